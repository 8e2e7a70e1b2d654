"""Personal data: spans found by exact patterns, and more by gradient-boosted trees over candidates.

Base spans of four kinds come from one pattern each and a test (octets, Luhn sum, number of digits). For further ones, generators of
high recall propose spans of each kind in what the base spans leave (those of different kinds may overlap): addresses with the signs spelt out, hexadecimal addresses,
long numbers in any grouping, numbers without a country code. Counts of signs, tests of form and words before the span are the features of boosted
trees, one set for each kind; a span is taken where the trees' sum reaches the kind's threshold, at which the probability calibrated on rows
that the trees have not seen is ``SURE`` or more.

All that touches the rows is built-in functions, in one narrow stage: ``regexp_extract_all`` and ``split`` give matches and gaps,
running sums of their lengths the places, and the trees are nested CASE expressions over whole numbers. Patterns start once for each
run of signs and do not backtrack, so a text costs time in proportion to its length. The trees are fitted on the driver, on a labelled table of made-up
spans (``labelled``, a few thousand rows of fixed number) that uses no text of any table.

Defined cases: a null text counts as empty and has no spans; places are code points, ends are exclusive; rows are judged one by one, so
repeated rows, null ids and further columns (which pass through) do not matter; a column named like a result is
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import let

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base spans. The first form is for Spark: a match starts at the start of a run of its signs, or where the
# last match ended, as any other start in the run would reach the same signs; the second is the plain form.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_OCTETS = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

_AT = r"(?:\x20?[\[(]\x20?(?:at|AT|@)\x20?[\])]\x20?|\x20@\x20|@)"
_DOT = r"(?:\x20?[\[(]\x20?(?:dot|DOT|\.)\x20?[\])]\x20?|\x20(?:dot|DOT)\x20|\.)"
_SITE = r"[A-Za-z0-9-]{1,63}"
_MAIL = rf"(?:{_AT}{_SITE}(?:{_DOT}{_SITE}){{1,4}}|\x20(?:at|AT)\x20{_SITE}(?:\x20(?:dot|DOT)\x20{_SITE}){{1,4}})"
MORE = {
    "email": (rf"[A-Za-z0-9._%+-]{{1,64}}+{_MAIL}", rf"[A-Za-z0-9._%+-]{{1,64}}{_MAIL}"),
    "ip": (r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){3,7}|[0-9]{1,3}(?:\x20?[\[(]?(?:\.|dot)[\])]?\x20?[0-9]{1,3}){3}",) * 2,
    "card": (r"[0-9](?:[\x20.-]{0,2}[0-9]){11,18}",) * 2,
    "phone": (r"(?:\+?[0-9]{1,3}[\x20./-])?(?:\(?[0-9]{2,5}\)?[\x20./-]{1,2}){1,4}[0-9]{3,8}",) * 2,
}
# What a text must hold for a match; most texts are passed over by it.
NEEDS = {
    "email": (r"@[A-Za-z0-9-]", r"@|[\[(]\x20?(?:at|AT)\x20?[\])]|\x20(?:dot|DOT)\x20"),
    "ip": (r"[0-9]\.[0-9]", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:|[0-9]\x20?[\[(]?(?:\.|dot)[\])]?\x20?[0-9]"),
    "card": (r"(?:[0-9][\x20-]?){15}[0-9]", r"(?:[0-9][\x20.-]{0,2}){11}[0-9]"),
    "phone": (r"\+[0-9]", r"[0-9]\)?[\x20./-]{1,2}[0-9]"),
}
CONTEXT = 24

# Words before a span that speak for a kind, in the languages of the corpus, and such that speak for other numbers.
WORDS = {
    "email": "mail|courriel|correo|contact|kontakt|write to|schreib|escrib|inbox",
    "ip": r"(?:^|[^a-z0-9])ip(?:[^a-z0-9]|\z)|ipv|host|server|serveur|servidor|gateway|router|ping|login|client",
    "card": "card|visa|credit|debit|karte|carte|tarjeta|amex|paid with",
    "phone": r"(?:^|[^a-z])tel[^a-z]|phone|telefon|call|mobil|cell|fax|whatsapp|anruf|appel|llam|sms|dial",
}
OTHER = r"order|invoice|isbn|article|item|version|page|section|serial|reference|number of|total|price|date|seit|depuis|desde|since|figure|table|row|build|part|track|score"

FEATURES = ("digits", "letters", "size", "groups", "blanks", "dots", "dashes", "colons", "brackets", "luhn", "octets", "dated", "spelt", "known_end", "first", "tight_before", "tight_after", "plus_before", "money_before", "own_word", "other_word")
_ENDS = r"(?:com|net|org|edu|gov|io|info|de|fr|es|uk|eu)\z"
_DATED = r"^(?:(?:19|20)[0-9][0-9][\x20./-][0-9]{1,2}[\x20./-][0-9]{1,2}|[0-9]{1,2}[\x20./-][0-9]{1,2}[\x20./-](?:19|20)[0-9][0-9])$"
_SPELT = r"\x20(?:at|dot)\x20|[\[(]\x20?(?:at|dot|@|\.)\x20?[\])]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DOUBLED = "0516273849"  # at place v the digit whose double has v as its digit sum


class Dialect:
    """How an SQL dialect says what the features need."""

    def __init__(self, test: str, replace: str) -> None:
        self._test, self._replace = test, replace

    def test(self, value: str, pattern: str) -> str:
        return self._test.format(value, self.text(pattern))

    def replace(self, value: str, pattern: str, new: str) -> str:
        return self._replace.format(value, self.text(pattern), new)

    def text(self, pattern: str) -> str:
        return f"'{pattern}'"


class SparkDialect(Dialect):
    def text(self, pattern: str) -> str:
        return "r'" + pattern + "'"


SPARK = SparkDialect("rlike({0}, {1})", "regexp_replace({0}, {1}, '{2}')")
DUCK = Dialect("regexp_matches({0}, {1})", "regexp_replace({0}, {1}, '{2}', 'g')")


def features(kind: str, d: Dialect, x: str, before: str, after: str) -> dict[str, str]:
    """SQL of each feature (whole numbers) of a candidate ``x`` between two gaps."""
    lower = lambda v: f"translate({v}, '{_UPPER}', '{_LOWER}')"
    count = lambda signs: f"length({x}) - length(translate({x}, '{signs}', ''))"
    flag = lambda value, pattern: f"CASE WHEN {d.test(value, pattern)} THEN 1 ELSE 0 END"
    digits = d.replace(x, "[^0-9]", "")
    padded = f"lpad({digits}, 20, '0')"
    places = [f"CAST(substring({padded}, {20 - i}, 1) AS INT)" if i % 2 == 0 else f"instr('{_DOUBLED}', substring({padded}, {20 - i}, 1)) - 1" for i in range(20)]
    return {
        "digits": f"length({digits})",
        "letters": count(_UPPER + _LOWER),
        "size": f"length({x})",
        "groups": f"length({d.replace(d.replace(x, '[^0-9]', ' '), '[0-9]+', '#')}) - length(translate({d.replace(d.replace(x, '[^0-9]', ' '), '[0-9]+', '#')}, '#', ''))",
        "blanks": count(" "),
        "dots": count("."),
        "dashes": count("-"),
        "colons": count(":"),
        "brackets": count("()[]"),
        "luhn": f"CASE WHEN ({' + '.join(places)}) % 10 = 0 THEN 1 ELSE 0 END",
        "octets": flag(d.replace(x, "[^0-9]+", "."), _OCTETS),
        "dated": flag(x, _DATED),
        "spelt": flag(lower(x), _SPELT),
        "known_end": flag(lower(x), _ENDS),
        "first": f"CAST(substring({padded}, CAST(least(20, greatest(1, 21 - length({digits}))) AS INT), 1) AS INT)",
        "tight_before": flag(before, r"[A-Za-z0-9_]\z"),
        "tight_after": flag(after, "^[A-Za-z0-9_]"),
        "plus_before": flag(before, r"[+]\z"),
        "money_before": flag(before, r"[$€£#%][ ]?\z"),
        "own_word": flag(lower(before), WORDS[kind]),
        "other_word": flag(lower(before), OTHER),
    }


def _luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else _DOUBLED.index(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def features_of(kind: str, x: str, before: str, after: str) -> list[int]:
    """The same features of one candidate, for the labelled table."""
    lower = lambda v: "".join(c.lower() if c in _UPPER else c for c in v)
    digits = re.sub("[^0-9]", "", x)
    has = lambda pattern, v: int(re.search(pattern.replace(r"\z", r"\Z"), v) is not None)
    count = lambda signs: sum(c in signs for c in x)
    return [
        len(digits), count(_UPPER + _LOWER), len(x), len(re.findall("[0-9]+", x)), count(" "), count("."), count("-"), count(":"), count("()[]"), int(_luhn(digits[:20])),
        has(_OCTETS, re.sub("[^0-9]+", ".", x)), has(_DATED, x), has(_SPELT, lower(x)), has(_ENDS, lower(x)), int(digits[0]) if digits else 0,
        has(r"[A-Za-z0-9_]\z", before), has("^[A-Za-z0-9_]", after), has("[+]$", before), has(r"[$€£#%][ ]?\z", before), has(WORDS[kind], lower(before)), has(OTHER, lower(before)),
    ]


def labelled() -> list[tuple[str, str, str, str, int]]:
    """Rows (kind, before, span, after, label) of made-up spans: forms of each kind, and numbers and words that only look like it."""
    draw = random.Random(11)
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda: "".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4)))
    neutral = lambda: f"{word()} {word()} "
    clean = lambda pattern: draw.choice([w for w in pattern.split("|") if w.replace(" ", "").isalpha()])
    own = lambda kind: f"{word()} {clean(WORDS[kind])}{draw.choice([': ', ' ', ' is ', ', '])}"
    other = lambda: f"{word()} {clean(OTHER)}{draw.choice([' ', ': ', ' # '])}"
    after = lambda: draw.choice([" ", ".", ", ", "\n", ""])

    def luhn_number(n: int) -> str:
        body = draw.choice("3456") + digits(n - 2)
        return next(body + c for c in "0123456789" if _luhn(body + c))

    def grouped(number: str, sizes, joint: str) -> str:
        out, at = [], 0
        for s in sizes:
            out.append(number[at : at + s])
            at += s
        return joint.join(out + ([number[at:]] if number[at:] else []))

    rows = []

    def put(kind, before, span, label):
        rows.append((kind, before, span, after(), label))

    for _ in range(300):
        end = draw.choice(["com", "org", "de", "net", "fr", "io"])
        at, dot = draw.choice([(" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", "."), ("(@)", "(.)")])
        put("email", draw.choice([own("email"), neutral()]), f"{word()}{draw.choice(['', '.', '_'])}{word()}{at}{word()}{dot}{end}", 1)
        put("email", draw.choice([neutral(), other()]), f"{word()}{draw.choice([' @ ', ' (at) '])}{word()}.{draw.choice(['', word()])}{word()}", 0)
        put("email", draw.choice([neutral(), other()]), f"{word()} at {word()} dot {word()}", 0)
        quad = [str(draw.randint(0, 255)) for _ in range(4)]
        put("ip", draw.choice([own("ip"), neutral()]), ":".join("%x" % draw.randint(0, 65535) for _ in range(8)), 1)
        put("ip", draw.choice([own("ip"), neutral()]), draw.choice(["[.]", "(.)", "[dot]"]).join(quad), 1)
        put("ip", draw.choice([neutral(), other()]), ":".join(digits(2) for _ in range(draw.choice([4, 5]))), 0)
        put("ip", draw.choice([neutral(), other()]), draw.choice([" . ", ". "]).join(digits(draw.randint(1, 3)) for _ in range(4)), 0)
        n = draw.choice([14, 15, 15, 16, 16, 19])
        put("card", draw.choice([own("card"), own("card"), neutral()]) if n != 14 else own("card"), grouped(luhn_number(n), draw.choice([(4, 4, 4), (4, 6)]), draw.choice([".", "  ", " - "[:2]])) if n > 14 else luhn_number(n), 1)
        put("card", own("card"), grouped(luhn_number(15), (4, 6), draw.choice(["", " ", "-"])), 1)
        for make in (lambda: digits(draw.randint(12, 19)), lambda: grouped(digits(16), (4, 4, 4), draw.choice([" ", "-", "."])), lambda: luhn_number(draw.choice([12, 13]))):
            put("card", draw.choice([neutral(), other()]), make(), 0)
        joint = draw.choice([" ", "-", ".", "/"])
        put("phone", own("phone"), draw.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(6)}", grouped(digits(10), (3, 3), joint), grouped("0" + digits(10), (4, 3), joint), grouped("00" + digits(11), (4, 3, 3), " "), grouped("0" + digits(8), (2, 2, 2), joint)]), 1)
        put("phone", neutral(), f"{draw.choice(['', '', '1 ', '+1 ', '+44 '])}({digits(3)}) {digits(3)}-{digits(4)}", 1)
        year = f"{draw.choice(['19', '20'])}{digits(2)}"
        for make in (lambda: f"{year}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}"[:7] + "-" + digits(3), lambda: f"{draw.randint(1, 28):02d}.{draw.randint(1, 12):02d}.{year}", lambda: " ".join(digits(draw.randint(2, 4)) for _ in range(3)) + " " + digits(3), lambda: grouped(digits(10), (3, 3), joint), lambda: grouped(digits(13), (3, 1, 4), "-")):
            put("phone", draw.choice([neutral(), other(), neutral() + "$"]), make(), 0)
    draw.shuffle(rows)
    return rows


TREES, DEPTH, RATE, SHRINK, LEAST_LEAF, SURE, UNIT = 24, 3, 0.4, 1.0, 5, 0.9, 1_000_000


def _leaf(gap: np.ndarray, spread: np.ndarray) -> int:
    return round(UNIT * RATE * gap.sum() / (spread.sum() + SHRINK))


def _tree(x: np.ndarray, gap: np.ndarray, spread: np.ndarray, depth: int):
    """A leaf (a whole number) or (feature, bound, tree of those up to the bound, tree of the others), by the largest gain of the second-order loss."""
    gain = lambda g, s: g * g / (s + SHRINK)
    best = None
    for f in range(x.shape[1]) if depth else ():
        for bound in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= bound
            if min(low.sum(), (~low).sum()) >= LEAST_LEAF:
                won = gain(gap[low].sum(), spread[low].sum()) + gain(gap[~low].sum(), spread[~low].sum()) - gain(gap.sum(), spread.sum())
                if won > 1e-9 and (best is None or won > best[0] + 1e-9):
                    best = (won, f, int(bound), low)
    if best is None:
        return _leaf(gap, spread)
    _, f, bound, low = best
    return f, bound, _tree(x[low], gap[low], spread[low], depth - 1), _tree(x[~low], gap[~low], spread[~low], depth - 1)


def value_of(tree, x) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def fit(x: np.ndarray, y: np.ndarray, unseen: np.ndarray) -> tuple[list, int]:
    """Boosted trees by Newton steps of the logistic loss, and the least sum whose calibrated probability (a logistic fit on ``unseen`` rows) is ``SURE``."""
    total, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total / UNIT))
        trees.append(_tree(x[~unseen], (y - p)[~unseen], (p * (1 - p))[~unseen], DEPTH))
        total += np.array([value_of(trees[-1], r) for r in x])
    s, a, b = total[unseen] / UNIT, 1.0, 0.0
    smooth = np.where(y[unseen] > 0, (y[unseen].sum() + 1) / (y[unseen].sum() + 2), 1 / ((1 - y[unseen]).sum() + 2))
    both = np.stack([s, np.ones(len(s))])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-(a * s + b)))
        step = np.linalg.solve((both * (p * (1 - p))) @ both.T + 1e-6 * np.eye(2), both @ (smooth - p))
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return trees, math.ceil(UNIT * (math.log(SURE / (1 - SURE)) - b) / max(a, 0.1))


@lru_cache(maxsize=1)
def models() -> dict[str, tuple[list, int]]:
    """Trees and threshold of each kind, fitted on the labelled table; every fourth row is kept for the calibration."""
    rows, made = labelled(), {}
    for kind in KINDS:
        own = [r for r in rows if r[0] == kind]
        x = np.array([features_of(kind, *_in_context(r)) for r in own])
        made[kind] = fit(x, np.array([r[4] for r in own], float), np.arange(len(own)) % 4 == 0)
    return made


def _in_context(row) -> tuple[str, str, str]:
    return row[2], row[1][-CONTEXT:], row[3][:CONTEXT]


def tree_sql(tree, prefix: str) -> str:
    if not isinstance(tree, tuple):
        return str(tree)
    f, bound, low, high = tree
    return f"CASE WHEN {prefix}{FEATURES[f]} <= {bound} THEN {tree_sql(low, prefix)} ELSE {tree_sql(high, prefix)} END"


def score_sql(kind: str, prefix: str) -> str:
    return " + ".join(f"({tree_sql(t, prefix)})" for t in models()[kind][0])


SCAN = 256


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` over each prefix of an array of longs, in blocks, so that long arrays do not cost the square of their length."""

    def scan(items: Column, first: Column) -> Column:
        start = F.struct(first.alias("v"), F.array().cast("array<bigint>").alias("out"))
        step = lambda s, x: let(op(s["v"], x), lambda v: F.struct(v.alias("v"), F.concat(s["out"], F.array(v)).alias("out")))
        return F.aggregate(items, start, step, lambda s: s["out"])

    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / SCAN).cast("int")), lambda b: F.slice(values, b * SCAN + 1, F.lit(SCAN)))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda b: F.aggregate(b, zero, op))
        return let(scan(totals, zero), lambda before: F.flatten(F.transform(parts, lambda b, j: scan(b, F.coalesce(F.get(before, j - 1), zero)))))

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(let(blocks, joined))


def segments(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their places and the signs around, and the text between them: struct(found, gaps)."""

    def of(found: Column, gaps: Column) -> Column:
        long = lambda c: F.length(c).cast("long")
        steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: long(m) + long(g))
        item = lambda hi, m, g, h: F.struct(m.alias("x"), (hi - long(m)).alias("lo"), hi.alias("hi"), F.right(g, F.lit(CONTEXT)).alias("before"), F.left(h, F.lit(CONTEXT)).alias("after"))
        return let(running(steps, lambda a, b: a + b), lambda ends: F.transform(ends, lambda hi, i: item(hi, F.get(found, i), F.get(gaps, i), F.get(gaps, i + 1))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda gaps: F.struct(of(found, gaps).alias("found"), gaps.alias("gaps"))))


def _no_spans() -> Column:
    return F.array().cast("array<struct<x:string,lo:bigint,hi:bigint,before:string,after:string>>")


def passes(kind: str, d: Dialect, x: str) -> str:
    """SQL of the test that a base match has to pass."""
    f = features(kind, d, x, "''", "''")
    return {"email": "true", "ip": d.test(x, _OCTETS), "card": f"({f['digits']}) BETWEEN 16 AND 19 AND ({f['luhn']}) = 1", "phone": f"({f['digits']}) BETWEEN 8 AND 15"}[kind]


def spans(text: Column, docs: DataFrame, name: str = "spans") -> DataFrame:
    """``docs`` with ``name``: struct(base, spans), both arrays of (kind, lo, hi) by kind as listed and then place; ``text`` has no nulls."""
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() != name]
    kinds = range(len(KINDS))
    step = docs.select(F.struct(*own).alias("own"), text.alias("t")) if own else docs.select(F.lit(None).alias("own"), text.alias("t"))
    step = step.select("own", "t", *[F.when(F.col("t").rlike(NEEDS[k][0]), segments(F.col("t"), BASE[k][0])).alias(f"s{i}") for i, k in enumerate(KINDS)])
    step = step.select("own", F.col("t").alias("t0"), "s0", *[F.coalesce(F.expr(f"filter(s{i}.found, s -> {passes(k, SPARK, 's.x')})"), _no_spans()).alias(f"b{i}") for i, k in enumerate(KINDS)])
    base = [f"b{i}" for i in kinds]
    for i, k in enumerate(KINDS):  # write over the base spans of each kind
        if i:
            step = step.select("own", f"t{i}", *base, F.when(F.size(f"b{i}") > 0, segments(F.col(f"t{i}"), BASE[k][0])).alias(f"s{i}"))
        cover = f"CASE WHEN s IS NULL THEN '' WHEN {passes(k, SPARK, 's.x')} THEN repeat(char(1), length(s.x)) ELSE s.x END"
        masked = F.expr(f"array_join(zip_with(s{i}.gaps, s{i}.found, (g, s) -> concat(g, {cover})), '')")
        step = step.select("own", *base, F.when(F.size(f"b{i}") > 0, masked).otherwise(F.col(f"t{i}")).alias(f"t{i + 1}"))
    last = F.col(f"t{len(KINDS)}")
    step = step.select("own", *base, *[F.coalesce(F.when(last.rlike(NEEDS[k][1]), segments(last, MORE[k][0])["found"]), _no_spans()).alias(f"m{i}") for i, k in enumerate(KINDS)])
    described = lambda k: ", ".join(f"'{n}', {v}" for n, v in features(k, SPARK, "s.x", "s.before", "s.after").items())
    step = step.select("own", *base, *[F.expr(f"transform(m{i}, s -> named_struct('lo', s.lo, 'hi', s.hi, {described(k)}))").alias(f"m{i}") for i, k in enumerate(KINDS)])
    step = step.select("own", *base, *[F.expr(f"filter(m{i}, f -> {score_sql(k, 'f.')} >= {models()[k][1]})").alias(f"m{i}") for i, k in enumerate(KINDS)])
    named = lambda array, k: F.expr(f"transform({array}, s -> named_struct('kind', '{k}', 'lo', s.lo, 'hi', s.hi))")
    both = [F.array_sort(F.concat(named(f"b{i}", k), named(f"m{i}", k))) for i, k in enumerate(KINDS)]
    made = F.struct(F.concat(*[named(f"b{i}", k) for i, k in enumerate(KINDS)]).alias("base"), F.concat(*both).alias("spans"))
    return step.select(*([F.col("own.*")] if own else []), made.alias(name))


def find(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with the column ``name`` beside its own ones."""
    return spans(F.coalesce(F.col(f"`{text}`"), F.lit("")), docs, name)


def redact(docs: DataFrame, text: str = "text", name: str = "redacted") -> DataFrame:
    """``docs`` with ``name``, the text with each run of overlapping spans replaced by the kind of its first span in brackets."""
    found = find(docs, text, "__found" + "_" * max(map(len, docs.columns)))
    held = found.columns[-1]
    by_place = F.array_sort(F.transform(F.col(held)["spans"], lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), s["kind"].alias("kind"))))

    def cut(chars: Column, sorted_spans: Column) -> Column:
        ends = running(F.transform(sorted_spans, lambda s: s["hi"]), lambda a, b: F.greatest(a, b))

        def pieces(ends: Column) -> Column:
            opens = F.transform(F.filter(F.transform(sorted_spans, lambda s, i: F.struct(s.alias("s"), F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("e"), i.alias("i"))), lambda x: (x["i"] == 0) | (x["s"]["lo"] >= x["e"])), lambda x: x)
            last = F.element_at(ends, -1)

            def parts(opens: Column) -> Column:
                piece = lambda lo, hi: F.array_join(F.slice(chars, (lo + 1).cast("int"), (hi - lo).cast("int")), "")
                body = F.transform(opens, lambda x: F.concat(piece(F.when(x["i"] == 0, F.lit(0)).otherwise(x["e"]), x["s"]["lo"]), F.lit("["), x["s"]["kind"], F.lit("]")))
                return F.concat(F.array_join(body, ""), piece(last, F.size(chars).cast("long")))

            return let(opens, parts)

        return F.when(F.size(sorted_spans) == 0, F.array_join(chars, "")).otherwise(let(ends, pieces))

    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    made = let(by_place, lambda b: F.when(F.size(b) == 0, whole).otherwise(let(F.filter(F.split(whole, ""), lambda c: c != ""), lambda chars: cut(chars, b))))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name], made.alias(name))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = spans(F.coalesce("text", F.lit("")), docs).drop("text")
    said = lambda name: F.array_join(F.expr(f"transform(spans.{name}, s -> concat_ws(':', s.kind, s.lo, s.hi))"), ",")
    count = lambda k: F.size(F.expr(f"filter(spans.base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"))


def oracle_sql() -> str:
    """The query in SQL: the same patterns, tests and trees over unnested matches."""
    parts = ["t0 AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t0 FROM documents)"]
    for i, k in enumerate(KINDS):
        cut = lambda t, p: f"regexp_extract_all({t}, '{p}') AS m, regexp_split_to_array({t}, '{p}') AS g"
        parts.append(f"o{i} AS (SELECT rid, doc_id, {cut('t0', BASE[k][1])} FROM t0)")
        cover = f"CASE WHEN i > len(m) THEN '' WHEN {passes(k, DUCK, 'm[i]')} THEN repeat(chr(1), length(m[i])) ELSE m[i] END"
        some = f"len(list_filter(om, lambda x: {passes(k, DUCK, 'x')})) > 0"
        parts.append(f"c{i} AS (SELECT t{i}.rid, t{i}.doc_id, t{i}, {cut(f't{i}', BASE[k][1])}, o{i}.m AS om FROM t{i} JOIN o{i} USING (rid))")
        parts.append(f"t{i + 1} AS (SELECT rid, doc_id, CASE WHEN {some} THEN array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || {cover}), '') ELSE t{i} END AS t{i + 1} FROM c{i})")
        parts.append(f"n{i} AS (SELECT rid, doc_id, {cut(f't{len(KINDS)}', MORE[k][1])} FROM t{len(KINDS)})")
    parts.sort(key=lambda x: x[0] == "n")
    for i, k in enumerate(KINDS):
        for letter in "on":
            parts.append(f"{letter}{i}u AS (SELECT rid, doc_id, i, m[i] AS x, right(g[i], {CONTEXT}) AS b, left(g[i + 1], {CONTEXT}) AS a, length(m[i]) AS n, length(g[i]) AS skip FROM {letter}{i}, unnest(range(1, len(m) + 1)) r(i))")
            parts.append(f"{letter}{i}p AS (SELECT *, sum(n + skip) OVER (PARTITION BY rid ORDER BY i) AS hi FROM {letter}{i}u)")
        parts.append(f"b{i} AS (SELECT rid, {i} AS kind, true AS base, hi - n AS lo, hi FROM o{i}p WHERE {passes(k, DUCK, 'x')})")
        parts.append(f"f{i} AS (SELECT rid, hi - n AS lo, hi, {', '.join(f'{v} AS {name}' for name, v in features(k, DUCK, 'x', 'b', 'a').items())} FROM n{i}p)")
        parts.append(f"e{i} AS (SELECT rid, {i} AS kind, false AS base, lo, hi FROM f{i} f WHERE {score_sql(k, 'f.')} >= {models()[k][1]})")
    union = " UNION ALL ".join(f"SELECT * FROM {letter}{i}" for i in range(len(KINDS)) for letter in "be")
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    said = f"{names}[kind + 1] || ':' || CAST(lo AS BIGINT) || ':' || CAST(hi AS BIGINT)"
    counts = ", ".join(f"count(*) FILTER (base AND kind = {i}) AS n_{k}" for i, k in enumerate(KINDS))
    lists = f"coalesce(string_agg({said}, ',' ORDER BY kind, lo) FILTER (base), '') AS base, coalesce(string_agg({said}, ',' ORDER BY kind, lo, hi), '') AS spans"
    return f"""WITH {", ".join(parts)}, al AS ({union}), per AS (SELECT rid, {counts}, {lists} FROM al GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t0 LEFT JOIN per USING (rid)"""
