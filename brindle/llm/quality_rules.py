"""Quality rules: a table of thresholds compiled into one projection.

``measure`` computes word, symbol, stop-word and line counts of each text with built-in functions
only; ``compile_rules`` turns the rows of ``RULES`` into one boolean column. There is no shuffle and
no user function, so the work is one narrow stage of any size.

Defined cases: a null text counts as empty (no words, so it fails the base rules); a rule whose
denominator is zero sees the ratio 0; rows are judged one by one, so repeated rows, null ids and
further columns (which are passed through; columns of the same name as a result are replaced) do not
matter; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import let, words_of

WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for with as was on be by at this from or an it are he have not "
    "der die das und zu den von mit sich ein eine auf ist im dem nicht des für "
    "le la les de et en un une du que qui dans pour par sur avec est pas au "
    "el los las y se del con su al lo como más no para es"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a missing bound does not bind."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("words", "n_words", low=20),
    Rule("word_length", "word_chars", "n_words", low=2.5, high=12.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.04),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.4),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.5),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def _equals_neighbour(items: Column, key: str):
    def test(x: Column, j: Column) -> Column:
        before, after = F.get(items, j - 1), F.get(items, j + 1)
        return before[key].eqNullSafe(x[key]) | after[key].eqNullSafe(x[key])

    return test


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of ``width`` that begin at the sorted ``starts``."""
    steps = F.transform(starts, lambda s, j: F.least(F.lit(width), F.coalesce(F.get(starts, j + 1) - s, F.lit(width))))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of ``width`` words that the list holds twice or more.

    Windows are compared by a 64-bit hash first; those whose hash repeats are compared as text, so a
    collision cannot change the count.
    """
    n = F.size(words)

    # The last width - 1 keys are of shorter windows; exact() leaves those out.
    hashes = F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, width)]))

    def exact(keys: Column) -> Column:
        return let(
            F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: let(
                F.sort_array(
                    F.transform(
                        F.filter(F.filter(s, _equals_neighbour(s, "h")), lambda x: x["i"] <= n - width),
                        lambda x: F.struct(F.array_join(F.slice(words, x["i"] + 1, F.lit(width)), " ").alias("w"), x["i"].alias("i")),
                    )
                ),
                lambda e: let(F.sort_array(F.transform(F.filter(e, _equals_neighbour(e, "w")), lambda x: x["i"])), lambda starts: _covered(starts, width)),
            ),
        )

    found = let(hashes, lambda keys: F.when(F.size(F.array_distinct(keys)) < F.size(keys), exact(keys)).otherwise(0))
    return F.when(n >= width, found).otherwise(0)


def measure(text: Column) -> Column:
    """A struct of the counts that the rules use; each is a long."""
    text = F.coalesce(text, F.lit(""))
    bare = F.lit(" \t\n\x0b\x0c\r")
    with_word = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, bare)) > 0)
    stop = list(dict.fromkeys(v for w in STOP_WORDS for v in (w, w[0].upper() + w[1:])))

    def counts(w: Column, lines: Column) -> Column:
        firsts = F.transform(lines, lambda x: F.ltrim(x, bare))
        values = {
            "n_words": F.size(w),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")),
            "n_symbols": F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeat_words(w),
            "n_stop_words": F.size(F.filter(w, lambda x: F.rtrim(x, F.lit(".,;:")).isin(*stop))),
            "n_lines": F.size(lines),
            "n_bullet_lines": F.size(F.filter(firsts, lambda x: F.substring(x, 1, 1).isin("-", "*", "•"))),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x, bare).endswith("...") | F.rtrim(x, bare).endswith("…"))),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

    return let(words_of(text), lambda w: let(with_word, lambda lines: counts(w, lines)))


def compile_rules(rules=RULES) -> Column:
    """One boolean expression over the columns of ``measure``: true if every rule holds."""
    holds = F.lit(True)
    for r in rules:
        value = F.col(r.numerator).cast("double")
        if r.denominator:
            value = F.coalesce(F.try_divide(value, F.col(r.denominator)), F.lit(0.0))
        if r.low is not None:
            holds &= value >= r.low
        if r.high is not None:
            holds &= value <= r.high
    return holds


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept`` beside its own columns."""
    own = [c for c in docs.columns if c.lower() not in {*COUNTS, "base_failed", "kept"}]
    measured = docs.select(*[F.col(f"`{c}`") for c in own], measure(F.col(f"`{text}`")).alias("__m"))
    flat = measured.select(*[F.col(f"`{c}`") for c in own], *[F.col(f"__m.{c}").alias(c) for c in COUNTS])
    return flat.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & compile_rules(rules)})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")


def _sql_ratio(r: Rule) -> str:
    value = f"CAST({r.numerator} AS DOUBLE)"
    if r.denominator:
        value = f"coalesce({value} / nullif({r.denominator}, 0), 0.0)"
    tests = ([f"{value} >= {r.low}"] if r.low is not None else []) + ([f"{value} <= {r.high}"] if r.high is not None else [])
    return " AND ".join(tests)


ORACLE_COUNTS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
keyed AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k FROM win),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed),
starts AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM dup WHERE c > 1),
rep AS (SELECT doc_id, sum(step) AS n FROM starts GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(words, lambda x: list_contains([{", ".join(f"'{v}'" for s in dict.fromkeys(STOP_WORDS) for v in (s, s[0].upper() + s[1:]))}], rtrim(x, '.,;:')))) AS BIGINT) AS n_stop_words,
  CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
  CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines
  FROM w LEFT JOIN rep USING (doc_id))
"""

ORACLE_SQL = (
    ORACLE_COUNTS
    + f"""SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {" AND ".join(_sql_ratio(r) for r in RULES)} AS kept FROM m"""
)
