"""Text operators as column expressions (built-in functions only, unless said otherwise)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"


def strip(text: Column) -> Column:
    """Without white space (of all Unicode) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Each run of white space becomes one space; none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def title(text: Column) -> Column:
    """A capital after every character that is not a letter, small letters elsewhere."""
    chars = F.split(text, "")
    is_letter = lambda c: c.rlike(r"^\p{L}$")
    folded = F.transform(chars, lambda c, i: F.when((i > 0) & is_letter(F.coalesce(F.get(chars, i - 1), F.lit(""))), F.lower(c)).otherwise(F.upper(c)))
    return F.array_join(folded, "")


def literal_replace(text: Column, old: str, new: str) -> Column:
    """``old`` is literal; an empty one inserts ``new`` around every character."""
    if old == "":
        chars = F.filter(F.split(text, ""), lambda c: c != "")
        return F.concat(F.lit(new), F.array_join(F.transform(chars, lambda c: F.concat(c, F.lit(new))), ""))
    return F.replace(text, F.lit(old), F.lit(new))


def slice_text(text: Column, spec: str) -> Column:
    """``i`` (empty if negative or out of range), ``a:b`` (negative numbers count from the end); else unchanged."""
    parts = spec.split(":")
    try:
        bounds = [int(p) if p.strip() else None for p in parts]
    except ValueError:
        return text
    if len(parts) == 1:
        if bounds[0] is None:
            return text
        return F.substring(text, bounds[0] + 1, 1) if bounds[0] >= 0 else F.lit("")
    if len(parts) > 2:
        return text
    n = F.length(text)

    def place(b: int | None, default: Column) -> Column:
        return default if b is None else F.least(F.lit(b), n) if b >= 0 else F.greatest(n + b, F.lit(0))

    start, end = place(bounds[0], F.lit(0)), place(bounds[1], n)
    return F.when(end > start, text.substr(start + 1, end - start)).otherwise("")


def string_op(text: Column, operation: str, a: str = "", b: str = "") -> Column:
    """struct(text_out, bool_out, int_out); an unknown operation gives (text, false, length)."""
    n, yes = F.length(text), F.lit(True)
    made = {
        "upper": lambda: (F.upper(text), yes, n),
        "lower": lambda: (F.lower(text), yes, n),
        "strip": lambda: (strip(text), yes, F.length(strip(text))),
        "title": lambda: (title(text), yes, n),
        "replace": lambda: (literal_replace(text, a, b), yes, F.length(literal_replace(text, a, b))),
        "contains": lambda: (text, F.contains(F.lower(text), F.lit(a.lower())), n),
        "startswith": lambda: (text, text.startswith(a), n),
        "endswith": lambda: (text, text.endswith(a), n),
        "length": lambda: (text, n > 0, n),
        "slice": lambda: (slice_text(text, a), yes, F.length(slice_text(text, a))),
    }.get(operation, lambda: (text, F.lit(False), n))()
    return F.struct(made[0].alias("text_out"), made[1].alias("bool_out"), made[2].cast("long").alias("int_out"))


def join_parts(parts: list[Column], separator: str, skip_empty: bool = True) -> Column:
    """struct(text, count) of the parts that are not null, stripped."""
    kept = F.transform(F.filter(F.array(*parts), lambda x: x.isNotNull()), strip)
    kept = F.filter(kept, lambda x: x != "") if skip_empty else kept
    return F.struct(F.array_join(kept, separator).alias("text"), F.size(kept).cast("long").alias("count"))


def unescape(delimiter: str) -> str:
    return delimiter.replace("\\n", "\n").replace("\\t", "\t")


def split_items(text: Column, delimiter: str, max_splits: int = -1) -> Column:
    """Stripped items that are not empty; ``max_splits`` is the number of cuts."""
    pattern = re.escape(unescape(delimiter))
    return F.filter(F.transform(F.split(text, pattern, max_splits + 1 if max_splits >= 0 else -1), strip), lambda x: x != "")


def split_text(text: Column, delimiter: str, max_splits: int = -1) -> Column:
    items = split_items(text, delimiter, max_splits)
    at = lambda i: F.coalesce(F.get(items, i), F.lit(""))
    return F.struct(F.array_join(items, "\n").alias("items"), F.size(items).cast("long").alias("count"), at(F.lit(0)).alias("first"), at(F.size(items) - 1).alias("last"))


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's dialect; an error where the two differ beyond names and letters."""
    re.compile(pattern)
    return re.sub(r"\(\?P<(\w+)>", r"(?<\1>", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)).replace(r"\Z", r"\z")


def java_replacement(replacement: str) -> str:
    out = re.sub(r"\\(\d)|\\g<(\w+)>|\$", lambda m: f"${m[1]}" if m[1] else f"${{{m[2]}}}" if m[2] and not m[2].isdigit() else f"${m[2]}" if m[2] else r"\$", replacement)
    return out


def regex_extract(text: Column, pattern: str, mode: str, replacement: str = "") -> Column:
    """struct(result, found, groups, count). A bad pattern, or a match with a group that takes no part, gives (text, false, '', 0)."""
    miss = (text, F.lit(False), F.lit(""), F.lit(0))
    try:
        n_groups, java = re.compile(pattern).groups, java_pattern(pattern)
    except re.error:
        mode = "none"
    found = lambda c: F.coalesce(c, F.lit(False))
    if mode == "match":
        whole = F.regexp_extract(text, f"({java})" if n_groups == 0 else java, 0)
        hit = found(text.rlike(java))
        groups = F.concat_ws("\n", *[F.regexp_extract(text, java, k + 1) for k in range(n_groups)]) if n_groups else whole
        made = (F.when(hit, whole).otherwise(""), hit, F.when(hit, groups).otherwise(""), hit.cast("int"))
    elif mode == "findall":
        lists = [F.regexp_extract_all(text, F.lit(java), F.lit(k)) for k in (range(1, n_groups + 1) if n_groups else [0])]
        flat = lists[0] if len(lists) == 1 else F.transform(F.arrays_zip(*[x.alias(f"g{i}") for i, x in enumerate(lists)]), lambda z: F.concat_ws(", ", *[z[f"g{i}"] for i in range(len(lists))]))
        joined = F.array_join(flat, "\n")
        made = (joined, F.size(flat) > 0, joined, F.size(flat))
    elif mode == "replace":
        count = F.regexp_count(text, F.lit(java))
        made = (F.regexp_replace(text, java, java_replacement(replacement)), count > 0, text, count)
    elif mode == "split":
        parts = F.filter(F.transform(F.split(text, java), strip), lambda x: x != "")
        joined = F.array_join(parts, "\n")
        made = (joined, F.size(parts) > 1, joined, F.size(parts))
    else:
        made = miss
    return F.struct(made[0].alias("result"), made[1].alias("found"), made[2].alias("groups"), made[3].cast("long").alias("count"))


def concatenate(parts: list[Column], delimiter: str = ", ", clean_whitespace: bool = True, count: int | None = None) -> Column:
    """Parts that are not empty, joined; 2 to 64 of them are used."""
    used = parts[: max(2, min(count if count is not None else len(parts), 64))]
    texts = F.transform(F.array(*[F.coalesce(p, F.lit("")) for p in used]), lambda x: collapse(x) if clean_whitespace else x)
    return F.array_join(F.filter(texts, lambda x: x != ""), unescape(delimiter))


def render_template(template: Column, names: list[str], values: list[Column]) -> Column:
    """struct(text, missing): placeholders are filled in turn; one without a value goes with the commas beside it."""
    result, missing = template, F.array().cast("array<string>")
    for name, value in zip(names, values):
        mark, value = "{" + name + "}", strip(F.coalesce(value.cast("string"), F.lit("")))
        there = F.contains(result, F.lit(mark))
        missing = F.when(there & (value == ""), F.concat(missing, F.array(F.lit(name)))).otherwise(missing)
        cut = F.regexp_replace(result, r"(?U),?\s*\{" + re.escape(name) + r"\}\s*,?", "")
        result = F.when(there & (value != ""), F.replace(result, F.lit(mark), value)).when(there, cut).otherwise(result)
    result = strip(F.btrim(F.regexp_replace(result, r"(?U)\s{2,}", " "), F.lit(", ")))
    return F.struct(result.alias("text"), F.array_join(missing, ", ").alias("missing"))


def schedule(prompts: Column, step: Column, total: Column, mode: str, seed: int = 0) -> Column:
    """struct(prompt, progress, index). ``random`` is a hash of seed and step: repeatable, not Python's generator."""
    lines = split_items(prompts, "\n")
    n = F.size(lines)
    if mode == "sequential":
        index = F.least(F.floor(step / F.greatest(F.lit(1), F.floor(total / F.greatest(n, F.lit(1))))), n - 1)
    elif mode == "pingpong":
        cycle = F.greatest((n - 1) * 2, F.lit(1))
        spot = F.pmod(step, cycle)
        index = F.when(n <= 1, 0).when(spot < n, spot).otherwise((n - 1) * 2 - spot)
    elif mode == "random":
        index = F.pmod(F.xxhash64(F.lit(seed) + step), F.greatest(n, F.lit(1)))
    else:
        index = F.lit(0)
    index = F.greatest(F.lit(0), F.least(index, n - 1)).cast("long")
    progress = F.when(n > 0, F.least(F.lit(1.0), step / F.greatest(total, F.lit(1)))).otherwise(0.0)
    return F.struct(F.coalesce(F.get(lines, index.cast("int")), F.lit("")).alias("prompt"), progress.cast("double").alias("progress"), index.alias("index"))


def natural_key(text: Column) -> Column:
    """Text and number parts in turn, so that img2 comes before img10; arrays of structs compare part by part."""
    lower = F.lower(text)
    words = F.split(lower, r"\d+")
    numbers = F.regexp_extract_all(lower, F.lit(r"(\d+)"), F.lit(1))
    return F.transform(words, lambda w, i: F.struct(w.alias("text"), F.coalesce(F.get(numbers, i).cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)")).alias("number")))


def path_parts(path: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), r"[\\/]+"), strip), lambda p: p != "")


def base_name(path: Column) -> Column:
    return F.coalesce(F.get(path_parts(path), F.size(path_parts(path)) - 1), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def context_names(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n,;|]"), strip), lambda p: p != "")


def hex_color(text: Column, default: tuple[int, int, int] = (255, 255, 255)) -> Column:
    """struct(r, g, b) of 3 or 6 hexadecimal digits, else the default."""
    bare = F.ltrim(strip(F.coalesce(text, F.lit(""))), F.lit("#"))
    full = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    good = full.rlike("^[0-9a-fA-F]{6}$")
    part = lambda k: F.when(good, F.conv(F.substring(full, 2 * k + 1, 2), 16, 10).cast("int")).otherwise(default[k])
    return F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by 64 steps of Euclid's rule, enough for 32-bit numbers."""
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0)).otherwise(F.try_mod(s["x"], s["y"])).cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda s: s["x"])


def ratio_label(width: Column, height: Column) -> Column:
    w, h = F.greatest(width.cast("long"), F.lit(1)), F.greatest(height.cast("long"), F.lit(1))
    d = gcd(w, h)
    a, b = (w / d).cast("long"), (h / d).cast("long")
    return F.when((a > 100) | (b > 100), F.concat(F.format_string("%.3f", w / h), F.lit(":1"))).otherwise(F.concat_ws(":", a.cast("string"), b.cast("string")))


def short_name(name: Column) -> Column:
    return F.when(F.length(name) > 13, F.concat(F.substring(name, 1, 11), F.lit(".."))).otherwise(name)
