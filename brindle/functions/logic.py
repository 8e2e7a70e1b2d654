"""Comparison, gates and routing. Null operands are false, never unknown; a blocked value is a row that goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {"is": "__eq__", "not": "__ne__", ">": "__gt__", "<": "__lt__", ">=": "__ge__", "<=": "__le__"}


def compare(a: Column, b: Column, op: str, cast: str = "auto") -> Column:
    """``auto`` compares as numbers if both are numbers, else as text. Unknown operators and failed casts are false."""
    if op == "in":
        return contains(a, b)
    if op not in _OPS:
        return F.lit(False)
    test = lambda x, y: getattr(x, _OPS[op])(y)
    text_a, text_b = a.cast("string"), b.cast("string")
    if cast in ("int", "float"):
        kind = "long" if cast == "int" else "double"
        made = test(a.try_cast(kind), b.try_cast(kind))
    elif cast == "string":
        made = test(text_a, text_b)
    else:
        x, y = a.try_cast("double"), b.try_cast("double")
        made = F.when(x.isNotNull() & y.isNotNull(), test(x, y)).otherwise(test(text_a, text_b))
    return F.coalesce(made, F.lit(False))


def contains(a: Column, b: Column) -> Column:
    """Text ``a`` within text ``b``; a numeric ``a`` also if its digits occur in order with gaps."""
    needle, hay = a.cast("string"), b.cast("string")
    spread = F.array_join(F.transform(F.split(needle, ""), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), ".*")
    numeric = needle.rlike(r"^\s*[+-]?\d+(?:\.\d+)?\s*$")
    return F.coalesce(F.contains(hay, needle) | (numeric & F.regexp_like(hay, F.concat(F.lit("(?s).*"), spread, F.lit(".*")))), F.lit(False))


def contains_item(a: Column, items: Column) -> Column:
    return F.coalesce(F.array_contains(F.transform(items, lambda x: x.cast("string")), a.cast("string")), F.lit(False))


def contains_key(a: Column, mapping: Column) -> Column:
    return contains_item(a, F.map_keys(mapping))


def gate(a: Column, b: Column | None, kind: str) -> Column:
    x, y = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False)) if b is not None else F.lit(False)
    return {"AND": x & y, "OR": x | y, "NOT": ~x, "XOR": x != y, "NAND": ~(x & y), "NOR": ~(x | y)}.get(kind, F.lit(False))


def if_else(test: Column, yes: Column, no: Column) -> Column:
    """Only the branch that is taken is computed."""
    return F.when(F.coalesce(test, F.lit(False)), yes).otherwise(no)


def switch(values: list[Column], index: Column) -> Column:
    """struct(value, count): the value at ``index`` if it is there, else the first that is; how many are there."""
    items = F.array(*values)
    there = F.filter(items, lambda x: x.isNotNull())
    return F.struct(F.coalesce(F.get(items, index), F.get(there, F.lit(0))).alias("value"), F.size(there).cast("long").alias("count"))


def route(df: DataFrame, index: Column, branches: int = 5) -> list[DataFrame]:
    """One table for each branch; the index is clamped to the first and last."""
    at = F.greatest(F.lit(0), F.least(index, F.lit(branches - 1)))
    return [df.filter(at == k) for k in range(branches)]


def pass_gate(df: DataFrame, value: Column, enabled: Column) -> DataFrame:
    """Rows that are let through; the others are blocked."""
    return df.filter(F.coalesce(enabled, F.lit(False)) & value.isNotNull())


def match_index(text: Column, values: list[Column], mode: str = "is", no_match: int = 0, multi: int = -1) -> Column:
    """1-based place of the only value that fits (``is``: equal, ``in``: part of the text); empty values never do."""
    items = F.array(*[F.coalesce(v, F.lit("")) for v in values[: max(1, min(len(values), 64))]])
    fits = lambda v: (v != "") & ((v == text) if mode == "is" else F.contains(text, v))
    hits = F.filter(F.transform(items, lambda v, i: F.when(fits(v), i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(hits) == 0, no_match).when(F.size(hits) > 1, multi).otherwise(F.get(hits, F.lit(0))).cast("long")


def pick(items: Column, index: Column) -> Column:
    """The item at the 1-based index; null (to be blocked) if it is out of range or empty."""
    found = F.get(items, index - 1)
    return F.when(found != "", found)


def pack(values: list[Column]) -> Column:
    """Values that are connected (not null), in order; later ones move up."""
    return F.filter(F.array(*values), lambda x: x.isNotNull())


def unpack(package: Column, size: int) -> Column:
    """struct(out_1 .. out_n); null beyond the end."""
    return F.struct(*[F.get(package, F.lit(k)).alias(f"out_{k + 1}") for k in range(size)])


def counter(run: Column, start: int, step: int, limit: int) -> Column:
    """struct(value, done, progress, remaining) at the given run (from 0), in closed form."""
    last = max(0, -(-(limit - start + 1) // step)) if step > 0 else None
    at = F.lit(start) + step * (F.least(run, F.lit(last)) if last is not None else run)
    return F.struct(
        F.least(at, F.lit(limit)).cast("long").alias("value"), (at > limit).alias("done"),
        F.least(F.lit(1.0), at / max(limit, 1)).cast("double").alias("progress"), F.greatest(F.lit(0), limit - at + 1).cast("long").alias("remaining"),
    )
