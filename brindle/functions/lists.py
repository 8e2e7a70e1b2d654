"""Operators on arrays of text, and batches (rows with a position)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LENGTH = re.compile(r"^len\s*(>=|<=|==|!=|>|<)\s*(\d+)$")


def condition(text: str):
    """A predicate on an item: contains / startswith / endswith / regex / equals with a colon, len with a comparison, else contains."""
    key, colon, value = text.partition(":")
    key, value = key.strip().lower(), value.strip()
    if colon and key in ("contains", "startswith", "endswith", "regex", "equals"):
        if key == "regex":
            try:
                re.compile(value)
            except re.error:
                return lambda x: F.lit(False)
        return {
            "contains": lambda x: F.contains(F.lower(x), F.lit(value.lower())),
            "startswith": lambda x: x.startswith(value),
            "endswith": lambda x: x.endswith(value),
            "regex": lambda x: x.rlike(value),
            "equals": lambda x: F.lower(x) == value.lower(),
        }[key]
    if m := _LENGTH.match(text.strip()):
        n = int(m[2])
        return {
            ">": lambda x: F.length(x) > n, "<": lambda x: F.length(x) < n, ">=": lambda x: F.length(x) >= n,
            "<=": lambda x: F.length(x) <= n, "==": lambda x: F.length(x) == n, "!=": lambda x: F.length(x) != n,
        }[m[1]]
    return lambda x: F.contains(F.lower(x), F.lit(text.lower()))


def filter_list(items: Column, text: str, mode: str = "include") -> Column:
    """struct(passed, rejected, n_passed, n_rejected): the two lists share out the items."""
    test = condition(text)
    keep = (lambda x: F.coalesce(test(x), F.lit(False))) if mode == "include" else (lambda x: ~F.coalesce(test(x), F.lit(False)))
    passed, rejected = F.filter(items, keep), F.filter(items, lambda x: ~keep(x))
    return F.struct(passed.alias("passed"), rejected.alias("rejected"), F.size(passed).cast("long").alias("n_passed"), F.size(rejected).cast("long").alias("n_rejected"))


def item_at(items: Column, index: Column, wrap: bool = True) -> Column:
    """struct(item, is_first, is_last, count); an empty list gives ('', true, true, 0)."""
    n = F.size(items)
    at = F.pmod(index, F.greatest(n, F.lit(1))) if wrap else F.greatest(F.lit(0), F.least(F.when(index < 0, n + index).otherwise(index), n - 1))
    return F.struct(
        F.coalesce(F.get(items, at), F.lit("")).alias("item"), ((n == 0) | (at == 0)).alias("is_first"),
        ((n == 0) | (at == n - 1)).alias("is_last"), n.cast("long").alias("count"),
    )


def reorder(items: Column, how: str, seed: int = 0) -> Column:
    """``reverse`` or ``shuffle`` (repeatable for a seed)."""
    return F.reverse(items) if how == "reverse" else F.shuffle(items, F.lit(seed)) if how == "shuffle" else items


def lines_table(df: DataFrame, text: Column) -> DataFrame:
    """A row for each line that is not empty, with its place and whether it is the first or last."""
    from brindle.functions.text import split_items

    out = df.withColumn("lines", split_items(text, "\n"))
    return out.select(*df.columns, F.posexplode("lines").alias("pos", "line"), F.size("lines").alias("n")).withColumns({"is_first": F.col("pos") == 0, "is_last": F.col("pos") == F.col("n") - 1})


def batch_slice(df: DataFrame, pos: Column, size: Column, index: int, end: int = -1, step: int = 1) -> DataFrame:
    """Rows from ``index`` to ``end``: -1 takes one row, other negatives count from the size; an empty result gives row 0."""
    start = F.greatest(F.lit(0), F.when(F.lit(index) < 0, size + index).otherwise(F.lit(index)))
    stop = start + 1 if end == -1 else F.when(F.lit(end) < 0, size + end + 1).otherwise(F.least(F.lit(end), size))
    none = (start >= size) | (stop <= start)
    return df.filter(((pos >= start) & (pos < stop) & ((pos - start) % step == 0)) | (none & (pos == 0)))


def merge_batches(*batches: DataFrame, pos: str = "pos") -> DataFrame:
    """All rows of all batches; ``source`` and the old position give the order."""
    marked = [b.withColumn("source", F.lit(k)) for k, b in enumerate(batches)]
    out = marked[0]
    for b in marked[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def align(left: DataFrame, right: DataFrame, left_size: int, right_size: int, pos: str = "pos") -> DataFrame:
    """Equal sizes pair by position, a single row pairs with all, else both are cut to the shorter."""
    if right_size == 1:
        return left.crossJoin(F.broadcast(right.drop(pos)))
    if left_size == 1:
        return right.crossJoin(F.broadcast(left.drop(pos)))
    return left.join(right, pos)
