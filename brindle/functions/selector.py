"""Selector language: ``*`` or ``field[:type]=value`` / ``field[:type]=low-high``, joined by commas.

Types are int, float and str (the default). A ``-`` after the first character of a value makes an
inclusive range. All conditions must hold. An unknown field or type is an error when the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = {"int": (int, "long"), "float": (float, "double"), "str": (str, "string")}


def _condition(item: str, columns: list[str]) -> Column:
    left, sign, value = item.partition("=")
    if not sign:
        raise ValueError(f"selector {item!r} has no '='")
    field, _, kind = left.partition(":")
    kind = kind or "str"
    if kind not in TYPES:
        raise ValueError(f"selector type {kind!r} is not one of {sorted(TYPES)}")
    if field not in columns:
        raise KeyError(field)
    parse, sql_type = TYPES[kind]
    column = F.col(f"`{field}`").cast(sql_type)
    dash = value.find("-", 1)
    if dash < 0:
        return column == F.lit(parse(value))
    return column.between(F.lit(parse(value[:dash])), F.lit(parse(value[dash + 1 :])))


def selector(text: str, columns: list[str]) -> Column:
    """The predicate that ``text`` states over a table with these columns."""
    test = F.lit(True)
    for item in text.split(","):
        if item.strip() != "*":
            test &= _condition(item.strip(), columns)
    return test


def select_entries(df: DataFrame, text: str, max_entries: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Rows that meet the selector. ``max_entries`` limits the rows **before** they are tested."""
    if max_entries is not None:
        df = df.orderBy(*(order_by or df.columns)).limit(max_entries)
    return df.filter(selector(text, df.columns))
