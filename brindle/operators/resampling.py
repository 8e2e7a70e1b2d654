"""Resampling of images as tables of pixels (image_id, y, x, value): weights for each axis, joined and summed along rows, then columns.

A weight table says how much each source place counts for each target place. It depends on the two sizes only, has a few entries for each place of the longer side, and is
broadcast up to ``MOST_WEIGHTS`` entries (about 6 MB) and joined otherwise. Each axis is one shuffle with partial sums, whatever the number of images.

Two families of filters: ``bilinear``, ``bicubic`` and ``lanczos4`` look at 2, 4 and 8 places around a point and repeat the border; ``area`` averages the places that a target
covers. ``wide_bilinear``, ``wide_bicubic`` and ``lanczos`` widen with the reduction, so that every source place counts, and share the weight anew at the border.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_WEIGHTS = 250_000


def _cubic(a: float) -> Callable[[float], float]:
    def at(x: float) -> float:
        x = abs(x)
        if x < 1:
            return ((a + 2) * x - (a + 3)) * x * x + 1
        return (((x - 5) * x + 8) * x - 4) * a if x < 2 else 0.0

    return at


def _windowed_sinc(a: int) -> Callable[[float], float]:
    sinc = lambda x: math.sin(math.pi * x) / (math.pi * x) if x else 1.0
    return lambda x: sinc(x) * sinc(x / a) if abs(x) < a else 0.0


def _tent(x: float) -> float:
    return max(0.0, 1 - abs(x))


# (filter, reach)
POINT = {"bilinear": (_tent, 1), "bicubic": (_cubic(-0.75), 2), "lanczos4": (_windowed_sinc(4), 4)}
WIDE = {"wide_bilinear": (_tent, 1), "wide_bicubic": (_cubic(-0.5), 2), "lanczos": (_windowed_sinc(3), 3)}
METHODS = ("nearest", "area", *POINT, *WIDE)


def weights(old: int, new: int, method: str) -> list[tuple[int, int, float]]:
    """(target, source, weight) without zeros; the weights of a target sum to 1."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if old < 1 or new < 1:
        raise ValueError("sizes must be 1 or more")
    rows = []
    for t in range(new):
        found: dict[int, float] = {}
        if method == "nearest":
            found[t * old // new] = 1.0
        elif method == "area":
            places = range(t * old // new, -(-(t + 1) * old // new))
            found = dict.fromkeys(places, 1.0)
        elif method in POINT:
            filter_, reach = POINT[method]
            point = (t + 0.5) * old / new - 0.5
            for place in range(math.floor(point) - reach + 1, math.floor(point) + reach + 1):
                inside = min(max(place, 0), old - 1)
                found[inside] = found.get(inside, 0.0) + filter_(point - place)
        else:
            filter_, reach = WIDE[method]
            scale = old / new
            wide = max(scale, 1.0)
            middle = (t + 0.5) * scale
            for place in range(max(0, int(middle - reach * wide + 0.5)), min(old, int(middle + reach * wide + 0.5))):
                found[place] = filter_((place + 0.5 - middle) / wide)
        total = sum(found.values())
        rows += [(t, s, w / total) for s, w in sorted(found.items()) if w]
    return rows


def _along(pixels: DataFrame, axis: str, old: int, new: int, method: str) -> DataFrame:
    rows = weights(old, new, method)
    table = pixels.sparkSession.createDataFrame(rows, "__to long, __at long, __w double")
    other = "y" if axis == "x" else "x"
    joined = pixels.join(F.broadcast(table) if len(rows) <= MOST_WEIGHTS else table, F.col(axis) == F.col("__at"))
    return joined.groupBy("image_id", F.col(other).cast("long").alias(other), F.col("__to").alias(axis)).agg(F.sum(F.col("value") * F.col("__w")).alias("value"))


def to_bytes(value: Column) -> Column:
    """The nearest whole number (halves up) from 0 to 255, as 8-bit images keep it between the passes."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(value + 0.5).cast("double")))


def resample(pixels: DataFrame, old: tuple[int, int], new: tuple[int, int], method: str, bytes_: bool = False) -> DataFrame:
    """Images of size ``old`` (height, width) at size ``new``; all pixels of an image have to be there. ``bytes_`` rounds after each pass."""
    made = pixels.select("image_id", "y", "x", "value")
    for axis, k in (("x", 1), ("y", 0)):
        if method != "nearest" and old[k] == new[k]:  # every filter is exact at the same size
            made = made.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("value").cast("double").alias("value"))
        else:
            made = _along(made, axis, old[k], new[k], method)
        if bytes_:
            made = made.withColumn("value", to_bytes(F.col("value")))
    return made.select("image_id", "y", "x", "value")


def _sinc_columns(x: Column) -> Column:
    part = lambda v: F.when(F.abs(v) < 1e-12, 1.0).otherwise(F.sin(math.pi * v) / (math.pi * v))
    return F.when(F.abs(x) < 4, part(x) * part(x / 4)).otherwise(0.0)


def lanczos4_along(pixels: DataFrame, axis: str, old: int, new: Column, asked: Callable[[Column], Column] = lambda place: F.lit(True), sizes: DataFrame | None = None) -> DataFrame:
    """One pass of ``lanczos4`` where each row has the new size of its own image; ``pixels`` keeps the other columns of the image in ``plan``.

    Weights are made once for each size that occurs and joined by size and place. Only target places that are ``asked`` for are summed.
    ``sizes`` (size) holds the sizes that occur, if they are known without a pass over the pixels.
    """
    other = "y" if axis == "x" else "x"
    held = pixels.withColumn("__new", new.cast("long"))
    targets = (held.select("__new") if sizes is None else sizes.select(F.col("size").cast("long").alias("__new"))).distinct().withColumn("__to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__new") - 1)))
    point = targets.withColumn("__p", (F.col("__to") + 0.5) * F.lit(float(old)) / F.col("__new") - 0.5)
    taps = point.withColumn("__q", F.explode(F.transform(F.sequence(F.lit(-3), F.lit(4)), lambda k: F.floor("__p") + k)))
    inside = F.greatest(F.lit(0), F.least(F.lit(old - 1), F.col("__q")))
    raw = taps.groupBy("__new", "__to", inside.cast("long").alias("__at")).agg(F.sum(_sinc_columns(F.col("__p") - F.col("__q"))).alias("__w"))
    table = raw.withColumn("__w", F.col("__w") / F.sum("__w").over(Window.partitionBy("__new", "__to"))).filter("__w <> 0").withColumnRenamed("__new", "__size")
    joined = held.join(table, (F.col("__new") == F.col("__size")) & (F.col(axis) == F.col("__at"))).filter(asked(F.col("__to")))
    return joined.groupBy("image_id", "plan", F.col(other).cast("long").alias(other), F.col("__to").alias(axis)).agg(F.sum(F.col("value") * F.col("__w")).alias("value"))
