"""Polygons and small masks as pixels: runs of polygon fills, their areas and boxes, and masks pasted into boxes.

Polygons are drawn as annotation tools do: vertices are rounded on a grid five times as fine, edges are lines of that grid, and a column of pixels changes between in and out
where an edge passes its middle (from fine column 5k + 2 to 5k + 3). Where that happens has a closed form for each edge and column, so that nothing walks along edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.geometry import Box

FINE = 5


def _crossings(instances: DataFrame, keys: list[str], polygons: str, height: int, width: int) -> DataFrame:
    """keys, part, x and y: in column x, the pixels from row y on change between in and out of polygon ``part``."""
    parts = instances.select(*keys, F.posexplode(polygons).alias("__part", "__p")).filter("size(__p) >= 6")
    fine = lambda v: (v * FINE + 0.5).cast("long")
    count = F.floor(F.size("__p") / 2).cast("int")
    places = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(fine(F.get("__p", 2 * i)).alias("x"), fine(F.get("__p", 2 * i + 1)).alias("y")))
    ends = parts.select(*keys, "__part", places.alias("__v")).select(*keys, "__part", F.explode(F.arrays_zip(F.col("__v").alias("a"), F.concat(F.slice("__v", 2, F.size("__v") - 1), F.slice("__v", 1, 1)).alias("b"))).alias("e"))
    flat = F.abs(F.col("e.b.x") - F.col("e.a.x")) >= F.abs(F.col("e.b.y") - F.col("e.a.y"))
    turned = F.when(flat, F.col("e.a.x") > F.col("e.b.x")).otherwise(F.col("e.a.y") > F.col("e.b.y"))
    end = lambda c, first: F.when(turned == F.lit(first), F.col(f"e.b.{c}")).otherwise(F.col(f"e.a.{c}"))
    lines = ends.select(*keys, "__part", flat.alias("__flat"), *[end(c, first).alias(name) for c, first, name in (("x", True, "xa"), ("y", True, "ya"), ("x", False, "xb"), ("y", False, "yb"))])
    low, high = F.least("xa", "xb"), F.greatest("xa", "xb")
    first, last = F.greatest(F.lit(0), F.ceil((low - 2) / FINE)), F.least(F.lit(width - 1), F.floor((high - 3) / FINE))
    met = lines.filter(first <= last).withColumn("x", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    x, xa, ya = F.col("x"), F.col("xa"), F.col("ya")
    dx, dy = F.col("xb") - xa, F.col("yb") - ya
    row = lambda t: F.floor((2 * ya * dx + 2 * dy * t + dx) / (2 * dx))
    gentle = F.least(row(FINE * x + 2 - xa), row(FINE * x + 3 - xa))
    reached = dy * (2 * FINE * x + FINE - 2 * xa) / (2 * dx)  # steps down the edge until it passes the middle of the column
    steep = F.when(dx > 0, ya + F.ceil(reached) - 1).otherwise(ya + F.floor(reached))
    fine_row = F.when(F.col("__flat"), gentle).otherwise(steep)
    y = F.greatest(F.lit(0), F.least(F.lit(height), F.ceil((fine_row - 2) / FINE)))
    return met.select(*keys, "__part", "x", y.cast("long").alias("y"))


def polygon_runs(instances: DataFrame, keys: list[str], polygons: str, height: int, width: int) -> DataFrame:
    """keys, x, y0 and y1 (end exclusive): disjoint runs of pixels down the columns that any polygon of the instance covers.

    ``polygons`` holds array<array<double>> of x, y, x, y, ...; polygons of fewer than three points, null ones and parts outside the image have no pixels. Even-odd
    within a polygon, union over polygons. One exchange, by instance and column.
    """
    dealt = _crossings(instances, keys, polygons, height, width).repartition(*keys, "x")
    order = Window.partitionBy(*keys, "x", "__part").orderBy("y")
    runs = dealt.withColumns({"__n": F.row_number().over(order), "y1": F.lead("y").over(order)}).filter("__n % 2 = 1 AND y1 > y")
    before = F.max("y1").over(Window.partitionBy(*keys, "x").orderBy("y", "y1", "__part").rowsBetween(Window.unboundedPreceding, -1))
    return runs.select(*keys, "x", F.greatest("y", F.coalesce(before, F.lit(0))).alias("y0"), "y1").filter("y1 > y0")


def run_pixels(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The pixels (keys, y, x) of runs."""
    return runs.select(*keys, F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x")


def run_extents(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Number of pixels and box (end exclusive) of each instance that has any."""
    return runs.groupBy(*keys).agg(F.sum(F.col("y1") - F.col("y0")).alias("area"), F.min("x").alias("x0"), F.min("y0").alias("y0"), (F.max("x") + 1).alias("x1"), F.max("y1").alias("y1"))


def within_box(instances: DataFrame, keys: list[str], polygons: str, box: Box, size: int) -> DataFrame:
    """Runs of the polygons in a square of ``size`` pixels that stands for the box; sides under 0.1 count as 0.1."""
    across, down = (size / F.greatest(side, F.lit(0.1)) for side in (box.width, box.height))
    moved = lambda p: F.transform(p, lambda v, i: F.when(i % 2 == 0, (v - box.x0) * across).otherwise((v - box.y0) * down))
    return polygon_runs(instances.withColumn(polygons, F.transform(polygons, moved)), keys, polygons, size, size)


def paste(masks: DataFrame, keys: list[str], mask: str, side: int, box: Box, height: int, width: int, threshold: float = 0.5) -> DataFrame:
    """The pixels (keys, y, x) of an image where a mask, stretched over its box by bilinear samples, is ``threshold`` or more.

    ``mask`` holds side * side numbers row by row; what lies outside of it counts as 0. Each mask makes its own pixels in one narrow pass, and only those within half a
    mask cell of its box are asked, as all others are 0. Masks of another length, null ones, and boxes without area have no pixels.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0, as all pixels outside the box are 0")
    half = lambda low, high: (high - low) / (2 * side)
    asked = lambda low, high, most: (F.greatest(F.lit(0), F.floor(low - half(low, high)) - 1).cast("int"), F.least(F.lit(most - 1), F.ceil(high + half(low, high))).cast("int"))
    (x0, x1), (y0, y1) = asked(box.x0, box.x1, width), asked(box.y0, box.y1, height)
    held = masks.filter((F.size(mask) == side * side) & (box.width > 0) & (box.height > 0) & (x0 <= x1) & (y0 <= y1))
    at = lambda c, low, length: (F.col(c) + 0.5 - low) / length * side - 0.5
    rows = held.withColumn("y", F.explode(F.sequence(y0, y1))).withColumn("__v", at("y", box.y0, box.height))
    cells = rows.withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("__u", at("x", box.x0, box.width))
    u, v = F.col("__u"), F.col("__v")

    def corner(right: int, below: int) -> Column:
        i, j = (F.floor(v) + below).cast("int"), (F.floor(u) + right).cast("int")
        inside = i.between(0, side - 1) & j.between(0, side - 1)
        return F.when(inside, F.get(mask, i * side + j) * (1 - F.abs(v - i)) * (1 - F.abs(u - j))).otherwise(0.0)

    value = corner(0, 0) + corner(1, 0) + corner(0, 1) + corner(1, 1)
    return cells.filter(value >= threshold).select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
