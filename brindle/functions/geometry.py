"""Boxes as column arithmetic, in double precision. A box is four columns x0, y0, x1, y1 unless said otherwise."""

from __future__ import annotations

from dataclasses import dataclass
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE_CLAMP = log(1000 / 16)


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @classmethod
    def from_xywh(cls, x: Column, y: Column, w: Column, h: Column) -> Box:
        return cls(x, y, x + w, y + h)

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height

    def center(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    def clip(self, width: float, height: float) -> Box:
        cut = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top)))
        return Box(cut(self.x0, width), cut(self.y0, height), cut(self.x1, width), cut(self.y1, height))

    def scale(self, sx: float, sy: float) -> Box:
        return Box(self.x0 * sx, self.y0 * sy, self.x1 * sx, self.y1 * sy)

    def nonempty(self, threshold: float = 0.0) -> Column:
        return (self.width > threshold) & (self.height > threshold)

    def inside(self, width: float, height: float, border: float = 0.0) -> Column:
        return (self.x0 >= -border) & (self.y0 >= -border) & (self.x1 < width + border) & (self.y1 < height + border)

    def expand(self, factor: float, width: Column, height: Column) -> Box:
        """Grown about its centre, rounded half to even, within the image."""
        cx, cy = self.center()
        w, h = self.width * factor / 2, self.height * factor / 2
        low = lambda v: F.greatest(F.rint(v), F.lit(0.0))
        return Box(low(cx - w), low(cy - h), F.least(F.rint(cx + w), width), F.least(F.rint(cy + h), height))

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}") for n, c in zip(("x0", "y0", "x1", "y1"), (self.x0, self.y0, self.x1, self.y1))]


def intersection(a: Box, b: Box, plus: float = 0.0) -> Column:
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0) + plus
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0) + plus
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box, plus: float = 0.0) -> Column:
    """Overlap by union; ``plus`` = 1 measures inclusive pixels. Boxes that do not meet have 0."""
    over = intersection(a, b, plus)
    union = (a.width + plus) * (a.height + plus) + (b.width + plus) * (b.height + plus) - over
    return F.when(over > 0, over / union).otherwise(0.0)


def pairwise_iou(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of the two tables (with x0..y1 and an id each, ``a_`` and ``b_``) that share ``key``, with their overlap."""
    return left.join(right, key).withColumn("iou", iou(Box.of("a_"), Box.of("b_")))


def overlapping(left: DataFrame, right: DataFrame, key: str, cell: float = 64.0) -> DataFrame:
    """As ``pairwise_iou`` for pairs that overlap, joined on grid cells, so a large group is not paired as a whole.

    Both boxes lie in the cell of the corner of their intersection, which therefore gives each pair once.
    """

    def cells(df: DataFrame, p: str) -> DataFrame:
        spread = lambda lo, hi: F.sequence(F.floor(F.col(f"{p}{lo}") / cell), F.floor(F.greatest(F.col(f"{p}{lo}"), F.col(f"{p}{hi}")) / cell))
        return df.withColumn("cx", F.explode(spread("x0", "x1"))).withColumn("cy", F.explode(spread("y0", "y1")))

    pairs = cells(left, "a_").join(cells(right, "b_"), [key, "cx", "cy"])
    first = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("cy"))
    return pairs.filter(first).drop("cx", "cy").withColumn("iou", iou(Box.of("a_"), Box.of("b_"))).filter("iou > 0")


def rotated_bounds(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Box:
    """The upright box around a rotated one (degrees)."""
    t = angle * pi / 180
    c, s = F.abs(F.cos(t)), F.abs(F.sin(t))
    nw, nh = c * w + s * h, c * h + s * w
    return Box(cx - nw / 2, cy - nh / 2, cx + nw / 2, cy + nh / 2)


def to_rotated(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [(x + w / 2).alias("cx"), (y + h / 2).alias("cy"), w.alias("w"), h.alias("h"), F.lit(0.0).alias("angle")]


def wrap_angle(angle: Column) -> Column:
    """Within [-180, 180)."""
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def encode_deltas(source: Box, target: Box, weights=(1.0, 1.0, 1.0, 1.0)) -> list[Column]:
    (sx, sy), (tx, ty) = source.center(), target.center()
    made = ((tx - sx) / source.width, (ty - sy) / source.height, F.log(target.width / source.width), F.log(target.height / source.height))
    return [(w * d).alias(n) for n, w, d in zip(("dx", "dy", "dw", "dh"), weights, made)]


def decode_deltas(source: Box, deltas: list[Column], weights=(1.0, 1.0, 1.0, 1.0)) -> Box:
    dx, dy, dw, dh = (d / w for d, w in zip(deltas, weights))
    cx, cy = source.center()
    limit = lambda v: F.least(v, F.lit(SCALE_CLAMP))
    px, py = dx * source.width + cx, dy * source.height + cy
    pw, ph = F.exp(limit(dw)) * source.width, F.exp(limit(dh)) * source.height
    return Box(px - pw / 2, py - ph / 2, px + pw / 2, py + ph / 2)


def anchors(spark, sizes: list[float], ratios: list[float], stride: int, rows: int, columns: int, offset: float = 0.0) -> DataFrame:
    """Cell boxes moved over the grid, in the order row, column, size, ratio (height by width)."""
    cells = [(i * len(ratios) + j, float((s * s / r) ** 0.5), float((s * s / r) ** 0.5 * r)) for i, s in enumerate(sizes) for j, r in enumerate(ratios)]
    shapes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w"), F.lit(h).alias("h")) for k, w, h in cells])
    grid = spark.range(rows).withColumnRenamed("id", "row").select("row", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column")).select("row", "column", F.explode(shapes).alias("s"))
    x, y, w, h = (F.col("column") + offset) * stride, (F.col("row") + offset) * stride, F.col("s.w"), F.col("s.h")
    return grid.select("row", "column", F.col("s.k").alias("cell"), *Box(x - w / 2, y - h / 2, x + w / 2, y + h / 2).columns())


def pyramid_level(area: Column, low: int, high: int, canonical: float = 224.0, level: int = 4) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(level + F.log2(F.sqrt(area) / canonical + 1e-8)))).cast("long")


def bisect_right(value: Column, edges: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value)).cast("long")


def padded_shape(heights: Column, widths: Column, divisor: int = 0) -> list[Column]:
    """Aggregates: the largest shape, rounded up to a multiple of the divisor."""
    up = lambda v: (F.ceil(v / divisor) * divisor) if divisor > 1 else v
    return [up(F.max(heights)).cast("long").alias("height"), up(F.max(widths)).cast("long").alias("width")]


def normalized(x: Column, y: Column, box: Box) -> list[Column]:
    """Coordinates of a point in [-1, 1] within the box."""
    return [(2 * (x - box.x0) / box.width - 1).alias("nx"), (2 * (y - box.y0) / box.height - 1).alias("ny")]


def polygon_area(points: Column) -> Column:
    """Area within x, y, x, y, ... by the shoelace rule."""
    n = F.size(points) / 2
    at = lambda k: F.get(points, k.cast("int"))
    term = lambda i: at(2 * i) * at(2 * F.pmod(i + 1, n) + 1) - at(2 * F.pmod(i + 1, n)) * at(2 * i + 1)
    return F.abs(F.aggregate(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), term), F.lit(0.0), lambda a, b: a + b)) / 2


def polygons_area(polygons: Column) -> Column:
    """The sum of the areas of array<array<double>>; null stays null."""
    return F.aggregate(F.transform(polygons, polygon_area), F.lit(0.0), lambda a, b: a + b)


def polygons_bounds(polygons: Column) -> list[Column]:
    """x0, y0, x1 and y1 of the vertices of array<array<double>>; the upper ends are 0 at least."""
    every = lambda odd: F.flatten(F.transform(polygons, lambda p: F.filter(p, lambda _, i: i % 2 == odd)))
    low, high = (lambda odd: F.array_min(every(odd))), (lambda odd: F.greatest(F.lit(0.0), F.array_max(every(odd))))
    return [low(0).alias("x0"), low(1).alias("y0"), high(0).alias("x1"), high(1).alias("y1")]


def flip_keypoints(points: Column, width: float, pairs: list[tuple[int, int]], odd: bool = True) -> Column:
    """Mirrored x of array<struct<x,y,v>>, left and right swapped on an odd number of flips; unseen points are zero."""
    order = {a: b for p in pairs for a, b in (p, p[::-1])}
    moved = F.transform(points, lambda p: F.when(p["v"] == 0, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), p["v"].alias("v"))).otherwise(F.struct((width - p["x"]).alias("x"), p["y"].alias("y"), p["v"].alias("v"))))
    if not odd:
        return points
    swap = F.create_map(*[F.lit(k) for kv in order.items() for k in kv]) if order else None
    return moved if swap is None else F.transform(points, lambda _, i: F.get(moved, F.coalesce(F.try_element_at(swap, i), i)))
