"""Affine transforms of images, points and boxes in continuous coordinates (the middle of pixel k lies at k + 0.5).

A transform is six columns, so every image may have its own. Transforms compose and invert as columns do, and one matrix serves pixels, points and boxes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.geometry import Box


WHOLE = 1 << 16  # pixels of an image that a row may hold


def _lit(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


@dataclass(frozen=True)
class Affine:
    """x' = a x + b y + c, y' = d x + e y + f."""

    a: Column
    b: Column
    c: Column
    d: Column
    e: Column
    f: Column

    @classmethod
    def of(cls, *values: Column | float) -> Affine:
        return cls(*map(_lit, values))

    def at(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.a * x + self.b * y + self.c, self.d * x + self.e * y + self.f

    def then(self, other: Affine) -> Affine:
        """This transform, and the other one on its result."""
        c, f = other.at(self.c, self.f)
        return Affine(other.a * self.a + other.b * self.d, other.a * self.b + other.b * self.e, c, other.d * self.a + other.e * self.d, other.d * self.b + other.e * self.e, f)

    def inverse(self) -> Affine:
        """The way back; a transform that flattens the plane has null columns."""
        size = self.a * self.e - self.b * self.d
        part = lambda v: F.try_divide(v, size)
        return Affine(part(self.e), part(-self.b), part(self.b * self.f - self.e * self.c), part(-self.d), part(self.a), part(self.d * self.c - self.a * self.f))

    def box(self, box: Box) -> Box:
        """The upright box around the four moved corners."""
        corners = [self.at(x, y) for x in (box.x0, box.x1) for y in (box.y0, box.y1)]
        xs, ys = zip(*corners)
        return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def flipped(width: Column | float) -> Affine:
    return Affine.of(-1, 0, width, 0, 1, 0)


def resized(old: tuple[Column | float, Column | float], new: tuple[Column | float, Column | float]) -> Affine:
    """From (height, width) to (height, width)."""
    return Affine.of(_lit(new[1]) / _lit(old[1]), 0, 0, 0, _lit(new[0]) / _lit(old[0]), 0)


def extent(box: Box, height: Column | float, width: Column | float) -> Affine:
    """The box stretched over an image of the size."""
    across, down = _lit(width) / box.width, _lit(height) / box.height
    return Affine.of(across, 0, -box.x0 * across, 0, down, -box.y0 * down)


def rotated(height: Column | float, width: Column | float, degrees: Column, expand: bool = True, center: tuple[Column | float, Column | float] | None = None) -> tuple[Affine, Column, Column]:
    """(transform, height, width) of a turn to the left; ``expand`` takes the size of the whole turned image, rounded half to even, with the middle in the middle.

    Without it the size stays, and the image turns around ``center`` (x, y), which is the middle if not given.
    """
    h, w, angle = _lit(height), _lit(width), F.radians(degrees)
    cos, sin = F.cos(angle), F.sin(angle)
    middle = w / 2, h / 2
    out_w, out_h = (F.rint(h * F.abs(sin) + w * F.abs(cos)), F.rint(h * F.abs(cos) + w * F.abs(sin))) if expand else (w, h)
    (fx, fy), (tx, ty) = (middle, (out_w / 2, out_h / 2)) if expand or center is None else ((_lit(center[0]), _lit(center[1])),) * 2
    return Affine(cos, sin, tx - cos * fx - sin * fy, -sin, cos, ty + sin * fx - cos * fy), out_h.cast("long"), out_w.cast("long")


def warp(pixels: DataFrame, images: DataFrame, old: tuple[int, int], back: Affine, height: Column, width: Column, method: str = "bilinear", border: str = "blend", fill: float = 0.0) -> DataFrame:
    """Images (image_id, y, x, value) of size ``old`` drawn anew: pixel middles go through ``back`` to the place of the source that is read.

    ``images`` has a row for each image, with the columns that ``back``, ``height`` and ``width`` (at least 1) use. ``bilinear`` mixes four source pixels, ``nearest`` takes the
    one that holds the place. What lies outside is ``fill``: it mixes in at the border (``blend``), or the border pixels are repeated where the place itself
    lies inside (``repeat``). Source pixels that are missing count as ``fill``, and so does an image whose transform is null. Sources of up to ``WHOLE`` pixels meet the images as a row each,
    so that samples are never shuffled; if the caller has dealt images and pixels by image, nothing is. In larger ones the samples meet the source by image, row and column, with two exchanges.
    """
    if method not in ("bilinear", "nearest") or border not in ("blend", "repeat"):
        raise ValueError(f"unknown method {method} or border {border}")
    names = dict(zip(("__a", "__b", "__c", "__d", "__e", "__f"), (back.a, back.b, back.c, back.d, back.e, back.f)))
    plan = images.select("image_id", height.cast("long").alias("__h"), width.cast("long").alias("__w"), *[c.alias(k) for k, c in names.items()])
    pixels, whole = pixels.filter(F.col("y").between(0, old[0] - 1) & F.col("x").between(0, old[1] - 1)), old[0] * old[1] <= WHOLE
    if whole:
        plan = plan.join(_sources(pixels, old, fill).hint("merge"), "image_id", "left")
    rows = plan.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__h") - 1)))
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__w") - 1)))
    u, v = Affine(*map(F.col, names)).at(F.col("x") + 0.5, F.col("y") + 0.5)
    placed = cells.select("image_id", "y", "x", u.alias("__u"), v.alias("__v"), *(["__s"] if whole else []))
    inside = F.coalesce((F.col("__u") >= 0) & (F.col("__u") < old[1]) & (F.col("__v") >= 0) & (F.col("__v") < old[0]), F.lit(False))
    if method == "nearest":
        taps = [(F.floor("__v"), F.floor("__u"), F.lit(1.0))]
    else:
        low = {"u": F.floor(F.col("__u") - 0.5), "v": F.floor(F.col("__v") - 0.5)}
        share = {"u": F.col("__u") - 0.5 - low["u"], "v": F.col("__v") - 0.5 - low["v"]}
        weight = lambda c, k: share[c] if k else 1 - share[c]
        place = lambda c, k, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), low[c] + k)) if border == "repeat" else low[c] + k
        taps = [(place("v", j, old[0]), place("u", i, old[1]), weight("v", j) * weight("u", i)) for j in (0, 1) for i in (0, 1)]
    read = inside if border == "repeat" else F.col("__u").isNotNull() & F.col("__v").isNotNull()
    if whole:
        one = lambda sy, sx: F.coalesce(F.when(sy.between(0, old[0] - 1) & sx.between(0, old[1] - 1), F.get("__s", (sy * old[1] + sx).cast("int"))), F.lit(float(fill)))
        mixed = reduce(Column.__add__, [one(sy, sx) * w for sy, sx, w in taps])
        return placed.select("image_id", "y", "x", F.when(read, mixed).otherwise(float(fill)).alias("value"))
    taps = F.when(read, F.array(*[F.struct(sy.alias("sy"), sx.alias("sx"), w.alias("w")) for sy, sx, w in taps]))
    asked = placed.select("image_id", "y", "x", F.explode_outer(taps).alias("t")).select("image_id", "y", "x", F.col("t.sy").cast("long").alias("__sy"), F.col("t.sx").cast("long").alias("__sx"), F.coalesce("t.w", F.lit(1.0)).alias("__t"))
    source = pixels.select("image_id", F.col("y").cast("long").alias("__sy"), F.col("x").cast("long").alias("__sx"), F.col("value").cast("double").alias("__v"))
    return asked.join(source.hint("merge"), ["image_id", "__sy", "__sx"], "left").groupBy("image_id", "y", "x").agg(F.sum(F.coalesce("__v", F.lit(float(fill))) * F.col("__t")).alias("value"))


def _sources(pixels: DataFrame, size: tuple[int, int], fill: float) -> DataFrame:
    """image_id and ``__s``, the values of an image row by row; null where a pixel is missing. Values of a pixel that is there twice add up."""
    place, value = F.col("y") * size[1] + F.col("x"), F.coalesce(F.col("value").cast("double"), F.lit(float(fill)))
    each = pixels.groupBy("image_id", place.cast("int").alias("k")).agg(F.sum(value).alias("v"))
    held = each.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("__p"))
    gap = lambda e, i: F.array_repeat(F.lit(None).cast("double"), e["k"] - F.coalesce(F.get("__p", i - 1)["k"], F.lit(-1)) - 1)
    spread = F.flatten(F.transform("__p", lambda e, i: F.concat(gap(e, i), F.array(e["v"]))))
    return held.select("image_id", F.when(F.size("__p") == size[0] * size[1], F.transform("__p", lambda e: e["v"])).otherwise(spread).alias("__s"))
