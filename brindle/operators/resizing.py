"""Resizing of images as tables of pixels (image_id, y, x, value), by the nearest source pixel or a filter of ``resampling``.

With the nearest one, a target pixel t of ``new`` reads the source pixel floor(t * old / new), so a source pixel gives the targets
from ceil(s * old⁻¹ * new) on. Sizes are (height, width); Python's rounding to even is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.masks import properties, resize_nearest
from brindle.operators.resampling import lanczos4_along, resample


def on_canvas(pixels: DataFrame, size: tuple[int, int], top: int, left: int, fill: float) -> DataFrame:
    """Pixels moved by (top, left) on a canvas of ``size``: what lies outside is cut, what is free is ``fill``."""
    moved = pixels.select("image_id", (F.col("y") + top).cast("long").alias("y"), (F.col("x") + left).cast("long").alias("x"), "value").filter(F.col("y").between(0, size[0] - 1) & F.col("x").between(0, size[1] - 1))
    blank = pixels.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size[0] - 1).cast("long"))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size[1] - 1).cast("long"))).alias("x"))
    return blank.join(moved.hint("merge"), ["image_id", "y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def _scaled(old: tuple[int, int], scale: float) -> tuple[int, int]:
    return max(1, round(old[0] * scale)), max(1, round(old[1] * scale))


def _to(pixels: DataFrame, old: tuple[int, int], new: tuple[int, int], method: str) -> DataFrame:
    return resize_nearest(pixels, old, new) if method == "nearest" else resample(pixels, old, new, method)


def resize(pixels: DataFrame, old: tuple[int, int], new: tuple[int, int], mode: str = "stretch", fill: float = 0.0, method: str = "nearest") -> DataFrame:
    """``stretch``; ``pad`` (fit inside, centred); ``cover`` (fill, cut the rest evenly); ``crop`` (cut the source
    to the target's aspect, then stretch); ``lock_ratio`` (fit inside, no canvas; a side of 0 follows the other). ``method`` is a filter of ``resampling``."""
    wide, high = new[1] / max(old[1], 1), new[0] / max(old[0], 1)
    if mode == "stretch":
        return _to(pixels, old, new, method)
    if mode == "lock_ratio":
        if new[0] <= 0 and new[1] <= 0:
            return pixels
        if new[0] <= 0 or new[1] <= 0:
            scale = max(wide, high)
            return _to(pixels, old, (new[0], max(1, round(old[1] * scale))) if new[1] <= 0 else (max(1, round(old[0] * scale)), new[1]), method)
        return _to(pixels, old, _scaled(old, min(wide, high)), method)
    if mode == "crop":
        have, want = old[1] / old[0], new[1] / new[0]
        x = round((old[1] - old[1] * (want / have)) / 2) if have > want else 0
        y = round((old[0] - old[0] * (have / want)) / 2) if have < want else 0
        part = pixels.filter(F.col("x").between(x, old[1] - x - 1) & F.col("y").between(y, old[0] - y - 1)).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})
        return _to(part, (old[0] - 2 * y, old[1] - 2 * x), new, method)
    size = _scaled(old, max(wide, high) if mode == "cover" else min(wide, high))
    made = _to(pixels, old, size, method)
    if mode == "cover":
        top, left = max(0, (size[0] - new[0]) // 2), max(0, (size[1] - new[1]) // 2)
        cut = made.withColumns({"y": F.col("y") - top, "x": F.col("x") - left})
        return cut.filter(F.col("y").between(0, new[0] - 1) & F.col("x").between(0, new[1] - 1))
    return on_canvas(made, new, max(0, (new[0] - size[0]) // 2), max(0, (new[1] - size[1]) // 2), fill)


def merge_batches(batches: list[tuple[DataFrame, tuple[int, int]]], mode: str = "stretch", method: str = "bilinear") -> DataFrame:
    """(batch, image_id, y, x, value): image batches in order, each brought to the size of the first one (``stretch``, ``crop`` or ``pad`` with 0)."""
    size, merged = batches[0][1], None
    for number, (pixels, own) in enumerate(batches):
        made = pixels.select("image_id", "y", "x", "value") if own == size else resize(pixels, own, size, {"crop": "cover"}.get(mode, mode), method=method)
        made = made.select(F.lit(number).alias("batch"), "image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("value").cast("double").alias("value"))
        merged = made if merged is None else merged.unionByName(made)
    return merged


def _targets(place: Column, old: Column, new: Column) -> Column:
    """The target places that read a source place."""
    first, end = F.ceil(place * new / old), F.ceil((place + 1) * new / old) - 1
    return F.when(end >= first, F.sequence(first, end)).otherwise(F.array().cast("array<bigint>"))


def match_aspect(target: DataFrame, mask: DataFrame, mode: str, size: tuple[int, int]) -> DataFrame:
    """``mask`` with the content of its box brought to the aspect of the box of ``target`` around the same centre.

    ``stretch`` makes the box larger, ``crop`` cuts it, and ``pad`` leaves the content as it is. An empty target
    counts as square, an empty mask stays empty.
    """
    a = properties(target, target.select("image_id").distinct()).select("image_id", F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(1.0).alias("__ra"))
    b = properties(mask, mask.select("image_id").distinct()).filter("height > 0").withColumn("__rb", F.col("width") / F.col("height"))
    w, h, wider = F.col("width"), F.col("height"), F.col("__ra") > F.col("__rb")
    across, down = (h * F.col("__ra")).cast("int"), (w / F.col("__ra")).cast("int")
    nw = {"stretch": F.when(wider, across).otherwise(w), "crop": F.when(wider, w).otherwise(across), "pad": w}[mode]
    nh = {"stretch": F.when(wider, h).otherwise(down), "crop": F.when(wider, down).otherwise(h), "pad": h}[mode]
    plan = a.join(b.hint("merge"), "image_id").withColumns({"__nw": nw, "__nh": nh, "__cx": F.floor((F.col("x0") + F.col("x1")) / 2), "__cy": F.floor((F.col("y0") + F.col("y1")) / 2)})
    inside = mask.join(plan.hint("merge"), "image_id").filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    at = lambda c, n, old: _targets(F.col(c) - F.col(f"{c}0"), F.col(old), F.col(n)) if mode == "stretch" else F.array((F.col(c) - F.col(f"{c}0") - F.floor((F.col(old) - F.col(n)) / 2)).cast("long"))
    moved = inside.withColumn("__y", F.explode(at("y", "__nh", "height"))).withColumn("__x", F.explode(at("x", "__nw", "width")))
    moved = moved.filter(F.col("__y").between(0, F.col("__nh") - 1) & F.col("__x").between(0, F.col("__nw") - 1))
    placed = moved.select("image_id", (F.col("__y") + F.col("__cy") - F.floor(F.col("__nh") / 2)).alias("y"), (F.col("__x") + F.col("__cx") - F.floor(F.col("__nw") / 2)).alias("x"), F.col("value").alias("__v"))
    return mask.drop("value").join(placed.hint("merge"), ["image_id", "y", "x"], "left").withColumn("value", F.coalesce("__v", F.lit(0.0))).drop("__v")


def resize_by_mask(pixels: DataFrame, mask: DataFrame, old: tuple[int, int], new: tuple[int, int], mode: str = "pad", fill: float = 0.0, method: str = "nearest") -> DataFrame:
    """Images scaled so that the box of their mask fits (``pad``) or fills (``crop``) the target, with its centre in the middle.

    An image without a mask of its own takes that of image 0; an empty mask stretches the image. A crop that the
    scaled image cannot fill is padded with 0. ``method`` is nearest (masks) or lanczos4 (images).
    """
    boxes = properties(mask, mask.select("image_id").distinct())
    first = boxes.filter("image_id = 0").select(F.struct(*[c for c in boxes.columns if c != "image_id"]).alias("__d"))  # one row
    plan = pixels.select("image_id").distinct().join(boxes.select("image_id", F.struct(*[c for c in boxes.columns if c != "image_id"]).alias("__m")).hint("merge"), "image_id", "left").join(F.broadcast(first), F.lit(True), "left")
    plan = plan.select("image_id", F.coalesce("__m", "__d").alias("b")).select("image_id", "b.*")
    (th, tw), (sh, sw) = new, old
    ratios = F.try_divide(F.lit(tw), F.col("width")), F.try_divide(F.lit(th), F.col("height"))
    scale = (F.least if mode == "pad" else F.greatest)(*ratios)
    empty = F.coalesce(F.col("height") == 0, F.lit(True))
    plan = plan.withColumn("__s", scale).withColumns({"__w": F.when(empty, tw).otherwise(F.greatest(F.lit(1), F.rint(sw * F.col("__s")))).cast("long"), "__h": F.when(empty, th).otherwise(F.greatest(F.lit(1), F.rint(sh * F.col("__s")))).cast("long"), "__e": empty})
    centre = {c: F.rint((F.col(f"{c}0") + F.col(f"{c}1")) / 2.0 * F.col("__s")).cast("long") for c in "xy"}
    start = {"x": F.greatest(F.lit(0), F.least(centre["x"] - tw // 2, F.col("__w") - tw)), "y": F.greatest(F.lit(0), F.least(centre["y"] - th // 2, F.col("__h") - th))}
    paste = {"x": F.greatest(F.least(tw // 2 - centre["x"], F.lit(tw - 1)), 1 - F.col("__w")), "y": F.greatest(F.least(th // 2 - centre["y"], F.lit(th - 1)), 1 - F.col("__h"))}
    fits = (start["x"] + tw <= F.col("__w")) & (start["y"] + th <= F.col("__h"))
    cut = (F.lit(mode == "crop")) & fits
    moves = {c: F.when(F.col("__e"), 0).when(cut, -start[c]).otherwise(paste[c]).cast("long") for c in "xy"}
    plan = plan.select("image_id", "__w", "__h", moves["x"].alias("__dx"), moves["y"].alias("__dy"))
    if method == "lanczos4":
        held = pixels.join(plan.select("image_id", F.struct("__w", "__h", "__dx", "__dy").alias("plan")).hint("merge"), "image_id")
        across = lanczos4_along(held, "x", sw, F.col("plan.__w"), lambda x: (x + F.col("plan.__dx")).between(0, tw - 1), plan.select(F.col("__w").alias("size")))
        scaled = lanczos4_along(across, "y", sh, F.col("plan.__h"), lambda y: (y + F.col("plan.__dy")).between(0, th - 1), plan.select(F.col("__h").alias("size")))
        return on_canvas(scaled.select("image_id", (F.col("y") + F.col("plan.__dy")).alias("y"), (F.col("x") + F.col("plan.__dx")).alias("x"), "value"), new, 0, 0, fill if mode == "pad" else 0.0)
    rows = pixels.join(plan.hint("merge"), "image_id").withColumn("__y", F.explode(_targets(F.col("y"), F.lit(sh), F.col("__h")))).filter((F.col("__y") + F.col("__dy")).between(0, th - 1))
    made = rows.withColumn("__x", F.explode(_targets(F.col("x"), F.lit(sw), F.col("__w"))))
    return on_canvas(made.select("image_id", (F.col("__y") + F.col("__dy")).alias("y"), (F.col("__x") + F.col("__dx")).alias("x"), "value"), new, 0, 0, fill if mode == "pad" else 0.0)


def flip(pixels: DataFrame, size: int, axis: str = "x") -> DataFrame:
    return pixels.withColumn(axis, size - 1 - F.col(axis))


def quarter_turn(pixels: DataFrame, width: int) -> DataFrame:
    """A turn to the left: the last column becomes the first row."""
    return pixels.withColumns({"y": width - 1 - F.col("x"), "x": F.col("y")})


def crop(pixels: DataFrame, top: int, left: int, size: tuple[int, int]) -> DataFrame:
    inside = pixels.filter(F.col("y").between(top, top + size[0] - 1) & F.col("x").between(left, left + size[1] - 1))
    return inside.withColumns({"y": F.col("y") - top, "x": F.col("x") - left})


def adjust(value: Column, kind: str, weight: float, mean: Column | None = None) -> Column:
    """``brightness`` times the weight; ``contrast`` around the image's mean; ``linear`` between value and ``mean``."""
    if kind == "brightness":
        return value * weight
    return mean * (1 - weight) + value * weight


def to_bytes(value: Column) -> Column:
    """0..1 as 0..255, truncated as a cast truncates, after clipping."""
    return (F.greatest(F.lit(0.0), F.least(F.lit(255.0), value * 255.0))).cast("int")


def image_mean(value: str = "value") -> Column:
    return F.avg(value).over(Window.partitionBy("image_id"))
