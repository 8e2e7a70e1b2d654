"""Masks and images as tables of pixels (image_id, y, x, value).

Pixels made by ``explode`` look as small as the table of images to the planner, which would send them to every executor; joins with them therefore ask for a merge.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, images: int, height: int, width: int, value: Column) -> DataFrame:
    """A table of images with ``value`` computed from image_id, y and x."""
    rows = spark.range(images).withColumnRenamed("id", "image_id")
    cells = rows.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return cells.withColumn("value", value)


def properties(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """width, height and inclusive box of what is above one half; zeros for an empty mask."""
    box = pixels.filter("value > 0.5").groupBy("image_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    made = images.join(box.hint("merge"), "image_id", "left")
    there = F.col("x0").isNotNull()
    return made.withColumns({"width": F.when(there, F.col("x1") - F.col("x0") + 1).otherwise(0), "height": F.when(there, F.col("y1") - F.col("y0") + 1).otherwise(0)}).fillna(0, ["x0", "y0", "x1", "y1"])


def filled_box(pixels: DataFrame) -> DataFrame:
    """1 within the box of each image's mask, 0 outside."""
    w = Window.partitionBy("image_id")
    hit = lambda f, c: f(F.when(F.col("value") > 0.5, F.col(c))).over(w)
    inside = F.col("x").between(hit(F.min, "x"), hit(F.max, "x")) & F.col("y").between(hit(F.min, "y"), hit(F.max, "y"))
    return pixels.withColumn("value", F.when(F.coalesce(inside, F.lit(False)), 1.0).otherwise(0.0))


def morphology(pixels: DataFrame, across: int, down: int) -> DataFrame:
    """Dilate (positive) or erode (negative) a mask by a line of so many pixels, along rows, then along columns.

    A line of even length reaches one pixel further ahead when it dilates, and one further back when it
    erodes. What lies outside the image is 0, so erosion takes the border too.
    """

    def along(df: DataFrame, size: int, line: str, at: str) -> DataFrame:
        n = abs(size)
        if n == 0:
            return df
        back, ahead = ((n - 1) // 2, n // 2) if size > 0 else (n // 2, (n - 1) // 2)
        w = Window.partitionBy("image_id", line).orderBy(at).rangeBetween(-back, ahead)
        on = F.when(F.col("value") != 0, 1.0).otherwise(0.0)
        return df.withColumn("value", F.max(on).over(w) if size > 0 else F.when(F.count("*").over(w) == n, F.min(on).over(w)).otherwise(0.0))

    return along(along(pixels, across, "y", "x"), down, "x", "y")


def gaussian(pixels: DataFrame, sigma: float, reach: float = 4.0) -> DataFrame:
    """Blur by a Gaussian cut at ``reach`` sigmas, along columns, then rows; the image is mirrored at its borders."""
    radius = int(reach * sigma + 0.5)
    weights = [exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]

    def along(df: DataFrame, at: str, line: str) -> DataFrame:
        size = F.max(at).over(Window.partitionBy("image_id")) + 1
        # Each pixel gives its share to those whose mirrored window reads it. Mirrors repeat after two sizes, so a step has one target among the pixels that stand
        # upright and one among the mirrored ones, if it lies in the image.
        upright = lambda k: F.pmod(F.col(at) - k, 2 * F.col("__n"))
        mirrored = lambda k: F.pmod(-1 - F.col(at) - k, 2 * F.col("__n"))
        targets = F.array(*[F.struct(spot(F.lit(k)).alias("t"), F.lit(w / sum(weights)).alias("w")) for k, w in zip(range(-radius, radius + 1), weights) for spot in (upright, mirrored)])
        spread_out = df.withColumn("__n", size).withColumn("__s", F.explode(targets)).filter("__s.t < __n")
        return spread_out.groupBy("image_id", line, F.col("__s.t").cast("int").alias(at)).agg(F.sum(F.col("value") * F.col("__s.w")).alias("value")).select("image_id", "y", "x", "value")

    return along(along(pixels, "y", "x"), "x", "y")


def blend(image: DataFrame, overlay: DataFrame, alpha: Column) -> DataFrame:
    """image * (1 - alpha) + overlay * alpha at each pixel; both tables have the key columns and ``value``."""
    keys = [c for c in image.columns if c != "value"]
    other = overlay.withColumnRenamed("value", "__o")
    return image.join(other.hint("merge"), keys).withColumn("value", F.col("value") * (1 - alpha) + F.col("__o") * alpha).drop("__o")


def compare(image: DataFrame, other: DataFrame, mode: str, mix: float = 0.5, split: int = 0) -> DataFrame:
    """``difference``, ``overlay``, ``split`` (left of a column the first image), ``side`` or ``top`` (set beside or below)."""
    keys = [c for c in image.columns if c != "value"]
    if mode in ("side", "top"):
        axis = "x" if mode == "side" else "y"
        size = image.groupBy("image_id").agg((F.max(axis) + 1).alias("__s"))
        return image.unionByName(other.join(size.hint("merge"), "image_id").withColumn(axis, F.col(axis) + F.col("__s")).drop("__s"))
    both = image.join(other.withColumnRenamed("value", "__o").hint("merge"), keys)
    made = {"difference": F.abs(F.col("value") - F.col("__o")), "overlay": F.col("value") * (1 - mix) + F.col("__o") * mix, "split": F.when(F.col("x") < split, F.col("value")).otherwise(F.col("__o"))}[mode]
    return both.withColumn("value", made).drop("__o")


def stack(layers: DataFrame, width: int, height: int) -> DataFrame:
    """Layers with (layer, dx, dy) on a canvas: the last layer wins, what lies outside is cut."""
    moved = layers.withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")}).filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    return moved.groupBy("image_id", "y", "x").agg(F.max_by("value", "layer").alias("value"))


def resize_nearest(pixels: DataFrame, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """(height, width) by the nearest source pixel; each source pixel gives the target pixels that read it."""
    def targets(c: str, a: int, b: int) -> Column:
        first = F.ceil(F.col(c) * b / a).cast("int")
        end = F.ceil((F.col(c) + 1) * b / a).cast("int") - 1
        return F.when(end >= first, F.sequence(first, end)).otherwise(F.array().cast("array<int>"))

    made = pixels.withColumn("__y", F.explode(targets("y", old[0], new[0]))).withColumn("__x", F.explode(targets("x", old[1], new[1])))
    return made.select("image_id", F.col("__y").alias("y"), F.col("__x").alias("x"), "value")


def run_lengths(pixels: DataFrame, height: int) -> DataFrame:
    """Column-major run lengths of each mask, with a leading 0 if the first pixel is set."""
    flat = pixels.withColumn("p", F.col("x") * height + F.col("y")).withColumn("on", (F.col("value") > 0.5).cast("int"))
    w = Window.partitionBy("image_id").orderBy("p")
    runs = flat.withColumn("new", (F.col("on") != F.lag("on", 1, 0).over(w)).cast("int")).withColumn("run", F.sum("new").over(w))
    counts = runs.groupBy("image_id", "run").agg(F.count("*").alias("n"), F.min("on").alias("on"))
    per = counts.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("run", "n"))).alias("r"))
    lengths = F.transform("r", lambda s: s["n"])
    return per.select("image_id", F.when(F.get("r", F.lit(0))["run"] > 0, F.concat(F.array(F.lit(0).cast("long")), lengths)).otherwise(lengths).alias("counts"))


def decode_runs(runs: DataFrame, height: int) -> DataFrame:
    """Set pixels (image_id, y, x) of run lengths."""
    ends = F.transform("counts", lambda c, i: F.aggregate(F.slice("counts", 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b))
    spans = F.filter(F.transform(ends, lambda e, i: F.struct((e - F.get("counts", i)).alias("a"), e.alias("b"), (i % 2).alias("on"))), lambda s: (s["on"] == 1) & (s["b"] > s["a"]))
    return runs.select("image_id", F.explode(F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["b"] - 1)))).alias("p")).select("image_id", (F.col("p") % height).alias("y"), F.floor(F.col("p") / height).alias("x"))


def edges(labels: DataFrame, ignore: int = 255, width: int = 3) -> DataFrame:
    """1 near a border of labels: where a label differs from that above, to the right, or diagonally below on
    either side, widened to ``width`` pixels. ``ignore`` never differs."""
    v = F.col("value")
    line, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    near = labels.withColumns({"__r": F.lead("value").over(line), "__u": F.lag("value").over(column)})
    falling, rising = (Window.partitionBy("image_id", d).orderBy("y") for d in (F.col("x") - F.col("y"), F.col("x") + F.col("y")))
    near = near.withColumns({"__f": F.lead("value").over(falling), "__g": F.lead("value").over(rising)})
    differs = lambda o: F.coalesce((F.col(o) != v) & (F.col(o) != ignore) & (v != ignore), F.lit(False))
    marked = near.withColumn("__e", (differs("__r") | differs("__u") | differs("__f") | differs("__g")).cast("int"))
    half = width // 2
    across = F.max("__e").over(line.rangeBetween(-half, half))
    return marked.withColumn("__a", across).withColumn("edge", F.max("__a").over(column.rangeBetween(-half, half))).drop("__r", "__u", "__f", "__g", "__e", "__a")


def part_mask(labels: DataFrame, parts: list[int], without: list[int] = ()) -> DataFrame:
    keep = F.col("value").isin(*parts)
    return labels.withColumn("value", F.when(keep & ~F.col("value").isin(*without) if without else keep, 1.0).otherwise(0.0))


def arg_max_label(scores: DataFrame) -> DataFrame:
    """The label with the greatest score at each pixel, ties to the smaller one."""
    return scores.groupBy("image_id", "y", "x").agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("value"))


def instance_ids(labels: DataFrame) -> DataFrame:
    """An id for each (person, part) of an image, in order."""
    return labels.withColumn("instance", F.dense_rank().over(Window.partitionBy("image_id").orderBy("person", "part")))
