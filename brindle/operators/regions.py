"""Connected regions of masks; an image is the unit of work, and its runs of pixels are what is joined."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def _joined_runs(y: np.ndarray, first: np.ndarray, last: np.ndarray, reach: int) -> np.ndarray:
    """A root for each run (sorted by row and start); runs of neighbouring rows touch within ``reach`` columns."""
    root = np.arange(len(y))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    rows = {r: (a, b) for r, a, b in zip(*np.unique(y, return_index=True), np.append(np.unique(y, return_index=True)[1][1:], len(y)))}
    for r, (a, b) in rows.items():
        c, d = rows.get(r - 1, (0, 0))
        while a < b and c < d:
            if first[a] <= last[c] + reach and first[c] <= last[a] + reach:
                p, q = top(a), top(c)
                root[max(p, q)] = min(p, q)
            if last[a] < last[c]:
                a += 1
            else:
                c += 1
    return np.array([top(k) for k in range(len(y))], int)


def regions(pixels: DataFrame, diagonal: bool = True, on: str = "value > 0.5", within: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, y, x, region) of the pixels that are ``on``; a region is named by its first pixel in row order.

    Rows are cut into runs by windows; only the runs of an image, and not its pixels, come together. With ``within``, pixels touch only where these columns agree.
    """
    keys = ["image_id", *within]
    line = Window.partitionBy(*keys, "y").orderBy("x")
    lit = pixels.filter(on).select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    runs = lit.withColumn("__g", F.col("x") - F.row_number().over(line)).groupBy(*keys, "y", "__g").agg(F.min("x").alias("first"), F.max("x").alias("last")).drop("__g")

    def join(image: pd.DataFrame) -> pd.DataFrame:
        image = image.sort_values(["y", "first"]).reset_index(drop=True)
        root = _joined_runs(image["y"].to_numpy(), image["first"].to_numpy(), image["last"].to_numpy(), int(diagonal))
        return image.assign(region_y=image["y"].to_numpy()[root], region_x=image["first"].to_numpy()[root])

    named = runs.groupBy(*keys).applyInPandas(join, StructType([*runs.schema.fields, StructField("region_y", LongType()), StructField("region_x", LongType())]))
    return named.select(*keys, "y", F.explode(F.sequence("first", "last")).alias("x"), F.struct("region_y", "region_x").alias("region"))


def boxes_of(found: DataFrame) -> DataFrame:
    """Area and inclusive box of each region."""
    return found.groupBy("image_id", "region").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def remove_small(pixels: DataFrame, least_area: int) -> DataFrame:
    """0 in the whole box of every region with fewer pixels; boxes may cut into larger regions."""
    small = boxes_of(regions(pixels)).filter(F.col("area") < least_area)
    gone = small.select("image_id", F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1").select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x")).distinct()
    joined = pixels.join(gone.withColumn("__gone", F.lit(True)).hint("merge"), ["image_id", "y", "x"], "left")
    return joined.withColumn("value", F.when(F.col("__gone"), 0.0).when(F.col("value") > 0.5, 1.0).otherwise(0.0)).drop("__gone")


def largest(pixels: DataFrame) -> DataFrame:
    """1 on the region with the most pixels of each image (the first in row order of equal ones), 0 elsewhere."""
    found = regions(pixels)
    best = boxes_of(found).groupBy("image_id").agg(F.min_by("region", F.struct(-F.col("area"), F.col("region"))).alias("region"))
    kept = found.join(best.hint("merge"), ["image_id", "region"]).select("image_id", "y", "x", F.lit(1.0).alias("__v"))
    return pixels.join(kept.hint("merge"), ["image_id", "y", "x"], "left").withColumn("value", F.coalesce("__v", F.lit(0.0))).drop("__v")


def fill_holes(pixels: DataFrame) -> DataFrame:
    """1 on the mask and on what it encloses: dark regions (without diagonal steps) that do not reach the border."""
    dark = regions(pixels, diagonal=False, on="value <= 0.5")
    edge = pixels.groupBy("image_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    outside = boxes_of(dark).join(edge.hint("merge"), "image_id").filter((F.col("x0") == 0) | (F.col("y0") == 0) | (F.col("x1") == F.col("w")) | (F.col("y1") == F.col("h")))
    left = dark.join(outside.select("image_id", "region").hint("merge"), ["image_id", "region"]).select("image_id", "y", "x", F.lit(0.0).alias("__v"))
    return pixels.join(left.hint("merge"), ["image_id", "y", "x"], "left").withColumn("value", F.coalesce("__v", F.lit(1.0))).drop("__v")


def grow(pixels: DataFrame, classes: DataFrame) -> DataFrame:
    """``pixels`` (image_id, y, x, instance, person, part) with instances grown over free pixels of their class.

    ``classes`` gives the part of each (image_id, instance). A free pixel (instance 0) takes the instance and person of the first labelled pixel in row order that reaches
    it by steps, diagonal ones too, over free pixels of that class. All free pixels of one region are reached by the same labelled ones, so regions are
    found first and each asks only the pixels around it: nothing goes from pixel to pixel in rounds. Instances without a class do not grow; free
    pixels that none reaches stay as they are, and so do nulls.
    """
    free = regions(pixels, diagonal=True, on="instance = 0 AND part IS NOT NULL", within=("part",)).withColumnRenamed("part", "__c")
    sources = pixels.filter("instance <> 0").select("image_id", "instance", "person", F.col("y").cast("long").alias("sy"), F.col("x").cast("long").alias("sx"))
    sources = sources.join(classes.select("image_id", "instance", F.col("part").alias("__c")).dropDuplicates(["image_id", "instance"]).hint("merge"), ["image_id", "instance"])
    steps = F.array(*[F.struct((F.col("sy") + dy).alias("y"), (F.col("sx") + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    around = sources.withColumn("__s", F.explode(steps)).select("image_id", "__c", "instance", "person", "sy", "sx", "__s.y", "__s.x")
    claims = around.join(free.hint("merge"), ["image_id", "__c", "y", "x"]).groupBy("image_id", "__c", "region").agg(F.min(F.struct("sy", "sx", "instance", "person")).alias("by"))
    grown = free.join(claims.hint("merge"), ["image_id", "__c", "region"]).select("image_id", "y", "x", F.col("by.instance").alias("__i"), F.col("by.person").alias("__h"), F.lit(True).alias("__grown"))
    made = pixels.join(grown.hint("merge"), ["image_id", "y", "x"], "left")
    taken = lambda new, old: F.when(F.col("__grown"), F.col(new)).otherwise(F.col(old))
    return made.withColumns({"instance": taken("__i", "instance"), "person": taken("__h", "person")}).drop("__i", "__h", "__grown")
