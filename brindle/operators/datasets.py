"""Annotation tables: catalog, nested loading and export, filters, histograms and rebalancing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.geometry import polygons_area
from brindle.operators.metrics import running_sums


class Catalog:
    """Names of datasets; a loader runs when its name is read."""

    def __init__(self) -> None:
        self._loaders: dict[str, Callable[[SparkSession], DataFrame]] = {}
        self.metadata: dict[str, dict] = {}

    def register(self, name: str, loader: Callable[[SparkSession], DataFrame], **metadata) -> None:
        if name in self._loaders:
            raise ValueError(f"dataset {name} is registered already")
        self._loaders[name] = loader
        self.metadata[name] = metadata

    def get(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self._loaders:
            raise KeyError(f"dataset {name} is not registered; there are: {', '.join(self.names())}")
        df = self._loaders[name](spark)
        df.createOrReplaceTempView(name)
        return df

    def names(self) -> list[str]:
        return sorted(self._loaders)

    def clear(self) -> None:
        self._loaders.clear()
        self.metadata.clear()


def contiguous(categories: DataFrame, key: str) -> DataFrame:
    """Each category with its rank (from 0) among the sorted distinct ones. Categories are few: one window."""
    return categories.select(key).distinct().withColumn("contiguous_id", F.dense_rank().over(Window.orderBy(key)) - 1)


ANNOTATION_FILE = """
images array<struct<id: bigint, width: bigint, height: bigint, file_name: string>>,
annotations array<struct<id: bigint, image_id: bigint, bbox: array<double>, area: double, iscrowd: bigint, category_id: bigint, segmentation: array<array<double>>, keypoints: array<double>>>,
categories array<struct<id: bigint, name: string>>
"""


def load_annotations(spark: SparkSession, path: str, from_one: bool = False) -> DataFrame:
    """One row for each image with its annotations: polygons with an odd length or under 6 numbers go, and so
    does an annotation whose polygons all do; key points move by half a pixel; categories become contiguous, or
    are numbered from 0 instead of 1 (``from_one``). A file is one document of one task."""
    whole = spark.read.schema(ANNOTATION_FILE).option("multiLine", True).json(path)
    images = whole.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.width", "i.height", "i.file_name")
    ranks = contiguous(whole.select(F.explode("categories.id").alias("category_id")), "category_id")
    notes = _assert_unique(whole.select(F.explode("annotations").alias("a")).select("a.*"), "id")
    good = F.filter("segmentation", lambda p: (F.size(p) % 2 == 0) & (F.size(p) >= 6))
    notes = notes.withColumn("kept", good).filter(F.col("segmentation").isNull() | (F.size("segmentation") == 0) | (F.size("kept") > 0))
    points = F.transform("keypoints", lambda v, i: F.when(i % 3 == 2, v).otherwise(v + 0.5))
    notes = notes.withColumns({"segmentation": F.when(F.size("kept") > 0, F.col("kept")), "keypoints": points}).drop("kept")
    if from_one:
        notes = notes.withColumn("category_id", F.col("category_id") - 1)
    else:
        notes = notes.join(F.broadcast(ranks), "category_id").drop("category_id").withColumnRenamed("contiguous_id", "category_id")
    fields = ["id", "bbox", "iscrowd", "category_id", "segmentation", "keypoints"]
    nested = notes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("annotations"))
    return images.join(nested, "image_id", "left").withColumn("annotations", F.coalesce("annotations", F.expr("array()").cast(nested.schema["annotations"].dataType)))


def _assert_unique(notes: DataFrame, key: str) -> DataFrame:
    """``notes``; reading it fails if an id occurs twice."""
    n = F.count("*").over(Window.partitionBy(key))
    checked = notes.withColumn("__ok", F.assert_true(n == 1, F.concat(F.lit(f"{key} occurs twice: "), F.col(key).cast("string"))))
    return checked.filter("__ok IS NULL").drop("__ok")


def duplicate_ids(notes: DataFrame, key: str = "id") -> DataFrame:
    """Ids that occur more than once; a valid file has none."""
    return notes.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def export_annotations(images: DataFrame, categories: DataFrame) -> DataFrame:
    """Flat annotation rows with ids from 1 in the order of images, rounded boxes and original categories; the area is that of the polygons, or of the box where there are none."""
    flat = images.select("image_id", F.posexplode("annotations").alias("pos", "a")).join(F.broadcast(categories), F.col("a.category_id") == F.col("contiguous_id"))
    box = F.transform("a.bbox", lambda v: F.bround(v, 3))
    # Ids count on from image to image: sizes of images are summed over ranges, so no task sees all annotations.
    sizes = images.select("image_id", F.size("annotations").cast("long").alias("__n"))
    ends = running_sums(sizes, [], [F.col("image_id")], {"__end": F.col("__n")}).select("image_id", (F.col("__end") - F.col("__n")).alias("__start"))
    flat = flat.join(ends, "image_id")
    return flat.select(
        (F.col("__start") + F.col("pos") + 1).cast("long").alias("id"), "image_id", box.alias("bbox"), F.col("category_id"), F.coalesce("a.iscrowd", F.lit(0)).alias("iscrowd"),
        F.when(F.size("a.segmentation") > 0, polygons_area(F.col("a.segmentation"))).otherwise(F.bround(F.get("a.bbox", F.lit(2)) * F.get("a.bbox", F.lit(3)), 3)).alias("area"),
        F.transform("a.keypoints", lambda v, i: F.when(i % 3 == 2, v).otherwise(v - 0.5)).alias("keypoints"),
    )


def with_plain_annotations(images: DataFrame) -> DataFrame:
    """Images with at least one annotation that is no crowd."""
    return images.filter(F.exists("annotations", lambda a: F.coalesce(a["iscrowd"], F.lit(0)) == 0))


def with_keypoints(images: DataFrame, least: int) -> DataFrame:
    """Images with at least ``least`` visible key points (every third number above 0)."""
    visible = lambda a: F.size(F.filter(F.coalesce(a["keypoints"], F.array().cast("array<double>")), lambda v, i: (i % 3 == 2) & (v > 0)))
    return images.filter(F.aggregate("annotations", F.lit(0), lambda s, a: s + visible(a)) >= least)


def keep_images(images: DataFrame, general: Column, any_of: list[Column]) -> DataFrame:
    """Images that satisfy ``general`` and at least one of the others, if there are any (key points, masks, surface points)."""
    test = F.coalesce(general, F.lit(False))
    return images.filter(test & F.coalesce(reduce(lambda a, b: a | b, any_of), F.lit(False)) if any_of else test)


def with_field(field: str) -> Column:
    """Whether an annotation that is no crowd has a field that is neither null nor empty."""
    return F.exists("annotations", lambda a: (F.coalesce(a["iscrowd"], F.lit(0)) == 0) & F.coalesce(F.size(a[field]) > 0, F.lit(False)))


def foreground(proposals: DataFrame, label: str, background: int) -> DataFrame:
    """Proposals with a real class: neither ignored (-1) nor background."""
    return proposals.filter((F.col(label) > -1) & (F.col(label) != background))


def with_visible_point(proposals: DataFrame, points: str) -> DataFrame:
    """Proposals whose box (x0..y1) holds a visible key point of array<struct<x, y, v>>."""
    return proposals.filter(F.exists(points, lambda p: (p["v"] >= 1) & p["x"].between(F.col("x0"), F.col("x1")) & p["y"].between(F.col("y0"), F.col("y1"))))


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose numbers are all there and finite."""
    return df.filter(reduce(lambda a, b: a & b, [F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)) for c in map(lambda c: F.col(c).cast("double"), columns)]))


def map_or_fallback(df: DataFrame, by: list[str], order: list[str], made: Column) -> DataFrame:
    """``made`` for each row, and where it is null that of the next row of the group that has one (the first one after the last)."""
    tried = df.withColumn("made", made)
    ahead = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy(*by)
    return tried.withColumns({"__next": F.last("made", ignorenulls=True).over(ahead), "__first": F.min_by("made", F.when(F.col("made").isNotNull(), F.struct(*order))).over(first)}).withColumn("made", F.coalesce("__next", "__first")).drop("__next", "__first")


def inconsistent(metadata: DataFrame) -> DataFrame:
    """Keys of (dataset, key, value) that datasets give different values."""
    return metadata.groupBy("key").agg(F.count_distinct("value").alias("values")).filter("values > 1")


def empty_instances(annotations: DataFrame, by_box: bool = True, by_mask: bool = True, threshold: float = 1e-5) -> DataFrame:
    """Annotations (x0..y1, mask_area) whose box or mask is empty."""
    box = ~((F.col("x1") - F.col("x0") > threshold) & (F.col("y1") - F.col("y0") > threshold))
    tests = ([box] if by_box else []) + ([F.coalesce(F.col("mask_area"), F.lit(0)) <= 0] if by_mask else [])
    return annotations.filter(reduce(lambda a, b: a | b, tests))


def keep_categories(images: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """Annotations of the listed categories, renumbered; images that lose all of them go."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    kept = F.filter("annotations", lambda a: F.map_contains_key(table, a["category_id"]))
    renamed = F.transform(kept, lambda a: a.withField("category_id", F.try_element_at(table, a["category_id"])))
    return images.withColumn("annotations", renamed).filter(F.size("annotations") > 0)


def category_histogram(notes: DataFrame, categories: DataFrame, key: str, crowd: Column) -> DataFrame:
    """How many annotations that are no crowd each category has (0 for none), and a total with a null category."""
    counts = notes.filter(~crowd).groupBy(key).agg(F.count("*").alias("n"))
    full = categories.select(key).join(counts, key, "left").fillna(0, ["n"])
    return full.rollup(key).agg(F.sum("n").alias("n"))


def category_frequency(notes: DataFrame, image: str, key: str) -> DataFrame:
    """Share of images that hold the category."""
    images = notes.select(image).distinct().count()
    return notes.groupBy(key).agg((F.count_distinct(image) / F.lit(images)).alias("frequency"))


def repeat_factors(notes: DataFrame, image: str, key: str, threshold: float) -> DataFrame:
    """For each image the greatest max(1, sqrt(t / f)) of its categories."""
    factor = F.greatest(F.lit(1.0), F.sqrt(F.lit(threshold) / F.col("frequency")))
    rare = category_frequency(notes, image, key).withColumn("factor", factor)
    return notes.select(image, key).distinct().join(F.broadcast(rare), key).groupBy(image).agg(F.max("factor").alias("factor"))


def required_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that fails, when it runs, if a left row has no partner. Keys compare as text."""
    a, b = left.withColumn("__key", F.col(key).cast("string")), right.withColumn("__key", F.col(key).cast("string")).drop(key)
    joined = a.join(b.withColumn("__there", F.lit(True)), "__key", "left")
    return joined.withColumn("__ok", F.assert_true(F.col("__there").isNotNull(), F.concat(F.lit("no partner for "), F.col("__key")))).filter("__ok IS NULL").drop("__ok", "__there", "__key")


def merge_right_wins(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both tables; where both have a column, the right value is taken unless it is null."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    r = right.select(key, *[F.col(c).alias(f"__r_{c}" if c in shared else c) for c in right.columns if c != key])
    joined = left.join(r, key)
    return joined.withColumns({c: F.coalesce(f"__r_{c}", c) for c in shared}).drop(*[f"__r_{c}" for c in shared])


def category_conflicts(*tables: DataFrame) -> DataFrame:
    """Category ids that the tables (id, name) name differently."""
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)
    return union.groupBy("id").agg(F.count_distinct("name").alias("names")).filter("names > 1")


def flatten(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested structs as columns a/b/c."""
    def walk(prefix: str, label: str, kind) -> list[Column]:
        if hasattr(kind, "fields"):
            return [c for f in kind.fields for c in walk(f"{prefix}.`{f.name}`" if prefix else f"`{f.name}`", f"{label}{sep}{f.name}" if label else f.name, f.dataType)]
        return [F.col(prefix).alias(label)]

    return df.select(*walk("", "", df.schema))
