"""Further annotation sources and sinks: XML files, shifted categories, pairs by stem, proposals, id lists, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.metrics import running_sums

from brindle.functions.text import stem
from brindle.operators.datasets import load_annotations, required_join

BOX_FILE = "filename string, size struct<width: bigint, height: bigint>, object array<struct<name: string, difficult: int, truncated: int, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"


def load_xml_boxes(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Images of XML annotation files; boxes start at 0 instead of 1, categories are places in ``names``."""
    whole = spark.read.schema(BOX_FILE).option("rowTag", "annotation").xml(path)
    place = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)])
    note = lambda o: F.struct(F.try_element_at(place, o["name"]).alias("category_id"), F.array(o["bndbox"]["xmin"] - 1, o["bndbox"]["ymin"] - 1, o["bndbox"]["xmax"], o["bndbox"]["ymax"]).alias("bbox"), F.coalesce(o["difficult"], F.lit(0)).alias("difficult"))
    return whole.select(F.col("filename").alias("file_name"), "size.width", "size.height", F.transform(F.coalesce("object", F.expr("array()").cast(whole.schema["object"].dataType)), note).alias("annotations"))


def load_shifted(spark: SparkSession, path: str, name_length: int = 16) -> DataFrame:
    """As ``load_annotations`` with 1 taken from each category, gaps kept, and only the end of long file names that begin with COCO.
    A polygon with an odd length or under 6 numbers is an error."""
    raw = spark.read.option("multiLine", True).json(path)
    polygons = raw.select(F.explode("annotations.segmentation").alias("s")).select(F.explode("s").alias("p"))
    bad = polygons.filter((F.size("p") % 2 == 1) | (F.size("p") < 6)).limit(1).count()
    if bad:
        raise ValueError(f"{path} holds a polygon that is none")
    images = load_annotations(spark, path, from_one=True)
    name = F.when(F.col("file_name").startswith("COCO"), F.expr(f"right(file_name, {name_length})")).otherwise(F.col("file_name"))
    return images.withColumn("file_name", name)


def pair_by_stem(left: DataFrame, right: DataFrame, path: str = "path") -> DataFrame:
    """Files of two folders that share a stem."""
    a = left.select(stem(F.col(path)).alias("stem"), F.col(path).alias("left_path"))
    b = right.select(stem(F.col(path)).alias("stem"), F.col(path).alias("right_path"))
    return a.join(b, "stem")


def pair_in_order(left: DataFrame, right: DataFrame, left_root: str, right_root: str, path: str = "path") -> DataFrame:
    """(left_path, right_path) of two folders whose files answer each other in order.

    Files are ordered by their path below the root without extension, then by path. If both folders have as many, they are paired place by place,
    whatever their names; otherwise files with the same stem are. Places are running sums over ranges.
    """
    if left.count() != right.count():
        return pair_by_stem(left, right, path).select("left_path", "right_path")

    def numbered(files: DataFrame, root: str, name: str) -> DataFrame:
        below = F.regexp_replace(F.substring(F.col(path), len(root.rstrip("/")) + 2, 1 << 30), r"\.[^./]*$", "")
        made = files.select(F.col(path).alias(name), below.alias("__id"))
        return running_sums(made, [], [F.col("__id"), F.col(name)], {"__at": F.lit(1)}).select("__at", name)

    return numbered(left, left_root, "left_path").join(numbered(right, right_root, "right_path"), "__at").drop("__at")


def attach_proposals(records: DataFrame, proposals: DataFrame, key: str) -> DataFrame:
    """Records with their proposals (arrays of boxes and logits), highest logit first; a record without any is an error."""
    joined = required_join(records, proposals, key)
    order = F.sort_array(F.arrays_zip(F.col("logits"), F.transform("boxes", lambda b: b).alias("boxes")), asc=False)
    return joined.withColumn("__z", order).withColumns({"boxes": F.transform("__z", lambda z: z["boxes"]), "logits": F.transform("__z", lambda z: z["logits"])}).drop("__z")


def id_list(spark: SparkSession, path: str, folder: str, suffix: str = ".jpg") -> DataFrame:
    """Ids of a text file, one a line, with the paths that they name."""
    lines = spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")
    return lines.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("id"), F.lit(suffix)))


def write_id_list(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.text(path)


def write_metric_lines(metrics: DataFrame, path: str) -> None:
    """One JSON object for each iteration with a field for each name, appended."""
    wide = metrics.groupBy("iter").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("m"))
    line = F.to_json(F.map_concat(F.create_map(F.lit("iteration"), F.col("iter").cast("double")), "m"))
    wide.select(line.alias("value")).write.mode("append").text(path)


def prediction_lines(detections: DataFrame) -> DataFrame:
    """image_id, category_id, bbox as x, y, width, height, and score of each detection, as JSON."""
    box = F.array(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return detections.select(F.to_json(F.struct(F.col("image").alias("image_id"), F.col("label").alias("category_id"), box.alias("bbox"), "score")).alias("value"))


def registered(spark: SparkSession, rows: list, schema: str, name: str) -> DataFrame:
    """A list as an indexed table (``index`` from 0) under a name."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"index long, {schema}")
    df.createOrReplaceTempView(name)
    return df


def mask_annotations(labels: DataFrame) -> DataFrame:
    """An annotation for each label above 0 of each mask: box, area, and an id from 1 in order."""
    box = labels.filter("value > 0").groupBy("image_id", F.col("value").alias("label")).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), F.count("*").alias("area"))
    return running_sums(box, [], [F.col("image_id"), F.col("label")], {"id": F.lit(1)}).withColumn("id", F.col("id").cast("int")).drop("__p")
