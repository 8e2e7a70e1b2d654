"""Vectors for boxes, masks, matching, datasets and streams."""

import json

import pytest
from pyspark.sql import functions as F

from brindle.functions import geometry
from brindle.functions.geometry import Box
from brindle.operators import datasets, masks, matching, metrics, series
from brindle.streaming import metrics as streams


def lits(*v):
    return [F.lit(float(x)) for x in v]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("b, want", [((0, 0, 1, 1), 1), ((0, 0, 0.5, 1), 0.5), ((0, 0, 0.5, 0.5), 0.25), ((0.5, 0.5, 1.5, 1.5), 0.25 / 1.75), ((2, 2, 3, 3), 0)])
def test_iou(spark, b, want):
    assert value(spark, geometry.iou(Box(*lits(0, 0, 1, 1)), Box(*lits(*b)))) == pytest.approx(want)


@pytest.mark.parametrize("box, want", [((50, 50, 30, 20, 0), (35, 40, 65, 60)), ((50, 50, 30, 20, 90), (40, 35, 60, 65)), ((1, 1, 2**0.5, 2**0.5, -45), (0, 0, 2, 2))])
def test_rotated(spark, box, want):
    b = geometry.rotated_bounds(*lits(*box))
    assert tuple(value(spark, F.struct(*b.columns()))) == pytest.approx(want, abs=1e-6)


def test_anchors(spark):
    rows = geometry.anchors(spark, [32, 64], [0.25, 1, 4], 4, 1, 2).orderBy("row", "column", "cell").collect()
    assert len(rows) == 12
    assert tuple(rows[0])[3:] == pytest.approx((-32, -8, 32, 8)) and tuple(rows[6])[3:] == pytest.approx((-28, -8, 36, 8))


@pytest.mark.parametrize("points, want", [([0, 0, 5, 0, 5, 5, 0, 5], 25), ([0, 0, 10, 0, 10, 10], 50)])
def test_polygon_area(spark, points, want):
    assert value(spark, geometry.polygon_area(F.array(*lits(*points)))) == want


def test_overlapping_equals_pairwise(spark):
    import random

    random.seed(4)
    made = lambda p: spark.createDataFrame([(i % 3, i, x := random.uniform(0, 300), y := random.uniform(0, 300), x + random.uniform(1, 150), y + random.uniform(1, 150)) for i in range(80)], f"g int, {p}id long, {p}x0 double, {p}y0 double, {p}x1 double, {p}y1 double")
    a, b = made("a_").cache(), made("b_").cache()
    key = lambda df: sorted((r.a_id, r.b_id, round(r.iou, 9)) for r in df.collect())
    assert key(geometry.overlapping(a, b, "g")) == key(geometry.pairwise_iou(a, b, "g").filter("iou > 0"))


def test_average_precision(spark):
    rows = spark.createDataFrame([(1, 0.9, True, 2), (2, 0.8, False, 2), (3, 0.7, True, 2)], "id long, score double, hit boolean, positives int").withColumn("c", F.lit(1))
    curve = metrics.precision_recall(rows, ["c"], "score", "hit", "positives", ["id"])
    assert metrics.average_precision(curve, ["c"]).first()["ap"] == pytest.approx(5 / 6)


def test_repeat_factor(spark):
    notes = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1), ("C", 1), ("D", 1)], "image string, cat int")
    got = {r.image: r.factor for r in datasets.repeat_factors(notes, "image", "cat", 0.5).collect()}
    assert got["A"] == pytest.approx(2**0.5) and got["B"] == 1


def test_suppression_and_matching(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 1.0, 0.0, 11.0, 10.0), (1, 3, 0.7, 50.0, 0.0, 60.0, 10.0)], "image long, det_id long, score double, x0 double, y0 double, x1 double, y1 double")
    kept = matching.non_maximum_suppression(rows, ["image"], 0.5, ties=["det_id"])
    assert sorted(r.det_id for r in kept.collect()) == [1, 3]
    truth = spark.createDataFrame([(1, 7, 0.0, 0.0, 10.0, 10.0)], "image long, gt_id long, x0 double, y0 double, x1 double, y1 double")
    got = {r.det_id: (r.gt_id, r.hit) for r in matching.greedy_match(rows, truth, ["image"], 0.5, ["det_id"]).collect()}
    assert got == {1: (7, True), 2: (None, False), 3: (None, False)}


def test_mask_box(spark):
    on = F.col("y").between(2, 4) & F.col("x").between(1, 3)
    got = masks.properties(masks.grid(spark, 1, 6, 6, F.when(on, 1.0).otherwise(0.0)), spark.range(2).withColumnRenamed("id", "image_id")).orderBy("image_id").collect()
    assert (got[0].width, got[0].height, got[0].x0, got[0].y0, got[0].x1, got[0].y1) == (3, 3, 1, 2, 3, 4)
    assert (got[1].width, got[1].x1) == (0, 0)


def test_smoothing(spark):
    rows = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate([5, 1, 4, 2, 3])], "name string, iter long, value double")
    assert [r.smoothed for r in series.smoothed(rows, "name", "value", ["iter"], 3).orderBy("iter").collect()] == [5, 3, 4, 2, 3]


def test_load_and_export(spark, tmp_path):
    file = {
        "images": [{"id": 5, "width": 9, "height": 9, "file_name": "a"}, {"id": 4, "width": 9, "height": 9, "file_name": "b"}],
        "annotations": [
            {"id": 1, "image_id": 5, "bbox": [1, 2, 3.12345, 4], "area": 12, "iscrowd": 0, "category_id": 30, "segmentation": [[0, 0, 1, 1], [0, 0, 1, 0, 1, 1]], "keypoints": [1, 2, 2]},
            {"id": 2, "image_id": 5, "bbox": [0, 0, 1, 1], "area": 1, "iscrowd": 1, "category_id": 10, "segmentation": [[0, 0, 1]], "keypoints": None},
        ],
        "categories": [{"id": 30, "name": "x"}, {"id": 10, "name": "y"}],
    }
    (tmp_path / "f.json").write_text(json.dumps(file))
    rows = {r.image_id: r for r in datasets.load_annotations(spark, str(tmp_path / "f.json")).collect()}
    assert rows[4].annotations == [] and len(rows[5].annotations) == 1
    note = rows[5].annotations[0]
    assert note.category_id == 1 and note.segmentation == [[0, 0, 1, 0, 1, 1]] and note.keypoints == [1.5, 2.5, 2]
    ranks = datasets.contiguous(spark.createDataFrame([(30,), (10,)], "category_id long"), "category_id")
    back = datasets.export_annotations(datasets.load_annotations(spark, str(tmp_path / "f.json")), ranks).collect()
    assert [(r.id, r.category_id, r.bbox[2], r.keypoints, r.area) for r in back] == [(1, 30, 3.123, [1, 2, 2], 0.5)]


def test_catalog(spark):
    c = datasets.Catalog()
    c.register("a", lambda s: s.range(3))
    with pytest.raises(ValueError):
        c.register("a", lambda s: s.range(1))
    assert c.get(spark, "a").count() == 3 and spark.table("a").count() == 3
    with pytest.raises(KeyError):
        c.get(spark, "b")


def test_streams(spark, tmp_path):
    spark.createDataFrame([("m", i, float(v)) for i, v in enumerate([5, 1, 4, 2, 3])], "name string, iter long, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("name string, iter long, value double").parquet(str(tmp_path / "in"))
    q = streams.smoothed_stream(source, 3).writeStream.format("memory").queryName("smooth").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.smoothed for r in spark.table("smooth").orderBy("iter").collect()] == [5, 3, 4, 2, 3]
