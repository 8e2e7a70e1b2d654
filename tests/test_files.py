"""Annotation files, sinks and decoding vectors."""

import json

import pytest
from pyspark.sql import functions as F

from brindle.operators import poses
from brindle.sources import annotation_files as files


def test_xml_boxes(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<annotation><filename>a.jpg</filename><size><width>9</width><height>8</height></size><object><name>cat</name><difficult>1</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>5</xmax><ymax>6</ymax></bndbox></object></annotation>")
    row = files.load_xml_boxes(spark, str(tmp_path / "a.xml"), ["dog", "cat"]).first()
    assert (row.file_name, row.width, row.height) == ("a.jpg", 9, 8)
    assert row.annotations[0].asDict() == {"category_id": 1, "bbox": [0, 1, 5, 6], "difficult": 1}


def test_proposals(spark):
    records = spark.createDataFrame([(1,), (2,)], "id long")
    proposals = spark.createDataFrame([("1", [[0.0], [1.0]], [0.1, 0.9]), ("2", [[5.0]], [0.3])], "id string, boxes array<array<double>>, logits array<double>")
    got = {r.id: (r.boxes, r.logits) for r in files.attach_proposals(records, proposals, "id").collect()}
    assert got == {1: ([[1.0], [0.0]], [0.9, 0.1]), 2: ([[5.0]], [0.3])}
    with pytest.raises(Exception, match="no partner"):
        files.attach_proposals(records.union(spark.range(3, 4)), proposals, "id").collect()


def test_lines(spark, tmp_path):
    metrics = spark.createDataFrame([(1, "loss", 0.5), (1, "lr", 0.1), (2, "loss", 0.4)], "iter long, name string, value double")
    files.write_metric_lines(metrics, str(tmp_path / "m"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "m")).collect())
    assert [json.loads(x) for x in lines] == [{"iteration": 1, "loss": 0.5, "lr": 0.1}, {"iteration": 2, "loss": 0.4}]
    (tmp_path / "ids.txt").write_text("a\nb\n\n")
    assert [r.path for r in files.id_list(spark, str(tmp_path / "ids.txt"), "/x/").collect()] == ["/x/a.jpg", "/x/b.jpg"]


def test_sliders(spark):
    config = "# c\nscale, float, 1.5, 0, 2, 0.1\nbroken\nsteps, int, 20, 1, 50, 1"
    assert poses.sliders(config) == {"scale": ("FLOAT", 1.5), "steps": ("INT", 20)}
    assert tuple(spark.range(1).select(*poses.slider_columns(config, {"value_2_steps": 30})).first()) == (1.5, 30)


def test_neck_and_palette(spark):
    points = F.array(*[F.struct(F.lit(float(k)).alias("x"), F.lit(2.0 * k).alias("y"), F.lit(0.5).alias("score")) for k in range(18)])
    row = spark.range(1).select(poses.with_neck(points).alias("p")).first()
    assert len(row.p) == 19 and tuple(row.p[17]) == (5.5, 11.0, 1.0)
    colours = {r.label: (r.r, r.g, r.b) for r in poses.palette(spark, 10).collect()}
    assert colours[0] == (0, 0, 0) and colours[1] == (128, 0, 0) and colours[3] == (128, 128, 0) and colours[8] == (64, 0, 0)
