"""The matches of an evaluation are made once, and only what counts is sorted."""

from pyspark.sql import functions as F

from brindle.operators import evaluation, metrics
from brindle.plans.evaluation import AREAS, LEVELS, LIMITS, detections, truths

SF = "/root/testdata/sf0.001"


def test_matches_are_made_once(spark):
    precision, recall = evaluation.coco_evaluation(detections(spark, SF), truths(spark, SF), "image", "label", LEVELS, AREAS, LIMITS, 11)
    for made in (precision, recall):
        assert "CoGroup" not in made._jdf.queryExecution().executedPlan().toString()


def test_ignored_rows_are_not_sorted(spark, monkeypatch):
    seen, plain = [], metrics.running_sums
    monkeypatch.setattr(metrics, "running_sums", lambda df, *a: (seen.append((df.columns, df.count())), plain(df, *a))[1])
    rows = [("a", i, 1.0 - i / 10, i % 3 == 0, i % 4 == 1, "wide") for i in range(10)] + [("b", i, 0.5, False, True, "wide") for i in range(3)]
    matches = spark.createDataFrame(rows, "c string, place int, score double, hit boolean, ignored boolean, note string")
    positives = spark.createDataFrame([("a", 4), ("b", 2)], "c string, positives long")
    precision, recall = metrics.accumulate(matches, positives, ["c"], "score", ["place"], 3)
    assert seen == [(["c", "score", "place", "hit"], 7)]
    assert {r.c: r.recall for r in recall.collect()} == {"a": 0.75, "b": 0.0}
    assert [r.precision for r in precision.filter(F.col("c") == "b").collect()] == [0.0] * 3
