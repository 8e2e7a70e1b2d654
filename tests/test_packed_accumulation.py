"""Precision and recall of all combinations come from one sort of one row for each detection, and small blocks in a checkpoint."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.catalogue import REGISTRY
from brindle.operators import metrics
from brindle.plans import evaluation as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture
def held(monkeypatch):
    kept, plain = [], metrics.checkpointed
    monkeypatch.setattr(metrics, "checkpointed", lambda df: (kept.append(plain(df)), kept[-1])[1])
    return kept


@pytest.mark.parametrize("name", ["coco_accumulate", "coco_summary", "coco_recall", "coco_precision"])
def test_no_row_for_each_combination_is_kept(spark, held, name):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    REGISTRY.queries()[name](spark, SF).collect()
    assert len(held) == 1 and held[0].count() < lines / 50
    assert held[0].agg(F.sum(F.length("block"))).first()[0] <= 3 * lines  # 12 combinations of two bits


@pytest.mark.parametrize("n", [3, 33])
def test_codes_against_rows(spark, n):
    """Categories that span ranges and batches, scores with many ties, more combinations than a long holds; the same as with a row for each combination."""
    draw = np.random.default_rng(4)
    codes = draw.integers(-1, 3, (900, n))
    codes[:, 1] = np.where(codes[:, 1] > 0, 0, codes[:, 1])  # counts nowhere
    codes[:600, 0] = -1  # no such detection in the first category
    found = [("ab"[k // 600], k, float(draw.integers(0, 5)), [None if c < 0 else int(c) for c in codes[k]]) for k in range(900)] + [(None, 900, 1.0, [1] * n), ("c", 901, 1.0, [1] * n)]
    rows = spark.createDataFrame(found, "c string, id int, score double, codes array<int>")
    options = [{"level_of": j / 10, "kind": f"k{j}"} for j in range(n)]
    positives = spark.createDataFrame([(c, f"k{j}", p + j) for c, p in (("a", 400), ("b", 170)) for j in range(n)] + [("c", "k2", 0)], "c string, kind string, positives long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        made = metrics.accumulate_codes(rows, positives, "c", options, [F.get("codes", F.lit(j)) for j in range(n)], "score", ["id"], 11)
        precision, recall = ({tuple(r[:-1]): r[-1] for r in x.select("c", "kind", "level_of", *own).collect()} for x, own in zip(made, (["level", "precision"], ["recall"])))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = {}, {}
    for c, first in (("a", 400), ("b", 170), ("c", 0)):
        for j in range(n):
            goals = first + j if c != "c" else 0
            own = [k[3][j] for k in sorted((k for k in found if k[0] == c), key=lambda k: (-k[2], k[1]))]
            if (c == "c" and j != 2) or all(v is None for v in own):
                continue
            tp, fp = np.cumsum([v == 1 for v in own]), np.cumsum([v == 2 for v in own])
            last[c, f"k{j}", j / 10] = tp[-1] / goals if goals else -1.0
            for k in range(11):
                reached = [a / (a + b + 2.0**-52) for a, b in zip(tp, fp) if a / goals >= k / 10] if goals else []
                want[c, f"k{j}", j / 10, k] = max(reached, default=0.0) if goals else -1.0
    assert precision == want and recall == last


def test_evaluation_keeps_one_narrow_row_for_each_detection(spark, monkeypatch):
    from brindle.operators import evaluation

    kept, plain = [], evaluation.checkpointed
    monkeypatch.setattr(evaluation, "checkpointed", lambda df: (kept.append(df), plain(df))[1])
    evaluation.coco_evaluation(plans.detections(spark, SF), plans.truths(spark, SF), "image", "label", plans.LEVELS, plans.AREAS, plans.LIMITS, 11)
    assert [d.columns for d in kept] == [["image", "label", "score", "place", "codes"]]
