"""Groups of up to a bound are suppressed in one stream, from one shuffle and without pairs; larger ones in parallel, with one result."""

import numpy as np
import pytest

from brindle.catalogue import REGISTRY
from brindle.operators import evaluation as ev
from brindle.operators.matching import first_come, suppressed

SF = "/root/testdata/sf0.001"


def test_no_pairs_and_no_checkpoint(spark, monkeypatch):
    kept, plain = [], ev.checkpointed
    monkeypatch.setattr(ev, "checkpointed", lambda d: (kept.append(1), plain(d))[1])
    plan = REGISTRY.queries()["nms_large_groups"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not kept and "Join" not in plan and plan.count("Exchange") == 1


def drawn(spark):
    """Three groups, one of null; more boxes that stay than a block is compared with at once; scores that are missing or no numbers."""
    draw = np.random.default_rng(12)
    n = 2600
    low = draw.integers(0, 300, (n, 2)).astype(float)
    boxes = np.hstack([low, low + draw.integers(1, 40, (n, 2))])
    group = np.where(np.arange(n) < 2000, 0, np.where(np.arange(n) < 2400, 1, 2))
    score = [None if k % 97 == 0 else float("nan") if k % 89 == 0 else k * 7919 % 13 / 13 for k in range(n)]
    df = spark.createDataFrame([(None if group[k] == 2 else int(group[k]), k, score[k], *map(float, boxes[k])) for k in range(n)], "g int, id long, score double, x0 double, y0 double, x1 double, y1 double")
    want = set()
    for g in (0, 1, 2):
        place = lambda k: (1, 0.0, k) if score[k] is None else (2, 0.0, k) if score[k] != score[k] else (0, -score[k], k)
        ids = sorted(np.flatnonzero(group == g).tolist(), key=place)
        want |= set(suppressed(boxes, np.array(ids), 0.3).tolist())
    return df, want


@pytest.mark.parametrize("large, batch", [(1, 10_000), (16, 70), (600, 900), (5_000, 10_000)])
def test_blocks_and_batches(spark, large, batch):
    df, want = drawn(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = [r.id for r in ev.suppress(df, ["g"], 0.3, "id", large=large).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == want


def test_groups_beyond_a_stream(spark):
    df, want = drawn(spark)
    plain = df.filter("score IS NOT NULL AND NOT isnan(score)")
    got = {r.id for r in ev.suppress(plain, ["g"], 0.3, "id", large=16, streamed=500).collect()}
    assert got == {r.id for r in ev.suppress(plain, ["g"], 0.3, "id", large=16).collect()} and len(got) > 500


def test_places_that_are_gone_remove_nothing():
    removes = np.eye(9, dtype=bool) | (np.arange(9)[None] == np.arange(9)[:, None] + 1)
    assert first_come(removes).tolist() == [0, 2, 4, 6, 8]
    assert first_come(removes, np.arange(9) == 2).tolist() == [0, 3, 5, 7]
