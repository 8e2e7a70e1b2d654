"""Groups with few pairs of overlapping boxes are decided by one stream of pairs, others in rounds, with one result."""

import numpy as np
import pytest

from brindle.operators import evaluation as ev
from brindle.operators.matching import suppressed


@pytest.mark.parametrize("many", [0, 700, 1 << 20])
def test_stream_and_rounds(spark, monkeypatch, many):
    draw = np.random.default_rng(9)
    n = 900
    low = draw.integers(0, 90, (n, 2)).astype(float)
    boxes = np.hstack([low, low + draw.integers(1, 40, (n, 2))])
    group, score = np.where(np.arange(n) < 600, 0, 1), draw.integers(0, 9, n) / 9
    df = spark.createDataFrame([(int(group[k]), k, float(score[k]), *map(float, boxes[k])) for k in range(n)], "g int, id long, score double, x0 double, y0 double, x1 double, y1 double")
    kept, plain = [], ev.checkpointed
    monkeypatch.setattr(ev, "checkpointed", lambda d: (kept.append(1), plain(d))[1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {r.id for r in ev.suppress_in_rounds(df, ["g"], 0.3, "id", many=many).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for g in (0, 1):
        ids = np.flatnonzero(group == g)
        want |= set(suppressed(boxes, ids[np.lexsort((ids, -score[ids]))], 0.3).tolist())
    assert got == want
    assert (len(kept) == 3) == (many == 1 << 20)  # the boxes, the pairs and those left to rounds: no round was needed
