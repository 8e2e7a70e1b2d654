"""Heat maps, similarity on surfaces and tracks against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import metrics, poses, tracking
from brindle.streaming import metrics as streams


def cubic(x, a=-0.75):
    x = abs(x)
    return (a + 2) * x**3 - (a + 3) * x * x + 1 if x < 1 else a * x**3 - 5 * a * x * x + 8 * a * x - 4 * a if x < 2 else 0.0


def axis(old, new):
    made = np.zeros((new, old))
    for t in range(new):
        p = (t + 0.5) * old / new - 0.5
        for k in range(math.floor(p) - 1, math.floor(p) + 3):
            made[t, min(max(k, 0), old - 1)] += cubic(p - k)
    return made


def test_heat_points(spark):
    draw = np.random.default_rng(3)
    side = 5
    rows = [(k, draw.normal(size=side * side).tolist(), *(float(v) for v in (x, y, x + w, y + h))) for k, (x, y, w, h) in enumerate(draw.uniform([-3, -3, 0, 0], [9, 9, 14, 14], (25, 4)))]
    names = "id long, heat array<double>, x0 double, y0 double, x1 double, y1 double"
    box = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    got = {r.id: r for r in poses.heat_points(spark.createDataFrame([*rows, (90, [1.0], 0.0, 0.0, 3.0, 3.0), (91, None, 0.0, 0.0, 3.0, 3.0)], names), "heat", side, box).collect()}
    for k, heat, x0, y0, x1, y1 in rows:
        m = np.array(heat).reshape(side, side)
        w, h = max(1.0, x1 - x0), max(1.0, y1 - y0)
        grown = axis(side, math.ceil(h)) @ m @ axis(side, math.ceil(w)).T
        row, column = divmod(int(grown.argmax()), math.ceil(w))
        want = ((column + 0.5) * w / math.ceil(w) + x0, (row + 0.5) * h / math.ceil(h) + y0, grown.max(), 1 / np.exp(m - grown.max()).sum())
        assert [got[k].x, got[k].y, got[k].logit, got[k].score] == pytest.approx(want, abs=1e-9)
    assert got[90].logit is None and got[91].score is None


def test_ties_of_a_flat_map_go_to_the_first_place(spark):
    df = spark.createDataFrame([(1, [2.0] * 16)], "id long, heat array<double>")
    r = poses.heat_points(df, "heat", 4, tuple(F.lit(float(v)) for v in (10, 20, 14, 24))).first()
    assert (r.x, r.y, r.logit) == (10.5, 20.5, 2.0) and r.score == pytest.approx(1 / 16)


def test_surface_similarity(spark):
    points = [(1, 3, 3), (1, 1, 2), (1, 2, 1), (1, 0, 2), (1, None, 2), (1, 2, 0), (1, 4, 2), (2, 1, 0), (2, 5, None), (3, 2, 2), (3, 9, 9)]
    distances = spark.createDataFrame([(0, 0.5)], "place long, distance double")  # vertices 1 and 2; others lie on another chart
    spreads = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 2.0)], "vertex long, spread double")
    df = spark.createDataFrame(points, "pair long, vertex long, truth_vertex long")
    got = {r.pair: r.similarity for r in metrics.surface_similarity(df, ["pair"], distances, spreads).collect()}
    assert got[1] == pytest.approx((1 + math.exp(-0.125) + math.exp(-0.5)) / 6) and got[2] == 0 and got[3] == 0.5
    assert metrics.surface_similarity(df.filter("false"), ["pair"], distances, spreads).count() == 0


FIELDS = "video string, frame long, det_id long, label long, x0 double, y0 double, x1 double, y1 double, pixels array<long>"


def box(video, frame, det, x, label=1, size=10.0):
    return (video, frame, det, label, float(x), 0.0, x + size, size, None)


def tracks(df):
    return {(r.video, r.frame, r.det_id): r.track for r in df.collect()}


def test_an_old_instance_has_no_second_choice(spark):
    rows = [
        box("a", 1, 0, 0), box("a", 1, 1, 1),
        box("a", 2, 0, 0.4), box("a", 2, 1, 2.2),  # both old ones overlap the first most: the first takes it, the second has no other
        box("b", 1, 0, 0), box("b", 2, 0, 0, label=2), box("b", 3, 0, 0),  # another label, then the first track again
        box("c", 1, 0, 0), box("c", 2, 0, 2.5),  # an overlap of exactly 0.6 is not enough
    ]
    got = tracks(tracking.track(spark.createDataFrame(rows, FIELDS)))
    assert [got["a", 2, 0], got["a", 2, 1]] == [0, 2]
    assert [got["b", f, 0] for f in (1, 2, 3)] == [0, 1, 0]
    assert [got["c", f, 0] for f in (1, 2)] == [0, 1]


def test_missed_instances_expire(spark):
    """An instance is known for seven frames that miss it, and no longer in the eighth."""
    rows = [box("x", 0, 0, 0), *[box("x", f, 0, 100) for f in range(1, 8)], box("x", 8, 0, 0), box("y", 0, 0, 0), *[box("y", f, 0, 100) for f in range(1, 9)], box("y", 9, 0, 0)]
    got = tracks(tracking.track(spark.createDataFrame(rows, FIELDS)))
    assert got["x", 8, 0] == 0 and got["y", 9, 0] == 2


def test_masks_where_boxes_are_missing(spark):
    mask = lambda frame, det, pixels: ("m", frame, det, 1, None, None, None, None, pixels)
    rows = [mask(1, 0, [1, 2, 3, 4]), mask(1, 1, [7, 8]), mask(2, 0, [8, 7, 7]), mask(2, 1, [2, 3, 4, 5]), mask(2, 2, None), mask(3, 0, [4, 5, 6, 9])]
    assert tracks(tracking.track(spark.createDataFrame(rows, FIELDS))) == {("m", 1, 0): 0, ("m", 1, 1): 1, ("m", 2, 0): 1, ("m", 2, 1): 0, ("m", 2, 2): 2, ("m", 3, 0): 3}


def plain(rows, keep=8):
    """The rule by loops over dictionaries."""
    made, known, following = {}, {}, {}
    for video, frame in sorted({r[:2] for r in rows}):
        new = sorted(r for r in rows if r[:2] == (video, frame))
        old, taken = known.get(video, []), {}
        left = []
        for o in old:
            shares = []
            for n in new:
                w, h = min(o["b"][2], n[6]) - max(o["b"][0], n[4]), min(o["b"][3], n[7]) - max(o["b"][1], n[5])
                both = max(w, 0) * max(h, 0) if o["label"] == n[3] else 0
                shares.append(both / ((o["b"][2] - o["b"][0]) * (o["b"][3] - o["b"][1]) + (n[6] - n[4]) * (n[7] - n[5]) - both))
            top = shares.index(max(shares))
            if shares[top] > 0.6 and top not in taken:
                taken[top] = o["t"]
            elif o["left"] > 1:
                left.append(o | {"left": o["left"] - 1})
        now = []
        for i, n in enumerate(new):
            if i not in taken:
                taken[i] = following[video] = following.get(video, -1) + 1
            made[n[:3]] = taken[i]
            now.append({"t": taken[i], "label": n[3], "left": keep, "b": n[4:8]})
        known[video] = now + left
    return made


@pytest.fixture(scope="module")
def many():
    draw = np.random.default_rng(5)
    return [(f"v{v}", f, k, int(draw.integers(0, 2)), *(float(x) for x in (a, b, a + w, b + h)), None) for v in range(4) for f in range(40) for k in range(int(draw.integers(1, 6))) for a, b, w, h in [draw.uniform([0, 0, 6, 6], [5, 5, 9, 9])]]


def test_random_tracks(spark, many):
    want = plain(many)
    assert tracks(tracking.track(spark.createDataFrame(many[::-1], FIELDS))) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # frames cut by batches
    try:
        assert tracks(tracking.track(spark.createDataFrame(many, FIELDS))) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tracking.track(spark.createDataFrame([], FIELDS)).count() == 0


def test_stream_keeps_tracks_between_triggers(spark, many, tmp_path):
    for part, frames in enumerate((range(0, 13), range(13, 14), range(14, 40))):
        chosen = [r for r in many if r[1] in frames]
        spark.createDataFrame(chosen, FIELDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={part}"))
        source = spark.readStream.schema(FIELDS).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = streams.track_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert tracks(spark.read.parquet(str(tmp_path / "out"))) == plain(many)
