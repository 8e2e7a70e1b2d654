"""Series, batches and file pairs that are dealt to ranges and blocks give what plain loops give."""

import json
from statistics import median

import numpy as np
import pytest

from brindle.operators import sampling, series
from brindle.sources import annotation_files


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(2)
    names = ["hot"] * 90 + ["b"] * 11 + [None] * 7 + ["one"]
    return [(n, k, None if k % 13 == 5 else float(draw.integers(0, 50))) for k, n in enumerate(names)]


def by_name(rows):
    groups = {}
    for n, k, v in rows:
        groups.setdefault(n, []).append((k, v))
    return groups


@pytest.mark.parametrize("block", [5, 8, 1000])
def test_series_in_blocks(spark, rows, block):
    df = spark.createDataFrame(rows[::-1], "name string, iter long, value double")
    smooth, average = {}, {}
    for items in by_name(rows).values():
        for i, (k, _) in enumerate(items):
            last, every = ([v for _, v in items[low : i + 1] if v is not None] for low in (max(0, i - 4), 0))
            smooth[k] = median(last) if last else None
            average[k] = (sum(last) / len(last) if last else None, sum(every) / len(every) if every else None)
    got = series.smoothed(df, "name", "value", ["iter"], 5, block=block)
    assert got.columns == ["name", "iter", "value", "smoothed"] and {r.iter: r.smoothed for r in got.collect()} == smooth
    got = series.running_average(df, "name", "value", ["iter"], 5, block)
    assert got.columns == ["name", "iter", "value", "avg_window", "avg_global"]
    for r in got.collect():
        assert (r.avg_window, r.avg_global) == pytest.approx(average[r.iter])


def test_window_longer_than_a_block(spark, rows):
    with pytest.raises(ValueError):
        series.smoothed(spark.createDataFrame(rows, "name string, iter long, value double"), "name", "value", ["iter"], 9, block=8)


def test_batches_and_offsets(spark, rows):
    df = spark.createDataFrame(rows, "name string, iter long, value double")
    got = sampling.group_batches(df, "name", ["iter"], 4)
    want = {k: i // 4 for items in by_name(rows).values() for i, (k, _) in enumerate(items) if i // 4 < len(items) // 4}
    assert got.columns == ["name", "iter", "value", "batch"] and {r.iter: r.batch for r in got.collect()} == want
    ends = {k: sum(j for j, _ in items[: i + 1]) for items in by_name(rows).values() for i, (k, _) in enumerate(items)}
    assert {r.iter: r.end for r in series.byte_offsets(df, "iter", ["iter"], "name").collect()} == ends


def test_files_in_order(spark):
    files = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    pairs = lambda a, b: sorted(map(tuple, annotation_files.pair_in_order(a, b, "/in/", "/out").collect()))
    left = files("/in/b/2.jpg", "/in/a/9.jpg", "/in/a/10.jpg")
    assert pairs(left, files("/out/a/10_x.png", "/out/b/2_x.png", "/out/a/9_x.png")) == [("/in/a/10.jpg", "/out/a/10_x.png"), ("/in/a/9.jpg", "/out/a/9_x.png"), ("/in/b/2.jpg", "/out/b/2_x.png")]
    assert pairs(left, files("/out/q/9.png", "/out/2.png")) == [("/in/a/9.jpg", "/out/q/9.png"), ("/in/b/2.jpg", "/out/2.png")]


def test_shifted_categories_keep_gaps(spark, tmp_path):
    note = lambda k, category: {"id": k, "image_id": 1, "bbox": [0, 0, 1, 1], "area": 1, "category_id": category, "segmentation": [[0, 0, 1, 0, 1, 1]]}
    file = {"images": [{"id": 1, "width": 9, "height": 9, "file_name": "COCO_val2014_000000000001.jpg"}], "annotations": [note(1, 3), note(2, 7)], "categories": [{"id": 3, "name": "x"}, {"id": 7, "name": "y"}]}
    (tmp_path / "f.json").write_text(json.dumps(file))
    row = annotation_files.load_shifted(spark, str(tmp_path / "f.json")).first()
    assert row.file_name == "000000000001.jpg" and sorted(a.category_id for a in row.annotations) == [2, 6]
