"""Resampling filters: known values, properties, and other libraries where they are installed."""

import numpy as np
import pytest

from brindle.operators import resampling, resizing


def matrix(old, new, method):
    m = np.zeros((new, old))
    for t, s, w in resampling.weights(old, new, method):
        m[t, s] = w
    return m


@pytest.mark.parametrize("method", resampling.METHODS)
@pytest.mark.parametrize("old,new", [(1, 1), (1, 5), (5, 1), (7, 7), (3, 10), (10, 3), (64, 9)])
def test_weights(method, old, new):
    m = matrix(old, new, method)
    assert m.sum(1) == pytest.approx(np.ones(new))
    assert m == pytest.approx(m[::-1, ::-1]) or method == "nearest"  # symmetric
    if old == new:
        assert m == pytest.approx(np.eye(old))


def test_known_values():
    assert matrix(2, 4, "bilinear") @ [0, 1] == pytest.approx([0, 0.25, 0.75, 1])
    assert matrix(4, 2, "area") @ [1, 2, 3, 5] == pytest.approx([1.5, 4])
    assert matrix(3, 2, "area") @ [1, 2, 4] == pytest.approx([1.5, 3])
    assert matrix(4, 2, "bilinear") @ [0, 1, 2, 3] == pytest.approx([0.5, 2.5])
    # A step, a quarter of a pixel after the second of four.
    assert matrix(4, 8, "bicubic")[3] @ [0, 0, 1, 1] == pytest.approx(0.2265625)
    with pytest.raises(ValueError):
        resampling.weights(0, 3, "area")
    with pytest.raises(ValueError):
        resampling.weights(3, 3, "none")


@pytest.mark.parametrize("method,name", [("bilinear", "bilinear"), ("bicubic", "bicubic"), ("area", "area")])
def test_against_tensor_library(method, name):
    torch = pytest.importorskip("torch")
    x = torch.rand(1, 1, 7, 9, dtype=torch.float64)
    more = {} if name == "area" else {"align_corners": False}
    want = torch.nn.functional.interpolate(x, size=(5, 13), mode=name, **more).numpy()[0, 0]
    assert matrix(7, 5, method) @ x.numpy()[0, 0] @ matrix(9, 13, method).T == pytest.approx(want)


@pytest.mark.parametrize("method,number", [("wide_bilinear", 2), ("wide_bicubic", 3), ("lanczos", 1)])
def test_against_image_library(method, number):
    image = pytest.importorskip("PIL.Image")
    x = np.random.default_rng(1).random((7, 9), np.float32)
    want = np.asarray(image.fromarray(x).resize((13, 5), number))
    assert matrix(7, 5, method) @ x @ matrix(9, 13, method).T == pytest.approx(want, abs=1e-5)


def frame(spark, image, number=0):
    return spark.createDataFrame([(number, y, x, float(v)) for (y, x), v in np.ndenumerate(image)], "image_id long, y int, x int, value double")


def array(df, size):
    out = np.full(size, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r.value
    return out


def test_resample_frames(spark, monkeypatch):
    x = np.random.default_rng(2).random((6, 5))
    want = matrix(6, 4, "lanczos") @ x @ matrix(5, 9, "lanczos").T
    assert array(resampling.resample(frame(spark, x), (6, 5), (4, 9), "lanczos"), (4, 9)) == pytest.approx(want)
    monkeypatch.setattr(resampling, "MOST_WEIGHTS", 1)  # joined, not broadcast
    assert array(resampling.resample(frame(spark, x), (6, 5), (4, 9), "lanczos"), (4, 9)) == pytest.approx(want)
    b = np.floor(x * 256)
    rows = np.clip(np.floor(b @ matrix(5, 9, "lanczos").T + 0.5), 0, 255)
    assert array(resampling.resample(frame(spark, b), (6, 5), (4, 9), "lanczos", bytes_=True), (4, 9)).tolist() == np.clip(np.floor(matrix(6, 4, "lanczos") @ rows + 0.5), 0, 255).tolist()
    assert resampling.resample(frame(spark, x).limit(0), (6, 5), (4, 9), "area").count() == 0


def test_merge_batches(spark):
    a, b = np.random.default_rng(3).random((4, 6)), np.random.default_rng(4).random((8, 6))
    made = {mode: resizing.merge_batches([(frame(spark, a), (4, 6)), (frame(spark, b), (8, 6))], mode) for mode in ("stretch", "crop", "pad")}
    assert array(made["stretch"].filter("batch = 0"), (4, 6)) == pytest.approx(a)
    assert array(made["stretch"].filter("batch = 1"), (4, 6)) == pytest.approx(matrix(8, 4, "bilinear") @ b)
    assert array(made["crop"].filter("batch = 1"), (4, 6)) == pytest.approx(b[2:6])
    small = matrix(8, 4, "bilinear") @ b @ matrix(6, 3, "bilinear").T
    assert array(made["pad"].filter("batch = 1"), (4, 6)) == pytest.approx(np.pad(small, ((0, 0), (1, 2))))


def test_resize_by_mask_with_a_filter(spark):
    draw = np.random.default_rng(6)
    images = draw.random((2, 12, 10))
    masks = np.zeros((2, 12, 10))
    masks[0, 3:9, 4:7] = masks[1, 5:8, 1:6] = 1
    stacked = lambda stack: frame(spark, stack[0]).unionByName(frame(spark, stack[1], 1))
    got = resizing.resize_by_mask(stacked(images), stacked(masks), (12, 10), (8, 9), "pad", 0.5, "lanczos4")
    for k, (y0, y1, x0, x1) in enumerate([(3, 8, 4, 6), (5, 7, 1, 5)]):
        scale = min(9 / (x1 - x0 + 1), 8 / (y1 - y0 + 1))
        high, wide = round(12 * scale), round(10 * scale)
        scaled = matrix(12, high, "lanczos4") @ images[k] @ matrix(10, wide, "lanczos4").T
        top, left = 4 - round((y0 + y1) / 2 * scale), 4 - round((x0 + x1) / 2 * scale)
        want = np.full((8, 9), 0.5)
        for y in range(8):
            for x in range(9):
                if 0 <= y - top < high and 0 <= x - left < wide:
                    want[y, x] = scaled[y - top, x - left]
        assert array(got.filter(f"image_id = {k}"), (8, 9)) == pytest.approx(want)
