"""Evaluations and suppression against plain loops that follow their definitions."""

import random

import numpy as np
import pytest

from brindle.operators import evaluation as ev
from brindle.operators.matching import suppressed

AREAS = {"all": (0.0, 1e5), "small": (0.0, 300.0), "large": (300.0, 1e5)}
LEVELS = [0.3, 0.5, 0.75]


def overlap(a, b, plus=0.0, crowd=False):
    w = min(a[2], b[2]) - max(a[0], b[0]) + plus
    h = min(a[3], b[3]) - max(a[1], b[1]) + plus
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda x: (x[2] - x[0] + plus) * (x[3] - x[1] + plus)
    return w * h / (area(a) if crowd else area(a) + area(b) - w * h)


@pytest.fixture(scope="module")
def made(spark):
    draw = random.Random(2)

    def box():
        x, y = draw.randint(0, 30), draw.randint(0, 30)
        return [float(x), float(y), float(x + draw.randint(1, 30)), float(y + draw.randint(1, 30))]

    found, goals = [], []
    for image in range(12):
        for label in "ab":
            if image == 3 and label == "b":
                continue
            for k in range(draw.choice([0, 1, 8, 25])):
                b = box()
                goals.append((image, label, k, *b, (b[2] - b[0]) * (b[3] - b[1]) * draw.choice([1.0, 0.8]), draw.random() < 0.15, draw.choice([None, False, True, False]), draw.random() < 0.2))
            for k in range(draw.choice([0, 3, 30])):
                b = goals[draw.randrange(len(goals))][3:7] if goals and draw.random() < 0.5 else box()
                found.append((image, label, k, draw.choice([0.1, 0.2, 0.5, 0.9]), *b))
    corners = "x0 double, y0 double, x1 double, y1 double"
    return found, goals, spark.createDataFrame(found, f"image long, label string, det_id long, score double, {corners}"), spark.createDataFrame(goals, f"image long, label string, gt_id long, {corners}, area double, crowd boolean, ignore boolean, difficult boolean")


def plain_coco(found, goals, level, lo, hi, most):
    goals = sorted(goals, key=lambda g: g[2])
    out = [g[8] or bool(g[9]) or not lo <= g[7] <= hi for g in goals]
    order = [i for i in range(len(goals)) if not out[i]] + [i for i in range(len(goals)) if out[i]]
    used, rows = set(), []
    for place, d in enumerate(sorted(found, key=lambda d: (-d[3], d[2]))[:most], 1):
        best, m = min(level, 1 - 1e-10), None
        for i in order:
            if i in used and not goals[i][8]:
                continue
            if m is not None and not out[m] and out[i]:
                break
            v = overlap(d[4:], goals[i][3:7], crowd=goals[i][8])
            if v >= best and v > 0:
                best, m = v, i
        used.add(m)
        area = (d[6] - d[4]) * (d[7] - d[5])
        rows.append((d[0], d[1], d[2], place, None if m is None else goals[m][2], out[m] if m is not None else not lo <= area <= hi))
    return rows


def test_coco_matches(made):
    found, goals, fd, gd = made
    got = ev.coco_matches(fd, gd, ["image", "label"], LEVELS, AREAS, 20).collect()
    want = []
    for image in range(12):
        for label in "ab":
            mine = lambda rows: [r for r in rows if r[:2] == (image, label)]  # noqa: B023, E731
            for name, (lo, hi) in AREAS.items():
                for level in LEVELS:
                    want += [(*r, name, level) for r in plain_coco(mine(found), mine(goals), level, lo, hi, 20)]
    key = lambda r: str(r)
    assert sorted(((r.image, r.label, r.det_id, r.place, r.gt_id, r.ignored, r.area, r.threshold) for r in got), key=key) == sorted(want, key=key)
    assert len(want) > 500


def test_coco_without_truths(made):
    _, _, fd, gd = made
    got = ev.coco_matches(fd, gd.limit(0), ["image", "label"], LEVELS, AREAS, 5).collect()
    assert got and all(r.gt_id is None for r in got) and {r.ignored for r in got if r.area == "all"} == {False}
    assert ev.coco_matches(fd.limit(0), gd, ["image", "label"], LEVELS, AREAS, 5).count() == 0


def plain_voc(found, goals, level):
    used, tp, fp = set(), [], []
    for d in sorted(found, key=lambda d: (-d[3], d[0], d[2])):
        best, m = -1.0, None
        for g in goals:
            v = overlap(d[4:], g[3:7], 1.0)
            if g[0] == d[0] and v > best:
                best, m = v, g
        right = best > level and not m[10] and m[:3] not in used
        wrong = best <= level or (not m[10] and m[:3] in used)
        if best > level:
            used.add(m[:3])
        tp.append(right), fp.append(wrong)
    return np.array(tp), np.array(fp)


@pytest.mark.parametrize("points", [None, 11])
def test_voc_average_precision(made, points):
    found, goals, fd, gd = made
    got = {(r.label, r.threshold): r.ap for r in ev.voc_average_precision(fd, gd, "image", "label", LEVELS, points).collect()}
    for label in "ab":
        for level in LEVELS:
            mine = [g for g in goals if g[1] == label]
            tp, fp = plain_voc([d for d in found if d[1] == label], mine, level)
            ct, cf = np.cumsum(tp), np.cumsum(fp)
            rec, prec = ct / sum(not g[10] for g in mine), ct / np.maximum(ct + cf, 2.0**-52)
            if points:
                ap = np.mean([prec[rec >= 0.1 * k].max(initial=0) for k in range(11)])
            else:
                ap = sum((r - b) * prec[k:].max() for k, (r, b) in enumerate(zip(rec, [0, *rec])))
            assert got[label, level] == pytest.approx(ap)


def test_box_recall(made):
    found, goals, fd, gd = made
    fd, gd = fd.filter("label = 'a'"), gd.filter("label = 'a'")
    got = {(r.area, r.limit): (r.positives, r.ar) for r in ev.box_recall(fd, gd, "image", AREAS, [2, 10], LEVELS).collect()}
    for name, (lo, hi) in AREAS.items():
        for limit in (2, 10):
            hits, positives = 0, 0
            for image in range(12):
                mine = sorted((d for d in found if d[:2] == (image, "a")), key=lambda d: (-d[3], d[2]))
                ours = [g for g in goals if g[:2] == (image, "a") and not g[8] and lo <= g[7] <= hi]
                if not mine:
                    continue
                positives += len(ours)
                table = np.array([[overlap(d[4:], g[3:7]) for g in ours] for d in mine[:limit]]).reshape(len(mine[:limit]), len(ours))
                for _ in range(min(table.shape)):
                    g, p = min(((-table[p, g], g, p) for g in range(table.shape[1]) for p in range(table.shape[0])))[1:]
                    hits += sum(table[p, g] >= t for t in LEVELS)
                    table[p, :] = table[:, g] = -1
            assert got[name, limit] == (positives, pytest.approx(hits / positives / len(LEVELS)))


@pytest.mark.parametrize("plus", [0.0, 1.0])
def test_suppression_in_rounds(spark, plus):
    draw = np.random.default_rng(4)
    n = 8000
    x, y = draw.integers(0, 900, n).astype(float), draw.integers(0, 900, n).astype(float)
    boxes = np.stack([x, y, x + draw.integers(1, 60, n), y + draw.integers(1, 60, n)], axis=1)
    boxes[n - 500 :] = boxes[:500]
    score = draw.integers(0, 50, n) / 50
    rows = [(k % 2, k, float(s), *map(float, b), "own") for k, (s, b) in enumerate(zip(score, boxes))]
    df = spark.createDataFrame(rows, "g int, id long, score double, x0 double, y0 double, x1 double, y1 double, v string")
    got = {r.id for r in ev.suppress_in_rounds(df, ["g"], 0.3, "id", plus=plus).collect()}
    want = set()
    for g in (0, 1):
        ids = np.arange(n)[np.arange(n) % 2 == g]
        order = ids[np.lexsort((ids, -score[ids]))]
        want |= set(suppressed(boxes, order, 0.3, plus).tolist())
    assert got == want and len(got) < n
    mixed = {r.id for r in ev.suppress(df.filter("g = 0 OR id < 400"), ["g"], 0.3, "id", plus=plus, large=1000).collect()}
    small = np.arange(1, 400, 2)
    assert mixed == {k for k in want if k % 2 == 0} | set(suppressed(boxes, small[np.lexsort((small, -score[small]))], 0.3, plus).tolist())
