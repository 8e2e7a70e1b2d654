"""Rotated boxes (cx, cy, w, h, angle in degrees): overlap, suppression, deltas and clipping."""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.geometry import SCALE_CLAMP, wrap_angle
from brindle.operators import matching


def corners(boxes: np.ndarray) -> np.ndarray:
    """Four corners of each box, in turn."""
    t = np.radians(boxes[:, 4])
    c, s = np.cos(t) / 2, np.sin(t) / 2
    ux, uy = c * boxes[:, 2], -s * boxes[:, 2]
    vx, vy = s * boxes[:, 3], c * boxes[:, 3]
    signs = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    return np.stack([np.stack([boxes[:, 0] + a * ux + b * vx, boxes[:, 1] + a * uy + b * vy], 1) for a, b in signs], 1)


def _cross(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]


def _common_area(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Areas that a rectangle p (4 corners), or one for each of q (n x 4 corners), shares with rectangles q (n x 4 corners).

    The corners of the shared polygon are corners of one in the other and crossings of sides; they are set in
    turn around their mean.
    """
    n = len(q)
    p = np.broadcast_to(p, (n, 4, 2))
    small = 1e-9 * np.maximum(1.0, np.abs(p).max((1, 2)))[:, None]

    def within(points: np.ndarray, box: np.ndarray) -> np.ndarray:
        u, v = box[..., 1, :] - box[..., 0, :], box[..., 3, :] - box[..., 0, :]
        w = points - box[..., None, 0, :]
        a, b = (w * u[..., None, :]).sum(-1), (w * v[..., None, :]).sum(-1)
        return (a >= -small) & (a <= (u * u).sum(-1)[..., None] + small) & (b >= -small) & (b <= (v * v).sum(-1)[..., None] + small)

    d, e = (np.roll(p, -1, 1) - p)[:, :, None, :], (np.roll(q, -1, 1) - q)[:, None, :, :]
    gap = q[:, None, :, :] - p[:, :, None, :]
    base = _cross(d, e)
    with np.errstate(divide="ignore", invalid="ignore"):
        s, t = _cross(gap, e) / base, _cross(gap, d) / base
        meet = (np.abs(base) > 1e-12) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
        crossing = np.where(meet[..., None], p[:, :, None, :] + s[..., None] * d, 0.0)
    points = np.concatenate([p, q, crossing.reshape(n, 16, 2)], 1)
    there = np.concatenate([within(p, q), within(q, p), meet.reshape(n, 16)], 1)
    count = there.sum(1)
    middle = (points * there[..., None]).sum(1) / np.maximum(count, 1)[:, None]
    turn = np.where(there, np.arctan2(points[..., 1] - middle[:, None, 1], points[..., 0] - middle[:, None, 0]), np.inf)
    order = np.argsort(turn, axis=1)
    ring = np.take_along_axis(points, order[..., None], 1) - middle[:, None, :]
    ring = np.where(np.take_along_axis(there, order, 1)[..., None], ring, ring[:, :1, :])  # the rest closes the ring
    return np.where(count > 2, np.abs(_cross(ring, np.roll(ring, -1, 1)).sum(1)) / 2, 0.0)


def rotated_iou(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Overlaps of one box with others; those whose circles do not meet have none."""
    out = np.zeros(len(boxes))
    reach = np.hypot(box[2], box[3]) / 2 + np.hypot(boxes[:, 2], boxes[:, 3]) / 2
    solid = (boxes[:, 2:4] > 0).all(1) & (box[2:4] > 0).all()
    near = np.flatnonzero(solid & (np.hypot(boxes[:, 0] - box[0], boxes[:, 1] - box[1]) < reach))
    if len(near):
        both = _common_area(corners(box[None])[0], corners(boxes[near]))
        total = box[2] * box[3] + boxes[near, 2] * boxes[near, 3] - both
        out[near] = np.divide(both, total, out=np.zeros(len(near)), where=total > 0)
    return out


def rotated_suppression(df: DataFrame, by: list[str], threshold: float, score: str = "score", ties: list[str] = ()) -> DataFrame:
    """Greedy suppression of rotated boxes in each group (image, or image and class), highest score first."""

    def keep(*values: np.ndarray) -> np.ndarray:
        boxes = np.stack(values, axis=1).astype(float)
        if threshold >= 0 and len(boxes) <= matching.SQUARE:
            return matching.first_come(_beyond(boxes, threshold))
        order, kept = np.arange(len(boxes)), []
        while len(order):
            kept.append(order[0])
            order = order[1:][rotated_iou(boxes[order[0]], boxes[order[1:]]) <= threshold]
        return np.array(kept, int)

    return matching.pick(df, by, [*matching.falling(score), *map(F.asc_nulls_last, ties)], ["cx", "cy", "w", "h", "angle"], keep)


def _beyond(boxes: np.ndarray, threshold: float) -> np.ndarray:
    """For each box and each one after it whether they overlap by more than the threshold, which is 0 or more.

    The boxes share no more than their upright frames do, nor more than the smaller one holds; only pairs whose overlap can pass by that are cut exactly.
    """
    solid = (boxes[:, 2:4] > 0).all(1)
    at = corners(boxes)
    low, high, area = at.min(1), at.max(1), boxes[:, 2] * boxes[:, 3]
    frame = np.maximum(np.minimum(high[:, None], high[None]) - np.maximum(low[:, None], low[None]), 0).prod(2)
    most = np.minimum(frame, np.minimum(area[:, None], area[None])) * (1 + 1e-6)
    total = area[:, None] + area[None]
    first, second = np.nonzero(np.triu(solid[:, None] & solid[None] & ~(most <= threshold * (total - most)), 1))
    beyond = np.zeros(frame.shape, bool)
    step = 65_536
    for k in range(0, len(first), step):
        i, j = first[k : k + step], second[k : k + step]
        both = _common_area(at[i], at[j])
        rest = total[i, j] - both
        beyond[i, j] = ~(np.divide(both, rest, out=np.zeros(len(i)), where=rest > 0) <= threshold)
    return beyond


def encode(source: list[Column], target: list[Column], weights=(1.0, 1.0, 1.0, 1.0, 1.0)) -> list[Column]:
    """dx, dy, dw, dh, da of (cx, cy, w, h, angle) columns; the angle is in radians, by the shorter way."""
    made = [(target[0] - source[0]) / source[2], (target[1] - source[1]) / source[3], F.log(target[2] / source[2]), F.log(target[3] / source[3]), wrap_angle(target[4] - source[4]) * pi / 180]
    return [(w * d).alias(n) for n, w, d in zip(("dx", "dy", "dw", "dh", "da"), weights, made)]


def decode(source: list[Column], deltas: list[Column], weights=(1.0, 1.0, 1.0, 1.0, 1.0)) -> list[Column]:
    dx, dy, dw, dh, da = (d / w for d, w in zip(deltas, weights))
    limit = lambda v: F.least(v, F.lit(SCALE_CLAMP))
    made = [dx * source[2] + source[0], dy * source[3] + source[1], F.exp(limit(dw)) * source[2], F.exp(limit(dh)) * source[3], wrap_angle(da * 180 / pi + source[4])]
    return [v.alias(n) for n, v in zip(("cx", "cy", "w", "h", "angle"), made)]


def clip_level(box: list[Column], width: float, height: float, limit: float = 1.0) -> list[Column]:
    """Boxes within ``limit`` degrees of level are cut at the image, others stay."""
    cx, cy, w, h, angle = box[0], box[1], box[2], box[3], wrap_angle(box[4])
    level = F.abs(angle) <= limit
    edge = lambda v, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), v))
    x0, x1, y0, y1 = edge(cx - w / 2, width), edge(cx + w / 2, width), edge(cy - h / 2, height), edge(cy + h / 2, height)
    made = [(x0 + x1) / 2, (y0 + y1) / 2, F.least(w, x1 - x0), F.least(h, y1 - y0)]
    return [F.when(level, m).otherwise(o).alias(n) for n, m, o in zip(("cx", "cy", "w", "h"), made, (cx, cy, w, h))] + [angle.alias("angle")]
