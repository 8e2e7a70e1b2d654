"""Tracks through the frames of a video: each known instance claims the instance of the next frame that it overlaps most.

A step needs the known instances and one frame, so a video passes through a task frame by frame, whatever its length; videos are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BOX_OVERLAP, MASK_OVERLAP, KEEP = 0.6, 0.5, 8
FEW = 128  # pairs of boxes that are compared without arrays

COLUMNS = ["video", "frame", "det_id", "label", "x0", "y0", "x1", "y1", "pixels"]


class Instance(NamedTuple):
    track: int | None
    label: int
    left: int  # frames that it may still miss
    box: tuple[float, float, float, float] | None
    pixels: tuple[int, ...] | None


def _box_overlaps(old: list[Instance], new: list[Instance]) -> np.ndarray:
    blank = (np.nan,) * 4
    a, b = (np.array([i.box or blank for i in some], float).reshape(-1, 4) for some in (old, new))
    sides = np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2])
    both = np.clip(sides, 0, None).prod(2)
    area = lambda c: (c[:, 2] - c[:, 0]) * (c[:, 3] - c[:, 1])
    union = area(a)[:, None] + area(b)[None] - both
    return np.nan_to_num(np.divide(both, union, out=np.zeros_like(both), where=both > 0))


def _mask_overlaps(old: list[Instance], new: list[Instance]) -> np.ndarray:
    a, b = ([np.unique(np.array(i.pixels or (), np.int64)) for i in some] for some in (old, new))
    both = np.array([[len(np.intersect1d(p, q, assume_unique=True)) for q in b] for p in a], float).reshape(len(a), len(b))
    union = np.array([len(p) for p in a], float)[:, None] + np.array([len(q) for q in b], float)[None] - both
    return np.divide(both, union, out=np.zeros_like(both), where=both > 0)


def _best(known: list[Instance], frame: list[Instance], boxes: bool) -> list[tuple[int, float]]:
    """For each known instance the first of those of the frame that it overlaps most, and the overlap."""
    overlaps = (_box_overlaps if boxes else _mask_overlaps)(known, frame)
    overlaps[np.array([o.label for o in known])[:, None] != np.array([n.label for n in frame])] = 0.0
    return list(zip(overlaps.argmax(1).tolist(), overlaps.max(1).tolist()))


def _best_boxes(known: list[Instance], frame: list[Instance], boxes: bool = True) -> list[tuple[int, float]]:
    """As ``_best`` for boxes; arrays cost more than they save where there are few pairs."""
    made = []
    for old in known:
        best, most = 0, 0.0
        if old.box is not None:
            a0, b0, a1, b1 = old.box
            for i, new in enumerate(frame):
                if new.label != old.label or new.box is None:
                    continue
                x0, y0, x1, y1 = new.box
                w, h = (a1 if a1 < x1 else x1) - (a0 if a0 > x0 else x0), (b1 if b1 < y1 else y1) - (b0 if b0 > y0 else y0)
                if w > 0 and h > 0:
                    both = w * h
                    union = (a1 - a0) * (b1 - b0) + (x1 - x0) * (y1 - y0) - both
                    if union and both / union > most:
                        best, most = i, both / union
        made.append((best, most))
    return made


def follow(known: list[Instance], following: int, frame: list[Instance], keep: int = KEEP) -> tuple[list[Instance], list[int], int]:
    """The instances known after ``frame``, the tracks of its instances and the next free number.

    Known instances claim in their order: the instance of the frame with the same label that they overlap most (the first of equal ones), if by more than the threshold.
    One whose choice is too far or claimed already has no second choice; it is kept for ``keep`` - 1 frames. Boxes decide unless the
    first instance of the frame has none; then pixels do.
    """
    boxes = frame[0].box is not None
    least = BOX_OVERLAP if boxes else MASK_OVERLAP
    tracks: list[int | None] = [None] * len(frame)
    missed = []
    if known:
        for old, (best, most) in zip(known, (_best_boxes if boxes and len(known) * len(frame) <= FEW else _best)(known, frame, boxes)):
            if most > least and tracks[best] is None:
                tracks[best] = old.track
            elif old.left > 1:
                missed.append(Instance(old.track, old.label, old.left - 1, old.box, old.pixels))
    for i, track in enumerate(tracks):
        if track is None:
            tracks[i], following = following, following + 1
    return [Instance(t, n.label, keep, n.box, n.pixels) for n, t in zip(frame, tracks)] + missed, tracks, following


def instances(rows: pd.DataFrame) -> list[Instance]:
    """The rows as instances, in their order."""
    pixels = rows["pixels"] if "pixels" in rows else [None] * len(rows)
    boxes = zip(*[rows[c].astype(float).tolist() for c in ("x0", "y0", "x1", "y1")])
    return [Instance(None, int(k), 0, None if b[0] != b[0] else b, None if p is None else tuple(map(int, p))) for k, b, p in zip(rows["label"].tolist(), boxes, pixels)]


def track(detections: DataFrame, keep: int = KEEP) -> DataFrame:
    """(video, frame, det_id, track) of detections (video, frame, det_id, label, x0, y0, x1, y1 and, if there, pixels: array<long>).

    Tracks are numbered from 0 in each video. det_id names a detection within its frame and orders it. Frames without detections do not count as missed.
    Boxes that are null have no overlap, and a frame whose first box is null goes by pixels.
    """
    columns = [c for c in COLUMNS if c in detections.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known, following, held = None, [], 0, None
        for batch in chain(batches, [None]):
            rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            video, frame = rows["video"].to_numpy(), rows["frame"].to_numpy()
            cuts = np.flatnonzero((video[1:] != video[:-1]) | (frame[1:] != frame[:-1])) + 1
            end = len(rows) if batch is None else int(cuts[-1]) if len(cuts) else 0  # the last frame may go on in the next batch
            held = rows.iloc[end:]
            found, made = instances(rows.iloc[:end]), []
            for a, b in pairwise([0, *[c for c in cuts.tolist() if c < end], end] if end else []):
                if video[a] != now:
                    now, known, following = video[a], [], 0
                known, tracks, following = follow(known, following, found[a:b], keep)
                made += tracks
            yield rows.iloc[:end][["video", "frame", "det_id"]].assign(track=made)

    tasks = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as small rows would be put into one task
    kinds = {f.name: f.dataType.simpleString() for f in detections.schema}
    dealt = detections.select(*columns).filter("video IS NOT NULL AND frame IS NOT NULL").repartition(tasks, "video").sortWithinPartitions("video", "frame", "det_id")
    return dealt.mapInPandas(run, f"video {kinds['video']}, frame {kinds['frame']}, det_id {kinds['det_id']}, track long")
