"""Structured Streaming forms: metric storage with smoothing, counters and trackers with keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.operators.tracking import KEEP, Instance, follow, instances


def smoothed_stream(metrics: DataFrame, window: int = 20) -> DataFrame:
    """(name, iter, value) as they come, with the median of the last ``window`` values of each name."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        for batch in batches:
            rows = batch.sort_values("iter", kind="stable")
            made = []
            for value in rows["value"]:
                past = [*past, float(value)][-window:]
                made.append(median(past))
            yield pd.DataFrame({"name": key[0], "iter": rows["iter"].to_numpy(), "value": rows["value"].to_numpy(), "smoothed": made})
        state.update((past,))

    return metrics.groupBy("name").applyInPandasWithState(run, "name string, iter long, value double, smoothed double", "past array<double>", "append", GroupStateTimeout.NoTimeout)


def counter_stream(ticks: DataFrame, start: int, step: int, limit: int) -> DataFrame:
    """(key, reset) ticks to (key, value, done, progress, remaining); a tick after the limit stays there."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else start
        for batch in batches:
            out = []
            for reset in batch["reset"]:
                now = start if reset else now
                done = now > limit
                out.append((key[0], min(now, limit), done, min(1.0, now / max(limit, 1)), max(0, limit - now + 1)))
                now += 0 if done else step
            yield pd.DataFrame(out, columns=["key", "value", "done", "progress", "remaining"])
        state.update((now,))

    return ticks.groupBy("key").applyInPandasWithState(run, "key string, value long, done boolean, progress double, remaining long", "now long", "append", GroupStateTimeout.NoTimeout)


def track_stream(detections: DataFrame, keep: int = KEEP) -> DataFrame:
    """``tracking.track`` on a stream: (video string, frame, det_id, label, x0..y1 and, if there, pixels) to (video, frame, det_id, track).

    The rows of a frame have to come in one trigger, and frames in their order; the state of a video is what it knows after its last frame.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, following = [], 0
        if state.exists:
            known, following = [Instance(t[0], t[1], t[2], None if t[3] is None else tuple(t[3]), None if t[4] is None else tuple(t[4])) for t in state.get[0]], state.get[1]
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["frame", "det_id"], kind="stable")
        made = []
        for _, frame in rows.groupby("frame"):
            known, tracks, following = follow(known, following, instances(frame), keep)
            made.append(frame[["frame", "det_id"]].assign(video=key[0], track=tracks))
        state.update(([(i.track, i.label, i.left, None if i.box is None else list(i.box), None if i.pixels is None else list(i.pixels)) for i in known], following))
        yield pd.concat(made, ignore_index=True)[["video", "frame", "det_id", "track"]]

    kind = "known array<struct<track: bigint, label: bigint, left: bigint, box: array<double>, pixels: array<bigint>>>, following bigint"
    return detections.groupBy("video").applyInPandasWithState(run, "video string, frame long, det_id long, track long", kind, "append", GroupStateTimeout.NoTimeout)


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by time window and type, with a watermark for late rows (an extension)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
