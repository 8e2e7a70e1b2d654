"""Matching of detections with truths as the two usual evaluations define it, box recall, and suppression of groups of any size.

Detections carry det_id, score and x0..y1, truths gt_id, x0..y1 and flags; ``by`` names image and category.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from brindle.functions.geometry import Box, iou
from brindle.operators import matching, metrics
from brindle.session import checkpointed

EPSILON = 2.0**-52
CORNERS = ("x0", "y0", "x1", "y1")


def coverage(boxes: np.ndarray, truths: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    """Overlap of boxes with truths: by the union, or by the box's own area where the truth is a crowd."""
    w = np.minimum(boxes[..., 2], truths[..., 2]) - np.maximum(boxes[..., 0], truths[..., 0])
    h = np.minimum(boxes[..., 3], truths[..., 3]) - np.maximum(boxes[..., 1], truths[..., 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    own = (boxes[..., 2] - boxes[..., 0]) * (boxes[..., 3] - boxes[..., 1])
    whole = np.where(crowd, own, own + (truths[..., 2] - truths[..., 0]) * (truths[..., 3] - truths[..., 1]) - both)
    return np.divide(both, whole, out=np.zeros(both.shape), where=both > 0)


def coco_matches(detections: DataFrame, truths: DataFrame, by: list[str], thresholds: list[float], areas: dict[str, tuple[float, float]], most: int, ties: list[str] = ("det_id",), held: bool = False) -> DataFrame:
    """by, det_id, score, place (from 1, within the group), area, threshold, gt_id (null if none), ignored; at most ``most`` detections of a group.

    Truths have area, crowd and ignore (both may be null: false). A truth is ignored where its flags or its area say so, a detection where its truth is, or where it has none and
    its own area is outside the range. One pass over a group makes all thresholds and ranges. ``held`` keeps its result, a row for each detection, in a checkpoint, for callers that read it more than once.
    """
    shown = lambda df, own: df.select(*dict.fromkeys([*by, *own, *CORNERS]))
    both = matching.together(shown(detections, ["det_id", "score", *ties]), shown(truths, ["gt_id", "area", "crowd", "ignore"]))
    return coco_matches_of(both, by, thresholds, areas, most, ties, held)


def coco_matches_of(rows: DataFrame, by: list[str], thresholds: list[float], areas: dict[str, tuple[float, float]], most: int, ties: list[str] = ("det_id",), held: bool = False) -> DataFrame:
    """As ``coco_matches``, with both sides in one table (see ``matching.together``).

    A detection prefers truths that count to ignored ones, then the greatest overlap, then the later truth; a truth is taken once, a crowd any number of times.
    """
    made = _coco(rows, by, thresholds, areas, most, ties)
    made = checkpointed(made) if held else made
    pairs = F.array(*[F.struct(F.lit(a).alias("area"), F.lit(float(t)).alias("threshold")) for a in areas for t in thresholds])
    each = F.arrays_zip(pairs.alias("o"), F.col("matched").alias("m"), F.col("ignored").alias("i"))
    return made.select(*by, "det_id", "score", "place", F.explode(each).alias("x")).select(*by, "det_id", "score", "place", "x.o.area", "x.o.threshold", F.col("x.m").alias("gt_id"), F.col("x.i").alias("ignored"))


def _coco(rows: DataFrame, by: list[str], thresholds: list[float], areas: dict[str, tuple[float, float]], most: int, ties: list[str]) -> DataFrame:
    """by, det_id, score, place and the arrays matched and ignored, with an entry for each threshold of each range."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    limits = np.array(list(areas.values()), float)
    levels = np.minimum(np.array(thresholds, float), 1 - 1e-10)
    options = [(a, t) for a in range(len(limits)) for t in range(len(levels))]
    names = [*by, "det_id", "score", "place", "matched", "ignored"]

    def run(table: pa.Table, cuts: list[int], begins: np.ndarray) -> pa.Table:
        n, is_truth = table.num_rows, table.column("truth").to_numpy()
        place = np.arange(n) - np.repeat(begins, np.diff(cuts)) + 1
        first = np.flatnonzero(is_truth | (place <= most))
        table, place, is_truth = table.take(pa.array(first)), place[first], is_truth[first]
        at = np.searchsorted(first, cuts).tolist()
        boxes, n = matching.corners(table), len(first)
        crowd, ignore = table.column("crowd").to_numpy(), table.column("ignore").to_numpy()
        area = np.where(is_truth, table.column("area").to_numpy(), (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]))
        ignored = (area < limits[:, :1]) | (area > limits[:, 1:]) | (is_truth & (ignore | crowd))
        goal, free = np.full((len(options), n), -1), np.ones((len(options), n), bool)

        def blocks():
            for (start, end), begin in zip(zip(at, at[1:]), np.searchsorted(first, begins).tolist()):
                overlaps = lambda a, b, c=crowd[start:begin]: coverage(a, b, c)
                for d, t, over in matching.overlap_blocks(boxes, [start, end], np.array([begin]), overlaps):
                    over[over <= 0] = -1.0
                    yield d, t, over

        for detection, truth, over in matching.links(blocks(), max(levels.min(), 0.0), later=True):
            for a in range(len(limits)):
                out = ignored[a, truth]
                order = np.argsort(2 * detection + out, kind="stable")
                d, t, v = detection[order], truth[order], over[order]
                for k, (area_, level) in enumerate(options):
                    if area_ == a:
                        enough = np.flatnonzero(v >= levels[level])
                        got = enough[matching.taken(d[enough], t[enough], free[k], crowd)]
                        goal[k, d[got]] = t[got]
                        free[k, t[got]] = crowd[t[got]]
        mine = np.flatnonzero(~is_truth)
        goal = goal[:, mine]
        aside = np.stack([np.where(goal[k] < 0, ignored[a, mine], ignored[a, goal[k]]) for k, (a, _) in enumerate(options)])
        flat = goal.T.ravel()
        gt = table.column("gt_id").combine_chunks().take(pa.array(flat, mask=flat < 0))
        ends = pa.array(np.arange(len(mine) + 1) * len(options), pa.int32())
        found = table.take(pa.array(mine))
        columns = [*(found.column(c) for c in (*by, "det_id", "score")), pa.array(place[mine], pa.int32()), pa.ListArray.from_arrays(ends, gt), pa.ListArray.from_arrays(ends, pa.array(aside.T.ravel()))]
        return pa.table(columns, names=names)

    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    shown = rows.select(*by, "truth", *[F.col(c).cast("long").alias(c) for c in ("det_id", "gt_id")], *[F.col(c).cast("double").alias(c) for c in ("score", *CORNERS, "area")], no("crowd"), no("ignore"), *[c for c in ties if c not in (*by, "det_id", "score")])
    return matching.in_groups(shown, by, [F.desc("score"), *ties], run, f"{kinds}, det_id long, score double, place int, matched array<long>, ignored array<boolean>")


def coco_positives(truths: DataFrame, category: str, areas: dict[str, tuple[float, float]]) -> DataFrame:
    """category, area, positives: the truths that count; every pair of a category of the truths and a range has a row."""
    flags = F.coalesce(F.col("crowd"), F.lit(False)) | F.coalesce(F.col("ignore"), F.lit(False))
    options = F.array(*[F.struct(F.lit(a).alias("area"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for a, (lo, hi) in areas.items()])
    wide = truths.select(category, F.col("area").cast("double").alias("__area"), flags.alias("__out"), F.explode(options).alias("o"))
    return wide.groupBy(category, F.col("o.area").alias("area")).agg(F.count_if(~F.col("__out") & F.col("__area").between(F.col("o.lo"), F.col("o.hi"))).alias("positives"))


def coco_evaluation(detections: DataFrame, truths: DataFrame, image: str, category: str, thresholds: list[float], areas: dict[str, tuple[float, float]], limits: list[int], levels: int = 101, ties: list[str] = ("det_id",)) -> tuple[DataFrame, DataFrame]:
    """Precision at recall levels and final recall by threshold, category, area and limit, from the matches; see ``metrics.accumulate_codes``.

    The matches are made once; a row for each detection, with a small number for each threshold of each range, lies in a checkpoint.
    """
    shown = lambda df, own: df.select(*dict.fromkeys([image, category, *own, *CORNERS]))
    both = matching.together(shown(detections, ["det_id", "score", *ties]), shown(truths, ["gt_id", "area", "crowd", "ignore"]))
    code = F.zip_with("matched", "ignored", lambda gt, aside: F.when(aside, 0).when(gt.isNotNull(), 1).otherwise(2).cast("tinyint"))
    made = checkpointed(_coco(both, [image, category], thresholds, areas, max(limits), ties).select(image, category, "score", "place", code.alias("codes")))
    pairs = [(a, t) for a in areas for t in thresholds]
    options = [{"threshold": float(t), "area": a, "limit": m} for a, t in pairs for m in limits]
    codes = [F.when(F.col("place") <= m, F.get("codes", F.lit(i))) for i in range(len(pairs)) for m in limits]
    return metrics.accumulate_codes(made, coco_positives(truths, category, areas), category, options, codes, "score", [image, "place"], levels)


def voc_marks(detections: DataFrame, truths: DataFrame, by: list[str], thresholds: list[float], ties: list[str] = ("det_id",)) -> DataFrame:
    """by, det_id, score and the arrays tp and fp with one entry for each threshold; no loop.

    A detection looks at the truth that it overlaps most (inclusive pixels, the first of equal ones), taken or not. Beyond the threshold, the best detection
    of a truth is right and later ones wrong; one on a difficult truth counts neither way; any other detection is wrong.
    """
    shown = lambda df, own: df.select(*dict.fromkeys([*by, *own, *CORNERS]))
    return voc_marks_of(matching.together(shown(detections, ["det_id", "score", *ties]), shown(truths, ["gt_id", "difficult"])), by, thresholds, ties)


def _voc(rows: DataFrame, by: list[str], thresholds: list[float], ties: list[str], counting: bool) -> DataFrame:
    """by, det_id, score, ties and code: for each threshold 1 (right), 2 (wrong) or 0. With ``counting``, detections that count nowhere are left out, and each group
    with truths has a row more, with the number of those that are not difficult (``goals``)."""
    names = list(dict.fromkeys([*by, "det_id", "score", *ties]))
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*names).schema}

    def run(table: pa.Table, cuts: list[int], begins: np.ndarray) -> pa.Table:
        n, boxes = table.num_rows, matching.corners(table)
        known = np.logical_and.reduce([table.column(c).is_valid().to_numpy() for c in by])[cuts[:-1]]  # no group of a null meets
        goal, most = np.full(n, -1), np.zeros(n)
        for a, start, over in matching.overlap_blocks(boxes, cuts, np.where(known, begins, cuts[:-1]), lambda a, b: matching._overlaps(a, b, 1.0)):
            best = over.argmax(1)
            v = over[np.arange(len(over)), best]
            most[a : a + len(over)], goal[a : a + len(over)] = v, np.where(v > 0, best + start, -1)
        is_truth, hard = table.column("truth").to_numpy(), table.column("difficult").to_numpy()
        mine = np.flatnonzero(~is_truth)
        goal, most = goal[mine], most[mine]
        there, hard_one = goal >= 0, np.where(goal >= 0, hard[goal], False)
        codes = np.full((len(mine), len(thresholds)), 2, np.int8)
        for k, t in enumerate(thresholds):
            beyond = np.flatnonzero(there & (most > t))
            first = np.zeros(len(mine), bool)
            first[beyond[np.unique(goal[beyond], return_index=True)[1]]] = True
            codes[beyond, k] = np.where(hard_one[beyond], 0, np.where(first[beyond], 1, 2))
        if not counting:
            return _coded(table.take(pa.array(mine)).select(names), codes)
        some = codes.any(1)
        heads = np.array(cuts[:-1])[begins > cuts[:-1]]
        counts = np.add.reduceat((is_truth & ~hard).astype(np.int64), cuts[:-1])[begins > cuts[:-1]]
        found = _coded(table.take(pa.array(mine[some])).select(names), codes[some]).append_column("goals", pa.nulls(int(some.sum()), pa.int64()))
        own = table.take(pa.array(heads)).select(names)
        for name in (c for c in names if c not in by):
            own = own.set_column(own.schema.get_field_index(name), table.schema.field(name), pa.nulls(len(heads), table.schema.field(name).type))
        return pa.concat_tables([found, _coded(own, np.zeros((len(heads), len(thresholds)), np.int8)).append_column("goals", pa.array(counts))])

    hard = F.coalesce(F.col("difficult"), F.lit(False)).alias("difficult")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", code array<tinyint>" + (", goals long" if counting else "")
    return matching.in_groups(rows.select(*names, "truth", "gt_id", hard, *CORNERS), by, [F.desc("score"), *ties], run, schema)


def _coded(table: pa.Table, codes: np.ndarray) -> pa.Table:
    ends = pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32())
    return table.append_column("code", pa.ListArray.from_arrays(ends, pa.array(codes.ravel())))


def voc_marks_of(rows: DataFrame, by: list[str], thresholds: list[float], ties: list[str] = ("det_id",)) -> DataFrame:
    """As ``voc_marks``, with both sides in one table (see ``matching.together``)."""
    is_ = lambda v: F.transform("code", lambda c: c == v)
    return _voc(rows, by, thresholds, ties, False).withColumns({"tp": is_(1), "fp": is_(2)}).drop("code")


def voc_average_precision(detections: DataFrame, truths: DataFrame, image: str, category: str, thresholds: list[float], points: int | None = None, ties: list[str] = ("det_id",)) -> DataFrame:
    """category, threshold, ap: the area under the precision envelope, or its mean at ``points`` recall levels. One sort makes all thresholds."""
    shown = lambda df, own: df.select(*dict.fromkeys([image, category, *own, *CORNERS]))
    return voc_average_precision_of(matching.together(shown(detections, ["det_id", "score", *ties]), shown(truths, ["gt_id", "difficult"])), image, category, thresholds, points, ties)


def voc_average_precision_of(rows: DataFrame, image: str, category: str, thresholds: list[float], points: int | None = None, ties: list[str] = ("det_id",)) -> DataFrame:
    """As ``voc_average_precision``, with both sides in one table (see ``matching.together``).

    The marks are dealt to sorted ranges, which lie in a checkpoint, and are read as streams from there on. A category that spans ranges takes what the ranges before it
    counted, and the greatest precision of those after it; these are at most two rows for each range, which the driver passes on.
    """
    each = range(len(thresholds))
    order = [category, F.desc("score"), image, *ties]
    marks = _voc(rows, [image, category], thresholds, ties, True)
    ranged = checkpointed(marks.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(category).alias("category"), "code", "goals", F.spark_partition_id().alias("p")))
    counts = [F.count_if(F.get("code", F.lit(k)) == v).alias(f"n{v}_{k}") for v in (1, 2) for k in each]
    totals = ranged.groupBy("category", "p").agg(F.sum("goals").alias("goals"), *counts)
    whole = Window.partitionBy("category")
    before = whole.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.array(*[F.coalesce(F.sum(f"n{v}_{k}").over(before), F.lit(0)) for v in (1, 2) for k in each])
    spans = totals.select("p", F.min("p").over(whole).alias("chain"), (F.max("p").over(whole) > F.min("p").over(whole)).alias("spans"), F.sum("goals").over(whole).alias("goals"), starts.alias("starts"))
    known = {(r.p, r.p > r.chain): r for r in spans.filter("spans").collect()}
    kind = f"p int, later boolean, category {ranged.schema['category'].dataType.simpleString()}, goals long, tops array<double>, made array<double>"
    steps = [i * (1 / (points - 1)) for i in range(points)] if points is not None else []

    def through(after: dict | None):
        """A row for each category of a range; without ``after`` only of those that span ranges."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches, schema=shape)
            if not table.num_rows:
                return
            p = table.column("p")[0].as_py()
            if after is None and not {(p, False), (p, True)} & set(known):
                return
            codes = table.column("code").combine_chunks().flatten().to_numpy().reshape(-1, len(thresholds))
            kinds = table.column("category").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
            goals = table.column("goals").combine_chunks()
            out = []
            for a, b in pairwise(cuts):
                key = (p, True) if a == 0 and (p, True) in known else (p, False) if b == len(kinds) and (p, False) in known else None
                if after is None and key is None:
                    continue
                n = pc.sum(goals.slice(a, b - a)).as_py() if key is None else known[key].goals
                begun = known[key].starts if key else [0] * (2 * len(thresholds))
                later = after[key] if after and key else [0.0] * len(thresholds)
                tops, made = [], []
                for k in each:
                    hits = np.flatnonzero(codes[a:b, k] == 1)
                    right = begun[k] + np.arange(1, len(hits) + 1)
                    wrong = begun[len(thresholds) + k] + np.cumsum(codes[a:b, k] == 2)[hits]
                    best = np.maximum(np.maximum.accumulate((right / np.maximum(right + wrong, EPSILON))[::-1])[::-1], later[k])
                    tops.append(float(best.max(initial=0.0)))
                    if points is None:
                        made.append(float((best / max(n or 0, 1)).sum()))
                    else:
                        made += [float(best[right / max(n or 0, 1) >= s].max(initial=0.0)) for s in steps]
                out.append((p, bool(key and key[1]), a, n, tops, made))
            if out:
                firsts = table.column("category").take(pa.array([o[2] for o in out]))
                column = lambda i, t: pa.array([o[i] for o in out], t)
                yield from pa.table([column(0, pa.int32()), column(1, pa.bool_()), firsts, column(3, pa.int64()), column(4, pa.list_(pa.float64())), column(5, pa.list_(pa.float64()))], names=["p", "later", "category", "goals", "tops", "made"]).combine_chunks().to_batches()

        shape = to_arrow_schema(ranged.schema)
        return ranged.mapInArrow(run, kind)

    after = {}
    tops = {(r.p, r.later): r.tops for r in through(None).select("p", "later", "tops").collect()} if known else {}
    chains: dict[int, list[float]] = {}
    for key in sorted(tops, reverse=True):
        chain = known[key].chain
        after[key] = chains.get(chain, [0.0] * len(thresholds))
        chains[chain] = [max(x, y) for x, y in zip(after[key], tops[key])]
    full = through(after).filter("goals IS NOT NULL")
    if points is None:
        made = full.groupBy("category").agg(F.array(*[F.sum(F.get("made", F.lit(k))) for k in each]).alias("ap"))
    else:
        most = full.groupBy("category").agg(F.array(*[F.max(F.get("made", F.lit(k))) for k in range(points * len(thresholds))]).alias("tops"))
        mean = lambda k: F.aggregate(F.slice("tops", k * points + 1, points), F.lit(0.0), lambda a, b: a + b) / points
        made = most.select("category", F.array(*map(mean, each)).alias("ap"))
    out = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.get("ap", F.lit(k)).alias("ap")) for k, t in enumerate(thresholds)])
    return made.select(F.col("category").alias(category), F.explode(out).alias("x")).select(category, "x.threshold", "x.ap")


def box_recall(proposals: DataFrame, truths: DataFrame, image: str, areas: dict[str, tuple[float, float]], limits: list[int], thresholds: list[float], ties: list[str] = ("det_id",)) -> DataFrame:
    """area, limit, positives, ar: of each image's best proposals, pairs are taken by falling overlap, each end once; the share of truths that
    are covered, averaged over the thresholds. Crowds do not count, nor images without proposals."""
    shown = lambda df, own: df.select(*dict.fromkeys([image, *own, *CORNERS]))
    return box_recall_of(matching.together(shown(proposals, ["det_id", "score", *ties]), shown(truths, ["gt_id", "area", "crowd"])), image, areas, limits, thresholds, ties)


def box_recall_of(rows: DataFrame, image: str, areas: dict[str, tuple[float, float]], limits: list[int], thresholds: list[float], ties: list[str] = ("det_id",), goals: list[str] = ("gt_id",)) -> DataFrame:
    """As ``box_recall``, with both sides in one table (see ``matching.together``); ``goals`` name and order the truths of an image.

    Pairs below the least threshold come after all others and cover nothing, so they are left out.
    """
    options = [(k, a, m) for k, a in enumerate(areas) for m in limits]
    cuts_of, least = np.array(list(areas.values()), float), max(min(thresholds), 0.0)

    def run(table: pa.Table, cuts: list[int], begins: np.ndarray) -> pa.Table:
        boxes, area, known = matching.corners(table), table.column("area").to_numpy(), table.column(image).is_valid().to_numpy()
        inside = (area >= cuts_of[:, :1]) & (area <= cuts_of[:, 1:]) & ~table.column("crowd").to_numpy()
        positives, hits = np.zeros(len(options), np.int64), np.zeros(len(options), np.int64)
        for (start, end), begin in zip(pairwise(cuts), begins.tolist()):
            if not (start < begin < end and known[start]):
                continue
            counts, last, found = inside[:, start:begin].sum(1), min(end, begin + max(limits)), []
            for d, t, over in matching.overlap_blocks(boxes, [start, last], np.array([begin]), lambda a, b: matching._overlaps(a, b, 0.0)):
                i, j = np.nonzero((over > 0) & (over >= least))
                found.append((over[i, j], i + d - begin, j + t))
            v, i, j = map(np.concatenate, zip(*found))
            order = np.lexsort((i, j, -v))
            v, i, j = v[order], i[order], j[order]
            for o, (k, _, m) in enumerate(options):
                positives[o] += counts[k]
                own = np.flatnonzero(inside[k, j] & (i < m))
                got = v[own[matching.falling_ends(i[own], j[own])]]
                hits[o] += sum(int((got >= t).sum()) for t in thresholds)
        return pa.table([pa.array([a for _, a, _ in options]), pa.array([m for *_, m in options], pa.int32()), pa.array(positives), pa.array(hits)], names=["area", "limit", "positives", "hits"])

    crowd = F.coalesce(F.col("crowd"), F.lit(False)).alias("crowd")
    shown = rows.select(*dict.fromkeys([image, "truth", "score", *ties, *goals]), F.col("area").cast("double").alias("area"), crowd, *CORNERS)
    made = matching.in_groups(shown, [image], [F.desc("score"), *ties], run, "area string, limit int, positives long, hits long", goals)
    sums = made.groupBy("area", "limit").agg(F.sum("positives").alias("positives"), F.sum("hits").alias("hits")).filter("positives > 0")
    return sums.select("area", "limit", "positives", (F.col("hits") / F.col("positives") / len(thresholds)).alias("ar"))


LARGE = 5_000  # boxes of a group that are compared at once
STREAMED = 1 << 16  # boxes of a group that one stream may read
MANY = 1 << 20  # pairs of a group that one stream may read


def suppress(df: DataFrame, by: list[str], threshold: float, key: str, score: str = "score", plus: float = 0.0, large: int = LARGE, streamed: int = STREAMED) -> DataFrame:
    """Greedy suppression with no bound on a group: groups of up to ``streamed`` boxes are read in order, up to ``large`` boxes at once, larger ones are decided in parallel.

    ``key`` is unique within a group and breaks ties of the score.
    """
    crowded = df.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > streamed).select(*by)
    if crowded.isEmpty():
        return suppress_in_order(df, by, threshold, key, score, plus, large)
    rest = suppress_in_order(df.join(crowded, by, "left_anti"), by, threshold, key, score, plus, large)
    return rest.unionByName(suppress_in_rounds(df.join(crowded, by, "left_semi"), by, threshold, key, score, plus))


def suppress_in_order(df: DataFrame, by: list[str], threshold: float, key: str, score: str = "score", plus: float = 0.0, large: int = LARGE) -> DataFrame:
    """The boxes that stay, from one shuffle by group and no table of pairs.

    A task reads its groups one after the other in the order of the boxes. Blocks of up to ``large`` boxes are compared with those of the group that stay so far, which is
    all that is held of a group, then with one another.
    """
    names = df.columns

    def stay(boxes: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """Places of the boxes that neither ``kept`` nor better boxes that stay remove."""
        n, step = len(kept), max(1, matching.COMPARED // len(boxes))
        if len(boxes) <= matching.SQUARE and n + len(boxes) <= step:
            over = ~(matching._overlaps(boxes[:, None], np.concatenate([kept, boxes])[None], plus) <= threshold)
            return matching.first_come(over[:, n:], over[:, :n].any(1))
        places = np.arange(len(boxes))
        for a in range(0, n, step):
            places = places[(matching._overlaps(boxes[places, None], kept[None, a : a + step], plus) <= threshold).all(1)]
        return places[matching.staying(boxes[places], threshold, plus)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = kept = np.zeros((0, 4))
        for batch in batches:
            table = pa.Table.from_batches([batch])
            boxes, firsts, places = matching.corners(table), table.column("__n").to_numpy() == 1, []
            cuts = sorted({0, *np.flatnonzero(firsts).tolist(), len(boxes)})
            for start, end in pairwise(cuts):
                kept = none if firsts[start] else kept
                for a in range(start, end, large):
                    own = a + stay(boxes[a : min(a + large, end)], kept)
                    kept = np.concatenate([kept, boxes[own]])
                    places.append(own)
            if places:
                yield from table.select(names).take(pa.array(np.concatenate(places))).combine_chunks().to_batches()

    order = [*matching.falling(score), F.asc_nulls_last(key)]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).mapInArrow(run, df.schema)


def suppress_in_rounds(df: DataFrame, by: list[str], threshold: float, key: str, score: str = "score", plus: float = 0.0, cell: float = 64.0, many: int = MANY) -> DataFrame:
    """The boxes that stay, without taking the boxes of a group into one task.

    Of equal boxes all but the best go at once, if the threshold is below 1: what removes the best removes the others too. Pairs of the rest beyond the threshold are found
    by grid cells and point from the better box to the other. A group with up to ``many`` such pairs is decided by one stream of them, in the order of the better box. In the
    other groups there are rounds: in each a box to which no pair points stays for good and removes those that it points to; pairs of
    decided boxes leave. The result is that of the greedy order, since a box waits for every better neighbour. Rounds lie in checkpoints; their number is the length of
    the longest chain of waiting, which for scores that do not follow places grows with the logarithm of the boxes.
    """
    source = checkpointed(df)
    rows = source.select(*by, F.struct((-F.col(score)).alias("s"), F.col(key).alias("k")).alias("__v"), *CORNERS)
    if threshold < 1:
        rows = rows.groupBy(*by, *CORNERS).agg(F.min("__v").alias("__v"))

    def cells(p: str) -> DataFrame:
        spread = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.greatest(F.col(lo), F.col(hi)) + plus) / cell))
        wide = rows.withColumn("cx", F.explode(spread("x0", "x1"))).withColumn("cy", F.explode(spread("y0", "y1")))
        return wide.select(*by, "cx", "cy", F.col("__v").alias(f"{p}v"), *[F.col(c).alias(f"{p}{c}") for c in CORNERS])

    met = cells("a_").join(cells("b_"), [*by, "cx", "cy"])
    corner = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("cy"))
    found = checkpointed(met.filter((iou(Box.of("a_"), Box.of("b_"), plus) > threshold) & (F.col("a_v") < F.col("b_v")) & corner).select(*by, "a_v", "b_v"))
    crowded = found.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > many).select(*by)
    pairs = checkpointed(found.join(crowded, by, "left_semi"))
    removed = _removed_in_order(found.join(crowded, by, "left_anti"), by)
    while not pairs.isEmpty():
        tops = pairs.select(*by, "a_v").distinct().join(pairs.select(*by, F.col("b_v").alias("a_v")).distinct(), [*by, "a_v"], "left_anti")
        gone = checkpointed(pairs.join(tops, [*by, "a_v"], "left_semi").select(*by, "b_v").distinct())
        removed = removed.unionByName(gone)
        left = pairs.join(gone, [*by, "b_v"], "left_anti").join(gone.withColumnRenamed("b_v", "a_v"), [*by, "a_v"], "left_anti")
        pairs = checkpointed(left)
    stay = rows.select(*by, "__v").join(removed.withColumnRenamed("b_v", "__v"), [*by, "__v"], "left_anti")
    return source.withColumn("__v", F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))).join(stay, [*by, "__v"], "left_semi").select(*df.columns)


def _removed_in_order(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, b_v) that go, where each a_v in turn, if it is still there, removes its b_v; what is known of a group is what has gone."""
    numbered = pairs.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("a_v", "b_v")))
    shown = numbered.select(*by, "b_v", "__n", F.col("a_v.k").alias("__a"), F.col("b_v.k").alias("__b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: set = set()
        for batch in batches:
            places = []
            for i, (n, a, b) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("__n", "__a", "__b")])):
                if n == 1:
                    gone = set()
                if a not in gone and b not in gone:
                    gone.add(b)
                    places.append(i)
            yield batch.select([*by, "b_v"]).take(pa.array(places, pa.int64()))

    return shown.mapInArrow(run, pairs.select(*by, "b_v").schema)
