"""Matching and suppression. Order-dependent loops run per group on Arrow batches; the rest are windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import checkpointed


def best_match(pairs: DataFrame, prediction: str, truth: str, low: float = 0.3, high: float = 0.5, rescue: bool = True) -> DataFrame:
    """Of (prediction, truth, iou) the best truth for each prediction with label 1 (>= high), -1 (between) or 0 (< low);
    ``rescue`` labels 1 every prediction that is the best, ties included, for some truth."""
    best = pairs.groupBy(prediction).agg(F.max_by(F.col(truth), F.struct("iou", -F.col(truth))).alias("match"), F.max("iou").alias("iou"))
    label = F.when(F.col("iou") >= high, 1).when(F.col("iou") < low, 0).otherwise(-1)
    if rescue:
        top = pairs.withColumn("r", F.rank().over(Window.partitionBy(truth).orderBy(F.desc("iou")))).filter("r = 1 AND iou > 0").select(prediction).distinct()
        best = best.join(top.withColumn("saved", F.lit(True)), prediction, "left")
        label = F.when(F.col("saved"), 1).otherwise(label)
    return best.withColumn("label", label).select(prediction, "match", "iou", "label")


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts the groups before their exchange too."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


def level_then_image_top_k(df: DataFrame, image: str, level: str, order: list, per_level: int, per_image: int) -> DataFrame:
    return top_k(top_k(df, [image, level], order, per_level), [image], order, per_image)


SQUARE = 512  # boxes of a group that are compared all at once


def falling(score: str) -> list:
    """An order by falling score with what is no number last."""
    return [F.coalesce(F.isnan(F.col(score).cast("double")), F.lit(True)), F.desc(score)]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups with the places where groups begin (``__n`` is 1) and the end; a group may span batches."""
    held: list[pa.Table] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            piece = pa.Table.from_batches([batch])
            starts = np.flatnonzero(piece.column("__n").to_numpy() == 1)
            end = int(starts[-1]) if len(starts) else piece.num_rows  # the last group may go on in the next batch
            held.append(piece.slice(0, end))
            if not len(starts):
                continue
        rows, held = pa.concat_tables(held) if held else None, [] if batch is None else [piece.slice(end)]
        if rows is not None and rows.num_rows:
            yield rows, [*np.flatnonzero(rows.column("__n").to_numpy() == 1).tolist(), rows.num_rows]


def pick(df: DataFrame, by: list[str], order: list, columns: list[str], keep: Callable[..., np.ndarray]) -> DataFrame:
    """The rows of each group at the places that ``keep`` returns for its ``columns``, which are arrays in ``order``.

    A task reads its groups one after the other from large batches, so that many small groups cost no call and no table each.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in whole_groups(batches):
            values = [rows.column(c).to_numpy() for c in columns]
            places = np.concatenate([a + keep(*[v[a:b] for v in values]) for a, b in pairwise(cuts)])
            yield from rows.select(names).take(pa.array(places)).combine_chunks().to_batches()

    numbered = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered.mapInArrow(run, df.schema)


CORNERS = ("x0", "y0", "x1", "y1")
COMPARED = 1 << 18  # pairs of boxes that are compared at once
LINKS = 1 << 20  # pairs that may match and are held at once


def together(detections: DataFrame, truths: DataFrame) -> DataFrame:
    """Both sides of a matching in one table, told apart by ``truth``. Who has both in one table spares one of two shuffles."""
    return detections.withColumn("truth", F.lit(False)).unionByName(truths.withColumn("truth", F.lit(True)), allowMissingColumns=True)


def in_groups(rows: DataFrame, by: list[str], order: list, run: Callable[[pa.Table, list[int], np.ndarray], pa.Table], schema: str, goals: list[str] = ("gt_id",)) -> DataFrame:
    """``run`` over tables of whole groups, in each of which the truths come first, by ``goals``, then the detections in ``order``.

    It gets such a table, the places where its groups begin (and the end), and for each group where its detections begin.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches):
            n = np.add.reduceat(table.column("truth").to_numpy().astype(np.int64), cuts[:-1])
            yield from run(table, cuts, np.array(cuts[:-1]) + n).combine_chunks().to_batches()

    window = Window.partitionBy(*by).orderBy(F.desc("truth"), *[F.when(F.col("truth"), F.col(c)).asc_nulls_last() for c in goals], *order)
    return rows.withColumn("__n", F.row_number().over(window)).mapInArrow(each, schema)


def corners(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(float) for c in CORNERS], axis=1)


def overlap_blocks(boxes: np.ndarray, cuts: list[int], begins: np.ndarray, overlaps: Callable) -> Iterator[tuple[int, int, np.ndarray]]:
    """(place of the first detection, of the first truth, overlaps) for blocks of detections with all truths of their group; groups without either have none."""
    for (start, end), begin in zip(pairwise(cuts), begins.tolist()):
        if start < begin < end:
            step = max(1, COMPARED // (begin - start))
            for a in range(begin, end, step):
                yield a, start, overlaps(boxes[a : min(a + step, end), None], boxes[None, start:begin])


def links(blocks: Iterator[tuple[int, int, np.ndarray]], least: float, strict: bool = False, later: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Detection, truth and overlap of the pairs from ``least`` on (``strict``: beyond it), by detection, then falling overlap; of equal ones the first truth leads, or the ``later``.

    They come in parts of about ``LINKS``, so that a large group is not held with all its pairs; a detection lies in one part.
    """
    found, n = [], 0
    for a, start, over in blocks:
        d, t = np.nonzero(over > least if strict else over >= least)
        v = over[d, t]
        order = np.lexsort((-t if later else t, -v, d))
        found.append((d[order] + a, t[order] + start, v[order]))
        n += len(d)
        if n > LINKS:
            yield tuple(map(np.concatenate, zip(*found)))
            found, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*found)))


def taken(detection: np.ndarray, truth: np.ndarray, free: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The links that are taken: in order of detections each takes its first one to a truth that is ``free``; ``shared`` truths stay free.

    Links are sorted by detection. All detections ask at once, a truth keeps the first that ever asks, and the others ask for their next one. As all truths prefer
    earlier detections, this ends in what one after the other would take.
    """
    open_ = np.flatnonzero(free[truth])
    detection, truth = detection[open_], truth[open_]
    if not len(detection):
        return open_
    starts = np.flatnonzero(np.concatenate([[True], detection[1:] != detection[:-1]]))
    ends = np.append(starts[1:], len(detection))
    holder = np.full(len(shared), len(starts))
    at, asking = starts.copy(), np.arange(len(starts))
    while len(asking):
        goal = truth[at[asking]]
        single = ~shared[goal]
        mine, goal = asking[single], goal[single]
        before = holder[goal]
        np.minimum.at(holder, goal, mine)
        out = np.concatenate([mine[holder[goal] != mine], before[(before < len(starts)) & (holder[goal] != before)]])
        out = np.unique(out)
        at[out] += 1
        asking = out[at[out] < ends[out]]
    return open_[at[at < ends]]


def first_come(removes: np.ndarray, gone: np.ndarray | None = None) -> np.ndarray:
    """Places that stay where each in turn removes the later ones that ``removes[place]`` marks; those of ``gone`` neither stay nor remove."""
    bits = lambda marks: int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
    out, kept = 0 if gone is None else bits(gone), []
    packed = np.packbits(removes, axis=1, bitorder="little")
    width, data = packed.shape[1], packed.tobytes()
    for i in range(len(removes)):
        if not out >> i & 1:
            kept.append(i)
            out |= int.from_bytes(data[i * width : (i + 1) * width], "little")
    return np.array(kept, int)


def _overlaps(box: np.ndarray, boxes: np.ndarray, plus: float) -> np.ndarray:
    w = np.minimum(box[..., 2], boxes[..., 2]) - np.maximum(box[..., 0], boxes[..., 0]) + plus
    h = np.minimum(box[..., 3], boxes[..., 3]) - np.maximum(box[..., 1], boxes[..., 1]) + plus
    both = np.maximum(w, 0) * np.maximum(h, 0)
    area = lambda b: (b[..., 2] - b[..., 0] + plus) * (b[..., 3] - b[..., 1] + plus)
    return np.divide(both, area(box) + area(boxes) - both, out=np.zeros(both.shape), where=both > 0)


def suppressed(boxes: np.ndarray, order: np.ndarray, threshold: float, plus: float = 0.0) -> np.ndarray:
    """Places that stay: each in turn removes those after it that overlap it by more than the threshold."""
    kept = []
    while len(order):
        i, order = order[0], order[1:]
        kept.append(i)
        order = order[_overlaps(boxes[i], boxes[order], plus) <= threshold]
    return np.array(kept, int)


def staying(boxes: np.ndarray, threshold: float, plus: float = 0.0) -> np.ndarray:
    """Places of the boxes that stay, where each in turn removes those after it."""
    if len(boxes) > SQUARE:
        return suppressed(boxes, np.arange(len(boxes)), threshold, plus)
    return first_come(~(_overlaps(boxes[:, None], boxes[None], plus) <= threshold))


def non_maximum_suppression(df: DataFrame, by: list[str], threshold: float, score: str = "score", ties: list[str] = (), plus: float = 0.0, least_score: float | None = None) -> DataFrame:
    """Greedy suppression in each group (image and class), highest score first; ``ties`` complete the order."""

    def keep(*corners: np.ndarray) -> np.ndarray:
        return staying(np.stack(corners, axis=1).astype(float), threshold, plus)

    if least_score is not None:
        df = df.filter(F.col(score) > least_score)
    return pick(df, by, [*falling(score), *map(F.asc_nulls_last, ties)], ["x0", "y0", "x1", "y1"], keep)


def detections_per_image(df: DataFrame, image: str, label: str, threshold: float, least_score: float, most: int, ties: list[str]) -> DataFrame:
    """Score threshold, suppression per class, then the best of each image."""
    kept = non_maximum_suppression(df, [image, label], threshold, ties=ties, least_score=least_score)
    return top_k(kept, [image], [F.desc("score"), *ties], most)


def greedy_match(detections: DataFrame, truths: DataFrame, by: list[str], threshold: float, ties: list[str], strict: bool = False, plus: float = 0.0) -> DataFrame:
    """Each detection, best score first, takes the free truth it overlaps most, if by the threshold (``strict``: more than it).
    The rules of the two usual evaluations differ from this one: see ``evaluation``.

    Detections carry ``det_id``, truths ``gt_id``; the result is by, det_id, score, gt_id (null if none), iou, hit.
    """
    shown = lambda df, own: df.select(*dict.fromkeys([*by, *own, *CORNERS]))
    return greedy_match_of(together(shown(detections, ["det_id", "score", *ties]), shown(truths, ["gt_id"])), by, threshold, ties, strict, plus)


def greedy_match_of(rows: DataFrame, by: list[str], threshold: float, ties: list[str], strict: bool = False, plus: float = 0.0) -> DataFrame:
    """As ``greedy_match``, with both sides in one table (see ``together``)."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    names = [*by, "det_id", "score", "gt_id", "iou", "hit"]

    def run(table: pa.Table, cuts: list[int], begins: np.ndarray) -> pa.Table:
        blocks = overlap_blocks(corners(table), cuts, begins, lambda a, b: _overlaps(a, b, plus))
        n = table.num_rows
        goal, iou, free, shared = np.full(n, -1), np.zeros(n), np.ones(n, bool), np.zeros(n, bool)
        for detection, truth, over in links(blocks, threshold if strict else min(threshold, 1 - 1e-10), strict):
            got = taken(detection, truth, free, shared)
            goal[detection[got]], iou[detection[got]], free[truth[got]] = truth[got], over[got], False
        mine = np.flatnonzero(~table.column("truth").to_numpy())
        goal, found = goal[mine], table.take(pa.array(mine))
        ids = table.column("gt_id").take(pa.array(goal, mask=goal < 0))
        return pa.table([*[found.column(c) for c in (*by, "det_id", "score")], ids, pa.array(iou[mine]), pa.array(goal >= 0)], names=names)

    shown = rows.select(*by, "truth", F.col("det_id").cast("long").alias("det_id"), F.col("gt_id").cast("long").alias("gt_id"), F.col("score").cast("double").alias("score"), *CORNERS, *[c for c in ties if c not in (*by, "det_id", "score")])
    return in_groups(shown, by, [*falling("score"), *map(F.asc_nulls_last, ties)], run, f"{kinds}, det_id long, score double, gt_id long, iou double, hit boolean")


def falling_ends(lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
    """Places of the pairs that are taken, in their order, where each end is taken once."""
    a, b, kept = set(), set(), []
    for i, (x, y) in enumerate(zip(lefts.tolist(), rights.tolist())):
        if x not in a and y not in b:
            a.add(x), b.add(y), kept.append(i)
    return np.array(kept, int)


def global_greedy_match(pairs: DataFrame, by: str, left: str, right: str) -> DataFrame:
    """Of (by, left, right, iou) the pair with the greatest overlap, then the next one between free ends, and so on."""

    return pick(pairs, [by], [*falling("iou"), F.asc_nulls_last(left), F.asc_nulls_last(right)], [left, right], falling_ends)


def mask_suppression(pixels: DataFrame, by: str, threshold: float, least_score: float) -> DataFrame:
    """Masks as pixel sets (by, mask_id, score, pixel), best score first: one that lies in those before it by more than the
    threshold goes, else it keeps its free pixels. Ends at the first score below ``least_score``.

    A mask is a row with ``pixels`` (an array without repeats) where the caller has them so; else they are gathered first.
    """
    masks = pixels if "pixels" in pixels.columns else pixels.groupBy(by, "mask_id", "score").agg(F.collect_set("pixel").alias("pixels"))
    kinds = {f.name: f.dataType.simpleString() for f in masks.schema}
    order = Window.partitionBy(by).orderBy(F.desc("score"), "mask_id")
    dealt = masks.select(by, "mask_id", "score", F.sort_array("pixels").alias("pixels")).withColumn("__n", F.row_number().over(order)).filter(F.col("score") >= least_score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: set = set()  # the only state: pixels of the group so far, which may span batches
        for batch in batches:
            rows, places, free = batch.column("__n").to_pylist(), [], []
            for place, (number, mine) in enumerate(zip(rows, batch.column("pixels").to_pylist())):
                if number == 1:
                    taken = set()
                mine = mine or []
                left = [p for p in mine if p not in taken]
                if (len(mine) - len(left)) / max(len(mine), 1) > threshold:
                    continue
                if left:
                    places.append(place), free.append(left)
                    taken.update(left)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(places, pa.int64())) for c in (by, "mask_id", "score")), pa.array(free, batch.schema.field("pixels").type)], [by, "mask_id", "score", "pixels"])

    kept = dealt.mapInArrow(run, f"{by} {kinds[by]}, mask_id {kinds['mask_id']}, score {kinds['score']}, pixels {kinds['pixels']}")
    return kept.select(by, "mask_id", "score", F.explode("pixels").alias("pixel"))


def nearest(points: DataFrame, candidates: DataFrame, part: str) -> DataFrame:
    """For each point (id, u, v) the candidate (vertex, cu, cv) of its part with the least squared distance ``d2``, ties to the smaller one.

    Points of one place are asked once, and candidates of one place are one. Both are laid on cells of about one candidate and meet in three by three cells; a
    place whose best is nearer than a cell is done, as nothing nearer lies further out, and the others go on with cells twice as wide, until a cell
    holds the whole part. Points outside of the candidates search from the nearest cell. Rows with nulls, and points of parts without candidates, have no result.
    """
    spots = points.select(part, "u", "v").dropna().distinct()
    there = candidates.select(part, "vertex", "cu", "cv").dropna().groupBy(part, "cu", "cv").agg(F.min("vertex").alias("vertex"))
    wide = F.greatest(F.max("cu") - F.min("cu"), F.max("cv") - F.min("cv"))
    frames = there.groupBy(part).agg(F.min("cu").alias("__u"), F.min("cv").alias("__v"), F.max("cu").alias("__mu"), F.max("cv").alias("__mv"), wide.alias("__wide"), F.count("*").alias("__n"))
    frames = frames.withColumn("__side", F.when(F.col("__wide") > 0, F.col("__wide") / F.ceil(F.sqrt("__n"))).otherwise(1.0))
    there, open_ = checkpointed(there.join(frames, part)), checkpointed(spots.join(frames, part))
    d2 = (F.col("u") - F.col("cu")) ** 2 + (F.col("v") - F.col("cv")) ** 2
    found, level = [], 0
    while not open_.isEmpty():
        side = F.col("__side") * float(2**level)
        cell = lambda c, low, side=side: F.floor((c - F.col(low)) / side)
        inner = [F.greatest(F.col(f"__{c}"), F.least(F.col(f"__m{c}"), F.col(c))) for c in "uv"]
        around = F.array(*[F.struct((cell(inner[0], "__u") + i).alias("i"), (cell(inner[1], "__v") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        asked = open_.select(part, "u", "v", F.explode(around).alias("__c")).select(part, "u", "v", "__c.i", "__c.j")
        held = there.select(part, "cu", "cv", "vertex", cell(F.col("cu"), "__u").alias("i"), cell(F.col("cv"), "__v").alias("j"))
        best = asked.join(held, [part, "i", "j"]).groupBy(part, "u", "v").agg(F.min(F.struct(d2.alias("d2"), F.col("vertex").alias("vertex"))).alias("__best"))
        tried = checkpointed(open_.join(best, [part, "u", "v"], "left"))
        done = F.coalesce(F.col("__best.d2") < side * side, F.lit(False)) | (side >= F.col("__wide"))
        found.append(tried.filter(done).select(part, "u", "v", "__best.vertex", "__best.d2"))
        open_, level = tried.filter(~done).drop("__best"), level + 1
    if not found:
        return points.join(there, part).select("id", "vertex", F.lit(0.0).alias("d2")).limit(0)
    return points.join(reduce(DataFrame.unionByName, found), [part, "u", "v"]).select("id", "vertex", "d2")


def panoptic_merge(instances: DataFrame, semantic: DataFrame, by: str, threshold: float, least_score: float, least_stuff: int, things: int = 0) -> DataFrame:
    """Segments (by, segment, is_thing, label, pixel): instance masks first (``mask_suppression``), then the free pixels of
    each stuff label, if there are enough of them.

    ``instances`` has (by, mask_id, score, pixel, label), ``semantic`` (by, pixel, label); the label ``things`` stands for all things.
    Segments are numbered from 1: instances by falling score, then stuff by label.
    """
    kept = checkpointed(mask_suppression(instances, by, threshold, least_score))  # read four times
    labels = instances.select(by, "mask_id", "label").distinct()
    order = Window.partitionBy(by).orderBy(F.desc("score"), "mask_id")
    first = kept.join(labels.hint("merge"), [by, "mask_id"]).withColumn("segment", F.dense_rank().over(order)).select(by, "segment", F.lit(True).alias("is_thing"), "label", "pixel")
    free = semantic.filter(F.col("label") != things).join(kept.select(by, "pixel").hint("merge"), [by, "pixel"], "left_anti")
    large = free.groupBy(by, "label").agg(F.count("*").alias("n")).filter(F.col("n") >= least_stuff)
    used = first.groupBy(by).agg(F.max("segment").alias("__used"))
    numbered = large.join(used.hint("merge"), by, "left").withColumn("segment", F.coalesce("__used", F.lit(0)) + F.row_number().over(Window.partitionBy(by).orderBy("label")))
    stuff = free.join(numbered.select(by, "label", "segment").hint("merge"), [by, "label"]).select(by, "segment", F.lit(False).alias("is_thing"), "label", "pixel")
    return first.unionByName(stuff)
