"""Detection and segmentation metrics as aggregates and ordered windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.geometry import Box
from brindle.operators.poses import triangular_index
from brindle.session import checkpointed


def confusion(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n): partial counts are merged by the shuffle."""
    return pairs.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame, classes: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, tp, n_truth, n_predicted, iou and recall; a class that does not occur has 0. One pass over the matrix."""
    sides = matrix.select(F.explode(F.array(F.struct(F.col(truth).alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")))).alias("s")).select("s.*")
    sums = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("t").alias("n_truth"), F.sum("p").alias("n_predicted"))
    full = classes.join(sums, "class", "left").fillna(0)
    return full.withColumns({"iou": F.col("tp") / F.greatest(F.lit(1), F.col("n_truth") + F.col("n_predicted") - F.col("tp")), "recall": F.col("tp") / F.greatest(F.lit(1), F.col("n_truth"))})


def segmentation_summary(scores: DataFrame) -> DataFrame:
    """pixel accuracy, mean accuracy over classes in the truth, mean IoU (numerator over truth, denominator over any), frequency-weighted IoU."""
    there, any_ = F.col("n_truth") > 0, (F.col("n_truth") + F.col("n_predicted")) > 0
    return scores.agg(
        (F.sum("tp") / F.greatest(F.lit(1), F.sum("n_truth"))).alias("pixel_acc"),
        (F.sum(F.when(there, F.col("recall"))) / F.count_if(there)).alias("mean_acc"),
        (F.sum(F.when(there, F.col("iou"))) / F.count_if(any_)).alias("mean_iou"),
        (F.sum(F.when(there, F.col("iou") * F.col("n_truth"))) / F.greatest(F.lit(1), F.sum("n_truth"))).alias("fw_iou"),
    )


def running_sums(df: DataFrame, by: list[str], order: list, values: dict[str, Column]) -> DataFrame:
    """``df`` with running sums of ``values`` along ``order`` in each group of ``by``, and ``__p``, the range that holds the row.

    A group may hold most rows, so no task takes it whole: rows are dealt to ranges of (by, order), each
    range has its own running sums, and starts from the sum of the ranges before it, of which there are
    few. The ranges lie in a checkpoint, as their borders are drawn anew whenever they are computed.
    """
    ranged = checkpointed(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__p", F.spark_partition_id()))
    keys = [*by, "__p"]  # without ``by`` the sums of the ranges meet in one task, a row for each range
    totals = ranged.groupBy(*keys).agg(*[F.sum(v).alias(f"__all_{k}") for k, v in values.items()])
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, *[F.coalesce(F.sum(f"__all_{k}").over(before), F.lit(0)).alias(f"__from_{k}") for k in values])
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(starts, keys)
    return joined.withColumns({k: F.col(f"__from_{k}") + F.sum(v).over(local) for k, v in values.items()}).drop(*[f"__from_{k}" for k in values])


def running_max_from_end(df: DataFrame, by: list[str], place: str, value: str, name: str) -> DataFrame:
    """``df`` (with ``__p`` of ``running_sums``) with the greatest ``value`` at or after each row in the order of ``place``."""
    keys = [*by, "__p"]
    tops = df.groupBy(*keys).agg(F.max(value).alias("__top"))
    later = tops.select(*keys, F.max("__top").over(Window.partitionBy(*by).orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, -1)).alias("__later"))
    local = Window.partitionBy(*keys).orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, 0)  # a frame that ends here costs a step, one that begins here the rest
    return df.join(later, keys).withColumn(name, F.greatest(F.max(value).over(local), F.col("__later"))).drop("__later")


def running_maxima_from_end(df: DataFrame, by: list[str], place: str, values: dict[str, str]) -> DataFrame:
    """As ``running_max_from_end`` for several values (value: name), in one pass."""
    keys = [*by, "__p"]
    tops = df.groupBy(*keys).agg(*[F.max(v).alias(f"__top_{v}") for v in values])
    after = Window.partitionBy(*by).orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, -1)
    later = tops.select(*keys, *[F.max(f"__top_{v}").over(after).alias(f"__later_{v}") for v in values])
    local = Window.partitionBy(*keys).orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(later, keys).withColumns({name: F.greatest(F.max(v).over(local), F.col(f"__later_{v}")) for v, name in values.items()}).drop(*[f"__later_{v}" for v in values])


def precision_recall(detections: DataFrame, by: list[str], score: str, hit: str, positives: str, order: list[str]) -> DataFrame:
    """Running tp, seen, recall, precision, and the precision envelope from the right."""
    ordered = [F.desc(score), *[F.col(c) for c in order]]
    made = running_sums(detections, by, ordered, {"tp": F.col(hit).cast("long"), "seen": F.lit(1).cast("long")})
    made = made.withColumns({"recall": F.col("tp") / F.greatest(F.col(positives), F.lit(1)), "precision": F.col("tp") / F.col("seen")})
    return running_max_from_end(made, by, "seen", "precision", "envelope").drop("__p")


def average_precision(curve: DataFrame, by: list[str], hit: str = "hit") -> DataFrame:
    """Area under the envelope: each hit is a step of recall."""
    return curve.groupBy(*by).agg(F.sum(F.when(F.col(hit), F.col("recall") / F.col("tp") * F.col("envelope")).otherwise(0.0)).alias("ap"))


def accumulate(matches: DataFrame, positives: DataFrame, by: list[str], score: str, order: list[str], levels: int = 101) -> tuple[DataFrame, DataFrame]:
    """Precision at recall levels, and final recall, for each ``by`` (threshold, category, area range, limit).

    ``matches`` has hit and ignored beside ``by``: an ignored detection counts neither way. ``positives`` has
    the number of truths (by the keys that it has of ``by``); a combination without truths has -1 everywhere.
    Precision (by, level, precision) is that of the first place that reaches a level on the envelope, else 0.
    """
    ordered = [F.desc(score), *[F.col(c) for c in order]]
    # What counts neither way leaves precision and recall where they are, so only the rest is sorted, with no more columns than that takes.
    counting = matches.filter(F.coalesce(~F.col("ignored"), F.lit(False))).select(*dict.fromkeys([*by, score, *order, "hit"]))
    curve = running_sums(counting, by, ordered, {"tp": F.col("hit").cast("long"), "fp": (~F.col("hit")).cast("long"), "place": F.lit(1).cast("long")})
    keys = [c for c in positives.columns if c in by]
    curve = curve.join(positives.withColumnRenamed("positives", "__n"), keys).withColumns({"recall": F.col("tp") / F.col("__n"), "precision": F.col("tp") / (F.col("tp") + F.col("fp") + F.lit(2.0**-52))})
    curve = running_max_from_end(curve, by, "place", "precision", "envelope")
    # Recall and envelope are monotone, so what the first place at a level has is the greatest envelope from there on.
    reached = curve.groupBy(*by, "recall").agg(F.max("envelope").alias("envelope")).withColumn("level", F.explode(F.filter(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: k / (levels - 1) <= F.col("recall"))))
    best = reached.groupBy(*by, "level").agg(F.max("envelope").alias("precision"))
    every = matches.select(*by).distinct().join(positives, keys)
    grid = every.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    value = lambda c: F.when(F.col("positives") == 0, -1.0).otherwise(F.coalesce(c, F.lit(0.0)))
    precision = grid.join(best, [*by, "level"], "left").select(*by, "level", value("precision").alias("precision"))
    recall = every.join(curve.groupBy(*by).agg(F.max("recall").alias("r")), by, "left").select(*by, value("r").alias("recall"))
    return precision, recall


CODES = 32  # codes of two bits that a long holds


def accumulate_codes(rows: DataFrame, positives: DataFrame, category: str, options: list[dict], codes: list[Column], score: str, order: list[str], levels: int = 101) -> tuple[DataFrame, DataFrame]:
    """As ``accumulate``, from a row for each detection, not for each of its combinations; one sort makes all of them.

    ``options`` are the combinations (name: value, such as threshold, area range and limit). ``codes`` has a column for each: 1 (right), 2 (wrong), 0 (counts neither way)
    or null (no such detection). Rows are sorted once, with their codes packed in longs; those that count anywhere lie in a checkpoint as blocks of bytes. What the blocks before it
    counted is all that a block needs: the precision at a level is the greatest of any place that reaches it, in whatever block.
    """
    n, width, each = len(options), -(-len(options) // 4), range(len(options))
    names = list(options[0])
    bits = [F.shiftleft(F.coalesce(c, F.lit(0)).cast("long"), 2 * (k % CODES)) for k, c in enumerate(codes)]
    words = [f"__w{j}" for j in range(-(-n // CODES))]
    packs = [reduce(Column.bitwiseOR, bits[j * CODES : (j + 1) * CODES]).alias(w) for j, w in enumerate(words)]
    counting = rows.select(*dict.fromkeys([category, score, *order]), *packs)
    ordered = [F.col(category), F.desc(score), *[F.col(c) for c in order]]
    ranged = counting.repartitionByRange(*ordered).sortWithinPartitions(*ordered).select(F.col(category).alias("category"), F.spark_partition_id().alias("p"), *words)
    kind = ranged.schema["category"].dataType.simpleString()
    at = lambda packed, k: (packed[:, k // 4] >> (2 * (k % 4))) & 3

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part of a batch that is of one category."""
        seen = 0
        for batch in batches:
            packed = np.stack([batch.column(w).to_numpy() for w in words], axis=1)
            some = packed.any(1)
            if not some.any():
                continue
            batch, packed = batch.filter(pa.array(some)), packed[some].view(np.uint8)[:, :width]
            kinds = batch.column("category").dictionary_encode().indices.fill_null(-1).to_numpy()
            cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
            sums = [np.stack([np.add.reduceat((at(packed, k) == v).astype(np.int64), cuts[:-1]) for k in each], axis=1).ravel() for v in (1, 2)]
            ends = pa.array(np.arange(len(cuts)) * n, pa.int32())
            firsts = pa.array(cuts[:-1])
            blocks = pa.array([packed[a:b].tobytes() for a, b in pairwise(cuts)], pa.binary())
            places = pa.array(np.arange(seen, seen + len(firsts)))
            seen += len(firsts)
            yield pa.RecordBatch.from_arrays([batch.column("category").take(firsts), batch.column("p").take(firsts), places, *[pa.ListArray.from_arrays(ends, pa.array(v)) for v in sums], blocks], ["category", "p", "seq", "right", "wrong", "block"])

    blocks = checkpointed(ranged.mapInArrow(pack, f"category {kind}, p int, seq long, `right` array<long>, wrong array<long>, block binary"))
    literal = F.array(*[F.struct(F.lit(k).alias("__k"), *[F.lit(v).alias(name) for name, v in o.items()]) for k, o in enumerate(options)])
    there = rows.groupBy(category).agg(F.array(*[F.max(c.isNotNull()) for c in codes]).alias("__there"))
    shown = there.select(category, "__there", F.explode(literal).alias("__o")).filter(F.get("__there", F.col("__o.__k"))).select(category, "__o.*")
    every = shown.join(positives, [c for c in positives.columns if c in (category, *names)])
    goals = every.groupBy(F.col(category).alias("category")).agg(F.array(*[F.max(F.when(F.col("__k") == k, F.col("positives"))) for k in each]).alias("goals"))
    before = Window.partitionBy("category").orderBy("p", "seq").rowsBetween(Window.unboundedPreceding, -1)
    begun = [F.array(*[F.coalesce(F.sum(F.get(v, F.lit(k))).over(before), F.lit(0)) for k in each]).alias(v) for v in ("right", "wrong")]
    known = blocks.select("category", "p", "seq", "right", "wrong").select("category", "p", "seq", *begun).join(goals, "category")
    steps = np.arange(levels) / (levels - 1)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """category and, for each option and level, the greatest precision in the block at a place that reaches the level."""
        for batch in (b for b in batches if b.num_rows):
            tops = np.zeros((batch.num_rows, n, levels))
            for row, (block, right, wrong, goal) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("block", "right", "wrong", "goals")])):
                packed = np.frombuffer(block, np.uint8).reshape(-1, width)
                for k in each:
                    code = at(packed, k)
                    hits = np.flatnonzero(code == 1)
                    if len(hits) and goal[k]:
                        tp = right[k] + np.arange(1, len(hits) + 1)
                        precision = tp / (tp + (wrong[k] + np.cumsum(code == 2)[hits]) + 2.0**-52)
                        best = np.append(np.maximum.accumulate(precision[::-1])[::-1], 0.0)
                        tops[row, k] = best[np.searchsorted(tp / goal[k], steps)]
            ends = pa.array(np.arange(batch.num_rows + 1) * n * levels, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("category"), pa.ListArray.from_arrays(ends, pa.array(tops.ravel()))], ["category", "tops"])

    made = blocks.select("p", "seq", "block").join(known, ["p", "seq"]).select("category", "block", "right", "wrong", "goals").mapInArrow(through, f"category {kind}, tops array<double>")
    best = made.select(F.col("category").alias(category), F.posexplode("tops").alias("__i", "__top")).groupBy(category, "__i").agg(F.max("__top").alias("__best"))
    value = lambda c: F.when(F.col("positives") == 0, -1.0).otherwise(F.coalesce(c, F.lit(0.0)))
    grid = every.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("__i", F.col("__k") * levels + F.col("level"))
    precision = grid.join(best, [category, "__i"], "left").select(category, *names, "level", value(F.col("__best")).alias("precision"))
    sums = blocks.groupBy(F.col("category").alias(category)).agg(F.array(*[F.sum(F.get("right", F.lit(k))) for k in each]).alias("__tp"))
    recall = every.join(sums, category, "left").select(category, *names, value(F.try_divide(F.get("__tp", F.col("__k")), F.col("positives"))).alias("recall"))
    return precision, recall


def summarize(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The mean of what is above -1, which marks combinations without truths; -1 if nothing is."""
    return values.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col(value) > -1, F.col(value))), F.lit(-1.0)).alias("mean"))


def interpolated_precision(curve: DataFrame, by: list[str], points: int = 101) -> DataFrame:
    """Mean over ``points`` recall levels of the first precision that reaches each (0 if none does)."""
    reached = curve.groupBy(*by, "recall").agg(F.max("envelope").alias("envelope"))
    levels = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: k / (points - 1))
    # The envelope falls with recall, so the best precision at or beyond a level is the first one.
    best = reached.withColumn("level", F.explode(F.filter(levels, lambda x: x <= F.col("recall") + 1e-12))).groupBy(*by, "level").agg(F.max("envelope").alias("p"))
    return best.groupBy(*by).agg((F.sum("p") / points).alias("ap"))


def average_recall(best_overlap: DataFrame, overlap: Column, thresholds: list[float], by: list[str]) -> DataFrame:
    hits = sum((F.count_if(overlap >= t) for t in thresholds[1:]), F.count_if(overlap >= thresholds[0]))
    return best_overlap.groupBy(*by).agg((hits / F.count("*") / len(thresholds)).alias("ar"))


def soft_dice(p: Column, g: Column, smooth: float = 1.0) -> Column:
    return 1 - (2 * F.sum(p * g) + smooth) / (F.sum(p) + F.sum(g) + smooth)


def tversky(p: Column, g: Column, alpha: float = 0.3, beta: float = 0.7, smooth: float = 1.0) -> Column:
    tp = F.sum(p * g)
    return 1 - (tp + smooth) / (tp + alpha * F.sum(p * (1 - g)) + beta * F.sum((1 - p) * g) + smooth)


def balance_weights(counts: DataFrame, n: str) -> DataFrame:
    """(total - n) / total / (classes - 1)."""
    everything = Window.partitionBy(F.lit(0))
    total, classes = F.sum(n).over(everything), F.count("*").over(everything)
    return counts.withColumn("weight", (total - F.col(n)) / total / F.greatest(classes - 1, F.lit(1)))


def jaccard_gradient(errors: DataFrame, by: list[str], error: str, truth: str, order: list[str]) -> DataFrame:
    """First differences of the Jaccard loss along falling errors."""
    totals = errors.groupBy(*by).agg(F.sum(truth).alias("__pos"))
    run = running_sums(errors, by, [F.desc(error), *[F.col(c) for c in order]], {"__t": F.col(truth), "__f": 1 - F.col(truth)}).join(totals, by)
    loss = lambda t, f: 1 - F.try_divide(F.col("__pos") - t, F.col("__pos") + f)
    before = F.coalesce(loss(F.col("__t") - F.col(truth), F.col("__f") - (1 - F.col(truth))), F.lit(0.0))
    made = run.withColumn("jaccard", loss(F.col("__t"), F.col("__f")))
    return made.withColumn("gradient", F.col("jaccard") - before).drop("__p", "__t", "__f", "__pos")


def check_expected(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Each expected (task, metric, value, tolerance) with whether the result is there and near enough."""
    joined = expected.join(results.withColumnRenamed("value", "actual"), ["task", "metric"], "left")
    return joined.withColumn("ok", F.coalesce(F.isnotnull("actual") & ~F.isnan("actual") & (F.abs(F.col("actual") - F.col("value")) <= F.col("tolerance")), F.lit(False)))


def keypoint_similarity(points: Column, truth: Column, area: Column, variances: list[float], box: Box | None = None) -> Column:
    """Mean over visible points of exp(-d^2 / variance / area / 2).

    If no point is visible: null without ``box``, else the mean over all points of their distances to the box of the truth, grown by its own sides on each side.
    """
    k2 = F.array(*[F.lit(float(v)) for v in variances])
    share = lambda dx, dy, i: F.exp(-(dx * dx + dy * dy) / F.get(k2, i) / area / 2)
    parts = F.transform(truth, lambda t, i: F.when(t["v"] > 0, share(F.get(points, i)["x"] - t["x"], F.get(points, i)["y"] - t["y"], i)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    seen = F.filter(parts, lambda v: v.isNotNull())
    if box is None:
        return F.when(F.size(seen) > 0, mean(seen))
    off = lambda v, low, high, side: F.greatest(F.lit(0.0), low - side - v) + F.greatest(F.lit(0.0), v - high - side)
    outside = F.transform(points, lambda p, i: share(off(p["x"], box.x0, box.x1, box.width), off(p["y"], box.y0, box.y1, box.height), i))
    return F.when(F.size(seen) > 0, mean(seen)).otherwise(mean(outside))


def surface_similarity(points: DataFrame, by: list[str], distances: DataFrame, spreads: DataFrame) -> DataFrame:
    """(by, similarity): the mean over truth points of exp(-d^2 / 2 spread^2), where d is the distance on the surface.

    ``points`` has ``by``, vertex and truth_vertex, numbered from 1 (0 or null: none). ``distances`` is the packed triangle (place, distance) in the numbering of
    ``poses.triangular_index`` for vertices from 0; pairs that it lacks are infinitely far, as is a missing vertex, and equal vertices have 0. ``spreads`` has (vertex,
    spread) of truth vertices; one without a spread counts 0. Groups without a truth point have 0. Equal pairs of a group meet as one row with a count.
    """
    real = F.col("truth_vertex") > 0
    met = points.groupBy(*by, "vertex", "truth_vertex").agg(F.count_if(real).alias("__n"))
    both = real & (F.col("vertex") > 0)
    packed = met.withColumn("__k", F.when(both, triangular_index(F.col("vertex").cast("long") - 1, F.col("truth_vertex").cast("long") - 1)))
    far = packed.join(distances.select(F.col("place").alias("__k"), F.col("distance").alias("__d")), "__k", "left").join(spreads.select(F.col("vertex").alias("truth_vertex"), F.col("spread").alias("__s")), "truth_vertex", "left")
    d = F.when(both & (F.col("vertex") == F.col("truth_vertex")), 0.0).otherwise(F.col("__d"))
    near = F.coalesce(F.exp(-(d * d) / (2 * F.col("__s") * F.col("__s"))), F.lit(0.0))
    return far.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(near * F.col("__n")), F.sum("__n")), F.lit(0.0)).alias("similarity"))
