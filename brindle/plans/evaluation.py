"""Queries of the detection evaluations on boxes derived from ``lineitem``: an image is a supplier, a category a return flag, every other box a truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.geometry import Box
from brindle.operators import evaluation, metrics
from brindle.plans.annotations import DETECTIONS, suppressed_sql
from brindle.registry import Registry
from brindle.session import table

ORDER = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice"
AREAS = {"all": (0.0, 1e5), "small": (0.0, 400.0), "large": (400.0, 1e5)}
LEVELS = (0.3, 0.5)
LIMITS = (10, 100)
TEN = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))


def rows(s, d, dealt: str | None = None) -> DataFrame:
    """``dealt`` is a column by which the lines are dealt to tasks beforehand, where groups wider than those of the numbers follow."""
    box = Box.from_xywh((F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double"), F.col("l_quantity"), F.col("l_linenumber") * 5.0)
    number = F.row_number().over(Window.partitionBy("l_suppkey", "l_returnflag").orderBy(*ORDER.split(", "))).cast("long")
    lines = table(s, d, "lineitem")
    made = (lines.repartition(dealt) if dealt else lines).withColumn("id", number).select("*", *box.columns())  # boxes are made after the shuffle, which has fewer columns so
    return made.select(F.col("l_suppkey").alias("image"), F.col("l_returnflag").alias("label"), "id", F.col("l_discount").alias("score"), "x0", "y0", "x1", "y1", (F.col("l_tax") > 0.07).alias("flag"))


def detections(s, d) -> DataFrame:
    return rows(s, d).filter("id % 2 = 0").withColumnRenamed("id", "det_id").drop("flag")


def truths(s, d) -> DataFrame:
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    made = rows(s, d).filter("id % 2 = 1").withColumnRenamed("id", "gt_id").drop("score")
    return made.select("*", area.alias("area"), F.col("flag").alias("crowd"), (F.col("gt_id") % 10 == 1).alias("ignore"), F.col("flag").alias("difficult"))


def both(s, d, dealt: str | None = None) -> DataFrame:
    """Detections and truths in one table, from one pass over the lines."""
    odd = F.col("id") % 2 == 1
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    made = rows(s, d, dealt).select("*", odd.alias("truth"), F.when(~odd, F.col("id")).alias("det_id"), F.when(odd, F.col("id")).alias("gt_id"), area.alias("area"))
    return made.select("*", F.col("flag").alias("crowd"), (F.col("gt_id") % 10 == 1).alias("ignore"), F.col("flag").alias("difficult")).drop("id", "flag")


BASE = f"""b AS (SELECT l_suppkey AS image, l_returnflag AS label, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY {ORDER}) AS id, l_discount AS score,
(l_partkey % 100)::DOUBLE AS x0, (l_suppkey % 100)::DOUBLE AS y0, (l_partkey % 100 + l_quantity)::DOUBLE AS x1, (l_suppkey % 100 + l_linenumber * 5)::DOUBLE AS y1, l_tax > 0.07 AS flag FROM lineitem),
det AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY image, label ORDER BY score DESC, id) AS place FROM b WHERE id % 2 = 0),
gt AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, id % 10 = 1 AS skip FROM b WHERE id % 2 = 1)"""


def _met(plus: int, left: str = "d", right: str = "g") -> str:
    return f"greatest(0, least({left}.x1, {right}.x1) - greatest({left}.x0, {right}.x0) + {plus}) * greatest(0, least({left}.y1, {right}.y1) - greatest({left}.y0, {right}.y0) + {plus})"


def _size(name: str, plus: int) -> str:
    return f"({name}.x1 - {name}.x0 + {plus}) * ({name}.y1 - {name}.y0 + {plus})"


def voc_sql(levels) -> str:
    return f"""{BASE}, p AS (SELECT d.image, d.label, d.id, g.id AS gt, g.flag, {_met(1)} AS v, {_size('d', 1)} + {_size('g', 1)} AS w FROM det d JOIN gt g USING (image, label)),
near AS (SELECT *, v / (w - v) AS iou FROM p WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY image, label, id ORDER BY v / (w - v) DESC, gt) = 1),
look AS (SELECT d.image, d.label, d.id, d.score, n.gt, coalesce(n.flag, false) AS flag, coalesce(n.iou, -1) AS iou FROM det d LEFT JOIN near n USING (image, label, id)),
t AS (SELECT unnest([{', '.join(map(str, levels))}])::DOUBLE AS t),
m AS (SELECT look.*, t, iou > t AS over, sum((iou > t)::INT) OVER (PARTITION BY image, label, coalesce(gt, -id), t ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS n FROM look, t),
k AS (SELECT *, over AND NOT flag AND n = 1 AS tp, NOT over OR (NOT flag AND n > 1) AS fp FROM m),
np AS (SELECT label, count(*) FILTER (NOT flag) AS np FROM gt GROUP BY 1),
c AS (SELECT k.label, k.t, tp, np, sum(tp::INT) OVER o AS ct, sum(fp::INT) OVER o AS cf, row_number() OVER o AS place FROM k JOIN np USING (label) WINDOW o AS (PARTITION BY k.label, k.t ORDER BY score DESC, image, id ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, ct / greatest(np, 1) AS rec, ct / greatest(ct + cf, power(2.0, -52)) AS prec FROM c),
e AS (SELECT *, max(prec) OVER (PARTITION BY label, t ORDER BY place DESC) AS env FROM q)"""


VOC = voc_sql(TEN)

_FREE = "list_filter(o.c, lambda k: k.crowd OR NOT list_contains(s.taken, k.gt))[1]"
COCO = f"""{BASE}, ar AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {lo}, {hi})" for a, (lo, hi) in AREAS.items())}) v(name, lo, hi)), th AS (SELECT unnest([{', '.join(map(str, LEVELS))}])::DOUBLE AS threshold),
pr AS (SELECT d.image, d.label, d.id, g.id AS gid, g.flag, g.skip, g.area AS garea, v / CASE WHEN g.flag THEN {_size('d', 0)} ELSE {_size('d', 0)} + {_size('g', 0)} - v END AS iou FROM det d JOIN gt g USING (image, label), LATERAL (SELECT {_met(0)} AS v) WHERE v > 0 AND d.place <= {max(LIMITS)}),
cand AS (SELECT image, label, id, name, threshold, list({{'gt': gid, 'out': flag OR skip OR garea < lo OR garea > hi, 'crowd': flag, 'iou': iou}} ORDER BY (flag OR skip OR garea < lo OR garea > hi), iou DESC, gid DESC) AS c FROM pr, ar, th WHERE iou >= threshold GROUP BY ALL),
o AS (SELECT d.image, d.label, d.id, d.score, d.place, name, threshold, d.area < lo OR d.area > hi AS own, coalesce(c, []) AS c FROM det d CROSS JOIN ar CROSS JOIN th LEFT JOIN cand USING (image, label, id, name, threshold) WHERE d.place <= {max(LIMITS)}),
s AS (SELECT image, label, name, threshold, place, id, score, own, c[1] AS hit, list_filter([c[1].gt], lambda x: x IS NOT NULL) AS taken FROM o WHERE place = 1
UNION ALL SELECT o.image, o.label, o.name, o.threshold, o.place, o.id, o.score, o.own, {_FREE}, list_filter(list_append(s.taken, {_FREE}.gt), lambda x: x IS NOT NULL) FROM o JOIN s ON o.image = s.image AND o.label = s.label AND o.name = s.name AND o.threshold = s.threshold AND o.place = s.place + 1),
m AS (SELECT image, label, id AS det_id, score, place, name AS area, threshold, hit.gt AS gt_id, CASE WHEN hit.gt IS NULL THEN own ELSE hit.out END AS ignored FROM s)"""

COCO_CURVE = f"""{COCO}, lim AS (SELECT unnest([{', '.join(map(str, LIMITS))}]) AS lim),
np AS (SELECT label, name AS area, count(*) FILTER (NOT flag AND NOT skip AND area BETWEEN lo AND hi) AS np FROM gt, ar GROUP BY ALL),
c AS (SELECT m.label, m.area, threshold, lim, np, sum((gt_id IS NOT NULL AND NOT ignored)::INT) OVER o AS tp, sum((gt_id IS NULL AND NOT ignored)::INT) OVER o AS fp, row_number() OVER o AS n FROM m JOIN np ON np.label = m.label AND np.area = m.area, lim WHERE m.place <= lim
WINDOW o AS (PARTITION BY m.label, m.area, threshold, lim ORDER BY score DESC, image, m.place ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, tp / nullif(np, 0) AS rc, tp / (tp + fp + power(2.0, -52)) AS prec FROM c), e AS (SELECT *, max(prec) OVER (PARTITION BY label, area, threshold, lim ORDER BY n DESC) AS env FROM q),
steps AS (SELECT label, area, threshold, lim, np, k, max(env) FILTER (rc >= k / 10) AS p FROM e, range(11) r(k) GROUP BY ALL),
precs AS (SELECT label, area, threshold, lim, k, CASE WHEN np = 0 THEN -1.0 ELSE coalesce(p, 0) END AS precision FROM steps),
recs AS (SELECT label, area, threshold, lim, CASE WHEN max(np) = 0 THEN -1.0 ELSE max(rc) END AS recall FROM e GROUP BY ALL)"""

RECALL = f"""{BASE}, ar AS (SELECT name, lo, hi, lim FROM (VALUES {', '.join(f"('{a}', {lo}, {hi})" for a, (lo, hi) in AREAS.items())}) v(name, lo, hi), (VALUES (5), (40)) l(lim)),
own AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, label, id) AS n FROM det), truth AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY label, id) AS gid FROM gt WHERE NOT flag AND image IN (SELECT image FROM det)),
np AS (SELECT name, lim, count(*) AS positives FROM truth, ar WHERE area BETWEEN lo AND hi GROUP BY ALL),
pr AS (SELECT d.image, d.n, g.gid, g.area, v / ({_size('d', 0)} + {_size('g', 0)} - v) AS iou FROM own d JOIN truth g USING (image), LATERAL (SELECT {_met(0)} AS v) WHERE v > 0 AND d.n <= 40),
o AS (SELECT image, name, lim, n, gid, iou, row_number() OVER (PARTITION BY image, name, lim ORDER BY iou DESC, gid, n) AS k FROM pr, ar WHERE area BETWEEN lo AND hi AND n <= lim),
s AS (SELECT image, name, lim, k, iou, true AS took, [n] AS ns, [gid] AS gs FROM o WHERE k = 1
UNION ALL SELECT o.image, o.name, o.lim, o.k, o.iou, ok, CASE WHEN ok THEN list_append(s.ns, o.n) ELSE s.ns END, CASE WHEN ok THEN list_append(s.gs, o.gid) ELSE s.gs END FROM o JOIN s ON o.image = s.image AND o.name = s.name AND o.lim = s.lim AND o.k = s.k + 1, LATERAL (SELECT NOT list_contains(s.ns, o.n) AND NOT list_contains(s.gs, o.gid) AS ok) z)"""


def register(registry: Registry) -> None:
    add = registry.add
    by = ["image", "label"]
    flags = lambda name: [F.get(name, F.lit(k)).alias(f"{name}{round(TEN[k] * 100)}") for k in (0, 5)]
    add(
        "voc_matching",
        lambda s, d: evaluation.voc_marks_of(both(s, d), by, TEN).select(*by, "det_id", *flags("tp"), *flags("fp")),
        f"WITH {VOC} SELECT image, label, id AS det_id, bool_or(tp) FILTER (t = 0.5) AS tp50, bool_or(tp) FILTER (t = 0.75) AS tp75, bool_or(fp) FILTER (t = 0.5) AS fp50, bool_or(fp) FILTER (t = 0.75) AS fp75 FROM k GROUP BY ALL",
    )
    voc = lambda s, d, points: evaluation.voc_average_precision_of(both(s, d), "image", "label", TEN, points).withColumn("ap", F.round("ap", 9))
    add("voc_average_precision", lambda s, d: voc(s, d, None), f"WITH {VOC} SELECT label, t AS threshold, round(sum(CASE WHEN tp THEN env / greatest(np, 1) ELSE 0 END), 9) AS ap FROM e GROUP BY ALL")
    add(
        "class_average_precision",
        lambda s, d: evaluation.voc_average_precision_of(both(s, d), "image", "label", [0.3]).select("label", F.round("ap", 9).alias("ap")),
        f"WITH {voc_sql([0.3])} SELECT label, round(sum(CASE WHEN tp THEN env / greatest(np, 1) ELSE 0 END), 9) AS ap FROM e GROUP BY ALL",
    )
    add(
        "voc_eleven_points",
        lambda s, d: voc(s, d, 11).groupBy("label").agg(F.round(F.avg("ap"), 8).alias("ap")),
        f"WITH {VOC}, r AS (SELECT label, t, k, coalesce(max(prec) FILTER (rec >= k * 0.1::DOUBLE), 0) AS p FROM q, range(11) x(k) GROUP BY ALL), a AS (SELECT label, t, round(sum(p) / 11, 9) AS ap FROM r GROUP BY ALL) SELECT label, round(avg(ap), 8) AS ap FROM a GROUP BY 1",
    )
    coco = lambda s, d: evaluation.coco_evaluation(detections(s, d), truths(s, d), "image", "label", LEVELS, AREAS, LIMITS, 11)
    add("coco_matching", lambda s, d: evaluation.coco_matches_of(both(s, d), by, LEVELS, AREAS, max(LIMITS)).withColumn("place", F.col("place").cast("long")), f"WITH RECURSIVE {COCO} SELECT image, label, det_id, score, place, area, threshold, gt_id, ignored FROM m")
    add(
        "coco_precision",
        lambda s, d: coco(s, d)[0].select("label", "area", "threshold", "limit", "level", F.round("precision", 9).alias("precision")),
        f'WITH RECURSIVE {COCO_CURVE} SELECT label, area, threshold, lim AS "limit", k::INT AS level, round(precision::DOUBLE, 9) AS precision FROM precs',
    )
    add(
        "coco_mean_precision",
        lambda s, d: metrics.summarize(coco(s, d)[0], "precision", ["area", "limit"]).withColumn("mean", F.round("mean", 8)),
        f'WITH RECURSIVE {COCO_CURVE} SELECT area, lim AS "limit", round(coalesce(avg(precision) FILTER (precision > -1), -1)::DOUBLE, 8) AS mean FROM precs GROUP BY ALL',
    )
    add(
        "coco_mean_recall",
        lambda s, d: metrics.summarize(coco(s, d)[1], "recall", ["area", "limit"]).withColumn("mean", F.round("mean", 8)),
        f'WITH RECURSIVE {COCO_CURVE} SELECT area, lim AS "limit", round(coalesce(avg(recall) FILTER (recall > -1), -1)::DOUBLE, 8) AS mean FROM recs GROUP BY ALL',
    )

    def recall(s, d):
        return evaluation.box_recall_of(both(s, d, "l_suppkey"), "image", AREAS, [5, 40], TEN, ["label", "det_id"], ["label", "gt_id"]).withColumn("ar", F.round("ar", 9))

    add(
        "box_recall",
        recall,
        f"""WITH RECURSIVE {RECALL}, hits AS (SELECT name, lim, {' + '.join(f'count(*) FILTER (iou >= {t}::DOUBLE)' for t in TEN)} AS h FROM s WHERE took GROUP BY ALL)
        SELECT name AS area, lim AS "limit", positives, round(coalesce(h, 0) / positives / {len(TEN)}, 9) AS ar FROM np LEFT JOIN hits USING (name, lim)""",
    )

    every = lambda s, d: rows(s, d).select("image", "label", F.col("id").alias("det_id"), "score", "x0", "y0", "x1", "y1")
    add(
        "nms_large_groups",
        lambda s, d: evaluation.suppress(every(s, d), by, 0.6, "det_id", large=16),
        f"WITH RECURSIVE {DETECTIONS}, {suppressed_sql('SELECT * FROM det', 0.6)} SELECT image, label, det_id, score, x0, y0, x1, y1 FROM kept",
    )
