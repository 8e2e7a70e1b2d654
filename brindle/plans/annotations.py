"""Queries of the annotation operators on boxes derived from ``lineitem``: an image is an order, a category a return flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import geometry
from brindle.functions.geometry import Box
from brindle.operators import datasets, matching, metrics, sampling
from brindle.registry import Registry
from brindle.session import table

TIES = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice"
BOXES = "(SELECT *, l_partkey % 100 AS x0, l_suppkey % 100 AS y0, l_partkey % 100 + l_quantity AS x1, l_suppkey % 100 + l_linenumber * 5 AS y1 FROM lineitem)"


def boxes(s, d) -> DataFrame:
    b = Box.from_xywh((F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double"), F.col("l_quantity"), F.col("l_linenumber") * 5.0)
    return table(s, d, "lineitem").select("*", *b.columns())


def _curve(s, d) -> DataFrame:
    found = boxes(s, d).filter("l_linestatus = 'O'").withColumn("hit", F.col("l_quantity") > 25)
    n = found.groupBy("l_returnflag").agg(F.count_if("hit").alias("positives"))
    return metrics.precision_recall(found.join(F.broadcast(n), "l_returnflag"), ["l_returnflag"], "l_discount", "hit", "positives", ["l_orderkey", *TIES])


CURVE = f"""c AS (SELECT *, l_quantity > 25 AS hit FROM lineitem WHERE l_linestatus = 'O'), n AS (SELECT l_returnflag, count(*) FILTER (hit) AS p FROM c GROUP BY 1),
r AS (SELECT c.*, row_number() OVER o AS seen, sum(hit::INT) OVER o AS tp, n.p FROM c JOIN n USING (l_returnflag) WINDOW o AS (PARTITION BY l_returnflag ORDER BY l_discount DESC, {KEYS})),
q AS (SELECT *, tp / greatest(p, 1) AS recall, tp / seen AS prec FROM r), e AS (SELECT *, max(prec) OVER (PARTITION BY l_returnflag ORDER BY seen ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env,
recall - lag(recall, 1, 0) OVER (PARTITION BY l_returnflag ORDER BY seen) AS step FROM q)"""


DETECTIONS = f"""det AS (SELECT l_suppkey AS image, l_returnflag AS label, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY {KEYS}) AS det_id, l_discount AS score, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM {BOXES})"""


def _iou_sql(a: str, b: str) -> str:
    both = f"greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    return f"({both}) / (({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0) + ({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0) - {both})"


def suppressed_sql(source: str, threshold: float) -> str:
    """Suppression step by step: row n of each group stays if it overlaps none that stayed."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY image, label ORDER BY score DESC, det_id) AS n, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} AS b FROM ({source})),
    s AS (SELECT image, label, n, [b] AS boxes, true AS stays, det_id FROM o WHERE n = 1
    UNION ALL SELECT o.image, o.label, o.n, CASE WHEN t.ok THEN list_append(t.boxes, o.b) ELSE t.boxes END, t.ok, o.det_id FROM o JOIN LATERAL (SELECT s.boxes, len(list_filter(s.boxes, lambda k: {_iou_sql('k', 'o.b')} > {threshold})) = 0 AS ok FROM s WHERE s.image = o.image AND s.label = o.label AND s.n = o.n - 1) t ON true),
    kept AS (SELECT o.* FROM o JOIN s USING (image, label, n) WHERE s.stays)"""


MATCHED = f"""pairs AS (SELECT a.image, a.label, a.det_id, b.det_id AS gt, {_iou_sql('a', 'b')} AS iou FROM det a JOIN det b USING (image, label) WHERE a.det_id % 2 = 0 AND b.det_id % 2 <> 0),
near AS (SELECT image, label, det_id, list({{'gt': gt, 'iou': iou}} ORDER BY iou DESC, gt) AS c FROM pairs WHERE iou >= 0.3 GROUP BY ALL),
o AS (SELECT d.image, d.label, d.det_id, d.score, coalesce(c, []) AS c, row_number() OVER (PARTITION BY d.image, d.label ORDER BY d.score DESC, d.det_id) AS n FROM det d LEFT JOIN near USING (image, label, det_id) WHERE d.det_id % 2 = 0),
g AS (SELECT image, label, n, det_id, score, c[1] AS hit, list_filter([c[1].gt], lambda x: x IS NOT NULL) AS taken FROM o WHERE n = 1
UNION ALL SELECT o.image, o.label, o.n, o.det_id, o.score, list_filter(o.c, lambda k: NOT list_contains(g.taken, k.gt))[1], list_filter(list_append(g.taken, list_filter(o.c, lambda k: NOT list_contains(g.taken, k.gt))[1].gt), lambda x: x IS NOT NULL) FROM o JOIN g ON o.image = g.image AND o.label = g.label AND o.n = g.n + 1),
m AS (SELECT image, label, det_id, score, hit.gt AS gt_id, coalesce(hit.iou, 0.0) AS iou FROM g)"""


def register(registry: Registry) -> None:
    add = registry.add
    cats = lambda s, d: table(s, d, "lineitem").select("l_returnflag").distinct()
    add(
        "category_histogram",
        lambda s, d: datasets.category_histogram(table(s, d, "lineitem"), cats(s, d), "l_returnflag", F.col("l_linestatus") == "O"),
        "SELECT l_returnflag, count(*) FILTER (l_linestatus <> 'O') AS n FROM lineitem GROUP BY ROLLUP (l_returnflag)",
    )
    add(
        "contiguous_categories",
        lambda s, d: datasets.contiguous(table(s, d, "part"), "p_type"),
        "SELECT p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INT) AS contiguous_id FROM (SELECT DISTINCT p_type FROM part)",
    )
    add(
        "repeat_factors",
        lambda s, d: datasets.repeat_factors(table(s, d, "lineitem"), "l_orderkey", "l_returnflag", 0.9).withColumn("factor", F.round("factor", 9)),
        """WITH f AS (SELECT l_returnflag, count(DISTINCT l_orderkey) / (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS f FROM lineitem GROUP BY 1)
        SELECT l_orderkey, round(max(greatest(1.0, sqrt(0.9 / f))), 9) AS factor FROM lineitem JOIN f USING (l_returnflag) GROUP BY 1""",
    )
    images = lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_linestatus") == "O").cast("long").alias("iscrowd"), F.ascii("l_returnflag").cast("long").alias("category_id"), F.array(F.col("l_quantity"), F.lit(1.0), F.col("l_linenumber") - 3.0).alias("keypoints"))).alias("annotations"))
    add(
        "image_filters",
        lambda s, d: datasets.with_keypoints(datasets.with_plain_annotations(images(s, d)), 2).select("l_orderkey", F.size("annotations").alias("n")),
        "SELECT l_orderkey, CAST(count(*) AS INT) AS n FROM lineitem GROUP BY 1 HAVING bool_or(l_linestatus <> 'O') AND count(*) FILTER (l_linenumber > 3) >= 2",
    )
    add(
        "category_whitelist",
        lambda s, d: datasets.keep_categories(images(s, d), {ord("A"): 0, ord("R"): 1}).select("l_orderkey", F.aggregate("annotations", F.lit(0).cast("long"), lambda a, x: a + x["category_id"]).alias("ones")),
        "SELECT l_orderkey, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS ones FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1",
    )
    add(
        "required_join",
        lambda s, d: datasets.required_join(table(s, d, "orders").select("o_custkey", "o_orderkey"), table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("o_orderkey", "c_name"),
        "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    )
    add(
        "merge_right_wins",
        lambda s, d: datasets.merge_right_wins(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), table(s, d, "nation").filter("n_nationkey % 2 = 0").select("n_nationkey", F.when(F.col("n_nationkey") % 4 == 0, F.lower("n_name")).alias("n_name")), "n_nationkey"),
        "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey % 2 = 0",
    )

    def geometry_query(s, d):
        b = boxes(s, d)
        box, other = Box.of(), Box.from_xywh(F.lit(20.0), F.lit(30.0), F.lit(40.0), F.lit(25.0))
        clipped = box.clip(90, 80)
        turned = geometry.rotated_bounds(*box.center(), box.width, box.height, F.col("l_linenumber") * 30.0)
        back = geometry.decode_deltas(other, geometry.encode_deltas(other, box, (5.0, 5.0, 10.0, 10.0)), (5.0, 5.0, 10.0, 10.0))
        made = {"area": box.area, "clipped": clipped.area, "keep": clipped.nonempty(), "overlap": F.round(geometry.iou(box, other), 9), "wide": F.round(turned.width, 6), "x1_back": F.round(back.x1, 6), "angle": geometry.wrap_angle(F.col("l_linenumber") * 100.0), "level": geometry.pyramid_level(box.area * 40, 2, 5), "bin": geometry.bisect_right(box.width / box.height, [0.5, 1, 2])}
        return b.select(*TIES, "l_orderkey", *[v.alias(k) for k, v in made.items()])

    add(
        "box_geometry",
        geometry_query,
        f"""SELECT {KEYS}, l_quantity * (l_linenumber * 5) AS area, (greatest(least(x1, 90), 0) - greatest(least(x0, 90), 0)) * (greatest(least(y1, 80), 0) - greatest(least(y0, 80), 0))::DOUBLE AS clipped,
        least(x1, 90) > least(x0, 90) AND least(y1, 80) > least(y0, 80) AS keep,
        round(CASE WHEN least(x1, 60) > greatest(x0, 20) AND least(y1, 55) > greatest(y0, 30) THEN (least(x1, 60) - greatest(x0, 20)) * (least(y1, 55) - greatest(y0, 30)) / (l_quantity * l_linenumber * 5 + 1000 - (least(x1, 60) - greatest(x0, 20)) * (least(y1, 55) - greatest(y0, 30))) ELSE 0 END, 9) AS overlap,
        round(abs(cos(radians(l_linenumber * 30.0))) * l_quantity + abs(sin(radians(l_linenumber * 30.0))) * l_linenumber * 5, 6) AS wide, round(x1, 6) AS x1_back,
        CAST((l_linenumber * 100 + 180) % 360 - 180 AS DOUBLE) AS angle, CAST(greatest(2, least(5, floor(4 + log2(sqrt(l_quantity * l_linenumber * 200) / 224 + 1e-8)))) AS BIGINT) AS level,
        CAST((l_quantity / (l_linenumber * 5) >= 0.5)::INT + (l_quantity / (l_linenumber * 5) >= 1)::INT + (l_quantity / (l_linenumber * 5) >= 2)::INT AS BIGINT) AS bin FROM {BOXES}""",
    )

    def sides(s, d):
        b = boxes(s, d).withColumn("id", F.xxhash64("l_orderkey", *TIES))
        # A row key that both engines can state: its place in its order.
        b = b.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*TIES)))
        left, right = b.filter("l_linestatus = 'O'"), b.filter("l_linestatus <> 'O'")
        name = lambda df, p: df.select("l_orderkey", F.col("k").cast("long").alias(f"{p}id"), *[F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")])
        return name(left, "a_"), name(right, "b_")

    pairs_sql = f"""k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS k FROM {BOXES}),
    a AS (SELECT l_orderkey, k AS a_id, x0, y0, x1, y1 FROM k WHERE l_linestatus = 'O'), b AS (SELECT l_orderkey, k AS b_id, x0, y0, x1, y1 FROM k WHERE l_linestatus <> 'O'),
    i AS (SELECT l_orderkey, a_id, b_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS v, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS t FROM a JOIN b USING (l_orderkey)),
    p AS (SELECT l_orderkey, a_id, b_id, v / (t - v) AS iou FROM i)"""
    add(
        "pairwise_overlap",
        lambda s, d: geometry.overlapping(*sides(s, d), "l_orderkey").select("l_orderkey", "a_id", "b_id", F.round("iou", 9).alias("iou")),
        f"WITH {pairs_sql} SELECT l_orderkey, a_id, b_id, round(iou, 9) AS iou FROM p WHERE iou > 0",
    )

    def best(s, d):
        pairs = geometry.pairwise_iou(*sides(s, d), "l_orderkey").select((F.col("l_orderkey") * 100 + F.col("a_id")).alias("a"), (F.col("l_orderkey") * 100 + F.col("b_id")).alias("b"), "iou")
        return matching.best_match(pairs, "a", "b", 0.1, 0.3).withColumn("iou", F.round("iou", 9))

    add(
        "best_match",
        best,
        f"""WITH {pairs_sql}, q AS (SELECT l_orderkey * 100 + a_id AS a, l_orderkey * 100 + b_id AS b, iou FROM p),
        m AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY iou DESC, b) AS n FROM q), s AS (SELECT DISTINCT a FROM (SELECT a, iou, rank() OVER (PARTITION BY b ORDER BY iou DESC) AS r FROM q) WHERE r = 1 AND iou > 0)
        SELECT a, b AS match, round(iou, 9) AS iou, CASE WHEN a IN (SELECT a FROM s) OR iou >= 0.3 THEN 1 WHEN iou < 0.1 THEN 0 ELSE -1 END AS label FROM m WHERE n = 1""",
    )
    add(
        "top_k_per_group",
        lambda s, d: matching.level_then_image_top_k(boxes(s, d), "l_suppkey", "l_returnflag", [F.desc("l_discount"), "l_orderkey", *TIES], 5, 8).select("l_suppkey", "l_returnflag", "l_discount", "l_orderkey", "l_partkey"),
        """SELECT l_suppkey, l_returnflag, l_discount, l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS m FROM (
        SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_discount DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS n FROM lineitem) WHERE n <= 5) WHERE m <= 8""",
    )
    add("average_precision", lambda s, d: metrics.average_precision(_curve(s, d), ["l_returnflag"]).withColumn("ap", F.round("ap", 9)), f"WITH {CURVE} SELECT l_returnflag, round(sum(step * env), 9) AS ap FROM e GROUP BY 1")
    add(
        "interpolated_precision",
        lambda s, d: metrics.interpolated_precision(_curve(s, d), ["l_returnflag"], 11).withColumn("ap", F.round("ap", 9)),
        f"""WITH {CURVE}, l AS (SELECT i / 10 AS lv FROM range(11) t(i)), b AS (SELECT l_returnflag, lv, max(env) AS p FROM e, l WHERE lv <= recall + 1e-12 GROUP BY ALL) SELECT l_returnflag, round(sum(p) / 11, 9) AS ap FROM b GROUP BY 1""",
    )
    add("confusion_matrix", lambda s, d: metrics.confusion(table(s, d, "labels"), "quality", "toxic"), "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
    scores = lambda s, d: metrics.class_scores(metrics.confusion(table(s, d, "labels"), "quality", "toxic"), s.range(4).select(F.col("id").cast("int").alias("class")), "quality", "toxic")
    scores_sql = """c AS (SELECT i AS k, count(*) FILTER (quality = i AND toxic = i) AS tp, count(*) FILTER (quality = i) AS t, count(*) FILTER (toxic = i) AS p FROM labels, range(4) r(i) GROUP BY i)"""
    add("class_iou", lambda s, d: scores(s, d).select("class", "tp", "n_truth", "n_predicted", F.round("iou", 9).alias("iou"), F.round("recall", 9).alias("recall")), f"WITH {scores_sql} SELECT CAST(k AS INT) AS class, tp, t AS n_truth, p AS n_predicted, round(tp / greatest(1, t + p - tp), 9) AS iou, round(tp / greatest(1, t), 9) AS recall FROM c")
    add(
        "segmentation_summary",
        lambda s, d: metrics.segmentation_summary(scores(s, d)).select(*[F.round(c, 9).alias(c) for c in ("pixel_acc", "mean_acc", "mean_iou", "fw_iou")]),
        f"WITH {scores_sql} SELECT round(sum(tp) / sum(t), 9) AS pixel_acc, round(sum(tp / greatest(1, t)) / count(*) FILTER (t > 0), 9) AS mean_acc, round(sum(tp / greatest(1, t + p - tp)) / count(*) FILTER (t + p > 0), 9) AS mean_iou, round(sum(t * tp / greatest(1, t + p - tp)) / sum(t), 9) AS fw_iou FROM c",
    )
    add(
        "balance_weights",
        lambda s, d: metrics.balance_weights(table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")), "n").withColumn("weight", F.round("weight", 9)),
        "SELECT l_returnflag, n, round((sum(n) OVER () - n) / sum(n) OVER () / greatest(count(*) OVER () - 1, 1), 9) AS weight FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)",
    )
    add(
        "soft_losses",
        lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(metrics.soft_dice(F.col("l_discount"), (F.col("l_quantity") > 25).cast("double")), 6).alias("dice"), F.round(metrics.tversky(F.col("l_discount"), (F.col("l_quantity") > 25).cast("double")), 6).alias("tversky")),
        """WITH t AS (SELECT l_returnflag, l_discount AS p, (l_quantity > 25)::INT AS g FROM lineitem) SELECT l_returnflag, round(1 - (2 * sum(p * g) + 1) / (sum(p) + sum(g) + 1), 6) AS dice,
        round(1 - (sum(p * g) + 1) / (sum(p * g) + 0.3::DOUBLE * sum(p * (1 - g)) + 0.7::DOUBLE * sum((1 - p) * g) + 1), 6) AS tversky FROM t GROUP BY 1""",
    )
    add(
        "jaccard_gradient",
        lambda s, d: metrics.jaccard_gradient(table(s, d, "lineitem").withColumn("g", (F.col("l_quantity") > 25).cast("int")), ["l_returnflag"], "l_discount", "g", ["l_orderkey", *TIES]).groupBy("l_returnflag").agg(F.round(F.sum(F.col("gradient") * F.col("l_discount")), 6).alias("loss")),
        f"""WITH t AS (SELECT *, (l_quantity > 25)::INT AS g FROM lineitem), j AS (SELECT l_returnflag, l_discount, row_number() OVER o AS n, 1 - (sum(g) OVER (PARTITION BY l_returnflag) - sum(g) OVER o) / (sum(g) OVER (PARTITION BY l_returnflag) + sum(1 - g) OVER o) AS j FROM t
        WINDOW o AS (PARTITION BY l_returnflag ORDER BY l_discount DESC, {KEYS} ROWS UNBOUNDED PRECEDING)), k AS (SELECT l_returnflag, l_discount * (j - lag(j, 1, 0) OVER (PARTITION BY l_returnflag ORDER BY n)) AS v FROM j) SELECT l_returnflag, round(sum(v), 6) AS loss FROM k GROUP BY 1""",
    )
    add(
        "group_batches",
        lambda s, d: sampling.group_batches(table(s, d, "orders"), "o_orderstatus", ["o_orderkey"], 16).select("o_orderkey", "o_orderstatus", "batch"),
        "SELECT o_orderkey, o_orderstatus, CAST((n - 1) // 16 AS BIGINT) AS batch FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_orderstatus) AS c FROM orders) WHERE (n - 1) // 16 < c // 16",
    )
    add(
        "rank_shards",
        lambda s, d: table(s, d, "customer").select("c_custkey", sampling.contiguous_shard(F.col("c_custkey"), table(s, d, "customer").count(), 7).alias("shard"), sampling.interleaved_shard(F.col("c_custkey"), 7).alias("turn")),
        "SELECT c_custkey, CAST(c_custkey // CAST(ceil((SELECT count(*) FROM customer) / 7) AS BIGINT) AS BIGINT) AS shard, c_custkey % 7 AS turn FROM customer",
    )
    add(
        "anchor_grid",
        lambda s, d: geometry.anchors(s, [32, 64], [0.25, 1, 4], 4, 3, 5).select("row", "column", "cell", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")]),
        """WITH c AS (SELECT (row_number() OVER (ORDER BY s, r) - 1)::INT AS cell, sqrt(s * s / r) AS w, sqrt(s * s / r) * r AS h FROM (VALUES (32), (64)) a(s), (VALUES (0.25), (1), (4)) b(r))
        SELECT i AS row, CAST(j AS INT) AS "column", cell, round(j * 4 - w / 2, 6) AS x0, round(i * 4 - h / 2, 6) AS y0, round(j * 4 + w / 2, 6) AS x1, round(i * 4 + h / 2, 6) AS y1 FROM range(3) p(i), range(5) q(j), c""",
    )

    def detections(s, d):
        number = F.row_number().over(Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_orderkey", *TIES)).cast("long")
        return boxes(s, d).select(F.col("l_suppkey").alias("image"), F.col("l_returnflag").alias("label"), number.alias("det_id"), F.col("l_discount").alias("score"), "x0", "y0", "x1", "y1")

    add(
        "nms_per_class",
        lambda s, d: matching.non_maximum_suppression(detections(s, d), ["image", "label"], 0.5, ties=["det_id"]),
        f"WITH RECURSIVE {DETECTIONS}, {suppressed_sql('SELECT * FROM det', 0.5)} SELECT image, label, det_id, score, x0, y0, x1, y1 FROM kept",
    )
    add(
        "detections_per_image",
        lambda s, d: matching.detections_per_image(detections(s, d), "image", "label", 0.5, 0.02, 10, ["label", "det_id"]),
        f"""WITH RECURSIVE {DETECTIONS}, {suppressed_sql('SELECT * FROM det WHERE score > 0.02', 0.5)}
        SELECT image, label, det_id, score, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, label, det_id) AS place FROM kept) WHERE place <= 10""",
    )

    def matched(s, d):
        odd = F.col("det_id") % 2 != 0
        rows = detections(s, d).select("image", "label", odd.alias("truth"), F.when(odd, F.col("det_id")).alias("gt_id"), F.when(~odd, F.col("det_id")).alias("det_id"), "score", "x0", "y0", "x1", "y1")
        return matching.greedy_match_of(rows, ["image", "label"], 0.3, ["det_id"])

    add("greedy_detection_match", lambda s, d: matched(s, d).withColumn("iou", F.round("iou", 9)), f"WITH RECURSIVE {DETECTIONS}, {MATCHED} SELECT image, label, det_id, score, gt_id, round(iou, 9) AS iou, gt_id IS NOT NULL AS hit FROM m")

    # Thresholds, area ranges and limits: a detection hits if its quantity is great enough for the threshold.
    areas = {"all": (0.0, 1e9), "small": (0.0, 3e4), "large": (3e4, 1e9)}

    def coco(s, d):
        lines, price = table(s, d, "lineitem"), F.col("l_extendedprice")
        inside = {a: (price >= lo) & (price < hi) for a, (lo, hi) in areas.items()}
        per = lines.groupBy("l_returnflag").agg(F.array(*[F.struct(F.lit(a).alias("area"), F.count_if(c & (F.col("l_quantity") > 20)).alias("positives")) for a, c in inside.items()]).alias("n"))
        n = per.select("l_returnflag", F.explode("n").alias("n")).select("l_returnflag", "n.*")
        options = [{"threshold": t, "area": a, "most": m} for t in (0.5, 0.75) for a in areas for m in (2, 100)]
        # What the codes are made of is told once for each line: long expressions with nulls would not be compiled.
        hits = {t: F.col("l_quantity") > 50 * t for t in (0.5, 0.75)}
        facts = {f"in_{a}": c & (F.col("l_tax") <= 0.06) for a, c in inside.items()} | {f"hit_{t}": c for t, c in hits.items()} | {f"miss_{t}": ~c for t, c in hits.items()} | {f"most_{m}": F.col("l_linenumber") <= m for m in (2, 100)}
        rows = lines.select("l_orderkey", *TIES, "l_returnflag", "l_discount", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in facts.items()])
        f = lambda name, v: F.col(f"`{name}_{v}`")
        codes = [F.when(f("most", o["most"]), F.when(f("in", o["area"]) & f("hit", o["threshold"]), 1).when(f("in", o["area"]) & f("miss", o["threshold"]), 2).otherwise(0)) for o in options]
        return metrics.accumulate_codes(rows, n, "l_returnflag", options, codes, "l_discount", ["l_orderkey", *TIES], 11)

    coco_sql = f"""r AS (SELECT * FROM lineitem), a AS (SELECT * FROM (VALUES ('all', 0.0, 1e9), ('small', 0.0, 3e4), ('large', 3e4, 1e9)) v(area, lo, hi)),
    n AS (SELECT l_returnflag, area, count(*) FILTER (l_extendedprice >= lo AND l_extendedprice < hi AND l_quantity > 20) AS p FROM r, a GROUP BY ALL),
    f AS (SELECT r.*, threshold, area, most, l_quantity > 50 * threshold AS hit, l_extendedprice < lo OR l_extendedprice >= hi OR l_tax > 0.06 AS ign FROM r, a, (VALUES (0.5), (0.75)) t(threshold), (VALUES (2), (100)) k(most) WHERE l_linenumber <= most),
    c AS (SELECT threshold, l_returnflag, area, most, p, sum((hit AND NOT ign)::INT) OVER o AS tp, sum((NOT hit AND NOT ign)::INT) OVER o AS fp, row_number() OVER o AS place FROM f JOIN n USING (l_returnflag, area) WINDOW o AS (PARTITION BY threshold, l_returnflag, area, most ORDER BY l_discount DESC, {KEYS} ROWS UNBOUNDED PRECEDING)),
    q AS (SELECT *, tp / nullif(p, 0) AS rc, tp / (tp + fp + power(2.0, -52)) AS pr FROM c), e AS (SELECT *, max(pr) OVER (PARTITION BY threshold, l_returnflag, area, most ORDER BY place DESC) AS env FROM q),
    g AS (SELECT DISTINCT threshold, l_returnflag, area, most, p FROM e),
    precs AS (SELECT g.threshold, g.l_returnflag, g.area, g.most, k AS level, CASE WHEN g.p = 0 THEN -1.0 ELSE coalesce((SELECT max(env) FROM e WHERE e.threshold = g.threshold AND e.l_returnflag = g.l_returnflag AND e.area = g.area AND e.most = g.most AND rc >= k / 10), 0) END AS prec FROM g, range(11) x(k)),
    recs AS (SELECT threshold, l_returnflag, area, most, CASE WHEN max(p) = 0 THEN -1.0 ELSE max(rc) END AS recall FROM e GROUP BY ALL)"""
    add(
        "coco_accumulate",
        lambda s, d: coco(s, d)[0].select(F.col("threshold").cast("double").alias("threshold"), "l_returnflag", "area", "most", "level", F.round("precision", 9).alias("precision")),
        f"WITH {coco_sql} SELECT CAST(threshold AS DOUBLE) AS threshold, l_returnflag, area, most, CAST(level AS INT) AS level, round(CAST(prec AS DOUBLE), 9) AS precision FROM precs",
    )
    add(
        "coco_summary",
        lambda s, d: metrics.summarize(coco(s, d)[0], "precision", ["area", "most"]).withColumn("mean", F.round("mean", 8)),
        f"WITH {coco_sql} SELECT area, most, round(CAST(coalesce(avg(prec) FILTER (prec > -1), -1) AS DOUBLE), 8) AS mean FROM precs GROUP BY ALL",
    )
    add(
        "coco_recall",
        lambda s, d: metrics.summarize(coco(s, d)[1], "recall", ["area", "most"]).withColumn("mean", F.round("mean", 8)),
        f"WITH {coco_sql} SELECT area, most, round(CAST(coalesce(avg(recall) FILTER (recall > -1), -1) AS DOUBLE), 8) AS mean FROM recs GROUP BY ALL",
    )
