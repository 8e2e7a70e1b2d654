"""Queries of the decoding operators and of annotation files."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import metrics, poses
from brindle.registry import Registry
from brindle.session import table
from brindle.sources.annotation_files import mask_annotations


def register(registry: Registry) -> None:
    add = registry.add
    add(
        "label_palette",
        lambda s, d: table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 256).alias("label")).join(F.broadcast(poses.palette(s, 256)), "label").select("p_partkey", "label", "r", "g", "b"),
        """SELECT p_partkey, i AS label, (i & 1) * 128 + (i >> 3 & 1) * 64 + (i >> 6 & 1) * 32 AS r, (i >> 1 & 1) * 128 + (i >> 4 & 1) * 64 + (i >> 7 & 1) * 32 AS g, (i >> 2 & 1) * 128 + (i >> 5 & 1) * 64 AS b FROM (SELECT p_partkey, p_partkey % 256 AS i FROM part)""",
    )
    add(
        "detector_grid_decode",
        lambda s, d: poses.decode_grid(table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 84).alias("index"), (F.col("p_size") / 50).alias("dx"), (F.col("p_size") / 25).alias("dy"), (F.col("p_size") / 50).alias("dw"), F.lit(0.0).alias("dh")), poses.detector_grid(s, 64, 64, [8, 16, 32])).select("p_partkey", "index", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")]),
        """WITH g AS (SELECT i AS k, i % 8 AS gx, i // 8 AS gy, 8 AS s FROM range(64) t(i) UNION ALL SELECT 64 + i, i % 4, i // 4, 16 FROM range(16) t(i) UNION ALL SELECT 80 + i, i % 2, i // 2, 32 FROM range(4) t(i))
        SELECT p_partkey, k AS index, round((p_size / 50 + gx) * s, 6) AS cx, round((p_size / 25 + gy) * s, 6) AS cy, round(exp(p_size / 50) * s, 6) AS w, round(1.0::DOUBLE * s, 6) AS h FROM part JOIN g ON p_partkey % 84 = k""",
    )
    add(
        "axis_argmax",
        lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(poses.axis_argmax(F.col("embedding")), 6).alias("place"), (F.col("label") * 3).alias("i")).withColumn("pair", poses.triangular_index(F.col("i"), F.lit(7))).drop("i"),
        """SELECT vec_id, CASE WHEN list_max(embedding) > 0 THEN round((list_position(embedding, list_max(embedding)) - 1) / 2, 6) ELSE -1 END AS place,
        CAST(CASE WHEN label * 3 <> 7 THEN greatest(label * 3, 7) * (greatest(label * 3, 7) - 1) // 2 + least(label * 3, 7) END AS BIGINT) AS pair FROM embeddings""",
    )
    add(
        "panoptic_quality",
        lambda s, d: poses.panoptic_quality(table(s, d, "lineitem").select("l_returnflag", (0.5 + F.col("l_discount")).alias("iou"), F.when(F.col("l_linenumber") <= 3, "tp").when(F.col("l_linenumber") <= 5, "fp").otherwise("fn").alias("kind")), "l_returnflag").select("l_returnflag", *[F.round(c, 9).alias(c) for c in ("pq", "sq", "rq")]),
        """WITH t AS (SELECT l_returnflag, sum(0.5 + l_discount) FILTER (l_linenumber <= 3) AS s, count(*) FILTER (l_linenumber <= 3) AS tp, count(*) FILTER (l_linenumber > 3) AS x FROM lineitem GROUP BY 1)
        SELECT l_returnflag, round(s / (tp + 0.5 * x), 9) AS pq, round(s / tp, 9) AS sq, round(tp / (tp + 0.5 * x), 9)::DOUBLE AS rq FROM t""",
    )
    add(
        "uncertain_points",
        lambda s, d: poses.uncertain_points(table(s, d, "customer"), "c_nationkey", "c_acctbal", 5, ["c_custkey"]).select("c_nationkey", "c_custkey"),
        "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal), c_custkey) AS n FROM customer) WHERE n <= 5",
    )
    add(
        "proposals_with_truth",
        lambda s, d: poses.with_truth(table(s, d, "lineitem").filter("l_linenumber > 2").select("l_orderkey", F.col("l_discount").alias("logit")), table(s, d, "lineitem").filter("l_linenumber = 1").select("l_orderkey")).groupBy("l_orderkey").agg(F.count_if("is_truth").alias("truths"), F.count_if(~F.col("is_truth")).alias("proposals"), F.round(F.max("logit"), 5).alias("top")),
        "SELECT l_orderkey, count(*) FILTER (l_linenumber = 1) AS truths, count(*) FILTER (l_linenumber > 2) AS proposals, round(max(CASE WHEN l_linenumber = 1 THEN 23.02585 ELSE l_discount END), 5)::DOUBLE AS top FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1",
    )
    add(
        "mask_to_annotations",
        lambda s, d: mask_annotations(table(s, d, "lineitem").select((F.col("l_orderkey") % 50).alias("image_id"), (F.col("l_partkey") % 30).alias("x"), (F.col("l_suppkey") % 30).alias("y"), (F.col("l_linenumber") % 4).alias("value"))),
        """SELECT i AS image_id, v AS label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS area, CAST(row_number() OVER (ORDER BY i, v) AS INT) AS id
        FROM (SELECT l_orderkey % 50 AS i, l_partkey % 30 AS x, l_suppkey % 30 AS y, l_linenumber % 4 AS v FROM lineitem) WHERE v > 0 GROUP BY i, v""",
    )
    add(
        "average_recall",
        lambda s, d: metrics.average_recall(table(s, d, "lineitem"), F.col("l_discount") * 10, [0.1, 0.3, 0.5, 0.7], ["l_returnflag"]).withColumn("ar", F.round("ar", 9)),
        "SELECT l_returnflag, round((count(*) FILTER (l_discount * 10 >= 0.1) + count(*) FILTER (l_discount * 10 >= 0.3) + count(*) FILTER (l_discount * 10 >= 0.5) + count(*) FILTER (l_discount * 10 >= 0.7)) / count(*) / 4, 9) AS ar FROM lineitem GROUP BY 1",
    )
    add(
        "expected_results",
        lambda s, d: metrics.check_expected(table(s, d, "nation").select(F.lit("t").alias("task"), F.col("n_name").alias("metric"), F.col("n_nationkey").cast("double").alias("value")), table(s, d, "nation").select(F.lit("t").alias("task"), F.col("n_name").alias("metric"), (F.col("n_nationkey") + F.col("n_regionkey") * 0.01).alias("value"), F.lit(0.025).alias("tolerance"))).select("metric", "ok"),
        "SELECT n_name AS metric, n_regionkey <= 2 AS ok FROM nation",
    )
    number = lambda c, n, plus=0: (F.col(c) % n + plus).cast("double")
    box = lambda: (F.lit(5.0), F.lit(4.0), F.lit(45.0), (F.lit(44) + F.col("l_linenumber")).cast("double"))
    add(
        "keypoint_labels",
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", poses.heat_label(number("l_partkey", 60), number("l_suppkey", 55), F.col("l_linenumber") % 3, box(), 56).alias("h")).select("l_orderkey", "l_linenumber", "h.label", "h.valid"),
        """WITH p AS (SELECT l_orderkey, l_linenumber, (l_partkey % 60)::DOUBLE AS x, (l_suppkey % 55)::DOUBLE AS y, (44 + l_linenumber)::DOUBLE AS y1 FROM lineitem),
        c AS (SELECT *, CASE WHEN x = 45 THEN 55 ELSE floor((x - 5) * (56 / 40::DOUBLE)) END AS i, CASE WHEN y = y1 THEN 55 ELSE floor((y - 4) * (56 / (y1 - 4))) END AS j FROM p),
        v AS (SELECT *, i >= 0 AND i < 56 AND j >= 0 AND j < 56 AND l_linenumber % 3 > 0 AS valid FROM c)
        SELECT l_orderkey, l_linenumber, CAST(CASE WHEN valid THEN j * 56 + i ELSE 0 END AS BIGINT) AS label, valid FROM v""",
    )
    add(
        "pose_warp",
        lambda s, d: table(s, d, "lineitem")
        .select("l_orderkey", "l_linenumber", poses.center_scale((number("l_partkey", 60), number("l_suppkey", 50), number("l_partkey", 60, 40), (number("l_suppkey", 50) + F.col("l_linenumber") * 20)), 0.75).alias("k"))
        .select("*", poses.warp_matrix(F.col("k.cx"), F.col("k.cy"), F.col("k.w"), F.col("l_linenumber") * 15.0, 288.0, 384.0).alias("m"))
        .select("l_orderkey", "l_linenumber", *[F.round(f"k.{c}", 6).alias(c) for c in ("cx", "cy", "w", "h")], *[F.round(f"m.{c}", 6).alias(f"m_{c}") for c in "abcdef"]),
        """WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 60 + 20)::DOUBLE AS cx, (l_suppkey % 50 + l_linenumber * 10)::DOUBLE AS cy, 50::DOUBLE AS w0, (l_linenumber * 25)::DOUBLE AS h0, radians(l_linenumber * 15) AS t FROM lineitem),
        k AS (SELECT *, greatest(w0, h0 * 0.75) AS w, greatest(h0, w0 / 0.75) AS h FROM b)
        SELECT l_orderkey, l_linenumber, cx, cy, round(w, 6) AS w, round(h, 6) AS h, round(288 / w * cos(t), 6) AS m_a, round(288 / w * sin(t), 6) AS m_b, round(144 - 288 / w * (cos(t) * cx + sin(t) * cy), 6) AS m_c,
        round(-288 / w * sin(t), 6) AS m_d, round(288 / w * cos(t), 6) AS m_e, round(192 - 288 / w * (cos(t) * cy - sin(t) * cx), 6) AS m_f FROM k""",
    )
    joint = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    shoulder, elbow = lambda: joint(number("l_partkey", 97), number("l_suppkey", 41)), lambda: joint(number("l_partkey", 89, 10), number("l_suppkey", 43, 20))
    wrist = lambda: joint(number("l_orderkey", 101), number("l_orderkey", 83))
    add(
        "hand_boxes",
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", poses.hand_box(shoulder(), elbow(), F.when(F.col("l_linenumber") < 6, wrist()), F.lit(160.0), F.lit(120.0)).alias("b")).filter("b IS NOT NULL").select("l_orderkey", "l_linenumber", "b.*"),
        """WITH p AS (SELECT l_orderkey, l_linenumber, (l_partkey % 97)::DOUBLE AS ax, (l_suppkey % 41)::DOUBLE AS ay, (l_partkey % 89 + 10)::DOUBLE AS jx, (l_suppkey % 43 + 20)::DOUBLE AS jy, (l_orderkey % 101)::DOUBLE AS cx, (l_orderkey % 83)::DOUBLE AS cy FROM lineitem WHERE l_linenumber < 6),
        w AS (SELECT *, greatest(sqrt((cx - jx) * (cx - jx) + (cy - jy) * (cy - jy)), sqrt((jx - ax) * (jx - ax) + (jy - ay) * (jy - ay)) * 0.9) * 1.5 AS s FROM p),
        c AS (SELECT *, greatest(cx + (cx - jx) * 0.33 - s / 2, 0) AS x, greatest(cy + (cy - jy) * 0.33 - s / 2, 0) AS y FROM w),
        k AS (SELECT *, least(CASE WHEN x + s > 160 THEN 160 - x ELSE s END, CASE WHEN y + s > 120 THEN 120 - y ELSE s END) AS side FROM c)
        SELECT l_orderkey, l_linenumber, CAST(trunc(x) AS INT) AS x, CAST(trunc(y) AS INT) AS y, CAST(trunc(side) AS INT) AS side FROM k WHERE side >= 20""",
    )
    nose, eye = lambda: joint(number("l_partkey", 97, 20), number("l_suppkey", 41, 20)), lambda: joint(number("l_partkey", 97, 26), number("l_suppkey", 41, 15))
    add(
        "face_boxes",
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", poses.face_box(nose(), [F.when(F.col("l_linenumber") % 2 == 0, eye())], [F.when(F.col("l_linenumber") % 3 == 0, wrist())], F.lit(160.0), F.lit(120.0)).alias("b")).filter("b IS NOT NULL").select("l_orderkey", "l_linenumber", "b.*"),
        """WITH p AS (SELECT l_orderkey, l_linenumber, (l_partkey % 97 + 20)::DOUBLE AS nx, (l_suppkey % 41 + 20)::DOUBLE AS ny, (l_orderkey % 101)::DOUBLE AS ex, (l_orderkey % 83)::DOUBLE AS ey FROM lineitem),
        w AS (SELECT *, greatest(CASE WHEN l_linenumber % 2 = 0 THEN 18.0::DOUBLE END, CASE WHEN l_linenumber % 3 = 0 THEN greatest(abs(nx - ex), abs(ny - ey)) * 1.5 END) AS r FROM p),
        c AS (SELECT *, greatest(nx - r, 0) AS x, greatest(ny - r, 0) AS y FROM w WHERE r IS NOT NULL),
        k AS (SELECT *, least(CASE WHEN x + r > 160 THEN 160 - x ELSE 2 * r END, CASE WHEN y + r > 120 THEN 120 - y ELSE 2 * r END) AS side FROM c)
        SELECT l_orderkey, l_linenumber, CAST(trunc(x) AS INT) AS x, CAST(trunc(y) AS INT) AS y, CAST(trunc(side) AS INT) AS side FROM k WHERE side >= 20""",
    )
