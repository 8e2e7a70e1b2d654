"""Queries of heat maps, similarities of points and surfaces, and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.geometry import Box
from brindle.operators import metrics, poses, tracking
from brindle.plans.annotations import KEYS, TIES
from brindle.registry import Registry
from brindle.session import table

SIDE = 8
NODES = 26  # vertices 1 to 25, and 0 for none


def _maps(s, d) -> DataFrame:
    key = F.col("vec_id")
    heat = F.transform(F.slice("embedding", 1, SIDE * SIDE), lambda v: v.cast("double"))
    corner = ((key % 13) - 2.5).alias("x0"), ((key % 7) + 0.25).alias("y0")
    return table(s, d, "embeddings").select("vec_id", heat.alias("heat"), *corner, ((key * 7 % 61) / 4.0).alias("w"), ((key * 11 % 53) / 4.0).alias("h"))


HEAT = f"""WITH b AS (SELECT vec_id, (vec_id % 13) - 2.5::DOUBLE AS x0, (vec_id % 7) + 0.25::DOUBLE AS y0, greatest(1, (vec_id * 7 % 61) / 4.0::DOUBLE) AS w, greatest(1, (vec_id * 11 % 53) / 4.0::DOUBLE) AS h FROM embeddings),
m AS (SELECT vec_id, (i - 1) // {SIDE} AS r, (i - 1) % {SIDE} AS c, embedding[i]::DOUBLE AS v FROM embeddings, range(1, {SIDE * SIDE + 1}) t(i)),
n AS (SELECT DISTINCT n FROM (SELECT ceil(w)::INT AS n FROM b UNION ALL SELECT ceil(h)::INT FROM b)),
g AS (SELECT n, t, (t + 0.5::DOUBLE) * {SIDE} / n - 0.5 AS p, k FROM (SELECT n, unnest(range(n)) AS t FROM n), range(-1, 3) q(k)),
f AS (SELECT n, t, greatest(0, least({SIDE - 1}, floor(p) + k))::BIGINT AS s, abs(p - floor(p) - k) AS a FROM g),
z AS (SELECT n, t, s, sum(CASE WHEN a < 1 THEN 1.25 * a ** 3 - 2.25 * a ** 2 + 1 ELSE -0.75 * a ** 3 + 3.75 * a ** 2 - 6 * a + 3 END) AS wt FROM f GROUP BY ALL),
u AS (SELECT b.vec_id, zy.t AS ty, zx.t AS tx, sum(v * zy.wt * zx.wt) AS value FROM b JOIN m USING (vec_id) JOIN z zy ON zy.n = ceil(h) AND zy.s = r JOIN z zx ON zx.n = ceil(w) AND zx.s = c GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, ty, tx) AS place FROM u)
SELECT vec_id, round((tx + 0.5) * (w / ceil(w)) + x0, 6) AS x, round((ty + 0.5) * (h / ceil(h)) + y0, 6) AS y, round(value, 6) AS logit, round((SELECT 1 / sum(exp(v - value)) FROM m WHERE m.vec_id = o.vec_id), 6) AS score FROM o JOIN b USING (vec_id) WHERE place = 1"""


def _surface(s, d) -> DataFrame:
    points = table(s, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % NODES).alias("vertex"), (F.col("l_suppkey") % NODES).alias("truth_vertex"))
    distances = table(s, d, "part").select((F.col("p_partkey") - 1).alias("place"), (F.col("p_size") / 20.0).alias("distance"))
    spreads = table(s, d, "nation").select((F.col("n_nationkey") + 1).alias("vertex"), (0.5 + F.col("n_regionkey") * 0.25).alias("spread"))
    return metrics.surface_similarity(points, ["l_orderkey"], distances, spreads).select("l_orderkey", F.round("similarity", 9).alias("similarity"))


def _hidden(s, d) -> DataFrame:
    """Three key points for each line; none is visible where the line number is even."""
    joint = lambda k: F.struct((F.col("l_partkey") % (50 + k)).cast("double").alias("x"), (F.col("l_suppkey") % (30 + k)).cast("double").alias("y"), F.when((F.col("l_linenumber") % 2 == 0) | (F.col("l_linenumber") + k == 3), 0).otherwise(2).alias("v"))
    rows = table(s, d, "lineitem").withColumn("truth", F.array(*map(joint, range(3))))
    found = F.transform("truth", lambda q, k: F.struct(((F.col("l_partkey") + k) % 90).cast("double").alias("x"), (q["y"] + 1).alias("y")))
    box = Box(*(F.lit(float(v)) for v in (20, 10, 40, 25)))
    return rows.select("l_orderkey", *TIES, F.round(metrics.keypoint_similarity(found, F.col("truth"), F.col("l_quantity") * 10, [0.5, 1.0, 2.0], box), 9).alias("oks"))


def _hidden_sql() -> str:
    seen = lambda k: f"(l_linenumber % 2 = 1 AND l_linenumber + {k} <> 3)"
    x, y = (lambda k: f"((l_partkey + {k}) % 90)"), (lambda k: f"(l_suppkey % {30 + k} + 1)")
    share = lambda k, dx, dy: f"exp(-(power({dx}, 2) + power({dy}, 2)) / {(0.5, 1.0, 2.0)[k]}::DOUBLE / (l_quantity * 10) / 2)"
    near = [f"CASE WHEN {seen(k)} THEN {share(k, f'{x(k)} - l_partkey % {50 + k}', 1)} ELSE 0 END" for k in range(3)]
    away = [share(k, f"CASE WHEN {x(k)} < 0 THEN 0 - {x(k)} WHEN {x(k)} > 60 THEN {x(k)} - 60 ELSE 0 END", f"CASE WHEN {y(k)} < -5 THEN -5 - {y(k)} WHEN {y(k)} > 40 THEN {y(k)} - 40 ELSE 0 END") for k in range(3)]
    count = " + ".join(f"{seen(k)}::INT" for k in range(3))
    return f"SELECT {KEYS}, round(CASE WHEN {count} > 0 THEN ({' + '.join(near)}) / ({count}) ELSE ({' + '.join(away)}) / 3 END, 9) AS oks FROM lineitem"


def _detections(s, d) -> DataFrame:
    """Suppliers as videos, orders as frames, lines as detections."""
    x, y = F.col("l_partkey") % 3, F.col("l_linenumber") % 2
    return table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("video"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("det_id"), (F.col("l_linenumber") % 2).cast("long").alias("label"),
        x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 8 + F.col("l_quantity") % 4).cast("double").alias("x1"), (y + 9).cast("double").alias("y1"),
    )


def register(registry: Registry) -> None:
    add = registry.add
    add(
        "heat_map_points",
        lambda s, d: poses.heat_points(_maps(s, d), "heat", SIDE, (F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))).select("vec_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "logit", "score")]),
        HEAT,
    )
    add(
        "surface_similarity",
        _surface,
        f"""WITH p AS (SELECT l_orderkey, l_partkey % {NODES} AS v, l_suppkey % {NODES} AS t FROM lineitem), i AS (SELECT *, greatest(v, t) - 1 AS a, least(v, t) - 1 AS b FROM p),
        j AS (SELECT i.*, p_size / 20.0::DOUBLE AS far, 0.5::DOUBLE + n_regionkey * 0.25 AS spread FROM i LEFT JOIN part ON v > 0 AND t > 0 AND v <> t AND p_partkey - 1 = a * (a - 1) // 2 + b LEFT JOIN nation ON n_nationkey + 1 = t)
        SELECT l_orderkey, round(coalesce(avg(CASE WHEN v = t THEN 1 WHEN v = 0 OR far IS NULL THEN 0 ELSE exp(-far * far / (2 * spread * spread)) END) FILTER (WHERE t > 0), 0), 9) AS similarity FROM j GROUP BY ALL""",
    )
    add("keypoint_similarity_hidden", _hidden, _hidden_sql())
    add("tracked_instances", lambda s, d: tracking.track(_detections(s, d)))
