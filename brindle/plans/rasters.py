"""Queries of polygon fills, pasted masks and grown instances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import geometry
from brindle.functions.geometry import Box
from brindle.operators import rasters, regions
from brindle.plans.pixels import HEIGHT, IMAGES, WIDTH, _canvases
from brindle.registry import Registry
from brindle.session import table

# Two polygons for each part, of five and three points; edges cross, and some points lie outside the image.
POINTS = (5, 3)
VERTICES = "(SELECT p_partkey, p AS part, j, n, ((p_partkey * (7 + 2 * j) + j * 11 + p * 23) % 140) / 4.0::DOUBLE - 2 AS px, ((p_size * (5 + j) + p_partkey * 3 + j * 17 + p * 29) % 112) / 4.0::DOUBLE - 2 AS py FROM part, (VALUES (0, 5), (1, 3)) q(p, n), range(5) r(j) WHERE j < n)"


def _polygons(s, d) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    point = lambda p, j: (((key * (7 + 2 * j) + j * 11 + p * 23) % 140) / 4.0 - 2, ((size * (5 + j) + key * 3 + j * 17 + p * 29) % 112) / 4.0 - 2)
    return table(s, d, "part").select("p_partkey", F.array(*[F.array(*[v for j in range(n) for v in point(p, j)]) for p, n in enumerate(POINTS)]).alias("polygons"))


def _filled_sql(vertices: str, height: int, width: int) -> str:
    """Pixels (p_partkey, x, y), by walking every step of every edge on the fine grid."""
    return f"""v AS (SELECT p_partkey, part, j, n, trunc(px * 5 + 0.5)::BIGINT AS x, trunc(py * 5 + 0.5)::BIGINT AS y FROM {vertices}),
    e AS (SELECT a.p_partkey, a.part, a.j, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb, abs(b.x - a.x) >= abs(b.y - a.y) AS flat, greatest(abs(b.x - a.x), abs(b.y - a.y)) AS len
      FROM v a JOIN v b ON a.p_partkey = b.p_partkey AND a.part = b.part AND b.j = (a.j + 1) % a.n WHERE a.x <> b.x OR a.y <> b.y),
    o AS (SELECT *, CASE WHEN flat THEN xa > xb ELSE ya > yb END AS back FROM e),
    f AS (SELECT p_partkey, part, j, flat, len, CASE WHEN back THEN xb ELSE xa END AS xa, CASE WHEN back THEN yb ELSE ya END AS ya, CASE WHEN back THEN xa ELSE xb END AS xb, CASE WHEN back THEN ya ELSE yb END AS yb FROM o),
    w AS (SELECT p_partkey, part, j, t, CASE WHEN flat THEN xa + t ELSE (2 * xa * len + 2 * (xb - xa) * t + len - ((2 * xa * len + 2 * (xb - xa) * t + len) % (2 * len) + 2 * len) % (2 * len)) // (2 * len) END AS u,
      CASE WHEN flat THEN (2 * ya * len + 2 * (yb - ya) * t + len - ((2 * ya * len + 2 * (yb - ya) * t + len) % (2 * len) + 2 * len) % (2 * len)) // (2 * len) ELSE ya + t END AS q FROM (SELECT *, unnest(range(len + 1)) AS t FROM f)),
    c AS (SELECT p_partkey, part, least(u, lead(u) OVER s) AS u, u <> lead(u) OVER s AS turns, least(q, lead(q) OVER s) AS q FROM w WINDOW s AS (PARTITION BY p_partkey, part, j ORDER BY t)),
    k AS (SELECT p_partkey, part, (u - 2) // 5 AS x, ceil(greatest(0, least({height}, (q + 0.5) / 5 - 0.5)))::BIGINT AS y FROM c WHERE turns AND u % 5 = 2 AND u >= 2 AND (u - 2) // 5 < {width}),
    px AS (SELECT DISTINCT p_partkey, x, r.y FROM (SELECT k.p_partkey, k.part, k.x, r.y FROM k, range({height}) r(y) WHERE k.y <= r.y GROUP BY ALL HAVING count(*) % 2 = 1) r)"""


# Vectors as masks of 8 x 8, stretched over boxes that reach out of the image.
SIDE = 8
_BOX = {"x0": (7, 31, -3, 4.0), "y0": (5, 23, -3, 4.0), "w": (11, 67, 2, 4.0), "h": (13, 53, 2, 4.0)}


def _pasted(s, d) -> DataFrame:
    key = F.col("vec_id")
    made = {k: ((key * a) % (b * 3)) / q + low for k, (a, b, low, q) in _BOX.items()}
    mask = F.transform(F.slice("embedding", 1, SIDE * SIDE), lambda v: F.round(v.cast("double"), 6))
    rows = table(s, d, "embeddings").select("vec_id", mask.alias("mask"), *[c.alias(k) for k, c in made.items()])
    box = Box(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))
    return rasters.paste(rows, ["vec_id"], "mask", SIDE, box, HEIGHT, WIDTH, 0.05)


def _pasted_sql() -> str:
    made = ", ".join(f"((vec_id * {a}) % {b * 3}) / {q}::DOUBLE + {low} AS {k}" for k, (a, b, low, q) in _BOX.items())
    return f"""WITH m AS (SELECT vec_id, (i - 1) // {SIDE} AS r, (i - 1) % {SIDE} AS c, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, range(1, {SIDE * SIDE + 1}) t(i)), b AS (SELECT vec_id, {made} FROM embeddings),
    t AS (SELECT vec_id, y, x, (y + 0.5::DOUBLE - y0) / h * {SIDE} - 0.5 AS v, (x + 0.5::DOUBLE - x0) / w * {SIDE} - 0.5 AS u FROM b, range({HEIGHT}) p(y), range({WIDTH}) q(x)),
    s AS (SELECT t.vec_id, y, x, sum(value * greatest(0, 1 - abs(v - r)) * greatest(0, 1 - abs(u - c))) AS value FROM t JOIN m ON m.vec_id = t.vec_id AND abs(v - r) < 1 AND abs(u - c) < 1 WHERE u > -1 AND u < {SIDE} AND v > -1 AND v < {SIDE} GROUP BY ALL)
    SELECT vec_id, count(*) AS area, sum(y * {WIDTH} + x)::BIGINT AS places, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM s WHERE value >= 0.05 GROUP BY ALL"""


# Each image has parts in blocks and a few labelled pixels.
LABELLED = f"(SELECT i AS image_id, y, x, CASE WHEN (x * 7 + y * 13 + i * 5 + b) % 37 = 0 THEN 1 + (x + y) % 4 ELSE 0 END AS instance, (x + 2 * y) % 5 AS person, (x // 4 + y // 3 * 2 + i + b) % 3 AS part FROM {IMAGES}, range({HEIGHT}) p(y), range({WIDTH}) q(x))"


def _labelled(s, d) -> DataFrame:
    x, y, i, b = (F.col(c) for c in ("x", "y", "image_id", "b"))
    instance = F.when((x * 7 + y * 13 + i * 5 + b) % 37 == 0, 1 + (x + y) % 4).otherwise(0).cast("long")
    return _canvases(s, d).select("image_id", y.cast("long").alias("y"), x.cast("long").alias("x"), instance.alias("instance"), ((x + 2 * y) % 5).cast("long").alias("person"), ((F.floor(x / 4) + F.floor(y / 3) * 2 + i + b) % 3).cast("long").alias("part"))


def _grown(s, d) -> DataFrame:
    classes = table(s, d, "supplier").select((F.col("s_suppkey") - 1).cast("long").alias("image_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("instance"))
    return regions.grow(_labelled(s, d), classes.withColumn("part", F.col("instance") % 3)).select("image_id", "y", "x", "instance", "person")


def register(registry: Registry) -> None:
    add = registry.add
    keys = ["p_partkey"]
    add(
        "polygon_columns",
        lambda s, d: rasters.run_pixels(rasters.polygon_runs(_polygons(s, d), keys, "polygons", HEIGHT, WIDTH), keys).groupBy("p_partkey", "x").agg(F.count("*").alias("n"), F.sum("y").alias("places")),
        f"WITH {_filled_sql(VERTICES, HEIGHT, WIDTH)} SELECT p_partkey, x, count(*) AS n, sum(y)::BIGINT AS places FROM px GROUP BY ALL",
    )
    add(
        "polygon_extents",
        lambda s, d: rasters.run_extents(rasters.polygon_runs(_polygons(s, d), keys, "polygons", HEIGHT, WIDTH), keys).select(*keys, "area", "x0", "y0", "x1", "y1"),
        f"WITH {_filled_sql(VERTICES, HEIGHT, WIDTH)} SELECT p_partkey, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM px GROUP BY ALL",
    )
    add(
        "polygon_bounds",
        lambda s, d: _polygons(s, d).select("p_partkey", F.round(geometry.polygons_area(F.col("polygons")), 6).alias("area"), *geometry.polygons_bounds(F.col("polygons"))),
        f"""WITH v AS (SELECT * FROM {VERTICES}), a AS (SELECT p_partkey, abs(sum(px * ny - nx * py)) / 2 AS area FROM (SELECT a.p_partkey, a.part, a.px, a.py, b.px AS nx, b.py AS ny FROM v a JOIN v b ON a.p_partkey = b.p_partkey AND a.part = b.part AND b.j = (a.j + 1) % a.n) GROUP BY p_partkey, part)
        SELECT p_partkey, round(area, 6) AS area, x0, y0, greatest(0, x1) AS x1, greatest(0, y1) AS y1 FROM (SELECT p_partkey, sum(area) AS area FROM a GROUP BY ALL) JOIN (SELECT p_partkey, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM v GROUP BY ALL) USING (p_partkey)""",
    )

    def boxed(s, d):
        key = F.col("p_partkey")
        box = Box((key % 9).cast("double"), (key % 7).cast("double"), (key % 9 + 7 + key % 4 * 4).cast("double"), (key % 7 + 14).cast("double"))
        runs = rasters.within_box(_polygons(s, d), keys, "polygons", box, 28)
        return rasters.run_extents(runs, keys).select(*keys, "area", "x0", "y0", "x1", "y1")

    moved = f"(SELECT p_partkey, part, j, n, (px - p_partkey % 9) * (28.0::DOUBLE / (7 + p_partkey % 4 * 4)) AS px, (py - p_partkey % 7) * (28.0::DOUBLE / 14) AS py FROM {VERTICES})"
    add(
        "polygon_in_box",
        boxed,
        f"WITH {_filled_sql(moved, 28, 28)} SELECT p_partkey, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM px GROUP BY ALL",
    )
    add(
        "pasted_masks",
        lambda s, d: _pasted(s, d).groupBy("vec_id").agg(F.count("*").alias("area"), F.sum(F.col("y") * WIDTH + F.col("x")).alias("places"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1")),
        _pasted_sql(),
    )
    add(
        "grown_instances",
        _grown,
        f"""WITH RECURSIVE g AS (SELECT *, y * {WIDTH} + x AS p FROM {LABELLED}),
        r AS (SELECT image_id, p AS source, instance % 3 AS part, y, x FROM g WHERE instance <> 0
          UNION SELECT r.image_id, r.source, r.part, g.y, g.x FROM r JOIN g ON g.image_id = r.image_id AND g.part = r.part AND g.instance = 0 AND abs(g.y - r.y) <= 1 AND abs(g.x - r.x) <= 1),
        m AS (SELECT image_id, y, x, min(source) AS source FROM r GROUP BY ALL)
        SELECT g.image_id, g.y, g.x, CASE WHEN g.instance = 0 AND m.source IS NOT NULL THEN o.instance ELSE g.instance END AS instance, CASE WHEN g.instance = 0 AND m.source IS NOT NULL THEN o.person ELSE g.person END AS person
        FROM g LEFT JOIN m USING (image_id, y, x) LEFT JOIN g o ON o.image_id = g.image_id AND o.p = m.source""",
    )
