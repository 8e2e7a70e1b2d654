"""Queries of turned and cut images and of boxes under composed transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.geometry import Box
from brindle.operators import transforms
from brindle.plans.annotations import KEYS, TIES
from brindle.plans.pixels import HEIGHT, IMAGES, WIDTH, _canvases, _images
from brindle.registry import Registry
from brindle.session import table

SHADES = f"(SELECT i AS image_id, y, x, ((x * 7 + y * 5 + i * 3 + b) % 11) / 10.0::DOUBLE AS value FROM {IMAGES}, range({HEIGHT}) p(y), range({WIDTH}) q(x))"


def _shades(s, d) -> DataFrame:
    return _canvases(s, d).select("image_id", "y", "x", (((F.col("x") * 7 + F.col("y") * 5 + F.col("image_id") * 3 + F.col("b")) % 11) / 10.0).alias("value"))


def _told(pixels: DataFrame) -> DataFrame:
    """What the values of each image and row add up to, plain and weighed by column."""
    return pixels.groupBy("image_id", "y").agg(F.count("*").alias("n"), F.round(F.sum("value") + 1e-9, 6).alias("total"), F.round(F.sum(F.col("value") * F.col("x")) + 1e-9, 6).alias("moment"))


TOLD = "SELECT image_id, y, count(*) AS n, round(sum(value) + 1e-9, 6) AS total, round(sum(value * x) + 1e-9, 6) AS moment FROM ({0}) GROUP BY ALL"


def _turned(s, d) -> DataFrame:
    turn, height, width = transforms.rotated(HEIGHT, WIDTH, (F.col("image_id") * 37 % 360).cast("double"))
    return _told(transforms.warp(_shades(s, d), _images(s, d), (HEIGHT, WIDTH), turn.inverse(), height, width))


def _turned_sql() -> str:
    middle = f"SELECT i AS image_id, cos(r) AS c, sin(r) AS s, round_even({HEIGHT} * abs(sin(r)) + {WIDTH} * abs(cos(r)), 0)::BIGINT AS w, round_even({HEIGHT} * abs(cos(r)) + {WIDTH} * abs(sin(r)), 0)::BIGINT AS h FROM (SELECT i, radians(i * 37 % 360) AS r FROM {IMAGES})"
    places = f"SELECT image_id, y, x, c * (x + 0.5 - w / 2.0::DOUBLE) - s * (y + 0.5 - h / 2.0::DOUBLE) + {WIDTH / 2} - 0.5 AS u, s * (x + 0.5 - w / 2.0::DOUBLE) + c * (y + 0.5 - h / 2.0::DOUBLE) + {HEIGHT / 2} - 0.5 AS v FROM (SELECT *, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM m))"
    mixed = "SELECT p.image_id, p.y, p.x, coalesce(sum(g.value * (1 - abs(v - g.y)) * (1 - abs(u - g.x))), 0) AS value FROM p LEFT JOIN g ON g.image_id = p.image_id AND g.y BETWEEN floor(v) AND floor(v) + 1 AND g.x BETWEEN floor(u) AND floor(u) + 1 GROUP BY ALL"
    return f"WITH m AS ({middle}), p AS ({places}), g AS (SELECT * FROM {SHADES}) {TOLD.format(mixed)}"


OUT = (9, 11)


def _cut(s, d, method: str) -> DataFrame:
    i, b = F.col("image_id"), F.col("b")
    x0, y0 = i % 7 - 2.3, i % 5 - 1.3
    part = transforms.extent(Box(x0, y0, x0 + 5 + b % 37, y0 + 4 + b % 29), *OUT)
    return _told(transforms.warp(_shades(s, d), _images(s, d), (HEIGHT, WIDTH), part.inverse(), F.lit(OUT[0]), F.lit(OUT[1]), method, "repeat", 0.25))


def _cut_sql(method: str) -> str:
    places = f"SELECT i AS image_id, y, x, i % 7 - 2.3::DOUBLE + (x + 0.5::DOUBLE) * (5 + b % 37) / {OUT[1]} AS u, i % 5 - 1.3::DOUBLE + (y + 0.5::DOUBLE) * (4 + b % 29) / {OUT[0]} AS v FROM {IMAGES}, range({OUT[0]}) r(y), range({OUT[1]}) q(x)"
    inside = f"u >= 0 AND u < {WIDTH} AND v >= 0 AND v < {HEIGHT}"
    if method == "nearest":
        drawn = f"SELECT p.image_id, p.y, p.x, CASE WHEN {inside} THEN g.value ELSE 0.25 END AS value FROM p LEFT JOIN g ON g.image_id = p.image_id AND g.y = floor(v) AND g.x = floor(u)"
    else:
        near = lambda j, i: f"(SELECT g.value FROM g WHERE g.image_id = p.image_id AND g.y = greatest(0, least({HEIGHT - 1}, floor(v - 0.5) + {j})) AND g.x = greatest(0, least({WIDTH - 1}, floor(u - 0.5) + {i})))"
        share = lambda c, k: f"({c} - 0.5 - floor({c} - 0.5))" if k else f"(1 - ({c} - 0.5 - floor({c} - 0.5)))"
        mixed = " + ".join(f"{near(j, i)} * {share('v', j)} * {share('u', i)}" for j in (0, 1) for i in (0, 1))
        drawn = f"SELECT image_id, y, x, CASE WHEN {inside} THEN {mixed} ELSE 0.25 END AS value FROM p"
    return f"WITH p AS ({places}), g AS (SELECT * FROM {SHADES}) {TOLD.format(drawn)}"


def _moved_boxes(s, d) -> DataFrame:
    """Boxes of lines in images of 80 x 100: mirrored, turned about their middle, brought to 60 x 50; and back again."""
    x, y = (F.col("l_partkey") % 20).cast("double"), (F.col("l_suppkey") % 15).cast("double")
    box = Box(x, y, x + F.col("l_quantity"), y + F.col("l_linenumber") * 2)
    turn, height, width = transforms.rotated(80, 100, F.col("l_quantity") * 7)
    whole = transforms.flipped(100).then(turn).then(transforms.resized((height, width), (60, 50)))
    back = whole.inverse().at(*whole.at(x, y))
    return table(s, d, "lineitem").select("l_orderkey", *TIES, *[F.round(c, 6).alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), _sides(whole.box(box)))], F.round(back[0], 6).alias("x"), F.round(back[1], 6).alias("y"))


def _sides(box: Box) -> tuple:
    return box.x0, box.y0, box.x1, box.y1


MOVED_BOXES = f"""WITH b AS (SELECT *, (l_partkey % 20)::DOUBLE AS x, (l_suppkey % 15)::DOUBLE AS y, radians(l_quantity * 7) AS r FROM lineitem),
s AS (SELECT *, round_even(80 * abs(sin(r)) + 100 * abs(cos(r)), 0) AS w, round_even(80 * abs(cos(r)) + 100 * abs(sin(r)), 0) AS h FROM b),
k AS (SELECT *, 100 - (x + i * l_quantity) - 50 AS p, y + j * l_linenumber * 2 - 40 AS q FROM s, range(2) e(i), range(2) f(j)),
t AS (SELECT *, (cos(r) * p + sin(r) * q + w / 2) * 50 / w AS u, (cos(r) * q - sin(r) * p + h / 2) * 60 / h AS v FROM k)
SELECT {KEYS}, round(min(u), 6) AS x0, round(min(v), 6) AS y0, round(max(u), 6) AS x1, round(max(v), 6) AS y1, x, y FROM t GROUP BY ALL"""


def register(registry: Registry) -> None:
    add = registry.add
    add("turned_images", _turned, _turned_sql())
    for method in ("bilinear", "nearest"):
        add(f"image_extents_{method}", lambda s, d, method=method: _cut(s, d, method), _cut_sql(method))
    add("moved_boxes", _moved_boxes, MOVED_BOXES)
