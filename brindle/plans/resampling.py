"""Queries of the resampling filters on the vectors of ``embeddings`` as images of 8 x 8 pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import resampling, resizing
from brindle.registry import Registry
from brindle.session import table

SIDE = 8
PIXELS = f"(SELECT vec_id AS image_id, (i - 1) // {SIDE} AS y, (i - 1) % {SIDE} AS x, embedding[i]::DOUBLE AS value FROM embeddings, range(1, {SIDE * SIDE + 1}) r(i))"


def pixels(s, d) -> DataFrame:
    cells = table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    return cells.filter(F.col("i") < SIDE * SIDE).select("image_id", F.floor(F.col("i") / SIDE).alias("y"), (F.col("i") % SIDE).cast("long").alias("x"), F.col("v").cast("double").alias("value"))


def _sinc(x: str, a: int) -> str:
    part = lambda v: f"CASE WHEN abs({v}) < 1e-12 THEN 1.0 ELSE sin(pi() * ({v})) / (pi() * ({v})) END"
    return f"CASE WHEN abs({x}) < {a} THEN ({part(x)}) * ({part(f'({x}) / {a}')}) ELSE 0 END"


def _cubic(x: str, a: float) -> str:
    return f"CASE WHEN abs({x}) < 1 THEN ({a} + 2) * abs({x}) ** 3 - ({a} + 3) * ({x}) ** 2 + 1 WHEN abs({x}) < 2 THEN {a} * abs({x}) ** 3 - 5 * {a} * ({x}) ** 2 + 8 * {a} * abs({x}) - 4 * {a} ELSE 0 END"


FILTERS = {"bilinear": ("greatest(0, 1 - abs({0}))", 1), "bicubic": (_cubic("{0}", -0.75), 2), "lanczos4": (_sinc("{0}", 4), 4), "wide_bilinear": ("greatest(0, 1 - abs({0}))", 1), "wide_bicubic": (_cubic("{0}", -0.5), 2), "lanczos": (_sinc("{0}", 3), 3)}


def weights_sql(name: str, old: int, new: int, method: str) -> str:
    """A table (t, s, w) of weights, from the definition of the filter."""
    if method == "area":
        raw = f"SELECT t, s, 1.0::DOUBLE AS w FROM range({new}) a(t), range({old}) b(s) WHERE s >= t * {old} // {new} AND s * {new} < (t + 1) * {old}"
    else:
        text, reach = FILTERS[method]
        if method in resampling.POINT:
            place = f"(SELECT t, (t + 0.5::DOUBLE) * {old} / {new} - 0.5 AS p, floor((t + 0.5::DOUBLE) * {old} / {new} - 0.5) + k AS q FROM range({new}) a(t), range({1 - reach}, {reach + 1}) b(k))"
            raw = f"SELECT t, greatest(0, least({old - 1}, q))::BIGINT AS s, sum({text.format('(p - q)')}) AS w FROM {place} GROUP BY ALL"
        else:
            wide = max(old / new, 1.0)
            middle = f"((t + 0.5::DOUBLE) * {old} / {new})"
            x = f"((s + 0.5 - {middle}) / {wide}::DOUBLE)"
            raw = f"SELECT t, s, {text.format(x)} AS w FROM range({new}) a(t), range({old}) b(s) WHERE s >= trunc(greatest(0, {middle} - {reach * wide}::DOUBLE + 0.5)) AND s < trunc({middle} + {reach * wide}::DOUBLE + 0.5)"
    return f"{name} AS (SELECT t, s, w / sum(w) OVER (PARTITION BY t) AS w FROM ({raw}))"


def resampled_sql(source: str, old: tuple[int, int], new: tuple[int, int], method: str) -> str:
    return f"""WITH {weights_sql('wy', old[0], new[0], method)}, {weights_sql('wx', old[1], new[1], method)}
    SELECT image_id, wy.t AS y, wx.t AS x, sum(value * wy.w * wx.w) AS value FROM {source} p JOIN wy ON wy.s = p.y JOIN wx ON wx.s = p.x GROUP BY ALL"""


def register(registry: Registry) -> None:
    add = registry.add
    rounded = lambda df: df.withColumn("value", F.round(F.col("value") + 1e-11, 7))
    for method in resampling.METHODS[1:]:
        add(
            f"resample_{method}",
            lambda s, d, method=method: rounded(resampling.resample(pixels(s, d), (SIDE, SIDE), (13, 5), method)),
            f"SELECT image_id, y, x, round(value + 1e-11, 7) AS value FROM ({resampled_sql(PIXELS, (SIDE, SIDE), (13, 5), method)})",
        )
    add(
        "resize_cover_lanczos",
        lambda s, d: rounded(resizing.resize(pixels(s, d), (SIDE, SIDE), (6, 10), "cover", method="lanczos")),
        f"SELECT image_id, y - 2 AS y, x, round(value + 1e-11, 7) AS value FROM ({resampled_sql(PIXELS, (SIDE, SIDE), (10, 10), 'lanczos')}) WHERE y BETWEEN 2 AND 7",
    )
    add(
        "resize_pad_bicubic",
        lambda s, d: rounded(resizing.resize(pixels(s, d), (SIDE, SIDE), (6, 11), "pad", 0.5, method="bicubic")),
        f"""SELECT i.image_id, y, x, coalesce(round(r.value + 1e-11, 7), 0.5::DOUBLE) AS value FROM (SELECT vec_id AS image_id, y, x FROM embeddings, range(6) a(y), range(11) b(x)) i
        LEFT JOIN (SELECT image_id, y, x + 2 AS x, value FROM ({resampled_sql(PIXELS, (SIDE, SIDE), (6, 6), 'bicubic')})) r USING (image_id, y, x)""",
    )

    def merged(s, d):
        small = pixels(s, d).filter("y < 4")
        return rounded(resizing.merge_batches([(pixels(s, d), (SIDE, SIDE)), (small, (4, SIDE))]))

    add(
        "batch_merge_resized",
        merged,
        f"""SELECT 0 AS batch, image_id, y, x, round(value + 1e-11, 7) AS value FROM {PIXELS} UNION ALL
        SELECT 1, image_id, y, x, round(value + 1e-11, 7) FROM ({resampled_sql(f'(SELECT * FROM {PIXELS} WHERE y < 4)', (4, SIDE), (SIDE, SIDE), 'bilinear')})""",
    )
