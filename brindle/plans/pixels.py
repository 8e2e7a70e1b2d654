"""Queries of the pixel and series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import masks, series
from brindle.registry import Registry
from brindle.session import table

# An image for each supplier, with a pattern that its balance moves.
IMAGES = "(SELECT s_suppkey - 1 AS i, CAST(floor(abs(s_acctbal)) AS BIGINT) AS b FROM supplier) a"
GRID = f"(SELECT i AS image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CASE WHEN (x * 7 + y * 5 + i * 3 + b) % 11 < 4 AND i % 5 <> 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM {IMAGES}, range(24) b(y), range(30) c(x))"
HEIGHT, WIDTH = 24, 30


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to tasks by ``key`` before they are spread out: a small file would be one task, and what is keyed by image then stays where it is."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _images(s, d):
    return dealt(table(s, d, "supplier").select((F.col("s_suppkey") - 1).cast("long").alias("image_id"), F.floor(F.abs("s_acctbal")).alias("b")), "image_id")


def _canvases(s, d):
    rows = _images(s, d).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))))


def _grid(s, d):
    on = ((F.col("x") * 7 + F.col("y") * 5 + F.col("image_id") * 3 + F.col("b")) % 11 < 4) & (F.col("image_id") % 5 != 4)
    return _canvases(s, d).select("image_id", "y", "x", F.when(on, 1.0).otherwise(0.0).alias("value"))


def _labels(s, d):
    x, y, i = F.col("x"), F.col("y"), F.col("image_id")
    return _grid(s, d).withColumn("value", F.when((x + y + i) % 17 == 0, 255).otherwise(((F.floor(x / 4) + i) * F.floor(y / 5)) % 3))


def register(registry: Registry) -> None:
    add = registry.add
    add(
        "mask_properties",
        lambda s, d: masks.properties(_grid(s, d), _images(s, d).select("image_id")),
        f"""SELECT r.i AS image_id, CAST(coalesce(max(x) - min(x) + 1, 0) AS INT) AS width, CAST(coalesce(max(y) - min(y) + 1, 0) AS INT) AS height, coalesce(min(x), 0) AS x0, coalesce(min(y), 0) AS y0, coalesce(max(x), 0) AS x1, coalesce(max(y), 0) AS y1
        FROM (SELECT s_suppkey - 1 FROM supplier) r(i) LEFT JOIN (SELECT * FROM {GRID} WHERE value > 0.5) g ON g.image_id = r.i GROUP BY r.i""",
    )
    add(
        "mask_filled_box",
        lambda s, d: masks.filled_box(_grid(s, d)).groupBy("image_id").agg(F.sum("value").alias("filled")),
        f"SELECT image_id, coalesce(CAST((max(x) FILTER (value > 0.5) - min(x) FILTER (value > 0.5) + 1) * (max(y) FILTER (value > 0.5) - min(y) FILTER (value > 0.5) + 1) AS DOUBLE), 0.0) AS filled FROM {GRID} GROUP BY image_id",
    )
    add(
        "mask_dilate_erode",
        lambda s, d: masks.morphology(_grid(s, d), 4, -3).select("image_id", "y", "x", "value"),
        f"""WITH a AS (SELECT image_id, y, x, max(value) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS v FROM {GRID})
        SELECT image_id, y, x, CASE WHEN count(*) OVER w = 3 THEN min(v) OVER w ELSE 0.0::DOUBLE END AS value FROM a WINDOW w AS (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
    )
    add(
        "mask_run_lengths",
        lambda s, d: masks.run_lengths(_grid(s, d), HEIGHT).select("image_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts")),
        f"""WITH f AS (SELECT image_id, x * {HEIGHT} + y AS p, value > 0.5 AS v FROM {GRID}), g AS (SELECT *, v <> lag(v, 1, false) OVER (PARTITION BY image_id ORDER BY p) AS n FROM f),
        r AS (SELECT image_id, p, sum(n::INT) OVER (PARTITION BY image_id ORDER BY p) AS run FROM g), c AS (SELECT image_id, run, count(*) AS k FROM r GROUP BY ALL)
        SELECT image_id, CASE WHEN min(run) > 0 THEN '0,' ELSE '' END || string_agg(k::VARCHAR, ',' ORDER BY run) AS counts FROM c GROUP BY image_id""",
    )
    add(
        "mask_round_trip",
        lambda s, d: masks.decode_runs(masks.run_lengths(_grid(s, d), HEIGHT), HEIGHT).groupBy("image_id").agg(F.count("*").alias("pixels"), F.sum(F.col("y") * 1000 + F.col("x")).alias("places")),
        f"SELECT image_id, count(*) AS pixels, CAST(sum(y * 1000 + x) AS BIGINT) AS places FROM {GRID} WHERE value > 0.5 GROUP BY image_id",
    )
    add(
        "image_blend_compare",
        lambda s, d: masks.compare(masks.blend(_grid(s, d), _grid(s, d).withColumn("value", F.lit(0.25)), F.lit(0.4)), _grid(s, d), "difference").select("image_id", "y", "x", F.round("value", 6).alias("value")),
        f"SELECT image_id, y, x, round(abs(value * 0.6 + 0.1 - value), 6) AS value FROM {GRID}",
    )

    def layers(s, d):
        g = _grid(s, d)
        made = g.select((F.col("image_id") % 5).alias("image_id"), F.floor(F.col("image_id") / 5).alias("layer"), "y", "x", (F.col("value") + F.col("image_id")).alias("value"), (F.col("image_id") - 5).alias("dx"), (F.col("image_id") - 14).alias("dy"))
        return masks.stack(made, 40, 30)

    add(
        "layer_stack",
        layers,
        f"""SELECT image_id, y, x, value FROM (SELECT image_id % 5 AS image_id, y + image_id - 14 AS y, x + image_id - 5 AS x, value + image_id AS value, row_number() OVER (PARTITION BY image_id % 5, y + image_id - 14, x + image_id - 5 ORDER BY image_id // 5 DESC) AS n
        FROM {GRID}) WHERE n = 1 AND x BETWEEN 0 AND 39 AND y BETWEEN 0 AND 29""",
    )
    add(
        "resize_nearest",
        lambda s, d: masks.resize_nearest(_grid(s, d), (HEIGHT, WIDTH), (36, 20)),
        f"SELECT g.image_id, CAST(a.y AS INT) AS y, CAST(b.x AS INT) AS x, g.value FROM range(36) a(y), range(20) b(x), {GRID} g WHERE g.y = a.y * {HEIGHT} // 36 AND g.x = b.x * {WIDTH} // 20",
    )
    add(
        "label_edges",
        lambda s, d: masks.edges(_labels(s, d)).select("image_id", "y", "x", "edge"),
        f"""WITH l AS (SELECT image_id, y, x, CASE WHEN (x + y + image_id) % 17 = 0 THEN 255 ELSE ((x // 4 + image_id) * (y // 5)) % 3 END AS v FROM {GRID}),
        e AS (SELECT a.image_id, a.y, a.x FROM l a JOIN l b ON a.image_id = b.image_id AND ((b.y = a.y - 1 AND b.x = a.x) OR (b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x IN (a.x - 1, a.x + 1))) WHERE a.v <> b.v AND a.v <> 255 AND b.v <> 255 GROUP BY ALL)
        SELECT image_id, y, x, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.image_id = l.image_id AND abs(e.y - l.y) <= 1 AND abs(e.x - l.x) <= 1) THEN 1 ELSE 0 END AS edge FROM l""",
    )
    order = ["ts", "event_id"]
    add(
        "smoothed_series",
        lambda s, d: series.smoothed(table(s, d, "events"), "event_type", "value", order, 20).select("event_id", F.round("smoothed", 6).alias("smoothed")),
        "SELECT event_id, round(median(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM events",
    )
    add(
        "running_average",
        lambda s, d: series.running_average(table(s, d, "events"), "event_type", "value", order, 20).select("event_id", F.round("avg_window", 6).alias("avg_window"), F.round(F.col("avg_global") * 1.0000001, 6).alias("avg_global")),
        "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS avg_window, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) * 1.0000001::DOUBLE, 6) AS avg_global FROM events",
    )
    add(
        "series_histogram",
        lambda s, d: series.histogram(table(s, d, "lineitem"), "l_quantity", 1.0, 50.0, 7),
        "SELECT CAST(least(floor((l_quantity - 1) / 7.0), 6) AS BIGINT) AS bucket, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1",
    )
    add(
        "series_summary",
        lambda s, d: series.value_summary(table(s, d, "events"), ["event_type"], "value").select("event_type", "min", "max", "num", F.round("sum", 2).alias("sum"), F.round("sumsq", 1).alias("sumsq")),
        "SELECT event_type, min(value) AS min, max(value) AS max, count(value) AS num, round(sum(value), 2) AS sum, round(sum(value * value), 1) AS sumsq FROM events GROUP BY 1",
    )
    add(
        "rate_schedules",
        lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("step"), F.round(series.multistep_rate(F.col("o_orderkey"), 0.02, [120, 240], 0.1, 50), 9).alias("multistep"), F.round(series.cosine_rate(F.col("o_orderkey"), 0.02, 300, 50), 9).alias("cosine")),
        """WITH t AS (SELECT o_orderkey AS step, CASE WHEN o_orderkey >= 50 THEN 1.0 ELSE 0.001 * (1 - o_orderkey / 50) + o_orderkey / 50 END AS w FROM orders)
        SELECT step, round(0.02::DOUBLE * w * power(0.1, (step >= 120)::INT + (step >= 240)::INT), 9) AS multistep, round(0.02::DOUBLE * w * 0.5 * (1 + cos(pi() * step / 300)), 9) AS cosine FROM t""",
    )
    add(
        "byte_offsets",
        lambda s, d: series.byte_offsets(table(s, d, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size")), "size", ["doc_id"], "source"),
        "SELECT source, doc_id, CAST(strlen(text) AS BIGINT) AS size, CAST(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS \"end\" FROM documents",
    )
