"""Queries of batches, samplers, matching, key points and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import geometry, lists, logic
from brindle.functions.expressions import fold_positions
from brindle.functions.geometry import Box
from brindle.operators import datasets, masks, matching, metrics, poses, sampling, series
from brindle.plans.annotations import KEYS, TIES, boxes
from brindle.plans.pixels import GRID, _grid
from brindle.registry import Registry
from brindle.session import table

IMAGES = "SELECT image_id, y, x, value FROM "


def register(registry: Registry) -> None:
    add = registry.add

    # Batches: rows of an order, by line number.
    def lines(s, d):
        w = Window.partitionBy("l_orderkey")
        return table(s, d, "lineitem").select("l_orderkey", "l_partkey", (F.row_number().over(w.orderBy(*TIES)) - 1).cast("long").alias("pos"), F.count("*").over(w).alias("size"))

    lines_sql = "l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem)"
    for name, (index, end, step), start, stop in (("single", (2, -1, 1), "2", "3"), ("steps", (1, -2, 2), "1", "size - 1"), ("last", (-2, 9, 1), "greatest(0, size - 2)", "least(9, size)")):
        add(
            f"batch_slice_{name}",
            lambda s, d, a=(index, end, step): lists.batch_slice(lines(s, d), F.col("pos"), F.col("size"), *a),
            f"WITH {lines_sql} SELECT * FROM l WHERE (pos >= {start} AND pos < {stop} AND (pos - {start}) % {step} = 0) OR (({start} >= size OR {stop} <= {start}) AND pos = 0)",
        )
    add(
        "batch_merge",
        lambda s, d: lists.merge_batches(table(s, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name")), table(s, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), "c_nationkey")),
        "SELECT s_suppkey AS pos, s_name AS name, NULL AS c_nationkey, CAST(0 AS INT) AS source FROM supplier UNION ALL SELECT c_custkey, c_name, c_nationkey, 1 FROM customer",
    )
    add(
        "batch_align",
        lambda s, d: lists.align(table(s, d, "supplier").select(F.col("s_suppkey").alias("pos"), "s_name"), table(s, d, "customer").select(F.col("c_custkey").alias("pos"), "c_name"), 2, 3),
        "SELECT s_suppkey AS pos, s_name, c_name FROM supplier JOIN customer ON s_suppkey = c_custkey",
    )
    add(
        "pick_by_number",
        lambda s, d: table(s, d, "orders").select("o_orderkey", logic.pick(F.array(F.lit("red"), F.lit(""), F.col("o_orderstatus"), F.col("o_orderpriority")), (F.col("o_orderkey") % 7).cast("int")).alias("picked")).filter("picked IS NOT NULL"),
        "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN 'red' WHEN 3 THEN o_orderstatus ELSE o_orderpriority END AS picked FROM orders WHERE o_orderkey % 7 IN (1, 3, 4)",
    )
    spots = fold_positions("10, -4\nx1 + 5, y1 - +2\n-x2 + 100, y1 + y2")
    add(
        "position_offsets",
        lambda s, d: table(s, d, "part").select("p_partkey", F.explode(F.array(*[F.struct(F.lit(k).alias("n"), (F.col("p_size") + x).alias("x"), (F.col("p_size") + y).alias("y")) for k, (x, y) in enumerate(spots)])).alias("s")).select("p_partkey", "s.*"),
        "SELECT p_partkey, CAST(k AS INT) AS n, CAST(p_size + ([10, 15, 85])[k + 1] AS DOUBLE) AS x, CAST(p_size + ([-4, -6, -10])[k + 1] AS DOUBLE) AS y FROM part, range(3) r(k)",
    )

    # Samplers.
    add(
        "test_time_grid",
        lambda s, d: sampling.test_time_grid(table(s, d, "customer").select("c_custkey"), [400, 800]),
        "SELECT c_custkey, CAST(unnest([400, 400, 800, 800]) AS INT) AS size, unnest([false, true, false, true]) AS flip FROM customer",
    )
    add(
        "repeat_counts",
        lambda s, d: sampling.repeated(table(s, d, "part").select("p_partkey", (1.0 + F.col("p_size") % 3).alias("f")), "f", "p_partkey", 3, 1).groupBy("p_partkey").agg(F.count("*").alias("n")),
        "SELECT p_partkey, CAST(1 + p_size % 3 AS BIGINT) AS n FROM part",
    )

    def balanced(s, d):
        found = sampling.balanced_sample(table(s, d, "lineitem").select("l_suppkey", F.xxhash64("l_orderkey", *TIES).alias("k"), (F.col("l_quantity") > 45).alias("p")), "l_suppkey", F.col("p"), 32, 0.25, "k", 5)
        return found.groupBy("l_suppkey").agg(F.count_if("p").alias("positives"), F.count("*").alias("taken"))

    add(
        "balanced_sample_sizes",
        balanced,
        "SELECT l_suppkey, least(8, count(*) FILTER (l_quantity > 45)) AS positives, least(8, count(*) FILTER (l_quantity > 45)) + least(32 - least(8, count(*) FILTER (l_quantity > 45)), count(*) FILTER (l_quantity <= 45)) AS taken FROM lineitem GROUP BY 1",
    )
    add(
        "epoch_order",
        lambda s, d: sampling.epoch_order(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 1, 4).groupBy("epoch").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("distinct_keys")),
        "SELECT CAST(4 AS INT) AS epoch, count(*) AS n, count(DISTINCT o_orderkey) AS distinct_keys FROM orders",
    )

    # Matching.
    def sides(s, d):
        b = boxes(s, d).withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*TIES)).cast("long"))
        side = lambda c, p: b.filter(f"l_linestatus {c} 'O'").select("l_orderkey", F.col("k").alias(f"{p}id"), *[F.col(n).alias(f"{p}{n}") for n in ("x0", "y0", "x1", "y1")])
        return geometry.pairwise_iou(side("=", "a_"), side("<>", "b_"), "l_orderkey").filter("iou > 0").select("l_orderkey", "a_id", "b_id", F.round("iou", 12).alias("iou"))

    add(
        "global_greedy_match",
        lambda s, d: matching.global_greedy_match(sides(s, d), "l_orderkey", "a_id", "b_id").withColumn("iou", F.round("iou", 9)),
        """WITH RECURSIVE k AS (SELECT l_orderkey, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS k, (l_partkey % 100)::DOUBLE AS x0, (l_suppkey % 100)::DOUBLE AS y0, l_partkey % 100 + l_quantity AS x1, l_suppkey % 100 + l_linenumber * 5.0::DOUBLE AS y1 FROM lineitem),
        i AS (SELECT l_orderkey, a.k AS a_id, b.k AS b_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS v, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS t FROM k a JOIN k b USING (l_orderkey) WHERE a.l_linestatus = 'O' AND b.l_linestatus <> 'O'),
        o AS (SELECT l_orderkey, a_id, b_id, round(v / (t - v), 12) AS iou, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(v / (t - v), 12) DESC, a_id, b_id) AS n FROM i WHERE v > 0),
        g AS (SELECT l_orderkey, n, [a_id] AS a, [b_id] AS b, true AS taken FROM o WHERE n = 1
        UNION ALL SELECT o.l_orderkey, o.n, CASE WHEN list_contains(g.a, o.a_id) OR list_contains(g.b, o.b_id) THEN g.a ELSE list_append(g.a, o.a_id) END, CASE WHEN list_contains(g.a, o.a_id) OR list_contains(g.b, o.b_id) THEN g.b ELSE list_append(g.b, o.b_id) END, NOT (list_contains(g.a, o.a_id) OR list_contains(g.b, o.b_id)) FROM o JOIN g ON o.l_orderkey = g.l_orderkey AND o.n = g.n + 1)
        SELECT l_orderkey, a_id, b_id, round(iou, 9) AS iou FROM o JOIN g USING (l_orderkey, n) WHERE taken""",
    )
    add(
        "nearest_by_part",
        lambda s, d: matching.nearest(
            table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("part"), (F.col("c_custkey") % 97 / 97.0).alias("u"), (F.col("c_custkey") % 31 / 31.0).alias("v")),
            table(s, d, "supplier").select(F.col("s_suppkey").alias("vertex"), F.col("s_nationkey").alias("part"), (F.col("s_suppkey") % 53 / 53.0).alias("cu"), (F.col("s_suppkey") % 29 / 29.0).alias("cv")), "part",
        ).withColumn("d2", F.round("d2", 9)),
        """WITH p AS (SELECT c_custkey AS id, s_suppkey AS vertex, power(c_custkey % 97 / 97.0::DOUBLE - s_suppkey % 53 / 53.0::DOUBLE, 2) + power(c_custkey % 31 / 31.0::DOUBLE - s_suppkey % 29 / 29.0::DOUBLE, 2) AS d2 FROM customer JOIN supplier ON c_nationkey = s_nationkey)
        SELECT id, vertex, round(d2, 9) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, vertex) AS n FROM p) WHERE n = 1""",
    )

    # Key points: three joints for each line, seen if the tax allows.
    def points(s, d):
        joint = lambda k: F.struct((F.col("l_partkey") % (50 + k)).cast("double").alias("x"), (F.col("l_suppkey") % (30 + k)).cast("double").alias("y"), F.when((F.col("l_linenumber") + k) % 3 == 0, 0).otherwise(2).alias("v"))
        return table(s, d, "lineitem").select("l_orderkey", *TIES, "l_quantity", F.array(joint(0), joint(1), joint(2)).alias("p"))

    seen = lambda k: f"((l_linenumber + {k}) % 3 <> 0)"
    term = lambda k: f"CASE WHEN {seen(k)} THEN exp(-(power((l_partkey + {k}) % 60 - l_partkey % {50 + k}, 2) + power(1, 2)) / {(0.5, 1.0, 2.0)[k]} / (l_quantity * 100) / 2) ELSE 0 END"

    def similarity(s, d):
        found = F.transform("p", lambda q, k: F.struct(((F.col("l_partkey") + k) % 60).cast("double").alias("x"), (q["y"] + 1).alias("y")))
        return points(s, d).select("l_orderkey", *TIES, F.round(metrics.keypoint_similarity(found, F.col("p"), F.col("l_quantity") * 100, [0.5, 1.0, 2.0]), 9).alias("oks"))

    add("keypoint_similarity", similarity, f"SELECT {KEYS}, round(({term(0)} + {term(1)} + {term(2)}) / ({seen(0)}::INT + {seen(1)}::INT + {seen(2)}::INT), 9) AS oks FROM lineitem")
    flipped = lambda k, src: f"CASE WHEN {seen(src)} THEN 80.0 - l_partkey % {50 + src} ELSE 0.0 END::DOUBLE AS x{k}, CASE WHEN {seen(src)} THEN l_suppkey % {30 + src} ELSE 0 END::DOUBLE AS y{k}"
    add(
        "keypoint_flip",
        lambda s, d: points(s, d).withColumn("f", geometry.flip_keypoints(F.col("p"), 80.0, [(1, 2)])).select("l_orderkey", *TIES, *[F.get("f", F.lit(k))[c].alias(f"{c}{k}") for k in range(3) for c in "xy"]),
        f"SELECT {KEYS}, {flipped(0, 0)}, {flipped(1, 2)}, {flipped(2, 1)} FROM lineitem",
    )

    def neck(s, d):
        joint = lambda k: F.struct((F.col("l_partkey") % (50 + k)).cast("double").alias("x"), (F.col("l_suppkey") % (30 + k)).cast("double").alias("y"), (F.col("l_discount") * (k + 1) * 2).alias("score"))
        made = poses.with_neck(F.array(*[joint(k) for k in range(4)]), 1, 3, 2)
        return table(s, d, "lineitem").select("l_orderkey", *TIES, made.alias("p")).select("l_orderkey", *TIES, F.size("p").alias("n"), F.get("p", F.lit(2))["x"].alias("nx"), F.get("p", F.lit(2))["score"].alias("ns"), F.get("p", F.lit(3))["x"].alias("after"))

    add(
        "neck_joint",
        neck,
        f"SELECT {KEYS}, CAST(5 AS INT) AS n, (l_partkey % 51 + l_partkey % 53) / 2.0::DOUBLE AS nx, CASE WHEN l_discount * 2 * 2 > 0.3::DOUBLE AND l_discount * 4 * 2 > 0.3::DOUBLE THEN 1.0 ELSE 0.0 END::DOUBLE AS ns, (l_partkey % 52)::DOUBLE AS after FROM lineitem",
    )
    add(
        "padded_shapes",
        lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(*geometry.padded_shape(F.col("l_quantity"), F.col("l_linenumber") * 9, 32)),
        "SELECT l_orderkey, CAST(ceil(max(l_quantity) / 32) * 32 AS BIGINT) AS height, CAST(ceil(max(l_linenumber * 9) / 32) * 32 AS BIGINT) AS width FROM lineitem GROUP BY 1",
    )
    add(
        "quantized_ratio",
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", *TIES, geometry.bisect_right(F.col("l_quantity") / F.col("l_linenumber"), [2, 5, 10, 25]).alias("bin")),
        f"SELECT {KEYS}, CAST((l_quantity / l_linenumber >= 2)::INT + (l_quantity / l_linenumber >= 5)::INT + (l_quantity / l_linenumber >= 10)::INT + (l_quantity / l_linenumber >= 25)::INT AS BIGINT) AS bin FROM lineitem",
    )
    add(
        "polygon_areas",
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", *TIES, geometry.polygon_area(F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.lit(0.0), F.col("l_quantity"), F.col("l_linenumber") * 2.0, F.lit(-1.0), F.col("l_linenumber") * 1.0)).alias("area")),
        f"SELECT {KEYS}, (l_quantity * (l_linenumber * 2) + (l_quantity * l_linenumber + l_linenumber * 2)) / 2 AS area FROM lineitem",
    )

    # Aggregates.
    add("reduce_metrics", lambda s, d: series.reduce_metrics(table(s, d, "events"), "event_type", "value").withColumn("value", F.round("value", 6)), "SELECT event_type, round(avg(value), 6) AS value FROM events GROUP BY 1")
    add(
        "moving_average",
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", *TIES, F.round(series.moving_average(F.col("l_quantity"), F.col("l_discount"), 0.9), 9).alias("ema")),
        f"SELECT {KEYS}, round(l_quantity * 0.9::DOUBLE + l_discount * (1 - 0.9::DOUBLE), 9) AS ema FROM lineitem",
    )
    add(
        "instance_confidence",
        lambda s, d: poses.instance_confidence(table(s, d, "lineitem").select(F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").alias("instance"), F.col("l_quantity").alias("logit"), F.col("l_tax").alias("weight"))).withColumn("confidence", F.round("confidence", 9)),
        "SELECT l_suppkey AS image_id, l_linenumber AS instance, round(avg(l_quantity * l_tax), 9) AS confidence FROM lineitem GROUP BY ALL",
    )
    add(
        "fuse_patches",
        lambda s, d: poses.fuse_patches(table(s, d, "lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % 8).alias("y"), (F.col("l_orderkey") % 8).alias("x"), (F.col("l_linenumber") % 3).alias("label"), F.col("l_discount").alias("score"))).withColumn("score", F.round("score", 9)),
        "SELECT l_suppkey AS image_id, l_partkey % 8 AS y, l_orderkey % 8 AS x, l_linenumber % 3 AS label, round(CASE WHEN l_linenumber % 3 = 0 THEN min(l_discount) ELSE avg(l_discount) END, 9) AS score FROM lineitem GROUP BY l_suppkey, l_partkey % 8, l_orderkey % 8, l_linenumber % 3",
    )
    add(
        "flatten_metrics",
        lambda s, d: datasets.flatten(table(s, d, "part").select("p_partkey", F.struct(F.col("p_size").alias("size"), F.struct(F.col("p_name").alias("name")).alias("text")).alias("box"))),
        'SELECT p_partkey, p_size AS "box/size", p_name AS "box/text/name" FROM part',
    )
    add(
        "category_conflicts",
        lambda s, d: datasets.category_conflicts(table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"))),
        "SELECT n_nationkey AS id, CAST(2 AS BIGINT) AS names FROM nation WHERE n_nationkey % 3 = 0 AND lower(n_name) <> n_name",
    )
    add("duplicate_ids", lambda s, d: datasets.duplicate_ids(table(s, d, "lineitem"), "l_suppkey"), "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")

    # Filters and checks.
    def proposals(s, d):
        return boxes(s, d).select("l_orderkey", *TIES, "x0", "y0", "x1", "y1", (F.col("l_linenumber") - 2).alias("label"), F.array(F.struct(F.lit(30.0).alias("x"), F.lit(40.0).alias("y"), (F.col("l_partkey") % 2).alias("v")), F.struct(F.lit(60.0).alias("x"), F.lit(70.0).alias("y"), F.lit(2).alias("v"))).alias("points"))

    add(
        "foreground_proposals",
        lambda s, d: datasets.with_visible_point(datasets.foreground(proposals(s, d), "label", 3), "points").select("l_orderkey", *TIES, "label"),
        f"""SELECT {KEYS}, l_linenumber - 2 AS label FROM (SELECT *, l_partkey % 100 AS x0, l_suppkey % 100 AS y0, l_partkey % 100 + l_quantity AS x1, l_suppkey % 100 + l_linenumber * 5 AS y1 FROM lineitem)
        WHERE l_linenumber - 2 > -1 AND l_linenumber - 2 <> 3 AND ((l_partkey % 2 = 1 AND 30 BETWEEN x0 AND x1 AND 40 BETWEEN y0 AND y1) OR (60 BETWEEN x0 AND x1 AND 70 BETWEEN y0 AND y1))""",
    )
    add(
        "finite_rows",
        lambda s, d: datasets.finite(table(s, d, "lineitem").select("l_orderkey", *TIES, F.when(F.col("l_linenumber") == 1, float("inf")).when(F.col("l_linenumber") == 2, float("nan")).when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_tax")).alias("v")), ["v", "l_linenumber"]),
        f"SELECT {KEYS}, l_tax AS v FROM lineitem WHERE l_linenumber > 3",
    )
    add(
        "empty_instances",
        lambda s, d: datasets.empty_instances(boxes(s, d).withColumns({"x1": F.when(F.col("l_partkey") % 5 == 0, F.col("x0")).otherwise(F.col("x1")), "mask_area": F.col("l_linenumber") - 2})).select("l_orderkey", *TIES),
        f"SELECT {KEYS} FROM lineitem WHERE l_partkey % 5 = 0 OR l_linenumber <= 2",
    )

    def annotated(s, d):
        note = F.struct((F.col("l_linenumber") % 2).alias("iscrowd"), F.when(F.col("l_quantity") > 48, F.array(F.lit(1.0))).alias("keypoints"), F.when(F.col("l_tax") > 0.07, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("segmentation"), F.array(F.col("l_quantity")).alias("bbox"))
        return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(note).alias("annotations"))

    add(
        "keep_images",
        lambda s, d: datasets.keep_images(annotated(s, d), datasets.with_field("bbox"), [datasets.with_field("keypoints"), datasets.with_field("segmentation")]).select("l_orderkey"),
        "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_linenumber % 2 = 0) AND (bool_or(l_linenumber % 2 = 0 AND l_quantity > 48) OR bool_or(l_linenumber % 2 = 0 AND l_tax > 0.07))",
    )
    add(
        "map_with_fallback",
        lambda s, d: datasets.map_or_fallback(table(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") * 10)),
        """WITH t AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey * 10 END AS m FROM orders)
        SELECT o_custkey, o_orderkey, coalesce((SELECT min(m) FROM t u WHERE u.o_custkey = t.o_custkey AND u.o_orderkey >= t.o_orderkey), (SELECT min(m) FROM t u WHERE u.o_custkey = t.o_custkey)) AS made FROM t""",
    )
    add(
        "metadata_conflicts",
        lambda s, d: datasets.inconsistent(table(s, d, "lineitem").select(F.col("l_suppkey").alias("dataset"), F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("value"))),
        "SELECT l_partkey AS key, count(DISTINCT l_returnflag) AS values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1",
    )

    # Parts of a person in an image.
    def labels(s, d):
        return _grid(s, d).withColumn("value", (F.col("x") * 3 + F.col("y") + F.col("image_id")) % 6)

    label_sql = f"(SELECT image_id, y, x, (x * 3 + y + image_id) % 6 AS v FROM {GRID})"
    add("part_mask", lambda s, d: masks.part_mask(labels(s, d), [1, 2, 4], [2]).select("image_id", "y", "x", "value"), f"SELECT image_id, y, x, CASE WHEN v IN (1, 4) THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM {label_sql}")
    add(
        "arg_max_label",
        lambda s, d: masks.arg_max_label(_grid(s, d).withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("score", (F.col("x") * (F.col("label") + 2) + F.col("y") * 3 + F.col("label")) % 7)).select("image_id", "y", "x", "value"),
        f"SELECT image_id, y, x, CAST(arg_min(l, -((x * (l + 2) + y * 3 + l) % 7) * 10 + l) AS INT) AS value FROM {GRID}, range(4) r(l) GROUP BY ALL",
    )
    add(
        "instance_ids",
        lambda s, d: masks.instance_ids(_grid(s, d).select("image_id", "y", "x", F.floor(F.col("x") / 10).alias("person"), (F.col("y") % 3).alias("part"))),
        f"SELECT image_id, y, x, x // 10 AS person, y % 3 AS part, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY x // 10, y % 3) AS INT) AS instance FROM {GRID}",
    )
    add(
        "agnostic_fill",
        lambda s, d: masks.blend(_grid(s, d), _grid(s, d).withColumn("value", F.lit(128 / 255.0)), F.when(F.col("x") > F.col("y"), 1.0).otherwise(0.0)).select("image_id", "y", "x", F.round("value", 9).alias("value")),
        f"SELECT image_id, y, x, round(CASE WHEN x > y THEN 128 / 255.0::DOUBLE ELSE value END, 9) AS value FROM {GRID}",
    )
