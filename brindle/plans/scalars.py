"""Queries of the scalar, logic and list operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import lists, logic, text
from brindle.functions.expressions import math_eval
from brindle.functions.selector import select_entries
from brindle.operators import presets, sampling
from brindle.registry import Registry
from brindle.session import table


def register(registry: Registry) -> None:
    add = registry.add
    add(
        "selector_orders",
        lambda s, d: select_entries(table(s, d, "orders"), "o_orderkey:int=10-500", 400, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "o_totalprice"),
        "SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 400) WHERE o_orderkey BETWEEN 10 AND 500",
    )
    add(
        "selector_text_range",
        lambda s, d: select_entries(table(s, d, "orders"), "o_orderpriority=1-URGENT,o_orderstatus=F").select("o_orderkey", "o_orderpriority"),
        "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority BETWEEN '1' AND 'URGENT' AND o_orderstatus = 'F'",
    )
    ops = [("upper", ""), ("lower", ""), ("contains", "STEEL"), ("startswith", "s"), ("endswith", "r"), ("length", ""), ("slice", "2:-2"), ("slice", "-4:"), ("slice", "3")]

    def string_ops(s, d):
        p = table(s, d, "part")
        cols = [text.string_op(F.col("p_name"), op, a).alias(f"r{k}") for k, (op, a) in enumerate(ops)]
        made = p.select("p_partkey", *cols)
        return made.select("p_partkey", *[F.col(f"r{k}.{c}").alias(f"{c}_{k}") for k in range(len(ops)) for c in ("text_out", "bool_out", "int_out")])

    n = "CAST(length(p_name) AS BIGINT)"
    plain = {
        0: ("upper(p_name)", "true", n), 1: ("lower(p_name)", "true", n), 2: ("p_name", "contains(lower(p_name), 'steel')", n), 3: ("p_name", "starts_with(p_name, 's')", n),
        4: ("p_name", "suffix(p_name, 'r')", n), 5: ("p_name", "length(p_name) > 0", n),
        6: ("p_name[3:greatest(length(p_name) - 2, 0)]", "true", None), 7: ("p_name[greatest(length(p_name) - 4, 0) + 1:]", "true", None), 8: ("p_name[4:4]", "true", None),
    }
    sql = ", ".join(f"{t} AS text_out_{k}, {b} AS bool_out_{k}, {i or f'CAST(length({t}) AS BIGINT)'} AS int_out_{k}" for k, (t, b, i) in plain.items())
    add("string_ops", string_ops, f"SELECT p_partkey, {sql} FROM part")

    def split_join(s, d):
        p = table(s, d, "part").withColumn("s", text.split_text(F.col("p_type"), " ")).withColumn("j", text.join_parts([F.col("p_brand"), F.lit(None).cast("string"), F.lit("  "), F.col("p_type")], " / "))
        c = text.concatenate([F.col("p_brand"), F.lit(""), F.col("p_name")], "\\n")
        return p.select("p_partkey", F.col("s.items").alias("items"), F.col("s.count").alias("n_items"), F.col("s.first").alias("first_item"), F.col("s.last").alias("last_item"), F.col("j.text").alias("joined"), F.col("j.count").alias("n_joined"), c.alias("both"))

    add(
        "split_join_text",
        split_join,
        """WITH t AS (SELECT *, list_filter(list_transform(string_split(p_type, ' '), lambda x: trim(x)), lambda x: x <> '') AS a FROM part)
        SELECT p_partkey, array_to_string(a, chr(10)) AS items, CAST(len(a) AS BIGINT) AS n_items, coalesce(a[1], '') AS first_item, coalesce(a[-1], '') AS last_item,
        trim(p_brand) || ' / ' || trim(p_type) AS joined, CAST(2 AS BIGINT) AS n_joined, p_brand || chr(10) || p_name AS both FROM t""",
    )

    def regexes(s, d):
        p = table(s, d, "part")
        made = p.select("p_partkey", text.regex_extract(F.col("p_brand"), r"([A-Z])\w*#(\d)(\d)", "match").alias("m"), text.regex_extract(F.col("p_name"), "[aeiou]", "findall").alias("f"), text.regex_extract(F.col("p_name"), "([aeiou])", "replace", r"<\1>").alias("r"), text.regex_extract(F.col("p_type"), r"\s+", "split").alias("s"))
        return made.select("p_partkey", *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in "mfrs" for c in ("result", "found", "count")], F.col("m.groups").alias("m_groups"))

    add(
        "regex_extract",
        regexes,
        r"""WITH t AS (SELECT *, regexp_extract_all(p_name, '[aeiou]') AS v, list_filter(regexp_split_to_array(p_type, '\s+'), lambda x: x <> '') AS w,
        regexp_matches(p_brand, '([A-Z])\w*#(\d)(\d)') AS hit FROM part)
        SELECT p_partkey, regexp_extract(p_brand, '([A-Z])\w*#(\d)(\d)', 0) AS m_result, hit AS m_found, CAST(hit AS BIGINT) AS m_count,
        array_to_string(v, chr(10)) AS f_result, len(v) > 0 AS f_found, CAST(len(v) AS BIGINT) AS f_count,
        regexp_replace(p_name, '([aeiou])', '<\1>', 'g') AS r_result, len(v) > 0 AS r_found, CAST(len(v) AS BIGINT) AS r_count,
        array_to_string(w, chr(10)) AS s_result, len(w) > 1 AS s_found, CAST(len(w) AS BIGINT) AS s_count,
        CASE WHEN hit THEN regexp_extract(p_brand, '([A-Z])\w*#(\d)(\d)', 1) || chr(10) || regexp_extract(p_brand, '([A-Z])\w*#(\d)(\d)', 2) || chr(10) || regexp_extract(p_brand, '([A-Z])\w*#(\d)(\d)', 3) ELSE '' END AS m_groups FROM t""",
    )

    def comparisons(s, d):
        o = table(s, d, "orders")
        a, b = F.col("o_orderkey").cast("string"), F.col("o_custkey")
        return o.select("o_orderkey", logic.compare(a, b, ">").alias("gt"), logic.compare(F.col("o_orderstatus"), F.lit("F"), "is").alias("is_f"), logic.compare(F.col("o_orderkey") % 10, F.col("o_totalprice"), "in").alias("inside"), logic.compare(F.lit(None), F.lit(1), "is").alias("nothing"), logic.gate(F.col("o_orderkey") % 2 == 0, F.lit(None).cast("boolean"), "NOR").alias("nor"), logic.gate(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0, "XOR").alias("xor"))

    add(
        "compare_and_gates",
        lambda s, d: comparisons(s, d).drop("inside"),
        """SELECT o_orderkey, o_orderkey > o_custkey AS gt, o_orderstatus = 'F' AS is_f, false AS nothing, o_orderkey % 2 <> 0 AS nor, (o_orderkey % 2 = 0) <> (o_orderkey % 3 = 0) AS xor FROM orders""",
    )

    def routing(s, d):
        o = table(s, d, "orders")
        sw = logic.switch([F.when(F.col("o_orderkey") % 2 == 0, F.lit("even")), F.when(F.col("o_orderkey") % 3 == 0, F.lit("three")), F.lit("rest")], (F.col("o_orderkey") % 3).cast("int"))
        made = o.withColumn("sw", sw).withColumn("hit", logic.match_index(F.col("o_orderpriority"), [F.lit("URGENT"), F.lit("HIGH"), F.lit("")], "in"))
        return made.select("o_orderkey", F.col("sw.value").alias("value"), F.col("sw.count").alias("n"), "hit", logic.if_else(F.col("o_orderstatus") == "F", F.lit(1), F.lit(0)).alias("closed"), logic.pick(F.array(F.lit("a"), F.lit(""), F.lit("c")), (F.col("o_orderkey") % 5).cast("int")).alias("picked"))

    add(
        "switches",
        routing,
        """WITH t AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'even' END AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'three' END AS b FROM orders)
        SELECT o_orderkey, coalesce(CASE o_orderkey % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE 'rest' END, a, b, 'rest') AS value,
        CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1 AS BIGINT) AS n,
        CAST(CASE WHEN contains(o_orderpriority, 'URGENT') THEN 1 WHEN contains(o_orderpriority, 'HIGH') THEN 2 ELSE 0 END AS BIGINT) AS hit,
        CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS closed, CASE o_orderkey % 5 WHEN 1 THEN 'a' WHEN 3 THEN 'c' END AS picked FROM t""",
    )
    add(
        "branch_two",
        lambda s, d: logic.route(logic.pass_gate(table(s, d, "orders"), F.col("o_orderstatus"), F.col("o_totalprice") > 1000), F.col("o_orderkey") % 9 - 2)[4].select("o_orderkey"),
        "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus IS NOT NULL AND o_orderkey % 9 - 2 >= 4",
    )

    def list_ops(s, d):
        p = table(s, d, "part").withColumn("items", text.split_items(F.col("p_name"), " "))
        made = p.withColumn("f", lists.filter_list(F.col("items"), "len>=6")).withColumn("e", lists.filter_list(F.col("items"), "contains: E", "exclude")).withColumn("w", lists.item_at(F.col("items"), F.lit(-1))).withColumn("c", lists.item_at(F.col("items"), F.lit(-7), wrap=False))
        return made.select("p_partkey", F.array_join("f.passed", " ").alias("long"), F.col("f.n_rejected").alias("n_short"), F.array_join("e.passed", " ").alias("without_e"), F.col("w.item").alias("last"), F.col("w.is_last").alias("is_last"), F.col("c.item").alias("clamped"), F.array_join(lists.reorder(F.col("items"), "reverse"), " ").alias("back"))

    add(
        "list_ops",
        list_ops,
        """WITH t AS (SELECT *, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS a FROM part)
        SELECT p_partkey, array_to_string(list_filter(a, lambda x: length(x) >= 6), ' ') AS long, CAST(len(list_filter(a, lambda x: length(x) < 6)) AS BIGINT) AS n_short,
        array_to_string(list_filter(a, lambda x: NOT contains(lower(x), 'e')), ' ') AS without_e, coalesce(a[-1], '') AS last, true AS is_last, coalesce(a[1], '') AS clamped,
        array_to_string(list_reverse(a), ' ') AS back FROM t""",
    )
    add(
        "text_lines",
        lambda s, d: lists.lines_table(table(s, d, "documents").select("doc_id", "text"), F.col("text")).select("doc_id", "pos", "line", "is_first", "is_last"),
        """WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '') AS a FROM documents)
        SELECT doc_id, CAST(i - 1 AS INT) AS pos, a[i] AS line, i = 1 AS is_first, i = len(a) AS is_last FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM t)""",
    )
    math = "clamp(a // 7 - b % 5 + round(c / 3), -50, 900) / (d - d) + a ** 2"
    add(
        "math_eval",
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", math_eval(math, {"a": F.col("l_partkey") - 500, "b": F.col("l_suppkey") - 60, "c": F.col("l_quantity"), "d": F.col("l_discount")}, 3)["result"].alias("r"), math_eval("-a // 4 + a % 0", {"a": F.col("l_quantity")})["result"].alias("zero"), math_eval("sqrt(a) + min(a, b, 7)", {"a": F.col("l_quantity"), "b": F.col("l_tax")}, 4)["result"].alias("m")),
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CAST(power(CAST(l_partkey - 500 AS DOUBLE), 2) AS DOUBLE), 3) AS r, CAST(0 AS DOUBLE) AS zero,
        round_even(sqrt(l_quantity) + least(l_quantity, l_tax, 7), 4) AS m FROM lineitem""",
    )

    def prompts(s, d):
        o = table(s, d, "orders")
        t = text.render_template(F.lit("a {color}, {style} ,{size}"), ["color", "style", "size"], [F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(" bold ")), F.lit("")])
        q = text.schedule(F.lit("one\n two\n\nthree"), F.col("o_orderkey") % 7, F.lit(10), "pingpong")
        r = text.schedule(F.lit("one\n two\n\nthree"), F.col("o_orderkey") % 12, F.lit(10), "sequential")
        made = o.select("o_orderkey", t.alias("t"), q.alias("q"), r.alias("r"))
        return made.select("o_orderkey", F.col("t.text").alias("prompt"), F.col("t.missing").alias("missing"), F.col("q.prompt").alias("ping"), F.col("r.prompt").alias("seq"), F.round("r.progress", 6).alias("progress"))

    add(
        "prompt_template_schedule",
        prompts,
        """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a ' || o_orderstatus || ', bold' ELSE 'a ' || o_orderstatus END AS prompt,
        CASE WHEN o_orderkey % 2 = 0 THEN 'size' ELSE 'style, size' END AS missing, (['one', 'two', 'three', 'two'])[o_orderkey % 7 % 4 + 1] AS ping,
        (['one', 'two', 'three'])[CAST(least((o_orderkey % 12) // 3, 2) AS BIGINT) + 1] AS seq, round(least(1.0, (o_orderkey % 12) / 10.0), 6)::DOUBLE AS progress FROM orders""",
    )
    add(
        "counter_runs",
        lambda s, d: table(s, d, "customer").select((F.col("c_custkey") - 1).alias("run"), logic.counter(F.col("c_custkey") - 1, 0, 2, 9).alias("c")).select("run", "c.value", "c.done", F.round("c.progress", 6).alias("progress"), "c.remaining"),
        """SELECT r AS run, least(2 * least(r, 5), 9) AS value, 2 * least(r, 5) > 9 AS done, round(least(1.0, 2 * least(r, 5) / 9), 6)::DOUBLE AS progress, greatest(0, 9 - 2 * least(r, 5) + 1) AS remaining FROM (SELECT c_custkey - 1 AS r FROM customer)""",
    )
    add(
        "natural_order",
        lambda s, d: table(s, d, "customer").select("c_custkey", F.concat_ws("", F.substring("c_mktsegment", 1, 3), (F.col("c_custkey") % 200).cast("string"), F.lit("b")).alias("name")).orderBy(text.natural_key(F.col("name")), "c_custkey").withColumn("number", F.get(text.natural_key(F.col("name")), F.lit(0))["number"].cast("long")),
        "SELECT c_custkey, c_mktsegment[1:3] || (c_custkey % 200) || 'b' AS name, c_custkey % 200 AS number FROM customer",
    )
    add(
        "paths_and_colors",
        lambda s, d: table(s, d, "supplier").select("s_suppkey", text.stem(F.concat_ws("/", F.lit("a b"), F.col("s_name"), F.concat(F.lit("img."), F.col("s_suppkey").cast("string"), F.lit(".png")))).alias("stem"), text.hex_color(F.concat(F.lit("#0f"), F.lpad(F.hex(F.col("s_suppkey") % 16), 1, "0")))["b"].alias("blue"), text.ratio_label(F.col("s_suppkey") * 4 + 4, F.col("s_suppkey") * 3 + 3).alias("ratio"), text.short_name(F.col("s_name")).alias("short")),
        "SELECT s_suppkey, 'img.' || s_suppkey AS stem, CAST((s_suppkey % 16) * 17 AS INT) AS blue, '4:3' AS ratio, CASE WHEN length(s_name) > 13 THEN s_name[1:11] || '..' ELSE s_name END AS short FROM supplier",
    )
    add("presets_sorted", lambda s, d: presets.presets(s).select("place", "model", "tier", "aspect", "width", "height", "reliability", "sweet"), f"SELECT place, model, tier, aspect, width, height, reliability, sweet FROM {presets.preset_values_sql()}")
    add(
        "preset_nearest_ratio",
        lambda s, d: presets.nearest_preset(table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 1900 + 100).alias("width"), (F.col("p_size") * 30 + 50).alias("height")), s, "FLUX.2 Klein 9B", "2 MP", 2.0),
        f"""WITH q AS (SELECT p_partkey, p_partkey % 1900 + 100 AS width, p_size * 30 + 50 AS height FROM part),
        c AS (SELECT q.*, p.aspect AS preset_aspect, p.width AS preset_width, p.height AS preset_height, row_number() OVER (PARTITION BY p_partkey ORDER BY round(abs(ln(p.width / p.height / (q.width / q.height))), 12), p.rank, abs(p.width * p.height / 1e6 - 2.0), p.width * p.height, p.width) AS n
        FROM q, {presets.preset_values_sql()} WHERE p.model = 'FLUX.2 Klein 9B' AND starts_with(p.tier, '2 MP')) SELECT p_partkey, width, height, preset_aspect, preset_width, preset_height FROM c WHERE n = 1""",
    )

    def custom(s, d):
        p = table(s, d, "part").select("p_partkey", presets.custom_resolution(F.col("p_partkey") + 7, F.col("p_size") * 50).alias("c"), presets.to_pixels(F.col("p_size"), "mm", 300).alias("px"))
        return p.select("p_partkey", F.col("c.width").alias("width"), F.col("c.height").alias("height"), F.col("c.snapped").alias("snapped"), F.col("c.clamped").alias("clamped"), "px")

    add(
        "custom_resolution",
        custom,
        """WITH t AS (SELECT p_partkey, p_partkey + 7 AS w0, p_size * 50 AS h0, CAST(floor((p_partkey + 7) / 16 + 0.5) * 16 AS BIGINT) AS w, CAST(floor(p_size * 50 / 16 + 0.5) * 16 AS BIGINT) AS h, p_size FROM part)
        SELECT p_partkey, greatest(64, least(2048, w)) AS width, greatest(64, least(2048, h)) AS height, w <> w0 OR h <> h0 AS snapped, greatest(64, least(2048, w)) <> w OR greatest(64, least(2048, h)) <> h AS clamped, CAST(round_even(p_size / 25.4 * 300, 0) AS BIGINT) AS px FROM t""",
    )
    add(
        "grid_layout",
        lambda s, d: presets.grid_slots(s, 1000, 700, 4, 3, 10, 20, 6, 8),
        "SELECT i AS slot, 10 + (i % 4) * 246 AS x, 20 + (i // 4) * 222 AS y, CAST(CASE WHEN i % 4 = 3 THEN 242 ELSE 240 END AS BIGINT) AS width, CAST(CASE WHEN i // 4 = 2 THEN 216 ELSE 214 END AS BIGINT) AS height FROM range(12) t(i)",
    )

    def picks(s, d):
        e = table(s, d, "events")
        w = sampling.weighted_pick([F.lit("a"), F.when(F.col("event_id") % 2 == 0, F.lit("b")), F.lit("c")], [1, 2, 1], (F.col("event_id") % 100) / 100.0)
        return e.select("event_id", w.alias("w")).select("event_id", F.col("w.value").alias("value"), F.col("w.index").alias("place"), F.round("w.probability", 6).alias("probability"))

    add(
        "weighted_pick",
        picks,
        """WITH t AS (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS r, event_id % 2 = 0 AS e FROM events)
        SELECT event_id, CASE WHEN e THEN CASE WHEN r * 4 <= 1 THEN 'a' WHEN r * 4 <= 3 THEN 'b' ELSE 'c' END ELSE CASE WHEN r * 3 <= 1 THEN 'a' ELSE 'c' END END AS value,
        CASE WHEN e THEN CASE WHEN r * 4 <= 1 THEN 0 WHEN r * 4 <= 3 THEN 1 ELSE 2 END ELSE CASE WHEN r * 3 <= 1 THEN 0 ELSE 2 END END AS place,
        round(CASE WHEN e THEN CASE WHEN r * 4 <= 1 THEN 0.25 WHEN r * 4 <= 3 THEN 0.5 ELSE 0.25 END ELSE CASE WHEN r * 3 <= 1 THEN 1.0 / 3 ELSE 2.0 / 3 END END, 6)::DOUBLE AS probability FROM t""",
    )
