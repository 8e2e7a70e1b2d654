"""Queries of connected regions, resizing, layouts, presets and rotated boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions.geometry import Box
from brindle.operators import layouts, masks, matching, presets, regions, resizing, rotated
from brindle.plans.annotations import BOXES, KEYS, TIES, boxes, suppressed_sql
from brindle.plans.pixels import GRID, HEIGHT, IMAGES, WIDTH, _canvases, _grid, dealt
from brindle.registry import Registry
from brindle.session import table

BLOBS = "(SELECT i AS image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CASE WHEN ((x // 3) * 7 + (y // 2) * 5 + i * 3 + b) % 11 < 3 AND i % 7 <> 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM " + IMAGES + ", range(24) b(y), range(30) c(x))"


def _blobs(s, d):
    on = ((F.floor(F.col("x") / 3) * 7 + F.floor(F.col("y") / 2) * 5 + F.col("image_id") * 3 + F.col("b")) % 11 < 3) & (F.col("image_id") % 7 != 6)
    return _canvases(s, d).select("image_id", "y", "x", F.when(on, 1.0).otherwise(0.0).alias("value"))


def _regions_sql(on: str, diagonal: bool) -> str:
    """All pixels of a region are reached from each other; a region is named by its first pixel."""
    near = "abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1" if diagonal else "abs(b.y - a.y) + abs(b.x - a.x) <= 1"
    return f"""px AS (SELECT image_id, y, x, y * {WIDTH} + x AS p FROM {BLOBS} WHERE {on}),
    st AS (SELECT a.image_id, a.p, b.p AS q FROM px a JOIN px b ON a.image_id = b.image_id AND {near}),
    reach AS (SELECT image_id, p, p AS r FROM px UNION SELECT reach.image_id, st.q, reach.r FROM reach JOIN st ON reach.image_id = st.image_id AND reach.p = st.p WHERE reach.r < st.q),
    reg AS (SELECT px.*, m.r FROM px JOIN (SELECT image_id, p, min(r) AS r FROM reach GROUP BY ALL) m USING (image_id, p)),
    box AS (SELECT image_id, r, count(*) AS area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM reg GROUP BY ALL)"""


def _canvas(pixels):
    return pixels.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("value") > 0.5, F.col("y") * 1000 + F.col("x"))).alias("places"), F.round(F.sum("value"), 6).alias("total"))


def _mapped(new: tuple[int, int], y: str, x: str, inside: str, fill: str) -> str:
    """SQL of a canvas whose pixel (t.y, t.x) reads the source pixel (y, x) where ``inside``."""
    return f"""SELECT t.image_id, t.y, t.x, CASE WHEN {inside} THEN g.value ELSE {fill} END AS value FROM (SELECT i AS image_id, y, x FROM (SELECT s_suppkey - 1 FROM supplier) a(i), range({new[0]}) b(y), range({new[1]}) c(x)) t
    LEFT JOIN {GRID} g ON g.image_id = t.image_id AND {inside} AND g.y = {y} AND g.x = {x}"""


def register(registry: Registry) -> None:
    add = registry.add
    add(
        "region_boxes",
        lambda s, d: regions.boxes_of(regions.regions(_blobs(s, d))).select("image_id", (F.col("region.region_y") * WIDTH + F.col("region.region_x")).alias("r"), "area", "x0", "y0", "x1", "y1"),
        f"WITH RECURSIVE {_regions_sql('value > 0.5', True)} SELECT image_id, CAST(r AS BIGINT) AS r, area, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1 FROM box",
    )
    add(
        "remove_small_regions",
        lambda s, d: regions.remove_small(_blobs(s, d), 13).select("image_id", "y", "x", "value"),
        f"""WITH RECURSIVE {_regions_sql('value > 0.5', True)} SELECT image_id, y, x, CASE WHEN value > 0.5 AND NOT EXISTS (SELECT 1 FROM box b WHERE b.image_id = g.image_id AND area < 13 AND g.x BETWEEN x0 AND x1 AND g.y BETWEEN y0 AND y1) THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM {BLOBS} g""",
    )
    add(
        "largest_region",
        lambda s, d: regions.largest(_blobs(s, d)).filter("value = 1").select("image_id", "y", "x"),
        f"WITH RECURSIVE {_regions_sql('value > 0.5', True)}, top AS (SELECT image_id, r FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, r) AS n FROM box) WHERE n = 1) SELECT image_id, y, x FROM reg JOIN top USING (image_id, r)",
    )
    add(
        "fill_holes",
        lambda s, d: regions.fill_holes(_blobs(s, d)).select("image_id", "y", "x", "value"),
        f"""WITH RECURSIVE {_regions_sql('value <= 0.5', False)}, out AS (SELECT image_id, r FROM box WHERE x0 = 0 OR y0 = 0 OR x1 = {WIDTH - 1} OR y1 = {HEIGHT - 1})
        SELECT g.image_id, g.y, g.x, CASE WHEN out.r IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM {BLOBS} g LEFT JOIN reg USING (image_id, y, x) LEFT JOIN out ON out.image_id = reg.image_id AND out.r = reg.r""",
    )
    k = " + ".join(f"exp(-{i * i} / 2.0)" for i in range(-4, 5))
    mirror = lambda c, n: f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} >= {n} THEN {2 * n - 1} - ({c}) ELSE {c} END"
    add(
        "mask_gaussian",
        lambda s, d: masks.gaussian(_grid(s, d), 1.0).select("image_id", "y", "x", F.round("value", 8).alias("value")),
        f"""WITH g AS (SELECT image_id, y::INT AS y, x::INT AS x, value FROM {GRID}), k AS (SELECT i::INT AS i, exp(-i * i / 2.0) / ({k}) AS w FROM range(-4, 5) r(i)),
        a AS (SELECT t.image_id, t.y, t.x, sum(g.value * w) AS v FROM g t, k JOIN g ON g.image_id = t.image_id AND g.x = t.x AND g.y = {mirror('t.y + k.i', HEIGHT)} GROUP BY ALL)
        SELECT t.image_id, t.y, t.x, round(sum(a.v * w), 8) AS value FROM a t, k JOIN a ON a.image_id = t.image_id AND a.y = t.y AND a.x = {mirror('t.x + k.i', WIDTH)} GROUP BY ALL""",
    )
    # 24 x 30 to 40 x 36: fit 29 x 36 (scale 1.2), cover 40 x 50 (scale 5/3), crop the source to 24 x 22.
    resized = {
        "pad": _mapped((40, 36), "(t.y - 5) * 24 // 29", "t.x * 30 // 36", "t.y BETWEEN 5 AND 33", "0.5"),
        "cover": _mapped((40, 36), "t.y * 24 // 40", "(t.x + 7) * 30 // 50", "true", "0"),
        "crop": _mapped((40, 36), "t.y * 24 // 40", "4 + t.x * 22 // 36", "true", "0"),
        "lock_ratio": _mapped((29, 36), "t.y * 24 // 29", "t.x * 30 // 36", "true", "0"),
    }
    for mode, sql in resized.items():
        add(
            f"resize_{mode}",
            lambda s, d, mode=mode: _canvas(resizing.resize(_grid(s, d), (HEIGHT, WIDTH), (40, 36), mode, 0.5)),
            f"SELECT image_id, count(*) AS n, CAST(sum(y * 1000 + x) FILTER (value > 0.5) AS BIGINT) AS places, round(sum(value), 6) AS total FROM ({sql}) GROUP BY image_id",
        )

    def target_mask(s, d):
        inside = F.col("y").between(3, 5 + F.col("image_id") % 9) & F.col("x").between(4, 9 + F.col("image_id") % 13)
        return _grid(s, d).withColumn("value", F.when(inside, 1.0).otherwise(0.0))

    def own_mask(s, d):
        inside = F.col("y").between(8, 13 + F.col("image_id") % 3) & F.col("x").between(10, 17 + F.col("image_id") % 4) & ((F.col("x") + F.col("y")) % 3 != 0)
        return _grid(s, d).withColumn("value", F.when(inside & (F.col("image_id") % 10 != 9), 1.0).otherwise(0.0))

    own_sql = f"(SELECT image_id, y, x, CASE WHEN y BETWEEN 8 AND 13 + image_id % 3 AND x BETWEEN 10 AND 17 + image_id % 4 AND (x + y) % 3 <> 0 AND image_id % 10 <> 9 THEN 1.0 ELSE 0.0 END AS value FROM {GRID})"
    boxes_sql = f"""b AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, (6 + image_id % 13) / (3 + image_id % 9) AS ra FROM {own_sql} WHERE value > 0.5 GROUP BY image_id)"""
    sizes = {
        "stretch": ("CASE WHEN ra > w / h THEN trunc(h * ra) ELSE w END", "CASE WHEN ra > w / h THEN h ELSE trunc(w / ra) END", "y0 + (t.y - py) * h // nh", "x0 + (t.x - px) * w // nw"),
        "crop": ("CASE WHEN ra > w / h THEN w ELSE trunc(h * ra) END", "CASE WHEN ra > w / h THEN trunc(w / ra) ELSE h END", "y0 + (h - nh) // 2 + t.y - py", "x0 + (w - nw) // 2 + t.x - px"),
        "pad": ("w", "h", "y0 + t.y - py", "x0 + t.x - px"),
    }
    for mode, (nw, nh, y, x) in sizes.items():
        add(
            f"mask_aspect_{mode}",
            lambda s, d, mode=mode: resizing.match_aspect(target_mask(s, d), own_mask(s, d), mode, (HEIGHT, WIDTH)).filter("value > 0").select("image_id", "y", "x"),
            f"""WITH {boxes_sql}, c AS (SELECT *, CAST({nw} AS BIGINT) AS nw, CAST({nh} AS BIGINT) AS nh FROM b), q AS (SELECT *, (x0 + x1) // 2 - nw // 2 AS px, (y0 + y1) // 2 - nh // 2 AS py FROM c)
            SELECT t.image_id, t.y, t.x FROM {GRID} t JOIN q USING (image_id) JOIN {own_sql} o ON o.image_id = t.image_id AND o.y = {y} AND o.x = {x} AND o.value > 0 WHERE t.y BETWEEN py AND py + nh - 1 AND t.x BETWEEN px AND px + nw - 1""",
        )
    def placed_sql(mode: str, best: str) -> str:
        """Size and place of each scaled image."""
        return f"""{boxes_sql}, i AS (SELECT i AS image_id, CASE WHEN i < 30 THEN i ELSE 0 END AS m FROM (SELECT s_suppkey - 1 FROM supplier) r(i)),
            c AS (SELECT i.image_id, b.x0 IS NULL AS e, b.*EXCLUDE (image_id), {best}(28 / w, 20 / h) AS s FROM i LEFT JOIN b ON b.image_id = i.m),
            z AS (SELECT *, CASE WHEN e THEN 28 ELSE CAST(round_even(30 * s, 0) AS BIGINT) END AS sw, CASE WHEN e THEN 20 ELSE CAST(round_even(24 * s, 0) AS BIGINT) END AS sh, CAST(round_even((x0 + x1) / 2 * s, 0) AS BIGINT) AS cx, CAST(round_even((y0 + y1) / 2 * s, 0) AS BIGINT) AS cy FROM c),
            k AS (SELECT *, greatest(0, least(cx - 14, sw - 28)) AS ax, greatest(0, least(cy - 10, sh - 20)) AS ay, greatest(least(14 - cx, 27), 1 - sw) AS px, greatest(least(10 - cy, 19), 1 - sh) AS py FROM z),
            o AS (SELECT image_id, sw, sh, CASE WHEN e THEN 0 WHEN '{mode}' = 'crop' AND ax + 28 <= sw AND ay + 20 <= sh THEN -ax ELSE px END AS dx, CASE WHEN e THEN 0 WHEN '{mode}' = 'crop' AND ax + 28 <= sw AND ay + 20 <= sh THEN -ay ELSE py END AS dy FROM k)"""

    for mode, best in (("pad", "least"), ("crop", "greatest")):
        add(
            f"resize_by_mask_{mode}",
            lambda s, d, mode=mode: _canvas(resizing.resize_by_mask(_grid(s, d), own_mask(s, d).filter("image_id < 30"), (HEIGHT, WIDTH), (20, 28), mode, 0.25)),
            f"""WITH {placed_sql(mode, best)},
            t AS (SELECT o.image_id, y, x, (y - dy) * 24 // sh AS sy, (x - dx) * 30 // sw AS sx, y - dy BETWEEN 0 AND sh - 1 AND x - dx BETWEEN 0 AND sw - 1 AS inside FROM o, range(20) a(y), range(28) b(x)),
            v AS (SELECT t.image_id, t.y, t.x, CASE WHEN inside THEN g.value ELSE {0.25 if mode == 'pad' else 0.0} END AS value FROM t LEFT JOIN {GRID} g ON inside AND g.image_id = t.image_id AND g.y = t.sy AND g.x = t.sx)
            SELECT image_id, count(*) AS n, CAST(sum(y * 1000 + x) FILTER (value > 0.5) AS BIGINT) AS places, round(sum(value), 6)::DOUBLE AS total FROM v GROUP BY image_id""",
        )

    # The SQL of 64 taps for each pixel takes minutes, so tests compare this one with the weight tables.
    add("resize_by_mask_lanczos4", lambda s, d: _canvas(resizing.resize_by_mask(_grid(s, d), own_mask(s, d).filter("image_id < 30"), (HEIGHT, WIDTH), (20, 28), "pad", 0.25, "lanczos4")).select("image_id", "n", "total"))

    def transforms(s, d):
        g = _grid(s, d)
        turned = resizing.quarter_turn(resizing.flip(resizing.flip(g, WIDTH), HEIGHT, "y"), WIDTH)
        cut = resizing.crop(turned, 4, 5, (20, 12)).withColumn("m", resizing.image_mean())
        return cut.select("image_id", "y", "x", resizing.to_bytes(resizing.adjust(F.col("value"), "contrast", 0.5, F.col("m")) * 1.3).alias("byte"))

    add(
        "image_transforms",
        transforms,
        f"""WITH f AS (SELECT image_id, {HEIGHT - 1} - y AS y, {WIDTH - 1} - x AS x, value FROM {GRID}), r AS (SELECT image_id, {WIDTH - 1} - x AS y, y AS x, value FROM f),
        c AS (SELECT image_id, y - 4 AS y, x - 5 AS x, value, avg(value) OVER (PARTITION BY image_id) AS m FROM r WHERE y BETWEEN 4 AND 23 AND x BETWEEN 5 AND 16)
        SELECT image_id, y, x, CAST(trunc(greatest(0, least(255, (m * 0.5 + value * 0.5) * 1.3 * 255))) AS INT) AS byte FROM c""",
    )

    def slots(s, d, make):
        p = table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 700 + 300).cast("long").alias("w"), (F.col("p_size") * 17 + 200).cast("long").alias("h"))
        return p.select("p_partkey", F.posexplode(make(F.col("w"), F.col("h"))).alias("slot", "s")).select("p_partkey", "slot", "s.x", "s.y", "s.width", "s.height")

    canvas = "c AS (SELECT p_partkey, p_partkey % 700 + 300 AS w, p_size * 17 + 200 AS h FROM part)"
    add(
        "layout_grid",
        lambda s, d: slots(s, d, lambda w, h: layouts.grid(w, h, 4, 3, (10, 20), (6, 8))),
        f"""WITH {canvas}, z AS (SELECT *, (w - 38) // 4 AS cw, (h - 56) // 3 AS ch FROM c), q AS (SELECT *, CAST(i AS INT) AS slot, 10 + (i % 4) * (cw + 6) AS x, 20 + (i // 4) * (ch + 8) AS y FROM z, range(12) r(i))
        SELECT p_partkey, slot, x, y, CASE WHEN i % 4 = 3 THEN w - 10 - x ELSE cw END AS width, CASE WHEN i // 4 = 2 THEN h - 20 - y ELSE ch END AS height FROM q""",
    )
    add(
        "layout_presets",
        lambda s, d: slots(s, d, lambda w, h: F.concat(*[layouts.preset(n, w, h, (4, 6), (5, 7)) for n in ("1_full", "2_vertical", "2_top_1_bottom", "2x3_mixed")])),
        f"""WITH {canvas}, z AS (SELECT *, w - 8 AS iw, h - 12 AS ih, (w - 13) // 2 AS half, CAST(round_even((h - 19) * 0.42::DOUBLE, 0) AS BIGINT) AS top, CAST(round_even((h - 26) * 0.2::DOUBLE / (0.2::DOUBLE + 0.2::DOUBLE + 0.44::DOUBLE), 0) AS BIGINT) AS f, (h - 19) // 2 AS vh FROM c),
        l AS (SELECT p_partkey, [{{'x': 4, 'y': 6, 'width': iw, 'height': ih}}, {{'x': 4, 'y': 6, 'width': w - 8, 'height': vh}}, {{'x': 4, 'y': 6 + vh + 7, 'width': w - 8, 'height': h - 6 - (6 + vh + 7)}},
          {{'x': 4, 'y': 6, 'width': half, 'height': top}}, {{'x': 4 + half + 5, 'y': 6, 'width': iw - half - 5, 'height': top}}, {{'x': 4, 'y': 6 + top + 7, 'width': iw, 'height': 6 + ih - (6 + top + 7)}},
          {{'x': 4, 'y': 6, 'width': half, 'height': f}}, {{'x': 4 + half + 5, 'y': 6, 'width': iw - half - 5, 'height': f}}, {{'x': 4, 'y': 6 + f + 7, 'width': half, 'height': f}}, {{'x': 4 + half + 5, 'y': 6 + f + 7, 'width': iw - half - 5, 'height': f}},
          {{'x': 4, 'y': 6 + 2 * (f + 7), 'width': half, 'height': ih - 14 - 2 * f}}, {{'x': 4 + half + 5, 'y': 6 + 2 * (f + 7), 'width': iw - half - 5, 'height': ih - 14 - 2 * f}}] AS a FROM z)
        SELECT p_partkey, CAST(i AS INT) AS slot, a[i + 1].x::BIGINT AS x, a[i + 1].y::BIGINT AS y, a[i + 1].width::BIGINT AS width, a[i + 1].height::BIGINT AS height FROM l, range(12) r(i)""",
    )
    add(
        "layout_custom",
        lambda s, d: slots(s, d, lambda w, h: F.concat(layouts.custom("# parts\n0.1, 0.2; 0.5 0.25\n9 10 20 30 40 # pixels", w, h), layouts.custom("10 0 50 100", w, h, "percent"))),
        f"""WITH {canvas} SELECT p_partkey, CAST(i AS INT) AS slot, CAST(CASE i WHEN 0 THEN round_even(w * 0.1::DOUBLE, 0) WHEN 1 THEN 10 ELSE round_even(w * 0.1::DOUBLE, 0) END AS BIGINT) AS x, CAST(CASE i WHEN 0 THEN round_even(h * 0.2::DOUBLE, 0) WHEN 1 THEN 20 ELSE 0 END AS BIGINT) AS y,
        CAST(CASE i WHEN 0 THEN round_even(w * 0.5::DOUBLE, 0) WHEN 1 THEN 30 ELSE round_even(w * 0.5::DOUBLE, 0) END AS BIGINT) AS width, CAST(CASE i WHEN 0 THEN round_even(h * 0.25::DOUBLE, 0) WHEN 1 THEN 40 ELSE h END AS BIGINT) AS height FROM c, range(3) r(i)""",
    )
    add(
        "preset_closest_by_size",
        lambda s, d: presets.closest_by_size(presets.presets(s), 3.3).select("model", "n", "place", "width", "height"),
        f"SELECT model, n, place, width, height FROM (SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY abs(width * height / 1e6 - 3.3), rank, place) AS INT) AS n FROM {presets.preset_values_sql()}) WHERE n <= 12",
    )
    add(
        "preset_info",
        lambda s, d: presets.presets(s).select("place", presets.info(F.col("model"), F.col("tier"), F.col("aspect"), F.col("width"), F.col("height"), F.col("reliability"), None, F.when(F.col("place") % 3 == 0, F.lit("slow")), F.when(F.col("place") % 5 == 0, F.lit("orientation swapped"))).alias("info")),
        f"""SELECT place, CASE WHEN regexp_matches(lower(tier || ' ' || reliability), 'community|extrapolation|rủi ro|risk') OR place % 5 = 0 THEN '⚠️ ' ELSE '' END || format('{{}} | {{}} | {{}} | {{}}×{{}} | {{:.2f}}MP', model, tier, aspect, width, height, width::DOUBLE * height / 1e6)
        || CASE WHEN place % 3 = 0 THEN chr(10) || 'Note: slow' ELSE '' END || CASE WHEN place % 5 = 0 THEN chr(10) || 'Adjustment: orientation swapped' ELSE '' END AS info FROM {presets.preset_values_sql()}""",
    )

    def picked(s, d):
        dim = presets.presets(s)
        n = dim.count()
        asked = table(s, d, "part").select("p_partkey", (F.col("p_partkey") % n).cast("int").alias("place"), (F.col("p_size") % 2 == 0).alias("swap"), (F.col("p_size") * 2 - 10).cast("long").alias("batch"), F.col("p_partkey") % 7)
        named = asked.join(F.broadcast(dim.select("place", "model", "tier", "aspect")), "place")
        named = named.select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, "none").otherwise(F.col("model")).alias("model"), F.when(F.col("p_partkey") % 13 == 0, "none").otherwise(F.col("tier")).alias("tier"), "aspect", "swap", "batch")
        made = presets.pick(named, dim)
        return made.select("p_partkey", "width", "height", "ratio", F.col("latent.b").alias("b"), F.col("latent.h").alias("h"), F.col("latent.w").alias("w"), F.round("aspect_ratio", 6).alias("aspect_ratio"))

    add(
        "preset_pick",
        picked,
        f"""WITH p AS (SELECT * FROM {presets.preset_values_sql()}), q AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN (SELECT arg_min(model, place) FROM p) ELSE p.model END AS model, CASE WHEN p_partkey % 13 = 0 THEN 'none' ELSE p.tier END AS tier, p.aspect, p_size % 2 = 0 AS swap, p_size * 2 - 10 AS batch FROM part JOIN p ON p.place = p_partkey % (SELECT count(*) FROM p)),
        f AS (SELECT q.*, coalesce(a.width, b.width) AS w0, coalesce(a.height, b.height) AS h0 FROM q LEFT JOIN (SELECT model, tier, aspect, arg_min(width, place) AS width, arg_min(height, place) AS height FROM p GROUP BY ALL) a ON a.model = q.model AND a.tier = q.tier AND a.aspect = q.aspect JOIN (SELECT model, arg_min(width, place) AS width, arg_min(height, place) AS height FROM p GROUP BY 1) b ON b.model = q.model),
        g AS (SELECT p_partkey, batch, CAST(CASE WHEN swap THEN h0 ELSE w0 END AS BIGINT) AS width, CAST(CASE WHEN swap THEN w0 ELSE h0 END AS BIGINT) AS height FROM f)
        SELECT p_partkey, width, height, CASE WHEN width // gcd(width, height) > 100 OR height // gcd(width, height) > 100 THEN printf('%.3f:1', width / height) ELSE (width // gcd(width, height)) || ':' || (height // gcd(width, height)) END AS ratio,
        greatest(1, least(64, batch)) AS b, height // 8 AS h, width // 8 AS w, round(width / height, 6) AS aspect_ratio FROM g""",
    )

    # Quarter turns: a box turned by 90 degrees is the upright one with its sides exchanged.
    def turned(s, d):
        number = F.row_number().over(Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_orderkey", *TIES)).cast("long")
        b, (cx, cy) = Box.of(), Box.of().center()
        quarter = F.col("l_linenumber") % 4
        w, h = F.when(quarter % 2 == 1, b.height).otherwise(b.width), F.when(quarter % 2 == 1, b.width).otherwise(b.height)
        return boxes(s, d).select(F.col("l_suppkey").alias("image"), F.col("l_returnflag").alias("label"), number.alias("det_id"), F.col("l_discount").alias("score"), cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), (quarter * 90.0).alias("angle"))

    upright = f"SELECT l_suppkey AS image, l_returnflag AS label, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY {KEYS}) AS det_id, l_discount AS score, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM {BOXES}"
    add(
        "rotated_nms",
        lambda s, d: rotated.rotated_suppression(turned(s, d), ["image", "label"], 0.4567, ties=["det_id"]).select("image", "label", "det_id", "score"),
        f"WITH RECURSIVE {suppressed_sql(upright, 0.4567)} SELECT image, label, det_id, score FROM kept",
    )

    def rotated_boxes(s, d):
        l = table(s, d, "lineitem")  # noqa: E741
        source = [F.lit(50.0), F.lit(40.0), F.lit(20.0), F.lit(10.0), F.lit(30.0)]
        box = [(F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double"), F.col("l_quantity"), F.col("l_linenumber") * 5.0, (F.col("l_partkey") % 9) * 90.25 - 361.0]
        weights = (10.0, 10.0, 5.0, 5.0, 1.0)
        deltas = rotated.encode(source, box, weights)
        back = rotated.decode(source, deltas, weights)
        clipped = rotated.clip_level(box, 60.0, 50.0)
        keys = [F.col(c) for c in ("l_orderkey", *TIES)]
        return l.select(*keys, *[F.round(v, 6).alias(n) for n, v in zip(("dx", "dy", "dw", "dh", "da"), deltas)], *[F.round(v, 4).alias(f"b_{n}") for n, v in zip(("cx", "w", "angle"), (back[0], back[2], back[4]))], *[F.round(v, 6).alias(f"c_{n}") for n, v in zip(("cx", "cy", "w", "h"), clipped)])

    add(
        "rotated_deltas",
        rotated_boxes,
        f"""WITH t AS (SELECT *, (l_partkey % 100)::DOUBLE AS cx, (l_suppkey % 100)::DOUBLE AS cy, l_quantity AS w, l_linenumber * 5.0::DOUBLE AS h, (l_partkey % 9) * 90.25::DOUBLE - 361.0 AS a FROM lineitem),
        u AS (SELECT *, (a - 30 + 180) - 360 * floor((a - 30 + 180) / 360) - 180 AS da, (a + 180) - 360 * floor((a + 180) / 360) - 180 AS wa, greatest(0, least(60, cx - w / 2)) AS x0, greatest(0, least(60, cx + w / 2)) AS x1, greatest(0, least(50, cy - h / 2)) AS y0, greatest(0, least(50, cy + h / 2)) AS y1 FROM t)
        SELECT {KEYS}, round((cx - 50) / 20 * 10, 6) AS dx, round((cy - 40) / 10 * 10, 6) AS dy, round(ln(w / 20) * 5, 6) AS dw, round(ln(h / 10) * 5, 6) AS dh, round(radians(da), 6) AS da, round(cx, 4) AS b_cx, round(w, 4) AS b_w, round(wa, 4) AS b_angle,
        round(CASE WHEN abs(wa) <= 1 THEN (x0 + x1) / 2 ELSE cx END, 6) AS c_cx, round(CASE WHEN abs(wa) <= 1 THEN (y0 + y1) / 2 ELSE cy END, 6) AS c_cy, round(CASE WHEN abs(wa) <= 1 THEN least(w, x1 - x0) ELSE w END, 6) AS c_w, round(CASE WHEN abs(wa) <= 1 THEN least(h, y1 - y0) ELSE h END, 6) AS c_h FROM u""",
    )

    # Masks of an image (a supplier) are runs of pixels; stuff is a label for each pixel.
    def masks_of(s, d):
        o = table(s, d, "lineitem")
        number = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", *TIES)).cast("long")
        runs = o.select(F.col("l_suppkey").alias("image"), number.alias("mask_id"), F.col("l_discount").alias("score"), F.col("l_linenumber").alias("label"), (F.col("l_partkey") % 90).alias("a"), F.col("l_quantity").cast("int").alias("n"))
        return runs.select("image", "mask_id", "score", "label", F.sequence(F.col("a"), F.col("a") + F.col("n") - 1).alias("pixels"))

    def semantic(s, d):
        return dealt(table(s, d, "supplier").select(F.col("s_suppkey").alias("image")), "image").select("image", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(139).cast("long"))).alias("pixel")).withColumn("label", F.floor(F.col("pixel") / 20) % 4)

    merge_sql = f"""r AS (SELECT l_suppkey AS image, row_number() OVER (PARTITION BY l_suppkey ORDER BY {KEYS}) AS mask_id, l_discount AS score, l_linenumber AS label, range(l_partkey % 90, l_partkey % 90 + l_quantity::INT) AS px FROM lineitem),
    o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, mask_id) AS n FROM r WHERE score >= 0.02),
    m AS (SELECT image, n, mask_id, score, label, px AS own, px AS taken FROM o WHERE n = 1
    UNION ALL SELECT o.image, o.n, o.mask_id, o.score, o.label, CASE WHEN len(list_intersect(o.px, m.taken)) / len(o.px) > 0.5 THEN [] ELSE list_filter(o.px, lambda p: NOT list_contains(m.taken, p)) END, CASE WHEN len(list_intersect(o.px, m.taken)) / len(o.px) > 0.5 THEN m.taken ELSE list_concat(m.taken, list_filter(o.px, lambda p: NOT list_contains(m.taken, p))) END FROM o JOIN m ON o.image = m.image AND o.n = m.n + 1),
    k AS (SELECT image, mask_id, score, label, unnest(own) AS pixel FROM m)"""
    add(
        "mask_suppression",
        lambda s, d: matching.mask_suppression(masks_of(s, d), "image", 0.5, 0.02),
        f"WITH RECURSIVE {merge_sql} SELECT image, mask_id, score, CAST(pixel AS BIGINT) AS pixel FROM k",
    )
    add(
        "panoptic_merge",
        lambda s, d: matching.panoptic_merge(masks_of(s, d), semantic(s, d), "image", 0.5, 0.02, 12).select("image", "segment", "is_thing", "label", "pixel"),
        f"""WITH RECURSIVE {merge_sql}, a AS (SELECT image, CAST(dense_rank() OVER (PARTITION BY image ORDER BY score DESC, mask_id) AS INT) AS segment, label, pixel FROM k),
        f AS (SELECT s_suppkey AS image, pixel, (pixel // 20) % 4 AS label FROM supplier, range(140) p(pixel) WHERE (pixel // 20) % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM k WHERE k.image = s_suppkey AND k.pixel = p.pixel)),
        g AS (SELECT image, label, CAST(row_number() OVER (PARTITION BY image ORDER BY label) AS INT) + coalesce((SELECT max(segment) FROM a WHERE a.image = z.image), 0) AS segment FROM (SELECT image, label, count(*) AS n FROM f GROUP BY ALL) z WHERE n >= 12)
        SELECT image, segment, true AS is_thing, label, CAST(pixel AS BIGINT) AS pixel FROM a UNION ALL SELECT image, segment, false, label, pixel FROM f JOIN g USING (image, label)""",
    )
