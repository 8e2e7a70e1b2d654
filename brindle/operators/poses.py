"""Key points, grids and palettes: decoding arithmetic on arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def axis_argmax(scores: Column, ratio: float = 2.0) -> Column:
    """Place of the greatest score (the first), divided by the ratio; -1 if none is above 0."""
    top = F.array_max(scores)
    return F.when(top > 0, (F.array_position(scores, top) - 1) / ratio).otherwise(-1.0)


def decode_point(x_scores: Column, y_scores: Column, ratio: float = 2.0) -> Column:
    """struct(x, y, score): the score is the smaller of the two maxima."""
    score = F.least(F.array_max(x_scores), F.array_max(y_scores))
    spot = lambda s: F.when(score > 0, axis_argmax(s, ratio)).otherwise(-1.0)
    return F.struct(spot(x_scores).alias("x"), spot(y_scores).alias("y"), score.alias("score"))


def with_neck(points: Column, left: int = 5, right: int = 6, place: int = 17, least: float = 0.3) -> Column:
    """array<struct<x,y,score>> with the middle of two joints put in at ``place``; its score is 1 if both exceed ``least``."""
    a, b = F.get(points, F.lit(left)), F.get(points, F.lit(right))
    both = (a["score"] > least) & (b["score"] > least)
    neck = F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"), F.when(both, 1.0).otherwise(0.0).alias("score"))
    return F.concat(F.slice(points, 1, place), F.array(neck), F.slice(points, place + 1, F.greatest(F.size(points) - place, F.lit(0))))


def detector_grid(spark: SparkSession, width: int, height: int, strides: list[int]) -> DataFrame:
    """index, gx, gy, stride of all grid cells, stride by stride and row by row."""
    parts, start = [], 0
    for s in strides:
        w, h = width // s, height // s
        parts.append(spark.range(w * h).select((F.col("id") + start).alias("index"), (F.col("id") % w).alias("gx"), F.floor(F.col("id") / w).alias("gy"), F.lit(s).alias("stride")))
        start += w * h
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def decode_grid(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """dx, dy, dw, dh at a grid index to centre and size in pixels; further columns stay."""
    own = [c for c in rows.columns if c not in ("dx", "dy", "dw", "dh")]
    return rows.join(F.broadcast(grid), "index").select(*own, ((F.col("dx") + F.col("gx")) * F.col("stride")).alias("cx"), ((F.col("dy") + F.col("gy")) * F.col("stride")).alias("cy"), (F.exp("dw") * F.col("stride")).alias("w"), (F.exp("dh") * F.col("stride")).alias("h"))


def palette(spark: SparkSession, n: int) -> DataFrame:
    """label, r, g, b: bits 0, 1, 2 of the label, then of its eighth, and so on, fill the channels from the top bit."""
    channel = lambda c: sum((F.shiftleft(F.shiftright(F.col("id"), 3 * k + c).bitwiseAND(1), 7 - k) for k in range(1, 8)), F.shiftleft(F.shiftright(F.col("id"), c).bitwiseAND(1), 7))
    return spark.range(n).select(F.col("id").alias("label"), *[channel(c).alias(name) for c, name in enumerate("rgb")])


def triangular_index(i: Column, j: Column) -> Column:
    """Place of the pair in the lower triangle without the diagonal, row by row; null for equal ends."""
    big, small = F.greatest(i, j), F.least(i, j)
    return F.when(big != small, (big * (big - 1) / 2 + small).cast("long"))


def panoptic_quality(matches: DataFrame, by: str) -> DataFrame:
    """(by, iou of a match or null, kind tp/fp/fn) to pq, sq and rq."""
    tp, fp, fn = (F.count_if(F.col("kind") == k) for k in ("tp", "fp", "fn"))
    total = F.coalesce(F.sum(F.when(F.col("kind") == "tp", F.col("iou"))), F.lit(0.0))
    weight = tp + 0.5 * fp + 0.5 * fn
    return matches.groupBy(by).agg(F.coalesce(F.try_divide(total, weight), F.lit(0.0)).alias("pq"), F.coalesce(F.try_divide(total, tp), F.lit(0.0)).alias("sq"), F.coalesce(F.try_divide(tp, weight), F.lit(0.0)).alias("rq"))


def instance_confidence(pixels: DataFrame) -> DataFrame:
    """Mean of weighted logits over the pixels of each instance."""
    return pixels.groupBy("image_id", "instance").agg(F.avg(F.col("logit") * F.col("weight")).alias("confidence"))


def fuse_patches(patches: DataFrame) -> DataFrame:
    """Scores of overlapping patches: the mean, but the least for the background label 0."""
    return patches.groupBy("image_id", "y", "x", "label").agg(F.when(F.col("label") == 0, F.min("score")).otherwise(F.avg("score")).alias("score"))


def uncertain_points(points: DataFrame, by: str, logit: str, k: int, order: list[str]) -> DataFrame:
    """The k points of each image nearest to zero logit."""
    return points.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.abs(logit), *order))).filter(F.col("__n") <= k).drop("__n")


def with_truth(proposals: DataFrame, truths: DataFrame) -> DataFrame:
    """Truth boxes first, with a logit that stands for a score of nearly 1, then the proposals."""
    marked = truths.withColumns({"logit": F.lit(23.02585), "is_truth": F.lit(True)})
    return marked.unionByName(proposals.withColumn("is_truth", F.lit(False)), allowMissingColumns=True)


def sliders(config: str, given: dict[str, float] | None = None) -> dict[str, tuple[str, float | int]]:
    """Lines ``name, type, default, min, max, step`` as name -> (type, value); comments and broken lines are skipped.

    A given value is named ``value_<line>_<name>``. The result is plan-time: use ``slider_columns`` to select it.
    """
    out: dict[str, tuple[str, float | int]] = {}
    lines = [x.strip() for x in config.split("\n") if x.strip() and not x.strip().startswith("#")]
    for k, line in enumerate(lines):
        parts = [p.strip() for p in line.split(",")]
        try:
            name, kind, default, *bounds = parts
            cast = float if kind.upper() == "FLOAT" else int
            if len(bounds) != 3:
                continue
            [cast(b) for b in bounds]
            out[name] = (kind.upper(), (given or {}).get(f"value_{k}_{name}", cast(default)))
        except ValueError:
            continue
    return out


def slider_columns(config: str, given: dict[str, float] | None = None) -> list[Column]:
    return [F.lit(v).cast("double" if kind == "FLOAT" else "long").alias(name) for name, (kind, v) in sliders(config, given).items()]


def heat_label(x: Column, y: Column, seen: Column, box: tuple[Column, Column, Column, Column], side: int) -> Column:
    """struct(label, valid): the cell of a side x side map over the box, row by row; 0 and false outside or unseen.

    A point on the right or lower border belongs to the last cell.
    """
    place = lambda v, low, high: F.when(v == high, F.lit(side - 1)).otherwise(F.floor((v - low) * (F.lit(side) / (high - low))))
    column, row = place(x, box[0], box[2]), place(y, box[1], box[3])
    valid = column.between(0, side - 1) & row.between(0, side - 1) & (seen > 0)
    return F.struct(F.when(valid, row * side + column).otherwise(0).cast("long").alias("label"), valid.alias("valid"))


def _taps(place: Column, old: int, new: Column) -> list[tuple[Column, Column]]:
    """(source place, weight) of the four cubic samples of a target place, borders repeated."""
    point = (place + 0.5) * old / new - 0.5
    low = F.floor(point)
    near = lambda x: (1.25 * x - 2.25) * x * x + 1
    far = lambda x: (((x - 5) * x + 8) * x - 4) * -0.75
    part = point - low
    shares = (far(part + 1), near(part), near(1 - part), far(2 - part))
    return [(F.greatest(F.lit(0), F.least(F.lit(old - 1), low + k)).cast("int"), w) for k, w in zip((-1, 0, 1, 2), shares)]


def heat_points(maps: DataFrame, heat: str, side: int, box: tuple[Column, Column, Column, Column]) -> DataFrame:
    """``maps`` with x, y, logit and score of the highest place of each map, stretched over its box by cubic samples.

    ``heat`` holds side * side logits row by row. The map takes as many places as the box has pixels (sides under 1 count as 1, rounded up); the first of equal
    places in row order wins, and its middle is brought back to the true sides. ``score`` is the share of exp(logit) by the sum over the
    map as given, so that boxes of different sizes compare. One narrow pass, in the memory of one stretched map; maps of another length have nulls.
    """
    width, height = (F.greatest(F.lit(1.0), box[k + 2] - box[k]) for k in (0, 1))
    sized = maps.withColumns({"__m": F.when(F.size(heat) == side * side, F.col(heat)), "__w": width, "__h": height, "__x": box[0], "__y": box[1]})
    sized = sized.withColumns({"__n": F.ceil("__w").cast("int"), "__k": F.ceil("__h").cast("int")})
    places = lambda n: F.sequence(F.lit(0), n - 1)
    tall = F.flatten(F.transform(places(F.col("__k")), lambda y: F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda c: sum(w * F.get("__m", at * side + c) for at, w in _taps(y, side, F.col("__k"))))))
    grown = sized.withColumn("__t", F.when(F.col("__m").isNotNull(), tall))
    wide = F.flatten(F.transform(places(F.col("__k")), lambda y: F.transform(places(F.col("__n")), lambda x: F.struct(sum(w * F.get("__t", y * side + at) for at, w in _taps(x, side, F.col("__n"))).alias("v"), (-(y * F.col("__n") + x)).alias("p")))))
    best = grown.withColumn("__b", F.array_max(wide))
    place, top = -F.col("__b.p"), F.col("__b.v")
    total = F.aggregate(F.transform("__m", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b)
    made = {
        "x": (place % F.col("__n") + 0.5) * (F.col("__w") / F.col("__n")) + F.col("__x"),
        "y": (F.floor(place / F.col("__n")) + 0.5) * (F.col("__h") / F.col("__k")) + F.col("__y"),
        "logit": top,
        "score": 1 / total,
    }
    return best.select(*maps.columns, *[c.alias(name) for name, c in made.items()])


def center_scale(box: tuple[Column, Column, Column, Column], aspect: float, padding: float = 1.25) -> Column:
    """struct(cx, cy, w, h): the padded box grown on one side to the aspect w / h."""
    w, h = (box[2] - box[0]) * padding, (box[3] - box[1]) * padding
    wide = w > h * aspect
    grown = F.when(wide, w).otherwise(h * aspect).alias("w"), F.when(wide, w / aspect).otherwise(h).alias("h")
    return F.struct(((box[0] + box[2]) * 0.5).alias("cx"), ((box[1] + box[3]) * 0.5).alias("cy"), *grown)


def warp_matrix(cx: Column, cy: Column, w: Column, degrees: Column, out_w: float, out_h: float) -> Column:
    """struct(a, b, c, d, e, f) of x' = a x + b y + c, y' = d x + e y + f: the centre to the middle of the output, the width to its width."""
    scale, angle = F.lit(out_w) / w, F.radians(degrees)
    a, b = scale * F.cos(angle), scale * F.sin(angle)
    moved = (F.lit(out_w) * 0.5 - (a * cx + b * cy)).alias("c"), (F.lit(out_h) * 0.5 - (a * cy - b * cx)).alias("f")
    return F.struct(a.alias("a"), b.alias("b"), moved[0], (-b).alias("d"), a.alias("e"), moved[1])


# Reach of the hand beyond the wrist, side over the longer limb, weight of the upper arm; sides of a face
# over its distance to the eyes and to the ears; the least side of a box in pixels.
HAND_REACH, HAND_SIDE, UPPER_ARM = 0.33, 1.5, 0.9
EYE_SIDE, EAR_SIDE = 3.0, 1.5
LEAST_SIDE = 20


def _square(x: Column, y: Column, side: Column, reach: Column, width: Column, height: Column) -> Column:
    """struct(x, y, side) in whole pixels, cut where x + reach or y + reach leaves the image; null if too small."""
    x, y = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    cut = F.least(F.when(x + reach > width, width - x).otherwise(side), F.when(y + reach > height, height - y).otherwise(side))
    return F.when(cut >= LEAST_SIDE, F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), cut.cast("int").alias("side")))


def hand_box(shoulder: Column, elbow: Column, wrist: Column, width: Column, height: Column) -> Column:
    """Square around the hand from struct<x,y> joints; null if a joint is missing."""
    length = lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    side = F.greatest(length(wrist, elbow), length(elbow, shoulder) * UPPER_ARM) * HAND_SIDE
    corner = lambda c: wrist[c] + (wrist[c] - elbow[c]) * HAND_REACH - side / 2
    whole = shoulder.isNotNull() & elbow.isNotNull() & wrist.isNotNull()
    return F.when(whole, _square(corner("x"), corner("y"), side, side, width, height))


def face_box(nose: Column, eyes: list[Column], ears: list[Column], width: Column, height: Column) -> Column:
    """Square around the face from struct<x,y> points; null without the nose or without any eye or ear."""
    far = lambda p, times: F.greatest(F.abs(nose["x"] - p["x"]), F.abs(nose["y"] - p["y"])) * times
    half = F.greatest(*[far(p, EYE_SIDE) for p in eyes], *[far(p, EAR_SIDE) for p in ears])  # skips missing points
    return F.when(nose.isNotNull() & half.isNotNull(), _square(nose["x"] - half, nose["y"] - half, half * 2, half, width, height))
