"""Samplers: repeatable for a seed, and deterministic in how they deal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.metrics import running_sums


def draw(seed: int, *keys: str) -> Column:
    """A repeatable number in [0, 1) for each key."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def weighted_pick(values: list[Column], weights: list[float], random: Column) -> Column:
    """struct(value, index, probability) among the values that are there; weights go by place among those."""
    there = F.filter(F.transform(F.array(*values), lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: x["v"].isNotNull())
    w = F.array(*[F.lit(float(x)) for x in weights])
    weighed = F.transform(there, lambda x, k: F.struct(x["v"].alias("v"), x["i"].alias("i"), F.greatest(F.coalesce(F.get(w, k), F.lit(1.0)), F.lit(0.0)).alias("w")))
    total = F.aggregate(weighed, F.lit(0.0), lambda s, x: s + x["w"])
    run = F.transform(weighed, lambda x, k: F.struct(x["v"].alias("v"), x["i"].alias("i"), x["w"].alias("w"), F.aggregate(F.slice(weighed, 1, k + 1), F.lit(0.0), lambda s, y: s + y["w"]).alias("c")))
    hit = F.get(F.filter(run, lambda x: x["c"] >= random * total), F.lit(0))
    return F.struct(hit["v"].alias("value"), hit["i"].alias("index"), F.try_divide(hit["w"], total).alias("probability"))


def balanced_sample(df: DataFrame, by: str, positive: Column, size: int, share: float, key: str, seed: int) -> DataFrame:
    """Up to ``size * share`` positives of each group and negatives for the rest."""
    marked = df.withColumn("__p", positive).withColumn("__r", draw(seed, key))
    order = Window.partitionBy(by, "__p").orderBy("__r", key)
    ranked = marked.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= size)
    most = int(size * share)
    taken = ranked.withColumn("__k", F.sum(F.when(F.col("__p") & (F.col("__n") <= most), 1).otherwise(0)).over(Window.partitionBy(by)))
    return taken.filter(F.when(F.col("__p"), F.col("__n") <= most).otherwise(F.col("__n") <= size - F.col("__k"))).drop("__p", "__r", "__n", "__k")


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """The shuffled rows of an epoch, with their place ``pos`` by a total order over range partitions."""
    return df.withColumn("epoch", F.lit(epoch)).withColumn("__r", F.xxhash64(F.lit(seed), F.lit(epoch), key)).orderBy("__r", key).drop("__r")


def repeated(df: DataFrame, factor: str, key: str, seed: int, epoch: int) -> DataFrame:
    """Each row floor(factor) times, and once more with the odds of the rest."""
    times = F.floor(factor) + F.when(draw(seed + epoch, key) < F.col(factor) - F.floor(factor), 1).otherwise(0)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int"))))


def contiguous_shard(pos: Column, rows: int, world: int) -> Column:
    """The rank that holds a position, if ranks take contiguous shares rounded up."""
    return F.floor(pos / max(1, -(-rows // world))).cast("long")


def interleaved_shard(pos: Column, world: int) -> Column:
    return pos % world


def group_batches(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Batches of rows of one group; incomplete ones at the end of a group are dropped. Places are running sums over ranges, so no task holds a group."""
    keyed = df.withColumn("__group", F.struct(F.col(group)))
    placed = running_sums(keyed, ["__group"], [F.col(c) for c in order], {"__at": F.lit(1)}).drop("__p")
    sizes = keyed.groupBy("__group").agg(F.count("*").alias("__all"))
    marked = placed.join(sizes, "__group").withColumn("batch", F.floor((F.col("__at") - 1) / size))
    return marked.filter(F.col("batch") < F.floor(F.col("__all") / size)).select(*df.columns, "batch")


def test_time_grid(df: DataFrame, sizes: list[int], flips: bool = True) -> DataFrame:
    grid = df.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    return grid.withColumn("flip", F.explode(F.array(F.lit(False), F.lit(True)))) if flips else grid
