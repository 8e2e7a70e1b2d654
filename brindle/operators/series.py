"""Metric series (name, iter, value) as windows, and closed-form schedules."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from brindle.operators.metrics import running_sums


BLOCK = 100_000  # rows of one series that a task holds


def _placed(df: DataFrame, name: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with running sums along each series; a series is dealt to ranges, so that one long one takes no task whole. Null names are one series."""
    keyed = df.withColumn("__name", F.struct(F.col(name)))
    return running_sums(keyed, ["__name"], [F.col(c) for c in order], values).drop("__p")


def _over_last(df: DataFrame, name: str, order: list[str], n: int, made: dict[str, Callable[[WindowSpec], Column]], sums: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """``df`` with ``made`` over the last ``n`` rows of each series, which is cut into blocks; each block is led by the n - 1 rows before it."""
    if n > block:
        raise ValueError(f"a window has at most {block} rows")
    at = F.col("__at") - 1
    own = F.floor(at / block)
    placed = _placed(df, name, order, {"__at": F.lit(1), **(sums or {})}).withColumn("__own", own)
    spread = placed.withColumn("__b", F.explode(F.when(at % block > block - n, F.array(own, own + 1)).otherwise(F.array(own))))
    window = Window.partitionBy("__name", "__b").orderBy("__at").rowsBetween(-(n - 1), 0)
    return spread.withColumns({k: f(window) for k, f in made.items()}).filter("__b = __own").drop("__name", "__at", "__own", "__b")


def smoothed(df: DataFrame, name: str, value: str, order: list[str], window: int = 20, smooth: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Median of the last ``window`` values of each series; the value itself where ``smooth`` is false."""
    median = _over_last(df, name, order, window, {"smoothed": lambda w: F.percentile(F.col(value), F.lit(0.5)).over(w)}, block=block)
    return median if smooth is None else median.withColumn("smoothed", F.when(smooth, F.col("smoothed")).otherwise(F.col(value)))


def running_average(df: DataFrame, name: str, value: str, order: list[str], window: int, block: int = BLOCK) -> DataFrame:
    sums = {"__sum": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "__n": F.col(value).isNotNull().cast("long")}
    made = _over_last(df, name, order, window, {"avg_window": lambda w: F.avg(value).over(w)}, sums, block)
    return made.withColumn("avg_global", F.try_divide("__sum", "__n")).drop("__sum", "__n")


def histogram(df: DataFrame, value: str, low: float, high: float, buckets: int) -> DataFrame:
    """Counts of equal buckets; the last one holds its upper edge."""
    bucket = F.least(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(buckets)), F.lit(buckets))
    return df.filter(F.col(value).between(low, high)).groupBy((bucket - 1).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def value_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("num"), F.sum(v).alias("sum"), F.sum(v * v).alias("sumsq"))


def reduce_metrics(df: DataFrame, name: str, value: str, average: bool = True) -> DataFrame:
    return df.groupBy(name).agg((F.avg if average else F.sum)(value).alias(value))


def moving_average(old: Column, new: Column, decay: float = 0.99) -> Column:
    return old * decay + new * (1 - decay)


def byte_offsets(df: DataFrame, size: str, order: list[str], by: str) -> DataFrame:
    """Running end of each item within its file."""
    return _placed(df, by, order, {"end": F.col(size)}).drop("__name")


def warmup(step: Column, steps: int, factor: float, kind: str = "linear") -> Column:
    inside = F.lit(factor) if kind == "constant" else factor * (1 - step / steps) + step / steps
    return F.when(step >= steps, 1.0).otherwise(inside)


def multistep_rate(step: Column, base: float, milestones: list[int], gamma: float = 0.1, warm: int = 0, factor: float = 0.001) -> Column:
    passed = sum((F.when(step >= m, 1).otherwise(0) for m in milestones), F.lit(0))
    return base * (warmup(step, warm, factor) if warm else F.lit(1.0)) * F.pow(F.lit(gamma), passed)


def cosine_rate(step: Column, base: float, most: int, warm: int = 0, factor: float = 0.001) -> Column:
    return base * (warmup(step, warm, factor) if warm else F.lit(1.0)) * 0.5 * (1 + F.cos(pi * step / most))
