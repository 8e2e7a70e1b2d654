"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

With n rows in P partitions and blocks of fixed sizes, the numbers of rows that a uniform permutation
sends from each partition to each block have a multivariate hypergeometric law. ``matrix_row`` draws one
row of that matrix from the partition sizes alone: it halves the partitions again and again, and draws at
each step how many places of each block go to the half that it follows. The draws of a step come from
``seed`` and the range of partitions, so all tasks see the same halves, their rows add up exactly, and no
one holds the matrix. Each partition then permutes the block names that it owes over its rows, the rows
are exchanged by block, and each block is permuted again; the place in the block, counted from the
block's first slot, is the row's slot. Given the counts, every permutation is equally likely, and every
shard has exactly its size.

Shards are cut into blocks of at most about ``block_rows`` rows, so no task holds a shard. A task is sent
the number of rows of each partition and works out the blocks itself, so it holds a number for each partition and
for each block. Rows carry what ``digest`` keeps of the text (its size and checksum), never the text. All
draws come from ``seed`` and the number of the partition, and the rows lie in a checkpoint, so a task that
is run again gives the same rows.

Defined cases: a null text has size 1 and the checksum of no bytes; null ids, repeated rows and equal
texts are rows of their own; further columns stay out of the result; with fewer rows than shards some
shards are empty; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import checkpointed

BLOCK_ROWS = 50_000
SEED = 20_011
MOST_AT_ONCE = 1_000_000_000  # the largest population of numpy's draws


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Counts at most one apart."""
    return np.array([rows // shards + (k < rows % shards) for k in range(shards)], np.int64)


def blocks_of(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first slot and size of each block."""
    shard, first, size = [], [], []
    for s, n in enumerate(sizes.tolist()):
        parts = max(1, -(-n // block_rows))
        cuts = [n * k // parts for k in range(parts + 1)]
        for a, b in zip(cuts, cuts[1:]):
            shard.append(s), first.append(a), size.append(b - a)
    return np.array(shard), np.array(first), np.array(size)


def _large_draw(good: int, bad: int, n: int, draw: np.random.Generator) -> int:
    """A hypergeometric number beyond the sizes that numpy takes, by the ratios of its law around the mode."""
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    share = good / (good + bad)
    reach = int(20 * (n * share * (1 - share)) ** 0.5) + 50
    up, down = np.arange(mode, min(high, mode + reach), dtype=float), np.arange(mode, max(low, mode - reach), -1, dtype=float)
    above = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    below = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    weights = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return mode - len(below) + int(np.searchsorted(weights, draw.random() * weights[-1], side="right"))


def split_places(sizes: np.ndarray, n: int, draw: np.random.Generator) -> np.ndarray:
    """How many of ``n`` rows take places in each block, by halving the blocks; all draws of a step are made at once."""
    width = 1 << max(0, (len(sizes) - 1).bit_length())
    sums = [np.concatenate([sizes, np.zeros(width - len(sizes), np.int64)]).astype(np.int64)]
    while len(sums[-1]) > 1:
        sums.append(sums[-1].reshape(-1, 2).sum(1))
    taken = np.array([n], np.int64)
    for level in reversed(sums[:-1]):
        good, bad = level.reshape(-1, 2).T
        small = good + bad < MOST_AT_ONCE
        left = np.zeros(len(good), np.int64)
        left[small] = draw.hypergeometric(good[small], bad[small], taken[small])
        for k in np.flatnonzero(~small).tolist():  # the few ranges at the top
            left[k] = _large_draw(int(good[k]), int(bad[k]), int(taken[k]), draw)
        taken = np.stack([left, taken - left], 1).ravel()
    return taken[: len(sizes)]


def matrix_row(part_rows: np.ndarray, block_sizes: np.ndarray, part: int, seed: int = SEED) -> np.ndarray:
    """How many rows go from one partition to each block, drawn as a uniform shuffle would give them."""
    if part_rows.sum() != block_sizes.sum():
        raise ValueError("rows and places differ in number")
    low, high, places = 0, len(part_rows), block_sizes.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        first = split_places(places, int(part_rows[low:middle].sum()), np.random.default_rng([seed, low, high]))
        low, high, places = (low, middle, first) if part < middle else (middle, high, places - first)
    return places


def communication_matrix(part_rows: np.ndarray, block_sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """All rows of the matrix, to look at; tasks draw their own."""
    return np.array([matrix_row(part_rows, block_sizes, p, seed) for p in range(len(part_rows))]).reshape(len(part_rows), len(block_sizes))


def owed_blocks(part_rows: np.ndarray, block_sizes: np.ndarray, part: int, seed: int = SEED) -> tuple[np.ndarray, np.random.Generator]:
    """The block of each row of a partition, and the generator of their places."""
    draw = np.random.default_rng([seed, part])
    return draw.permutation(np.repeat(np.arange(len(block_sizes)), matrix_row(part_rows, block_sizes, part, seed))), draw


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes of the text and 1) and text_crc32."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with shard (from 0) and slot (gapless from 0 in each shard)."""
    if shards < 1 or block_rows < 1:
        raise ValueError("shards and block_rows must be positive")
    own = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    held = checkpointed(rows.select(*[F.col(f"`{c}`") for c in own]))
    parts = held.rdd.getNumPartitions()
    counts = np.zeros(parts, np.int64)
    for r in held.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect():  # a row for each partition
        counts[r["p"]] = r["n"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        shard, first, size = blocks_of(shard_sizes(int(counts.sum()), shards), block_rows)
        owed, draw = owed_blocks(counts, size, part, seed)
        for batch in batches:
            n = batch.num_rows
            keys = draw.integers(0, 1 << 63, n)
            block = owed[at : at + n]
            made = [block, keys, np.arange(at, at + n), np.full(n, part), shard[block].astype(np.int32), first[block]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], names=[*own, "__block", "__key", "__at", "__part", "shard", "__first"])
            at += n

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema) + ", __block long, __key long, __at long, __part long, shard int, __first long"
    dealt = held.mapInArrow(deal, schema)
    order = Window.partitionBy("__block").orderBy("__key", "__part", "__at")
    placed = dealt.withColumn("__place", F.row_number().over(order) - 1)
    return placed.select(*[F.col(f"`{c}`") for c in own], "shard", (F.col("__first") + F.col("__place")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = shuffle_into_shards(digest(docs), 8)
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
