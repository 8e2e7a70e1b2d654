"""SimHash near-duplicates by covering locality-sensitive hashing.

``fingerprints`` makes a 64-bit SimHash of the word shingles of whole texts. ``link`` finds the connected
components of fingerprints that differ in at most ``radius`` bits:

* Covering masks: bit i gets a vector m(i) that is not zero of radius + 1 bits, and each such vector v
  names a table whose mask holds the bits with an odd <m(i), v>. Fewer than radius + 2 differing bits
  leave some v orthogonal to all their vectors, so every pair within the radius agrees under some mask.
* Equal fingerprints are one row from here on, so groups of copies cost nothing more.
* A bucket of a table with up to ``bucket_limit`` fingerprints is compared by one vectorised function,
  which returns the links that keep its parts connected (fewer than it has members), not its pairs.
* A larger bucket is opened by the neighbours of its members: two fingerprints x, y are within 3 bits
  exactly if some key is within 1 bit of x and 2 of y, and all members of that kind at a key are linked
  to one of them. So the work is linear in the bucket, is spread over the keys, and loses no link.
* Components: alternating large-star and small-star steps on the links, each written to a checkpoint.

Defined cases: a null text, an empty one or one without words has the fingerprint zero, which is linked
like any other; repeated rows share a component; a null id never names a component unless it has no other
id; further columns stay out of the result (``dedup`` keeps those of its input); an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, freeing
from brindle.session import checkpointed

BITS = 64
RADIUS = 3
SHINGLE = 3
BUCKET_LIMIT = 2048
HOT_ROWS = 100_000

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """SimHash: bit k is 1 if more than half of the shingle hashes have it."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    some = (range(start, min(n, start + (1 << 14))) for start in range(0, n, 1 << 14))
    return majority(np.array([digest(b" ".join(words[i : i + shingle]), seed) for i in block], "<u8") for block in some)


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits that more than half of all hashes of the blocks have."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in blocks:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones, n = ones + bits.sum(0, dtype=np.int64), n + len(hashes)
    return int(sum(1 << k for k in range(BITS) if 2 * ones[k] > n))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (all, if not given) with ``fp``, the fingerprint as a signed long."""
    own = [c for c in (docs.columns if keep is None else keep) if c.lower() != "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(len(own))], np.uint64)
            names = [batch.schema.field(k).name for k in range(len(own))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(made.view(np.int64))], names=[*names, "fp"])

    bounded_batches(docs.sparkSession)
    shown = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`").cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema.fields[:-1])
    return shown.mapInArrow(freeing(run), f"{kinds}{', ' if kinds else ''}fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask for each vector v that is not zero of radius + 1 bits."""
    top = 1 << (radius + 1)
    vector = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def spanning_links(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what links within the radius connect among ``members`` (distinct int64)."""
    x = members.view(np.uint64)
    root = np.arange(len(x))
    links = []
    for i in range(len(x) - 1):
        for j in (np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= radius) + i + 1).tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                links.append((int(members[i]), int(members[j])))
    return links


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values, cuts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            pairs = [x for k in range(len(lists)) for x in spanning_links(values[cuts[k] : cuts[k + 1]], radius)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    return buckets.select("members").mapInArrow(freeing(run), "a long, b long")


def _neighbour_links(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links in large buckets. Differing bits lie outside the mask, so only those are flipped."""
    near, far = radius // 2, radius - radius // 2
    full = (1 << BITS) - 1
    free = [[_signed(1 << i) for i in range(BITS) if (m ^ full) >> i & 1] for m in masks]
    flips = F.element_at(F.array(*[F.array(*[F.lit(b) for b in bits]) for bits in free]), F.col("table") + 1)
    singles = F.transform(F.col("flips"), lambda b: F.struct(b.alias("bits"), F.lit(1).alias("steps")))
    pairs = F.flatten(
        F.transform(F.col("flips"), lambda b, i: F.transform(F.slice(F.col("flips"), i + 2, F.size("flips")), lambda c: F.struct(b.bitwiseOR(c).alias("bits"), F.lit(2).alias("steps"))))
    )
    if far > 2:
        raise ValueError("radii above 4 need more flips")
    zero = F.array(F.struct(F.lit(0).cast("long").alias("bits"), F.lit(0).alias("steps")))
    steps = F.concat(zero, singles, pairs) if far == 2 else F.concat(zero, singles) if far == 1 else zero
    keyed = rows.withColumn("flips", flips).select("table", "fp", F.explode(steps).alias("s"))
    keyed = keyed.select("table", F.col("fp").bitwiseXOR(F.col("s.bits")).alias("near"), "fp", F.col("s.steps").alias("steps"))
    hub = keyed.filter(F.col("steps") <= near).groupBy("table", "near").agg(F.min("fp").alias("a"))
    return keyed.join(hub, ["table", "near"]).filter(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b")).distinct()


def near_links(distinct: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` (distinct rows) within the radius."""
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(k).alias("table"), F.lit(_signed(m)).alias("mask")) for k, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(tables).alias("t")).select(F.col("t.table").alias("table"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"), "fp")
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = rows.join(sizes, ["table", "key"])
    small = shared.filter(F.col("n") <= bucket_limit).groupBy("table", "key").agg(F.collect_list("fp").alias("members"))
    return _bucket_links(small, radius).union(_neighbour_links(shared.filter(F.col("n") > bucket_limit), masks, radius)).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links; the root is the smallest node of the component.

    Large-star links every larger neighbour of a node, small-star every smaller one, to the smallest of
    its neighbourhood; nothing is collected. It ends when a round leaves the links as they were.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = checkpointed(edges)
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def groups(marked: DataFrame, order: Column, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(fp, leader): for each fingerprint the smallest ``order`` over all rows of its component."""
    mine = marked.groupBy("fp").agg(F.min(order).alias("low"))
    mine = checkpointed(mine)
    roots = components(near_links(mine.select("fp"), radius, bucket_limit))
    full = mine.join(roots, mine["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = full.groupBy("root").agg(F.min("low").alias("leader"))
    return full.join(least, "root").select("fp", "leader")


def components_of(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach)."""
    marked = checkpointed(fingerprints(docs, shingle, keep=["doc_id"]))
    found = groups(marked, F.col("doc_id"), radius)
    return _spread_join(marked, found).select("doc_id", "fp", F.col("leader").alias("component_id"))


def _spread_join(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` joined with the one row of their ``fp``; a fingerprint that very many rows share is dealt to several keys.

    There are at most rows / HOT_ROWS such fingerprints, so they are broadcast.
    """
    hot = rows.groupBy("fp").agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("__keys")).filter("__keys > 1")
    dealt = rows.join(F.broadcast(hot), "fp", "left").withColumn("__key", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("__keys")).cast("int"), F.lit(0))).drop("__keys")
    copied = found.join(F.broadcast(hot), "fp", "left").withColumn("__key", F.explode(F.sequence(F.lit(0), F.coalesce("__keys", F.lit(1)) - 1))).drop("__keys")
    return dealt.join(copied, ["fp", "__key"]).drop("__key")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def rank_of(doc_id: Column, tie: Column) -> Column:
    """Order of rows: the smallest id, nulls last, then the smallest text hash."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), tie.alias("tie"))


def leading_rows(docs: DataFrame, leaders: DataFrame) -> DataFrame:
    """One row of ``docs`` for each distinct ``leader`` (a ``rank_of`` doc_id and the hash of text)."""
    own = docs.columns
    leaders = leaders.select(F.col("leader.none").alias("__none"), F.coalesce("leader.doc_id", F.lit(0)).alias("__id"), F.col("leader.tie").alias("__tie")).distinct()
    keys = ["__none", "__id", "__tie"]
    keyed = docs.withColumns({"__none": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0).cast("long")), "__tie": F.xxhash64("text")})
    one = Window.partitionBy(*keys).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in own]))
    kept = keyed.join(leaders, keys, "left_semi").withColumn("__n", F.row_number().over(one))
    return kept.filter("__n = 1").select(*[F.col(f"`{c}`") for c in own])


def dedup(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without all but one row of each component: the smallest doc_id, then the smallest text hash."""
    slim = docs.select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("__tie"))
    marked = checkpointed(fingerprints(slim, shingle, keep=["doc_id", "__tie"]))
    return leading_rows(docs, groups(marked, rank_of(F.col("doc_id"), F.col("__tie")), radius))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return components_of(docs).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
