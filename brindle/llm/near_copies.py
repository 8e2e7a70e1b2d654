"""Near copies by shingle sets: texts whose sets of five words in a row have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash, and from MinHash keys what SimHash cannot reach; every link is checked exactly:

* The set of a text holds 64-bit hashes of its shingles (A-Z lower-cased, cut at ASCII white space; a
  text of fewer words is one shingle). Equal sets are one node from here on.
* The SimHash of a set has the bits that more than half of its hashes have. Nodes of one SimHash meet the smallest
  of them, and SimHashes within ``simhash.RADIUS`` bits meet by the covering masks of ``simhash.near_links``.
* At a similarity of 0.8 about 10 of 64 bits differ, and covering tables double with every bit of radius, so
  SimHash alone would lose most links near the threshold. The others are found by
  ``BANDS`` keys of ``ROWS`` MinHash values each: a pair at 0.8 shares no key with probability 7e-5, one
  at 0.9 with 3e-10. Every node of a key is joined to its smallest, which is linear in the size of the key.
* Each key's smallest node, its hub, is compared exactly with the others: hub and members meet in parts dealt
  by a hash, where the members stream past one set. Groups of near copies are linked here, in linear work.
* What is left are pairs of one key in different components of these links, the hub left aside. The nodes of
  the hub's component need not meet each other, only the rest; both are dealt to blocks of about ``BLOCK``
  sets and a cell of two blocks is compared in one group, so no task holds a whole key. Work grows with the square only
  among texts that share keys and stay below the threshold.
* What two texts share is never taken from the fingerprints, and links are transitive: the smallest id of each
  component of true links stays, as in ``simhash.dedup``.

Defined cases: texts that are null, empty or without words are equal; repeated rows, null ids and further
columns are treated as ``simhash.dedup`` treats them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, freeing
from brindle.llm.simhash import _LOWER, _signed, components, leading_rows, majority, near_links, rank_of
from brindle.session import checkpointed

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
COMPARED = 1 << 20
DEALS = 256  # parts of the nodes around one hub
BLOCK = 256  # sets of a block
LARGE = 8_192  # so many shingles count as one set more

_EMPTY = np.zeros(0, np.uint64)


def _constants(name: str, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{name}{k}") | 1 for k in range(n)], np.uint64)


_PLACE, _ROW, _BAND = _constants("place", SHINGLE), _constants("row", ROWS), _constants("band", BANDS)
_TIMES, _PLUS = (_constants(name, BANDS * ROWS).astype(np.uint32)[:, None] for name in ("times", "plus"))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return _EMPTY
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n, total = max(1, len(words) - SHINGLE + 1), np.uint64(0)
    for k in range(min(SHINGLE, len(words))):
        total = total + hashes[k : k + n] * _PLACE[k]
    return np.unique(_mixed(total))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band of the set, none for the empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    short, low = (found >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), 1024):
        np.minimum(low, (short[start : start + 1024] * _TIMES + _PLUS).min(1), out=low)
    return _mixed((low.reshape(BANDS, ROWS) * _ROW).sum(1, dtype=np.uint64) + _BAND).view(np.int64)


def set_fingerprint(found: np.ndarray) -> int:
    """SimHash of the set as a signed long; that of the empty set is 0."""
    return _signed(majority(found[k : k + (1 << 14)] for k in range(0, len(found), 1 << 14)))


def marks(docs: DataFrame) -> DataFrame:
    """doc_id and __tie with node, the hash of the set, keys, its bands, n, its size, and fp, its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(2)]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            prints = pa.array([set_fingerprint(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), keys, sizes, prints], names=["doc_id", "__tie", "node", "keys", "n", "fp"])

    bounded_batches(docs.sparkSession)
    shown = docs.select("doc_id", F.xxhash64("text").alias("__tie"), F.col("text").cast("string").alias("__text"))
    return shown.mapInArrow(freeing(run), f"doc_id {shown.schema['doc_id'].dataType.simpleString()}, __tie long, node long, keys array<long>, n long, fp long")


def linked_parts(sets: list[np.ndarray], similarity: float = SIMILARITY, parts: np.ndarray | None = None, sides: np.ndarray | None = None) -> np.ndarray:
    """For each of the sets (none is empty) the first set of its component of links.

    ``parts`` names components that are known; with ``sides``, only sets of different sides are compared.
    """
    size = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, root = np.zeros(len(ids), bool), first_of(np.arange(len(sets)) if parts is None else parts)
    for i in range(1, len(sets)):
        mine = ids[at[i] : at[i + 1]]
        mark[mine] = True
        open_ = (root[:i] != root[i]) & (size[:i] >= similarity * size[i] - 1e-9) & (size[i] >= similarity * size[:i] - 1e-9)
        near = np.flatnonzero(open_ if sides is None else open_ & (sides[:i] != sides[i]))
        first = root[near] == near
        for some in (near[first], near[~first]):
            some = some[root[some] != root[i]]
            block = np.cumsum(size[some]) // COMPARED
            for b in np.unique(block):
                part = some[block == b]
                part = part[root[part] != root[i]]
                if not len(part):
                    continue
                both = np.add.reduceat(mark[np.concatenate([ids[at[j] : at[j + 1]] for j in part])], np.cumsum(size[part]) - size[part], dtype=np.int64)
                hits = part[both >= similarity * (size[part] + size[i] - both) - 1e-9]
                for r in np.unique(root[hits]).tolist():
                    low, high = min(r, root[i]), max(r, root[i])
                    root[root == high] = low
        mark[mine] = False
    return root


def first_of(values: np.ndarray) -> np.ndarray:
    """For each value the first place where it stands."""
    _, first, group = np.unique(values, return_index=True, return_inverse=True)
    return first[group]


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    least, most = sorted((len(a), len(b)))
    if least < similarity * most - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def shared_keys(nodes: DataFrame) -> DataFrame:
    """key, node, n and hub (the smallest node of the key) for the keys that several nodes have."""
    rows = nodes.select(F.explode("keys").alias("key"), "node", "n").repartition("key")
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub")
    return rows.join(hubs, "key")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (hub, node): nodes of one SimHash with the smallest of them, and such smallest nodes whose SimHashes link within the radius."""
    homes = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("hub"), F.max("node").alias("last")))
    same = nodes.select("fp", "node").join(homes.filter("hub < last").select("fp", "hub"), "fp").filter("node <> hub").select("hub", "node")
    near = near_links(homes.select("fp")).join(homes.select(F.col("fp").alias("a"), "hub"), "a").join(homes.select(F.col("fp").alias("b"), F.col("hub").alias("node")), "b")
    return same.union(near.select("hub", "node"))


def star_links(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """True links (a, b) of hubs and the nodes that they may be near; a task holds one hub's set at a time."""
    members = shared.filter("node <> hub").select("hub", "node").distinct().withColumn("deal", F.pmod(F.xxhash64("node"), F.lit(DEALS)))
    hubs = members.select("hub", F.col("hub").alias("node"), "deal").distinct()
    dealt = members.union(hubs.select(*members.columns)).join(texts, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, _EMPTY
        for batch in batches:
            links = []
            for hub, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if node == hub:
                    if now != hub:
                        now, found = hub, shingle_set(text.as_py())
                elif similar(found, shingle_set(text.as_py())):
                    links.append((hub, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    order = ["hub", "deal", F.col("node") != F.col("hub")]
    return dealt.repartition("hub", "deal").sortWithinPartitions(*order).select("hub", "node", "text").mapInArrow(freeing(run), "a long, b long")


def _count_to(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))


def cells(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """key, x, y, side, node and part: cells of two blocks in which the pairs left by the stars meet.

    ``parts`` has node and root of the links found. Blocks 0 to b - 1 of a key hold nodes outside the hub's
    component, later ones nodes inside it; the latter meet only the former.
    """
    full = shared.join(parts, "node", "left").select("key", "node", "hub", "n", F.coalesce("root", "node").alias("part"))
    homes = full.filter("node = hub").select("key", F.col("part").alias("home"))
    rest = full.filter("node <> hub").join(homes, "key").withColumn("inside", F.col("part") == F.col("home"))
    load = 1 + F.col("n") / LARGE
    blocks = lambda inside: F.ceil(F.coalesce(F.sum(F.when(F.col("inside") == inside, load)), F.lit(0)) / BLOCK).cast("long")
    sizes = rest.groupBy("key").agg(blocks(False).alias("out"), blocks(True).alias("ins"), F.count("*").alias("nodes")).filter("out > 0 and nodes > 1")
    rest = rest.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("ins")).otherwise(F.col("out"))))
    cell = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), side.cast("int").alias("side"))
    own, out = F.col("own"), F.col("out")
    outer = F.transform(_count_to(out), lambda k: cell(F.least(own, k), F.greatest(own, k), own > k))
    inner = F.transform(_count_to(F.col("ins")), lambda k: cell(own, out + k, F.lit(0)))
    home = F.transform(_count_to(out), lambda k: cell(k, out + own, F.lit(1)))
    made = rest.select("key", "node", "part", F.explode(F.when(F.col("inside"), home).otherwise(F.concat(outer, inner))).alias("c"))
    return made.select("key", "c.x", "c.y", "c.side", "node", "part")


def cell_links(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """True links (a, b) of known components, found within cells."""

    def result(rows: list[tuple]) -> list[tuple[int, int]]:
        parts, sides = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
        if len(set(parts.tolist())) < 2:
            return []
        root = linked_parts([r[0] for r in rows], parts=parts, sides=sides if rows[0][3] else None)
        return list({(int(parts[r]), int(p)) for r, p in zip(root, parts) if parts[r] != p})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        shown = lambda links: pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
        for batch in batches:
            for key, x, y, side, part, text in zip(*[batch.column(k).to_pylist() for k in range(5)], batch.column(5)):
                if (key, x, y) != now:
                    if rows:
                        yield shown(result(rows))
                    now, rows = (key, x, y), []
                rows.append((shingle_set(text.as_py()), part, side, x != y))
        if rows:
            yield shown(result(rows))

    spread = dealt.join(texts, "node").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "node")
    return spread.select("key", "x", "y", "side", "part", "text").mapInArrow(freeing(run), "a long, b long")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each component: the smallest doc_id, then the smallest text hash."""
    marked = marks(docs).groupBy("node").agg(F.min(rank_of(F.col("doc_id"), F.col("__tie"))).alias("low"), F.first("keys").alias("keys"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    marked = checkpointed(marked)
    shared = checkpointed(shared_keys(marked))
    pairs = checkpointed(fingerprint_pairs(marked))
    asked = shared.select("node").union(pairs.select("node")).union(pairs.select("hub")).distinct()
    picked = marked.join(asked, "node", "left_semi")
    picked = picked.select("node", F.col("low.none").alias("__none"), F.coalesce("low.doc_id", F.lit(0)).alias("__id"), F.col("low.tie").alias("__tie"))
    slim = docs.select(F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("__id"), F.xxhash64("text").alias("__tie"), F.col("text").cast("string").alias("text"))
    texts = checkpointed(slim.join(picked, ["__none", "__id", "__tie"]).select("node", "text").dropDuplicates(["node"]))
    candidates = shared.select("hub", "node").union(pairs)
    parts = checkpointed(components(star_links(candidates, texts)))
    more = components(cell_links(cells(shared, parts), texts)).select(F.col("node").alias("root"), F.col("root").alias("last"))
    full = marked.select("node", "low").join(parts, "node", "left").select("low", F.coalesce("root", "node").alias("root"))
    full = full.join(more, "root", "left").select("low", F.coalesce("last", "root").alias("root"))
    return leading_rows(docs, full.groupBy("root").agg(F.min("low").alias("leader")))
