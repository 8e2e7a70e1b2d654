"""Ranked lexical search: an inverted index of compressed blocks, searched by Block-Max WAND.

``build`` deals the documents to segments of about ``SEGMENT_BYTES`` of text (each task cuts its own rows, so no posting crosses the network)
and writes one row for each term of a segment: its postings in blocks of ``BLOCK``, each of
fixed-width distances and frequencies, and a head for each block with its last document, its largest impact and its place. One more row has the segment's documents. Counts of the
whole table (N, L) are made first, since impacts need them; df is the sum of the segments' posting counts.

``search`` keeps the rows of the asked terms (the terms of a block of at most about ``ASKED`` query terms are broadcast; more queries
are more blocks) and groups them by segment. Within a segment, an item's pointers move shallowly from block end to block end:
between two ends no pointer leaves its block, so the sum of the blocks' largest impacts bounds every score there. Stretches
whose bound is below the item's 10th best score are skipped, and only the blocks of the others are decoded. The
best of each segment meet in one ranking.

Defined cases: a null text, or one without a term, is no document; rows with a null id are left out on both sides; a repeated document row counts as a
document of its own and is ranked so; a query without terms, or whose terms no document holds, has no rows; repeated
items of one id are one query with the terms of all; equal scores go to the smaller id; a text of any length is one document of a
segment; other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import Numbering, bounded_batches, freeing, token_numbers
from brindle.session import checkpointed

BLOCK = 128
SEGMENT_BYTES = 16 << 20
ASKED = 100_000
FIRST = 10
STRETCHES = 64

# Terms are runs of ASCII letters, digits and anything beyond ASCII; only A-Z change.
_BYTES = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_IN_TERM = np.frombuffer(_BYTES, np.uint8) != 32

HEAD = np.dtype([("last", "<i4"), ("most", "<i4"), ("at", "<i4"), ("gap", "u1"), ("freq", "u1")])
ROWS = "segment long, term string, df long, heads binary, blocks binary"


def _term_starts(raw: np.ndarray) -> np.ndarray:
    inside = _IN_TERM[raw]
    inside[1:] &= ~_IN_TERM[raw[:-1]]
    return np.flatnonzero(inside)


def _sizes(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        per = [len(_term_starts(np.frombuffer(t, np.uint8))) for t in batch.column(0).cast(pa.binary()).to_pylist() if t]
        yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in per)], pa.int64()), pa.array([sum(per)], pa.int64())], names=["docs", "terms"])


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[int, int]:
    """The number of documents with a term, and of all terms."""
    row = _texts(docs, key, text).select("text").mapInArrow(freeing(_sizes), "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def _widths(values: np.ndarray) -> np.ndarray:
    return np.where(values < 1 << 8, 1, np.where(values < 1 << 16, 2, 4)).astype(np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _segment(number: int, ids: list[int], texts: list[bytes], n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    data = b" ".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(ends, _term_starts(np.frombuffer(data, np.uint8)), side="right")
    numbers = Numbering()
    found = token_numbers(data.translate(_BYTES), numbers)
    del data
    lengths = np.bincount(owner, minlength=len(ids))
    real = np.flatnonzero(lengths)
    if not len(real):
        return
    m = np.array([25 + 75 * n * n_docs // n_terms for n in lengths[real].tolist()], np.int64)
    place = np.cumsum(lengths > 0) - 1
    postings, tf = np.unique(found * len(real) + place[owner], return_counts=True)
    del found, owner
    term, doc = postings // len(real), postings % len(real)

    starts = np.flatnonzero(np.diff(term, prepend=-1))  # of the lists
    inlist = np.arange(len(term)) - np.repeat(starts, np.diff(starts, append=len(term)))
    firsts = np.flatnonzero(inlist % BLOCK == 0)  # of the blocks
    size = np.diff(firsts, append=len(term))
    gap = np.where(inlist == 0, doc + 1, np.diff(doc, prepend=0))  # the first one counts from -1
    heads = np.zeros(len(firsts), HEAD)
    heads["last"] = doc[firsts + size - 1]
    heads["most"] = np.maximum.reduceat(impacts(tf, m[doc]), firsts)
    widths = {"gap": _widths(np.maximum.reduceat(gap, firsts)), "freq": _widths(np.maximum.reduceat(tf, firsts))}
    for name, w in widths.items():
        heads[name] = w
    begin = np.cumsum(size * (widths["gap"] + widths["freq"])) - size * (widths["gap"] + widths["freq"])
    total = int(begin[-1] + size[-1] * (widths["gap"][-1] + widths["freq"][-1]))
    out = np.zeros(total, np.uint8)
    block = np.repeat(np.arange(len(firsts)), size)
    within = np.arange(len(term)) - firsts[block]
    for name, values in (("gap", gap), ("freq", tf)):
        w = widths[name][block]
        at = begin[block] + within * w + (0 if name == "gap" else (size * widths["gap"])[block])
        for b in range(4):
            wide = w > b
            out[at[wide] + b] = values[wide] >> (8 * b) & 255
    list_blocks = np.searchsorted(firsts, starts)
    list_at = begin[list_blocks]
    heads["at"] = begin - np.repeat(list_at, np.diff(list_blocks, append=len(firsts)))

    names = pa.array(list(numbers), pa.large_binary()).take(pa.array(term[starts] - 1)).cast(pa.large_string()).cast(pa.string())
    df = np.diff(starts, append=len(term))

    def bytes_of(buffer: bytes, cuts: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(buffer)])

    columns = [pa.array(np.full(len(df), number), pa.int64()), names, pa.array(df, pa.int64()), bytes_of(heads.tobytes(), np.append(list_blocks, len(firsts)) * HEAD.itemsize), bytes_of(out.tobytes(), np.append(list_at, total))]
    whole = pa.RecordBatch.from_arrays(columns, names=["segment", "term", "df", "heads", "blocks"])
    own = [pa.array([number], pa.int64()), pa.array([""]), pa.array([len(real)], pa.int64()), pa.array([m.astype("<i8").tobytes()], pa.binary()), pa.array([np.array(ids, "<i8")[real].tobytes()], pa.binary())]
    yield pa.RecordBatch.from_arrays(own, names=whole.schema.names)
    for i in range(0, len(whole), 50_000):
        yield whole.slice(i, 50_000)


def build(docs: DataFrame, n_docs: int, n_terms: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: segment, term, df (in the segment), heads and blocks; the row of the empty term has the documents."""
    bounded_batches(docs.sparkSession)

    def segments(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, number = [], [], 0, None
        for batch in found:
            for part, i, t in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2).cast(pa.binary()).to_pylist()):
                number = part << 32 if number is None else number
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held >= SEGMENT_BYTES:
                    yield from _segment(number, ids, texts, n_docs, n_terms)
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield from _segment(number, ids, texts, n_docs, n_terms)

    texts = _texts(docs, key, text).select(F.spark_partition_id().cast("long").alias("part"), "id", "text")
    return texts.mapInArrow(freeing(segments), ROWS)


def query_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term and how often the item has it."""
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda t: t != "")
    return _texts(items, key, text).select(F.col("id").alias("item_id"), F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


class _List:
    """A posting list of one segment; blocks are decoded when asked for, once."""

    def __init__(self, df: int, heads: bytes, blocks: bytes, m: np.ndarray) -> None:
        self.heads, self.blocks, self.df, self.m = np.frombuffer(heads, HEAD), blocks, df, m
        self.last, self.most = self.heads["last"].astype(np.int64), self.heads["most"].astype(np.int64)
        self.decoded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if k not in self.decoded:
            h = self.heads[k]
            n = min(BLOCK, self.df - k * BLOCK)
            at, gap, freq = int(h["at"]), int(h["gap"]), int(h["freq"])
            gaps = np.frombuffer(self.blocks, f"<u{gap}", n, at).astype(np.int64)
            tf = np.frombuffer(self.blocks, f"<u{freq}", n, at + n * gap).astype(np.int64)
            docs = np.cumsum(gaps) + (self.last[k - 1] if k else -1)
            self.decoded[k] = docs, impacts(tf, self.m[docs])
        return self.decoded[k]


def best_of_segment(lists: list[tuple[_List, int]], ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``first`` best documents with a score above 0, by Block-Max WAND."""
    ends = np.unique(np.concatenate([x.last for x, _ in lists]))
    begins = np.append(0, ends[:-1] + 1)
    bound, under = np.zeros(len(ends), np.int64), []
    for x, weight in lists:
        at = np.searchsorted(x.last, ends)  # the block that a shallow move to each end finds
        inside = at < len(x.last)
        bound[inside] += weight * x.most[at[inside]]
        under.append(np.where(inside, at, -1))
    best_docs, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = 1
    ahead = np.flatnonzero(bound >= least)
    score = np.zeros(len(ids), np.int64)
    while len(ahead):
        now, ahead = ahead[:STRETCHES], ahead[STRETCHES:]
        wanted = np.concatenate([np.arange(b, e + 1) for b, e in zip(begins[now], ends[now])])
        score[:] = 0
        for (x, weight), at in zip(lists, under):
            for k in set(at[now].tolist()) - {-1}:
                docs, impact = x.block(k)
                score[docs] += weight * impact
        got = score[wanted]
        better = got >= least
        best_docs, best = np.append(best_docs, wanted[better]), np.append(best, got[better])
        if len(best) > first:
            order = np.lexsort((ids[best_docs], -best))[:first]
            best_docs, best = best_docs[order], best[order]
        if len(best) == first:
            least = max(1, int(best.min()))
            ahead = ahead[bound[ahead] >= least]
    return ids[best_docs], best


def _search(first: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["asked"] is None)
        ids, m = np.frombuffer(own["blocks"], "<i8"), np.frombuffer(own["heads"], "<i8")
        items: dict[int, list] = {}
        for r in rows:
            if r["asked"] is not None:
                x = _List(r["df"], r["heads"], r["blocks"], m)
                for a in r["asked"]:
                    if a["weight"]:
                        items.setdefault(a["item_id"], []).append((x, a["weight"]))
        out = ([], [], [])
        for item, lists in items.items():
            docs, scores = best_of_segment(lists, ids, first)
            for column, values in zip(out, ([item] * len(docs), docs.tolist(), scores.tolist())):
                column.extend(values)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("item_id", "doc_id", "score"), out)})

    return run


def search(index: DataFrame, wanted: DataFrame, n_docs: int, first: int = FIRST) -> DataFrame:
    """item_id, rank, doc_id, score: the ``first`` best documents of each item of ``wanted`` (from ``query_terms``)."""
    terms = wanted.select("term").distinct()
    df = index.join(F.broadcast(terms) if terms.count() <= ASKED else terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    asked = checkpointed(wanted.join(df, "term").select("term", "item_id", (weight * F.col("times")).cast("long").alias("weight")))
    blocks = max(1, -(-asked.count() // ASKED))
    found = None
    for k in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).groupBy("term").agg(F.collect_list(F.struct("item_id", "weight")).alias("asked"))
        rows = index.join(F.broadcast(block), "term", "left").filter((F.col("term") == "") | F.col("asked").isNotNull())
        best = rows.groupBy("segment").applyInArrow(_search(first), "item_id long, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return ranked.select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_docs, n_terms = sizes(docs)
    index = checkpointed(build(docs, n_docs, n_terms))
    return search(index, query_terms(spark.read.parquet(f"{sf_dir}/benchmark.parquet")), n_docs)


_TERMS = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, {_TERMS} AS ws FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, len(ws)::BIGINT AS n FROM t WHERE len(ws) > 0),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM t) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS w FROM f, s),
m AS (SELECT doc_id, 25 + (75 * n * nn) // ll AS m FROM d, s),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= {FIRST}
"""
