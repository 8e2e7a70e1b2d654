"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the buckets (``2 ** BITS``) of its words, adjacent word pairs and pairs with one
word between them, each counted once. Words are runs of letters, digits and non-ASCII bytes, with A-Z
lower-cased. All hashing is vectorised over windows of about ``CHUNK`` bytes; a longer text is read in
windows that end between words, and a longer word in pieces whose sums add up to its hash.

``train`` reads a bounded sample of labelled rows (``MAX_TRAIN_ROWS``, chosen by a hash of the id) in one
task and returns the weights that L1 left over, at most ``2 ** BITS`` rows, so they are safe to ship to
every task. ``score`` is one narrow pass over whole texts.

Defined cases: a null or empty text has no features and gets the score of the intercept; a null id is
never labelled and never held out; several labels for one id count as their maximum; without labelled
rows of both classes every score is 0; an empty table gives an empty result. Further columns pass through ``score``;
columns named ``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from brindle.llm.common import bounded_batches, freeing, slices, text_buffers

BITS = 18
MAX_TRAIN_ROWS = 20_000
EPOCHS = 5
ALPHA, BETA, L2 = 1.0, 1.0, 0.0
L1_ROOT = 0.15  # L1 is this times the root of the number of examples, as the noise of a sum grows so
FOLDS = 5
CHUNK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _fold_bytes() -> np.ndarray:
    table = np.zeros(256, np.uint64)
    for i in range(256):
        c = chr(i)
        table[i] = ord(c.lower()) if i < 128 and c.isalnum() else i if i >= 128 else 0
    return table


_FOLD = _fold_bytes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse, enough for a window."""
    if not _powers:
        for base in (_BASE, _INVERSE):
            grown = np.full(CHUNK, base, np.uint64)
            grown[0] = 1
            _powers.append(np.cumprod(grown, dtype=np.uint64))
    return _powers


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word of the texts in ``raw``, which holds at most ``CHUNK`` bytes."""
    n, powers = len(raw), _tables()
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    b = _FOLD[raw]
    inside = b != 0
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | opens[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | opens[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(b * powers[0][:n], out=total[1:])
    return np.searchsorted(offsets, s, side="right") - 1, _mix((total[e + 1] - total[s]) * powers[1][s])


def _long_word(raw: np.ndarray) -> np.uint64:
    """The hash of one word of any length."""
    powers, total = _tables(), 0
    for a in range(0, len(raw), CHUNK):
        part = _FOLD[raw[a : a + CHUNK]]
        total += int((part * powers[0][: len(part)]).sum(dtype=np.uint64)) * pow(int(_BASE), a, 1 << 64)
    return _mix(np.array([total & ((1 << 64) - 1)], np.uint64))[0]


def _keys(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each word, pair and skip pair of the words in order."""
    rows, keys = [row], [h]
    for gap, left, right in ((1, 0xA24BAED4963EE407, 0x9FB21C651E98DF25), (2, 0xD6E8FEB86659FD93, 0xCA5A826395121157)):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            rows.append(row[:-gap][same])
            keys.append(_mix(h[:-gap][same] * np.uint64(left) + h[gap:][same] * np.uint64(right)))
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def _windows(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of one text that end between words; a part above ``CHUNK`` bytes is one word."""
    at, n = 0, len(raw)
    while at < n:
        gaps = np.flatnonzero(_FOLD[raw[at : at + CHUNK]] == 0) if n - at > CHUNK else None
        if gaps is None:
            end = n
        elif len(gaps):
            end = at + int(gaps[-1]) + 1
        else:  # a word goes on: find its end
            end = at + CHUNK
            while end < n and not len(more := np.flatnonzero(_FOLD[raw[end : end + CHUNK]] == 0)):
                end += CHUNK
            end = min(n, end + int(more[0])) if end < n else n
        yield at, end
        at = end


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each word, pair and skip pair of the texts in ``raw``; of a long text each bucket once."""
    if len(raw) <= CHUNK:
        return _keys(*_words(raw, offsets))
    rows, keys = [], []
    for k in range(len(offsets) - 1):
        text, last, found = raw[offsets[k] : offsets[k + 1]], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for a, b in _windows(text):
            h = np.array([_long_word(text[a:b])]) if b - a > CHUNK else _words(text[a:b], np.array([0, b - a]))[1]
            h = np.concatenate([last, h])  # the two words before a window make pairs with those in it
            found = np.union1d(found, _keys(np.zeros(len(h), np.int64), h)[1])
            last = h[-2:]
        rows.append(np.full(len(found), k))
        keys.append(found)
    return np.concatenate(rows), np.concatenate(keys)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2; the intercept is not shrunk."""

    def __init__(self, size: int, l1: float) -> None:
        self.l1 = l1
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)
        self.free = np.zeros(size + 1, bool)
        self.free[size] = True

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(self.free[at], 0.0, self.l1)
        w = (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) > l1, w, 0.0)

    def step(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gap = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += gap - (np.sqrt(n + gap * gap) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + gap * gap


def fit(examples: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights that are not zero; the intercept has the bucket ``2 ** BITS``."""
    size = 1 << BITS
    labels = {y for _, y in examples}
    if len(labels) < 2:
        return np.zeros(0, np.int64), np.zeros(0)
    model, order = Ftrl(size, L1_ROOT * len(examples) ** 0.5), np.random.default_rng(7)
    data = [(np.append(x, np.int32(size)).astype(np.int32), y) for x, y in examples]
    examples = []
    for _ in range(EPOCHS):
        for k in order.permutation(len(data)):
            model.step(*data[k])
    w = model.weights(np.arange(size + 1))
    kept = np.flatnonzero(w)
    kept = kept if size in kept else np.append(kept, size)
    return kept, w[kept]


_EXAMPLE = pa.schema([("key", pa.int64()), ("toxic", pa.float64()), ("buckets", pa.binary())])
_WEIGHT = pa.schema([("bucket", pa.int64()), ("weight", pa.float64())])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = text_buffers(batch.column("text"))
        keys, labels = batch.column("key"), batch.column("toxic")
        for i, j in slices(at, CHUNK):
            row, bucket = features(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            packed = np.unique((row << BITS) | bucket)
            cuts = np.searchsorted(packed >> BITS, np.arange(j - i + 1))
            low = (packed & ((1 << BITS) - 1)).astype(np.int32)
            sets = [low[cuts[k] : cuts[k + 1]].tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), labels.slice(i, j - i), pa.array(sets, pa.binary())], schema=_EXAMPLE)


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[int, float, bytes]] = []
    for batch in batches:
        found += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
        if len(found) > 2 * MAX_TRAIN_ROWS:  # only if ids repeat: the same bound holds for rows
            found = sorted(found)[:MAX_TRAIN_ROWS]
    found = sorted(found)[:MAX_TRAIN_ROWS]
    bucket, weight = fit([(np.frombuffer(x, np.int32), y) for _, y, x in found])
    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(weight, pa.float64())], schema=_WEIGHT)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt from at most ``max_rows`` labelled documents outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("double").alias("toxic"))
    sample = known.withColumn("key", F.xxhash64("doc_id")).orderBy("key", "doc_id").limit(max_rows)
    # The sample has at most max_rows rows of three numbers, so it is small enough to broadcast.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("key", "toxic", "text")
    found = rows.mapInArrow(freeing(_examples), "key long, toxic double, buckets binary").repartition(1).mapInArrow(freeing(_fit_batches), "bucket long, weight double").toPandas()
    return found["bucket"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) with ``score`` and ``predicted``."""
    own = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    bounded_batches(docs.sparkSession)
    bucket, weight = model
    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(size)
        dense[bucket[bucket < size]] = weight[bucket < size]
        base = float(weight[bucket == size].sum()) if len(bucket) else None
        for batch in batches:
            raw, at = text_buffers(batch.column("__text"))
            out = np.zeros(batch.num_rows)
            if base is not None:
                for i, j in slices(at, CHUNK):
                    row, key = features(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                    heavy = dense[key] != 0
                    packed = np.unique((row[heavy] << BITS) | key[heavy])
                    out[i:j] = np.bincount(packed >> BITS, weights=dense[packed & (size - 1)], minlength=j - i)
                out = 1 / (1 + np.exp(-np.clip(out + base, -30, 30)))
            columns = [batch.column(k) for k in range(len(own))]
            names = [batch.schema.field(k).name for k in range(len(own))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    fields = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in own]).schema.add("score", DoubleType()).add("predicted", IntegerType())
    return fields.mapInArrow(freeing(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs, labels)
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
