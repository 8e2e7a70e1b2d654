"""Best-fit packing of token pieces into sequences under several capacities at once.

A sequence has capacities for tokens, for pieces and for attention cost (the sum of squared lengths). Which pieces
fit together depends only on how many pieces there are of each length, so the plan is made from that
histogram, whose size is the token capacity and not the number of documents. ``plan`` fills one kind of
sequence at a time: of the lengths that still fit under every capacity it takes the one whose demand has
the largest weighted dot product with the residual capacities, or the one that leaves the smallest weighted
residual norm. The filled kind is then used as often as the counts allow, so the plan has a few thousand
kinds for any input.

``pieces`` tokenises whole texts and cuts only documents above the capacity. ``pack`` numbers the pieces
of each length without bringing them together: they are dealt to ``GROUPS`` groups by a hash, and the
counts by length and group give each group its first number. Each number is looked up in the plan. The
result does not depend on how the input is partitioned.

Defined cases: a null or empty text is one piece that holds the separator alone; further columns stay out
of the result; repeated rows and equal ids are packed as rows of their own; ties between lengths go to the
longer one; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import bounded_batches, freeing, kept_between_rows
from brindle.session import checkpointed

CAPACITY = 4096
SEPARATOR = 1
GROUPS = 1024
CACHE_CHUNKS = 500_000  # about 100 MB, freed when a task ends
CACHED_LENGTH = 48


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and the weights with which the three count in the choice."""

    tokens: int = CAPACITY
    pieces: int = CAPACITY
    attention: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    rule: str = "dot"  # or "norm"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it is printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Tokens:
    """Ids of texts for a tokenizer that lower-cases, drops white space and has no token across it.

    Texts are lower-cased (A-Z) and cut at ASCII white space; the ids of the chunks are remembered, so the
    tokenizer sees each chunk once. A full stop or comma after a last ASCII letter is a token of its own. A word of
    lower-case Latin letters in composed form is what the tokenizer's normalizer and pre-tokenizer would make
    of it, so it goes to the model at once; all other chunks go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merge = self.model.model.tokenize
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}

    def _word(self, chunk: bytes) -> bytes:
        if chunk[-1] in b".," and chunk[-2:-1].isalpha():
            stem, mark = chunk[:-1], chunk[-1:]
            return (self.known.get(stem) or self._remember(stem)) + (self.known.get(mark) or self._remember(mark))
        word = chunk.decode()
        if word.isalpha() and max(word) < "\u0250" and word == word.lower() and unicodedata.is_normalized("NFC", word):
            shown = word if word.isascii() else "".join([self.letters[b] for b in chunk])
            return array("I", [t.id for t in self.merge(shown)]).tobytes()
        return array("I", self.model.encode(word, add_special_tokens=False).ids).tobytes()

    def _remember(self, chunk: bytes) -> bytes:
        made = self._word(chunk)
        if len(chunk) <= CACHED_LENGTH:
            self.known[chunk] = made
        return made

    def ids(self, text: str) -> bytes:
        known = self.known
        chunks = text.encode().lower().split()
        missing = set(chunks).difference(known)
        if missing:
            if len(known) + 2 * len(missing) > CACHE_CHUNKS:
                known.clear()
                missing = set(chunks)
            made = {c: self._remember(c) for c in missing}
            long = {c: x for c, x in made.items() if len(c) > CACHED_LENGTH}
            if long:
                return b"".join([long[c] if c in long else known[c] for c in chunks])
        return b"".join(map(known.__getitem__, chunks))


@lru_cache(maxsize=1)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


kept_between_rows(_tokens.cache_clear)


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = _tokens(path), np.array([separator], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids = memoryview((code.ids(text) if text else b"") + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PIECE)], schema=_PIECE)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(freeing(run), kind)


@dataclass
class Plan:
    """Runs of equal placements: the numbers ``first`` and on of the pieces of ``length`` go to sequences
    ``base`` and on, ``each`` pieces to a sequence, from ``offset`` on."""

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(counts: dict[int, int], limits: Limits = Limits()) -> Plan:
    """The placements for so many pieces of each length."""
    top = limits.tokens
    if counts and (max(counts) > top or max(counts) ** 2 > limits.attention or limits.pieces < 1):
        raise ValueError("a piece exceeds a capacity by itself")
    left = np.zeros(top + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    used = np.zeros(top + 1, np.int64)
    capacity = np.array([limits.tokens, limits.pieces, limits.attention], float)
    weights = np.array(limits.weights)
    every = np.arange(top + 1)
    demand = np.stack([every, np.ones(top + 1), every.astype(float) ** 2], 1) / capacity
    rows, base = [], 0
    while left.any():
        room, taken, offset = np.array([limits.tokens, limits.pieces, limits.attention], np.int64), [], 0
        merged: dict[int, int] = {}
        while True:
            reach = min(int(room[0]), int(np.sqrt(float(room[2])) + 1e-9))
            open_ = np.flatnonzero(left[: reach + 1]) if room[1] > 0 else every[:0]
            whole = [length for length, n in merged.items() if left[length] <= n]  # this sequence has taken them all
            open_ = open_[~np.isin(open_, whole)] if whole else open_
            if not len(open_):
                break
            share, items = room / capacity, demand[open_]
            if limits.rule == "dot":
                value = items @ (weights * share)
            else:
                value = -(((share - items) ** 2) @ weights)
            length = int(open_[len(value) - 1 - np.argmax(value[::-1])])
            fits = min(int(room[0]) // length, int(room[1]), int(room[2]) // (length * length), int(left[length]) - merged.get(length, 0))
            # A dot product keeps its order while only the residual shrinks, so a run of one length is taken at once.
            n = fits if limits.rule == "dot" else 1
            taken.append((length, n, offset))
            merged[length] = merged.get(length, 0) + n
            offset += n * length
            room -= np.array([n * length, n, n * length * length])
        times = min(int(left[length]) // n for length, n in merged.items())
        for length, n, at in taken:
            rows.append((length, int(used[length]), base, n, at))
            used[length] += n * times
            left[length] -= n * times
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T.copy(), sequences=base)


def place(length: np.ndarray, number: np.ndarray, made: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces, given their numbers among those of their length."""
    wide = np.int64(1) << np.int64(48)
    k = np.searchsorted(made.length * wide + made.first, length * wide + number, side="right") - 1
    past = number - made.first[k]
    return made.base[k] + past // made.each[k], made.offset[k] + past % made.each[k] * length


def pack(found: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``found`` (the result of ``pieces``) with sequence_id and offset."""
    found = checkpointed(found.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(GROUPS))))
    sizes = found.groupBy("length", "__part").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("__first", F.sum("n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    # At most as many rows as there are token lengths.
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(counts, limits)
    order = Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = found.withColumn("__at", F.row_number().over(order) - 1).join(sizes.drop("n"), ["length", "__part"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.coalesce("__first", F.lit(0)) + F.col("__at")).alias("__number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = place(batch.column(3).to_numpy(), batch.column(5).to_numpy(), made)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*_PIECE.names, "sequence_id", "offset"])

    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs, str(public_tokenizers.path("word_bpe_49k.json"))))
