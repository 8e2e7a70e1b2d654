"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding.

``Vocabulary`` maps each byte to the Latin-1 character of its number, so that an Aho-Corasick automaton
over strings finds every token of a byte string. A piece is encoded from left to right: take the longest
token that fits here and is compatible with the token before it; if none fits, drop the last token and
try a shorter one in its place. Two tokens are compatible if BPE keeps the border between them, which is
memoised for each pair. Each position fails once at most, so the time is linear in the piece, and the
result is that of the merges.

``encode`` adds a column of ids, ``decode`` one of bytes; both are narrow. The file of ranks is a
parameter and is read once by each Python worker.

Defined cases: a null or empty text has no ids; null ids decode to no bytes; further columns pass
through and a column named like the result is replaced; repeated rows are encoded alike; an empty table
gives an empty result; an id outside the vocabulary raises an error. A piece of any length is encoded
whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType

from brindle.llm.common import bounded_batches, freeing, kept_between_rows

CACHE_PIECES = 200_000
CACHED_LENGTH = 64


class Vocabulary:
    """Ranks of byte strings; the rank is the id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        for i in sorted(self.tokens):
            self._learn(i)
        self._fits.clear()  # answers given before all merges were known

    def _prefix(self, token: bytes) -> int:
        """The longest token that begins ``token`` and is shorter; -1 if there is none."""
        for k in range(len(token) - 1, 0, -1):
            if (i := self.ranks.get(token[:k])) is not None:
                return i
        return -1

    def _learn(self, i: int) -> None:
        """The two tokens whose merge makes token ``i``."""
        token = self.tokens[i]
        left = self.shorter[i] = self._prefix(token)
        while left >= 0:
            right = self.ranks.get(token[len(self.tokens[left]) :])
            if right is not None and left < i and right < i and self._border_holds(left, right):
                self.parts[i] = (left, right)
                self.merged[left, right] = i
                return
            left = self.shorter[left] if left in self.shorter else self._prefix(self.tokens[left])
        self.parts[i] = (i, i)

    def _border_holds(self, left: int, right: int) -> bool:
        """Undo merges on both sides, the latest first; the border falls if one across it came before."""
        limit = 1 << 62
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left":
                    limit, inner = left, self.parts[left][1]
                    if inner != left:
                        left = inner
                        break
                else:
                    limit, inner = right + 1, self.parts[right][0]
                    if inner != right:
                        right = inner
                        break
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[pair] = self._border_holds(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (i, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = i  # matches come by their ends, so the longest is the last
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token, tokens = 0, longest[0], self.tokens
        while at < n:
            while token >= 0:
                end = at + len(tokens[token])
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("a byte has no token")
                token = out.pop()
                at -= len(tokens[token])
        return out


def _ranks(path: str) -> dict[bytes, int]:
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(_ranks(path))


class Encoder:
    """Splits texts by a pattern and encodes each match separately; frequent pieces are remembered."""

    def __init__(self, path: str, pattern: str) -> None:
        self.vocabulary = vocabulary(path)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        known, out = self.known, []
        for piece in self.split(text):
            got = known.get(piece)
            if got is None:
                got = np.array(self.vocabulary.encode_piece(piece.encode()), "<i4").tobytes()
                if len(piece) <= CACHED_LENGTH:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[piece] = got
            out.append(got)
        return b"".join(out)


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@kept_between_rows
def _forget() -> None:
    """The automaton costs a second to build, so the vocabulary stays and only what grew from texts goes."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
    if vocabulary.cache_info().currsize > 1:
        vocabulary.cache_clear()


def _with_column(df: DataFrame, source: str, name: str, kind: DataType, keep: list[str] | None, run) -> DataFrame:
    own = [c for c in (df.columns if keep is None else keep) if c.lower() != name.lower()]
    bounded_batches(df.sparkSession)
    shown = [F.col(f"`{c}`") for c in own]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            names = [batch.schema.field(k).name for k in range(len(own))]
            for i, made in run(batch.column(len(own))):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, len(made)) for k in range(len(own))), made], names=[*names, name])

    schema = df.select(*shown).schema.add(name, kind)
    return df.select(*shown, F.col(f"`{source}`").alias("__source")).mapInArrow(freeing(batches), schema)


def _chunks(sizes: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for k, s in enumerate(sizes):
        if held and held + s > limit:
            yield start, k
            start, held = k, 0
        held += int(s)
    if start < len(sizes):
        yield start, len(sizes)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) with the ids of ``text`` as array<int>."""

    def run(texts: pa.Array):
        code = encoder(path, pattern)
        sizes = np.array([0 if s is None else s for s in pc.binary_length(texts).to_pylist()], np.int64)
        for i, j in _chunks(sizes):
            parts = [code.ids(t) if t else b"" for t in texts.slice(i, j - i).to_pylist()]
            cuts = np.zeros(j - i + 1, np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=cuts[1:])
            yield i, pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))

    return _with_column(df, text, name, ArrayType(IntegerType()), keep, run)


@lru_cache(maxsize=4)
def _token_table(path: str) -> list[bytes]:
    tokens = {i: t for t, i in _ranks(path).items()}
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)]


def decode(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) with the bytes that ``ids`` stand for."""

    def run(lists: pa.Array):
        token = _token_table(path).__getitem__
        sizes = np.array([0 if s is None else s for s in pc.list_value_length(lists).to_pylist()], np.int64)
        for i, j in _chunks(sizes, 2 << 20):
            part = lists.slice(i, j - i)
            values, cuts = part.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes[i:j])])
            if len(values) and values.min() < 0:
                raise IndexError("negative id")
            yield i, pa.array([b"".join(map(token, values[cuts[k] : cuts[k + 1]].tolist())) for k in range(j - i)], pa.binary())

    return _with_column(df, ids, name, BinaryType(), keep, run)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = decode(encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id"]), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
