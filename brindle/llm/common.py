"""Pieces that several training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WORD_GAP = "[\\x20\\x09-\\x0D]+"


BATCH_ROWS = 1_000
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of texts within a bound of bytes, unless the session has its own settings.

    By default a batch has 10,000 rows or 64 MB, and each task holds several batches outside the heap.
    """
    given = spark.conf.getAll
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        if name not in given:
            spark.conf.set(name, str(value))


_caches: list[Callable[[], None]] = []


def kept_between_rows(clear: Callable[[], None]) -> Callable[[], None]:
    """Name a function that empties what an operator remembers from row to row; tasks call it at their end."""
    _caches.append(clear)
    return clear


def free_memory() -> None:
    """Give back what a task held: Python workers live on for other stages, of this query and of later ones."""
    for clear in _caches:
        clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches for ``mapInArrow`` that frees its memory when the task's input ends."""

    def batches(found: Iterator) -> Iterator:
        try:
            yield from run(found)
        finally:
            free_memory()

    return batches


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once for each row however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words (runs of anything but ASCII white space) of a text that is not null."""
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of an Arrow string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) and len(raw) else np.zeros(0, np.uint8), at - at[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts hold about ``limit`` bytes; a longer text is a run of its own."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


class Numbering(dict):
    """Numbers from 1 in order of first sight."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self) + 1
        return number


TOKEN_WINDOW = 4 << 20


def token_numbers(data: bytes, numbers: Numbering) -> np.ndarray:
    """Numbers of the runs of bytes other than ASCII white space, made in windows of about ``TOKEN_WINDOW`` bytes that end at a blank."""
    parts, start = [], 0
    while start < len(data):
        end = data.rfind(b" ", start, start + TOKEN_WINDOW) if len(data) - start > TOKEN_WINDOW else len(data)
        if end <= start:
            end = data.find(b" ", start + 1)
            end = len(data) if end < 0 else end
        tokens = data[start:end].split()
        parts.append(np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
