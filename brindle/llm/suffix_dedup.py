"""Removal of long byte passages that an earlier document holds, by logarithmic families of suffix arrays.

A byte goes if it lies in a string of ``width`` bytes that also starts in a document with a smaller id.
Such a string is the front of a suffix, so it is enough to index suffixes by their first ``width`` bytes.

1. Texts are dealt to buckets by a hash of the row; a bucket is a batch. ``_runs`` cuts it into runs of
   suffixes that share a minimizer (the smallest hash of the ``gram``-byte strings in the front). Equal
   fronts have equal minimizers, so the minimizer deals suffixes to parts.
2. Each bucket sends the list of its minimizers to the parts, which answer with those that another
   document has too. Only runs with such a minimizer travel, each as one short string. Of equal runs
   within a batch only those of the smallest id travel; the others are known to be repeated, so a passage
   that many documents share costs one row for each batch and not for each document.
3. ``SuffixFamily`` holds the suffixes of a part. A new batch gets its suffix array, which is merge-scanned
   against the arrays of all levels; the later holder of a front loses it, whichever side it is on, so each
   front is kept for its smallest id only. Then levels of about equal size are merged, so there are
   logarithmically many and each suffix is merged logarithmically often.
4. Removed ranges return to their buckets, where they are joined and cut.

Suffix arrays are sorted by bytes, and a match is ``width`` equal bytes. A 64-bit hash of the front only saves
work: suffixes that share it are not sorted further but compared. The same holds for runs of a batch that
are taken as equal. Minimizers are compared by 40 bits of a hash, as a chance agreement only sends a run in vain.

Texts cross the network once, and all steps read that exchange again. A bucket and a part hold about ``part_bytes`` of
text or suffixes whatever the input; nothing is collected. There are as many partitions as parts up to
``MOST_PARTITIONS``; beyond that a task works on several buckets or parts, one after the other, so the blocks
of a shuffle stop growing with the square of the input. A list of minimizers that a bucket sends to a part
holds one or more of them, so there are never more lists than minimizers.

Defined cases: a null text is empty; documents with a null id count as one document with the largest id;
rows with the same id never take bytes from each other; repeated rows get equal results; texts shorter
than ``width`` keep all bytes; further columns pass through, and columns named ``kept`` or ``spans`` are
replaced; an empty table gives an empty result. A text of any length is read whole, in windows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from brindle.llm.common import bounded_batches, free_memory, freeing, slices, text_buffers

WIDTH = 50
GRAM = 20
PART_BYTES = 4 << 20
LEAST_PARTS = 48
MOST_PARTITIONS = 20_000
BATCH_BYTES = 16 << 20
STEP = 1 << 18
LEVEL_SUFFIXES = 1 << 20
NO_ID = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    if not _tables or len(_tables[0]) < n:
        _tables.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(max(n, STEP + 4 * WIDTH), b, np.uint64)
            row[0] = 1
            _tables.append(np.cumprod(row, dtype=np.uint64))
    return _tables


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (h ^ (h >> _U(29))) * _U(0x9FB21C651E98DF25)


def _sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of byte times power, from which the hash of any range follows."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * _powers(len(raw))[0][: len(raw)], out=total[1:])
    return total


def _hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((total[end] - total[start]) * _powers(len(total))[1][start])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by running minima within blocks from both sides."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _runs(raw: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first and one past the last suffix, minimizer and hash of each run; suffixes are places in ``raw``."""
    found: list[tuple[np.ndarray, ...]] = []
    last = len(raw) - width + 1
    for a in range(0, max(0, last), STEP):
        b = min(a + STEP, last)
        part = raw[a : b + width - 1]
        total = _sums(part)
        at = np.arange(len(part) - gram + 1)
        least = _sliding_least(_hashes(total, at, at + gram), width - gram + 1)
        spot = np.arange(a, b)
        row = np.searchsorted(offsets, spot, side="right") - 1
        fits = spot + width <= offsets[row + 1]
        opens = fits.copy()
        opens[1:] &= ~fits[:-1] | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        closes = fits.copy()
        closes[:-1] &= ~fits[1:] | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        if len(s):
            found.append((row[s], s + a, e + a, least[s], _hashes(total, s, e + width - 1)))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of ranges, one after the other."""
    ends = np.cumsum(size)
    return raw[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def _equal_ranges(raw: np.ndarray, start: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of eight bytes or more at ``start`` and at ``other`` hold the same bytes."""
    view, equal = np.ndarray((max(0, len(raw) - 7),), "<u8", np.ascontiguousarray(raw), strides=(1,)), np.ones(len(start), bool)
    words = -(-size // 8)
    for i, j in slices(np.concatenate([[0], np.cumsum(words)]), STEP):
        n = words[i:j]
        first = np.cumsum(n) - n
        step = np.minimum(8 * (np.arange(n.sum()) - np.repeat(first, n)), np.repeat(size[i:j] - 8, n))
        differ = view[np.repeat(start[i:j], n) + step] != view[np.repeat(other[i:j], n) + step]
        equal[i:j] = ~np.logical_or.reduceat(differ, first)
    return equal


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([x.nbytes for x in arrays], "<i8")
    return zstandard.ZstdCompressor(level=3).compress(b"".join([sizes.tobytes(), *(np.ascontiguousarray(x).tobytes() for x in arrays)]))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(data, "<i8", len(kinds))
    ends = 8 * len(kinds) + np.cumsum(sizes)
    return [np.frombuffer(data[e - n : e], kind) for e, n, kind in zip(ends, sizes, kinds)]


_SHORT = _U(24)  # minimizers are listed by their upper 40 bits; a chance agreement only sends a run in vain


def _pack_sorted(x: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted 40-bit numbers as differences, with further arrays."""
    step = np.diff(x, prepend=_U(0))
    return _pack(step.astype("<u4"), (step >> _U(32)).astype("u1"), *more)


def _unpack_sorted(blob: bytes, *kinds: str) -> list[np.ndarray]:
    low, high, *more = _unpack(blob, "<u4", "u1", *kinds)
    return [np.cumsum(low.astype(np.uint64) + (high.astype(np.uint64) << _U(32)), dtype=np.uint64), *more]


_RUN_KINDS = ("<i8", "<i8", "<u4", "<u4", "<u4", "u1", "<u4", "<u4", "<u4")


def _minimizer_lists(ids: np.ndarray, raw: np.ndarray, offsets: np.ndarray, parts: int, width: int, gram: int) -> Iterator[tuple[int, bytes]]:
    """(part, packed list) of the minimizers of a batch, each with whether two documents of the batch have it."""
    row, _, _, least, _ = _runs(raw, offsets, width, gram)
    if not len(row):
        return
    part, owner, least = (least % _U(parts)).astype(np.int64), ids[row], least >> _SHORT
    order = np.lexsort((least, part))
    least, part, owner = least[order], part[order], owner[order]
    head = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (part[1:] != part[:-1])))
    several = np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head)
    cuts = np.searchsorted(part[head], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[p], cuts[p + 1]
        yield p, _pack_sorted(least[head[a:b]], several[a:b].astype(np.uint8))


def _shared(lists: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed minimizers that another bucket, or another document of the bucket, has too) from the lists of a part."""
    found = [_unpack_sorted(blob, "u1") for _, blob in lists]
    least, several = (np.concatenate(x) for x in zip(*found))
    bucket = np.repeat(np.array([b for b, _ in lists]), [len(x[0]) for x in found])
    order = np.argsort(least, kind="stable")
    least, several, bucket = least[order], several[order], bucket[order]
    head = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    count = np.diff(np.append(head, len(least)))
    keep = np.repeat((count > 1) | (np.maximum.reduceat(several, head) > 0), count)
    least, bucket = least[keep], bucket[keep]
    order = np.argsort(bucket, kind="stable")
    least, bucket = least[order], bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
        yield int(bucket[a]), _pack_sorted(least[a:b])


def _batch_blobs(ids: np.ndarray, keys: np.ndarray, raw: np.ndarray, offsets: np.ndarray, parts: int, width: int, gram: int, shared: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, packed runs) of a batch with minimizers in ``shared`` (sorted); runs that an earlier row of the batch holds go as ranges only."""
    found = _runs(raw, offsets, width, gram)
    if not len(found[0]) or not len(shared):
        return
    short = found[3] >> _SHORT
    there = shared[np.minimum(np.searchsorted(shared, short), len(shared) - 1)] == short
    row, s, e, least, h = (x[there] for x in found)
    if not len(row):
        return
    size = e - s
    order = np.lexsort((ids[row], size, h))
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (h[a] == h[b]) & (size[a] == size[b])
    near = np.flatnonzero(same)  # equal by hash: compare the bytes
    same[near] = _equal_ranges(raw, s[order[near]], s[order[near - 1]], size[order[near]] + width - 1)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    known = np.zeros(len(order), bool)
    known[order] = ids[row[order]] > ids[row[order[head]]]
    part = (least % _U(parts)).astype(np.int64)
    by = np.lexsort((s, known, part))
    cuts = np.searchsorted(part[by], np.arange(parts + 1))
    for p in range(parts):
        mine = by[cuts[p] : cuts[p + 1]]
        if not len(mine):
            continue
        sent, done = mine[~known[mine]], mine[known[mine]]
        rows, local = np.unique(row[mine], return_inverse=True)
        place = s - offsets[row]
        yield p, _pack(
            ids[rows], keys[rows],
            local[: len(sent)].astype("<u4"), place[sent].astype("<u4"), size[sent].astype("<u4"), _gather(raw, s[sent], size[sent] + width - 1),
            local[len(sent) :].astype("<u4"), place[done].astype("<u4"), (place[done] + size[done] + width - 1).astype("<u4"),
        )


def _words_at(text: np.ndarray, at: np.ndarray, offset: int, width: int) -> np.ndarray:
    """Eight bytes from ``offset`` on of the fronts at ``at`` as numbers in byte order; bytes past ``width`` are cut off.

    ``text`` has eight bytes more than the last front.
    """
    view = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    return view[at + offset].byteswap() >> _U(8 * max(0, offset + 8 - width))


def _by_group(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order by group, then key; two sorts of numbers are much faster than a sort of pairs."""
    order = np.argsort(key)
    rank = np.zeros(len(key), np.int64)
    rank[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
    return np.argsort((group << 32) | rank)


def suffix_order(text: np.ndarray, at: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by their first ``width`` bytes, and where an order's front differs from the one before.

    Suffixes are sorted by eight bytes, and those that agree by the next eight. Suffixes of one hash are
    not sorted further; their bytes are compared at the end, and if some differ, hashes are not used.
    """
    n = len(at)
    first = _words_at(text, at, 0, width)
    order = np.argsort(first, kind="stable")  # linear where two sorted arrays follow each other
    first = first[order]
    fresh = np.ones(n, bool)
    fresh[1:] = first[1:] != first[:-1]
    for offset in range(8, width, 8):
        group = np.cumsum(fresh) - 1
        h = hashes[order]
        mixed = np.zeros(group[-1] + 1 if n else 0, bool)
        mixed[group[h != h[np.flatnonzero(fresh)][group]]] = True
        spot = np.flatnonzero(mixed[group])
        if not len(spot):
            break
        some, inner = order[spot], group[spot]
        key = _words_at(text, at[some], offset, width)
        by = _by_group(inner, key)
        order[spot], key = some[by], key[by]
        fresh[spot[1:]] |= key[1:] != key[:-1]
    same = np.flatnonzero(~fresh)
    here, before = at[order[same]], at[order[same - 1]]
    for offset in range(0, width, 8):
        if (_words_at(text, here, offset, width) != _words_at(text, before, offset, width)).any():
            return suffix_order(text, at, np.arange(n, dtype=np.uint64), width)
    return order, fresh


class SuffixFamily:
    """Suffix arrays in levels of geometrically growing size; see the module's text.

    A suffix is (place in ``text``, hash of its front, row, place in the row); ``ids`` gives the document of a
    row. A level also has whether each front differs from the one before. ``lost`` collects the (row, place)
    whose front a smaller id holds.
    """

    def __init__(self, width: int = WIDTH) -> None:
        self.width = width
        self.text = np.zeros(8, np.uint8)
        self.levels: list[list[np.ndarray]] = []
        self.lost: list[tuple[np.ndarray, np.ndarray]] = []

    def append(self, text: np.ndarray) -> int:
        """Take up text; returns where it begins."""
        begin = len(self.text) - 8
        self.text = np.concatenate([self.text[:begin], text, np.zeros(8, np.uint8)])
        return begin

    def _lose(self, level: list[np.ndarray], gone: np.ndarray) -> list[np.ndarray]:
        """Without the suffixes of the fronts that are ``gone``."""
        gone = gone[np.cumsum(level[4]) - 1]
        if not gone.any():
            return level
        self.lost.append((level[2][gone], level[3][gone]))
        return [x[~gone] for x in level]

    def _array(self, suffixes: list[np.ndarray]) -> list[np.ndarray]:
        order, fresh = suffix_order(self.text, suffixes[0], suffixes[1], self.width)
        return [*(x[order] for x in suffixes[:4]), fresh]

    def _scan(self, level: list[np.ndarray], batch: list[np.ndarray], ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Merge the fronts of two arrays; where both have one, the larger id loses it."""
        heads = [np.flatnonzero(x[4]) for x in (level, batch)]
        n = len(heads[0])
        at, hashes = (np.concatenate([level[k][heads[0]], batch[k][heads[1]]]) for k in (0, 1))
        order, fresh = suffix_order(self.text, at, hashes, self.width)
        twice = np.flatnonzero(~fresh)
        pair = np.sort(np.stack([order[twice - 1], order[twice]]), axis=0)
        old, new = ids[level[2][heads[0][pair[0]]]], ids[batch[2][heads[1][pair[1] - n]]]
        old_gone, new_gone = np.zeros(n, bool), np.zeros(len(heads[1]), bool)
        old_gone[pair[0][new < old]] = True
        new_gone[pair[1][old < new] - n] = True
        return self._lose(level, old_gone), self._lose(batch, new_gone)

    def add(self, suffixes: list[np.ndarray], ids: np.ndarray) -> None:
        if not len(suffixes[0]):
            return
        batch = self._array(suffixes)
        head, owner = np.flatnonzero(batch[4]), ids[batch[2]]
        least = np.minimum.reduceat(owner, head)
        late = owner > least[np.cumsum(batch[4]) - 1]  # a smaller id of the same batch has the front
        self.lost.append((batch[2][late], batch[3][late]))
        group = (np.cumsum(batch[4]) - 1)[~late]
        batch = [*(x[~late] for x in batch[:4]), np.append(True, group[1:] != group[:-1])]
        for k, level in enumerate(self.levels):
            if len(level[0]) and len(batch[0]):
                self.levels[k], batch = self._scan(level, batch, ids)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            above, below = self.levels.pop(), self.levels.pop()
            self.levels.append(self._array([np.concatenate(x) for x in zip(below[:4], above[:4])]))


def _joined(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges joined where they touch or overlap within a row."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    wide = row.astype(np.int64) << 34
    reach = np.maximum.accumulate(wide + end)
    fresh = np.ones(len(row), bool)
    fresh[1:] = wide[1:] + start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return row[at], start[at], (reach - wide)[np.append(at[1:], len(row)) - 1]


def _part_ranges(blobs: Iterator[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row keys, and removed ranges (row, start, end) of a part."""
    family, ids, keys, n = SuffixFamily(width), np.zeros(0, np.int64), [], 0
    ranges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting: list[list[np.ndarray]] = []
    texts: list[np.ndarray] = []
    held = taken = 0

    def flush() -> None:
        nonlocal waiting, texts, held, taken
        if waiting:
            begin = family.append(np.concatenate(texts))
            at, *others = (np.concatenate(x) for x in zip(*waiting))
            family.add([at + begin, *others], ids)
        waiting, texts, held, taken = [], [], 0, 0
        if family.lost:
            row, place = (np.concatenate(x) for x in zip(*family.lost))
            family.lost = []
            place = place.astype(np.int64)
            ranges.append(_joined(row, place, place + width))

    for blob in blobs:
        own, key, row, place, size, data, done, start, end = _unpack(blob, *_RUN_KINDS)
        ids = np.concatenate([ids, own])
        keys.append(key)
        if len(done):
            ranges.append(_joined(done.astype(np.int64) + n, start.astype(np.int64), end.astype(np.int64)))
        size = size.astype(np.int64)
        length = size + width - 1
        begin = np.cumsum(length) - length
        for i, j in slices(np.append(begin, length.sum()), STEP):
            a, b = begin[i], begin[j - 1] + length[j - 1]
            total = _sums(data[a:b])
            within = np.arange(size[i:j].sum()) - np.repeat(np.cumsum(size[i:j]) - size[i:j], size[i:j])
            at = np.repeat(begin[i:j] - a, size[i:j]) + within
            waiting.append([at + a + taken, _hashes(total, at, at + width), np.repeat(row[i:j].astype(np.int32) + np.int32(n), size[i:j]), (np.repeat(place[i:j], size[i:j]) + within).astype(np.uint32)])
            held += len(at)
        texts.append(data)
        taken += len(data)
        n += len(own)
        if held >= LEVEL_SUFFIXES:
            flush()
    flush()
    joined = _joined(*(np.concatenate(x) for x in zip(*ranges))) if ranges else (np.zeros(0, np.int64),) * 3
    return ids, np.concatenate(keys) if keys else np.zeros(0, np.int64), *joined


def _rows(columns: list[tuple[str, pa.DataType]], rows: Iterator[tuple]) -> pa.Table:
    data = list(rows)
    return pa.table({name: pa.array([r[k] for r in data], kind) for k, (name, kind) in enumerate(columns)})


_PART_BLOB = [("part", pa.int32()), ("bucket", pa.int64()), ("blob", pa.binary())]
_BUCKET_BLOB = [("__bucket", pa.int64()), ("blob", pa.binary())]


def _by_part(run):
    """Apply ``run`` to the (bucket, blob) rows of each part of a partition that is sorted by part."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, b, x.as_py()) for batch in found for p, b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)))
        for _, part in itertools.groupby(rows, key=lambda r: r[0]):
            for bucket, blob in run((b, x) for _, b, x in part):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([blob], pa.binary())], names=["__bucket", "blob"])

    return batches


def repeated_ranges(rows: DataFrame, parts: int, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(__bucket, blob of removed ranges) for ``rows`` with __id, __key, __text and __bucket, dealt by __bucket.

    The rows are not projected, so that the caller's plan reads the same exchange.
    """

    def columns(table: pa.Table):
        raw, at = text_buffers(table.column("__text"))
        return table.column("__id").to_numpy(), table.column("__key").to_numpy(), raw, at

    def lists(table: pa.Table) -> pa.Table:
        ids, _, raw, at = columns(table)
        bucket = table.column("__bucket")[0].as_py()
        made = (x for i, j in slices(at, BATCH_BYTES) for x in _minimizer_lists(ids[i:j], raw[at[i] : at[j]], at[i : j + 1] - at[i], parts, width, gram))
        return _rows(_PART_BLOB, ((p, bucket, blob) for p, blob in made))

    def runs(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _rows(_PART_BLOB, iter(()))
        ids, keys, raw, at = columns(table)
        bucket = table.column("__bucket")[0].as_py()
        shared = np.unique(np.concatenate([_unpack_sorted(x)[0] for x in answers.column("blob").to_pylist()]))
        made = (x for i, j in slices(at, BATCH_BYTES) for x in _batch_blobs(ids[i:j], keys[i:j], raw[at[i] : at[j]], at[i : j + 1] - at[i], parts, width, gram, shared))
        return _rows(_PART_BLOB, ((p, bucket, blob) for p, blob in made))

    def scan(found: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        ids, keys, row, start, end = _part_ranges((blob for _, blob in found), width)
        bucket = np.mod(ids[row] ^ keys[row], parts)
        order = np.argsort(bucket, kind="stable")
        row, start, end, bucket = row[order], start[order], end[order], bucket[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
            yield int(bucket[a]), _pack(ids[row[a:b]], keys[row[a:b]], start[a:b].astype("<u4"), end[a:b].astype("<u4"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(min(parts, MOST_PARTITIONS), "part").sortWithinPartitions("part", "bucket")

    to_part, to_bucket = "part int, bucket long, blob binary", "__bucket long, blob binary"
    listed = rows.groupBy("__bucket").applyInArrow(lists, to_part)
    answers = dealt(listed).mapInArrow(freeing(_by_part(lambda found: _shared(list(found)))), to_bucket)
    sent = rows.groupBy("__bucket").cogroup(answers.groupBy("__bucket")).applyInArrow(runs, to_part)
    return dealt(sent).mapInArrow(freeing(_by_part(scan)), to_bucket)


def _spans_of(blobs: list[bytes]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Removed ranges of each (id, key)."""
    if not blobs:
        return {}
    ids, keys, start, end = (np.concatenate(x) for x in zip(*(_unpack(b, "<i8", "<i8", "<u4", "<u4") for b in blobs)))
    pairs, row = np.unique(np.stack([ids, keys], 1), axis=0, return_inverse=True)
    row, start, end = _joined(row.ravel(), start.astype(np.int64), end.astype(np.int64))
    cuts = np.searchsorted(row, np.arange(len(pairs) + 1))
    return {(int(i), int(h)): (start[a:b], end[a:b]) for (i, h), a, b in zip(pairs, cuts, cuts[1:])}


def cut_repeats(docs: DataFrame, width: int = WIDTH, keep: list[str] | None = None, part_bytes: int = PART_BYTES, text: str = "text", as_text: bool = False) -> DataFrame:
    """The columns ``keep`` (all, if not given) with ``kept`` (the bytes that stay) and ``spans`` (removed [start, end)).

    With ``as_text``, ``kept`` is a string without the characters that a span cuts in two.
    """
    bounded_batches(docs.sparkSession)
    own = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("kept", "spans")]
    source = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    carried = [c for c in own if c != text]  # the text itself travels once, as __text
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").isNull().alias("__null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"), source.alias("__text"))
    rows = rows.withColumn("__key", F.xxhash64("__text"))
    total = rows.agg(F.sum(F.octet_length("__text").cast("long"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-total // part_bytes))
    shown = docs.select(*[F.col(f"`{c}`") for c in own]).schema
    # All later steps read this one exchange.
    rows = rows.withColumn("__bucket", F.pmod(F.col("__id").bitwiseXOR(F.col("__key")), F.lit(parts))).repartition(min(parts, MOST_PARTITIONS), "__bucket")
    found = repeated_ranges(rows, parts, width)

    def cut(table: pa.Table, ranges: pa.Table) -> pa.Table:
        spans = _spans_of(ranges.column("blob").to_pylist())
        kept, removed = [], []
        for i, key, given in zip(table.column("__id").to_pylist(), table.column("__key").to_pylist(), table.column("__text")):
            data = given.as_py().encode()
            start, end = spans.get((i, key), ((), ()))
            edges = [0, *(x for pair in zip(start, end) for x in pair), len(data)]
            left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if len(start) else data
            kept.append(left.decode(errors="ignore") if as_text else left)
            removed.append([{"start": int(a), "end": int(b)} for a, b in zip(start, end)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        given = pc.if_else(table.column("__null"), pa.scalar(None, pa.string()), table.column("__text").cast(pa.string()))
        columns = [*(given if c == text else table.column(c) for c in own), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(removed, kind)]
        free_memory()
        return pa.table(columns, names=[*own, "kept", "spans"])

    result = StructType([*shown.fields]).add("kept", StringType() if as_text else BinaryType())
    result = result.add("spans", ArrayType(StructType().add("start", LongType()).add("end", LongType())))
    return rows.groupBy("__bucket").cogroup(found.groupBy("__bucket")).applyInArrow(cut, result)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    cut = cut_repeats(sized, keep=["doc_id", "n_bytes"])
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
