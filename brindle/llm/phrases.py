"""Phrase collocations: suffix automata of bounded depth for each shard, counts summed over all shards.

A task reads its texts in shards of about ``SHARD_BYTES`` and builds, for each language of a shard, the suffix
automaton of its pieces down to a depth. It is built level by level and not word by word: the suffix
links of an automaton form the tree of the reversed contexts, so the states of depth d are the distinct pairs of
a state of depth d - 1 (the suffix link) and the word before it, and the size of its endpos set is the number of places with that
pair. One sort of whole numbers for each level finds them all. The states of the deepest level are written as phrases with their counts,
which are summed by phrase over the shards; only those of ``least`` or more go on.

There is one pass for each length, since most phrases of any corpus are rare and a phrase is no more frequent than its suffix link and its prefix: the
frequent phrases of a level are marked in a bit table of fixed size (``MARKS`` bits), by which the next pass leaves out states under rare
ones. A mark set by chance lets a rare phrase through to the sums and changes no result; in a corpus with far more frequent phrases than marks the passes
just save less.

Of the table of counts, a candidate takes the counts of its parts by a join. The parts that are frequent enough
to make a hot key (1 / ``HEAVY`` of all words or more, so at most ``HEAVY`` for each length) are broadcast, the others meet in a shuffle in which
no key has more than its share of candidates. Of the longer candidates, each passes its count to its suffix link (all but the first word) and to its
prefix (all but the last), where the largest decides whether the shorter one is dropped.

Defined cases: a null text counts as empty; a null language is ``und`` (and joins texts that say ``und``); repeated
rows count each; ties are broken by count and then phrase in byte order; a text of any length is counted in
windows that overlap by ``longest - 1`` words, so nothing is cut; other columns of the table are not read; an empty table, or
one without a frequent phrase, gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import Numbering, bounded_batches, freeing, token_numbers
from brindle.session import checkpointed

LONGEST, LEAST, TOP, SUBSUMED = 3, 10, 2000, 50
UNIT = 1_000_000
SHARD_BYTES = 12 << 20
WINDOW_WORDS = 2_000_000
ROWS_OUT = 50_000
HEAVY = 4096
MARKS = 1 << 26

_BREAK = 0xFF  # no byte of UTF-8
_BYTES = bytes(_BREAK if c in b".,;:!?\n\x0b\x0c\r" else 32 if c in b"\t" else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Marks:
    """A set of 64-bit hashes as a table of ``MARKS`` bits, two for each; it may say yes by chance and never says no to a member."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes % np.uint64(MARKS), (hashes >> np.uint64(32)) % np.uint64(MARKS)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def _word_hashes(lang: str, words: Iterable[bytes]) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64)


def _longer(link: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their suffix links and first words."""
    mixed = (link ^ (link >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class BoundedAutomaton:
    """States of the suffix automaton of number sequences (0 ends a piece) at depths 1 to ``depth``, as one array for each level.

    ``word[d]`` is the first word of each state's phrase, ``link[d]`` its suffix link (a state of the level before, itself at the first).
    ``count`` has the sizes of the endpos sets at the last level. The first ``skip`` numbers are context only. States that ``marks`` of their
    level lack, and those under them, are left out.
    """

    def __init__(self, numbers: np.ndarray, skip: int, depth: int, hashes: np.ndarray, marks: Sequence[Marks] = ()) -> None:
        above = len(hashes)
        self.word, self.link = [np.arange(above)], [np.arange(above)]
        state = np.where(numbers > 0, numbers, -1)  # at each place, of the phrase that ends there
        own = hashes
        for d in range(1, depth):
            alive = state >= 0
            if d <= len(marks):
                alive &= np.append(marks[d - 1].has(own), False)[state]  # the last one is that of no state, -1
            ends = np.flatnonzero(alive[1:] & alive[:-1]) + 1
            found, inverse = np.unique(state[ends] * above + numbers[ends - d], return_inverse=True)
            state = np.full(len(numbers), -1)
            state[ends] = inverse
            self.link.append(found // above)
            self.word.append(found % above)
            own = _longer(own[self.link[-1]], hashes[self.word[-1]])
        ends = state[skip:]
        self.count = np.bincount(ends[ends >= 0], minlength=len(self.word[-1]))

    def phrases(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The phrases of the last level that end beyond the context, built along the suffix links, and their counts."""
        wanted = [np.flatnonzero(self.count)]
        for link in self.link[:0:-1]:
            wanted.append(link[wanted[-1]])
        made = words.take(pa.array(wanted.pop()))
        for word in self.word[1:]:
            made = pc.binary_join_element_wise(words.take(pa.array(word[wanted.pop()])), made, pa.scalar(b" ", pa.large_binary()))
        return made, self.count[self.count > 0]


def _shard(lang: str, texts: list[bytes], depth: int, marks: Sequence[Marks] = ()) -> Iterator[pa.RecordBatch]:
    numbers = Numbering({bytes([_BREAK]): 0})
    data = bytes([_BREAK]).join(texts).translate(_BYTES).replace(bytes([_BREAK]), b" \xff ")
    found = token_numbers(data, numbers)
    del data
    found = np.maximum(found - 1, 0)  # the first word was given 2; now each number is a place in the list of names
    names = list(numbers)
    hashes = _word_hashes(lang, names)
    words = pa.array(names, pa.large_binary())
    del numbers, names
    parts = [(pa.array([b""], pa.large_binary()), np.array([np.count_nonzero(found)]))] if depth == 1 else []
    for start in range(0, len(found), WINDOW_WORDS):
        context = min(start, depth - 1)
        parts.append(BoundedAutomaton(found[start - context : start + WINDOW_WORDS], context, depth, hashes, marks).phrases(words))
        for phrase, count in parts:
            for i in range(0, len(phrase), ROWS_OUT):
                part = phrase.slice(i, ROWS_OUT)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), part.cast(pa.large_string()).cast(pa.string()), pa.array(count[i : i + ROWS_OUT], pa.int64())], names=["lang", "phrase", "c"])
        parts = []


def _shards(depth: int, marks):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Marks(m.value) for m in marks]
        held, size = {}, 0
        for batch in found:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= SHARD_BYTES:
                    for key in list(held):
                        yield from _shard(key, held.pop(key), depth, tables)
                    size = 0
        for key in list(held):
            yield from _shard(key, held.pop(key), depth, tables)

    return run


def _places(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        hashes = np.zeros(len(batch), np.uint64)
        for k, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            words = _word_hashes(lang, phrase.encode().split(b" "))
            own = words[-1:]
            for k2 in range(len(words) - 2, -1, -1):
                own = _longer(own, words[k2 : k2 + 1])
            hashes[k] = own[0]
        at = np.concatenate(Marks.places(hashes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((at & 63).astype(np.int32))], names=["slot", "bit"])


def marks_of(table: DataFrame) -> np.ndarray:
    """The bit table of the phrases of ``table``; at most ``MARKS`` / 64 rows come to the driver."""
    places = table.select("lang", "phrase").mapInArrow(freeing(_places), "slot long, bit int")
    found = places.groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    words = np.zeros(MARKS >> 6, np.uint64)
    words[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


def counts(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, phrase, c, words: occurrences of all phrases of up to ``longest`` words that occur ``least`` times or more; the empty phrase has all words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    table, marks = None, []
    for depth in range(1, longest + 1):
        found = texts.mapInArrow(freeing(_shards(depth, tuple(marks))), "lang string, phrase string, c long")
        level = checkpointed(found.groupBy("lang", "phrase").agg(F.sum("c").alias("c")).filter((F.col("c") >= least) | (F.col("phrase") == "")).withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(depth)))
        if depth < longest:
            marks.append(spark.sparkContext.broadcast(marks_of(level.filter("words > 0"))))
        table = level if table is None else table.unionByName(level)
    return table


def _cuts(phrase: Column, longest: int) -> Column:
    """An array of (cut, side, part) for each place at which the phrase can be cut."""
    words = F.split(phrase, " ")
    n = F.size(words)
    sides = lambda k: F.array(
        F.struct(k.alias("cut"), F.lit(0).alias("side"), F.array_join(F.slice(words, 1, k), " ").alias("part")),
        F.struct(k.alias("cut"), F.lit(1).alias("side"), F.array_join(F.slice(words, k + 1, n - k), " ").alias("part")),
    )
    return F.flatten(F.transform(F.sequence(F.lit(1), n - 1), sides))


def _look_up(needs: DataFrame, table: DataFrame, total: int) -> DataFrame:
    """``needs`` (lang, part, ...) with the count ``f`` of its part."""
    known = table.select("lang", F.col("phrase").alias("part"), F.col("c").alias("f"))
    heavy = F.col("f") * HEAVY >= total
    tried = needs.join(F.broadcast(known.filter(heavy)), ["lang", "part"], "left")
    rest = tried.filter("f IS NULL").drop("f").join(known.filter(~heavy), ["lang", "part"])
    return tried.filter("f IS NOT NULL").unionByName(rest)


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    table = counts(docs, lang, text, longest, least)
    total = table.filter("words = 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    phrases = table.filter("words > 0")
    candidates = phrases.filter("words > 1")

    needs = candidates.select("lang", "phrase", F.col("c").alias("a"), F.explode(_cuts(F.col("phrase"), longest)).alias("x")).select("lang", "phrase", "a", "x.*")
    sides = _look_up(needs, phrases.filter(F.col("words") < longest), total)
    whole = lambda name: F.col(name).cast("decimal(15,0)")
    by_cut = sides.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    made = by_cut.select("*", whole("a").alias("da"), whole("l").alias("dl"), whole("r").alias("dr")).withColumn("score", F.expr(f"(CAST({UNIT} AS DECIMAL(7,0)) * (da * da)) div (dl * dr)"))
    scored = made.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))

    # A longer candidate reports to its suffix link and to its prefix; those hand the largest count on to theirs.
    ends = lambda: F.explode(F.array(F.regexp_replace("phrase", "^[^ ]+ ", ""), F.regexp_replace("phrase", " [^ ]+$", "")))
    cover, level = None, None
    for n in range(longest, 2, -1):
        own = candidates.filter(F.col("words") == n).select("lang", "phrase", "c")
        level = own if level is None else own.unionByName(level)
        level = level.select("lang", ends().alias("phrase"), "c").groupBy("lang", "phrase").agg(F.max("c").alias("c"))
        cover = level if cover is None else cover.unionByName(level)
    if cover is not None:
        scored = scored.join(cover.withColumnRenamed("c", "longer"), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < subsumed * F.col("a")))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.select("lang", "phrase", "a", "s.l", "s.r", "s.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    sizes = table.filter("words = 0").select("lang", F.col("c").alias("n"))
    return first.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 4) r(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL),
size AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND c >= {LEAST}),
cut AS (SELECT c.*, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM cand c, range(1, 3) r(j) WHERE j < k),
s AS (SELECT cut.lang, cut.phrase, cut.k, a, j, x.c AS l, y.c AS r, (1000000 * a::HUGEINT * a::HUGEINT) // (x.c::HUGEINT * y.c::HUGEINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
cover AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN cover ON cover.lang = low.lang AND part = phrase AND low.k = 2 WHERE longer IS NULL OR 100 * longer < {SUBSUMED} * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN size ON size.lang = kept.lang QUALIFY rank <= {TOP}
"""
