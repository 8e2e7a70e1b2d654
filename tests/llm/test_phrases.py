"""Phrase collocations against SQL, brute force and the defined cases."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa

from brindle.llm import phrases

SF = "/root/testdata/sf0.001"
RESULT = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, longest=3, least=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, ws), a in candidates.items():
        inside = lambda q: any(q[i : i + len(ws)] == ws for i in range(len(q) - len(ws) + 1))  # noqa: B023, E731
        if any(g == lang and len(q) > len(ws) and inside(q) and 100 * b >= 50 * a for (g, q), b in candidates.items()):
            continue
        score, k, l, r = min((10**6 * a * a // (f[lang, ws[:j]] * f[lang, ws[j:]]), j, f[lang, ws[:j]], f[lang, ws[j:]]) for j in range(1, len(ws)))
        out.append((lang, " ".join(ws), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks = Counter()
    return [(g, ranks.update([g]) or ranks[g], *rest) for g, *rest in out if ranks[g] < top]


def rows_of(df):
    return sorted(tuple(r[c] for c in RESULT) for r in df.collect())


def test_phrases_oracle(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.sql(phrases.ORACLE_SQL).df()
    got = phrases.query(spark, SF).toPandas()
    assert len(want) and list(got.columns) == RESULT
    pd.testing.assert_frame_equal(*(x[RESULT].sort_values(["lang", "rank"]).reset_index(drop=True) for x in (got, want)), check_dtype=False)


def test_phrases_brute(spark):
    draw = random.Random(3)
    words = ["a", "B", "ß", "new", "york", "x-y", "\x85", "of\xa0the"]
    rows = [(draw.choice(["en", None, "und", "de"]), "".join(draw.choices(words, [5, 4, 1, 3, 3, 1, 1, 1])[0] + draw.choice([" ", " ", " ", "\t ", ", ", "\n", "?"]) for _ in range(60)), i, "mine") for i in range(150)]
    rows += [("en", None, 1, ""), (None, "", 2, ""), ("en", " \n.,", 3, None)]
    docs = spark.createDataFrame(rows, "lang string, text string, score int, phrase string").repartition(5)
    for longest in (2, 3, 4):
        assert rows_of(phrases.mine(docs, longest=longest)) == sorted(brute([r[:2] for r in rows], longest))
    assert rows_of(phrases.mine(docs, top=7, least=12)) == sorted(brute([r[:2] for r in rows], top=7, least=12))


def test_phrases_edges(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.mine(empty).columns == RESULT and phrases.mine(empty).count() == 0
    assert phrases.mine(spark.createDataFrame([("en", "only once")], "lang string, text string")).count() == 0
    same = spark.createDataFrame([("en", "to be")] * 30, "lang string, text string")
    assert rows_of(phrases.mine(same)) == [("en", 1, "to be", 30, 30, 30, 60, 1_000_000)]


def test_windows_of_long_texts(monkeypatch):
    draw = random.Random(4)
    text = " ".join(draw.choice("abcd") + draw.choice(["", "", "."]) for _ in range(5000)).encode()

    def totals():
        seen = Counter()
        for depth in (1, 2, 3):
            for batch in phrases._shard("en", [text], depth):
                for p, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    seen[p] += c
        return seen

    whole = totals()
    monkeypatch.setattr(phrases, "WINDOW_WORDS", 37)
    monkeypatch.setattr("brindle.llm.common.TOKEN_WINDOW", 50)
    assert totals() == whole and whole[""] == 5000


def test_automaton_levels():
    numbers = np.array([1, 2, 1, 2, 0, 1, 2, 3])
    names = [b"-", b"a", b"b", b"c"]
    hashes = phrases._word_hashes("en", names)
    got = []
    for depth in (1, 2, 3):
        made, count = phrases.BoundedAutomaton(numbers, 0, depth, hashes).phrases(pa.array(names, pa.large_binary()))
        got.append(dict(zip(made.to_pylist(), count.tolist())))
    assert got == [{b"a": 3, b"b": 3, b"c": 1}, {b"a b": 3, b"b a": 1, b"b c": 1}, {b"a b a": 1, b"b a b": 1, b"a b c": 1}]


def test_marks_leave_out_what_is_rare_only(spark):
    table = spark.createDataFrame([("en", "a"), ("en", "b"), ("de", "c")], "lang string, phrase string")
    marks = [phrases.Marks(phrases.marks_of(table))]
    pairs = [dict(zip(b.column(1).to_pylist(), b.column(2).to_pylist())) for b in phrases._shard("en", [b"a b a b. a c b"], 2, marks)]
    assert pairs == [{"a b": 2, "b a": 1}]
    marks.append(phrases.Marks(phrases.marks_of(table.limit(0).union(spark.createDataFrame([("en", "a b"), ("en", "b a")], table.schema)))))
    three = [dict(zip(b.column(1).to_pylist(), b.column(2).to_pylist())) for b in phrases._shard("en", [b"a b a b. a b b"], 3, marks)]
    assert three == [{"a b a": 1, "b a b": 1}]
