"""Ranked lexical search against SQL, brute force and the defined cases."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from brindle.llm import lexical

SF = "/root/testdata/sf0.001"


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def brute(docs, items, first=10):
    bags = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out, asked = [], {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, Counter()).update(terms(text))
    for item, bag in asked.items():
        scores = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, times in bag.items() if t in b)
            if s > 0:
                scores.append((-s, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:first])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def run(spark, docs, items):
    n_docs, n_terms = lexical.sizes(docs)
    return rows_of(lexical.search(lexical.build(docs, n_docs, n_terms), lexical.query_terms(items), n_docs))


def test_lexical_oracle(spark):
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = c.sql(lexical.ORACLE_SQL).df()
    got = lexical.query(spark, SF).toPandas()
    assert len(want) and list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(*(x.sort_values(["item_id", "rank"]).reset_index(drop=True) for x in (got, want)), check_dtype=False)


@pytest.fixture(scope="module")
def made():
    draw = random.Random(9)
    words = [f"w{int(draw.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, " ".join(draw.choices(words, k=draw.choice([1, 5, 40, 400])))) for i in range(700)]
    docs += [(5, "Straße w1, W2-w3\x85é"), (5, "Straße w1, W2-w3\x85é"), (None, "w1 w1"), (901, None), (902, ""), (903, " .,!"), (904, "w1 " * 30_000)]
    items = [(k, " ".join(draw.choices(words, k=8))) for k in range(30)] + [(90, None), (91, "?"), (92, "unknown"), (93, "straße W1 w1"), (93, "w2"), (None, "w1")]
    return docs, items


def test_lexical_brute(spark, made):
    docs, items = made
    frame = spark.createDataFrame([(i, t, 1.0, 2) for i, t in docs], "doc_id long, text string, score double, rank int").repartition(4)
    asked = spark.createDataFrame([(i, t, 1.0, 2) for i, t in items], "item_id long, text string, score double, doc_id int")
    assert run(spark, frame, asked) == brute(docs, items)


def test_query_blocks(spark, made, monkeypatch):
    docs, items = made
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "ASKED", 60)
    assert run(spark, frame, asked) == brute(docs, items)


def test_lexical_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert run(spark, none, asked) == [] and run(spark, some, asked.limit(0)) == []
    assert run(spark, some, asked) == brute([(1, "a b")], [(1, "a")])


def _parts(docs, block, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "STRETCHES", 3)
    docs = [(i, t) for i, t in docs if i is not None]
    n_docs, n_terms = sum(bool(terms(t)) for _, t in docs), sum(len(terms(t)) for _, t in docs)
    rows = [r for b in lexical._segment(7, [i for i, _ in docs], [(t or "").encode() for _, t in docs], n_docs, n_terms) for r in b.to_pylist()]
    own = next(r for r in rows if r["term"] == "")
    return rows, np.frombuffer(own["blocks"], "<i8"), np.frombuffer(own["heads"], "<i8")


def test_blocks_round_trip(made, monkeypatch):
    docs, _ = made
    rows, ids, m = _parts(docs, 4, monkeypatch)
    bags = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    assert ids.tolist() == [i for i, _ in bags]
    for r in rows:
        if r["term"]:
            x = lexical._List(r["df"], r["heads"], r["blocks"], m)
            found = [x.block(k) for k in range(len(x.heads))]
            at = [k for k, (_, b) in enumerate(bags) if r["term"] in b]
            assert np.concatenate([d for d, _ in found]).tolist() == at
            assert np.concatenate([i for _, i in found]).tolist() == [10**9 * bags[k][1][r["term"]] // (1000 * bags[k][1][r["term"]] + 8 * int(m[k])) for k in at]
            assert [int(i.max()) for _, i in found] == x.most.tolist()


def test_blocks_are_skipped(monkeypatch):
    docs = [(i, f"common {'rare ' * 5 if i in (3, 4) else ''}word{i % 7}" + " filler" * (i % 50)) for i in range(3000)]
    rows, ids, m = _parts(docs, 16, monkeypatch)
    lists = {r["term"]: lexical._List(r["df"], r["heads"], r["blocks"], m) for r in rows if r["term"]}
    asked = [(lists["common"], 3), (lists["rare"], 9000)]
    got_ids, got = lexical.best_of_segment(asked, ids, 2)
    assert sorted(got_ids.tolist()) == [3, 4]
    assert len(lists["common"].decoded) < len(lists["common"].heads) / 2
