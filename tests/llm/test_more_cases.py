"""Toxicity against a plain model and on held-out labels; clashing columns, null and repeated rows; hot keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import byte_bpe, packing, simhash, toxicity

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.1"


def test_ftrl_equals_a_plain_one():
    """Per-coordinate FTRL-proximal written out for one example and one coordinate at a time."""
    draw = np.random.default_rng(2)
    size, l1, alpha, beta = 12, 0.4, toxicity.ALPHA, toxicity.BETA
    model = toxicity.Ftrl(size, l1)
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        penalty = 0.0 if i == size else l1
        return 0.0 if abs(z[i]) <= penalty else -(z[i] - np.sign(z[i]) * penalty) / ((beta + n[i] ** 0.5) / alpha)

    for _ in range(300):
        x = [*np.flatnonzero(draw.random(size) < 0.3).tolist(), size]
        y = float(0 in x or draw.random() < 0.1)
        w = {i: weight(i) for i in x}
        p = 1 / (1 + np.exp(-sum(w.values())))
        for i in x:
            g = p - y
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
            n[i] += g * g
        model.step(np.array(x), y)
    assert model.weights(np.arange(size + 1)) == pytest.approx([weight(i) for i in range(size + 1)])
    assert model.weights(np.arange(size + 1))[0] > 0


def test_held_out_labels(spark):
    got = toxicity.query(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    bad, good = held[held.toxic == 1], held[held.toxic == 0]
    assert len(bad) and (good.predicted == 0).mean() > 0.97 and (bad.predicted == 1).mean() > 0.7
    order = held.score.rank()
    auc = (order[held.toxic == 1].sum() - len(bad) * (len(bad) + 1) / 2) / (len(bad) * len(good))
    assert auc > 0.95


def test_long_texts_are_read_in_windows(monkeypatch):
    texts = ["one two three " * 40, "x" * 900 + " ab " + "y" * 700, "", "Aé b", "word " * 300]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    whole = [np.unique(toxicity._keys(*toxicity._words(r, np.array([0, len(r)])))[1]).tolist() for r in raw]
    for chunk in (7, 100, 1000):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        toxicity._powers.clear()
        assert [np.unique(toxicity.features(r, np.array([0, len(r)]))[1]).tolist() for r in raw] == whole
    toxicity._powers.clear()


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, [1], b"x"), (1, "a b c", 5, [1], b"x"), (None, None, 6, None, None)], "doc_id long, text string, fp int, ids array<int>, decoded binary")
    made = simhash.fingerprints(docs)
    assert made.columns == ["doc_id", "text", "ids", "decoded", "fp"] and made.filter("fp = 0").count() == 1
    path = str(P.path("byte_bpe_50k.tiktoken"))
    both = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path)
    assert both.columns == ["doc_id", "text", "fp", "ids", "decoded"]
    assert sorted(bytes(r.decoded) for r in both.collect()) == [b"", b"a b c", b"a b c"]


def test_hot_fingerprints_are_dealt(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i % 3 else f"some words that differ {i} {i * 7} {i * 13}") for i in range(300)], "doc_id long, text string")
    whole = sorted(map(tuple, simhash.components_of(docs).collect()))
    monkeypatch.setattr(simhash, "HOT_ROWS", 20)
    assert sorted(map(tuple, simhash.components_of(docs).collect())) == whole


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null texts and ids, repeated rows, no n_chars, and columns named like those of the stages."""
    text = "\n".join(f"the man of house {i} and a dog in yard {i * 7} is the friend {i * 3} to all that are {i * i}" for i in range(30))
    other = "\n".join(f"a tree was on the hill {i * 3} as rain came from the west {i * 11} and it is not far by foot {i + 5}" for i in range(30))
    rows = [(1, text, 0.5, "k"), (1, text, 0.5, "k"), (2, text, 0.5, "k"), (None, other, 0.1, None), (3, None, None, "k"), (4, "", 1.0, "k")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, score double, kept string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = str(tmp_path / f"out{k}")
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == ["doc_id", "text", "score", "kept"], name
    assert sorted((r.doc_id is None, r.text) for r in docs.collect()) == [(False, text), (True, other)]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(packed) == 2 and {r.doc_id for r in packed} == {1, None}


def test_packing_nears_the_lower_bound():
    draw = np.random.default_rng(3)
    lengths = np.minimum(4096, (draw.lognormal(5.5, 1.2, 200_000)).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    assert packing.plan(counts).sequences <= 1.001 * -(-int(lengths.sum()) // 4096) + 1
