"""The pipeline on a small corpus with planted cases, and against its parts."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import packing

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents, copies, near copies, toxic and junk documents, and a passage that two documents share."""
    random.seed(3)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "u", "an", "er")]
    word = lambda: "".join(random.choices(syllables, k=random.randint(1, 3)))
    sentence = lambda: " ".join(random.choice(["the", "of", "and", "in"]) if random.random() < 0.3 else word() for _ in range(12)) + "."
    clean = [(i, "\n".join(sentence() for _ in range(20))) for i in range(200)]
    rows = clean + [(1000 + i, t) for i, t in clean[:10]]
    rows += [(1100 + i, t + " Extra.") for i, t in clean[10:20]]
    rows += [(1200 + i, "\n".join([*(sentence() for _ in range(8)), "you rotten swine " + sentence()])) for i in range(60)]
    rows += [(1300 + i, "### %% buy $$$ " * 30) for i in range(5)]
    shared = " ".join(word() for _ in range(60))
    rows += [(1400, sentence() + "\n" + shared + "\n" + "\n".join(sentence() for _ in range(15))), (1401, "\n".join(sentence() for _ in range(15)) + "\n" + shared)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(1200 <= i < 1300)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(rows), shared


def test_stages(spark, corpus, tmp_path):
    folder, texts, shared = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, found = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        found[name] = {r.doc_id: r for r in docs.collect()} if name != "best_fit_packing" else docs.collect()
        assert name == "best_fit_packing" or docs.columns == columns
    clean = set(range(200)) | {1400, 1401}
    ids = set(found["toxicity"])
    assert len(ids & set(range(1200, 1260))) <= 3 and clean <= ids
    ids = set(found["quality_rules"])
    assert not ids & set(range(1300, 1305)) and clean <= ids
    ids = set(found["simhash_dedup"])
    assert not ids & set(range(1000, 1010)) and clean <= ids
    cut = found["suffix_dedup"]
    assert set(cut) == ids and shared in cut[1400].text and shared not in cut[1401].text
    assert all(r.n_chars == len(r.text) for r in cut.values()) and all(cut[i].text == texts[i] for i in range(10))
    path = str(P.path("word_bpe_49k.json"))
    whole = packing.pieces(spark.createDataFrame([(i, r.text) for i, r in cut.items()], "doc_id long, text string"), path)
    want = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole.collect())
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found["best_fit_packing"]) == want
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, found["best_fit_packing"]))


def test_stages_keep_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).select(F.col("sequence_id")).count() == 0


def test_stages_keep_columns_of_any_name(spark, corpus):
    """Values and types of columns that are named like results or inner columns of the operators."""
    folder, texts, _ = corpus
    names = ["score", "kept", "predicted", "n_words", "base_failed", "own", "node", "root", "low", "keys", "__id", "__m", "__text", "__key", "__none", "__tie", "__bucket", "__source", "none"]
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    docs = plain.select(*[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names], "*")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made, want = stage(spark, docs, folder), stage(spark, plain, folder)
        assert made.schema == docs.schema or [f.dataType for f in made.schema] == [f.dataType for f in docs.schema] and made.columns == docs.columns
        rows = made.collect()
        assert {r.doc_id for r in rows} == {r.doc_id for r in want.collect()}
        assert all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names), name
