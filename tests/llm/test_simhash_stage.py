"""The pipeline's stage ``simhash_dedup`` links by SimHash; MinHash keys add what lies beyond its radius."""

import random

import corpus_pipeline
from brindle.llm import near_copies


def test_simhash_alone_finds_close_copies(spark, monkeypatch):
    random.seed(8)
    words = [f"w{random.randrange(9000)}" for _ in range(2000)]
    other = [f"v{random.randrange(9000)}" for _ in range(2000)]
    near = [*words[:1000], "changed", *words[1001:]]
    prints = [near_copies.set_fingerprint(near_copies.shingle_set(" ".join(t))) for t in (words, near)]
    assert 0 < ((prints[0] ^ prints[1]) & (2**64 - 1)).bit_count() <= 3
    plain = near_copies.shared_keys
    monkeypatch.setattr(near_copies, "shared_keys", lambda nodes: plain(nodes).limit(0))
    docs = spark.createDataFrame([(3, " ".join(near)), (1, " ".join(words)), (2, " ".join(other)), (4, " ".join(words).upper()), (5, None), (6, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 2, 5]


def test_candidates_are_checked_exactly(spark):
    """Sets of one SimHash, and SimHashes within three bits, are candidates only."""
    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 0b111), (4, 0b1111 << 20)], "node long, fp long")
    pairs = near_copies.fingerprint_pairs(nodes)
    assert sorted(map(tuple, pairs.collect())) in ([(1, 2), (1, 3)], [(1, 2), (3, 1)])
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, "A b c d e f")], "node long, text string")
    links = near_copies.star_links(pairs, texts).collect()
    assert {frozenset(r) for r in links} == {frozenset((1, 3))}
