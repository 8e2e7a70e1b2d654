"""The pipeline's near-copy stage against brute force over sets of five words."""

import random

import numpy as np
import pytest
from test_operators import edges, empty  # noqa: F401
from test_pipeline import corpus  # noqa: F401

import corpus_pipeline
from brindle.llm import near_copies


def shingles(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_parts(sets):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and similar(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def drifting(seed, families, members, words=60):
    """Families of texts in which each is some words away from an earlier one."""
    random.seed(seed)
    word = lambda: f"w{random.randrange(5000)}"
    texts = []
    for _ in range(families):
        mine = [[word() for _ in range(words)]]
        for _ in range(members - 1):
            new = list(random.choice(mine))
            for _ in range(random.randint(1, 3)):
                new[random.randrange(len(new))] = word()
            mine.append(new)
        texts += [" ".join(t) for t in mine]
    random.shuffle(texts)
    return texts


def test_linked_parts(monkeypatch):
    texts = drifting(1, 3, 25)
    want = brute_parts([shingles(t) for t in texts])
    assert len(set(want)) > 6
    found = [near_copies.shingle_set(t) for t in texts]
    assert near_copies.linked_parts(found).tolist() == want
    monkeypatch.setattr(near_copies, "COMPARED", 100)
    assert near_copies.linked_parts(found).tolist() == want
    assert len(near_copies.shingle_set("a B c")) == 1 and np.array_equal(near_copies.shingle_set("A b\tC"), near_copies.shingle_set("a B c"))


def test_threshold(spark):
    words = [f"w{i}" for i in range(45)]  # 41 shingles
    at, below = " ".join(words[:-8]), " ".join(words[:-9])  # 33 and 32 of 41 shingles
    got = near_copies.dedup(spark.createDataFrame([(2, " ".join(words)), (1, at)], "doc_id long, text string")).collect()
    assert [r.doc_id for r in got] == [1]
    got = near_copies.dedup(spark.createDataFrame([(2, " ".join(words)), (1, below)], "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2]


def test_dedup_against_brute_force(spark):
    texts = drifting(2, 30, 12)
    texts += texts[:20]
    sets = [shingles(t) for t in texts]
    want = sorted(set(brute_parts(sets)))
    got = near_copies.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in got.collect()) == want


@pytest.mark.parametrize("block", [1, 3, 40])
def test_small_blocks_against_brute_force(spark, monkeypatch, block):
    """Few keys for many texts below the threshold, so that most pairs are left to the cells."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = drifting(5, 3, 30, 40)
    found = [near_copies.shingle_set(t) for t in texts]
    nodes = spark.createDataFrame([(k, [1, 2 + k % 2], len(s)) for k, s in enumerate(found)], "node long, keys array<long>, n long")
    shown = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    shared = near_copies.shared_keys(nodes)
    parts = near_copies.components(near_copies.star_links(shared, shown))
    dealt = near_copies.cells(shared, parts)
    sizes = [r["count"] for r in dealt.groupBy("key", "x", "y").count().collect()]
    assert max(sizes) < (20 if block < 40 else 91)
    more = near_copies.components(near_copies.cell_links(dealt, shown))
    first, last = dict(parts.collect()), dict(more.collect())
    got = [last.get(first.get(k, k), first.get(k, k)) for k in range(len(texts))]
    assert got == brute_parts([shingles(t) for t in texts])


def test_known_parts_and_sides():
    texts = drifting(1, 3, 25)
    found, want = [near_copies.shingle_set(t) for t in texts], brute_parts([shingles(t) for t in texts])
    assert near_copies.linked_parts(found, parts=np.array(want)).tolist() == want
    sides = np.arange(len(texts)) % 2
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sides[i] != sides[j] and similar(shingles(texts[i]), shingles(texts[j])):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert near_copies.linked_parts(found, sides=sides).tolist() == root


def test_defined_cases(spark, edges, empty):  # noqa: F811
    kept = near_copies.dedup(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (True, 0)]
    assert near_copies.dedup(empty).count() == 0


def test_stage_drops_near_copies(spark, corpus):  # noqa: F811
    folder, texts, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, folder).collect()}
    assert not ids & (set(range(1110, 1120)) | set(range(1000, 1010))) and set(range(200)) <= ids


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [shingles(t) for _, t in rows]
    holders = {}
    for k, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    root = list(range(len(rows)))
    pairs = {(a, b) for hold in holders.values() for i, b in enumerate(hold) for a in hold[:i]}
    pairs |= {(a, b) for b in range(len(rows)) for a in range(b) if not sets[a] and not sets[b]}
    for a, b in pairs:
        if root[a] != root[b] and similar(sets[a], sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    ids = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert ids == sorted(rows[k][0] for k in set(root))
