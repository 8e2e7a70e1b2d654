"""The ten operators against brute force and on the defined edge cases."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import byte_bpe, main_text, packing, posting_lists, quality_rules, sharding, simhash, suffix_dedup, toxicity, url_filter

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
EDGES = [(None, "a b c"), (1, None), (2, ""), (3, " \n\t "), (4, "word " * 30_000), (5, "same text " * 20), (6, "same text " * 20), (6, "same text " * 20)]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, "x", 1.5, True) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, kept boolean").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, score double, kept boolean")


# quality rules


def brute_quality(text):
    import re

    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams, covered = {}, set()
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in grams.values():
        if len(places) > 1:
            covered.update(k for i in places for k in range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, edges, empty):
    got = quality_rules.judge(edges)
    assert got.columns[:4] == ["doc_id", "text", "source", "score"]
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (not r.base_failed or not r.kept)
    assert quality_rules.judge(empty).count() == 0
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"]
    for r in quality_rules.query(spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(docs[r.doc_id])


def test_quality_oracle(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.sql(quality_rules.ORACLE_SQL).df()
    got = quality_rules.query(spark, SF).toPandas()
    columns = sorted(want.columns)
    pd.testing.assert_frame_equal(*(x[columns].sort_values("doc_id").reset_index(drop=True) for x in (got, want)), check_dtype=False)


# toxicity


def test_toxicity_learns(spark):
    random.seed(1)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 7 == 0
        text = random.choices(words, k=40) + (["Rotten"] if bad else [])
        random.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert 0 < len(model[0]) < 3000
    got = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = sum(r.predicted == (r.doc_id % 7 == 0) for r in held) / len(held)
    assert right > 0.97


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(edges, labels)
    got = toxicity.score(edges, model)
    assert sorted(got.columns) == sorted(["doc_id", "text", "source", "kept", "score", "predicted"]) and got.count() == len(EDGES)
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert {r.score for r in toxicity.score(edges, toxicity.train(empty, labels)).collect()} == {0.0}


def test_features_do_not_cross_texts():
    def sets(texts):
        raw, at = toxicity.text_buffers(pa.array(texts))
        row, key = toxicity.features(raw, at)
        return [set(key[row == k].tolist()) for k in range(len(texts))]

    both = sets(["Bad-word one", "two THREE four", "", None, "bad word ONE"])
    assert both[0] == sets(["bad word one"])[0] == both[4] and both[1] == sets(["two three four"])[0] and not both[2] and not both[3]
    assert len(both[1]) == 6


# nearest neighbours


def brute_near(ids, x, q, k=10):
    score = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    return [ids[i] for i in np.lexsort((ids, score)) if ids[i] != q][:k]


def test_posting_lists_recall(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(3000, 16)).astype("float32")
    x[1000:2000] = x[5]  # a vector that a third of the rows share
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = posting_lists.search(rows, F.col("id") % 100 == 0).toPandas()
    ids, xs = np.arange(3000), x.astype(float)
    found = total = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and list(zip(g.score, g.vec_id)) == sorted(zip(g.score, g.vec_id))
        exact = np.sqrt(((xs[g.vec_id] - xs[q]) ** 2).sum(1))
        assert np.allclose(exact, g.score, rtol=0, atol=1e-12)
        want = brute_near(ids, xs, q)
        if 1000 <= q < 2000:
            assert list(g.vec_id) == want
        found, total = found + len(set(want) & set(g.vec_id)), total + 10
    assert got.query_id.nunique() == 30 and found / total >= 0.9


def test_posting_lists_edges(spark):
    kind = "vec_id long, embedding array<float>, label int"
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [float("nan"), 1.0], 1), (5, [None, 1.0], 1), (6, [2.0, 0.0], 1), (6, [2.0, 0.0], 1), (7, [0.0, 3.0, 1.0], 1), (None, [1.0, 1.0], 1), (8, [float("inf"), 1.0], 1)]
    got = posting_lists.search(spark.createDataFrame(rows, kind), F.col("id") % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.0), (0, 2, 6, 1.0)]
    assert posting_lists.search(spark.createDataFrame([], kind), F.col("id") % 100 == 0).count() == 0


# SimHash


def brute_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=3):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def test_covering_masks():
    masks = simhash.covering_masks()
    random.seed(2)
    for _ in range(2000):
        differing = sum(1 << k for k in random.sample(range(64), 3))
        assert any(m & differing == 0 for m in masks)


@pytest.mark.parametrize("limit", [2048, 3])
def test_simhash_links(spark, limit):
    random.seed(7)
    values = {random.getrandbits(64) for _ in range(4)}
    while len(values) < 150:
        x = random.choice(sorted(values))
        for _ in range(random.randint(1, 5)):
            x ^= 1 << random.randrange(64)
        values.add(x)
    values = sorted(values)
    rows = spark.createDataFrame([(simhash._signed(x),) for x in values], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.near_links(rows, 3, limit)).collect()}
    got = [roots.get(simhash._signed(x), simhash._signed(x)) for x in values]
    want = brute_components(values)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_simhash_query(spark, edges, empty):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    values = [brute_fingerprint(t) for t in docs.text]
    got = simhash.query(spark, SF).toPandas().sort_values("doc_id")
    assert list(got.fingerprint) == [f"{v:016x}" for v in values]
    ids = list(docs.doc_id)
    assert list(got.component_id) == [ids[k] for k in brute_components(values)]
    found = {(r.doc_id, r.fp): r.component_id for r in simhash.components_of(edges).collect()}
    assert found[2, 0] == found[3, 0] == 1 and found[6, simhash._signed(brute_fingerprint(EDGES[5][1]))] == 5
    kept = simhash.dedup(edges).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 4), (False, 5), (True, 0)]
    assert simhash.dedup(empty).count() == 0 and simhash.components_of(empty).count() == 0


# suffix dedup


def brute_cut(rows, width=50):
    first = {}
    for i, t in rows:
        b, k = (t or "").encode(), suffix_dedup.NO_ID if i is None else i
        for p in range(len(b) - width + 1):
            first[b[p : p + width]] = min(k, first.get(b[p : p + width], k))
    out = []
    for i, t in rows:
        b, k = (t or "").encode(), suffix_dedup.NO_ID if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < k:
                gone[p : p + width] = b"\1" * width
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def random_documents(seed):
    random.seed(seed)
    base = ["".join(random.choice("abé \n") for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(50):
        t = ""
        while random.random() < 0.8:
            x, a = random.choice(base), random.randrange(300)
            t += x[a : a + random.randrange(20, 150)] + random.choice(["", "x", "yy"])
        rows.append((random.choice([i, i, i, 3, None]), random.choice([t, t, t, t * 4, None, ""])))
    return rows + rows[:4]


@pytest.mark.parametrize("step, level, batch", [(1 << 20, 1 << 20, 1 << 24), (200, 300, 3000), (64, 50, 500)])
def test_suffix_family_in_process(monkeypatch, step, level, batch):
    """Tiny windows, levels and batches, so that levels merge and passages cross all borders."""
    for name, v in (("STEP", step), ("LEVEL_SUFFIXES", level), ("BATCH_BYTES", batch)):
        monkeypatch.setattr(suffix_dedup, name, v)
    suffix_dedup._tables.clear()
    rows = random_documents(step)
    ids = np.array([suffix_dedup.NO_ID if i is None else i for i, _ in rows])
    raw, at = suffix_dedup.text_buffers(pa.array([t for _, t in rows]))
    parts, blobs = 5, {}
    everything = np.unique(suffix_dedup._runs(raw, at, 50, 20)[3] >> suffix_dedup._SHORT)
    keys = np.arange(len(rows))
    for i, j in suffix_dedup.slices(at, batch):
        for p, blob in suffix_dedup._batch_blobs(ids[i:j], keys[i:j], raw[at[i] : at[j]], at[i : j + 1] - at[i], parts, 50, 20, everything):
            blobs.setdefault(p, []).append(blob)
    gone = [bytearray(at[k + 1] - at[k]) for k in range(len(rows))]
    for p in blobs:
        _, row_keys, row, start, end = suffix_dedup._part_ranges(iter(blobs[p]), 50)
        for r, a, b in zip(row_keys[row], start, end):
            gone[r][a:b] = b"\1" * (b - a)
    got = sorted(((i, len(g), sum(g)) for (i, _), g in zip(rows, gone)), key=repr)
    assert got == sorted((x[:3] for x in brute_cut(rows)), key=repr)


def test_suffix_dedup(spark, edges, empty):
    def digest(cut):
        n = F.coalesce(F.octet_length("text"), F.lit(0))
        removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
        return sorted(map(tuple, cut.select("doc_id", n, removed, F.size("spans"), F.sha2("kept", 256)).collect()), key=repr)

    rows = random_documents(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert digest(suffix_dedup.cut_repeats(docs, part_bytes=2000)) == brute_cut(rows)
    assert digest(suffix_dedup.cut_repeats(edges)) == brute_cut([(i, t) for i, t in EDGES])
    assert suffix_dedup.cut_repeats(edges).columns == ["doc_id", "text", "source", "score", "kept", "spans"]
    assert suffix_dedup.cut_repeats(empty).count() == 0
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = suffix_dedup.query(spark, SF).toPandas()
    assert sorted(map(tuple, got[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]].values.tolist()), key=repr) == brute_cut(list(zip(docs.doc_id, docs.text)))


# packing


def check_packing(rows, capacity=4096):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, edges, empty):
    from tokenizers import Tokenizer

    path = str(P.path("word_bpe_49k.json"))
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    rows = packing.query(spark, SF).collect()
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"]
    ids = {i: np.array(model.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in docs.items()}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.start == 4096 * r.piece
    total = sum(map(len, ids.values()))
    assert sum(r.length for r in rows) == total
    assert check_packing(rows) <= -(-total // 4096) * 1.03 + 1
    got = packing.pack(packing.pieces(edges, path)).collect()
    assert len(got) >= len(EDGES) and sum(r.length == 1 for r in got) == 3
    check_packing(got)
    assert packing.pack(packing.pieces(empty, path)).count() == 0


@pytest.mark.parametrize("rule", ["dot", "norm"])
@pytest.mark.parametrize("limits", [{}, {"pieces": 3}, {"attention": 4096 * 1024}])
def test_packing_plan(rule, limits):
    limits = packing.Limits(rule=rule, **limits)
    random.seed(9)
    counts = {random.randint(1, 2000): random.randint(1, 30) for _ in range(60)}
    made = packing.plan(counts, limits)
    length = np.concatenate([np.full(n, k) for k, n in counts.items()])
    number = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = packing.place(length, number, made)
    for q in np.unique(sequence):
        mine = np.argsort(offset[sequence == q])
        size = length[sequence == q][mine]
        assert list(offset[sequence == q][mine]) == [0, *np.cumsum(size)[:-1]]
        assert size.sum() <= limits.tokens and len(size) <= limits.pieces and (size**2).sum() <= limits.attention


def test_chunked_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = str(P.path("word_bpe_49k.json"))
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    code = packing.Tokens(path)
    bits = ["ab", "the", "ing", " ", "é", "ß", "中", "😀", "1", "23", "!", "\n", "\t", "\u0301", "ΑΣ", "xQ", "'s", "İ", "\x00", "\x1c", "\xa0", ".", ",", "K"]
    random.seed(5)
    for _ in range(3000):
        text = "".join(random.choice(bits) for _ in range(random.randint(0, 30)))
        assert np.frombuffer(code.ids(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


# sharding


def test_communication_matrix_is_uniform():
    sums = np.zeros((3, 2))
    for seed in range(3000):
        m = sharding.communication_matrix(np.array([2, 3, 5]), np.array([6, 4]), seed)
        assert (m.sum(1) == [2, 3, 5]).all() and (m.sum(0) == [6, 4]).all()
        sums += m
    assert np.allclose(sums / 3000, np.outer([2, 3, 5], [0.6, 0.4]), atol=0.06)


def test_sharding(spark, edges, empty):
    made = sharding.shuffle_into_shards(sharding.digest(edges), 3, block_rows=2).collect()
    assert sorted(sum(r.shard == k for r in made) for k in range(3)) == [2, 3, 3]
    for k in range(3):
        assert sorted(r.slot for r in made if r.shard == k) == list(range(sum(r.shard == k for r in made)))
    assert sorted((r.size, r.text_crc32) for r in made) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in EDGES)
    assert sharding.shuffle_into_shards(sharding.digest(empty), 8).count() == 0
    again = sharding.query(spark, SF).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, sharding.query(spark, SF).collect()))


# main text


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<body><nav>menu</nav><article><h1>T</h1><p>One,  two<br>three &lt;x&gt;<p>Next <b>bo</b>ld.</article><footer>f</footer>", "T One, two three <x> Next bold."),
        ("<div class='sidebar'><p>" + "side, bar " * 30 + "</p></div><div><p>" + "main, text " * 9 + "</p></div>", " ".join(["main, text"] * 9)),
        ("<article><p>Kept &am", "Kept &am"),
        ("<article><p>A</p><script>if (a < b) { x('</p>') }</script><!-- <p>no</p> --><form><p>no</p></form></article>", "A"),
        ("<div" * 20000, ""),
    ],
)
def test_main_text(html, want):
    assert main_text.main_text(html) == want


def test_main_text_query(spark):
    import html
    import re

    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    for r in main_text.query(spark, SF).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages.html[r.page_id], re.S)[1]
        blocks = re.sub(r"<[^>]*>", "", re.sub("<br>", " ", re.sub(r"</?(?:p|h1)>", "\0", inner))).split("\0")
        want = " ".join(" ".join(html.unescape(b).split()) for b in blocks if b.split())
        assert r.text == want and r.n_chars == len(want) and r.url == pages.url[r.page_id]
    assert main_text.extract(spark.createDataFrame([], "page_id long, html string, text string")).count() == 0


# url filter


def test_url_filter(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    urls = ["https://Example.com/en/x", "http://www.EXAMPLE.com/en/1", "http://a.net/es/", "http://net/es/", "http://x.com", "x.com/en", "", "http://a.b/c://d.net/es/", None, "https://www.example.com/de/", "http://net/fr/a?b#c", "http://é中.org/ü/", "https://casino-bonus.example.org/en/1", "https://library.example.org/en/1"]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge(rows, model).orderBy("page_id").collect()
    assert [r.rule for r in got] == ["example.com/en/", "www.example.com/en/", "net/es/", "net/es/", None, None, None, None, None, "com/", "net/fr/", None, None, None]
    assert (got[0].host, got[0].path, got[7].host, got[7].path, got[5].host) == ("example.com", "/en/x", "a.b", "/c://d.net/es/", "")
    assert [r.verdict for r in got[:4]] == ["block", "allow", "block", "block"] and [r.verdict for r in got[-2:]] == ["block", "allow"]
    for r in got:
        found = set()
        for mark, s in (("h", r.host), ("p", r.path)):
            c = f"^{s}$" if s else ""
            found |= {int(hashlib.md5((mark + c[i : i + n]).encode()).hexdigest()[:3], 16) for n in url_filter.SIZES for i in range(len(c) - n + 1)}
        z = model[1] + sum(model[0][b] for b in found)
        assert r.score == pytest.approx(1 / (1 + np.exp(-z / url_filter.UNIT)), abs=1e-9)
    plan = url_filter.judge(rows, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), model).count() == 0


# byte BPE


def test_byte_bpe(spark, edges, empty):
    tiktoken = pytest.importorskip("tiktoken")
    path = str(P.path("byte_bpe_50k.tiktoken"))
    known = byte_bpe.vocabulary(path)
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=known.ranks, special_tokens={})
    code = byte_bpe.encoder(path, P.PATTERN)
    bits = ["ab", "the", "ing", " ", "é", "ß", "中", "😀", "1", "23", "!", "\n", "\t", "\u0301", "zz", "xQ", "er", "tion", "\x00", "\xa0"]
    random.seed(3)
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 60))) for _ in range(3000)] + ["a" * 20000, "".join(random.choice("abcdefgh") for _ in range(20000))]
    for text in texts:
        assert np.frombuffer(code.ids(text), "<i4").tolist() == real.encode_ordinary(text)
    both = byte_bpe.decode(byte_bpe.encode(edges, path, P.PATTERN), path).collect()
    assert all(r.ids == real.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in both)
    assert byte_bpe.decode(byte_bpe.encode(empty, path, P.PATTERN), path).count() == 0
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"]
    for r in byte_bpe.query(spark, SF).collect():
        ids = real.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
