"""Personal data against SQL, brute force, held-out rows and the defined cases."""

import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.llm import personal_data as pii

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def said(spans):
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


TEXTS = [
    None, "", "a@b.c_x@d.e f.g%h@i-j.k.l..m@n", "@@a@b.c.@d.e", "1.2.3.4.5.6.7.8 999.1.2.3.4.5 0001.02.3.255 1.2.3 1.2.3.256", "é😀 me@x.org 😀 10.0.0.1",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 4111  111111111111 00000000000000000000", "+1 (017) 555-7713 +1234567 +12345678 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +(1)23456789 +1((((((",
    "+4111111111111111 a+1@b.de", "9" * 50_000, "a" * 50_000 + "@", "a@" * 20_000, "1.2.3.4 " * 3_000, "x@y.z," * 2_000, "+" * 20_000, "1-" * 20_000, "a." * 20_000 + "@b.c",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "mine", 5, 2.5) for i, t in enumerate(TEXTS)] + [(None, "x@y.zz", "mine", 5, 2.5), (3, TEXTS[3], "mine", 5, 2.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, own int, t0 double").repartition(4).cache()


def test_base_spans(spark, docs):
    got = pii.find(docs)
    assert got.columns == ["doc_id", "text", "own", "t0", "spans"]
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 2 and {(r.own, r.t0) for r in rows} == {(5, 2.5)}
    for r in rows:
        assert [(s.kind, s.lo, s.hi) for s in r.spans.base] == base(r.text), r.doc_id
        assert {tuple(s) for s in r.spans.base} <= {tuple(s) for s in r.spans.spans}
        assert [tuple(s) for s in r.spans.spans] == sorted((tuple(s) for s in r.spans.spans), key=lambda s: (pii.KINDS.index(s[0]), *s[1:]))
    assert pii.find(docs.limit(0)).count() == 0


def test_query_and_oracle(spark, tmp_path):
    docs = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]]
    found = pii.labelled()
    more = pd.DataFrame({"doc_id": range(10**6, 10**6 + 1500), "text": [(b + x + a) * (1 + k % 3) for k, (_, b, x, a, _) in enumerate(found[:1500])]})
    odd = pd.DataFrame({"doc_id": range(2 * 10**6, 2 * 10**6 + len(TEXTS)), "text": [t and t[:500] for t in TEXTS]})
    pd.concat([docs, more, odd]).to_parquet(tmp_path / "documents.parquet", index=False)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = c.sql(pii.oracle_sql()).df()
    got = pii.query(spark, str(tmp_path)).toPandas()
    columns = ["doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256", "spans"]
    assert list(got.columns) == columns
    pd.testing.assert_frame_equal(*(x[columns].sort_values("doc_id").reset_index(drop=True) for x in (got, want)), check_dtype=False)
    texts = dict(zip(*(pd.concat([docs, more, odd])[k] for k in ("doc_id", "text"))))
    for r in got.itertuples():
        spans = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(said(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in PLAIN]
    assert sum(len(r.spans.split(",")) > r.n_email + r.n_ip + r.n_card + r.n_phone for r in got.itertuples() if r.spans) > 300


def test_models_on_rows_not_fitted(monkeypatch):
    """Made-up spans of another draw: few clean ones are taken, most others found."""
    fitted = pii.models()
    draw = random.Random
    monkeypatch.setattr(pii.random, "Random", lambda _: draw(77))
    rows = pii.labelled()
    for kind in pii.KINDS:
        trees, bound = fitted[kind]
        taken = [(r[4], sum(pii.value_of(t, pii.features_of(kind, *pii._in_context(r))) for t in trees) >= bound) for r in rows if r[0] == kind]
        assert sum(t for y, t in taken if not y) <= 0.02 * sum(not y for y, _ in taken)
        assert sum(t for y, t in taken if y) >= 0.8 * sum(y for y, _ in taken)


def test_spans_beyond_the_patterns(spark):
    texts = ["write to jo.doe [at] mail [dot] example [dot] com today", "call (212) 555-0188 now", "host fe80:0:0:0:202:b3ff:fe1e:8329 up", "lived at home. in 2019-05-12 order 1234567890123456 at 12:30:45:10"]
    rows = {r.text: r for r in pii.find(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    kinds = [[s.kind for s in rows[t].spans.spans] for t in texts]
    assert kinds == [["email"], ["phone"], ["ip"], []]


def test_running(spark):
    draw = random.Random(5)
    for n in (0, 1, 255, 256, 257, 3000):
        values = [draw.randrange(100) for _ in range(n)]
        frame = spark.createDataFrame([(values,)], "v array<bigint>")
        sums, tops = frame.select(pii.running(F.col("v"), lambda a, b: a + b), pii.running(F.col("v"), lambda a, b: F.greatest(a, b))).first()
        assert sums == [sum(values[: i + 1]) for i in range(n)] and tops == [max(values[: i + 1]) for i in range(n)]


def test_redact(spark, docs):
    frame = spark.createDataFrame([(1, "😀 a@b.cd, 10.0.0.1"), (2, "nothing"), (3, None), (4, "pay 4111 1111 1111 1111"), (5, "a@b.cd")], "id int, text string")
    assert {r.id: r.redacted for r in pii.redact(frame).collect()} == {1: "😀 [email], [ip]", 2: "nothing", 3: "", 4: "pay [card]", 5: "[email]"}
    marked = {r.doc_id: r.redacted for r in pii.redact(docs).collect()}
    assert marked[13] == "[email]," * 2_000 and marked[12] == "[ip] " * 3_000 and marked[0] == ""
