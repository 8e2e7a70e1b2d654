"""Lists dealt to pieces, vectors of several lengths, and recall on the given table."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from brindle.llm import posting_lists

SF = "/root/testdata/sf0.01"


def test_pieces_leave_nothing_out(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=3 if i % 3 else 5).round(3).tolist(), "x") for i in range(900)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    is_query = F.col("id") % 100 < 20
    whole, dealt = (sorted(map(tuple, posting_lists.search(docs, is_query, piece=p).collect())) for p in (10_000, 7))
    assert whole == dealt and len(whole) == 1800
    lengths = {i: len(v) for i, v, _ in rows}
    assert all(lengths[q] == lengths[v] for q, _, v, _ in whole)


def test_recall_on_the_table(spark):
    data = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.stack(data.embedding.to_numpy()).astype(float)
    ids = data.vec_id.to_numpy()
    got = posting_lists.query(spark, SF).toPandas()
    found = total = 0
    for q, g in got.groupby("query_id"):
        gap = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        want = [ids[i] for i in np.lexsort((ids, gap)) if ids[i] != q][:10]
        found, total = found + len(set(want) & set(g.vec_id)), total + len(want)
    assert total and found / total >= 0.95
