"""Approximate nearest neighbours by balanced posting lists.

* Centroids come from a bounded sample (``PER_LIST`` vectors for each list, chosen by a hash of the id),
  halved again and again between two means at the median, so all leaves hold equally many sample vectors.
* A graph of near centroids lives in memory with the centroids (at most ``MAX_LISTS`` of them, so it is
  small enough to ship to every task) and finds the nearest ones by a best-first search.
* Every vector goes to its nearest list, and a vector near a border also to others (``REPLICAS`` at most),
  if their centroids are nearly as near.
* A query reads the lists whose centroids are within a ratio of the nearest one's distance, between
  ``MIN_PROBES`` and ``MAX_PROBES`` of them, and measures their vectors exactly.
* A list that has grown beyond ``PIECE`` entries (the sample is only balanced in the sample, and beyond
  ``MAX_LISTS`` lists all of them grow) is dealt to pieces by a hash of the id, and likewise its queries, so no
  task holds a list; each piece answers every query of the list, so nothing is left out.

Equal vectors are one entry that carries its smallest ids (as many as an answer can need), found by a
group-limited window, so a vector that a third of all rows share stays small; equal query vectors are searched
once. Each list returns its best entries for each query, and these are merged.

Defined cases: vectors that are null, all zero, or hold a null or non-finite component take no part, nor do
null ids; vectors of another length are at no distance, so each length is searched by itself; rows that repeat
an id and its vector count once;
rows with the query's own id are never answers; ties go to the smaller id; with fewer candidates than
``k`` all that are found are returned; further columns stay out of the result; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import freeing
from brindle.session import checkpointed

K = 10
PER_LIST = 16
MAX_LISTS = 8_192
LIST_SIZE = 100
PIECE = 4_096
REPLICAS = 6
CLOSURE_RATIO = 1.2
PROBE_RATIO = 1.25
MIN_PROBES, MAX_PROBES = 16, 128
DEGREE = 16
BREADTH = 16
BLOCK = 1 << 22


def balanced_centroids(points: np.ndarray, leaves: int, rounds: int = 6) -> np.ndarray:
    """Means of leaves of equal size, by halving between two means at the median."""
    draw = np.random.default_rng(11)
    done, open_ = [], [(np.arange(len(points)), leaves)]
    while open_:
        rows, n = open_.pop()
        if n <= 1 or len(rows) < 2:
            done.append(points[rows].mean(0))
            continue
        x = points[rows]
        means = x[draw.choice(len(x), 2, replace=False)]
        left = n // 2
        at = max(1, min(len(x) - 1, len(x) * left // n))
        for _ in range(rounds):
            order = np.argsort(((x - means[0]) ** 2).sum(1) - ((x - means[1]) ** 2).sum(1), kind="stable")
            means = np.stack([x[order[:at]].mean(0), x[order[at:]].mean(0)])
        open_ += [(rows[order[:at]], left), (rows[order[at:]], n - left)]
    return np.array(done)


class CentroidGraph:
    """Neighbours of each centroid, and a best-first search for many vectors at once."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE) -> None:
        self.points = centroids
        self.squares = (centroids**2).sum(1)
        n = len(centroids)
        d = min(degree, n - 1)
        near = np.zeros((n, d), np.int32)
        for a in range(0, n, 1024):
            gaps = self.squares - 2 * centroids[a : a + 1024] @ centroids.T
            gaps[np.arange(len(gaps)), np.arange(a, a + len(gaps))] = np.inf
            near[a : a + 1024] = np.argsort(gaps, axis=1, kind="stable")[:, :d]
        # Long links keep the graph connected.
        far = (np.arange(n)[:, None] + np.array([1, max(1, n // 3), max(1, n // 2)])) % max(n, 1)
        self.links = np.concatenate([near, far.astype(np.int32)], 1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(int))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids and distances of each row, nearest first; ``width`` is the breadth of the search."""
        n, width = len(self.points), min(width, len(self.points))
        rows = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), n), bool)
        expanded = np.zeros((len(x), n), bool)
        base = (x**2).sum(1)

        def gaps(ids: np.ndarray) -> np.ndarray:
            return np.maximum(self.squares[ids] - 2 * (self.points[ids] @ x[:, :, None])[:, :, 0] + base[:, None], 0)

        ids = np.repeat(self.entries[None, :], len(x), 0)
        seen[rows, ids] = True
        dist = gaps(ids)
        for _ in range(n):
            order = np.argsort(dist, axis=1, kind="stable")[:, :width]
            ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
            waiting = ~expanded[rows, ids] & np.isfinite(dist)
            if not waiting.any():
                break
            pick = np.argmax(waiting, axis=1)
            here = ids[np.arange(len(x)), pick]
            expanded[np.arange(len(x)), here] = True
            more = self.links[here]
            cost = np.where(seen[rows, more] | ~waiting.any(1)[:, None], np.inf, gaps(more))
            for j in range(1, more.shape[1]):  # a node can be linked twice
                cost[:, j][(more[:, :j] == more[:, j : j + 1]).any(1)] = np.inf
            seen[rows, more] = True
            ids, dist = np.concatenate([ids, more], 1), np.concatenate([dist, cost], 1)
        return ids, np.sqrt(dist)

    def lists_of(self, x: np.ndarray, replicas: int = REPLICAS, ratio: float = CLOSURE_RATIO) -> np.ndarray:
        """Lists of each vector, -1 where there is none: the nearest one, and others if it is near their border."""
        ids, dist = self.search(x, BREADTH)
        keep = np.isfinite(dist) & (dist <= ratio * dist[:, :1])
        keep[:, 0] = True
        return np.where(keep, ids, -1)[:, :replicas]

    def probes_of(self, x: np.ndarray) -> np.ndarray:
        """Lists that each query reads, -1 where there is none."""
        ids, dist = self.search(x, MAX_PROBES)
        keep = np.isfinite(dist) & ((dist <= PROBE_RATIO * dist[:, :1]) | (np.arange(dist.shape[1]) < MIN_PROBES))
        return np.where(keep, ids, -1)[:, :MAX_PROBES]


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _exploded(rows: DataFrame, graph: CentroidGraph, method: str, kind: str) -> DataFrame:
    """(list, id, vector) for the lists that ``method`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1).astype(float)
                lists = getattr(graph, method)(x)
                row, col = np.nonzero(lists >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(lists[row, col].astype(np.int32)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], names=["list", "id", "vector"])

    return rows.select("id", "vector").mapInArrow(freeing(run), kind)


def _best_of_list(k: int):
    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(entries):
            return pd.DataFrame({"qid": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        x, ids = np.stack(entries["vector"].to_numpy()).astype(float), entries["id"].to_numpy()
        q, found = np.stack(queries["vector"].to_numpy()).astype(float), []
        step = max(1, BLOCK // x.size)
        for a in range(0, len(q), step):
            score = np.sqrt(((x[None] - q[a : a + step, None]) ** 2).sum(2))
            best = np.lexsort((np.broadcast_to(ids, score.shape), score), axis=-1)[:, :k]
            found.append((np.repeat(queries["id"].to_numpy()[a : a + step], best.shape[1]), ids[best].ravel(), np.take_along_axis(score, best, 1).ravel()))
        return pd.DataFrame(dict(zip(("qid", "id", "score"), map(np.concatenate, zip(*found)))))

    return run


def _in_pieces(rows: DataFrame, name: str, piece: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the number of their piece of the list, and the count of pieces of each list."""
    counts = rows.groupBy("list").agg(F.ceil(F.count("*") / piece).cast("int").alias(f"{name}s"))
    # A row for each list, of which there are MAX_LISTS at most.
    return rows.join(F.broadcast(counts), "list").withColumn(name, F.pmod(F.xxhash64("id"), F.col(f"{name}s")).cast("int")).drop(f"{name}s"), counts


def search(rows: DataFrame, is_query: Column, k: int = K, list_size: int = LIST_SIZE, piece: int = PIECE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows (vec_id, embedding) that ``is_query`` names, against all rows."""
    valid = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    widths = [r["d"] for r in valid.select(F.size("vector").alias("d")).distinct().orderBy("d").collect()]  # a table has few lengths
    return reduce(DataFrame.union, [_search_width(valid, d, is_query, k, list_size, piece, rows.schema["embedding"].dataType.simpleString()) for d in widths or [1]])


def _search_width(valid: DataFrame, width: int, is_query: Column, k: int, list_size: int, piece: int, item: str) -> DataFrame:
    valid = valid.filter(F.size("vector") == width)
    # The k + 1 smallest ids of each vector; the window is cut before its exchange.
    first = Window.partitionBy("vector").orderBy("id")
    entries = valid.withColumn("n", F.rank().over(first)).filter(F.col("n") <= k + 1)
    entries = entries.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    entries = checkpointed(entries.select(F.get("ids", F.lit(0)).alias("id"), "vector", F.slice("ids", 1, k + 1).alias("ids")))
    lists = max(1, min(MAX_LISTS, -(-entries.count() // list_size)))
    # At most PER_LIST * MAX_LISTS vectors.
    sample = entries.orderBy(F.xxhash64("id"), "id").limit(PER_LIST * lists).select("vector").toArrow().column(0)
    points = sample.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sample), width)
    graph = CentroidGraph(balanced_centroids(points, lists) if len(points) else np.zeros((1, width)))
    kind = f"list int, id long, vector {item}"
    posted = _exploded(entries, graph, "lists_of", kind)
    queries = valid.filter(is_query).groupBy("vector").agg(F.min("id").alias("id"))
    probes = _exploded(queries, graph, "probes_of", kind)
    posted, pieces = _in_pieces(checkpointed(posted), "piece", piece)
    probes, turns = _in_pieces(checkpointed(probes), "turn", piece)
    posted = posted.join(F.broadcast(turns), "list").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
    probes = probes.join(F.broadcast(pieces), "list").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    keys = ["list", "piece", "turn"]
    found = probes.groupBy(*keys).cogroup(posted.groupBy(*keys)).applyInPandas(_best_of_list(k + 1), "qid long, id long, score double")
    order = Window.partitionBy("qid").orderBy("score", "id")
    best = found.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    near = best.join(entries.select("id", "ids"), "id").select("qid", F.explode("ids").alias("vec_id"), "score")
    answers = near.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1).alias("near"))
    asked = valid.filter(is_query).distinct().join(queries.withColumnRenamed("id", "qid"), "vector").join(answers, "qid")
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)
    out = asked.select(F.col("id").alias("query_id"), F.posexplode(own).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("id") % 100 == 0)
