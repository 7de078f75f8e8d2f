"""Approximate nearest neighbours with balanced posting lists.

*Index.* A bounded sample fits centroids on the unit sphere by k-means with a penalty on crowded clusters. Every vector
goes to the list of its nearest centroid and, near a boundary, also to the lists of others within ``closure`` times that
distance, ``replicas`` at most. There are as many lists as the square root of the entries, ``max_lists`` at most, so that
the lists a query reaches, and the answers they give it, grow more slowly than the table. Lists are cut into parts of
``part_rows``, so no task gets an unbounded list.

*Search.* The centroids form a neighbour graph that each task holds in memory; queries walk it best first, until no centroid
within ``ratio`` times the distance of the nearest is left to walk from. All of those found are searched, however many.
A list part and the queries that want it meet in one task, which returns the best of the part for each query; the best
over all parts are the answer.

Equal vectors are one entry with its k + 1 smallest ids, found before anything is dealt out: enough for k answers that
leave out the query itself, so a vector that a third of all rows share costs one entry. Cosines are computed in double
precision on the original vectors, the same way wherever a vector lies. Vectors that are null, zero, or hold nulls or
values that are not finite take no part; nor do null ids. Shorter vectors count as followed by zeros. Ties go to the smaller
id. Repeated rows count once. An id with several vectors answers with its best one. With too few candidates all are
returned. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import Scratch, ship


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 10, crowd: float = 0.15, seed: int = 5) -> np.ndarray:
    """Spherical k-means whose assignment adds ``crowd`` times a cluster's relative size to its distance."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    share = np.ones(k)
    for _ in range(rounds):
        home = np.concatenate([(part @ c.T - crowd * 0.1 * share).argmax(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        share = np.bincount(home, minlength=k) * k / len(x)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.sqrt((total * total).sum(1))
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-12)[:, None], c)
        empty = np.flatnonzero(norm == 0)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c


@dataclass
class CentroidGraph:
    """Centroids and their ``degree`` nearest neighbours; ``entry`` points spread over the graph."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entry: np.ndarray

    @classmethod
    def build(cls, c: np.ndarray, degree: int = 24, entries: int = 8) -> "CentroidGraph":
        degree = min(degree, len(c) - 1)
        near = np.empty((len(c), degree), np.int64)
        for at in range(0, len(c), 1024):
            s = c[at : at + 1024] @ c.T
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
            near[at : at + 1024] = np.argsort(-s, axis=1)[:, :degree]
        # a link back to a random earlier centroid keeps the graph in one piece
        back = np.array([np.random.default_rng(i).integers(0, max(i, 1)) for i in range(len(c))])
        forth = np.roll(np.arange(len(c)), -1)
        return cls(c, np.column_stack([near, back, forth]), np.linspace(0, len(c) - 1, min(entries, len(c))).astype(int))

    def search(self, q: np.ndarray, ratio: float, beam: int = 64) -> np.ndarray:
        """Numbers of the centroids within ``ratio`` times the distance of the nearest. The walk goes on from all of those
        met, and from the ``beam`` nearest if they are fewer."""
        c = self.centroids
        dist = np.full(len(c), np.inf)
        done = np.zeros(len(c), bool)
        new = self.entry
        while True:
            dist[new] = np.sqrt(np.maximum(0, 2 - 2 * (c[new] @ q)))
            met = np.flatnonzero(dist < np.inf)
            least = dist[met].min()
            wide = np.partition(dist[met], min(beam, len(met)) - 1)[min(beam, len(met)) - 1]
            todo = met[~done[met] & (dist[met] <= max(wide, ratio * least + 1e-12))]
            if not len(todo):
                return met[dist[met] <= ratio * least + 1e-12]
            todo = todo[np.argsort(dist[todo], kind="stable")[:32]]
            done[todo] = True
            new = np.unique(self.neighbours[todo])
            new = new[dist[new] == np.inf]


def _postings(shared, closure: float, replicas: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, parts = shared.value
        for batch in batches:
            x = np.array(batch.column("v").to_pylist(), float).reshape(batch.num_rows, -1)
            if not len(x):
                continue
            d = np.sqrt(np.maximum(0, 2 - 2 * unit(x) @ c.T))
            near = np.argsort(d, axis=1, kind="stable")[:, :replicas]
            dist = np.take_along_axis(d, near, 1)
            row, col = np.nonzero(dist <= closure * dist[:, :1] + 1e-12)
            lists = near[row, col]
            part = np.array(batch.column("part").to_numpy())[row] % parts[lists]
            yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(part), batch.column("v").take(pa.array(row)), batch.column("ids").take(pa.array(row))], names=["list", "part", "v", "ids"])

    return run


def _wanted(shared, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, parts = shared.value
        for batch in batches:
            lists, part, row = [], [], []
            x = np.array(batch.column("v").to_pylist(), float).reshape(batch.num_rows, -1)
            for i, q in enumerate(unit(x) if len(x) else x):
                for l in graph.search(q, ratio).tolist():
                    n = int(parts[l])
                    lists += [l] * n
                    part += range(n)
                    row += [i] * n
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), pa.array(part, pa.int64()), batch.column("query_id").take(at), batch.column("v").take(at)], names=["list", "part", "query_id", "v"])

    return run


def _best(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            x = np.array(left.column("v").to_pylist(), float)
            ids = left.column("ids").to_pylist()
            queries = np.array(right.column("v").to_pylist(), float)
            names = right.column("query_id").to_pylist()
            u, w = unit(x), unit(queries)
            for at in range(0, len(w), 512):
                s = w[at : at + 512] @ u.T
                for i, row in enumerate(s):
                    # one vector more, as the query's own may be among them, and all that tie but for rounding
                    edge = np.partition(row, -min(k + 1, len(row)))[-min(k + 1, len(row))]
                    some = np.flatnonzero(row >= edge - 1e-9)
                    q = queries[at + i]
                    exact = (x[some] * q).sum(1) / (np.sqrt((x[some] * x[some]).sum(1)) * np.sqrt((q * q).sum()))
                    found = sorted({(-sc, v) for sc, j in zip(exact.tolist(), some.tolist()) for v in ids[j] if v != names[at + i]})[:k]
                    for sc, v in found:
                        out[0].append(names[at + i])
                        out[1].append(v)
                        out[2].append(-sc)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, part_rows: int = 1024, max_lists: int = 4096, sample_rows: int = 16_384, replicas: int = 2, closure: float = 1.04, ratio: float = 1.28) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest found of each row whose id is divisible by ``every``.

    ``sample_rows`` bounds the vectors that fit the centroids, ``max_lists`` the centroids; every row is indexed.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    # -0.0 and 0.0 are one value
    rows = scratch.table("rows", rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))), "snappy")
    empty = "query_id long, rank int, vec_id long, score double"
    short, width = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if not width:
        return spark.createDataFrame([], empty)
    if short < width:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    least = Window.partitionBy("v").orderBy("id")
    # the rank limit is applied before and after rows are dealt out
    entries = rows.dropDuplicates(["id", "v"]).withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    entries = entries.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = scratch.table("entries", entries.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(1 << 30))), "snappy")

    total = entries.count()
    one_in = max(1.0, total / sample_rows)
    sample = entries.where(F.col("part") < int((1 << 30) / one_in)).orderBy("part").limit(sample_rows).select("v").toArrow()
    x = unit(np.array(sample.column("v").to_pylist(), float)) if sample.num_rows else unit(np.array(entries.select("v").limit(1).toArrow().column("v").to_pylist(), float))
    n_lists = max(1, min(max_lists, math.isqrt(total), len(x)))
    centroids = balanced_centroids(x, n_lists)
    graph = CentroidGraph.build(centroids)
    shared = spark.sparkContext.broadcast((centroids, np.full(n_lists, 1 << 30)))  # max_lists rows at most

    lists = scratch.table("lists", entries.mapInArrow(_postings(shared, closure, replicas), "list long, part long, v array<double>, ids array<long>"), "snappy")
    sizes = np.zeros(n_lists, np.int64)
    for r in lists.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    parts = np.maximum(1, -(-sizes // part_rows))
    count = F.element_at(F.lit(parts.tolist()).cast("array<long>"), (F.col("list") + 1).cast("int"))
    dealt = lists.withColumn("part", F.pmod(F.col("part"), count))
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"]).select(F.col("id").alias("query_id"), "v")
    shared = spark.sparkContext.broadcast((graph, parts))
    wanted = queries.mapInArrow(_wanted(shared, ratio), "list long, part long, query_id long, v array<double>")
    found = dealt.groupBy("list", "part").cogroup(wanted.groupBy("list", "part")).applyInArrow(_best(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
