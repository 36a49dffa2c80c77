"""Approximate largest inner products by an adaptive dimension scan.

Vectors get one more coordinate that makes all norms equal, so the largest
inner product is the smallest distance, and are rotated at random.  They are
assigned to lists by k-means centroids; a query probes its nearest lists.
Inside a list, distances grow block by block of columns; after every block a
hypothesis test on the partial distance (which, after the rotation, estimates
the whole one) abandons candidates that are too far from the query's bound.
Survivors are scored exactly on the original vectors.

Centroids, the number of probed lists and each query's first bound come from
a bounded sample (``SAMPLE_ROWS`` rows); every row is indexed.  The number
of probes is the least with which the sample's own neighbours are found at
``target_recall``.

Defined cases: vectors that are null, zero, of another length than most, or
that hold null or non-finite values take no part; of rows with one id the
greatest vector stands; ties go to the smaller id; fewer candidates than
``k`` are all returned; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexicarta.llm.common import Staged

SAMPLE_ROWS = 8192
MAX_LISTS = 1024
#: A tile compares at most about so many vectors with so many queries.
TILE_VECTORS, TILE_QUERIES = 4096, 1024
BLOCK = 16  # columns per step
EPSILON = 2.1  # width of the hypothesis test


def usable_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec array<double>) of the vectors that take part."""
    vec = F.col(vec_col).cast("array<double>")
    good = (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    kept = rows.where(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), vec.alias("vec"))
    size = kept.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    kept = kept.where(F.size("vec") == (size.d if size else 0))
    return kept.groupBy("vec_id").agg(F.max("vec").alias("vec"))


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    radius2: float  # the common squared norm
    probes: int
    sample_ids: np.ndarray
    sample: np.ndarray
    sample_lists: np.ndarray

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.radius2 - (x * x).sum(1), 0))
        return np.concatenate([x, extra[:, None]], 1) @ self.rotation

    def nearest_lists(self, lifted: np.ndarray, n: int) -> np.ndarray:
        d = (self.centroids ** 2).sum(1)[None, :] - 2 * lifted @ self.centroids.T
        return np.argsort(d, 1, kind="stable")[:, :n]


def fit(vectors: DataFrame, k: int, target_recall: float, seed: int = 11) -> Index | None:
    """Fit rotation, centroids and probes on a bounded sample."""
    stats = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("r")).first()
    if not stats.n:
        return None
    share = min(1.0, 1.5 * SAMPLE_ROWS / stats.n)
    u = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 20)) / float(1 << 20)
    rows = vectors.where(u <= share).orderBy(F.xxhash64(F.lit(seed), "vec_id")).limit(SAMPLE_ROWS).collect()
    ids, sample = np.array([r.vec_id for r in rows]), np.array([r.vec for r in rows])
    rng = np.random.default_rng(seed)
    d = sample.shape[1] + 1
    rotation, _ = np.linalg.qr(rng.normal(size=(d, d)))
    lists = int(max(1, min(MAX_LISTS, len(sample) // 16, round(stats.n ** 0.5 / 2))))
    index = Index(rotation, np.zeros((0, d)), float(stats.r), lists, ids, sample, np.zeros(len(ids), np.int64))
    lifted = index.lift(sample, False)
    centroids = lifted[rng.choice(len(lifted), lists, replace=False)]
    for _ in range(10):
        owner = np.argmin((centroids ** 2).sum(1)[None, :] - 2 * lifted @ centroids.T, 1)
        n = np.bincount(owner, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, lifted)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    index.centroids = centroids
    owner = index.sample_lists = index.nearest_lists(lifted, 1)[:, 0]
    test = rng.choice(len(sample), min(256, len(sample)), replace=False)
    scores = sample[test] @ sample.T
    scores[np.arange(len(test)), test] = -np.inf
    near = np.argsort(-scores, 1)[:, : min(k, len(sample) - 1)]
    if near.shape[1]:
        order = index.nearest_lists(index.lift(sample[test], True), lists)
        rank = np.argsort(order, 1)
        needed = np.sort(np.take_along_axis(rank, owner[near], 1).ravel())
        index.probes = min(lists, int(needed[min(len(needed) - 1, int(np.ceil(target_recall * len(needed))) - 1)]) + 1)
    return index


def scan(queries: np.ndarray, vectors: np.ndarray, limit2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) whose distance the tests cannot put beyond the
    queries' squared limits, by column blocks."""
    d = vectors.shape[1]
    found = [], []
    for lo in range(0, len(vectors), 1024):
        part = vectors[lo: lo + 1024]
        dist, done = np.zeros((len(queries), len(part))), 0
        alive = np.ones(dist.shape, bool)
        while done < d and alive.mean() > 0.2:  # most are alive: whole blocks by one product
            x, y = queries[:, done: done + BLOCK], part[:, done: done + BLOCK]
            dist += (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
            done = min(done + BLOCK, d)
            alive &= _keep(dist, done, d, limit2[:, None])
        q, v = np.nonzero(alive)
        dist = dist[q, v]
        while done < d and len(q):
            step = slice(done, done + BLOCK)
            diff = queries[q, step] - part[v, step]
            dist = dist + (diff * diff).sum(1)
            done = min(done + BLOCK, d)
            keep = _keep(dist, done, d, limit2[q])
            q, v, dist = q[keep], v[keep], dist[keep]
        found[0].append(q)
        found[1].append(v + lo)
    return np.concatenate(found[0]), np.concatenate(found[1])


def _keep(dist, done, d, limit2):
    if done >= d:
        return dist <= limit2 * (1 + 1e-9) + 1e-9
    return dist * (d / done) <= limit2 * (1 + EPSILON / done ** 0.5) ** 2 + 1e-9


def search(rows: DataFrame, is_query: Column, k: int = 20, target_recall: float = 0.97, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products
    found for every row that ``is_query``, its own row excluded."""
    spark = rows.sparkSession
    staged = Staged(spark)
    marked = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"))
    vectors = staged.write(usable_vectors(marked, "vec_id", "embedding"))
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    fitted = fit(vectors, k, target_recall)
    if fitted is None:
        return spark.createDataFrame([], schema)
    index = spark.sparkContext.broadcast(fitted)
    lists = len(fitted.centroids)

    def matrix(column):
        return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.zeros((0, fitted.rotation.shape[0] - 1))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                owner = index.value.nearest_lists(index.value.lift(matrix(batch.column(1)), False), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int32)), *batch.columns], names=["list", "vec_id", "vec"])

    def probe(batches):
        ix = index.value
        sizes = np.bincount(ix.sample_lists, minlength=lists)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x, ids = matrix(part.column(1)), part.column(0).to_numpy()
                places = ix.nearest_lists(ix.lift(x, True), lists)
                # more lists where the nearest hold few rows
                held = np.cumsum(sizes[places], 1)
                enough = (held < min(8 * k, len(ix.sample))).sum(1) + 1
                probed = np.arange(lists)[None, :] < np.maximum(ix.probes, enough)[:, None]
                inside = np.zeros((len(x), lists), bool)
                np.put_along_axis(inside, places, probed, 1)
                own = ids[:, None] == ix.sample_ids[None, :]
                scores = np.where(own | ~inside[:, ix.sample_lists], -np.inf, x @ ix.sample.T)
                # twice k rows of the probed lists score at least this much
                bound = np.partition(scores, -2 * k, 1)[:, -2 * k] if scores.shape[1] > 2 * k else np.full(len(x), -np.inf)
                who, rank = np.nonzero(probed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places[who, rank].astype(np.int32)), part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who)),
                     pa.array(bound[who])], names=["list", "query_id", "vec", "bound"])

    listed = staged.write(vectors.mapInArrow(assign, "list int, vec_id bigint, vec array<double>"))
    asked = staged.write(vectors.where(is_query).mapInArrow(probe, "list int, query_id bigint, vec array<double>, bound double"))
    # one count per list: a long list or a much asked one is cut into tiles
    n_vec = {r.list: r.n for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    n_ask = {r.list: r.n for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts = lambda counts, size: F.array(*[F.lit(max(1, -(-counts.get(i, 0) // size))) for i in range(lists)])
    v_parts, q_parts = F.get(parts(n_vec, TILE_VECTORS), F.col("list")), F.get(parts(n_ask, TILE_QUERIES), F.col("list"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = listed.withColumn("vp", F.pmod(F.xxhash64("vec_id"), v_parts).cast("int")).withColumn("qp", upto(q_parts))
    right = asked.withColumn("qp", F.pmod(F.xxhash64("query_id"), q_parts).cast("int")).withColumn("vp", upto(v_parts))

    def tile(key, a, b):
        ix = index.value
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not a.num_rows or not b.num_rows:
            return empty
        vec, ids = matrix(a.column("vec").combine_chunks()), a.column("vec_id").to_numpy()
        ask, who, bound = matrix(b.column("vec").combine_chunks()), b.column("query_id").to_numpy(), b.column("bound").to_numpy()
        limit2 = (ask * ask).sum(1) + ix.radius2 - 2 * bound
        q, v = scan(ix.lift(ask, True), ix.lift(vec, False), limit2)
        other = who[q] != ids[v]
        q, v = q[other], v[other]
        score = np.zeros(len(q))
        for at in range(0, len(q), 50_000):
            s = slice(at, at + 50_000)
            score[s] = np.einsum("ij,ij->i", ask[q[s]], vec[v[s]])
        order = np.lexsort((ids[v], -score, q))
        q, v, score = q[order], v[order], score[order]
        first = np.searchsorted(q, q, "left")
        best = np.arange(len(q)) - first < k
        return pa.table({"query_id": who[q[best]], "vec_id": ids[v[best]], "score": score[best]})

    found = (left.groupBy("list", "vp", "qp").cogroup(right.groupBy("list", "vp", "qp"))
             .applyInArrow(tile, "query_id bigint, vec_id bigint, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
