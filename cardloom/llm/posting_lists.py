"""Approximate nearest neighbours by largest inner product over balanced posting lists.

Inner products become distances by one more component that gives every vector the same norm. Lists
are the cells of a k-means whose assignment charges a list for its size. A vector lies in every list
about as near as its nearest, up to REPLICAS of them. A query walks a graph over the centroids and
searches its FEWEST_LISTS nearest lists and all others whose centroid is at most a ratio farther than
the last of these; there the true inner products are taken, in double precision. The ratio is the
least of RATIOS whose recall, against an exact search for a sample of the queries, is high enough
with the lists at hand. A query that finds too few rows searches all lists.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import ready, written
from cardloom.llm.vectors import matrix, vector_rows

# The index is fitted on a sample of at most so many vectors and has at most so many lists; longer
# lists are searched in slices of about SLICE vectors. Every vector is indexed.
SAMPLE = 20_000
MOST_LISTS = 512
LIST = 1000
SLICE = 8192
REPLICAS = 4
# How much farther than the nearest centroid, for a list to hold a vector.
REPLICA_RATIO = 1.25
# How much farther than the last of the FEWEST_LISTS nearest centroids, for a list to be searched; the last means all lists.
RATIOS = (1.0, 1.02, 1.04, 1.06, 1.08, 1.1, 1.13, 1.17, 1.22, 1.3, 1.5, float("inf"))
FEWEST_LISTS = 4
# The ratio is chosen by MEASURED queries: their mean recall less two standard errors is at least GOAL.
MEASURED = 200
GOAL = 0.95
NEIGHBOURS = 16


class Index(NamedTuple):
    centroids: np.ndarray
    graph: np.ndarray
    norm: float
    ratio: float


def balanced_centroids(points: np.ndarray, lists: int, rounds: int = 8, charge: float = 0.05) -> np.ndarray:
    """k-means in which a list's size is part of its distance; empty lists take the farthest points."""
    rng = np.random.default_rng(7)
    centres = points[rng.permutation(len(points))[:lists]].copy()
    size = np.zeros(lists)
    for _ in range(rounds):
        far = (centres**2).sum(axis=1) - 2 * points @ centres.T
        own = (far + charge * size / (len(points) / lists)).argmin(axis=1)
        size = np.bincount(own, minlength=lists).astype(float)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        held = size > 0
        centres[held] = sums[held] / size[held, None]
        if not held.all():
            worst = np.argsort(-far[np.arange(len(points)), own])[: (~held).sum()]
            centres[~held] = points[worst]
    return centres


def centroid_graph(centres: np.ndarray) -> np.ndarray:
    """Each centroid's nearest others, and a ring through all of them so that every one can be reached."""
    k = len(centres)
    gaps = ((centres[:, None] - centres[None]) ** 2).sum(axis=2) if k <= 64 else (centres**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * centres @ centres.T
    near = np.argsort(gaps, axis=1)[:, 1 : NEIGHBOURS + 1]
    ring = ((np.arange(k) + 1) % k)[:, None]
    return np.concatenate([near, ring], axis=1)


def search_lists(index: Index, query: np.ndarray) -> list[int]:
    """Lists to search: a best-first walk over the graph, then the pruning by distance ratio.

    Distances are compared with that of the last of the nearest lists, as a query may lie on the nearest centroid itself.
    """
    seen = {0}
    dist = {0: float(np.linalg.norm(index.centroids[0] - query))}
    heap, near = [(dist[0], 0)], [dist[0]]
    while heap:
        d, at = heapq.heappop(heap)
        if d > 1.1 * index.ratio * near[-1] and len(seen) >= 4 * FEWEST_LISTS:
            break
        fresh = [int(x) for x in index.graph[at] if x not in seen]
        if not fresh:
            continue
        fresh = list(dict.fromkeys(fresh))
        seen.update(fresh)
        gaps = np.linalg.norm(index.centroids[fresh] - query, axis=1).tolist()
        for x, gap in zip(fresh, gaps):
            dist[x] = gap
            heapq.heappush(heap, (gap, x))
        near = sorted([*near, *gaps])[:FEWEST_LISTS]
    order = sorted(dist, key=dist.get)
    return [x for n, x in enumerate(order) if n < FEWEST_LISTS or dist[x] <= index.ratio * near[-1]]


def own_lists(index: Index, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): the lists that hold each of the lifted points."""
    gaps = (index.centroids**2).sum(axis=1) - 2 * points @ index.centroids.T + (points**2).sum(axis=1)[:, None]
    own = np.argsort(gaps, axis=1)[:, :REPLICAS]
    near = np.take_along_axis(gaps, own, 1)
    row, place = np.nonzero(near <= np.maximum(near[:, :1], 0) * REPLICA_RATIO**2 + 1e-12)
    return row, own[row, place]


def least_ratio(index: Index, queries: np.ndarray, owner: np.ndarray, nearest: np.ndarray) -> float:
    """The least ratio with which the `queries` find enough of their true `nearest`, of which `owner` says whose each is."""
    row, held = own_lists(index, _lifted(nearest, index.norm))
    for ratio in RATIOS:
        searched = np.zeros((len(queries), len(index.centroids)), bool)
        for n, query in enumerate(queries):
            searched[n, search_lists(index._replace(ratio=ratio), np.append(query, 0.0))] = True
        hit = np.zeros(len(nearest), bool)
        np.logical_or.at(hit, row, searched[owner[row], held])
        asked = np.bincount(owner, minlength=len(queries))
        recall = np.bincount(owner, weights=hit, minlength=len(queries))[asked > 0] / asked[asked > 0]
        if not len(recall) or recall.mean() - 2 * recall.std() / len(recall) ** 0.5 >= GOAL:
            return ratio
    return RATIOS[-1]


def _lifted(points: np.ndarray, norm: float) -> np.ndarray:
    """Points of one common norm whose distances to (query, 0) order as the inner products do."""
    rest = np.sqrt(np.maximum(norm**2 - (points**2).sum(axis=1), 0.0))
    return np.concatenate([points, rest[:, None]], axis=1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, ties to the smaller vec_id.

    Queries are the rows for which `is_query` holds; candidates are all rows but those with the
    query's own id. NULL ids and vectors that are NULL, empty, zero or hold NULL or non-finite
    components take no part; nor do vectors of another length than the commonest (the shorter of
    equally common ones). Rows that share an id count once, by their best score. An empty table, or
    one without queries, gives no rows; other columns play no part.
    """
    spark = ready(vectors.sparkSession)
    out = "query_id long, vec_id long, score double"
    flagged = vectors.withColumn("__query__", F.coalesce(is_query, F.lit(False)))
    kept = vector_rows(flagged, id_col, vector_col).filter("vec_id IS NOT NULL")
    queries_of = vector_rows(flagged.filter("__query__"), id_col, vector_col).filter("vec_id IS NOT NULL")
    common = kept.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = common
    rows = kept.filter(F.size("v") == dim)
    norm = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] ** 0.5
    lists = max(1, min(MOST_LISTS, total // LIST))
    sample = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    centres = balanced_centroids(_lifted(np.array(sample.v.tolist()), norm), lists)
    index = Index(centres, centroid_graph(centres), norm, RATIOS[-1])
    asking = queries_of.filter(F.size("v") == dim)

    # The true nearest of a bounded sample of the queries, each task's best first.
    picked = asking.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).toPandas() if lists > FEWEST_LISTS else []
    if len(picked):
        measured = spark.sparkContext.broadcast((picked.vec_id.to_numpy(), np.array(picked.v.tolist())))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, q = measured.value
            scores, ids, found = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64), np.zeros((len(q), k, dim))
            for batch in batches:
                x, fresh = matrix(batch.column(1)), batch.column(0).to_numpy()
                if not len(x):
                    continue
                near = q @ x.T
                near[own[:, None] == fresh] = -np.inf
                top = np.argpartition(-near, k - 1, axis=1)[:, :k] if len(x) > k else np.tile(np.arange(len(x)), (len(q), 1))
                scores = np.concatenate([scores, np.take_along_axis(near, top, 1)], axis=1)
                ids, found = np.concatenate([ids, fresh[top]], axis=1), np.concatenate([found, x[top]], axis=1)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                scores, ids = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)
                found = np.take_along_axis(found, best[:, :, None], 1)
            row, place = np.nonzero(np.isfinite(scores))
            vectors = pa.array(found[row, place].tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(ids[row, place]), pa.array(scores[row, place]), vectors], ["n", "vec_id", "score", "v"])

        tops = rows.mapInArrow(measure, "n int, vec_id long, score double, v array<double>")
        tops = tops.groupBy("n", "vec_id").agg(F.max("score").alias("score"), F.max_by("v", "score").alias("v"))
        tops = tops.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "vec_id")))
        true = tops.filter(F.col("rank") <= k).select("n", "v").toPandas()  # k of each measured query
        if len(true):
            index = index._replace(ratio=least_ratio(index, np.array(picked.v.tolist()), true.n.to_numpy(), np.array(true.v.tolist())))
    shared = spark.sparkContext.broadcast(index)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            points = _lifted(matrix(batch.column(1)), index.norm)
            if not len(points):
                continue
            row, held = own_lists(index, points)
            again = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *again.columns], ["list", "vec_id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            points = matrix(batch.column(1))
            found = [search_lists(index, np.append(x, 0.0)) for x in points]
            row = np.repeat(np.arange(len(points)), [len(x) for x in found])
            flat = pa.array([y for x in found for y in x], pa.int32())
            again = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([flat, *again.columns], ["list", "vec_id", "v"])

    schema = "list int, vec_id long, v array<double>"
    postings = written(rows.mapInArrow(post, schema), "postings")
    sizes = postings.groupBy("list").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))  # one row for each list at most
    sizes = spark.createDataFrame([tuple(r) for r in sizes.collect()], "list int, slices int")
    left = postings.join(F.broadcast(sizes), "list").withColumn("slice", F.expr("cast(pmod(xxhash64(vec_id), slices) as int)")).drop("slices")

    def score(_: tuple, base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, ids = np.array(base.v.tolist()), base.vec_id.to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(asked), 256):
            part = asked.iloc[at : at + 256]
            q = np.array(part.v.tolist())
            near = q @ x.T
            for i, query in enumerate(part.vec_id.to_numpy()):
                near[i, ids == query] = -np.inf
                line = near[i]
                least = np.partition(line, -k)[-k] if len(line) > k else -np.inf
                pick = np.flatnonzero((line >= least - 1e-9) & np.isfinite(line))
                # One fixed order of addition, so that equal vectors have equal scores everywhere.
                exact = (q[i] * x[pick]).sum(axis=1)
                best = np.lexsort((ids[pick], -exact))[:k]
                found.append((np.full(len(best), query), ids[pick][best], exact[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def searched(probes: DataFrame) -> DataFrame:
        right = probes.join(F.broadcast(sizes), "list").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        scored = left.groupBy("list", "slice").cogroup(right.groupBy("list", "slice")).applyInPandas(score, out)
        once = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = searched(asking.mapInArrow(probe, schema))
    if lists <= FEWEST_LISTS:
        return first
    # Queries of fewer than k rows search all lists.
    first = written(first, "nearest-first")
    full = first.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = written(asking.join(full, "vec_id", "left_anti"), "nearest-short")
    if short.isEmpty():
        return first
    every = short.select(F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list"), "vec_id", "v")
    return first.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").select(*first.columns).unionByName(searched(every))
