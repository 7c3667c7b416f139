"""Clustering around centroids with Hamerly's bounds, in whole numbers.

Each vector keeps, from round to round, an upper bound of its distance to its own centroid and a lower bound of its
distance to the nearest other one. When centroids have moved, the upper bound grows by the drift of its own centroid and the lower
one shrinks by the largest drift of the others. As long as the upper bound stays below the lower one, or below half
the distance from its centroid to the nearest other centroid, the vector's centroid is certain and nothing is computed. Else
the upper bound is made exact; a vector that is still ambiguous gets a full scan of all centroids. Scans and exact distances are
whole numbers, ties included; the bounds are doubles, widened by more than their rounding, and only strict comparisons decide.

The state is a table: one narrow pass a round reads the last one and writes the next, and an aggregation of the written
table gives sums and counts of each cluster. Only k rows come to the driver, and only k centroids go to the tasks. A vector that many rows
share, or a cluster with most rows, is summed before the shuffle.

Edge cases: vectors that are null, have another number of components, or a null, NaN or infinite one are left out, and so are those with a
component of 2^19 or more, whose squared distances don't fit a long; a null id is kept, but begins no cluster; rows that repeat
count each; with fewer vectors than centroids each begins one; equal centroids stay apart, and the smaller number gets the vectors; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, saved, table
from ledgerloom.llm.vectors import matrix, squared_distances, usable, whole

#: Bounds are widened by this part of themselves, thousands of times their rounding.
SLACK = 1e-12


def kept_vectors(rows: DataFrame, dims: int) -> DataFrame:
    """``vec_id, v`` of the rows whose ``embedding`` takes part."""
    fits = (F.size("embedding") == dims) & usable(F.col("embedding"))
    return rows.where(fits).select("vec_id", whole(F.col("embedding")).alias("v"))


def by_hash(salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in order; of equal ids by their components."""
    chosen = kept.where("vec_id is not null").select(by_hash(salt).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in chosen], np.int64)


class Round:
    """What a task needs to assign vectors: the centroids, how far each has moved, and half its distance to the nearest other."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids, self.first = centroids, before is None
        apart = np.sqrt(squared_distances(centroids, centroids).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2 * (1 - SLACK)
        self.drift = np.zeros(len(centroids)) if self.first else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        order = np.argsort(self.drift)
        self.others_drift = np.where(np.arange(len(centroids)) == order[-1], self.drift[order[-2]] if len(order) > 1 else 0.0, self.drift[order[-1]])

    def own_distances(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((x - self.centroids[cluster]) ** 2).sum(axis=1)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (of equal ones the first), the upper and the lower bound, from exact distances to all."""
        all_ = squared_distances(x, self.centroids)
        nearest = all_.argmin(axis=1)
        at = np.arange(len(x))
        own = np.sqrt(all_[at, nearest].astype(np.float64)) * (1 + SLACK)
        if all_.shape[1] == 1:
            return nearest, own, np.full(len(x), np.inf)
        all_[at, nearest] = np.iinfo(np.int64).max
        return nearest, own, np.sqrt(all_.min(axis=1).astype(np.float64)) * (1 - SLACK)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, bounds, and which vectors were scanned."""
        if self.first:
            return *self.scan(x), np.ones(len(x), bool)
        cluster = cluster.copy()
        upper = (upper + self.drift[cluster]) * (1 + SLACK)
        lower = (lower - self.others_drift[cluster]) * np.where(lower > self.others_drift[cluster], 1 - SLACK, 1 + SLACK)
        bound = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(upper >= bound)
        upper[open_] = np.sqrt(self.own_distances(x[open_], cluster[open_]).astype(np.float64)) * (1 + SLACK)
        open_ = open_[upper[open_] >= bound[open_]]
        cluster[open_], upper[open_], lower[open_] = self.scan(x[open_])
        scanned = np.zeros(len(x), bool)
        scanned[open_] = True
        return cluster, upper, lower, scanned


def assigned(state: DataFrame, now: Round, *, distances: bool = False) -> DataFrame:
    """The next state: ``vec_id, v, cluster, upper, lower, scanned``; with ``distances`` the exact squared distance instead of the bounds."""
    dims = now.centroids.shape[1]
    of_id = f"vec_id {state.schema['vec_id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            old = [None] * 3 if now.first else [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4)]
            cluster, upper, lower, scanned = now.assign(x, *old)
            out = [batch.column(0), pa.array(cluster, pa.int32())]
            if distances:
                yield pa.RecordBatch.from_arrays([*out, pa.array(now.own_distances(x, cluster), pa.int64())], names=["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out[1], pa.array(upper), pa.array(lower), pa.array(scanned)], names=["vec_id", "v", "cluster", "upper", "lower", "scanned"])

    columns = ["vec_id", "v"] if now.first else ["vec_id", "v", "cluster", "upper", "lower"]
    return map_batches(state.select(columns), run, f"{of_id}, cluster int, distance long" if distances else f"{of_id}, v array<int>, cluster int, upper double, lower double, scanned boolean")


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; clusters without vectors keep their centroids."""
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[k].cast("long")).alias(f"s{k}") for k in range(centroids.shape[1])]).collect()  # one row a centroid
    out = centroids.copy()
    for row in sums:
        out[row.cluster] = [s // row.n for s in row[2:]]
    return out


def cluster_vectors(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` (squared) of each vector of ``rows`` (vec_id, embedding) that takes part, and the final centroids."""
    kept = kept_vectors(rows, dims)
    centroids = first_centroids(kept, k, salt)
    if not len(centroids):
        return kept.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).limit(0), np.zeros((0, dims), np.int64)
    state, before = kept, None
    for _ in range(rounds):
        state = saved(assigned(state, Round(centroids, before)), "clusters")
        before, centroids = centroids, moved(state, centroids)
    return saved(assigned(state, Round(centroids, before), distances=True), "clustered"), centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("s")).collect()}  # one row a centroid
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of_cluster = spark.createDataFrame([(c, s, sum(sums.values()), names[c]) for c, s in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
