"""Centroid clustering with equal-average equal-variance search (operator 13).

Vectors become integers, ``floor(scale * x)`` of each component, and everything that
decides is computed in integers, so the result depends on neither order nor machine.
The first centroids are the ``k`` vectors with the smallest hash of their id. Each
round assigns every vector to its nearest centroid (squared Euclidean distance; ties:
the smaller number) and replaces each non-empty centroid by its vectors'
componentwise ``floor(sum / count)``.

*Search.* Centroids are sorted by their component sum (their mean, times the
dimension ``d``). For a vector with sum ``S`` and ``W² = d * sum(x²) - S²`` (its
variance, scaled alike) against a centroid's, ``d * distance`` is at least
``(S - S_c)² + (W - W_c)²``. The scan starts at the vector's place in the order and
goes outward on both sides: a side ends once its mean alone exceeds the best distance
(all further ones do, too), a centroid is passed over when mean and deviation
together exceed it, and only those left are computed, exactly. Both inequalities are
compared in doubles, with a margin that lets more through, never less. All vectors of
a batch take a step of the scan at once.

A round is one pass over the stored integer vectors, and moves one row of sums per
task and centroid. The driver sees the centroids (``k`` times ``d`` numbers). A
vector that a third of all rows share is no hot key: nothing is grouped by vector.

Defined results: vectors that are null, have another number of components, or hold a
null, NaN or infinite one are left out; null ids hash as the empty string; equal ids
are rows of their own, in the order of their components; with fewer than ``k`` vectors
each begins a centroid; among equal centroids the smaller number takes the vectors;
an empty table gives no rows; other columns are ignored. A component whose integer
exceeds ``LARGEST`` in magnitude has distances beyond 64 bits and raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanrisk.llm.common import written

K, DIMENSIONS, ROUNDS, SCALE, SEED = 40, 64, 5, 256, 2
#: Largest magnitude of an integer component: 64 squares of twice it fit 63 bits.
LARGEST = 1 << 27
#: Vectors that are searched at once in a task.
STEP_ROWS = 4096
#: Relative margin of comparisons in doubles.
MARGIN = 1e-9


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS,
             scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: the vectors that are kept, in integers."""
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x * scale))
    fits = F.forall(vector, lambda x: F.abs(x * scale) <= LARGEST)
    return (df.filter(vector.isNotNull() & (F.size(vector) == dimensions) & ~bad)
            .select(F.col(id_col).alias("vec_id"),
                    F.when(fits, whole.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST}"))).alias("v")))


def first_centroids(vectors: DataFrame, k: int, dimensions: int, seed: int) -> np.ndarray:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select("v", F.sha2(name, 256).alias("h")).orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), dimensions)


class Centroids:
    """Centroids sorted by component sum, for the search."""

    def __init__(self, centroids: np.ndarray):
        d = centroids.shape[1]
        total = centroids.sum(1)
        self.number = np.argsort(total, kind="stable")  # their numbers, in that order
        self.rows, self.total = centroids[self.number], total[self.number]
        self.deviation = deviations(self.rows, self.total)
        self.d = d

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """``(centroid, squared distance)`` of each vector, and how many distances
        were computed."""
        n, k = len(x), len(self.rows)
        total = x.sum(1)
        deviation = deviations(x, total)
        best, cluster = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        computed = 0
        right = np.searchsorted(self.total, total)
        sides = [(right, 1, np.arange(n)), (right - 1, -1, np.arange(n))]
        while any(len(active) for _, _, active in sides):
            for s, (place, step, active) in enumerate(sides):
                at = place[active]
                inside = (at >= 0) & (at < k)
                active, at = active[inside], at[inside]
                gap = (self.total[at] - total[active]).astype(float) ** 2
                limit = best[active].astype(float) * self.d
                near = gap <= limit * (1 + MARGIN) + 1  # equal average: else the scan of this side ends
                active, at, gap, limit = active[near], at[near], gap[near], limit[near]
                theirs, own = self.deviation[at], deviation[active]
                margin = MARGIN * (limit + theirs ** 2 + own ** 2) + 1
                go = gap + (theirs - own) ** 2 <= limit + margin  # equal variance
                row, c = active[go], at[go]
                if len(row):
                    diff = x[row] - self.rows[c]
                    distance, number = np.einsum("ij,ij->i", diff, diff), self.number[c]
                    computed += len(row)
                    better = (distance < best[row]) | ((distance == best[row]) & (number < cluster[row]))
                    best[row[better]], cluster[row[better]] = distance[better], number[better]
                place[active] += step
                sides[s] = place, step, active
        return cluster, best, computed


def deviations(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``sqrt(d * sum(x²) - sum(x)²)`` of each row, in doubles."""
    squares = np.einsum("ij,ij->i", x, x).astype(float)
    return np.sqrt(np.maximum(squares * x.shape[1] - total.astype(float) ** 2, 0.0))


def _vectors(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for k in range(0, batch.num_rows, STEP_ROWS):
        part = batch.slice(k, STEP_ROWS)
        yield part, part["v"].flatten().to_numpy().astype(np.int64).reshape(-1, dimensions)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, place, total, n``: over each cluster's vectors, the sum of each
    component; summed in each task before anything moves."""
    dimensions = centroids.shape[1]
    names = ["cluster", "n", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, n, total = Centroids(centroids), np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, x in _vectors(batch, dimensions):
                cluster, _, _ = search.nearest(x)
                n += np.bincount(cluster, minlength=len(n))
                np.add.at(total, cluster, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]),
                                          pa.array(list(total[some]), pa.list_(pa.int64()))], names)

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, total array<long>")
    return (parts.select("cluster", "n", F.posexplode("total").alias("place", "part"))
            .groupBy("cluster", "place").agg(F.sum("part").alias("total"), F.sum("n").alias("n")))


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round; those without vectors stay."""
    out = centroids.copy()
    # k * d rows; Python's // on the whole numbers is the floor
    for r in cluster_sums(vectors, centroids).collect():
        out[r["cluster"], r["place"]] = r["total"] // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of all vectors."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids)
        for batch in batches:
            for part, x in _vectors(batch, dimensions):
                cluster, distance, _ = search.nearest(x)
                yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                                 ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance long")


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, dimensions: int = DIMENSIONS,
            rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """A row per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256`` and ``centroid`` (array)."""
    spark = df.sparkSession
    vectors = written(integers(df, id_col, vector_col, dimensions, scale), "centroid-vectors")
    centroids = first_centroids(vectors, k, dimensions, seed)
    if not len(centroids):
        centroids = np.zeros((1, dimensions), np.int64)  # nobody's
    else:
        for _ in range(rounds):
            centroids = moved(vectors, centroids)
    out = written(assigned(vectors, centroids), "centroid-assigned")
    named = spark.createDataFrame([(i, c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in
                                   enumerate(centroids.tolist())], "c int, centroid array<long>, centroid_sha256 string")
    sums = out.groupBy(F.col("cluster").alias("c")).agg(F.sum("distance").alias("cluster_inertia"))
    # a row a cluster: its sum, and the sum over all of them
    both = named.join(sums, "c").withColumn("inertia", F.expr("sum(cluster_inertia) OVER ()"))
    return (out.join(F.broadcast(both), out["cluster"] == both["c"])
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"))
