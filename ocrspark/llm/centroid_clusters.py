"""Clusters of vectors around centroids: exact assignment by progressive search of transformed vectors.

Vectors become whole numbers and are put through a Walsh-Hadamard transform once, its rows ordered
by their number of sign changes. The transform keeps squared distances up to the factor of its
size, so the squared differences of the coefficients, added up from coarse to fine, are lower
bounds of the distance, and what is left of both vectors' energy bounds the rest from both sides.
After each stretch of coefficients a centroid whose lower bound exceeds the least upper bound is
strictly worse and drops out; those that stay finish all coefficients, so distances and ties are
exact. All of it is integer arithmetic.

The transformed vectors are written once and read once a round. A round sends back one row per
centroid and task, which Spark adds up: the driver holds the centroids and nothing that grows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ocrspark.llm import whole_vectors
from ocrspark.llm.common import session, stored

#: Ends of the stretches of coefficients, as shares of all, after which centroids drop out.
STRETCHES = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1)
#: Coefficients below this stay exact in 64 bits through squares, sums and bounds of 64 of them.
SAFE = 1 << 26


@dataclass
class Clusters:
    """Final centroids as whole numbers, and ``assigned`` rows ``(id, cluster, distance)``."""

    centroids: list[list[int]]
    assigned: DataFrame


def transform(dim: int) -> np.ndarray:
    """Walsh-Hadamard matrix, rows from few sign changes to many."""
    if dim < 1 or dim & (dim - 1):
        raise ValueError("vectors must have a power of two of components")
    h = np.ones((1, 1), np.int64)
    while len(h) < dim:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


def _roots(energy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers at or below and at or above the square roots."""
    if energy.dtype == object:
        low = np.array([math.isqrt(int(v)) for v in energy.ravel()], object).reshape(energy.shape)
        return low, low + 1
    near = np.sqrt(energy.astype(np.float64)).astype(np.int64)
    return np.maximum(near - 1, 0), near + 2


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each transformed vector, its squared distance, and coefficients compared.

    Of equally near centroids the first wins.
    """
    n, dim = x.shape
    x, centres = whole_vectors.exact(x, SAFE), whole_vectors.exact(centres, SAFE)
    kind = object if object in (x.dtype, centres.dtype) else np.int64
    so_far = np.zeros((n, len(centres)), kind)
    alive = np.ones(so_far.shape, bool)
    left_x, left_c = (x * x).sum(axis=1), (centres * centres).sum(axis=1)
    start = compared = 0
    for share in STRETCHES:
        end = max(start + 1, round(dim * share))
        if end > dim:
            break
        i, j = np.nonzero(alive)
        step = x[i, start:end] - centres[j, start:end]
        so_far[i, j] += (step * step).sum(axis=1)
        compared += step.size
        left_x = left_x - (x[:, start:end] ** 2).sum(axis=1)
        left_c = left_c - (centres[:, start:end] ** 2).sum(axis=1)
        start = end
        if end < dim:
            (low_x, high_x), (low_c, high_c) = _roots(left_x[:, None]), _roots(left_c[None])
            gap = np.maximum(np.maximum(low_x - high_c, low_c - high_x), 0)
            most = np.where(alive, so_far + (high_x + high_c) ** 2, np.iinfo(np.int64).max if kind is np.int64 else math.inf)
            alive &= so_far + gap * gap <= most.min(axis=1)[:, None]
    best = np.where(alive, so_far, np.iinfo(np.int64).max if kind is np.int64 else math.inf)
    chosen = np.array([min(range(len(row)), key=row.__getitem__) for row in best], np.int64) if kind is object else best.argmin(axis=1)
    return chosen, best[np.arange(n), chosen] // dim, compared


def _transformed(batches, dim: int, scale: int):
    h = transform(dim)
    for batch in batches:
        for rows, whole in whole_vectors.scaled(batch.column(1), scale):
            if whole.shape[1] == dim:
                coefficients = whole_vectors.exact(whole, SAFE) @ h.T
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), whole_vectors.lists(coefficients)], ["id", "x"]
                )


def _sums(batches, centres: np.ndarray, most: int):
    """Rows and sums of coefficients of each cluster, one row per cluster and task."""
    dim = centres.shape[1]
    rows, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape, object)
    for batch in batches:
        x = whole_vectors.matrix(batch.column(0), dim)
        for s in range(0, len(x), most):
            part = x[s : s + most]
            chosen = nearest(part, centres)[0]
            part = whole_vectors.exact(part, 1 << 40)
            for c in np.unique(chosen).tolist():
                rows[c] += (chosen == c).sum()
                sums[c] += part[chosen == c].sum(axis=0).astype(object)
    used = np.flatnonzero(rows).tolist()
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(used, pa.int32()), pa.array(rows[used], pa.int64()),
            pa.array([[Decimal(int(v)) for v in sums[c]] for c in used], pa.list_(pa.decimal128(38, 0))),
        ], ["cluster", "n", "sums"],
    )


def _labels(batches, centres: np.ndarray, most: int):
    dim = centres.shape[1]
    for batch in batches:
        x = whole_vectors.matrix(batch.column(1), dim)
        for s in range(0, len(x), most):
            chosen, distance, _ = nearest(x[s : s + most], centres)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(s, most), pa.array(chosen.astype(np.int32)), pa.array(distance.tolist(), pa.int64())],
                ["id", "cluster", "distance"],
            )


def cluster(
    df: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3,
    id_col: str = "vec_id", vec_col: str = "embedding", most: int = 2048,
) -> Clusters:
    """Clusters of the vectors of ``df`` with exactly ``dim`` components, a power of two.

    A component x counts as ``floor(scale * x)``. Centroids start as the vectors whose ids have the
    smallest SHA-256 of ``seed:id``; in each round every vector goes to its nearest centroid (of
    equally near ones to the first), and every centroid with vectors becomes the floor of their
    mean. A centroid without vectors stays. ``assigned`` has the ids under ``id_col``.

    - Vectors that are null, of another length (empty ones too) or hold null or non-finite
      components are left out, so their rows are not in the result.
    - Every row is a vector of its own, repeated rows too; of rows that share an id the one with
      the smaller components starts first. A null id is hashed as ``seed:``.
    - With fewer than ``k`` vectors there are fewer centroids; an empty table gives an empty result.
    - A component of 2**53 or more after scaling, or a distance beyond 64 bits, is an error.
    - Other columns are ignored, so their names cannot clash.
    """
    session(df.sparkSession)
    vectors = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    kind = vectors.schema["id"].dataType.simpleString()
    x = stored(vectors.mapInArrow(partial(_transformed, dim=dim, scale=scale), f"id {kind}, x array<bigint>"), "transformed")
    h = transform(dim)
    # the transform times its transpose is dim times the identity, so whole vectors come back exactly
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = x.orderBy(F.sha2(named.cast("binary"), 256), "x").limit(k).collect()
    centroids = [[int(v) // dim for v in np.array(r.x, object) @ h] for r in first]

    def coefficients() -> np.ndarray:
        c = np.array(centroids, object).reshape(-1, dim) @ h.T
        return c.astype(np.int64)

    for _ in range(rounds if centroids else 0):
        partial_sums = x.select("x").mapInArrow(
            partial(_sums, centres=coefficients(), most=most), "cluster int, n bigint, sums array<decimal(38,0)>"
        )
        totals = partial_sums.groupBy("cluster").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums")
        ).collect()
        for r in totals:
            sums = np.array([int(v) for v in r.sums], object) @ h
            centroids[r.cluster] = [int(v) // dim // r.n for v in sums]
    schema = f"id {kind}, cluster int, distance bigint"
    labelled = x.limit(0).selectExpr("id", "0 as cluster", "0L as distance") if not centroids else x.mapInArrow(
        partial(_labels, centres=coefficients(), most=most), schema
    )
    return Clusters(centroids, stored(labelled, "assigned").withColumnRenamed("id", id_col))


def inertia(clusters: Clusters) -> DataFrame:
    """``assigned`` with the summed distances of each row's cluster and of all rows."""
    sums = clusters.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    spark = clusters.assigned.sparkSession
    total = sum(int(r.s) for r in sums)
    table = spark.createDataFrame([(r.cluster, int(r.s), total) for r in sums], "cluster int, cluster_inertia long, inertia long")
    # one row per centroid, so the side that is sent to all tasks is bounded by k
    return clusters.assigned.join(F.broadcast(table), "cluster")
