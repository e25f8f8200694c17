"""Exact search for the largest inner products by a pivot-distance index.

One more component turns the largest inner product into the least distance: with M the greatest
norm, x gets sqrt(M^2 - |x|^2) and a query q gets 0, so their squared distance is
|q|^2 + M^2 - 2 q.x. Vectors are keyed by their nearest pivot and by the ring of the distance to
it. The triangle inequality bounds the distance of a query to every vector of a ring from the
ring's least and greatest distance to the pivot alone. A query takes rings in the order of that
bound, four times as many in each round, and stops when the bound of the next ring exceeds the
distance of its k-th best vector so far. Scores are exact integers; the bounds only leave rings
out, with a margin for rounding.

Equal vectors are one row of the index with their smallest ids, so copies cost nothing. A ring of
many vectors and the queries that want it are dealt into blocks of bounded bytes, and each pair of
blocks is one unit of work. The driver holds pivots and one line per ring; both are bounded by
parameters (for each length of vectors).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ocrspark.llm import whole_vectors
from ocrspark.llm.common import session, stored
from ocrspark.llm.groups import by_unit

#: Rows from which pivots and ring edges are chosen, pivots and rings per pivot.
SAMPLE_ROWS, PIVOTS, RINGS = 4096, 32, 8
#: Bytes of vectors and of queries in a unit, and queries compared at once.
BLOCK_BYTES, QUERY_BYTES, AT_ONCE = 2 << 20, 1 << 19, 128
#: Relative margin of distances, above the rounding of their squares.
MARGIN = 1e-7
#: A round takes this many times the rings of the round before.
WIDEN = 4


@dataclass
class Index:
    """Pivots and ring edges of the vectors of one length, and the lines of their rings.

    ``edges`` cut the distances to each pivot into rings. ``cells`` are the rings that hold
    vectors, as pivot and ring, with their least and greatest distance.
    """

    top: int
    pivots: np.ndarray
    edges: np.ndarray
    cells: np.ndarray | None = None
    least: np.ndarray | None = None
    greatest: np.ndarray | None = None


def norms(x: np.ndarray) -> np.ndarray:
    return products(x, None)


def products(a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``, or of each row with itself."""
    other = a if b is None else b
    largest = [int(np.abs(v).max()) if v.size else 0 for v in (a, other)]
    if a.shape[1] * largest[0] * largest[1] < 1 << 53:  # every partial sum is a whole double
        a, other = a.astype(np.float64), other.astype(np.float64)
        out = (a * a).sum(axis=1) if b is None else a @ other.T
        return out.astype(np.int64)
    a, other = a.astype(object), other.astype(object)
    out = (a * a).sum(axis=1) if b is None else a @ other.T
    return np.array(out.ravel().tolist(), np.int64).reshape(out.shape)  # beyond 64 bits this is an error


def _lift(x: np.ndarray, top: int) -> np.ndarray:
    """The added component of stored vectors."""
    return np.sqrt(np.maximum(top - norms(x), 0).astype(np.float64))


def _distances(x: np.ndarray, index: Index, stored_rows: bool) -> np.ndarray:
    """Distances of vectors (or queries) to the pivots."""
    lift = _lift(x, index.top) if stored_rows else np.zeros(len(x))
    flat = x.astype(np.float64)
    own, pivots = (flat * flat).sum(axis=1), index.pivots.astype(np.float64)
    at = _lift(index.pivots, index.top)
    square = own[:, None] + (pivots * pivots).sum(axis=1) - 2 * flat @ pivots.T + (lift[:, None] - at) ** 2
    return np.sqrt(np.maximum(square, 0))


def fit(sample: np.ndarray, top: int, pivots: int = PIVOTS, rings: int = RINGS) -> Index:
    """Pivots far from each other, and edges that cut the sample around each into even rings.

    The first pivot is the zero vector, so there is one also without a sample.
    """
    chosen = np.zeros((1, sample.shape[1]), np.int64)
    index = Index(top, chosen, np.zeros((1, 0)))
    far = _distances(sample, index, True)[:, 0]
    while len(chosen) < pivots and far.size and far.max() > 0:
        new = sample[far.argmax()][None]
        chosen = np.concatenate([chosen, new])
        far = np.minimum(far, _distances(sample, Index(top, new, index.edges), True)[:, 0])
    index.pivots, index.edges = chosen, np.zeros((len(chosen), rings - 1))
    if len(sample):
        d = _distances(sample, index, True)
        own = d.argmin(axis=1)
        for p in range(len(chosen)):
            if (own == p).any():
                index.edges[p] = np.quantile(d[own == p, p], np.arange(1, rings) / rings)
    return index


def _prepared(batches, scale: int):
    for batch in batches:
        for rows, whole in whole_vectors.scaled(batch.column(1), scale):
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), pa.array(np.full(len(rows), whole.shape[1], np.int32)),
                    whole_vectors.lists(whole), pa.array(norms(whole)), batch.column(2).take(at),
                ], ["id", "dim", "vec", "norm", "query"],
            )


def _by_length(batch: pa.RecordBatch):
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = batch.take(pa.array(np.flatnonzero(dims == dim)))
        yield dim, part, whole_vectors.matrix(part.column("vec"), dim)


def _indexed(batches, shared):
    """Vectors with their pivot, the distance to it and the ring."""
    for batch in batches:
        for dim, part, x in _by_length(batch):
            index = shared.value[dim]
            d = _distances(x, index, True)
            pivot = d.argmin(axis=1)
            own = d[np.arange(len(x)), pivot]
            ring = (own[:, None] > index.edges[pivot]).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(pivot.astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(own)],
                [*part.schema.names, "pivot", "ring", "d"],
            )


def _wanted(batches, shared, first: int, last: int | None):
    """The next rings of each query, unless the triangle inequality rules them out."""
    for batch in batches:
        for dim, part, q in _by_length(batch):
            index = shared.value[dim]
            to = _distances(q, index, False)[:, index.cells[:, 0]]
            margin = MARGIN * (1 + np.sqrt(float(index.top)) + np.sqrt(norms(q).astype(np.float64)))[:, None]
            bound = np.maximum(np.maximum(to - index.greatest, index.least - to), 0) - margin
            order = np.argsort(bound, axis=1, kind="stable")[:, first:last]
            kth = part.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN, nothing is ruled out
            reach = norms(q).astype(np.float64) + float(index.top) - 2 * kth
            reach = np.where(np.isnan(reach), np.inf, np.sqrt(np.maximum(reach, 0))) + margin[:, 0]
            chosen = np.take_along_axis(bound, order, 1) <= reach[:, None]
            rows = np.flatnonzero(chosen.any(axis=1))
            rings = [index.cells[order[r][chosen[r]]] for r in rows]
            flat = np.concatenate(rings) if rings else np.zeros((0, 2), int)
            offsets = np.r_[0, np.cumsum([len(r) for r in rings])].astype(np.int32)
            cells = pa.StructArray.from_arrays(
                [pa.array(flat[:, k].astype(np.int32)) for k in (0, 1)], ["pivot", "ring"]
            )
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(c).take(at) for c in ("node", "dim", "vec", "kth")] + [pa.ListArray.from_arrays(pa.array(offsets), cells)],
                ["node", "dim", "vec", "kth", "cells"],
            )


def _single(batches):
    for units in by_unit(batches):
        name = units["unit"].to_numpy()
        starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]).tolist()
        for start, end in zip(starts, [*starts[1:], len(name)]):
            yield units.slice(start, end - start)


def _searched(batches, keep: int):
    """The best rows of every unit for each of its queries."""
    for unit in _single(batches):
        asks = unit["asks"].to_numpy(zero_copy_only=False)
        data, queries = unit.filter(pa.array(~asks)), unit.filter(pa.array(asks))
        if not data.num_rows or not queries.num_rows:
            continue
        dim = data["dim"][0].as_py()
        x, q = whole_vectors.matrix(data["vec"], dim), whole_vectors.matrix(queries["vec"], dim)
        lists = data["ids"].combine_chunks()
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        ids = lists.flatten()
        absent = ids.is_null().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy(zero_copy_only=False)
        first, first_absent = number[ends[:-1]], absent[ends[:-1]]
        nodes = queries["node"].to_numpy()
        kth = queries["kth"].to_numpy()
        kth = np.where(np.isnan(kth.astype(np.float64)), -np.inf, kth.astype(np.float64))
        out_node, out_row, out_score = [], [], []
        for s in range(0, len(q), AT_ONCE):
            scores = products(q[s : s + AT_ONCE], x)
            for k, score in enumerate(scores, s):
                limit = np.partition(score, len(score) - keep)[len(score) - keep] if len(score) > keep else score.min()
                at = np.flatnonzero((score >= limit) & (score >= kth[k]))
                # of equal scores the vectors with the smallest ids, null ids last
                at = at[np.lexsort((first[at], first_absent[at], -score[at]))][:keep]
                for v in at.tolist():
                    rows = np.arange(ends[v], ends[v + 1])
                    out_row.append(rows)
                    out_score.append(np.full(len(rows), score[v]))
                    out_node.append(np.full(len(rows), nodes[k]))
        if out_row:
            rows = np.concatenate(out_row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_node)), pa.array(number[rows], mask=absent[rows]), pa.array(np.concatenate(out_score))],
                ["node", "id", "score"],
            )


def _first(df: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first rows of each group; tasks cut their own part of a group before it is shuffled."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= keep).drop("_rank")


def top_products(
    df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding",
    pivots: int = PIVOTS, rings: int = RINGS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``(query_id, rank, id, score)``: for each query row the ``k`` other rows with the largest inner products.

    A component x counts as ``floor(scale * x)``; scores are exact. Equal scores are ordered by id,
    null ids last; a query with fewer than ``k`` others gets all of them.

    - Vectors that are null or hold null or non-finite components take no part, neither as queries
      nor as candidates. Vectors of different lengths have no product and never meet; empty
      vectors meet each other with score 0.
    - Every row is a candidate and a query of its own: with repeated rows or ids only the query's
      own row is left out, and each of them is a query. Rows for which ``is_query`` is null are none.
    - An empty table gives an empty result. Other columns are ignored, so their names cannot clash.
    - A component of 2**53 or more after scaling, or a score or squared norm beyond 64 bits, is an error.

    Pivots and ring edges come from at most ``sample_rows`` vectors; all vectors are indexed and
    results are exact whatever the sample.
    """
    spark = session(df.sparkSession)
    keep = k + 1  # the query's own row may be among the best
    prepared = "id bigint, dim int, vec array<bigint>, norm bigint, query boolean"
    rows = stored(
        df.select(
            F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
            F.coalesce(is_query, F.lit(False)).alias("query"),
        ).mapInArrow(partial(_prepared, scale=scale), prepared), "whole",
    )
    smallest = _first(rows.select("dim", "vec", "id"), ["dim", "vec"], [F.col("id").asc_nulls_last()], keep)
    # the lists hold at most k + 1 ids each
    classes = smallest.groupBy("dim", "vec").agg(F.collect_list(F.struct(F.col("id").isNull().alias("absent"), "id")).alias("ids"))
    classes = stored(classes.select("dim", "vec", F.transform(F.array_sort("ids"), lambda i: i["id"]).alias("ids")), "classes")

    tops = {r.dim: r.top for r in rows.groupBy("dim").agg(F.max("norm").alias("top")).collect()}
    drawn: dict[int, list] = {dim: [] for dim in tops}
    for r in classes.select("dim", "vec").orderBy(F.xxhash64("vec"), "dim").limit(sample_rows).collect():
        drawn[r.dim].append(r.vec)
    shared = {
        dim: fit(np.array(drawn[dim], np.int64).reshape(len(drawn[dim]), dim), top, pivots, rings) for dim, top in tops.items()
    }
    keyed = "dim int, vec array<bigint>, ids array<bigint>, pivot int, ring int, d double"
    indexed = stored(classes.mapInArrow(partial(_indexed, shared=spark.sparkContext.broadcast(shared)), keyed), "rings")
    cell = ["dim", "pivot", "ring"]
    lines = indexed.groupBy(*cell).agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("greatest")).collect()
    for dim, index in shared.items():
        own = [r for r in lines if r.dim == dim]
        index.cells = np.array([(r.pivot, r.ring) for r in own], np.int64).reshape(-1, 2)
        index.least, index.greatest = (np.array([r[c] for r in own]) for c in ("least", "greatest"))
    ready = spark.sparkContext.broadcast(shared)

    def blocks(n: Column, size: int) -> Column:
        return F.ceil(n * F.greatest(F.col("dim"), F.lit(1)) * 8 / size).cast("int")

    # one line per ring, which the parameters bound
    sizes = spark.createDataFrame([(r.dim, r.pivot, r.ring, r.n) for r in lines], "dim int, pivot int, ring int, n long")
    sizes = sizes.select(*cell, blocks(F.col("n"), BLOCK_BYTES).alias("parts"))
    queries = rows.where("query").select("dim", "vec").distinct().withColumn("node", F.monotonically_increasing_id())
    queries = stored(queries, "queries")
    best = None
    first, step = 0, 1
    most = max((len(index.cells) for index in shared.values()), default=0)
    while first < most:
        last = first + step if first + step < most else None
        if best is None:
            asking = queries.withColumn("kth", F.lit(None).cast("bigint"))
        else:
            kth = best.groupBy("node").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            kth = kth.select("node", F.when(F.col("n") >= keep, F.col("least")).alias("kth"))
            asking = queries.join(kth, "node", "left")
        wanted = asking.mapInArrow(
            partial(_wanted, shared=ready, first=first, last=last),
            "node bigint, dim int, vec array<bigint>, kth bigint, cells array<struct<pivot:int,ring:int>>",
        )
        asks = stored(wanted.select("node", "dim", "vec", "kth", F.explode("cells").alias("c")).select("node", "dim", "vec", "kth", "c.*"), "asks")
        counts = asks.groupBy(*cell).agg(F.count("*").alias("asked")).collect()
        if counts:
            asked = spark.createDataFrame([tuple(r) for r in counts], "dim int, pivot int, ring int, asked long")
            plan = sizes.join(F.broadcast(asked.select(*cell, blocks(F.col("asked"), QUERY_BYTES).alias("groups"))), cell)
            found = stored(_round(indexed, asks, plan, cell, keep), "found")
            merged = found if best is None else best.unionAll(found)
            best = stored(_first(merged, ["node"], [F.col("score").desc(), F.col("id").asc_nulls_last()], keep), "best")
        first, step = first + step, step * WIDEN
    if best is None:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    one = F.struct((-F.col("score")).alias("order"), F.col("id").isNull().alias("absent"), "id", "score")
    lists = best.groupBy("node").agg(F.array_sort(F.collect_list(one)).alias("best"))
    answers = queries.join(lists, "node").select("dim", "vec", "best")
    asked = rows.where("query").select(F.col("id").alias("query_id"), "dim", "vec", "norm").join(answers, ["dim", "vec"])
    own = F.array_position(
        F.transform("best", lambda b: b["id"].eqNullSafe(F.col("query_id")) & (b["score"] == F.col("norm"))), True
    )
    others = F.filter("best", lambda b, i: i + 1 != F.col("own"))
    return (
        asked.withColumn("own", own).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "b"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("id"), F.col("b.score").alias("score"))
    )


def _round(indexed: DataFrame, asks: DataFrame, plan: DataFrame, cell: list[str], keep: int) -> DataFrame:
    """Best rows of the rings that queries ask for, block of vectors against block of queries."""
    part, group = F.pmod(F.xxhash64("vec"), F.col("parts")), F.pmod(F.xxhash64("node"), F.col("groups"))
    plan = F.broadcast(plan)
    no = F.lit(None)
    data = indexed.join(plan, cell).withColumn("part", part).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    data = data.select(*cell, "part", "group", F.lit(False).alias("asks"), no.cast("bigint").alias("node"), "vec", "ids", no.cast("bigint").alias("kth"))
    queries = asks.join(plan, cell).withColumn("group", group).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    queries = queries.select(
        *cell, "part", "group", F.lit(True).alias("asks"), "node", "vec", no.cast("array<bigint>").alias("ids"), "kth",
    )
    key = [*cell, "part", "group"]
    units = data.unionByName(queries).withColumn("name", F.concat_ws(":", *key))
    tasks = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.select(F.col("name").alias("unit"), "asks", "node", "dim", "vec", "ids", "kth")
    found = units.repartition(tasks, "unit").sortWithinPartitions("unit").mapInArrow(
        partial(_searched, keep=keep), "node bigint, id bigint, score bigint"
    )
    return _first(found, ["node"], [F.col("score").desc(), F.col("id").asc_nulls_last()], keep)
