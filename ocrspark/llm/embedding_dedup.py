"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, components.

In a table of b hyperplanes two vectors at cosine c share all signs with probability
(1 - acos(c) / pi) ** b. The number of tables follows from the chance allowed for a pair at
exactly the threshold to be missed. Signatures of all tables travel with a vector, so a pair
counts only in the first table it shares and no pair needs to be deduplicated by a shuffle.
Equal vectors are one row with a weight from the start, so a hot group of copies is no bucket.
The signs of a table grow with the logarithm of the vectors, so buckets of unrelated vectors keep
their size. Within a table, buckets of any size are compared in bounded units
(:mod:`ocrspark.llm.groups`) and leave counts and a spanning set of links, never all pairs.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ocrspark.llm import groups
from ocrspark.llm.common import binary_rows, rows_of, session, stored
from ocrspark.llm.components import connected_components


#: Distance to the threshold within which the order of a sum may decide.
ROUNDING = 1e-12


def tables_for(threshold: float, bits: int, miss: float) -> int:
    """Tables needed so that a pair at the threshold is missed with at most probability ``miss``."""
    share = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return 1 if share >= 1 else math.ceil(math.log(miss) / math.log(1 - share))


#: Unrelated vectors in a bucket: with fewer, rows travel to more tables; with more, tasks multiply longer.
BUCKET = 256
#: Signs of a table, at least; at most, since a code is an integer of 32 bits.
FEWEST_BITS, MOST_BITS = 4, 31


def bits_for(vectors: int) -> int:
    """Signs of a table that leave about ``BUCKET`` vectors of random directions in each bucket."""
    return min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(max(vectors, 1) / BUCKET))))


def _sign_type(bits: int):
    return np.uint16 if bits <= 16 else np.uint32


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _sign(batches, bits: int, tables: int, seed: int):
    """Usable vectors with their signs; vectors of one length at a time."""
    weights = 1 << np.arange(bits)
    for batch in batches:
        col = batch.column("vec")
        lengths = np.diff(col.offsets.to_numpy())
        for dim in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == dim)
            given = col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            x = given.astype(np.float64)
            top = np.abs(x).max(axis=1)
            good = np.isfinite(top) & (top > 0)
            rows, x = rows[good], x[good]
            unit = x / top[good][:, None]
            signs = (unit @ planes(dim, bits, tables, seed) >= 0).reshape(len(x), tables, bits) @ weights
            kept = [batch.column(c).take(pa.array(rows)) for c in ("node", "p1", "p2", "copies")]
            yield pa.RecordBatch.from_arrays(
                [
                    *kept, pa.array(np.full(len(x), dim, np.int32)), binary_rows(given[good]),
                    binary_rows(signs.astype(_sign_type(bits))),
                    pa.array(list(signs.astype(np.int32)), pa.list_(pa.int32())),
                ],
                ["node", "p1", "p2", "copies", "dim", "vec", "signs", "codes"],
            )


def _reach(cosine: np.ndarray, threshold: float, rows) -> np.ndarray:
    """Which cosines reach the threshold; those too near to it are summed up exactly, one way for all buckets."""
    reached = cosine >= threshold
    close = np.nonzero(np.abs(cosine - threshold) < ROUNDING)
    if len(close[0]):
        products = np.multiply(*rows(*close))
        reached[close] = [math.fsum(p) >= threshold for p in products.tolist()]
    return reached


def _count(batches, threshold: float, tables: int, number, sign):
    """Partial link counts and a root for each linked row of the units in a batch.

    A link counts as often as the vector at its other end has copies. ``number`` and ``sign`` are
    the types in which components and signs arrive.
    """
    for t in groups.by_unit(batches):
        node, dims, copies = (t[c].to_numpy() for c in ("node", "dim", "copies"))
        table, unit, home = (t[c].to_numpy() for c in ("table", "unit", "home"))
        across = t["across"].to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            own = t.take(pa.array(at))
            x = rows_of(own["vec"], number, dim).astype(np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            signs = rows_of(own["signs"], sign, tables)
            first, second = [], []
            for i, j in groups.pairs(
                unit[at], across[at], home[at],
                lambda i, j: _reach(np.einsum("ij,ij->i", x[i], x[j]), threshold, lambda k: (x[i[k]], x[j[k]])),
                lambda a, b: _reach(x[a] @ x[b].T, threshold, lambda r, c: (x[a[r]], x[b[c]])),
            ):
                for k in range(0, len(i), 1 << 16):  # links count in the first table that holds both
                    p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    now = table[at][p]
                    new = ((signs[p] == signs[q]).argmax(axis=1) == now) & (now == table[at][q])
                    first.append(p[new])
                    second.append(q[new])
            if not first:
                continue
            i, j = np.concatenate(first), np.concatenate(second)
            n = np.zeros(len(at), np.int64)
            np.add.at(n, i, copies[at][j])
            np.add.at(n, j, copies[at][i])
            root = groups.roots(len(at), i, j)
            linked = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[at][linked]), pa.array(n[linked]), pa.array(node[at][root[linked]])],
                ["node", "n", "root"],
            )


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, bits: int | None = None,
    miss: float = 1e-5, block: int = 2048, seed: int = 17,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``df``.

    ``bits`` (at most 31) are the signs of a table; by default they follow from the number of
    different vectors (:func:`bits_for`), and the number of tables follows from them.
    Pairs are linked when their cosine in double precision reaches the threshold.

    - A vector that is null, empty, zero, or holds a null or non-finite component links with
      nothing, nor do vectors of different lengths.
    - Every row is a vector of its own: repeated rows link with each other, also under one id.
      Equal vectors are told by a 128-bit print, and zeros of either sign are equal.
    - ``component_id`` is the least id that is not null in the component; ``kept`` marks rows
      with that id. A row with a null id that links with nothing has a null component and stays.
    - Other columns are ignored; an empty table gives an empty result.
    """
    spark = session(df.sparkSession)
    if bits is not None and not 1 <= bits <= MOST_BITS:
        raise ValueError(f"bits must be 1 to {MOST_BITS}")
    single = df.schema[vec_col].dataType.simpleString() == "array<float>"
    kind, number = ("array<float>", np.float32) if single else ("array<double>", np.float64)
    vec = F.col("vec")
    whole = (F.size(vec) > 0) & (F.size(F.array_compact(vec)) == F.size(vec))
    rows = stored(
        df.select(F.monotonically_increasing_id().alias("node"), F.col(vec_col).cast(kind).alias("vec"), F.col(id_col).alias("id"))
        .select("*", F.when(whole, F.xxhash64(vec)).alias("p1"), F.when(whole, F.xxhash64(F.lit(1), vec)).alias("p2")),
        "vectors",
    )
    distinct = stored(
        rows.where("p1 is not null").groupBy("p1", "p2", "vec").agg(F.min("node").alias("node"), F.count("*").alias("copies")),
        "distinct-vectors",
    )
    bits = bits_for(distinct.count()) if bits is None else bits
    tables = tables_for(threshold, bits, miss)
    schema = "node long, p1 long, p2 long, copies long, dim int, vec binary, signs binary, codes array<int>"
    signed = stored(distinct.mapInArrow(partial(_sign, bits=bits, tables=tables, seed=seed), schema), "signed")
    keys = signed.select("dim", F.posexplode("codes").alias("table", "code"), "node")
    met = groups.units(keys, ["dim", "table", "code"], block, "buckets").select(
        "unit", "across", "home", "table", "node"
    )
    met = met.join(signed.select("node", "copies", "dim", "vec", "signs"), "node")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counting = partial(_count, threshold=threshold, tables=tables, number=number, sign=_sign_type(bits))
    counted = stored(
        met.repartition(tasks, "unit").sortWithinPartitions("unit").mapInArrow(counting, "node long, n long, root long"),
        "links",
    )
    totals = stored(counted.groupBy("node").agg(F.sum("n").alias("n")), "link-counts")
    parts = connected_components(counted.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = signed.select("node", "p1", "p2", "copies").join(totals, "node", "left").join(parts, "node", "left").select(
        "p1", "p2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("part"),
    )
    placed = stored(
        rows.select("node", "id", "p1", "p2").join(classes, ["p1", "p2"], "left")
        .select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("part", "node").alias("part")),
        "placed",
    )
    least = stored(placed.groupBy("part").agg(F.min("id").alias("component_id")), "least")
    return placed.join(least, "part").select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
