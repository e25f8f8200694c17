"""Pairs within buckets of any size, without a task that holds an unbounded bucket.

A bucket of n rows is dealt into ceil(n / block) parts. A unit of work is one part or a pair
of parts, so it has at most twice ``block`` rows whatever the bucket holds, and the units of
one hot bucket spread over the cluster. Every pair of rows meets in exactly one unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ocrspark.llm.common import stored

#: Units up to this size are compared shift by shift together, larger ones each as a matrix.
SMALL = 48


def units(keys: DataFrame, bucket: list[str], block: int, label: str) -> DataFrame:
    """Rows ``(unit, across, home, *bucket, node)`` for ``keys`` of ``(*bucket, node)``.

    ``across`` marks units made of two parts, in which only rows of different ``home`` are
    compared. Rows alone in their bucket are left out, having no partner there.
    """
    counts = stored(keys.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1"), f"{label}-sizes")
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = keys.join(counts, bucket).select(
        *bucket, "node", parts.alias("parts"),
        F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int").alias("home"),
    )
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("home", "other"), F.greatest("home", "other")
    return met.select(
        F.xxhash64(*bucket, low, high).alias("unit"), (low != high).alias("across"), "home", *bucket, "node"
    )


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole units from batches sorted by ``unit``."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        unit = t["unit"].to_numpy()
        other = np.flatnonzero(unit != unit[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield t.slice(0, cut).combine_chunks()
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def pairs(
    unit: np.ndarray, across: np.ndarray, home: np.ndarray,
    near: Callable[[np.ndarray, np.ndarray], np.ndarray],
    dense: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) within the units that pass ``near`` (elementwise) or ``dense`` (as a matrix)."""
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    sizes = np.diff(np.r_[starts, len(unit)])
    of_row = np.repeat(sizes, sizes)
    for shift in range(1, SMALL):
        i = np.flatnonzero((unit[:-shift] == unit[shift:]) & (of_row[:-shift] <= SMALL))
        if not len(i):
            break
        j = i + shift
        ok = ~across[i] | (home[i] != home[j])
        i, j = i[ok], j[ok]
        ok = near(i, j)
        if ok.any():
            yield i[ok], j[ok]
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        rows = np.arange(s, s + n)
        if across[s]:
            first = home[rows] == home[rows].min()
            a, b = rows[first], rows[~first]
            x, y = np.nonzero(dense(a, b)) if len(a) and len(b) else (rows[:0], rows[:0])
        else:
            a = b = rows
            x, y = np.nonzero(np.triu(dense(a, b), 1))
        if len(x):
            yield a[x], b[y]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n rows over the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
