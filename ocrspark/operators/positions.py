"""Running totals and ranks over a document without one task per document.

A window over a whole document would put a document with a third of all pages into
one task. Here totals are taken per block of pages first; only the block totals of a
document meet in one task, and each block then counts on from its own start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ocrspark.session import stored

# Pages per block: a document of 2^31 pages still has only 2^19 blocks.
BLOCK_BITS = 12


def _before(part: list[str], key: str):
    return W.partitionBy(*part).orderBy(key).rowsBetween(W.unboundedPreceding, -1)


def prefix_sums(rows: DataFrame, part: list[str], keys: list[str], value: str) -> DataFrame:
    """Add ``before``: sum of ``value`` over smaller ``keys`` within ``part``.

    ``rows`` holds one row per ``part + keys``; ``keys[0]`` is an integer such as the page.
    """
    # every level reads the rows once more, so what they come from is computed only once
    rows = stored(rows, "counts")
    blocked = rows.withColumn("_blk", F.shiftright(keys[0], BLOCK_BITS))
    order = ["_blk", *keys]
    total, out = F.lit(0).cast("long"), blocked
    for i, key in enumerate(order):
        outer = [*part, *order[:i]]
        if i == len(order) - 1:
            out = out.withColumn("_last", F.sum(value).over(_before(outer, key)))
            total = total + F.coalesce("_last", F.lit(0))
            continue
        level = blocked.groupBy(*outer, key).agg(F.sum(value).alias("_n"))
        off = f"_off{i}"
        level = level.select(*outer, key, F.sum("_n").over(_before(outer, key)).alias(off))
        out = out.join(level, [*outer, key])
        total = total + F.coalesce(off, F.lit(0))
    return out.select(*rows.columns, total.cast("long").alias("before"))


def rank_in(rows: DataFrame, part: list[str], keys: list[str], ties: list[str], name: str) -> DataFrame:
    """Add ``name``: 1-based rank of a row in ``part`` by ``keys``, then ``ties``."""
    counts = rows.groupBy(*part, *keys).agg(F.count("*").alias("_n"))
    starts = prefix_sums(counts, part, keys, "_n").drop("_n")
    order = W.partitionBy(*part, *keys).orderBy(*ties)
    ranked = rows.withColumn("_rn", F.row_number().over(order)).join(starts, [*part, *keys])
    return ranked.withColumn(name, F.col("before") + F.col("_rn")).drop("before", "_rn")
