"""Labelled texts: all of them, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ocrspark.session import small_side


def _agreed(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    means = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(label).alias("mean"))
    return means.select("id", (F.col("mean") >= 0.5).cast("int").alias("label"))


def every(
    df: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text",
    extra: tuple[str, ...] = (),
) -> tuple[DataFrame, Column]:
    """``(id, text, label, *extra)`` of all labelled documents, and the part of about ``rows`` of them that each is in.

    Rows are dealt by part; up to ``rows`` labels are one. Labels are taken as by :func:`sample`. They are
    written first and sent to the texts while they are few; beyond that Spark shuffles both sides.
    """
    agreed = small_side(_agreed(labels, label, id_col), "labels")
    n = agreed.count()
    # a little below the bound, as the hash does not deal evenly
    parts = 1 if n <= rows else -(-n * 10 // (rows * 9))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *extra)
    part = F.pmod(F.hash("id"), F.lit(parts))
    # dealt by the part itself, so it is whole in any number of partitions; with some to spare few of them get two parts
    found = texts.join(agreed, "id").withColumn("part", part).repartition(4 * parts if parts > 1 else 1, "part")
    return found.dropDuplicates(["part", "id"]).drop("part"), part


def sample(
    df: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text",
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, text, label, *extra)`` of at most ``rows`` labelled documents.

    The documents are those whose hashed ids come first, so the sample is the same at every run
    and grows with the labels until it reaches its bound. Null ids and null labels are left out;
    contradictory labels of one id count as 1 if at least half of them say so, and of rows that
    share an id one is taken.
    """
    chosen = _agreed(labels, label, id_col).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *extra)
    # the chosen ids are few by construction, so no text is shuffled but theirs
    return texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"])
