"""Corpus preparation in stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ocrspark.llm import bpe, decontaminate, line_dedup, minhash_dedup, toxicity
from ocrspark.llm.common import BLANKS, in_fifths, stored, table, text_prints, unused
from ocrspark.session import scratch_scope

#: A line is dropped when it occurs in this many documents, as in the query of the operator.
LINE_DOCS = 10
VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language; training sees no held-out label.

    Every row is judged by itself: null, empty and blank texts get the score of an empty one, texts of
    any length are scored whole, repeated rows and null ids need no rule. A null or unknown language
    has the threshold of all. Without labels nothing reaches it. Other columns pass through.
    """
    labels = table(spark, sf_dir, "labels").where(~in_fifths(F.col("doc_id")))
    model = toxicity.train(docs, labels)
    (score,) = unused(docs, "_score")
    scored = toxicity.score(docs, model, score_col=score)
    return scored.where(~toxicity.rejected(model, score)).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; ``n_chars`` follows the text.

    A null text comes back empty; documents stay, also with no line left. Rows that share an id, null
    ids too, count as one document. Texts are read whole. Columns named ``n_lines`` or ``n_dropped``
    are dropped, others pass through; an empty table stays empty.
    """
    kept = line_dedup.dedup_lines(docs, min_docs=LINE_DOCS, keep="none").drop("n_lines", "n_dropped")
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone``: by id, and by the print of the text where there is none."""
    t1, t2 = text_prints(docs["doc_id"], docs["text"])
    found = docs["doc_id"].eqNullSafe(gone["id"]) & t1.eqNullSafe(gone["t1"]) & t2.eqNullSafe(gone["t2"])
    return docs.join(gone, found, "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id.

    Documents without an id are told apart by their text: one with a copy that has an id goes, and
    of a group without any id one row stays. Blank texts are copies of nothing.
    """
    left = _without(docs, stored(minhash_dedup.copies(docs), "copies"))
    # equal texts without an id go or stay together, so that one row of them is chosen here
    repeatable = F.col("doc_id").isNull() & F.coalesce(F.translate("text", BLANKS.decode(), "") != "", F.lit(False))
    once = left.where(repeatable)
    names = unused(docs, "_t1", "_t2")
    prints = dict(zip(names, text_prints(F.col("doc_id"), F.col("text"))))
    once = once.withColumns(prints).dropDuplicates(names).drop(*names)
    return left.where(~repeatable).unionAll(once)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; those without an id go by their own text only."""
    return _without(docs, stored(decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")), "contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and their number.

    A null or empty text has no tokens, a text of any length is encoded whole, and each of repeated
    rows or null ids is encoded by itself. Other columns are left out; an empty table stays empty.
    """
    path = public_tokenizers.path(VOCABULARY)
    coded = bpe.encode(docs, path).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")
    return coded


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_dedup", drop_copies),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]

#: A trained classifier stands at the start, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # what a stage writes on its way goes with it, its result stays
        with scratch_scope(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return docs
