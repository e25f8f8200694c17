"""Text search over words, match numbering and moving between matching pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ocrspark import pins
from ocrspark.operators.positions import BLOCK_BITS, prefix_sums
from ocrspark.session import stack

PAGE = list(pins.PAGE_KEY)
LINE = list(pins.LINE_KEY)


def _terms(query: str) -> list[str]:
    return query.strip().lower().split()


def _roles(terms: list[str]) -> list[Column]:
    """What the word at each place of a phrase must look like."""
    text = F.lower("text")
    if len(terms) == 1:
        return [F.contains(text, F.lit(terms[0]))]
    inner = [text == t for t in terms[1:-1]]
    return [F.endswith(text, F.lit(terms[0])), *inner, F.startswith(text, F.lit(terms[-1]))]


def _phrase_starts(words: DataFrame, terms: list[str]) -> DataFrame:
    """Address of the first word of each match.

    Only words that fit some place of the phrase are shuffled. Each votes for the start
    it implies, and a start with a vote for every place is a match.
    """
    roles = _roles(terms)
    places = F.array_compact(F.array(*[F.when(role, F.lit(i)) for i, role in enumerate(roles)]))
    votes = words.filter(reduce(Column.__or__, roles)).select(*LINE, "word_no", F.explode(places).alias("i"))
    start = (F.col("word_no") - F.col("i")).alias("word_no")
    full = votes.groupBy(*LINE, start).agg(F.count("*").alias("n")).filter(F.col("n") == len(terms))
    return full.drop("n")


def find_text(words: DataFrame, query: str) -> DataFrame:
    """Matches of the query per page, pages without any included; an empty query finds nothing.

    Case is ignored. A single term may stand anywhere in a word; several terms must run
    through consecutive words of a line.
    """
    terms = _terms(query)
    if len(terms) == 1:
        return words.groupBy(*PAGE).agg(F.count_if(_roles(terms)[0]).alias("n"))
    none = F.lit(0).cast("long").alias("n")
    pages = words.groupBy(*PAGE).agg(none)
    if not terms:
        return pages.filter(F.lit(False))
    found = _phrase_starts(words, terms).groupBy(*PAGE).agg(F.count("*").alias("n"))
    return stack(pages, found).groupBy(*PAGE).agg(F.sum("n").alias("n"))


def find_total(counts: DataFrame) -> DataFrame:
    return counts.groupBy("doc_id").agg(F.sum("n").alias("total"))


def find_words(words: DataFrame, query: str) -> DataFrame:
    """The words that take part in a match."""
    terms = _terms(query)
    if not terms:
        return words.filter(F.lit(False))
    roles = _roles(terms)
    hits = words.filter(reduce(Column.__or__, roles))
    if len(terms) == 1:
        return hits
    last = F.col("word_no") + (len(terms) - 1)
    covered = _phrase_starts(words, terms).select(
        *LINE, F.explode(F.sequence("word_no", last)).alias("word_no")
    )
    return hits.join(covered, list(pins.WORD_KEY), "left_semi")


def match_label(counts: DataFrame) -> DataFrame:
    """Number of the matches of a page within the document: ``-``, ``k`` or ``a-b``."""
    n, before = F.col("n"), F.col("before")
    label = (
        F.when(n == 0, "-")
        .when(n == 1, (before + 1).cast("string"))
        .otherwise(F.concat((before + 1).cast("string"), F.lit("-"), (before + n).cast("string")))
    )
    return prefix_sums(counts, ["doc_id"], ["page_no"], "n").select(*PAGE, "n", label.alias("label"))


def match_nav(counts: DataFrame) -> DataFrame:
    """Nearest earlier and later page with a match, NULL if there is none."""
    blk = F.shiftright("page_no", BLOCK_BITS).alias("_blk")
    hit = F.when(F.col("n") > 0, F.col("page_no"))
    pages = counts.select(*PAGE, blk, hit.alias("hit"))
    per_block = pages.groupBy("doc_id", "_blk").agg(F.min("hit").alias("lo"), F.max("hit").alias("hi"))
    blocks = W.partitionBy("doc_id").orderBy("_blk")
    near = W.partitionBy("doc_id", "_blk").orderBy("page_no")
    past, ahead = (W.unboundedPreceding, -1), (1, W.unboundedFollowing)
    outer = per_block.select(
        "doc_id", "_blk",
        F.max("hi").over(blocks.rowsBetween(*past)).alias("prev_block"),
        F.min("lo").over(blocks.rowsBetween(*ahead)).alias("next_block"),
    )
    inner = pages.withColumns(
        {
            "prev_near": F.max("hit").over(near.rowsBetween(*past)),
            "next_near": F.min("hit").over(near.rowsBetween(*ahead)),
        }
    )
    return inner.join(outer, ["doc_id", "_blk"]).select(
        *PAGE,
        F.coalesce("prev_near", "prev_block").alias("prev_page"),
        F.coalesce("next_near", "next_block").alias("next_page"),
    )


def top_pages(stats: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` pages of the corpus with the greatest value, ties by address."""
    return stats.orderBy(F.col(by).desc_nulls_last(), *PAGE).limit(k)
