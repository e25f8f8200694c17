"""Highlights: outlines, index, navigation and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ocrspark import pins
from ocrspark.operators.positions import prefix_sums, rank_in
from ocrspark.session import stack, stored


def _grouped(annots: DataFrame) -> DataFrame:
    return annots.filter(F.coalesce("group_id", F.lit("")) != "")


def annot_index(annots: DataFrame) -> DataFrame:
    """Groups of a document by page and top of their first highlight, numbered from 1."""
    first = F.min(F.struct("page_no", "annot_no", F.col("t").alias("top"))).alias("f")
    groups = _grouped(annots).groupBy("doc_id", "group_id").agg(first)
    rows = groups.select("doc_id", "group_id", "f.page_no", "f.top", "f.annot_no")
    ranked = rank_in(rows, ["doc_id"], ["page_no", "top"], ["annot_no"], "idx")
    return ranked.select("doc_id", "group_id", "page_no", "top", "idx")


def annot_count(annots: DataFrame) -> DataFrame:
    """Annotation groups per document; a document with only ungrouped highlights has 0."""
    group = F.nullif("group_id", F.lit(""))
    return annots.groupBy("doc_id").agg(F.count_distinct(group).alias("n"))


def annot_nav(index: DataFrame, places: DataFrame) -> DataFrame:
    """Previous and next group from each place, wrapping round.

    ``places`` holds ``(doc_id, page_no, group_id)``, group NULL if nothing is selected.
    Then the last group up to the page, or the first from the page on, is the anchor, and
    the step leads past it. Groups are ranked by page, so an anchor follows from how many
    groups lie on earlier pages and on this one.
    """
    index = stored(index, "index")
    here = places.select(*pins.PAGE_KEY).distinct().withColumn("n", F.lit(0).cast("long"))
    on_page = index.groupBy(*pins.PAGE_KEY).agg(F.count("*").alias("n"))
    counts = stack(here, on_page).groupBy(*pins.PAGE_KEY).agg(F.sum("n").alias("n"))
    before = prefix_sums(counts, ["doc_id"], ["page_no"], "n")
    totals = index.groupBy("doc_id").agg(F.count("*").alias("total"))
    own = index.select("doc_id", "group_id", F.col("idx").alias("own"))
    at = (
        places.join(before, list(pins.PAGE_KEY))
        .join(totals, "doc_id")
        .join(own, ["doc_id", "group_id"], "left")
    )
    total = F.col("total")
    back = F.coalesce("own", F.greatest(F.col("before") + F.col("n"), F.lit(1)))
    ahead = F.coalesce("own", F.least(F.col("before") + 1, total))
    at = at.select(
        *pins.PAGE_KEY, "group_id",
        F.when(back > 1, back - 1).otherwise(total).alias("prev_idx"),
        F.when(ahead < total, ahead + 1).otherwise(F.lit(1)).alias("next_idx"),
    )
    for side in ("prev", "next"):
        target = index.select(
            "doc_id", F.col("idx").alias(f"{side}_idx"),
            F.col("group_id").alias(f"{side}_group"), F.col("page_no").alias(f"{side}_page"),
        )
        at = at.join(target, ["doc_id", f"{side}_idx"])
    return at.select(
        *pins.PAGE_KEY, "group_id", "prev_group", "prev_page", "next_group", "next_page"
    )


def annot_position(index: DataFrame, places: DataFrame) -> DataFrame:
    """Counter of each place: 1-based ``position`` and ``total`` groups of the document.

    The position is that of the selected group, without a selection that of the first group
    on the page, and 0 where there is none. An empty group counts as no selection.
    """
    index = stored(index, "index")
    own = index.select("doc_id", "group_id", F.col("idx").alias("own"))
    first = index.groupBy(*pins.PAGE_KEY).agg(F.min("idx").alias("first"))
    totals = index.groupBy("doc_id").agg(F.count("*").alias("total"))
    chosen = F.nullif("group_id", F.lit("")).isNotNull()
    at = (
        places.join(own, ["doc_id", "group_id"], "left")
        .join(first, list(pins.PAGE_KEY), "left")
        .join(totals, "doc_id", "left")
    )
    zero = F.lit(0).cast("long")
    position = F.coalesce(F.when(chosen, F.col("own")).otherwise(F.col("first")).cast("long"), zero)
    return at.select(
        *pins.PAGE_KEY, "group_id", position.alias("position"), F.coalesce("total", zero).alias("total")
    )


def apply_highlights(annots: DataFrame, ops: DataFrame) -> DataFrame:
    """Word highlights after a log of operations ``(seq, doc_id, word_id, op, color, opacity, comment)``.

    The last ``highlight`` of a word counts; colour ``none`` removes it, and with it the
    comments so far. ``comment`` sets the text of a highlight that is there at that moment,
    else it is lost. Opacity arrives in percent.
    """
    is_mark = F.col("op") == "highlight"
    seq = F.col("seq")
    earlier = W.partitionBy("doc_id", "word_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    there = annots.select("doc_id", "word_id", (F.col("color") != "none").alias("from_start"))
    ops = ops.join(there, ["doc_id", "word_id"], "left").withColumn(
        "shown", F.coalesce(F.last(F.when(is_mark, F.col("color") != "none"), True).over(earlier), "from_start", F.lit(False))
    )
    is_note = (F.col("op") == "comment") & F.col("shown")
    log = ops.groupBy("doc_id", "word_id").agg(
        F.max(F.when(is_mark, seq)).alias("mark_seq"),
        F.max_by("color", F.when(is_mark, seq)).alias("new_color"),
        F.max_by("opacity", F.when(is_mark, seq)).alias("new_opacity"),
        F.max(F.when(is_mark & (F.col("color") == "none"), seq)).alias("gone_seq"),
        F.max(F.when(is_note, seq)).alias("note_seq"),
        F.max_by("comment", F.when(is_note, seq)).alias("new_comment"),
    )
    old = annots.select("doc_id", "word_id", "color", "opacity", "comment")
    marked, removed = F.col("mark_seq").isNotNull(), F.col("gone_seq").isNotNull()
    noted = F.col("note_seq").isNotNull() & (F.col("gone_seq").isNull() | (F.col("note_seq") > F.col("gone_seq")))
    color = F.when(marked, F.col("new_color")).otherwise(F.col("color"))
    opacity = F.when(marked, F.col("new_opacity") / F.lit(100.0)).otherwise(F.col("opacity"))
    comment = F.when(noted, F.col("new_comment")).when(~removed, F.col("comment"))
    return (
        old.join(log, ["doc_id", "word_id"], "full_outer")
        .select("doc_id", "word_id", color.alias("color"), opacity.alias("opacity"), comment.alias("comment"))
        .filter(F.col("color").isNotNull() & (F.col("color") != "none"))
    )
