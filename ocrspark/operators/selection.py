"""Projections and filters over documents, pages and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ocrspark import pins
from ocrspark.functions.geometry import round_half_up, union_box
from ocrspark.functions.text import parse_int, trim_all
from ocrspark.session import small_side
from ocrspark.operators.positions import rank_in


def clamp_pages(docs: DataFrame, first: Column, last: Column) -> DataFrame:
    """Page range as typed -> valid 1-based range and its label."""
    count = F.col("page_count")
    lo, hi = parse_int(first), parse_int(last)
    lo = F.when(lo.isNull() | (lo < 1) | (lo > count), F.lit(1)).otherwise(lo)
    hi = F.when(hi.isNull() | (hi < 1) | (hi > count), count).otherwise(hi)
    out = docs.select("doc_id", count, lo.alias("lo"), hi.alias("max_page"))
    out = out.withColumn("min_page", F.least("lo", "max_page"))
    label = F.when(
        (F.col("min_page") > 1) | (F.col("max_page") < count),
        F.format_string(" Pages: %d–%d", "min_page", "max_page"),
    ).otherwise(" Pages: All")
    return out.select("doc_id", "min_page", "max_page", label.alias("label"))


def page_range(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of the pages inside each document's 1-based range."""
    joined = rows.join(ranges.select("doc_id", "min_page", "max_page"), "doc_id")
    inside = (F.col("page_no") + 1).between(F.col("min_page"), F.col("max_page"))
    return joined.filter(inside).select(*rows.columns)


def conf_band(words: DataFrame, high: int = pins.CONF_HIGH, med: int = pins.CONF_MED) -> DataFrame:
    conf = F.col("conf")
    return words.withColumn("band", F.when(conf > high, "high").when(conf > med, "med").otherwise("low"))


def highlight_rect(words: DataFrame) -> DataFrame:
    """Word box grown by a fifth of its height above and below."""
    grow = (F.col("b") - F.col("t")) * F.lit(0.2)
    return words.withColumns(
        {
            "x": F.col("l").cast("double"),
            "y": F.col("t") - grow,
            "width": (F.col("r") - F.col("l")).cast("double"),
            "height": (F.col("b") - F.col("t")) + grow * 2,
        }
    )


def remove_margins(words: DataFrame, version: list[str] | None = None) -> DataFrame:
    """Shift every page so that its content starts at 0,0.

    The corners are written first, one row per page; while they are few the words are not shuffled.
    """
    key = [*(version or []), *pins.PAGE_KEY]
    corner = small_side(words.groupBy(*key).agg(F.min("l").alias("_l"), F.min("t").alias("_t")), "corners")
    moved = {"l": "_l", "r": "_l", "t": "_t", "b": "_t"}
    return (
        words.join(corner, key)
        .withColumns({c: F.col(c) - F.col(o) for c, o in moved.items()})
        .drop("_l", "_t")
    )


def standardize_pages(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Scale every page of a document to the width of its widest page, keeping proportions."""
    widest = pages.groupBy("doc_id").agg(F.max("width").alias("_target"))
    scale = pages.join(widest, "doc_id").select(
        *pins.PAGE_KEY, (F.col("_target").cast("double") / F.col("width")).alias("scale")
    )
    scaled = {c: round_half_up(F.col(c) * F.col("scale")) for c in pins.BOX}
    return words.join(scale, list(pins.PAGE_KEY)).withColumns(scaled)


def kv_map(texts: DataFrame) -> DataFrame:
    """``key value...`` lines as rows; a later line of the same key replaces an earlier one."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = lines.withColumn("line", trim_all(F.col("line"))).filter("line <> ''")
    blank = F.instr("line", " ")
    pair = lines.select(
        "doc_id", "n",
        F.when(blank > 0, F.substr("line", F.lit(1), blank - 1)).otherwise(F.col("line")).alias("key"),
        F.when(blank > 0, F.substr("line", blank + 1)).otherwise("").alias("value"),
    )
    return pair.groupBy("doc_id", "key").agg(F.max_by("value", "n").alias("value"))


def route(docs: DataFrame, use_main: bool = True, use_supp: bool = False) -> DataFrame:
    """Which documents skip recognition, and what their embedded text is used for."""
    text_only = F.get("xml_mode", F.lit(0)) & ~F.col("image_mode") & ~F.col("pdf_mode")
    text_pdf = F.col("pdf_mode") & (F.col("pdf_type") == "text")
    skip = F.coalesce(text_only, F.lit(False)) | F.coalesce(text_pdf, F.lit(False))
    embedded = F.col("pdf_mode") & F.col("pdf_type").isin("text", "ocr")
    use = F.when(embedded & F.lit(use_main), "main").when(embedded & F.lit(use_supp), "supp")
    return docs.select("doc_id", skip.alias("skip"), use.otherwise("none").alias("embedded_text"))


def word_address(words: DataFrame, word_id: str) -> DataFrame:
    """Page, line and word ordinal of the first word with this id in each document."""
    first = F.min(F.struct("page_no", "line_no", "word_no")).alias("a")
    found = words.filter(F.col("word_id") == word_id).groupBy("doc_id").agg(first)
    return found.select("doc_id", "a.page_no", "a.line_no", "a.word_no")


def common_value(words: DataFrame, prop: str, by: list[str]) -> DataFrame:
    """The value all selected words share, else an empty string."""
    value = F.col(prop).cast("string")
    one = (F.min(value) == F.max(value)) & (F.count(value) == F.count("*"))
    return words.groupBy(*by).agg(F.when(one, F.min(value)).otherwise("").alias(prop))


def union_boxes(words: DataFrame, keys: list[str]) -> DataFrame:
    """Outline of each line, paragraph or highlight group."""
    return words.groupBy(*keys).agg(*union_box())


def lang_mix(words: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Words per language and their share; a word without language has its paragraph's."""
    by = by or ["doc_id"]
    lang = F.coalesce("lang", "par_lang")
    counts = words.groupBy(*by, lang.alias("lang")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*by))
    return counts.withColumn("share", F.col("n").cast("double") / total)


def reading_order(words: DataFrame, parts: int | None = None) -> DataFrame:
    """Words sorted for reading, with their 1-based position in the document.

    ``parts`` is the number of ranges they are sorted in, by default that of shuffles. If it grows with the words,
    a range is sorted in memory.
    """
    ranked = rank_in(words, ["doc_id"], ["page_no", "line_no"], ["word_no"], "position")
    ranges = [parts] if parts else []
    return ranked.repartitionByRange(*ranges, *pins.WORD_KEY).sortWithinPartitions(*pins.WORD_KEY)
