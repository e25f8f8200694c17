"""Word, line, region, annotation and edit tables derived from ``documents`` (FIXTURES, part B).

A source line of a document becomes a paragraph, twelve tokens of it a text line, four
paragraphs a page. Everything is integer arithmetic and string splitting, so the SQL
twins in :mod:`ocrspark.plans.oracle` give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ocrspark import pins
from ocrspark.operators.selection import union_boxes
from ocrspark.session import by_parts, file_bytes, measured_broadcasts, spread, spread_parts, tune

E = F.expr


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return measured_broadcasts(tune(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    docs = table(by_parts(spark), sf_dir, "documents")
    if dealt:
        docs = spread(docs, "doc_id", file_bytes(spark, f"{sf_dir}/documents.parquet"))
    return docs.select("doc_id", "text", "lang", "source")


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions that documents, and so their words, are dealt to."""
    return spread_parts(spark, file_bytes(spark, f"{sf_dir}/documents.parquet"))


def tokens(spark: SparkSession, sf_dir: str, pages: int | None = None) -> DataFrame:
    """Words of all texts, which are dealt before they are cut out: by page into ``pages`` partitions, with 0 not at all."""
    lines = documents(spark, sf_dir, pages is None).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("par", "line"))
    lines = lines.withColumn("page_no", E("par div 4").cast("int"))
    if pages:
        lines = lines.repartition(pages, *pins.PAGE_KEY)
    toks = lines.select("doc_id", "lang", "page_no", "par", F.posexplode(F.split("line", " ")).alias("tok", "text"))
    return toks.filter("text <> ''").withColumns(
        {"len": F.length("text"), "h": E("cast((doc_id * 7 + par * 13 + tok * 29) % 100 as int)")}
    )


def _words(toks: DataFrame) -> DataFrame:
    """Columns of the word table for tokens that already carry their box shift."""
    return toks.select(
        "doc_id",
        "page_no",
        E("(par % 4) * 2000 + tok div 12").cast("int").alias("line_no"),
        E("tok % 12 + copy * 12").cast("int").alias("word_no"),
        F.col("par").alias("par_no"),
        E("concat(case when copy = 0 then 'w' else 'x' end, par, '_', tok)").alias("word_id"),
        "text",
        F.col("conf").cast("int").alias("conf"),
        E("case when h % 20 = 0 then 'la' end").alias("lang"),
        F.col("lang").alias("par_lang"),
        E("case when h % 10 < 6 then 'Serif' when h % 10 < 9 then 'Sans' end").alias("font"),
        E("h % 7 = 0").alias("bold"),
        E("h % 11 = 0").alias("italic"),
        F.lit(False).alias("small_caps"),
        F.lit(False).alias("sup"),
        E("h % 13 = 0").alias("underline"),
        E("cast(10 + h % 4 as double)").alias("size"),
        E("(tok % 12) * 100 + dx").cast("int").alias("l"),
        E("(par % 4) * 40000 + (tok div 12) * 20 + dy").cast("int").alias("t"),
        E("(tok % 12) * 100 + least(len * 8, 96) + dx").cast("int").alias("r"),
        E("(par % 4) * 40000 + (tok div 12) * 20 + 16 + dy").cast("int").alias("b"),
        "h",
    )


def gt_words(spark: SparkSession, sf_dir: str, pages: int | None = None) -> DataFrame:
    fixed = {"conf": F.lit(100), "copy": F.lit(0), "dx": F.lit(0), "dy": F.lit(0)}
    return _words(tokens(spark, sf_dir, pages).withColumns(fixed))


def ocr_words(spark: SparkSession, sf_dir: str, pages: int | None = None) -> DataFrame:
    """Perturbed copy: missed, wrong, shifted and extra words, varied confidence.

    An extra word stands in the line of its model, with an ordinal behind all others.
    """
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = E(
        "case when h < 5 then concat(text, '~') when h < 8 then concat(text, 'x') "
        f"when h < 10 then translate(text, '{lower}', '{upper}') else text end"
    )
    toks = (
        tokens(spark, sf_dir, pages)
        .filter("h >= 3")
        .withColumn("conf", E("(h * 31 + len * 3) % 101"))
        .withColumn("copy", F.explode(E("case when h in (10, 11) then array(0, 1) else array(0) end")))
        .withColumns(
            {"text": text, "dx": E("h % 5 + copy * 48"), "dy": E("copy * 10")}
        )
    )
    return _words(toks)


def lines(words: DataFrame) -> DataFrame:
    """Text lines of a word table, with a baseline and an x-height."""
    rows = union_boxes(words, [*pins.LINE_KEY, "par_no"])
    return rows.withColumns(
        {
            "slope": E("((par_no * 7 + doc_id) % 11 - 5) * 0.001D"),
            "offset": E("cast(-(par_no % 4) as int)"),
            "x_height": E("shiftleft(8, par_no % 3)"),
        }
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document descriptors."""
    return documents(spark, sf_dir).select(
        "doc_id",
        E(
            "concat(source, '_', doc_id, case doc_id % 5 when 0 then '.hocr' when 1 then '.tar.gz' "
            "when 2 then '.pdf' when 3 then '' else '.extension' end)"
        ).alias("file_name"),
        E("(size(split(text, '\n')) + 3) div 4").cast("int").alias("page_count"),
        E("doc_id % 2 = 0").alias("pdf_mode"),
        E("doc_id % 3 = 0").alias("image_mode"),
        E("array(doc_id % 5 < 3)").alias("xml_mode"),
        E("case doc_id % 4 when 0 then 'text' when 2 then 'ocr' end").alias("pdf_type"),
        E("slice(array(lang, 'eng', 'deu', 'fra'), 1, cast(doc_id % 5 as int))").alias("langs"),
        "lang",
    )


def pages(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.explode(E("sequence(0, page_count - 1)")).alias("page_no"))
    return rows.withColumns({"width": E("1200 + 100 * (page_no % 3)"), "height": F.lit(160000)})


def regions(docs: DataFrame) -> DataFrame:
    """Exclude and order boxes on the pages of every third document."""
    box = "named_struct('region_id', '{}', 'region_seq', {}, 'kind', '{}', 'ord', {}, 'l', {}, 't', {}, 'r', {}, 'b', {})"
    order = "cast(1 + doc_id % 5 as int)"
    every = [
        box.format("x0", 0, "exclude", "cast(null as int)", 0, 0, 600, 36),
        box.format("o0", 1, "order", order, 0, 40000, 1200, 79999),
    ]
    first = [
        box.format("x1", 2, "exclude", "cast(null as int)", 0, 0, 1200, 16),
        box.format("o1", 3, "order", "9", 0, 40000, 1200, 40400),
    ]
    found = E(
        f"case when page_no = 0 then array({', '.join(every + first)}) else array({', '.join(every)}) end"
    )
    rows = pages(docs.filter("doc_id % 3 = 0")).select("doc_id", "page_no", F.explode(found).alias("e"))
    return rows.select("doc_id", "page_no", "e.*")


def table_cols(docs: DataFrame) -> DataFrame:
    """A table of three columns over the third paragraph of the first page."""
    rows = docs.filter("page_count > 0").select(
        "doc_id", F.lit(0).alias("page_no"), F.lit("t0").alias("table_id"),
        E("case when doc_id % 2 = 0 then 'majority' else 'left' end").alias("rule"),
        E("case when doc_id % 7 = 0 then 'line' else 'word' end").alias("level"),
        F.explode(E("array(0, 1, 2)")).alias("col_no"),
    )
    return rows.withColumns(
        {
            "l": E("col_no * 400"), "t": F.lit(80000),
            "r": E("col_no * 400 + 400"), "b": F.lit(119999),
        }
    )


def annots(words: DataFrame) -> DataFrame:
    """Highlights on some words; groups cross lines and pages."""
    return words.filter("h in (20, 21)").select(
        "doc_id", "page_no", E("line_no * 12 + word_no").alias("annot_no"), "word_id",
        E("case when word_no <> 0 then concat(doc_id, '-', par_no div 3) end").alias("group_id"),
        *pins.BOX,
        E("case h when 20 then '#ffff00' else '#00ffff' end").alias("color"),
        F.lit(0.5).alias("opacity"),
        E("case when word_no % 2 = 0 then 'seen' end").alias("comment"),
    )


_SEQ = "cast(par_no as bigint) * 1000000 + (line_no % 2000) * 120 + word_no * 10"


def edits(words: DataFrame) -> DataFrame:
    """Style edits; later ones of a word replace or add to earlier ones."""
    edit = "named_struct('i', {}, 'field', '{}', 'value', {}, 'delta', {})"
    text, none, zero = "cast({} as string)", "cast(null as string)", "cast(null as double)"
    log = f"""array_compact(array(
      case h % 5
        when 0 then {edit.format(0, 'bold', "case when word_no % 2 = 0 then 'true' else 'false' end", zero)}
        when 1 then {edit.format(0, 'italic', "'true'", zero)}
        when 2 then {edit.format(0, 'font', "'Mono'", zero)}
        when 3 then {edit.format(0, 'size', text.format('8 + word_no'), zero)}
        else {edit.format(0, 'size', none, 'case when word_no % 2 = 0 then 1.0D else -1.0D end')} end,
      case h
        when 35 then {edit.format(1, 'bold', "'false'", zero)}
        when 36 then {edit.format(1, 'italic', "'false'", zero)}
        when 37 then {edit.format(1, 'font', "'Slab'", zero)}
        when 38 then {edit.format(1, 'size', none, '1.0D')}
        when 39 then {edit.format(1, 'size', "'20'", zero)} end,
      case h when 39 then {edit.format(2, 'size', none, '-1.0D')} end))"""
    rows = words.filter("h between 30 and 39").select(
        "doc_id", "word_id", E(_SEQ).alias("s"), F.explode(E(log)).alias("e")
    )
    return rows.select(
        (F.col("s") + F.col("e.i")).alias("seq"), "doc_id", "word_id", "e.field", "e.value", "e.delta"
    )


def highlight_ops(words: DataFrame) -> DataFrame:
    """Highlight operations: recolour, remove, comment, and both in turn."""
    op = "named_struct('i', {}, 'op', '{}', 'color', {}, 'opacity', {}, 'comment', {})"
    none, zero = "cast(null as string)", "cast(null as int)"

    def mark(i, color, opacity):
        return op.format(i, "highlight", f"'{color}'", opacity, none)

    def note(i, text):
        return op.format(i, "comment", none, zero, f"'{text}'")

    log = f"""case h
      when 20 then array({mark(0, 'none', 0)})
      when 21 then array({mark(0, '#00ff00', 40)}, {note(1, 'check')})
      when 22 then array({mark(0, '#ff0000', 80)}, {note(1, 'first')}, {note(2, 'second')})
      when 23 then array({mark(0, '#ff0000', 80)}, {mark(1, 'none', 80)})
      else array({mark(0, '#ff0000', 80)}, {note(1, 'lost')}, {mark(2, 'none', 80)}, {mark(3, '#0000ff', 30)}) end"""
    rows = words.filter("h between 20 and 24 and (h <> 21 or word_no % 3 <> 0)").select(
        "doc_id", "word_id", E(_SEQ).alias("s"), F.explode(E(log)).alias("e")
    )
    return rows.select(
        (F.col("s") + F.col("e.i")).alias("seq"), "doc_id", "word_id",
        "e.op", "e.color", "e.opacity", "e.comment",
    )


def baseline_edits(words: DataFrame) -> DataFrame:
    return words.filter("h between 40 and 44").select(
        E(_SEQ).alias("seq"), *pins.LINE_KEY, E("25 + (h + word_no) % 7 - 3").cast("int").alias("value")
    )


def new_words(words: DataFrame) -> DataFrame:
    """Hand-added words, half a word to the right of an existing one."""
    rows = words.filter("h = 60").drop("h")
    return rows.withColumns(
        {
            "word_id": E("concat('n', word_id)"), "text": F.lit("new"), "font": F.lit(None).cast("string"),
            "l": E("l + 50"), "r": E("r + 50"),
        }
    )


def with_chars(words: DataFrame) -> DataFrame:
    """Words with an array of character boxes: even steps, glyphs up to two pixels narrower."""
    style = E("case when bold then 'bold' when italic then 'italic' else 'normal' end")
    arrays = {
        "ch": E("split(text, '')"),
        "l": E("sequence(l, l + (n - 1) * step, step)"),
        "t": E("array_repeat(t, n)"),
        "r": E("sequence(l + step - n % 3, l + step - n % 3 + (n - 1) * step, step)"),
        "b": E("array_repeat(b - n % 5, n)"),
    }
    sized = words.withColumn("n", F.length("text")).withColumn("step", E("greatest((r - l) div n, 4)").cast("int"))
    return sized.select(
        *pins.WORD_KEY, "font", style.alias("style"),
        E("shiftleft(8, par_no % 3)").alias("x_height"),
        *[array.alias(name) for name, array in arrays.items()],
    ).select(*pins.WORD_KEY, "font", "style", "x_height", F.arrays_zip(*arrays).alias("chars"))
