"""Registered queries: every operator over the whole derived tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from ocrspark import pins
from ocrspark.functions import names, text as tx
from ocrspark.operators import (
    annotations, batch, edits, evaluate, flow, fonts, layout, search, search_index, selection, totals, versions,
)
from ocrspark.plans import derived as d
from ocrspark.plans.oracle import query
from ocrspark.operators.positions import prefix_sums
from ocrspark.session import scratch_dir, stack, stored
from ocrspark.sources import hocr, named, split, tables, version_store
from ocrspark.streaming import edits as edit_stream, ingest, progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
E = F.expr

ADDRESS = "doc_id, page_no, line_no, word_no"
STYLES = "bold, italic, small_caps, sup, underline, font, size"
STAT_SUMS = ", ".join(f"sum({c})::bigint as {c}" for c in evaluate.STATS)


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = query(sql)
        return fn

    return add


def _version(words: DataFrame, label: str) -> DataFrame:
    return words.withColumn("version", F.lit(label))


def _lines(s: SparkSession, p: str) -> DataFrame:
    return d.lines(d.gt_words(s, p))


def _regions(s: SparkSession, p: str) -> DataFrame:
    return d.regions(d.docs(s, p))


# -- sources and sinks -----------------------------------------------------------------------

ROUND_TRIP = f"{ADDRESS}, word_id, text, conf, lang, {STYLES}, l, t, r, b"
_RR = ROUND_TRIP
for _c in ("page_no", "line_no", "word_no"):
    _RR = _RR.replace(_c, f"{_c}::int as {_c}")


@register("s1_read_hocr", f"select {_RR} from rr")
def _(s, p):
    path = scratch_dir(s, "hocr")
    hocr.write_hocr(hocr.hocr_records(d.gt_words(s, p), parts=d.parts(s, p)), path, compression="gzip")
    words = hocr.words(hocr.read_hocr(s, path, whole=False, level="words"))
    return words.withColumn("doc_id", F.col("doc_id").cast("long")).select(*ROUND_TRIP.split(", "))


def _records(s, p) -> DataFrame:
    words = d.gt_words(s, p)
    return hocr.hocr_records(words, d.lines(words), d.pages(d.docs(s, p)), parts=d.parts(s, p))


def _reparsed(records: DataFrame, level: str = "chars") -> DataFrame:
    raw = records.select(F.lit("mem").alias("file"), F.col("hocr").alias("value"))
    return hocr.with_doc_id(hocr.parse_hocr(raw, level=level))


@register(
    "s2_flatten_pages",
    "select doc_id, page_no, page_no as ppageno, width, height from pg",
)
def _(s, p):
    pages = hocr.pages(_reparsed(_records(s, p), "pages"))
    return pages.select(
        F.col("doc_id").cast("long").alias("doc_id"), "page_no", "ppageno", "width", "height"
    )


@register(
    "s7_write_hocr",
    """select doc_id, page_no,
       (row_number() over (partition by doc_id, page_no order by line_no) - 1)::int as line_no,
       l, t, r, b, slope, "offset"::double as "offset", x_height::double as x_x_height from lines""",
)
def _(s, p):
    lines = hocr.lines(_reparsed(_records(s, p), "lines"))
    return lines.select(
        F.col("doc_id").cast("long").alias("doc_id"), "page_no", "line_no", *pins.BOX,
        "slope", "offset", "x_x_height",
    )


@register(
    "s3_read_meta",
    "select doc_id, page_no, region_id, (row_number() over (partition by doc_id, page_no order by region_seq)"
    " - 1)::int as region_seq, kind, ord, l, t, r, b from regions",
)
def _(s, p):
    layout_meta = hocr.layout_json(_regions(s, p))
    records = hocr.hocr_records(d.gt_words(s, p), layout=layout_meta, parts=d.parts(s, p))
    return hocr.regions(hocr.read_meta(_reparsed(records, "head"))).withColumn("doc_id", F.col("doc_id").cast("long"))


@register(
    "s4_with_version",
    f"select {ADDRESS}, text, conf, 'Engine A' as version from gt"
    f" union all select {ADDRESS}, text, conf, 'Engine B' from ocr",
)
def _(s, p):
    cols = [*pins.WORD_KEY, "text", "conf"]
    words = _version(d.gt_words(s, p).select(*cols), "Engine A")
    return tables.with_version(words, d.ocr_words(s, p).select(*cols), "Engine B")


CSV_COLS = f"{ADDRESS}, word_id, text, conf, lang, font, l, t, r, b"


@register("s5_words_csv", f"select {CSV_COLS} from ocr")
def _(s, p):
    path = scratch_dir(s, "csv")
    words = d.ocr_words(s, p).select(*CSV_COLS.split(", "))
    tables.write_words_csv(words, path)
    return tables.read_words_csv(s, path, words.schema)


@register(
    "s6_export_text",
    """select d.doc_id, coalesce(x.text, '') as text from docs d left join (
         select doc_id, string_agg(text, chr(10) order by page_no) as text from (
           select doc_id, page_no, string_agg(text, chr(10) order by line_no) as text from (
             select doc_id, page_no, line_no, string_agg(text, ' ' order by word_no) as text
             from gt group by all) group by all) group by all) x on d.doc_id = x.doc_id""",
)
def _(s, p):
    return tables.export_text(d.gt_words(s, p), d.docs(s, p))


@register(
    "s6_page_text_reflow",
    "select doc_id, page_no, string_agg(text, chr(10) order by par_no) as text from pars group by all",
)
def _(s, p):
    return tables.page_text(d.gt_words(s, p), reflow=True)


@register("s8_project", f"select {ADDRESS}, text, {STYLES}, l, t, r, b from gt")
def _(s, p):
    path = scratch_dir(s, "project")
    words = d.gt_words(s, p)
    project = {
        "words": words.select(*f"{ADDRESS}, text, {STYLES}, l, t, r, b".split(", ")),
        "lines": d.lines(words),
        "regions": _regions(s, p),
    }
    tables.save_project(project, path)
    return tables.load_project(s, path, {n: t.schema for n, t in project.items()})["words"]


def _batch_input(s, p) -> DataFrame:
    """Documents as file contents; three in ten are damaged, each in another way."""
    records = hocr.hocr_records(d.gt_words(s, p), parts=d.parts(s, p)).join(
        d.docs(s, p).select("doc_id", E("concat('in/', file_name)").alias("file")), "doc_id"
    )
    damaged = E(
        "case doc_id % 10 when 7 then replace(hocr, 'html', 'htm') "
        "when 8 then left(hocr, length(hocr) - 9) when 9 then replace(hocr, '</div>', '') else hocr end"
    )
    return records.select("file", damaged.alias("value"))


@register(
    "s9_batch_convert",
    r"""select 'in/' || file_name as file, case when m < 7 then 'Done' else 'Error' end as status,
        case when m in (7, 8) then 'no document' when m = 9 then 'malformed' end as reason,
        case when m < 7 then regexp_replace(file_name, '\.\w{1,6}$', '') || '.txt' end as output,
        case when m < 7 then 1 else 0 end::bigint as documents
        from (select *, doc_id % 10 as m from docs where doc_id in (select doc_id from gt))""",
)
def _(s, p):
    return batch.manifest(batch.parse_batch(_batch_input(s, p)), "txt")


@register(
    "s9_convert_text",
    r"""select regexp_replace(file_name, '\.\w{1,6}$', '') || '.txt' as name,
        string_agg(text, chr(10) order by page_no) as value from (
          select doc_id, page_no, string_agg(text, chr(10) order by line_no) as text from (
            select doc_id, page_no, line_no, string_agg(text, ' ' order by word_no) as text from gt group by all) group by all) t
        join docs using (doc_id) where doc_id % 10 < 7 group by all""",
)
def _(s, p):
    path = scratch_dir(s, "converted")
    batch.convert(partial(batch.parse_batch, _batch_input(s, p)), path, "txt")
    files = s.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("name"), "value")


@register(
    "s9_convert_hocr",
    r"""select regexp_replace(file_name, '\.\w{1,6}$', '') || '.hocr' as name, doc_id, page_no::int as page_no,
        (dense_rank() over (partition by doc_id, page_no order by line_no) - 1)::int as line_no,
        (row_number() over (partition by doc_id, page_no, line_no order by word_no) - 1)::int as word_no,
        word_id, text, conf, lang, par_lang, font, bold, italic, underline, size, l, t, r, b
        from gt join (select doc_id, file_name from docs) using (doc_id) where doc_id % 10 < 7""",
)
def _(s, p):
    path = scratch_dir(s, "converted")
    # files as they lie in a store: the conversion reads them once for every table
    batch.convert(partial(batch.parse_batch, stored(_batch_input(s, p), "files")), path, "hocr")
    docs = hocr.read_hocr(s, path, level="words").withColumn("doc_id", F.struct("file", "doc_id"))
    return hocr.words(docs).select(
        F.regexp_extract("doc_id.file", "([^/]*)$", 1).alias("name"), F.col("doc_id.doc_id").cast("long").alias("doc_id"),
        "page_no", "line_no", "word_no", "word_id", "text", "conf", "lang", "par_lang", "font", "bold", "italic", "underline", "size", *pins.BOX,
    )


def _one_document(s, p) -> tuple[DataFrame, DataFrame]:
    """All words as one document ``all``, which is the first table: the pages of all documents in a row, numbered through.

    Words keep the ``doc_id`` that they are dealt by, so their pages are built up where they are.
    """
    words = d.gt_words(s, p)
    pages = words.select(F.lit(1).alias("one"), "doc_id", "page_no").distinct().withColumn("n", F.lit(1))
    number = prefix_sums(pages, ["one"], ["doc_id", "page_no"], "n").select("doc_id", "page_no", F.col("before").cast("int").alias("at"))
    number = stored(number, "numbers")
    numbered = words.join(number, list(pins.PAGE_KEY)).withColumn("page_no", F.col("at")).drop("at")
    return number.select(F.lit("all").alias("doc_id")).limit(1), numbered


@register(
    "s2_split_pages",
    """select (dense_rank() over (order by doc_id, page_no) - 1)::int as page_no,
       (dense_rank() over (partition by doc_id, page_no order by line_no) - 1)::int as line_no,
       (row_number() over (partition by doc_id, page_no, line_no order by word_no) - 1)::int as word_no, word_id, text, par_lang, l, t, r, b from gt""",
)
def _(s, p):
    path = scratch_dir(s, "large")
    docs, words = _one_document(s, p)
    pieces = hocr.hocr_pieces(docs, words, parts=d.parts(s, p)).withColumn("name", F.lit("all.hocr"))
    named.write_named(pieces, path, ["piece"], sep="\n")
    _, pages = split.read_hocr_pages(s, path)
    return hocr.words(pages).select("page_no", "line_no", "word_no", "word_id", "text", "par_lang", *pins.BOX)


def _nested_records(s, p) -> DataFrame:
    """Documents with all levels: content areas, paragraphs with a language, lines, words, characters, head metadata."""
    words = d.gt_words(s, p)
    named_pars = words.withColumn("par_id", E("concat('par_', par_no)"))
    lines = d.lines(words).withColumns({
        "carea_id": E("concat('area_', par_no div 2)"), "par_id": E("concat('par_', par_no)"), "x_size": E("x_height * 2 + 0.5D"),
        "x_descenders": E("x_height / 4D"), "x_ascenders": E("x_height / 2D"), "x_asc_height": E("x_height + 1D"),
    })
    langs = words.groupBy(*pins.LINE_KEY).agg(F.max("par_lang").alias("par_lang"))
    lines = lines.join(langs, list(pins.LINE_KEY))
    chars = d.with_chars(words).select(*pins.WORD_KEY, F.posexplode("chars").alias("char_no", "c"))
    chars = chars.select(*pins.WORD_KEY, "char_no", E("(char_no % 100) + 0.5D").alias("conf"), "c.*")
    docs = d.docs(s, p)
    regions, cols = hocr.layout_json(d.regions(docs)), hocr.tables_json(d.table_cols(docs))
    head = stack(
        hocr.head_rows(regions), hocr.head_rows(cols),
        hocr.head_rows(docs.select("doc_id", F.lit("Serif").alias("default_font"), _font_metrics().alias("font_metrics"))),
    )
    return hocr.hocr_records(named_pars, lines, d.pages(docs), chars=chars, head=head, parts=d.parts(s, p))


def _font_metrics():
    """One font per document with two glyphs, in the shape of the head metadata."""
    style = "named_struct('width', map('65', doc_id % 7 + 0.5D), 'height', map('65', 1.5D), 'obs', cast(doc_id % 9 as int))"
    return F.from_json(E(f"to_json(map('Serif', named_struct('normal', {style}, 'obs', 3)))"), hocr.FONT_METRICS_SCHEMA)


@register(
    "s7_nested_lines",
    """select doc_id, page_no, (row_number() over (partition by doc_id, page_no order by line_no) - 1)::int as line_no,
       'area_' || (par_no // 2) as carea_id, 'par_' || par_no as par_id, par_lang, l, t, r, b, slope, "offset"::double as "offset",
       x_height * 2 + 0.5e0 as x_size, x_height / 4e0 as x_descenders, x_height / 2e0 as x_ascenders, x_height::double as x_x_height,
       x_height + 1e0 as x_asc_height
       from lines join (select doc_id, page_no, line_no, max(par_lang) as par_lang from gt group by all) using (doc_id, page_no, line_no)""",
)
def _(s, p):
    lines = hocr.lines(_reparsed(_nested_records(s, p), "lines"))
    return lines.withColumn("doc_id", F.col("doc_id").cast("long"))


@register(
    "s7_nested_chars",
    """select doc_id, page_no, (dense_rank() over (partition by doc_id, page_no order by line_no) - 1)::int as line_no,
       (dense_rank() over (partition by doc_id, page_no, line_no order by word_no) - 1)::int as word_no, word_id,
       (i - 1)::int as char_no, substr(text, i, 1) as ch, (i - 1) % 100 + 0.5e0 as conf, (l + (i - 1) * step)::int as l, t,
       (l + i * step - n % 3)::int as r, (b - n % 5)::int as b
       from (select *, length(text) as n, greatest((r - l) // length(text), 4) as step from gt) g, unnest(range(1, n + 1)) x(i)""",
)
def _(s, p):
    chars = hocr.chars(_reparsed(_nested_records(s, p)))
    return chars.withColumn("doc_id", F.col("doc_id").cast("long"))


@register(
    "s7_nested_langs",
    """select doc_id, lang, n, n::double / sum(n) over (partition by doc_id) as share from (
         select doc_id, coalesce(lang, par_lang) as lang, count(*) as n from gt group by all)""",
)
def _(s, p):
    words = hocr.words(_reparsed(_nested_records(s, p), "attributes")).withColumn("doc_id", F.col("doc_id").cast("long"))
    return selection.lang_mix(words)


@register(
    "s3_nested_head",
    """select doc_id, 'Serif' as font, doc_id % 7 + 0.5e0 as width, (doc_id % 9)::int as obs, c.col_no, c.rule, c.l, c.r
       from docs left join cols c using (doc_id)""",
)
def _(s, p):
    # used twice, and a record is much larger than its head
    meta = stored(hocr.read_meta(_reparsed(_nested_records(s, p), "head")), "meta").withColumn("doc_id", F.col("doc_id").cast("long"))
    fonts_of = meta.select("doc_id", F.explode("font_metrics").alias("font", "m")).select(
        "doc_id", "font", F.col("m.normal.width")["65"].alias("width"), F.col("m.normal.obs").alias("obs")
    )
    columns = hocr.table_columns(meta).select("doc_id", "col_no", "rule", "l", "r")
    return fonts_of.join(columns, "doc_id", "left")


_RANGE = r"""select doc_id, least(lo, hi)::int as min_page, hi::int as max_page, case
    when least(lo, hi) > 1 or hi < page_count then ' Pages: ' || least(lo, hi) || '–' || hi
    else ' Pages: All' end as label from (
  select doc_id, page_count, case when a is null or a < 1 or a > page_count then 1 else a end as lo,
    case when z is null or z < 1 or z > page_count then page_count else z end as hi from (
    select doc_id, page_count,
      case doc_id % 5 when 0 then null when 1 then 0 when 2 then 2 when 3 then 2 else -1 end as a,
      case doc_id % 7 when 0 then null when 1 then 2 when 2 then 1 when 3 then 3 else 0 end as z from docs))"""


def _clamped(s, p) -> DataFrame:
    first = E("case doc_id % 5 when 0 then 'abc' when 1 then '0' when 2 then '2x' when 3 then ' 2' else '-1' end")
    last = E("case doc_id % 7 when 0 then '' when 1 then '2' when 2 then '1' when 3 then '3.9' else '0' end")
    return selection.clamp_pages(d.docs(s, p), first, last)


@register(
    "s10_page_range",
    f"select {ADDRESS}, text from gt join ({_RANGE}) x using (doc_id) where page_no + 1 between min_page and max_page",
)
def _(s, p):
    words = d.gt_words(s, p).select(*pins.WORD_KEY, "text")
    return selection.page_range(words, _clamped(s, p))


# -- projections and filters -----------------------------------------------------------------

register("p1_clamp_pages", _RANGE)(_clamped)


@register(
    "p2_conf_band",
    f"select {ADDRESS}, conf, case when conf > 85 then 'high' when conf > 75 then 'med' else 'low' end as band from ocr",
)
def _(s, p):
    return selection.conf_band(d.ocr_words(s, p).select(*pins.WORD_KEY, "conf"))


@register("p3_norm", f"select {ADDRESS}, NORM(text) as norm from ocr")
def _(s, p):
    return d.ocr_words(s, p).select(*pins.WORD_KEY, tx.norm(F.col("text")).alias("norm"))


# Quotes are put into the text, as the source has few.
@register(
    "p4_smart_quotes",
    r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(q,
          '(^|[\s(\[{])"', '\1“', 'g'), '"', '”', 'g'), '(^|[\s(\[{“])''', '\1‘', 'g'), '''', '’', 'g') as text
        from (select doc_id, replace(replace(text, 'a', ''''), 'e ', '" "') as q from documents)""",
)
def _(s, p):
    quoted = F.replace(F.replace("text", F.lit("a"), F.lit("'")), F.lit("e "), F.lit('" "'))
    return d.documents(s, p).select("doc_id", tx.smart_quotes(quoted).alias("text"))


@register(
    "p5_highlight_rect",
    f"select {ADDRESS}, l::double as x, t - (b - t) * 0.2e0 as y, (r - l)::double as width,"
    " (b - t) + (b - t) * 0.2e0 * 2 as height from gt",
)
def _(s, p):
    words = selection.highlight_rect(d.gt_words(s, p))
    return words.select(*pins.WORD_KEY, "x", "y", "width", "height")


@register(
    "p6_remove_margins",
    f"select {ADDRESS}, l - min(l) over w as l, t - min(t) over w as t, r - min(l) over w as r,"
    " b - min(t) over w as b from ocr window w as (partition by doc_id, page_no)",
)
def _(s, p):
    words = d.ocr_words(s, p).select(*pins.WORD_KEY, *pins.BOX)
    return selection.remove_margins(words)


@register(
    "p7_standardize_pages",
    f"""select {", ".join("w." + c for c in ADDRESS.split(", "))},
        floor(l * k + 0.5)::int as l, floor(t * k + 0.5)::int as t, floor(r * k + 0.5)::int as r,
        floor(b * k + 0.5)::int as b from gt w join (
          select doc_id, page_no, max(width) over (partition by doc_id)::double / width as k from pg) x
        on w.doc_id = x.doc_id and w.page_no = x.page_no""",
)
def _(s, p):
    words = d.gt_words(s, p).select(*pins.WORD_KEY, *pins.BOX)
    return selection.standardize_pages(words, d.pages(d.docs(s, p))).drop("scale")


@register(
    "p8_out_name",
    r"""select doc_id, fmt, regexp_replace(file_name, '\.\w{1,6}$', '') || '.' || case when fmt = 'alto' then 'xml'
        when fmt = 'project' and not pdf_mode then 'project.json' else fmt end as output,
        regexp_replace(file_name, '\.\w{1,6}$', '') || '_' ||
          case when length(page_count::varchar) < 3 then lpad(page_count::varchar, 3, '0')
          else page_count::varchar end || '.png' as image
        from docs, (select unnest(['pdf', 'hocr', 'alto', 'txt', 'md', 'project']) as fmt)""",
)
def _(s, p):
    formats = F.explode(F.array(*[F.lit(x) for x in ("pdf", "hocr", "alto", "txt", "md", "project")]))
    rows = d.docs(s, p).withColumn("fmt", formats)
    return rows.select(
        "doc_id", "fmt",
        names.out_name(F.col("file_name"), F.col("fmt"), F.col("pdf_mode")).alias("output"),
        names.image_name(names.base_name(F.col("file_name")), F.col("page_count")).alias("image"),
    )


@register(
    "p9_kv_map",
    f"""select doc_id, key, arg_max(value, par) as value from (
          select doc_id, par, case when instr(x, ' ') > 0 then substring(x, 1, instr(x, ' ') - 1) else x end as key,
            case when instr(x, ' ') > 0 then substring(x, instr(x, ' ') + 1) else '' end as value
          from (select doc_id, par, regexp_replace(line, '^{pins.TRIM_CLASS}+|{pins.TRIM_CLASS}+$', '', 'g') as x
                from ln) where x <> '') group by all""",
)
def _(s, p):
    return selection.kv_map(d.documents(s, p))


@register(
    "p10_lang_label",
    """select doc_id, 'Lang: ' || array_to_string(list_transform(case when len(langs) = 0 then ['eng'] else langs end,
         lambda x: upper(x[1]) || substring(x, 2)), '+') as label, len(langs) > 2 as warn from docs""",
)
def _(s, p):
    langs = F.col("langs")
    return d.docs(s, p).select(
        "doc_id", names.lang_label(langs).alias("label"), names.many_langs(langs).alias("warn")
    )


@register(
    "p11_route",
    """select doc_id, (xml0 and not image_mode and not pdf_mode) or coalesce(pdf_mode and pdf_type = 'text', false) as skip,
       case when pdf_mode and pdf_type in ('text', 'ocr') then 'supp' else 'none' end as embedded_text from docs""",
)
def _(s, p):
    return selection.route(d.docs(s, p), use_main=False, use_supp=True)


@register(
    "p12_word_address",
    "select doc_id, page_no, line_no, word_no from gt where word_id = 'w1_3'",
)
def _(s, p):
    return selection.word_address(d.gt_words(s, p), "w1_3")


# -- joins -----------------------------------------------------------------------------------


@register(
    "j1_overlap_join",
    "select a.doc_id, a.page_no, a.line_no, e.region_id, OVERLAP(a, e) as overlap from lines a join regions e"
    " on a.doc_id = e.doc_id and a.page_no = e.page_no where OVERLAP(a, e) > 0.5",
)
def _(s, p):
    hits = layout.line_regions(_lines(s, p), _regions(s, p))
    return hits.select(*pins.LINE_KEY, "region_id", "overlap")


@register(
    "j2_excluded_text",
    """select x.doc_id, x.page_no, x.line_no, x.region_id, string_agg(w.text, ' ' order by w.word_no) || ' ' as text
       from hits x join gt w on x.doc_id = w.doc_id and x.page_no = w.page_no and x.line_no = w.line_no
       where kind = 'exclude' group by all""",
)
def _(s, p):
    words = d.gt_words(s, p)
    return layout.excluded_text(words, d.lines(words), _regions(s, p))


@register(
    "j3_line_priority",
    """select n.doc_id, n.page_no, n.line_no, coalesce(m.ord, 10) as priority from lines n left join marks m
       on n.doc_id = m.doc_id and n.page_no = m.page_no and n.line_no = m.line_no""",
)
def _(s, p):
    return layout.line_priority(_lines(s, p), _regions(s, p))


_REORDERED = """select w.doc_id, w.page_no, w.line_no, w.word_no, w.text, coalesce(m.ord, 10) as priority
    from gt w left join marks m on w.doc_id = m.doc_id and w.page_no = m.page_no and w.line_no = m.line_no
    where not coalesce(m.excluded, false)"""


@register(
    "j4_reorder",
    f"""select doc_id, page_no, string_agg(text, chr(10) order by priority, line_no) as text from (
          select doc_id, page_no, line_no, priority, string_agg(text, ' ' order by word_no) as text
          from ({_REORDERED}) group by all) group by all""",
)
def _(s, p):
    words = d.gt_words(s, p)
    kept = layout.reorder(words.select(*pins.WORD_KEY, "text"), d.lines(words), _regions(s, p))
    return tables.page_text(kept)


@register(
    "j5_extract_tables",
    "select doc_id, page_no, line_no, table_id, col_no, string_agg(text, ' ' order by word_no) as text"
    " from cells group by all",
)
def _(s, p):
    words = d.gt_words(s, p)
    return layout.extract_tables(words, d.table_cols(d.docs(s, p)), d.lines(words))


@register(
    "j5_pivot_tables",
    """select c.doc_id, page_no, line_no, table_id, string_agg(text, ' ' order by word_no) filter (col_no = 0) as c0,
       string_agg(text, ' ' order by word_no) filter (col_no = 1) as c1,
       string_agg(text, ' ' order by word_no) filter (col_no = 2) as c2, page_no + 1 as page, file_name
       from cells c join docs d on c.doc_id = d.doc_id group by all""",
)
def _(s, p):
    words, docs = d.gt_words(s, p), d.docs(s, p)
    cells = layout.extract_tables(words, d.table_cols(docs), d.lines(words))
    return layout.pivot_tables(cells, 3, docs)


@register(
    "j6_propagate_layout",
    """select e.* from regions e join docs d on e.doc_id = d.doc_id
         where not (page_count >= 2 and page_no between 1 and least(3, page_count) - 1)
       union all
       select g.doc_id, g.page_no, region_id, region_seq, kind, ord, l, t, r, b
         from pg g join docs d on g.doc_id = d.doc_id join regions e on e.doc_id = g.doc_id and e.page_no = 0
         where page_count >= 2 and g.page_no between 1 and least(3, page_count) - 1""",
)
def _(s, p):
    docs = d.docs(s, p)
    return layout.propagate_layout(d.regions(docs), d.pages(docs), docs, 0, "2", "3")


@register(
    "j7_drop_regions",
    "select * from regions where not (kind = 'exclude' and (doc_id + page_no) % 2 = 0)",
)
def _(s, p):
    regions = _regions(s, p)
    ids = regions.filter("kind = 'exclude' and (doc_id + page_no) % 2 = 0")
    return layout.drop_regions(regions, ids)


_SPREAD_COLS = """(select * from cols union all
    select g.doc_id, g.page_no, table_id, rule, level, col_no, l, t, r, b
      from pg g join docs d on g.doc_id = d.doc_id join cols c on c.doc_id = g.doc_id
      where page_count >= 2 and g.page_no between 1 and least(3, page_count) - 1)"""


def _spread_cols(s: SparkSession, p: str) -> DataFrame:
    docs = d.docs(s, p)
    return layout.propagate_layout(d.table_cols(docs), d.pages(docs), docs, 0, "2", "3")


@register("j6_propagate_tables", f"select * from {_SPREAD_COLS}")
def _(s, p):
    return _spread_cols(s, p)


@register("j7_drop_tables", f"select * from {_SPREAD_COLS} where (doc_id + page_no) % 2 <> 0")
def _(s, p):
    cols = _spread_cols(s, p)
    return layout.drop_tables(cols, cols.filter("(doc_id + page_no) % 2 = 0 and col_no = 0"))


@register("j8_delete_words", f"select {ADDRESS}, word_id from gt where h not between 50 and 54")
def _(s, p):
    words = d.gt_words(s, p)
    ids = words.filter("h between 50 and 54")
    return edits.delete_words(words.select(*pins.WORD_KEY, "word_id"), ids)


_EDITED = f"""select {ADDRESS}, coalesce(v_bold::boolean, bold) as bold, coalesce(v_italic::boolean, italic) as italic,
    small_caps, sup, underline, coalesce(v_font, font) as font,
    coalesce(v_size::double, size) + coalesce(step, 0e0) as size from edited"""
EDIT_COLS = [*pins.WORD_KEY, *pins.STYLE_FLAGS, "font", "size"]


@register("j9_apply_edits", _EDITED)
def _(s, p):
    words = d.gt_words(s, p)
    out = edits.apply_edits(words.select(*EDIT_COLS, "word_id"), d.edits(words))
    return out.select(*EDIT_COLS)


@register(
    "j10_apply_highlights",
    # replayed one operation at a time
    """select doc_id, word_id, color, opacity, comment from (
         with recursive step as (
           select *, row_number() over (partition by doc_id, word_id order by seq) as k from ops),
         state as (
           select w.doc_id, w.word_id, 0::bigint as k, a.color, a.opacity::double as opacity, a.comment
           from (select doc_id, word_id from annots union select doc_id, word_id from ops) w
           left join annots a on a.doc_id = w.doc_id and a.word_id = w.word_id
           union all
           select s.doc_id, s.word_id, o.k,
             case o.op when 'highlight' then nullif(o.color, 'none') else s.color end,
             case when o.op <> 'highlight' then s.opacity when o.color <> 'none' then o.opacity / 100e0 end,
             case when o.op = 'comment' and s.color is not null then o.comment
               when o.op = 'comment' or o.color <> 'none' then s.comment end
           from state s join step o on o.doc_id = s.doc_id and o.word_id = s.word_id and o.k = s.k + 1)
         select * from state qualify k = max(k) over (partition by doc_id, word_id))
       where color is not null""",
)
def _(s, p):
    words = d.gt_words(s, p)
    return annotations.apply_highlights(d.annots(words), d.highlight_ops(words))


@register(
    "j11_adjust_baseline",
    """select n.doc_id, n.page_no, n.line_no, (n."offset" + coalesce(x.moved, 0))::int as "offset" from lines n left join (
         select doc_id, page_no, line_no, sum(value - prev) as moved from (
           select doc_id, page_no, line_no, value,
             lag(value, 1, 25) over (partition by doc_id, page_no, line_no order by s) as prev
           from (select *, SEQ as s, 25 + (h + word_no) % 7 - 3 as value from gt where h between 40 and 44))
         group by all) x on n.doc_id = x.doc_id and n.page_no = x.page_no and n.line_no = x.line_no""",
)
def _(s, p):
    words = d.gt_words(s, p)
    moved = edits.adjust_baseline(d.lines(words), d.baseline_edits(words))
    return moved.select(*pins.LINE_KEY, "offset")


@register(
    "j12_align",
    "select doc_id, page_no, gl as g_line_no, gw as g_word_no, ol as o_line_no, ow as o_word_no from best",
)
def _(s, p):
    pairs = evaluate.align(d.gt_words(s, p), d.ocr_words(s, p))
    return pairs.select(*pins.PAGE_KEY, "g_line_no", "g_word_no", "o_line_no", "o_word_no")


COMBINED = f"{ADDRESS}, word_id, text, conf, l, t, r, b, source"


@register(
    "j13_combine_data",
    f"""select doc_id, page_no, case when q then ol else gl end as line_no, case when q then ow else gw end as word_no,
          case when q then o_id else g_id end as word_id, case when q then ocr_text else gt_text end as text,
          case when q then ocr_conf else gt_conf end as conf, case when q then o_l else g_l end as l,
          case when q then o_t else g_t end as t, case when q then o_r else g_r end as r,
          case when q then o_b else g_b end as b, case when q then 'b' else 'a' end as source
          from (select *, ocr_conf > gt_conf as q from al)
        union all select {COMBINED.replace("source", "'a'")} from lone_gt
        union all select {COMBINED.replace("source", "'b'")} from lone_ocr""",
)
def _(s, p):
    return evaluate.combine(d.gt_words(s, p), d.ocr_words(s, p), "data")


@register(
    "j13_combine_conf",
    f"""select doc_id, page_no, gl as line_no, gw as word_no, g_id as word_id, gt_text as text,
          case when gt_text = ocr_text then greatest(gt_conf, ocr_conf) else least(gt_conf, ocr_conf) end as conf,
          g_l as l, g_t as t, g_r as r, g_b as b, 'a' as source from al
        union all select {COMBINED.replace("source", "'a'")} from lone_gt""",
)
def _(s, p):
    return evaluate.combine(d.gt_words(s, p), d.ocr_words(s, p), "conf")


@register(
    "j14_conflicts",
    "select doc_id, page_no, gl as line_no, gw as word_no, gt_text as a_text, ocr_text as b_text,"
    " gt_conf as a_conf, ocr_conf as b_conf from al where not same",
)
def _(s, p):
    return evaluate.conflicts(d.gt_words(s, p), d.ocr_words(s, p))


@register(
    "j15_add_words",
    """select doc_id, page_no, line_no, case when touched then (row_number() over (partition by doc_id, page_no, line_no
         order by l, fresh, word_no, word_id) - 1)::int else word_no end as word_no, word_id, text, l, r from (
         select *, max(fresh) over (partition by doc_id, page_no, line_no) = 1 as touched from (
           select doc_id, page_no, line_no, word_no, word_id, text, l, r, 0 as fresh from gt union all
           select doc_id, page_no, line_no, word_no, 'n' || word_id, 'new', l + 50, r + 50, 1 from gt where h = 60))""",
)
def _(s, p):
    words = d.gt_words(s, p)
    out = edits.add_words(words.drop("h"), d.new_words(words))
    return out.select(*pins.WORD_KEY, "word_id", "text", "l", "r")


# -- evaluation and aggregation --------------------------------------------------------------


@register("e1_word_status", f"select {ADDRESS}, gt_text, ocr_text, conf, status from status")
def _(s, p):
    return evaluate.word_status(d.gt_words(s, p), d.ocr_words(s, p))


def _stats(s, p) -> DataFrame:
    return evaluate.eval_versions(d.gt_words(s, p), d.ocr_words(s, p))


register("e2_eval_page", f"select doc_id, page_no, {', '.join(evaluate.STATS)} from stats")(_stats)


@register(
    "e3_eval_doc",
    f"select doc_id, page_no, grouping(doc_id, page_no)::int as level, {STAT_SUMS} from stats"
    " group by rollup (doc_id, page_no)",
)
def _(s, p):
    return evaluate.eval_doc(_stats(s, p))


def _compared(s: SparkSession, p: str, operator, **options) -> DataFrame:
    """``operator`` over both versions, each stored by page first."""
    # texts are dealt to the buckets, then cut into words
    store = version_store.create(d.gt_words(s, p, 0), scratch_dir(s, "versions"))
    for words, label in ((d.gt_words, pins.GROUND_TRUTH), (d.ocr_words, "Engine B")):
        version_store.store_version(store, words(s, p, 0), label, dealt=words(s, p, store.buckets))
    return version_store.compare(store, pins.GROUND_TRUTH, "Engine B", operator, **options)


def _same_as(name: str, stored_name: str, operator, **options) -> None:
    QUERIES[stored_name] = lambda s, p: _compared(s, p, operator, **options)
    ORACLE[stored_name] = ORACLE[name]


_same_as("e1_word_status", "e1_status_stored", evaluate.word_status)
_same_as("e2_eval_page", "e2_eval_stored", evaluate.eval_versions)
_same_as("j13_combine_data", "j13_combine_stored", evaluate.combine, mode="data")
_same_as("j14_conflicts", "j14_conflicts_stored", evaluate.conflicts)


@register(
    "e3_totals_corrected",
    f"""select doc_id, (case grouping(doc_id) when 1 then 3 else 1 end)::int as level, count(*)::bigint as pages, {STAT_SUMS}
        from stats where doc_id % 11 <> 4 group by rollup (doc_id)""",
)
def _(s, p):
    path = scratch_dir(s, "totals")
    right = stored(_stats(s, p), "page-stats")
    # a third of the documents arrives with other counts, some with a page too many, and is corrected in two batches
    wrong = right.filter("doc_id % 3 = 0").withColumns({"total": F.col("total") + 7, "missed": F.col("missed") * 2 + 1})
    extra = right.filter("doc_id % 7 = 0").withColumn("page_no", F.col("page_no") + 100_000)
    totals.apply_corrections(stack(right.filter("doc_id % 3 <> 0"), wrong, extra), path, 0)
    totals.apply_corrections(right.filter("doc_id % 6 = 0"), path, 1, removed=extra)
    totals.apply_corrections(right.filter("doc_id % 3 = 0"), path, 2, removed=right.filter("doc_id % 11 = 4 and doc_id % 3 <> 0"))
    totals.apply_corrections(right.limit(0), path, 3, removed=right.filter("doc_id % 11 = 4"))
    return totals.totals(s, path)


_WER = """select doc_id, page_no, (incorrect + missed + extra)::double / nullif(total, 0) as wer,
    (incorrect + missed)::double / nullif(total, 0) as wer_no_extra from stats"""


@register("e4_wer", _WER)
def _(s, p):
    stats = evaluate.wer(_stats(s, p))
    both = evaluate.wer(stats.withColumnRenamed("wer", "wer_all"), ignore_extra=True)
    return both.select(*pins.PAGE_KEY, F.col("wer_all").alias("wer"), F.col("wer").alias("wer_no_extra"))


@register(
    "a1_common_value",
    "select doc_id, page_no, case when min(font) = max(font) and count(font) = count(*) then min(font) else '' end"
    " as font from gt group by all",
)
def _(s, p):
    return selection.common_value(d.gt_words(s, p), "font", list(pins.PAGE_KEY))


_BOX_SQL = "min(l) as l, min(t) as t, max(r) as r, max(b) as b"


@register(
    "a2_union_box",
    f"""select 'line' as kind, doc_id, page_no, line_no::varchar as id, {_BOX_SQL} from gt group by all
        union all select 'par', doc_id, page_no, par_no::varchar, {_BOX_SQL} from gt group by all
        union all select 'group', doc_id, page_no, group_id, {_BOX_SQL} from annots where group_id is not null group by all""",
)
def _(s, p):
    words = d.gt_words(s, p)
    grouped = d.annots(words).filter("group_id is not null")
    out = None
    for kind, rows, key in (("line", words, "line_no"), ("par", words, "par_no"), ("group", grouped, "group_id")):
        boxes = selection.union_boxes(rows, [*pins.PAGE_KEY, key])
        boxes = boxes.select(F.lit(kind).alias("kind"), *pins.PAGE_KEY, F.col(key).cast("string").alias("id"), *pins.BOX)
        out = boxes if out is None else stack(out, boxes)
    return out


@register(
    "a3_lang_mix",
    """select doc_id, lang, n, n::double / sum(n) over (partition by doc_id) as share from (
         select doc_id, coalesce(lang, par_lang) as lang, count(*) as n from gt group by 1, 2)""",
)
def _(s, p):
    return selection.lang_mix(d.gt_words(s, p))


def _named_versions(s, p) -> DataFrame:
    """Both versions and, for some documents, internal and active ones."""
    key = ["doc_id", "version"]
    gt, ocr = d.gt_words(s, p), d.ocr_words(s, p)
    rows = _version(gt, "Engine A").select(*key)
    for words, label in (
        (ocr, "Engine B"),
        (ocr.filter("doc_id % 2 = 0"), pins.INTERNAL_VERSIONS[0]),
        (ocr.filter("doc_id % 5 = 0"), pins.ACTIVE),
    ):
        rows = stack(rows, _version(words, label).select(*key))
    return rows.filter("version <> 'Engine B' or doc_id % 3 <> 0")


@register(
    "a4_versions",
    """select doc_id, string_agg(version, '|' order by version) as versions,
       case when bool_or(version = 'Engine B') then 'Engine B' else 'None' end as current from (
         select doc_id, 'Engine A' as version from gt union
         select doc_id, 'Engine B' from ocr where doc_id % 3 <> 0) group by doc_id""",
)
def _(s, p):
    rows = versions.versions(_named_versions(s, p), active="Engine B")
    return rows.withColumn("versions", F.array_join("versions", "|"))


@register(
    "a5_batch_summary",
    """select count(*) as total, count(*) filter (ok) as processed, count(*) filter (not ok) as failed, 100 as percent,
       count(*) filter (ok) || ' of ' || count(*) || ' files processed' as label
       from (select doc_id % 10 < 7 as ok from docs where doc_id in (select doc_id from gt))""",
)
def _(s, p):
    return batch.batch_summary(batch.manifest(batch.parse_batch(_batch_input(s, p)), "txt"))


@register("a6_annot_count", "select doc_id, count(distinct group_id) as n from annots group by doc_id")
def _(s, p):
    return annotations.annot_count(d.annots(d.gt_words(s, p)))


@register(
    "f1_glyph_metrics",
    """select font, style, ch, avg((r - l)::double / x_height) as width,
       avg((b - t)::double / x_height) as height, count(*) as obs from ch where font is not null group by all""",
)
def _(s, p):
    return fonts.glyph_metrics(d.with_chars(d.gt_words(s, p)))


@register(
    "f1_style_metrics",
    """select font, style, ascii(ch)::varchar as code, avg((r - l)::double / x_height) as width,
       avg((b - t)::double / x_height) as height from ch where font is not null group by all""",
)
def _(s, p):
    maps = fonts.style_metrics(fonts.glyph_metrics(d.with_chars(d.gt_words(s, p))))
    rows = maps.select("font", "style", F.explode("width").alias("code", "width"), "height")
    return rows.withColumn("height", F.element_at("height", F.col("code")))


@register(
    "f2_kerning",
    """select font, style, ch as first, nx as second, avg((nl - r)::double / x_height) as gap, count(*) as obs
       from (select *, lead(ch) over w as nx, lead(l) over w as nl from ch where font is not null
             window w as (partition by doc_id, page_no, line_no, word_no order by i))
       where nx is not null group by all""",
)
def _(s, p):
    return fonts.kerning(d.with_chars(d.gt_words(s, p)))


@register(
    "f3_page_skew",
    "select doc_id, page_no, median(slope) as slope, round(degrees(atan(median(slope))), 9) as degrees from lines group by all",
)
def _(s, p):
    return fonts.page_skew(_lines(s, p)).withColumn("degrees", F.round("degrees", 9))


@register(
    "f3_doc_skew",
    "select doc_id, quantile_disc(slope, 0.5) as slope, count(*) as n from lines group by all",
)
def _(s, p):
    # the page sketches are what is stored; documents are merged from them, here within the exact size
    pages = fonts.skew_sketches(_lines(s, p), k=16384)
    docs = fonts.merged_sketches(pages, ["doc_id"], k=16384)
    return docs.select("doc_id", fonts.sketch_quantile(F.col("sketch")).alias("slope"), "n")


@register("x1_reflow", "select doc_id, page_no, par_no, text from pars")
def _(s, p):
    return flow.reflow(d.gt_words(s, p))


@register(
    "x2_split_sentence",
    """select doc_id, page_no, par_no, unnest(x) as text, (unnest(range(len(x))))::int as n from (
         select doc_id, page_no, par_no, string_split(regexp_replace(text, '([.!?]+) +', '\\1' || chr(10), 'g'), chr(10)) as x
         from pars)""".replace("\\\\", "\\"),
)
def _(s, p):
    return flow.split_lines(d.gt_words(s, p), "sentence")


@register(
    "x2_split_width",
    """select doc_id, page_no, par_no, n, string_agg(text, ' ' order by line_no, word_no) as text from (
         select *, floor(coalesce(sum(length(text) + 1) over (partition by doc_id, page_no, par_no order by line_no, word_no
           rows between unbounded preceding and 1 preceding), 0) / 80)::int as n from gt) group by all""",
)
def _(s, p):
    return flow.split_lines(d.gt_words(s, p), "width", 80)


# -- windows, search, order ------------------------------------------------------------------


def _index(s, p) -> DataFrame:
    return annotations.annot_index(d.annots(d.gt_words(s, p)))


register("w1_annot_index", "select doc_id, group_id, page_no, top, idx from idx")(_index)


@register(
    "w2_annot_nav",
    """select a.doc_id, a.page_no, a.group_id, x.group_id as prev_group, x.page_no as prev_page,
         y.group_id as next_group, y.page_no as next_page from (
         select *, case when back > 1 then back - 1 else total end as pi,
           case when ahead < total then ahead + 1 else 1 end as ni from (
           select q.doc_id, q.page_no, q.group_id, c.total,
             coalesce(o.idx, greatest((select count(*) from idx i where i.doc_id = q.doc_id and i.page_no <= q.page_no), 1)) as back,
             coalesce(o.idx, least((select count(*) from idx i where i.doc_id = q.doc_id and i.page_no < q.page_no) + 1, c.total)) as ahead
           from (select doc_id, page_no, null as group_id from pg union all select doc_id, page_no, group_id from idx) q
           join (select doc_id, count(*) as total from idx group by doc_id) c on c.doc_id = q.doc_id
           left join idx o on o.doc_id = q.doc_id and o.group_id = q.group_id)) a
       join idx x on x.doc_id = a.doc_id and x.idx = pi join idx y on y.doc_id = a.doc_id and y.idx = ni""",
)
def _(s, p):
    index = _index(s, p)
    places = d.pages(d.docs(s, p)).select(*pins.PAGE_KEY, F.lit(None).cast("string").alias("group_id"))
    return annotations.annot_nav(index, stack(places, index.select(*pins.PAGE_KEY, "group_id")))


@register(
    "w2_annot_position",
    """select q.doc_id, q.page_no, q.group_id,
         coalesce(case when q.group_id is not null
           then (select max(i.idx) from idx i where i.doc_id = q.doc_id and i.group_id = q.group_id)
           else (select min(i.idx) from idx i where i.doc_id = q.doc_id and i.page_no = q.page_no) end, 0)::bigint as position,
         (select count(*) from idx i where i.doc_id = q.doc_id)::bigint as total
       from (select doc_id, page_no, null as group_id from pg union all select doc_id, page_no, group_id from idx
         union all select doc_id, page_no, 'gone' from pg) q""",
)
def _(s, p):
    index = _index(s, p)
    pages = d.pages(d.docs(s, p)).select(*pins.PAGE_KEY)
    unselected = pages.withColumn("group_id", F.lit(None).cast("string"))
    gone = pages.withColumn("group_id", F.lit("gone"))
    return annotations.annot_position(index, stack(unselected, index.select(*pins.PAGE_KEY, "group_id"), gone))


def _counts(s, p) -> DataFrame:
    return search.find_text(d.gt_words(s, p), " En ")


@register(
    "w3_match_label",
    """select doc_id, page_no, n, case when n = 0 then '-' when n = 1 then (before + 1)::varchar
         else (before + 1) || '-' || (before + n) end as label from (
         select *, coalesce(sum(n) over (partition by doc_id order by page_no
           rows between unbounded preceding and 1 preceding), 0)::bigint as before from found)""",
)
def _(s, p):
    return search.match_label(_counts(s, p))


@register(
    "w4_match_nav",
    """select doc_id, page_no, last_value(case when n > 0 then page_no end ignore nulls) over (partition by doc_id
         order by page_no rows between unbounded preceding and 1 preceding) as prev_page,
       first_value(case when n > 0 then page_no end ignore nulls) over (partition by doc_id
         order by page_no rows between 1 following and unbounded following) as next_page from found""",
)
def _(s, p):
    return search.match_nav(_counts(s, p))


@register(
    "w5_last_edit",
    """select doc_id, word_id, field, value, seq as abs_seq from edits where value is not null
       qualify row_number() over (partition by doc_id, word_id, field order by seq desc) = 1""",
)
def _(s, p):
    folded = edits.folded_edits(d.edits(d.gt_words(s, p))).filter("abs_seq is not null")
    return folded.select("doc_id", "word_id", "field", "value", "abs_seq")


register("q1_find_text", "select doc_id, page_no, n from found")(_counts)

# Two-term phrase: the first word ends with it, the next starts with it.
_PHRASE = """select a.doc_id, a.page_no, a.line_no, a.word_no from gt a join gt c on a.doc_id = c.doc_id
    and a.page_no = c.page_no and a.line_no = c.line_no and c.word_no = a.word_no + 1
    where ends_with(lower(a.text), 'e') and starts_with(lower(c.text), 'an')"""


@register(
    "q1_find_phrase",
    f"""select doc_id, page_no, sum(n)::bigint as n from (select distinct doc_id, page_no, 0 as n from gt union all
        select doc_id, page_no, 1 from ({_PHRASE})) group by all""",
)
def _(s, p):
    return search.find_text(d.gt_words(s, p), "E an")


@register("q1_find_total", "select doc_id, sum(n)::bigint as total from found group by doc_id")
def _(s, p):
    return search.find_total(_counts(s, p))


@register("q2_find_words", f"select {ADDRESS}, text from gt where contains(lower(text), 'en')")
def _(s, p):
    return search.find_words(d.gt_words(s, p).select(*pins.WORD_KEY, "text"), "en")


def _gram_index(s, p) -> str:
    path = scratch_dir(s, "index")
    search_index.build_index(d.gt_words(s, p).select(*pins.WORD_KEY, "text"), path, parts=8, buckets=8, tasks=d.parts(s, p))
    return path


@register("q2_index_words", f"select {ADDRESS}, text from gt where contains(lower(text), 'tion')")
def _(s, p):
    return search_index.find_words(s, _gram_index(s, p), "Tion").select(*pins.WORD_KEY, "text")


@register(
    "q1_index_phrase",
    """select doc_id, page_no, coalesce(n, 0)::bigint as n from (select distinct doc_id, page_no from gt) left join (
         select a.doc_id, a.page_no, count(*) as n from gt a join gt c on a.doc_id = c.doc_id and a.page_no = c.page_no
           and a.line_no = c.line_no and c.word_no = a.word_no + 1
         where ends_with(lower(a.text), 'ion') and starts_with(lower(c.text), 'e') group by all) using (doc_id, page_no)""",
)
def _(s, p):
    return search_index.find_text(s, _gram_index(s, p), "ion e")


@register(
    "q2_find_phrase_words",
    f"""select g.doc_id, g.page_no, g.line_no, g.word_no, g.text from gt g semi join (
          select * from ({_PHRASE}) union select doc_id, page_no, line_no, word_no + 1 from ({_PHRASE})) m
        on g.doc_id = m.doc_id and g.page_no = m.page_no and g.line_no = m.line_no and g.word_no = m.word_no""",
)
def _(s, p):
    return search.find_words(d.gt_words(s, p).select(*pins.WORD_KEY, "text"), "e an")


@register("q3_top_pages", "select doc_id, page_no, n from found order by n desc, doc_id, page_no limit 20")
def _(s, p):
    return search.top_pages(_counts(s, p), "n", 20)


@register("q3_worst_pages", f"select doc_id, page_no, wer from ({_WER}) order by wer desc nulls last, doc_id, page_no limit 20")
def _(s, p):
    stats = evaluate.wer(_stats(s, p)).select(*pins.PAGE_KEY, "wer")
    return search.top_pages(stats, "wer", 20)


@register(
    "o1_reading_order",
    f"select {ADDRESS}, text, row_number() over (partition by doc_id order by page_no, line_no, word_no) as position from gt",
)
def _(s, p):
    return selection.reading_order(d.gt_words(s, p).select(*pins.WORD_KEY, "text"), d.parts(s, p))


# -- set operations --------------------------------------------------------------------------


@register(
    "u1_make_ground_truth",
    f"select {ADDRESS}, text, 'Engine B' as version from ocr union all select {ADDRESS}, text, 'Ground Truth' from ocr",
)
def _(s, p):
    cols = [*pins.WORD_KEY, "text"]
    old = _version(d.gt_words(s, p).select(*cols), pins.GROUND_TRUTH)
    both = stack(old, _version(d.ocr_words(s, p).select(*cols), "Engine B"))
    return versions.make_ground_truth(both, "Engine B")


@register(
    "u2_union_versions",
    "select 'Engine A' as version, doc_id, count(*) as n, sum(conf)::bigint as conf from gt group by all"
    " union all select 'Engine B', doc_id, count(*), sum(conf)::bigint from ocr group by all",
)
def _(s, p):
    cols = ["doc_id", "conf"]
    words = _version(d.gt_words(s, p).select(*cols), "Engine A")
    both = tables.with_version(words, d.ocr_words(s, p).select(*cols), "Engine B")
    return both.groupBy("version", "doc_id").agg(F.count("*").alias("n"), F.sum("conf").alias("conf"))


@register(
    "u3_internal_versions",
    f"""select doc_id, version from (select doc_id, 'Engine A' as version from gt union
        select doc_id, 'Engine B' from ocr where doc_id % 3 <> 0 union
        select doc_id, '{pins.INTERNAL_VERSIONS[0]}' from ocr where doc_id % 2 = 0)""",
)
def _(s, p):
    shown = versions.versions(_named_versions(s, p), show_internal=True)
    return shown.select("doc_id", F.explode("versions").alias("version"))


# -- streaming -------------------------------------------------------------------------------


#: Every fifth document first arrives with wrong words, every seventh cut off; of those, the even ones are corrected.
_WRONG = "case when doc_id % 5 = 0 then replace(text, 'e', 'E') else text end"
_CUT = "case when doc_id % 7 = 0 then left(hocr, length(hocr) - 9) else hocr end"


@register(
    "r1_stream_hocr",
    """select 'pages' as sink, doc_id, page_no::int as page_no, null::int as line_no, null::int as word_no, null as value
       from (select distinct doc_id, page_no from gt) where not (doc_id % 7 = 0 and doc_id % 2 = 1)
       union all
       select 'words', doc_id, page_no::int, (dense_rank() over (partition by doc_id, page_no order by line_no) - 1)::int,
         (row_number() over (partition by doc_id, page_no, line_no order by word_no) - 1)::int,
         case when doc_id % 5 = 0 and doc_id % 2 = 1 then replace(text, 'e', 'E') else text end
       from gt where not (doc_id % 7 = 0 and doc_id % 2 = 1)
       union all
       select distinct 'errors', doc_id, null::int, null::int, null::int, 'no document' from gt where doc_id % 7 = 0 and doc_id % 2 = 1""",
)
def _(s, p):
    path = scratch_dir(s, "stream")
    words = d.gt_words(s, p)
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".hocr.gz")).alias("name")
    first = hocr.hocr_records(words.withColumn("text", E(_WRONG)), parts=d.parts(s, p)).select(name, "doc_id", E(_CUT).alias("value"))
    # a file is a record, so it is written where the record was made
    arrived = named.write_named(first, f"{path}/in/first", ["doc_id"], dealt=True)
    again = hocr.hocr_records(words.filter("doc_id % 2 = 0 and (doc_id % 5 = 0 or doc_id % 7 = 0)"), parts=d.parts(s, p))
    named.write_named(again.select(name, "doc_id", F.col("hocr").alias("value")), f"{path}/in/second", ["doc_id"], dealt=True)
    files = max(1, arrived.count() // 2)
    ingest.stream_hocr(s, f"{path}/in/*", f"{path}/out", f"{path}/checkpoint", files_per_batch=files).awaitTermination()
    read = lambda t: ingest.read_sink(s, f"{path}/out", t).withColumn("sink", F.lit(t))
    pages, words = (read(t).withColumn("doc_id", F.col("doc_id").cast("long")) for t in ("pages", "words"))
    errors = read("errors").withColumn("doc_id", F.regexp_extract("file", r"^(\d+)", 1).cast("long"))
    found = stack(
        pages.select("sink", "doc_id", "page_no"),
        words.select("sink", "doc_id", "page_no", "line_no", "word_no", F.col("text").alias("value")),
        errors.select("sink", "doc_id", F.col("reason").alias("value")), missing=True,
    )
    return found.select("sink", "doc_id", "page_no", "line_no", "word_no", "value")


@register("r2_stream_edits", _EDITED)
def _(s, p):
    path = scratch_dir(s, "edits")
    words = d.gt_words(s, p)
    log = d.edits(words)
    # the edits of a word are spread over the batches out of order, and a third of them arrives again
    arriving = stack(log, log.filter("seq % 3 = 0")).repartition(6, F.xxhash64("seq", F.rand(7) > 0.5))
    arriving.write.parquet(f"{path}/in")
    files = s.readStream.schema(edit_stream.EDIT_SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    edit_stream.stream_edits(files, f"{path}/checkpoint").awaitTermination()
    out = edit_stream.edited_words(words.select(*EDIT_COLS, "word_id"), f"{path}/checkpoint")
    return out.select(*EDIT_COLS)


@register(
    "r3_progress_counts",
    "select time_bucket(interval '10 minutes', ts) as window_start, event_type, count(*) as n from events group by all",
)
def _(s, p):
    return progress.progress_counts(d.table(s, p, "events"))


def flagship(s: SparkSession, p: str) -> DataFrame:
    return QUERIES["e2_eval_page"](s, p)
