"""Readers and writers on hand-made files of both shapes."""

import json

import pytest
from pyspark.sql import functions as F

from ocrspark.operators import batch, fonts
from ocrspark.session import spread
from ocrspark.sources import hocr, named, split, tables

NESTED = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">
<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en" lang="en">
 <head><title></title><meta name='ocr-system' content='engine 1'/></head>
 <body>
  <div class='ocr_page' id='sheet' title='image "my scan.png"; bbox 0 0 640 480; ppageno 0; scan_res 144 145'>
   <div class='ocr_separator' id='rule' title="bbox 20 55 620 57"></div>
   <div class='ocr_carea' id='a7' title="bbox 33 61 417 96">
    <p class='ocr_par' id='p_x' lang='nld' title="bbox 33 61 417 96">
     <span class='ocr_line' id='top' title="bbox 33 61 417 96; baseline -0.0125 2; x_size 22.75; x_descenders 6.5; x_ascenders 8">
      <span class='ocrx_word' id='q1' title='bbox 33 61 141 96; x_wconf 64'>R&amp;D</span>
      <span class='ocrx_word' id='q2' lang='ita' title='bbox 152 63 260 95; x_wconf 5'>
       <span class='ocrx_cinfo' title='x_bboxes 152 63 199 95; x_conf 71.5'>n</span>
       <span class='ocrx_cinfo' title='x_bboxes 207 63 260 95; x_conf 88.125'>o</span>
      </span>
     </span>
    </p>
   </div>
   <div class='ocr_carea' id='a8' title="bbox 33 118 300 150">
    <p class='ocr_par' id='p_y' lang='swe' title="bbox 33 118 300 150">
     <span class='ocr_line' id='foot' title="bbox 33 118 300 150; baseline 0.25 0">
      <span class='ocrx_word' id='q3' title='bbox 33 118 122 150; x_wconf 17'>Slut</span>
     </span>
    </p>
   </div>
   <div class='ocr_photo' id='picture' title="bbox 400 200 600 400"></div>
  </div>
 </body>
</html>
"""

METRICS = {"Serif": {"normal": {"width": {"65": 1.25}, "height": {"65": 1.5}, "kerning": {"65,66": 0.1},
                                "kerning2": {}, "variants": {"x": True}, "heightCaps": 1.4, "obs": 12, "obsCaps": 3},
                     "small-caps": {"width": {"66": 2.0}, "obs": 1}, "obs": 13}}
LAYOUT = [{"default": True, "boxes": {}},
          {"default": False, "boxes": {"r1": {"coords": {"left": 1, "top": 2, "right": 30, "bottom": 40},
                                              "type": "order", "order": 2},
                                       "r0": {"coords": {"left": 5, "top": 6, "right": 7, "bottom": 8},
                                              "type": "exclude", "order": None}}},
          {"default": True, "boxes": {}}]
TABLES = [{"default": False, "tables": [{"id": "t", "rule": "left", "level": "word", "boxes": {
    "c0": {"coords": {"left": 0, "top": 0, "right": 9, "bottom": 9}}}}]}]

FLAT = f"""<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">
<html xmlns="http://www.w3.org/1999/xhtml"><head>
 <title>flat</title>
 <meta name='font-metrics' content='{json.dumps(METRICS)}'></meta>
 <meta name='default-font' content='Serif'></meta>
 <meta name='enable-opt' content='true'></meta>
 <meta name='layout' content='{json.dumps(LAYOUT)}'></meta>
 <meta name='layout-data-table' content='{json.dumps(TABLES)}'></meta>
</head><body>
 <div class='ocr_page' title='bbox 0 0 1500 2100'>
  <span class='ocr_line' title="bbox 50 60 700 95; baseline 0 -6; x_x_height 20; x_asc_height 25">
   <span class='ocrx_word' id='word_1_0' title='bbox 50 60 140 90;x_wconf 100;x_font Garden_Serif' lang='eng' style='font-variant:small-caps;font-family:Garden_Serif'>Alpha</span>
   <span class='ocrx_word' id='word_7_12b' title='bbox 150 60 300 90;x_wconf 100'>one</span>
  </span>
 </div>
 <div class='ocr_page' title='bbox 0 0 100 200'>
  <span class='ocr_line' title="bbox 1 1 9 9; baseline 0.001 -1; x_x_height 17.125; x_asc_height 19">
   <span class='ocrx_word' id='word_3_0' title='bbox 1 1 9 9;x_wconf 0' style='font-weight:bold;font-style:italic'>two</span>
  </span>
 </div>
</body></html>"""


def write(folder, **files):
    for name, content in files.items():
        (folder / f"{name}.hocr").write_text(content, encoding="utf-8")
    return str(folder)


def test_nested_form(spark, tmp_path):
    docs = hocr.read_hocr(spark, write(tmp_path, nested=NESTED))
    page = hocr.pages(docs).collect()
    assert [(p.page_no, p.width, p.height, p.image, p.ppageno, p.scan_res) for p in page] == [
        (0, 640, 480, "my scan.png", 0, [144, 145])
    ]
    lines = hocr.lines(docs).orderBy("line_no").collect()
    assert [(x.line_no, x.carea_id, x.par_id, x.par_lang, x.slope, x.offset) for x in lines] == [
        (0, "a7", "p_x", "nld", -0.0125, 2.0), (1, "a8", "p_y", "swe", 0.25, 0.0)
    ]
    assert (lines[0].x_size, lines[0].x_descenders, lines[0].x_x_height) == (22.75, 6.5, None)
    words = hocr.words(docs).orderBy("line_no", "word_no").collect()
    assert [(w.word_id, w.text, w.conf, w.lang, w.par_lang, w.l, w.b) for w in words] == [
        ("q1", "R&D", 64, None, "nld", 33, 96),
        ("q2", "no", 5, "ita", "nld", 152, 95),
        ("q3", "Slut", 17, None, "swe", 33, 150),
    ]
    chars = hocr.chars(docs).orderBy("char_no").collect()
    assert [(c.word_id, c.ch, c.conf, c.l, c.r) for c in chars] == [
        ("q2", "n", 71.5, 152, 199), ("q2", "o", 88.125, 207, 260)
    ]
    assert sorted(b.kind for b in hocr.blocks(docs).collect()) == ["carea", "carea", "photo", "separator"]


def test_flat_form(spark, tmp_path):
    docs = hocr.read_hocr(spark, write(tmp_path, flat=FLAT))
    words = hocr.words(docs).orderBy("page_no", "word_no").collect()
    assert [(w.doc_id.rsplit("/", 1)[1], w.page_no, w.line_no, w.word_id, w.font, w.small_caps, w.bold, w.italic) for w in words] == [
        ("flat.hocr#0", 0, 0, "word_1_0", "Garden_Serif", True, False, False),
        ("flat.hocr#0", 0, 0, "word_7_12b", None, False, False, False),
        ("flat.hocr#0", 1, 0, "word_3_0", None, False, True, True),
    ]
    lines = hocr.lines(docs).orderBy("page_no").collect()
    assert [(x.x_x_height, x.x_asc_height, x.x_size) for x in lines] == [
        (20.0, 25.0, None), (17.125, 19.0, None)
    ]


def test_head_metadata(spark, tmp_path):
    meta = hocr.read_meta(hocr.read_hocr(spark, write(tmp_path, flat=FLAT)))
    row = meta.collect()[0]
    assert (row.default_font, row.enable_opt) == ("Serif", True)
    serif = row.font_metrics["Serif"]
    assert serif.normal.width == {"65": 1.25} and serif.normal.obsCaps == 3 and serif.obs == 13
    assert serif.smallCaps.width == {"66": 2.0}  # older spelling of the key
    regions = hocr.regions(meta).orderBy("region_seq").collect()
    assert [(r.page_no, r.region_id, r.kind, r.ord, r.l, r.b) for r in regions] == [
        (1, "r1", "order", 2, 1, 40), (1, "r0", "exclude", None, 5, 8)
    ]
    cols = hocr.table_columns(meta).collect()
    assert [(c.table_id, c.rule, c.level, c.col_no, c.r) for c in cols] == [("t", "left", "word", 0, 9)]


def test_several_documents_in_a_file(spark, tmp_path):
    docs = hocr.read_hocr(spark, write(tmp_path, many=NESTED + FLAT))
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert [i.rsplit("/", 1)[1] for i in ids] == ["many.hocr#0", "many.hocr#1"]


def test_equal_titles_stay_apart(spark, tmp_path):
    docs = hocr.read_hocr(spark, write(tmp_path, a=FLAT, b=FLAT))
    assert docs.select("doc_id").distinct().count() == 2 and docs.select("title").distinct().count() == 1


def test_nothing_is_lost_in_writing(spark, tmp_path, rows):
    words = spark.createDataFrame(
        [("a", 0, 0, 0, "w1", "x", 9, 0, 0, 5, 5), ("a", 0, 0, 1, None, "y", 8, 6, 0, 9, 5), ("a", 0, 0, 2, "w3", None, 7, 10, 0, 19, 5),
         ("a", 2, 0, 0, "w4", "z", None, 0, 0, 5, 5)],
        "doc_id string, page_no int, line_no int, word_no int, word_id string, text string, conf int, l int, t int, r int, b int",
    )
    pages = spark.createDataFrame([("a", k, 100, 200) for k in range(4)] + [("b", 0, 1, 2)],
                                  "doc_id string, page_no int, width int, height int")
    out = str(tmp_path / "out")
    hocr.write_hocr(hocr.hocr_records(words, pages=pages), out)
    again = hocr.read_hocr(spark, out, whole=False)
    got = rows(hocr.words(again), "doc_id", "page_no", "word_no", "word_id", "conf", "l", "r")
    assert got == rows(words, "doc_id", "page_no", "word_no", "word_id", "conf", "l", "r")
    assert rows(hocr.pages(again), "doc_id", "page_no", "width", "height") == rows(pages, *pages.columns)


def test_batch_isolates_failures(spark, tmp_path):
    path = write(tmp_path, good=FLAT, cut=FLAT[:-8], noroot="<p>no</p>", broken=FLAT.replace("</div>", "", 1),
                 mixed=FLAT + FLAT.replace("</div>", "", 1))
    rows = batch.manifest(batch.parse_batch(hocr.raw_files(spark, path)), "alto")
    got = {r.file.rsplit("/", 1)[1]: (r.status, r.reason, r.output, r.documents) for r in rows.collect()}
    assert got == {
        "good.hocr": ("Done", None, "good.xml", 1),
        "cut.hocr": ("Error", "no document", None, 0),
        "noroot.hocr": ("Error", "no document", None, 0),
        "broken.hocr": ("Error", "malformed", None, 0),
        "mixed.hocr": ("Error", "malformed", None, 1),
    }
    total = batch.batch_summary(rows).collect()[0]
    assert (total.total, total.processed, total.failed, total.percent, total.label) == (
        5, 1, 4, 100, "1 of 5 files processed")


def test_words_survive_a_round_trip(spark, tmp_path, rows):
    docs = hocr.read_hocr(spark, write(tmp_path, flat=FLAT))
    words = hocr.words(docs).withColumn("text", F.concat("text", F.lit("<&>'\"")))
    out = str(tmp_path / "out")
    hocr.write_hocr(hocr.hocr_records(words, pages=hocr.pages(docs)), out)
    again = hocr.read_hocr(spark, out, whole=False)
    cols = [c for c in words.columns if c not in ("par_id", "par_lang")]
    assert rows(hocr.words(again), *cols) == rows(words, *cols)
    assert rows(hocr.pages(again), "page_no", "width", "height") == [(0, 1500, 2100), (1, 100, 200)]


def test_glyphs_from_files(spark, tmp_path):
    flat = FLAT.replace(">Alpha<", "><span class='ocrx_cinfo' title='x_bboxes 50 60 70 80; x_conf 99'>C</span>"
                        "<span class='ocrx_cinfo' title='x_bboxes 90 60 130 100; x_conf 98'>a</span><")
    words = hocr.words_with_chars(hocr.read_hocr(spark, write(tmp_path, flat=flat)))
    glyphs = fonts.glyph_metrics(words)
    got = sorted((g.font, g.style, g.ch, g.width, g.height, g.obs) for g in glyphs.collect())
    assert got == [("Garden_Serif", "smallCaps", "C", 1.0, 1.0, 1), ("Garden_Serif", "smallCaps", "a", 2.0, 2.0, 1)]
    assert [(k["first"], k["second"], k.gap, k.obs) for k in fonts.kerning(words).collect()] == [("C", "a", 1.0, 1)]
    style = fonts.style_metrics(glyphs).collect()[0]
    assert style.width == {"67": 1.0, "97": 2.0}
    assert (style.obs, style.obs_caps, style.height_caps) == (2, 1, 1.0)


def test_csv_and_project(spark, tmp_path, rows):
    data = spark.createDataFrame([(1, 'say "hi", \\ ok', None), (2, " blank ", "x")], "id bigint, text string, font string")
    tables.write_words_csv(data, str(tmp_path / "csv"))
    assert rows(tables.read_words_csv(spark, str(tmp_path / "csv"), data.schema)) == rows(data)
    for compress in (True, False):
        path = str(tmp_path / f"project{compress}")
        tables.save_project({"words": data}, path, compress)
        assert rows(tables.load_project(spark, path, {"words": data.schema})["words"]) == rows(data)


def test_csv_keeps_line_breaks(spark, tmp_path, rows):
    data = spark.createDataFrame(
        [(1, "a\rb", "x"), (2, "c\nd", None), (3, "\r", "\r"), (4, None, None), (5, 'e"\r\n"', ",")], "id bigint, text string, font string"
    )
    tables.write_words_csv(data, str(tmp_path / "csv"))
    assert rows(tables.read_words_csv(spark, str(tmp_path / "csv"), data.schema)) == rows(data)


def test_csv_files_are_bounded(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(tables, "CSV_WORDS", 10)
    data = spark.range(35).selectExpr("id", "concat('w', id) as text").coalesce(1)
    tables.write_words_csv(data, str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").glob("part-*"))) == 4
    assert rows(tables.read_words_csv(spark, str(tmp_path / "csv"), data.schema)) == rows(data)


PROJECT = "line_no int, doc_id bigint, text string, page_no int, word_no int, `a.b` double, more array<string>"


def test_project_record_is_a_page(spark, tmp_path, rows):
    page = [(n // 9, 1, f"w{n}", 0, n % 9, n / 2, ["x", None]) for n in range(90)]
    odd = [
        (0, 1, None, 1, 0, None, None), (0, 1, None, 1, 0, None, None), (None, 1, "n", None, None, float("inf"), []),
        (None, None, None, None, None, None, None), (10_000, 1, "far", 0, 0, 1.0, ["y"]), (0, 1, "long", 0, 1_000, 2.0, [None]),
    ]
    data = spark.createDataFrame(page + odd, PROJECT)
    for compress in (True, False):
        path = str(tmp_path / f"project{compress}")
        tables.save_project({"words": data, "bare": data.select("doc_id", "page_no")}, path, compress)
        # a page, two parts that lie far off, and three addresses of odd rows
        assert spark.read.text(f"{path}/words").count() == 6
        loaded = tables.load_project(spark, path, {"words": data.schema, "bare": "doc_id bigint, page_no int"})
        assert loaded["words"].schema.simpleString() == data.schema.simpleString()
        plain = [c.replace(".", "_") for c in data.columns]
        assert rows(loaded["words"].toDF(*plain)) == rows(data.toDF(*plain))
        assert rows(loaded["bare"]) == rows(data.select("doc_id", "page_no"))


def test_project_words_are_not_shuffled(spark):
    dealt = spark.createDataFrame([(1, 0, 0, 0, "a")], "doc_id bigint, page_no int, line_no int, word_no int, text string")
    plan = tables._page_records(spread(dealt, "doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


WORDS = "doc_id bigint, page_no int, par_no int, line_no int, word_no int, text string"


def test_text_export(spark):
    data = [(1, 0, 0, 0, 0, "in-"), (1, 0, 0, 1, 0, "side"), (1, 0, 0, 1, 2, "-"), (1, 0, 1, 2, 0, "a"),
            (1, 2, 0, 0, 0, "end")]
    words = spark.createDataFrame(data, WORDS)
    docs = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    got = {r.doc_id: r.text for r in tables.export_text(words, docs).collect()}
    assert got == {1: "in-\nside -\na\nend", 2: ""}
    flowing = {r.doc_id: r.text for r in tables.export_text(words, reflow=True).collect()}
    assert flowing == {1: "inside -\na\nend"}
    assert tables.export_text(words.filter("false"), docs).filter("text <> ''").count() == 0


def test_page_text_files_keep_document_order(spark, tmp_path):
    data = [(d, p, 0, 0, w, f"d{d}p{p}w{w}") for d in range(5) for p in range(12) for w in range(2)]
    tables.write_page_text(spark.createDataFrame(data, WORDS), str(tmp_path / "text"))
    lines = []
    for part in sorted((tmp_path / "text").glob("part-*")):
        lines += part.read_text().splitlines()
    assert lines == [f"d{d}p{p}w0 d{d}p{p}w1" for d in range(5) for p in range(12)]


def test_batch_writes_the_text_of_good_files(spark, tmp_path):
    box = "1 as l, 2 as t, 30 as r, 40 as b, 90 as conf"
    words = spark.sql(
        f"""select *, {box} from values ('x', 0, 0, 0, 'w0', 'Four'), ('x', 0, 0, 1, 'w1', 'elms'), ('x', 1, 0, 0, 'w2', 'fell'),
        ('y', 0, 0, 0, 'w3', 'Rain') as v(doc_id, page_no, line_no, word_no, word_id, text)"""
    )
    pages = spark.sql("select doc_id, 0 as page_no, 50 as width, 60 as height from values ('x'), ('y'), ('z') as v(doc_id)")
    made = {r.doc_id: r.hocr for r in hocr.hocr_records(words, pages=pages).collect()}
    files = {
        "one.hocr": made["x"], "both.hocr": made["y"] + "\n" + made["x"], "bare.hocr": made["z"],
        "cut.hocr": made["x"][:-9], "half.hocr": made["x"] + made["y"].replace("</div>", ""),
    }
    source = tmp_path / "in"
    source.mkdir()
    for name, text in files.items():
        (source / name).write_text(text)
    docs = batch.parse_batch(hocr.raw_files(spark, str(source)))
    rows = batch.convert(docs, str(tmp_path / "out"), compress=False).collect()
    assert {(r.file.rsplit("/", 1)[1], r.status, r.output) for r in rows} == {
        ("one.hocr", "Done", "one.txt"), ("both.hocr", "Done", "both.txt"), ("bare.hocr", "Done", "bare.txt"),
        ("cut.hocr", "Error", None), ("half.hocr", "Error", None),
    }
    assert {f.name: f.read_text() for f in (tmp_path / "out").iterdir() if not f.name.startswith(".")} == {
        "one.txt": "Four elms\nfell", "both.txt": "Rain\nFour elms\nfell", "bare.txt": "",
    }
    batch.convert(docs, str(tmp_path / "again"), "hocr")
    got = hocr.read_hocr(spark, str(tmp_path / "again"))
    assert {r.file.rsplit("/", 1)[1] for r in got.select("file").collect()} == {"one.hocr", "both.hocr", "bare.hocr"}
    key = ["doc_id", "page_no", "word_no", "word_id", "text", "conf", "l", "b"]
    both = sorted(tuple(r) for r in hocr.words(got.filter("file like '%both.hocr'")).select(key).collect())
    assert both == sorted(tuple(r) for r in words.select(key).collect())
    with pytest.raises(ValueError):
        batch.convert(docs, str(tmp_path / "other"), "docx")


# -- all levels in writing, named files, pages of large files

def whole_tables(docs):
    """Everything the module reads from documents, as sorted rows without the place of the file."""
    meta = hocr.read_meta(docs)
    tables_of = {
        "pages": hocr.pages(docs), "lines": hocr.lines(docs), "words": hocr.words(docs), "chars": hocr.chars(docs),
        "blocks": hocr.blocks(docs), "regions": hocr.regions(meta), "columns": hocr.table_columns(meta),
        "fonts": meta.select("doc_id", F.to_json("font_metrics").alias("m"), "default_font", "enable_opt", "system"),
    }
    return {n: sorted((tuple(r) for r in t.drop("doc_id").collect()), key=repr) for n, t in tables_of.items()}


@pytest.mark.parametrize("sample", [NESTED, FLAT], ids=["nested", "flat"])
def test_every_level_survives_writing(spark, tmp_path, sample):
    docs = hocr.read_hocr(spark, write(tmp_path, one=sample))
    meta = hocr.read_meta(docs)
    records = hocr.hocr_records(
        hocr.words(docs), hocr.lines(docs), hocr.pages(docs), chars=hocr.chars(docs), blocks=hocr.blocks(docs), head=hocr.head_rows(meta)
    )
    hocr.write_hocr(records, str(tmp_path / "out"))
    again = hocr.read_hocr(spark, str(tmp_path / "out"), whole=False)
    want, got = whole_tables(docs), whole_tables(again)
    if sample is FLAT:  # the writer numbers pages, and names itself where no system is given
        want["pages"] = [(*r[:4], r[0], *r[5:]) for r in want["pages"]]
        want["fonts"] = [(*r[:3], "ocrspark") for r in want["fonts"]]
    else:  # content areas lie before other blocks only where they are listed so
        assert want["blocks"] == got["blocks"] and len(want["blocks"]) == 4
    assert got == want
    # regions and tables from their rows give the same metadata
    layout, cols = hocr.layout_json(hocr.regions(meta)), hocr.tables_json(hocr.table_columns(meta))
    head = hocr.head_rows(layout).unionByName(hocr.head_rows(cols))
    hocr.write_hocr(hocr.hocr_records(hocr.words(docs), head=head), str(tmp_path / "rows"))
    rows_again = whole_tables(hocr.read_hocr(spark, str(tmp_path / "rows"), whole=False))
    assert (rows_again["regions"], rows_again["columns"]) == (want["regions"], want["columns"])


def test_words_carry_their_paragraph(spark, tmp_path):
    """Language mix is the same before and after, with paragraphs from the words alone."""
    from ocrspark.operators.selection import lang_mix

    words = hocr.words(hocr.read_hocr(spark, write(tmp_path, one=NESTED)))
    hocr.write_hocr(hocr.hocr_records(words), str(tmp_path / "out"))
    again = hocr.words(hocr.read_hocr(spark, str(tmp_path / "out"), whole=False))
    mix = lambda w: sorted((r.lang, r.n, r.share) for r in lang_mix(w).collect())
    assert mix(again) == mix(words) and len(mix(words)) == 3


def test_named_files(spark, tmp_path):
    out = str(tmp_path / "out")
    data = [(f"f{k % 7}.txt", k, f"piece {k}" if k % 5 else None) for k in range(200)] + [("empty", 0, None), ("É ö.txt", 1, "ü")]
    pieces = spark.createDataFrame(data, "name string, no int, value string").repartition(5)
    for _ in range(2):  # a job that runs again leaves the same files
        made = {r.name: r.bytes for r in named.write_named(pieces, out, ["no"], sep="\n").collect()}
    want = {}
    for name, _, value in data:
        want.setdefault(name, []).extend([value] if value is not None else [])
    want = {n: "\n".join(v) for n, v in want.items()}
    assert {f.name: f.read_text() for f in (tmp_path / "out").iterdir()} == want
    assert made == {n: len(v.encode()) for n, v in want.items()}
    for bad in ("a/b", None, ".."):
        with pytest.raises(Exception, match="not a file name"):
            named.write_named(spark.createDataFrame([(bad, 1, "x")], pieces.schema), out, ["no"])
    assert named.write_named(pieces.limit(0), str(tmp_path / "none"), ["no"]).count() == 0


def test_a_repeated_task_leaves_one_file(spark, tmp_path):
    """A task that dies in the middle leaves nothing under the name; its repetition writes the file."""
    import pyarrow as pa

    out = str(tmp_path / "out")
    batch_of = lambda *rows: pa.RecordBatch.from_pylist([{"name": n, "value": v} for n, v in rows])

    def dying():
        yield batch_of(("a", "1"), ("b", "2"))
        raise RuntimeError("lost executor")

    with pytest.raises(RuntimeError):
        list(named._write(dying(), out, ""))
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == [named.UNFINISHED, "a"]
    for _ in range(2):
        list(named._write(iter([batch_of(("a", "1"), ("b", "2")), batch_of(("b", "3"))]), out, ""))
    assert {f.name: f.read_text() for f in (tmp_path / "out").iterdir() if f.is_file()} == {"a": "1", "b": "23"}


def large_document(pages, numbers=None):
    body = "\n".join(
        f"<div class='ocr_page' title='bbox 0 0 10 {n + 1}{'' if numbers is None else f'; ppageno {numbers[n]}'}'>"
        f"<span class='ocr_line' title='bbox 1 1 9 9'><span class='ocrx_word' id='w{n}' title='bbox 1 1 9 9;x_wconf {n % 101}'>t{n}</span></span></div>"
        for n in range(pages)
    )
    return f"<html xmlns='http://www.w3.org/1999/xhtml'><head><title>large</title><meta name='default-font' content='Serif'/></head><body>{body}</body></html>"


@pytest.mark.parametrize("limit", [1 << 21, -1], ids=["broadcast", "shuffled"])
def test_pages_of_a_large_file_are_read_by_many_tasks(spark, tmp_path, limit):
    count = 20_000
    folder = write(tmp_path, large=large_document(count), own=large_document(30, [100 - n for n in range(30)]),
                   twice=large_document(3, [1, 1, 2]), many=large_document(4) + large_document(0) + large_document(5, range(7, 12)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        docs, pages = split.read_hocr_pages(spark, folder, limit=limit)
        assert pages.filter("doc_id like '%large.hocr#0'").rdd.getNumPartitions() > 10 or limit < 0
        got = [tuple(r) for r in hocr.words(pages).drop("par_id", "par_lang").collect()]
        heights = sorted(tuple(r) for r in hocr.pages(pages).select("doc_id", "page_no", "height").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = hocr.read_hocr(spark, folder)
    assert sorted(got, key=repr) == sorted((tuple(r) for r in hocr.words(whole).drop("par_id", "par_lang").collect()), key=repr)
    assert len(got) == count + 30 + 3 + 9
    assert heights == sorted(tuple(r) for r in hocr.pages(whole).select("doc_id", "page_no", "height").collect())
    ids = lambda df: sorted((r.doc_id, r.title) for r in df.select("doc_id", "title").collect())
    assert ids(docs) == ids(whole) and len(ids(docs)) == 6
    assert {r.default_font for r in hocr.read_meta(docs).collect()} == {"Serif"}


def test_a_broken_page_costs_only_itself(spark, tmp_path):
    text = large_document(5).replace("t2</span></span></div>", "t2</span></div>")
    _, pages = split.read_hocr_pages(spark, write(tmp_path, broken=text))
    assert sorted(r.page_no for r in hocr.words(pages).collect()) == [0, 1, 3, 4]
    assert [r.page_no for r in pages.filter("page._corrupt_record is not null").collect()] == [2]


def test_scratch_without_a_setting():
    """The fallback folder belongs to the application, and a scope removes what was made in it."""
    import os

    from ocrspark import session

    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master, applicationId = "local[2]", "app-test"

    class Session:
        conf, sparkContext = Conf(), Context()

    one, two = session.scratch_dir(Session(), "a"), session.scratch_dir(Session(), "a")
    assert one != two and os.path.dirname(one) == os.path.dirname(two)
    Context.master = "spark://host"
    with pytest.raises(ValueError):
        session.scratch_dir(Session(), "a")


def test_scope_removes_its_folders(spark):
    import os

    from ocrspark.session import scratch_dir, scratch_scope, stored

    with scratch_scope(spark):
        inner = stored(spark.range(3), "t").inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        kept = scratch_dir(spark, "kept", keep=True)
        spark.range(2).write.parquet(kept)
        assert os.path.exists(inner.removeprefix("//"))
    assert not os.path.exists(inner.removeprefix("//")) and spark.read.parquet(kept).count() == 2


def test_records_of_dealt_words_are_built_in_place(spark, rows):
    from ocrspark import pins
    from ocrspark.plans import derived as d
    from conftest import SF_DIR

    parts = d.parts(spark, SF_DIR)
    words = d.gt_words(spark, SF_DIR).filter("doc_id % 20 = 0")
    chars = d.with_chars(words).select(*pins.WORD_KEY, F.posexplode("chars").alias("char_no", "c")).select(*pins.WORD_KEY, "char_no", "c.*")
    # characters, lines and pages without a word, an area, and metadata of a document without words
    own = spark.createDataFrame([(0, 0, 90001, 0, 0, "z", 1, 2, 3, 4)], "doc_id long, page_no int, line_no int, word_no int, char_no int, ch string, l int, t int, r int, b int")
    chars = chars.unionByName(own)
    lines = d.lines(words).unionByName(d.lines(words).filter("doc_id = 20").withColumn("line_no", F.col("line_no") + 70000))
    pages = d.pages(d.docs(spark, SF_DIR)).filter("doc_id % 10 = 0")
    blocks = spark.createDataFrame([(0, 0, 0, "a1", "carea", 0, 0, 9, 9)], "doc_id long, page_no int, block_no int, block_id string, kind string, l int, t int, r int, b int")
    head = spark.createDataFrame([(0, "x", "1"), (-5, "y", "2")], "doc_id long, name string, content string")
    tables = dict(lines=lines, pages=pages, chars=chars, blocks=blocks, head=head)
    want = rows(hocr.hocr_records(words, **tables))
    assert rows(hocr.hocr_records(words, **tables, parts=parts)) == want and len(want) > 5
    plain = hocr.hocr_records(words, parts=parts)
    assert rows(plain) == rows(hocr.hocr_records(words))
    # one exchange deals the documents
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_pieces_of_one_document_are_built_in_place(spark, rows):
    """Words dealt by something finer than the document, whose pages they number through."""
    words = spark.createDataFrame(
        [(k % 3, k % 3 * 10 + k % 2, 0, k, f"i{k}", f"w{k}", 90, k * 10, 0, k * 10 + 9, 9) for k in range(12)],
        "doc_id long, page_no int, line_no int, word_no int, word_id string, text string, conf int, l int, t int, r int, b int",
    )
    docs = spark.createDataFrame([("all",)], "doc_id string")
    got = hocr.hocr_pieces(docs, words.repartition(4, "doc_id"), parts=4)
    assert got._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS") == 0
    want = hocr.hocr_pieces(docs, words.withColumn("doc_id", F.lit("all")))
    assert got.count() == 8 and rows(got, "piece", "value") == rows(want, "piece", "value")


def test_kerning_makes_characters_once(spark):
    """No filter or explode repeats the expressions that make the characters; null and short words have no pairs."""
    rows = [("Serif", 10, 0, "abc"), ("Serif", 10, 0, "a"), ("Serif", 10, 0, None), (None, 10, 0, "abc"), ("Serif", 0, 0, "abc"), ("Serif", 10, None, "xy")]
    words = spark.createDataFrame(rows, "font string, x_height int, l int, text string").selectExpr(
        "font", "'normal' as style", "x_height",
        "transform(split(text, ''), (c, i) -> named_struct('ch', c, 'l', l + i * 10, 'r', l + i * 10 + 5 + i)) as chars")
    pairs = fonts.kerning(words)
    found = {(r.first, r.second, r.gap, r.obs) for r in pairs.collect()}
    assert found == {("a", "b", 0.5, 1), ("b", "c", 0.4, 1), ("x", "y", None, 1)}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


STRAY = FLAT.replace("<head>", "<head><!-- a note --><link rel='x'/>").replace(
    "<span class='ocr_line' title=\"bbox 50", "stray <b>bold <i>text</i></b><span class='ocr_line' title=\"bbox 50"
).replace("style='font-weight:bold;font-style:italic'>two", "style='font-weight:bold;font-style:italic'>\n <!-- x --><![CDATA[t<w]]>o <em>!</em>")
READERS = {
    "pages": [hocr.pages, hocr.blocks], "lines": [hocr.lines], "attributes": [lambda docs: hocr.words(docs).drop("text")], "words": [hocr.words],
    "chars": [hocr.chars, hocr.words_with_chars],
}


def test_a_level_gives_the_rows_of_a_whole_read(spark, tmp_path):
    broken = NESTED.replace("</p>", "", 1)
    late = FLAT.replace("</body></html>", "</div></body></html>")
    unspaced = "".join(x.strip() for x in NESTED.split("\n"))
    folder = write(tmp_path, a=NESTED, b=FLAT, c=STRAY, d=broken, e=late, f=unspaced, g="none", h=NESTED + FLAT)
    whole = hocr.read_hocr(spark, folder)
    state = ("file", "doc_pos", "doc_id", "title", F.col("html").isNull(), F.col("html._corrupt_record"))
    asked = lambda docs: sorted(map(repr, docs.select(*state).collect()))
    rows = lambda df: sorted(map(repr, df.collect()))
    for k, level in enumerate(hocr.LEVELS):
        docs = hocr.read_hocr(spark, folder, level=level)
        assert asked(docs) == asked(whole)
        assert rows(hocr.read_meta(docs)) == rows(hocr.read_meta(whole))
        for known in hocr.LEVELS[: k + 1]:
            for read in READERS.get(known, []):
                want = rows(read(whole))
                assert want and rows(read(docs)) == want
    assert "text" not in hocr.words(hocr.read_hocr(spark, folder, level="attributes")).columns
    with pytest.raises(ValueError):
        hocr.html_schema("page")


def test_what_is_left_out_is_not_parsed():
    assert "_title:string,span:array<struct<_VALUE" not in hocr.html_schema("lines") and "body" not in hocr.html_schema("head")
    assert "span:array<struct<_VALUE:string>>" in hocr.html_schema("words") and "_VALUE" not in hocr.html_schema("attributes")


def test_a_record_of_one_document_and_others(spark):
    one, two = "<html><body/></html>", "<html lang='x'><body/></html>"
    values = [one, two, one + two, one + "\n", "x" + one, "<htmlx>" + one, "<html></html", "</html>" + one, "<html></html><p></html>", "", None]
    raw = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "file int, value string")
    got = hocr.parse_hocr(raw, level="head").groupBy("file").agg(F.count("html").alias("n"), F.count("*").alias("rows"))
    assert [tuple(r) for r in got.orderBy("file").collect()] == [
        (0, 1, 1), (1, 1, 1), (2, 2, 2), (3, 1, 1), (4, 1, 1), (5, 1, 1), (6, 0, 1), (7, 1, 1), (8, 1, 1), (9, 0, 1), (10, 0, 1)
    ]


def test_files_written_where_their_pieces_are(spark, tmp_path):
    import gzip

    texts = {f"{k}.txt.gz": [f"{k}-{j} é" for j in range(4)] for k in range(9)}
    pieces = spark.createDataFrame([(n, j, t) for n, ts in texts.items() for j, t in enumerate(ts)], "name string, j int, value string")
    files = named.write_named(pieces.repartition(3, "name"), str(tmp_path / "out"), ["j"], sep="\n", dealt=True)
    assert {r.name: r.bytes for r in files.collect()} == {n: len("\n".join(t).encode()) for n, t in texts.items()}
    for n, t in texts.items():
        assert gzip.decompress((tmp_path / "out" / n).read_bytes()).decode() == "\n".join(t)
    again = spark.read.text(str(tmp_path / "out"), wholetext=True)
    assert sorted(r.value for r in again.collect()) == sorted("\n".join(t) for t in texts.values())


@pytest.mark.parametrize("fmt, levels", [("txt", {"head", "words"}), ("hocr", {"head", "pages", "lines", "words", "chars"})])
def test_convert_reads_what_each_table_needs(spark, tmp_path, fmt, levels):
    raw = spark.createDataFrame(
        [("a/one.hocr", NESTED), ("b/two.hocr", FLAT + NESTED), ("c/bad.hocr", FLAT.replace("</div>", "")), ("d/none.hocr", "x")], "file string, value string"
    )
    asked = set()

    def read(level):
        asked.add(level)
        return batch.parse_batch(raw, level)

    rows = [sorted(map(repr, batch.convert(d, str(tmp_path / n), fmt).collect())) for n, d in (("whole", batch.parse_batch(raw)), ("levels", read))]
    assert rows[0] == rows[1] and asked == levels
    files = [{f.name: f.read_text() for f in (tmp_path / n).iterdir() if f.suffix == f".{fmt}"} for n in ("whole", "levels")]
    assert files[0] == files[1] and len(files[0]) == 2


def test_many_small_files_share_tasks(spark, tmp_path):
    for k in range(2000):
        (tmp_path / f"{k}.hocr").write_text("x")
    assert hocr.raw_files(spark, str(tmp_path)).rdd.getNumPartitions() <= 16


def test_ingest_keeps_nothing_parsed(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    from ocrspark.streaming import ingest

    monkeypatch.setattr(DataFrame, "persist", lambda *a, **b: pytest.fail("persisted"))
    (tmp_path / "in").mkdir()
    folder = write(tmp_path / "in", a=FLAT, b="none")
    ingest.stream_hocr(spark, folder, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    counts = {t: ingest.read_sink(spark, str(tmp_path / "out"), t).count() for t in ingest.TABLES}
    assert counts == {"pages": 2, "words": 3, "errors": 1}


def test_csv_is_packed(spark, tmp_path, rows):
    data = spark.range(5000).selectExpr("id", "concat('word ', id % 9) as text").coalesce(1)
    sizes = {}
    for compress in (True, False):
        path = tmp_path / f"csv{compress}"
        tables.write_words_csv(data, str(path), **({} if compress else {"compress": False}))
        sizes[compress] = sum(f.stat().st_size for f in path.glob("part-*"))
        assert rows(tables.read_words_csv(spark, str(path), data.schema)) == rows(data)
    assert sizes[True] * 2 < sizes[False]
