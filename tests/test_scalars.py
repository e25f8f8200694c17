"""Scalar rules on edge values."""

from pyspark.sql import functions as F

from ocrspark.functions import names, text as tx
from ocrspark.operators import layout, search, selection


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_parse_numbers(spark):
    assert column(spark, ["12px", " -3", "x1", "", None, "99999999999", "3.9"], tx.parse_int) == [
        12, -3, None, None, None, None, 3]
    assert column(spark, ["1.5em", ".5", "abc", "7."], tx.parse_float) == [1.5, 0.5, None, 7.0]


def test_norm_and_quotes(spark):
    assert column(spark, ["Ab-C.", "$5", "—"], tx.norm) == ["abc", "5", ""]
    quoted = column(spark, ["\"a\" 'b'", "it's", "(\"x\")", "\"'n'\""], tx.smart_quotes)
    assert quoted == ["“a” ‘b’", "it’s", "(“x”)", "“‘n’”"]


def test_trim_takes_every_blank(spark):
    assert column(spark, [" \ta b　﻿", " \u000b"], tx.trim_all) == ["a b", ""]


def test_file_names(spark):
    assert column(spark, ["a.hocr", "b.tar.gz", "c", "d.toolongext", "e.x y"], names.base_name) == [
        "a", "b.tar", "c", "d.toolongext", "e.x y"]
    out = lambda fmt, zipped: column(spark, ["a.pdf"], lambda v: names.out_name(v, F.lit(fmt), F.lit(zipped)))[0]
    assert [out("alto", True), out("txt", True), out("project", True), out("project", False)] == [
        "a.xml", "a.txt", "a.project", "a.project.json"]
    image = lambda v: names.image_name(F.lit("p"), v)
    assert column(spark, [7, 123, 1234], image, "int") == ["p_007.png", "p_123.png", "p_1234.png"]
    assert column(spark, [".xml (ALTO)", ".TXT"], names.format_type) == ["alto", "txt"]


def test_languages(spark):
    langs = [[], None, ["eng", "chi_sim"], ["a", "b", "cD"]]
    assert column(spark, langs, names.lang_label, "array<string>") == [
        "Lang: Eng", "Lang: Eng", "Lang: Eng+Chi_sim", "Lang: A+B+CD"]
    assert column(spark, langs, names.many_langs, "array<string>") == [False, False, False, True]


def test_page_ranges(spark):
    cases = [("", "", 5), ("2", "4", 5), ("4", "2", 5), ("9", "9", 5), ("1", "5", 5), ("0", "-1", 3), ("3", "x", 5)]
    docs = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "doc_id bigint, a string, z string, page_count int")
    out = selection.clamp_pages(docs, F.col("a"), F.col("z")).orderBy("doc_id").collect()
    assert [(r.min_page, r.max_page, r.label) for r in out] == [
        (1, 5, " Pages: All"), (2, 4, " Pages: 2–4"), (2, 2, " Pages: 2–2"), (1, 5, " Pages: All"),
        (1, 5, " Pages: All"), (1, 3, " Pages: All"), (3, 5, " Pages: 3–5")]


def test_kv_map(spark):
    text = "a 1\n  b   two words \n\na 2\nflag\n"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert {r.key: r.value for r in selection.kv_map(df).collect()} == {"a": "2", "b": "  two words", "flag": ""}


def test_highlight_rect(spark):
    df = spark.createDataFrame([(10, 100, 50, 120)], "l int, t int, r int, b int")
    got = selection.highlight_rect(df).collect()[0]
    assert (got.x, got.y, got.width, got.height) == (10.0, 96.0, 40.0, 28.0)


def test_common_value(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, None)], "k int, font string")
    got = {r.k: r.font for r in selection.common_value(df, "font", ["k"]).collect()}
    assert got == {1: "a", 2: "", 3: ""}


def test_phrases(spark):
    line = "The cat sat; then the Cat sat".split()
    df = spark.createDataFrame([(1, 0, 0, i, w) for i, w in enumerate(line)] + [(1, 1, 0, 0, "cat")],
                               "doc_id bigint, page_no int, line_no int, word_no int, text string")
    count = lambda q: {r.page_no: r.n for r in search.find_text(df, q).collect()}
    assert count("cat") == {0: 2, 1: 1}
    assert count(" CAT  sat ") == {0: 2, 1: 0}
    assert count("e cat sat") == {0: 2, 1: 0}
    assert count("cat sat; th") == {0: 1, 1: 0}
    assert count("  ") == {}
    assert sorted(r.word_no for r in search.find_words(df, "the cat").collect()) == [0, 1, 4, 5]


REGION = "doc_id bigint, page_no int, region_id string, region_seq int, kind string, ord int, l int, t int, r int, b int"


def test_layout_copy_ignores_bad_ranges(spark, rows):
    regions = spark.createDataFrame([(1, 0, "a", 0, "order", 1, 0, 0, 9, 9), (1, 1, "b", 0, "order", 2, 0, 0, 9, 9)], REGION)
    pages = spark.createDataFrame([(1, p) for p in range(3)], "doc_id bigint, page_no int")
    docs = spark.createDataFrame([(1, 3)], "doc_id bigint, page_count int")
    copy = lambda lo, hi: rows(layout.propagate_layout(regions, pages, docs, 0, lo, hi), "page_no", "region_id")
    assert copy("x", "3") == copy("3", "2") == [(0, "a"), (1, "b")]
    assert copy("2", "99") == copy("-5", "99") == [(0, "a"), (1, "a"), (2, "a")]


def test_excluded_line_under_two_boxes_is_listed_twice(spark, rows):
    regions = spark.createDataFrame([(1, 0, "a", 0, "exclude", None, 0, 0, 99, 20), (1, 0, "b", 1, "exclude", None, 0, 0, 60, 20),
                                     (1, 0, "o1", 2, "order", 4, 0, 30, 99, 60), (1, 0, "o2", 3, "order", 2, 0, 30, 99, 60)], REGION)
    lines = spark.createDataFrame([(1, 0, 0, 0, 0, 90, 18), (1, 0, 1, 0, 40, 90, 58), (1, 0, 2, 0, 80, 90, 98)],
                                  "doc_id bigint, page_no int, line_no int, l int, t int, r int, b int")
    words = spark.createDataFrame([(1, 0, 0, 0, "x"), (1, 0, 0, 1, "y"), (1, 0, 1, 0, "z"), (1, 0, 2, 0, "v")],
                                  "doc_id bigint, page_no int, line_no int, word_no int, text string")
    assert rows(layout.excluded_text(words, lines, regions), "region_id", "text") == [("a", "x y "), ("b", "x y ")]
    assert layout.excluded_text(words, lines, regions, apply=False).count() == 0
    # The last order box in map order wins; a line in none has priority 10.
    assert rows(layout.line_priority(lines, regions), "line_no", "priority") == [(0, 10), (1, 2), (2, 10)]
    assert rows(layout.reorder(words, lines, regions), "line_no", "priority") == [(1, 2), (2, 10)]
