"""Ranks and running totals over documents longer than one block."""

import random

from pyspark.sql import functions as F

from ocrspark.operators import annotations, flow, positions, search, selection

PAGES = [0, 1, 5, 4095, 4096, 4097, 9000, 20000, 20001, 70000]


def counts(spark, seed=1):
    rng = random.Random(seed)
    data = [(d, p, rng.choice((0, 0, 1, 3))) for d in (1, 2, 3) for p in PAGES]
    return data, spark.createDataFrame(data, "doc_id bigint, page_no int, n bigint")


def test_prefix_sums(spark):
    data, df = counts(spark)
    got = {(r.doc_id, r.page_no): r.before for r in positions.prefix_sums(df, ["doc_id"], ["page_no"], "n").collect()}
    assert got == {(d, p): sum(n for e, q, n in data if e == d and q < p) for d, p, _ in data}


def test_rank_in(spark):
    rng = random.Random(2)
    data = list({(d, rng.choice(PAGES), rng.randrange(4), i) for d in (1, 2) for i in range(300)})
    df = spark.createDataFrame(data, "doc_id bigint, page_no int, top int, no int")
    ranked = positions.rank_in(df, ["doc_id"], ["page_no", "top"], ["no"], "rank")
    got = {(r.doc_id, r.no): r["rank"] for r in ranked.collect()}
    for d in (1, 2):
        order = sorted((x for x in data if x[0] == d), key=lambda x: x[1:])
        assert [got[d, x[3]] for x in order] == list(range(1, len(order) + 1))


def test_match_navigation(spark):
    data, df = counts(spark, 3)
    got = {(r.doc_id, r.page_no): (r.prev_page, r.next_page) for r in search.match_nav(df).collect()}
    for d, p, _ in data:
        hits = [q for e, q, n in data if e == d and n > 0]
        want = (max((q for q in hits if q < p), default=None), min((q for q in hits if q > p), default=None))
        assert got[d, p] == want


def test_match_label(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (1, 5000, 1), (1, 9000, 3)], "doc_id bigint, page_no int, n bigint")
    got = {r.page_no: r.label for r in search.match_label(df).collect()}
    assert got == {0: "1-2", 1: "-", 5000: "3", 9000: "4-6"}


ANNOTS = "doc_id bigint, page_no int, annot_no int, group_id string, l int, t int, r int, b int"


def test_index_uses_first_appearance(spark):
    # Group a appears first at top 50 although a later highlight of it lies higher.
    data = [(1, 0, 0, "a", 0, 50, 1, 60), (1, 0, 1, "b", 0, 20, 1, 30), (1, 0, 2, "a", 0, 5, 1, 10),
            (1, 0, 3, None, 0, 1, 1, 2), (1, 6000, 0, "c", 0, 0, 1, 1), (1, 6000, 1, "b", 0, 0, 1, 1)]
    df = spark.createDataFrame(data, ANNOTS)
    got = [(r.group_id, r.page_no, r.top, r.idx) for r in annotations.annot_index(df).orderBy("idx").collect()]
    assert got == [("b", 0, 20, 1), ("a", 0, 50, 2), ("c", 6000, 0, 3)]
    assert [r.n for r in annotations.annot_count(df).collect()] == [3]


def test_navigation_wraps_and_skips_anchor(spark):
    data = [(1, 2, 0, "a", 0, 0, 1, 1), (1, 2, 1, "b", 0, 9, 1, 10), (1, 5000, 0, "c", 0, 0, 1, 1)]
    index = annotations.annot_index(spark.createDataFrame(data, ANNOTS))
    places = [(1, 0, None), (1, 2, None), (1, 3, None), (1, 6000, None), (1, 2, "a"), (1, 5000, "c"), (1, 2, "zz")]
    nav = annotations.annot_nav(index, spark.createDataFrame(places, "doc_id bigint, page_no int, group_id string"))
    got = {(r.page_no, r.group_id): (r.prev_group, r.next_group) for r in nav.collect()}
    assert got == {
        (0, None): ("c", "b"), (2, None): ("a", "b"), (3, None): ("a", "a"), (6000, None): ("b", "a"),
        (2, "a"): ("c", "b"), (5000, "c"): ("b", "a"), (2, "zz"): ("a", "b"),
    }


def test_counter_position(spark):
    data = [(1, 2, 0, "a", 0, 0, 1, 1), (1, 2, 1, "b", 0, 9, 1, 10), (1, 5000, 0, "c", 0, 0, 1, 1)]
    index = annotations.annot_index(spark.createDataFrame(data, ANNOTS))
    places = [(1, 0, None), (1, 2, None), (1, 2, "b"), (1, 2, ""), (1, 2, "zz"), (1, 7, "c"), (2, 0, None)]
    at = annotations.annot_position(index, spark.createDataFrame(places, "doc_id bigint, page_no int, group_id string"))
    got = {(r.doc_id, r.page_no, r.group_id): (r.position, r.total) for r in at.collect()}
    assert got == {
        (1, 0, None): (0, 3), (1, 2, None): (1, 3), (1, 2, "b"): (2, 3), (1, 2, ""): (1, 3), (1, 2, "zz"): (0, 3),
        (1, 7, "c"): (3, 3), (2, 0, None): (0, 0),
    }


def test_width_is_split_where_the_words_are(spark):
    rng = random.Random(4)
    data = [(d, p, l, w, rng.choice(("a", "word", "longer"))) for d in range(3) for p in range(2) for l in range(5000, 5004) for w in range(4)]
    df = spark.createDataFrame(data, "doc_id long, page_no int, line_no int, word_no int, text string").withColumn("par_no", F.col("page_no"))
    got = flow.split_width(df.repartition(4, "doc_id"), 20)
    assert got._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS") == 0
    want = {}
    for d, p in {x[:2] for x in data}:
        at = 0
        for *_, text in sorted(x for x in data if x[:2] == (d, p)):
            want.setdefault((d, p, at // 20), []).append(text)
            at += len(text) + 1
    assert {(r.doc_id, r.page_no, r.n): r.text for r in got.collect()} == {k: " ".join(v) for k, v in want.items()}


def test_reading_order_in_as_many_ranges_as_asked_for(spark):
    df = spark.createDataFrame([(d, p, 0, w, "x") for d in range(5) for p in range(4) for w in range(9)], "doc_id long, page_no int, line_no int, word_no int, text string")
    got = selection.reading_order(df, 11)
    parts = [r.n for r in got.groupBy(F.spark_partition_id().alias("n")).count().collect()]
    assert 9 <= len(parts) <= 11 and max(parts) >= 8
    assert [(r.doc_id, r.position) for r in got.collect()] == [(d, k + 1) for d in range(5) for k in range(36)]
