"""Versions stored by page, and totals kept up to date."""

import pytest
from pyspark.sql import functions as F

from ocrspark.operators import evaluate, totals
from ocrspark.plans import derived as d
from ocrspark.sources import version_store as vs

from conftest import SF_DIR


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sides"))
    for name, df in (("gt", d.gt_words(spark, SF_DIR)), ("ocr", d.ocr_words(spark, SF_DIR))):
        df.write.parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/gt"), spark.read.parquet(f"{path}/ocr")


@pytest.fixture(scope="module")
def store(spark, sides, tmp_path_factory):
    made = vs.create(sides[0], str(tmp_path_factory.mktemp("versions") / "store"), buckets=4)
    for words, name in zip(sides, ("truth", "read")):
        vs.store_version(made, words, name)
    return made


OPERATORS = {
    "status": (evaluate.word_status, {}),
    "stats": (evaluate.eval_versions, {}),
    "data": (evaluate.combine, {"mode": "data"}),
    "conf": (evaluate.combine, {"mode": "conf"}),
    "conflicts": (evaluate.conflicts, {}),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_stored_versions_give_the_rows_of_the_operators(store, sides, rows, name):
    operator, options = OPERATORS[name]
    want = operator(*sides, **options)
    assert rows(vs.compare(store, "truth", "read", operator, **options), *want.columns) == rows(want)


def test_pages_large_in_either_version_take_the_other_way(spark, sides, rows, tmp_path):
    store = vs.create(sides[0], str(tmp_path / "store"), buckets=3)
    sizes = sorted(r["count"] for r in sides[0].groupBy("doc_id", "page_no").count().collect())
    # the limits differ, so that some pages are large in one version only
    vs.store_version(store, sides[0], "truth", large=sizes[len(sizes) // 2])
    vs.store_version(store, sides[1], "read", large=sizes[-1])
    with vs.by_page(spark):
        parts = vs.compared(store, "truth", "read", evaluate.eval_versions)
    assert len(parts) == 2
    want = evaluate.eval_versions(*sides)
    assert rows(vs.compare(store, "truth", "read", evaluate.eval_versions), *want.columns) == rows(want)
    assert rows(store.words("truth"), *sides[0].columns) == rows(sides[0])


def test_no_words_are_shuffled_before_pairs_are_known(spark, store):
    with vs.by_page(spark):
        (pairs,) = vs.compared(store, "truth", "read", evaluate.align)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        (stats,) = vs.compared(store, "truth", "read", evaluate.conflicts)
        assert "Exchange" not in stats._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_a_version_is_replaced_when_all_is_written(spark, sides, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store = vs.create(sides[0], path)
    assert store.buckets == vs.LEAST_BUCKETS and store.versions() == []
    with pytest.raises(ValueError, match="no version"):
        store.words("truth")
    vs.store_version(store, sides[1], "it's: a/b", large=5)
    vs.store_version(store, sides[0].limit(0), "none")
    assert store.words("none").count() == 0
    monkeypatch.setattr(vs, "_COMMITS", "broken")  # ends before the row of commits
    with pytest.raises(Exception):
        vs.store_version(store, sides[0], "it's: a/b")
    monkeypatch.undo()
    again = vs.open_store(spark, path)
    assert rows(again.words("it's: a/b"), *sides[1].columns) == rows(sides[1])
    vs.store_version(again, sides[0], "it's: a/b")
    assert rows(again.words("it's: a/b"), *sides[0].columns) == rows(sides[0])
    assert again.versions() == ["it's: a/b", "none"]
    assert vs.compare(again, "it's: a/b", "none", evaluate.conflicts).count() == 0


STATS = "doc_id bigint, page_no int, " + ", ".join(f"{c} bigint" for c in evaluate.STATS)


def _page(doc, page, total, correct):
    return (doc, page, total, correct, total - correct, 0, 0, 0, 0)


def _rolled(spark, pages):
    """Totals over the present pages, read anew."""
    df = spark.createDataFrame([_page(d, p, *v) for (d, p), v in pages.items()], STATS)
    rows = evaluate.eval_doc(df).filter("level > 0")
    return sorted((tuple(r) for r in rows.select("doc_id", "level", *evaluate.STATS).collect() if r.total is not None), key=repr)


def test_totals_follow_corrections(spark, rows, tmp_path):
    path, pages = str(tmp_path / "totals"), {}
    columns = ("doc_id", "level", *evaluate.STATS)
    batches = [
        ({(d, p): (100 + d, 90 - p) for d in range(6) for p in range(4)}, []),
        ({(1, 2): (50, 50), (9, 0): (7, 0), (None, 1): (3, 3)}, []),
        ({}, [(5, p) for p in range(4)] + [(77, 0)]),
        ({(1, 2): (50, 50), (None, 1): (4, 1)}, [(0, 0), (1, 2)]),
        ({}, []),
        ({(5, 1): (8, 8)}, [(9, 0)]),
    ]
    for k, (changed, gone) in enumerate(batches):
        stats = spark.createDataFrame([_page(d, p, *v) for (d, p), v in changed.items()], STATS)
        stats = stats.union(stats)  # every row twice
        totals.apply_corrections(stats, path, k, spark.createDataFrame(gone, "doc_id bigint, page_no int"))
        totals.apply_corrections(stats, path, k)  # a repeated batch counts once
        for key in gone:
            if key not in changed:
                pages.pop(key, None)
        pages |= changed
        assert rows(totals.totals(spark, path), *columns) == _rolled(spark, pages)
    assert totals.totals(spark, path).filter("level = 3").first().pages == len(pages)
    want = sorted((_page(d, p, *v) for (d, p), v in pages.items()), key=repr)
    assert rows(totals.page_stats(spark, path)) == want
    with pytest.raises(ValueError, match="comes after"):
        totals.apply_corrections(stats, path, -1)
    compacted = totals.compact(spark, path, 9)
    assert rows(totals.totals(spark, compacted)) == rows(totals.totals(spark, path))
    assert all("/sums/" in f for f in totals.totals(spark, path).inputFiles())


def test_a_failed_batch_is_not_counted(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "totals")
    first = spark.createDataFrame([_page(1, 0, 10, 9), _page(2, 0, 20, 9)], STATS)
    second = spark.createDataFrame([_page(1, 0, 10, 10)], STATS)
    with pytest.raises(ValueError, match="no batch"):
        totals.totals(spark, path)
    totals.apply_corrections(first, path, 0)
    before = rows(totals.totals(spark, path))
    second.withColumn("pages", F.lit(1)).write.parquet(f"{path}/pages/batch=1/part=3")  # cut off before its sums
    assert rows(totals.totals(spark, path)) == before
    totals.apply_corrections(second, path, 1)
    assert totals.totals(spark, path).filter("level = 3").first().correct == 19


def test_totals_of_a_stream(spark, rows, tmp_path):
    arriving = str(tmp_path / "in")
    for k in range(3):
        changed = [_page(d, 0, 10 + k, 5 + k) for d in range(k, 4)]
        spark.createDataFrame(changed, STATS).coalesce(1).write.mode("append").parquet(arriving)
    stream = spark.readStream.schema(STATS).option("maxFilesPerTrigger", 1).parquet(arriving)
    totals.stream_corrections(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    last = {(0, 0): (10, 5), (1, 0): (11, 6), (2, 0): (12, 7), (3, 0): (12, 7)}
    assert rows(totals.totals(spark, str(tmp_path / "out")), "doc_id", "level", *evaluate.STATS) == _rolled(spark, last)


def _moved(df) -> int:
    """Exchanges of the plan above those that deal the texts."""
    return df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


@pytest.fixture
def dealt(spark, tmp_path):
    """Both versions cut out of texts that are dealt by document; page 5 of document 2 is missing in one."""
    path = str(tmp_path / "tables")
    texts = [(i, "\n".join(f"word{i} number {k} of the text" for k in range(9))) for i in range(6)]
    rows = spark.createDataFrame([(i, t, "eng", "web", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    rows.coalesce(1).write.parquet(f"{path}/documents.parquet")
    return lambda pages=None: (d.gt_words(spark, path, pages), d.ocr_words(spark, path, pages))


@pytest.mark.parametrize("name", ["status", "data", "conf", "conflicts"])
def test_words_dealt_by_document_are_not_shuffled(spark, dealt, rows, name, monkeypatch):
    operator, options = OPERATORS[name]
    got = operator(*dealt(), **options)
    assert _moved(got) <= 1  # the levels of the boxes, one row
    plain = [spark.createDataFrame(w.collect(), w.schema) for w in dealt()]
    assert rows(got) == rows(operator(*plain, **options), *got.columns)


def test_equal_and_null_addresses_count_once(spark, rows):
    cols = "doc_id long, page_no int, line_no int, word_no int, word_id string, text string, conf int, l int, t int, r int, b int"
    word = lambda page, line, no, text, l: (1, page, line, no, text, text, 90, l, 0, l + 50, 16)
    a = spark.createDataFrame([word(0, 0, 0, "a", 0), word(0, None, None, "n", 100), word(0, 0, 3, "x", 300), word(0, 0, 3, "y", 300), word(None, 0, 0, "p", 0)], cols)
    b = spark.createDataFrame([word(0, 0, 0, "a", 0), word(0, None, None, "n", 100), word(None, 0, 0, "q", 0)], cols)
    found = rows(evaluate.word_status(a, b), "page_no", "line_no", "gt_text", "ocr_text", "status")
    assert found == sorted([
        (0, 0, "a", "a", "correct"), (0, None, "n", "n", "correct"), (0, 0, "y", None, "missed"),
        (None, 0, "p", None, "missed"), (None, 0, None, "q", "extra"),
    ], key=repr)


def test_dealt_words_are_stored_without_a_shuffle(spark, dealt, rows, tmp_path):
    truth = dealt(0)[0]
    store = vs.create(truth, str(tmp_path / "store"), buckets=3)
    vs.store_version(store, truth, "truth", dealt=dealt(3)[0])
    assert rows(store.words("truth"), *truth.columns) == rows(truth)
    files = spark.table(store.table).select("_metadata.file_name").distinct().collect()
    assert len({f.file_name for f in files}) <= 3
