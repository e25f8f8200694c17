"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ocrspark.llm import (
    bpe, chat_format, decontaminate, embedding_dedup, line_dedup, minhash_dedup, quality, resharding, toxicity, warc,
)
from ocrspark.session import scratch_dir

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORDS = " ".join(f"w{k}" for k in range(40))
LONG = " ".join(f"x{k}" for k in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, unit int, n string, score string"


def rows_of_docs():
    texts = [
        (0, WORDS), (1, WORDS + " more"), (2, None), (3, ""), (4, " \t"), (5, "one two"), (6, "one two"), (6, "one two"),
        (None, WORDS), (None, None), (7, LONG), (8, LONG + " tail"), (9, "é\nÉ\n" + WORDS), (10, "same line\nSame Line \nx"),
        (11, "same line\ny"),
    ]
    return [(i, t, "en" if i != 9 else None, None, 0, 1, "n", "s") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of_docs(), DOCS)


def test_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [0.999, 0.01, 0.0]
    data = [
        (1, a), (2, b), (3, None), (4, [0.0, 0.0, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [None, 1.0, 0.0]), (7, []),
        (8, [1.0, 0.0]), (2, b), (None, a), (None, None), (9, [float("inf"), 0.0, 0.0]), (10, [1e-300, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = sorted(embedding_dedup.near_duplicates(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0, -r.n_links))
    linked = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got]
    assert linked[:3] == [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False)]
    assert linked[3:9] == [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8)]
    assert linked[9:] == [(9, 0, 9, True), (10, 4, 1, False), (None, 4, 1, False), (None, 0, None, True)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_lines(docs):
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs, min_docs=2).collect()}
    assert (2, 1, 0, "") in got and (3, 1, 0, "") in got and (4, 1, 0, " \t") in got
    assert (10, 3, 1, "same line\nx") in got and (11, 2, 1, "y") in got  # the first occurrence stays
    assert (5, 1, 0, "one two") in got and (6, 1, 1, "") in got
    assert (9, 3, 1, "é\nÉ") in got  # only A-Z are lower-cased
    assert (None, 1, 1, "") in got and (None, 1, 0, "") in got
    out = line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit("old")), min_docs=2, keep="none")
    assert dict(out.dtypes)["n_lines"] == "bigint" and out.count() == len(rows_of_docs())
    assert {r.text for r in out.where("doc_id in (10, 11)").collect()} == {"x", "y"}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_texts(docs):
    got = minhash_dedup.near_duplicates(docs).collect()
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got}
    assert len(got) == len(rows_of_docs())
    assert {(0, 36, 0, True), (1, 37, 0, False), (None, 36, 0, False), (None, 0, None, True)} <= rows
    assert {(k, 0, k, True) for k in (2, 3, 4)} <= rows
    assert {(5, 1, 5, True), (6, 1, 5, False), (7, 59_996, 7, True), (8, 59_997, 7, False)} <= rows
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_benchmark(spark, docs):
    items = spark.createDataFrame(
        [(1, "W3 w4 (w5) w6, w7 w8 w9 w10"), (2, None), (3, " "), (4, "one two"), (None, WORDS), (5, "zebra crossing ahead"), (1, "q r s")],
        "item_id long, text string",
    ).withColumn("words", F.lit("clash"))
    got = {(r.doc_id, r.item_id, r.score, r.last_word) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {
        (0, 1, 1.0, 10), (1, 1, 1.0, 10), (9, 1, 1.0, 12), (None, 1, 1.0, 10), (5, 4, 1.0, 1), (6, 4, 1.0, 1),
    }
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_classifiers(spark, docs):
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (5, 0, 0), (None, 1, 1), (7, None, None), (0, 1, 0), (99, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    for operator, label in ((toxicity, "toxic"), (quality, "quality")):
        for known in (labels, labels.limit(0)):
            model = operator.train(docs, known, label)
            out = operator.score(docs, model).select("doc_id", "score").collect()
            assert len(out) == len(rows_of_docs()) and all(0 <= r.score <= 1 for r in out)
        assert operator.score(docs.limit(0), model).count() == 0


def test_toxicity_learns_from_every_unit(spark, monkeypatch):
    """Words that mark a class occur in a few rows each, in different units; a mark may be beyond the longest step."""
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    monkeypatch.setattr(toxicity, "BATCH_WORDS", 100)
    marks = [f"{'bad' if k % 2 else 'good'}{chr(97 + k // 2)}" for k in range(40)]
    filler = " ".join(f"f{k % 7}" for k in range(300))
    texts = [(k, f"{filler if k % 50 == 0 else 'some'} text {marks[k % 40]}", k % 2) for k in range(800)]
    df = spark.createDataFrame([(k, t, "en") for k, t, _ in texts], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, y) for k, _, y in texts], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "MEETINGS", 8)
    model = toxicity.train(df, labels, rows=150)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    wrong = [k for k, _, y in texts if (got[k] >= 0.5) != y]
    assert len(wrong) <= 16 and "en" in model.thresholds
    again = toxicity.train(df, labels, rows=150)
    assert (again.embedding == model.embedding).all() and again.thresholds == model.thresholds


def test_units_hold_every_row_once():
    import pyarrow as pa

    sizes = [3, 1, 50, 2, 2, 2, 2, 9, 0, 1]
    parts = [0, 0, 0, 0, 0, 0, 1, 1, 2, 2]
    table = pa.table({"id": list(range(10)), "words": [[1] * n for n in sizes], "part": parts})
    got = [(key, u["id"].to_pylist()) for key, u in toxicity._units(table.to_batches(max_chunksize=4), 3, 10)]
    assert [ids for _, ids in got] == [[0, 1], [2], [3, 4, 5], [6], [7], [8, 9]]
    assert [key for key, _ in got] == [0, 1, 2, 1 << 32, (1 << 32) + 1, 2 << 32]


def test_chat(spark):
    data = [
        (1, 0, "System: be brief", "system"), (1, 1, "User: hello?\nAssistant: hi\nthere", "user"), (1, 1, None, None),
        (2, None, "", "odd"), (None, 0, "Human: q", None), (None, 0, "Human: q", None), (3, 5, "x\n" * 3000, "user"),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, text string, role string").withColumn("path", F.lit(1))
    for known in (df, df.limit(0)):
        got = chat_format.format_chat(df, chat_format.train(known)).collect()
        assert len(got) == 8
        texts = {(r.conv_id, r.turn, r.block): (r.role, r.rendered) for r in got if r.conv_id == 1 and r.rendered.count("\n") > 1}
        assert texts[1, 0, 0] == ("system", "<|system|>\nbe brief\n<|end|>")
        assert texts[1, 1, 1] == ("assistant", "<|assistant|>\nhi\nthere\n<|end|>")
    assert chat_format.format_chat(df.limit(0), chat_format.train(df)).count() == 0


def test_warc(spark):
    big = "<p>" + "é" * 200
    data = [
        (3, "http://a", big), (1, None, big), (2, "http://b\r\nX: y", big), (4, "u", None), (5, "u", ""), (6, "u", "small"),
        (7, "u", "small"), (None, "u", big), (1, "u", big), (8, "u", "a\r\n\r\nb" * 30), (None, None, None), (9, "u", LONG),
    ]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.archive(df).collect()
    assert len(got) == len(data)
    digest = hashlib.sha256(big.encode()).hexdigest()
    kinds = sorted(((r.page_id or 0), r.record_type, r.refers_to) for r in got if r.payload_digest == digest)
    assert kinds == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "revisit", 1)]
    rest = {r.page_id: (r.payload_bytes, r.record_type) for r in got if r.page_id and r.page_id > 3}
    assert rest == {4: (0, "response"), 5: (0, "response"), 6: (5, "response"), 7: (5, "response"), 8: (180, "response"),
                    9: (len(LONG), "response")}
    assert warc.archive(df.limit(0)).count() == 0


def test_bpe(docs):
    out = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit("clash")), VOCABULARY), VOCABULARY)
    rows = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert rows[2].ids == rows[3].ids == [] and rows[2].decoded == ""
    assert rows[5].ids == rows[6].ids and rows[5].decoded == "one</w> two</w>"
    assert len(rows[7].ids) >= 60_000
    assert bpe.round_trip(docs, VOCABULARY).count() == len(rows_of_docs())
    assert bpe.round_trip(docs.limit(0), VOCABULARY).count() == 0


def test_shards(spark, docs):
    old = F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0))
    out = resharding.reshard(docs.withColumn("slot", F.lit("x")), scratch_dir(spark, "t"), old, 4).collect()
    assert len(out) == len(rows_of_docs())
    for s in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert resharding.reshard(docs.limit(0), scratch_dir(spark, "t"), old, 4).count() == 0


CLASHING = ("__id", "__h", "_h", "_drop", "__drop", "_old", "__size", "_size", "_Block", "_part", "_base", "_crc", "_score", "_t1")


@pytest.mark.parametrize("operator", ["lines", "shards", "stages"])
def test_columns_of_any_name_pass_through(spark, docs, operator, tmp_path):
    """Columns with names like those of our helper columns come back as they were."""
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumns({c: F.lit(77 + k) for k, c in enumerate(CLASHING)})
    if operator == "lines":
        out = line_dedup.dedup_lines(named, min_docs=2)
    elif operator == "shards":
        out = resharding.reshard(named, scratch_dir(spark, "t"), F.lit(0), 3)
    else:
        spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        out = corpus_pipeline.drop_copies(spark, corpus_pipeline.drop_toxic(spark, named, str(tmp_path)), str(tmp_path))
    assert set(CLASHING) <= set(out.columns)
    for row in out.select(*CLASHING).collect():
        assert [row[c] for c in CLASHING] == [77 + k for k in range(len(CLASHING))]


def test_many_equal_rows_name_their_lines_once(spark):
    """Equal rows do not multiply the numbers of the lines they lose."""
    text = "\n".join(f"line {k}" for k in range(40))
    df = spark.createDataFrame([(1, text)] * 60 + [(None, text)] * 60 + [(2, "line 3\nown")], "doc_id long, text string")
    out = line_dedup.dedup_lines(df, min_docs=2, keep="none").collect()
    assert sorted({(r.doc_id, r.n_dropped, r.text) for r in out}, key=repr) == [(1, 40, ""), (2, 1, "own"), (None, 40, "")]


def test_cosine_at_the_threshold_is_decided_one_way(spark):
    """A pair at the threshold is linked or not, whatever the size of its bucket."""
    rng = np.random.default_rng(8)
    a = rng.standard_normal(64)
    side = rng.standard_normal(64)
    side -= a * (side @ a) / (a @ a)
    a, side = a / np.linalg.norm(a), side / np.linalg.norm(side)
    pair = [a, 0.95 * a + np.sqrt(1 - 0.95**2) * side]
    unit = [v / np.abs(v).max() for v in pair]
    unit = [v / np.linalg.norm(v) for v in unit]
    limit = math.fsum((unit[0] * unit[1]).tolist())
    few = [(k, v.tolist()) for k, v in enumerate(pair)]
    many = few + [(k, pair[0].tolist()) for k in range(2, 200)]
    many += [(k, (pair[0] * 2.0 ** (k - 199)).tolist()) for k in range(200, 300)]  # one direction, different vectors
    for threshold, linked in ((limit, True), (np.nextafter(limit, 1), False)):
        for rows in (few, many):
            df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
            got = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(df, threshold=float(threshold)).collect()}
            assert (got[1] == 0) == linked


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, docs, empty, tmp_path):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8 w9")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now = docs.select(columns).limit(0) if empty else docs.select(columns)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert out.columns == columns
            assert stage(spark, out, str(tmp_path)).count() <= now.count()
    assert not empty or out.count() == 0


def test_stages_without_ids(spark, tmp_path):
    """Rows without an id are documents of their own in the stages that drop by id."""
    item = " ".join(f"v{k}" for k in range(20))
    other = " ".join(f"u{k}" for k in range(40))
    texts = [
        (1, WORDS), (None, WORDS), (None, WORDS + " more"), (None, other), (None, other), (None, other + " more"), (None, None),
        (None, None), (None, " "), (None, "clean " + WORDS[:60]), (None, "leak " + item), (2, LONG[:200] + " " + item), (3, "fine text"),
        (3, "fine text"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, df, str(tmp_path)).collect()]
    assert len([t for _, t in got if t and t.startswith("u0")]) == 1
    assert sorted((r for r in got if not (r[1] or "").startswith("u0")), key=repr) == sorted(
        [(1, WORDS), (None, None), (None, None), (None, " "), *texts[9:]], key=repr
    )
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_benchmark(spark, df, str(tmp_path)).collect()]
    assert sorted(left, key=repr) == sorted([t for t in texts if item not in (t[1] or "")], key=repr)
