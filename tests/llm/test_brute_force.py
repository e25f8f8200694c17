"""Operators that SQL cannot express, against brute force, a round trip or held-out labels, on whole tables."""

import hashlib
import itertools
import random
import string
import types
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ocrspark.llm import bpe, chat_format, decontaminate, embedding_dedup, minhash_dedup, queries, resharding
from ocrspark.llm.common import in_fifths, stored, table

SMALL, MIDDLE, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(text):
    for blank in BLANKS:
        text = (text or "").replace(blank, " ")
    return [w for w in text.translate(LOWER).split(" ") if w]


def shingles_of(text, n=5):
    words = words_of(text)
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def components(ids, links):
    """Least id of the component of every id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def linked_texts(texts, percent=75):
    """All pairs of ids whose sets are similar, by counting shared shingles over an inverted index."""
    sets = {i: shingles_of(t) for i, t in texts.items()}
    owners, shared = {}, {}
    for i in sorted(sets):
        for s in sets[i]:
            for j in owners.setdefault(s, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            owners[s].append(i)
    return sets, [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]


def check_groups(rows, texts):
    sets, links = linked_texts(texts)
    want = components(texts, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in texts}


def linked_vectors(ids, vectors):
    """What the vector contract asks for, from all cosines."""
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = vectors @ vectors.T >= 0.95
    np.fill_diagonal(near, False)
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near)))]
    root = components(ids, links)
    return {i: (int(n), root[i], root[i] == i) for i, n in zip(ids, near.sum(axis=1))}


@pytest.mark.parametrize("sf_dir", [SMALL, LARGE])
def test_vectors(spark, sf_dir):
    data = table(spark, sf_dir, "embeddings").collect()
    want = linked_vectors([r.vec_id for r in data], np.array([r.embedding for r in data], np.float64))
    got = queries.QUERIES["op1_embedding_dedup"](spark, sf_dir).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want


@pytest.mark.parametrize("bits", [None, 3, 20])
def test_groups_of_vectors(spark, bits):
    """A third of the rows equal, a third near each other in several groups, the rest alone."""
    rng = np.random.default_rng(23)
    hot = rng.standard_normal(24)
    heads = rng.standard_normal((5, 24))
    near = heads[rng.integers(0, 5, 300)] + 0.22 * rng.standard_normal((300, 24))
    vectors = np.concatenate([np.tile(hot, (300, 1)), near, rng.standard_normal((300, 24)), hot + 0.1 * rng.standard_normal((40, 24))])
    ids = rng.permutation(len(vectors)).tolist()
    df = spark.createDataFrame(list(zip(ids, vectors.tolist())), "vec_id long, embedding array<double>").repartition(7)
    got = embedding_dedup.near_duplicates(df, bits=bits, block=64).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == linked_vectors(ids, vectors)


def test_signs_of_a_table_grow():
    assert [embedding_dedup.bits_for(n) for n in (0, 1, 4096, 51_282, 10**9, 10**15)] == [4, 4, 4, 8, 22, 31]


def test_texts(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    check_groups(queries.QUERIES["op8_minhash_dedup"](spark, SMALL).collect(), texts)


def test_edited_texts(spark):
    """Copies with more and more edits, so that pairs lie on both sides of the threshold."""
    rng, texts = random.Random(5), {}
    for family in range(30):
        base = [f"t{rng.randrange(4000)}" for _ in range(rng.randrange(3, 150))]
        for edits in range(8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(4000)}"
            texts[len(texts)] = rng.choice(BLANKS).join(copy).upper() if edits % 2 else " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_groups(minhash_dedup.near_duplicates(df, block=16).collect(), texts)


def bare(text):
    return [w.strip(string.punctuation) or w for w in words_of(text)]


def best_alignment(item, text):
    above, best = [0] * (len(text) + 1), 0
    for a in item:
        row = [0]
        for k, b in enumerate(text):
            row.append(max(0, above[k] + (2 if a == b else -1), above[k + 1] - 1, row[k] - 1))
        best, above = max(best, max(row)), row
    return best / (2 * len(item))


def test_benchmark(spark):
    """Whole and edited items inside long texts score as an alignment with the whole text does."""
    rng = random.Random(7)
    items = {k: [f"q{rng.randrange(900)}" for _ in range(rng.randrange(6, 40))] for k in range(25)}
    texts = {}
    for k in range(80):
        text = [f"f{rng.randrange(3000)}" for _ in range(rng.randrange(50, 400))]
        if k % 4:
            passage = list(items[k % 25])
            for _ in range((k % 4 - 1) * len(passage) // 12):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = rng.choice([[], ["z"], [passage[at], "z"]])
            at = rng.randrange(len(text))
            text[at:at] = passage
        texts[k] = text
    found = decontaminate.contaminated(
        spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string"),
        spark.createDataFrame([(k, ", ".join(t).upper()) for k, t in items.items()], "item_id long, text string"),
    ).collect()
    scores = {(d, i): best_alignment(items[i], texts[d]) for d, i in itertools.product(texts, items)}
    want = {pair: score for pair, score in scores.items() if score >= 0.5}
    assert len(want) >= 55
    assert {(r.doc_id, r.item_id): r.score for r in found} == pytest.approx(want)


def check_leaks(spark, texts, items):
    found = decontaminate.contaminated(
        spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string"),
    ).collect()
    scores = {(d, i): best_alignment(items[i], texts[d]) for d, i in itertools.product(texts, items)}
    want = {pair: score for pair, score in scores.items() if score >= 0.5}
    assert {(r.doc_id, r.item_id): r.score for r in found} == pytest.approx(want)
    return want


def test_benchmark_same_edits_in_many_texts(spark):
    """A copy that is edited alike in many texts is found beside a single verbatim one."""
    rng = random.Random(11)
    item = [f"q{k}" for k in range(40)]
    edited = [f"e{k}" if k % 4 == 1 else w for k, w in enumerate(item)]
    texts = {}
    for k in range(13):
        text = [f"f{rng.randrange(10**6)}" for _ in range(60)]
        at = rng.randrange(len(text))
        text[at:at] = item if k == 0 else edited
        texts[k] = text
    want = check_leaks(spark, texts, {1: item})
    assert len(want) == 13 and sorted(want.values())[0] == 0.625


def test_benchmark_without_intact_runs(spark):
    """Copies that share no three words, or no two, in a row with the item reach the threshold too."""
    rng = random.Random(13)
    item = [f"q{k}" for k in range(36)]
    copies = [
        [x for k, w in enumerate(item) for x in ([w, f"e{k}"] if k % 2 else [w])],
        [x for k, w in enumerate(item) for x in (w, f"e{k}")],
        [f"e{k}" if k % 3 == 1 else w for k, w in enumerate(item)],
        [w for k, w in enumerate(item) if k % 3 != 1],
        [f"e{k}" if k % 3 == 2 else w for k, w in enumerate(item) if k % 7],
    ]
    texts = {}
    for k, copy in enumerate(copies * 2):
        text = [f"f{rng.randrange(10**6)}" for _ in range(30 + 11 * k)]
        at = rng.randrange(len(text))
        text[at:at] = copy
        texts[k] = text
    want = check_leaks(spark, texts, {1: item})
    assert {k for k, _ in want} == {0, 1, 2, 3, 5, 6, 7, 8}


@pytest.mark.parametrize("places", [64, 1 << 20])
def test_benchmark_of_few_words(monkeypatch, places):
    """Items and texts over so few words that every pair is frequent, looked up whole and in spans."""
    monkeypatch.setattr(decontaminate, "PLACES", places)
    rng = random.Random(17)
    items = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(3, 24))] for _ in range(30)]
    texts = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 160))] for _ in range(40)]
    for text in texts:
        copy = [w if rng.random() < 0.8 else rng.choice(["x", f"w{rng.randrange(30)}"]) for w in rng.choice(items)]
        at = rng.randrange(len(text) + 1)
        text[at:at] = [x for w in copy for x in rng.choice([[w], [w], [w, "y"]])]
    words = [np.array(decontaminate._hashes(pa.array([" ".join(i)]))[1]) for i in items]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([" ".join(t) for t in texts])], ["id", "text"])
    for threshold in (0.5, 0.7):
        shared = types.SimpleNamespace(value=decontaminate.index(list(range(len(items))), words, 3, threshold))
        got = {}
        for out in decontaminate._aligned([batch], shared, 3, threshold):
            for r in out.to_pylist():
                got[r["id"], r["item"]] = max(r["score"], got.get((r["id"], r["item"]), 0))
        scores = {(d, i): best_alignment(items[i], t) for d, t in enumerate(texts) for i in range(len(items))}
        want = {pair: score for pair, score in scores.items() if score >= threshold}
        assert len(want) >= 5 and got == pytest.approx(want)


def test_align_table():
    rng = np.random.default_rng(3)
    items = [rng.integers(0, 6, n).astype(np.uint64) for n in (1, 4, 9, 30)]
    texts = [rng.integers(0, 6, n).astype(np.uint64) for n in (12, 1, 40, 25)]
    score, _ = decontaminate.align(items, texts)
    assert [s / (2 * len(i)) for s, i in zip(score, items)] == [best_alignment(list(i), list(t)) for i, t in zip(items, texts)]


def coded(texts):
    known = Tokenizer.from_file(str(public_tokenizers.path(queries.VOCABULARY)))
    known.no_truncation()
    known.no_padding()
    out = {}
    for i, text in texts.items():
        ids = known.encode(text or "", add_special_tokens=False).ids
        digests = [" ".join(map(str, ids)), known.decode(ids, skip_special_tokens=False)]
        out[i] = (len(ids), *[hashlib.sha256(x.encode()).hexdigest() for x in digests])
    return out


def test_bpe(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    got = queries.QUERIES["op9_bpe"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == coded(texts)


def test_bpe_classes_of_all_code_points():
    """Every code point beside letters, marks and blanks is composed, lower-cased and cut as by the library."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.tokenizer(path)
    split = library.pre_tokenizer[0]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 128):
        text = " ".join(f"a{chr(c)}a!{chr(c)}! \u0301{chr(c)}1" for c in points[k : k + 128])
        words = [w for w, _ in split.pre_tokenize_str(library.normalizer.normalize_str(text))]
        assert [w for part in own.stretches(text) for w in own.cut(part)] == words, hex(points[k])


def test_bpe_on_random_strings():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), bpe.tokenizer(path), random.Random(5)
    points = [*range(0x3100), *range(0x3100, 0xD800, 7), *range(0xE000, 0x110000, 61)]
    for _ in range(3000):
        text = "".join(chr(rng.choice(points)) for _ in range(12))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_shards(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, SMALL, "documents").collect()}
    got = queries.QUERIES["op10_resharding"](spark, SMALL).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}
    assert len(got) == len(texts) and {r.shard for r in got} <= set(range(queries.NEW_SHARDS))
    sizes = []
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        rows = list(rows)
        assert [r.slot for r in rows] == list(range(len(rows)))
        sizes.append(sum(r["size"] for r in rows))
    assert len(sizes) == queries.NEW_SHARDS
    assert max(sizes) - min(sizes) <= 2 * max(len(t) + 8 for t in texts.values())


def test_flow_moves_least():
    """No split moves fewer bytes than a shard's excess over its new capacity."""
    rng = random.Random(2)
    for _ in range(40):
        old = {o: rng.randrange(50) for o in range(rng.randrange(1, 7))}
        cuts = sorted(rng.randrange(sum(old.values()) + 1) for _ in range(rng.randrange(0, 6)))
        room = [b - a for a, b in zip([0, *cuts], [*cuts, sum(old.values())])]
        flow = resharding.transfers(old, room)
        assert all(sum(f for (o, _), f in flow.items() if o == x) == n for x, n in old.items())
        assert all(sum(f for (_, t), f in flow.items() if t == x) == n for x, n in enumerate(room))
        moved = sum(f for (o, t), f in flow.items() if o != t)
        assert moved == sum(max(0, n - (room[o] if o < len(room) else 0)) for o, n in old.items())


@pytest.mark.parametrize("name, label", [("op4_toxicity", "toxic"), ("op6_quality", "quality")])
def test_classifier_on_held_out_labels(spark, name, label):
    labels = {r.doc_id: r[label] for r in table(spark, MIDDLE, "labels").collect()}
    got = queries.QUERIES[name](spark, MIDDLE).collect()
    assert len(got) == table(spark, MIDDLE, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    yes, no = [s for s, y in held if y], [s for s, y in held if not y]
    wins = sum((a > b) + (a == b) / 2 for a in yes for b in no)
    assert wins / (len(yes) * len(no)) >= 0.9


def test_chat_on_held_out_conversations(spark):
    """Roles as labelled, for turns that stay a single block."""
    turns = table(spark, MIDDLE, "conversations")
    held = turns.where(in_fifths(F.col("conv_id")))
    out = chat_format.format_chat(held.drop("role"), chat_format.train(turns.where(~in_fifths(F.col("conv_id"))))).collect()
    blocks = {}
    for r in out:
        blocks.setdefault((r.conv_id, r.turn), []).append(r.role)
    known = {(r.conv_id, r.turn): r.role for r in held.collect()}
    assert set(blocks) == set(known)
    single = [roles[0] == known[k] for k, roles in blocks.items() if len(roles) == 1]
    assert sum(single) >= 0.9 * len(single) > 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(11)
    for length in (1, 2, 6):
        steps = rng.normal(size=(length, len(chat_format.ROLES) + 1, len(chat_format.ROLES)))
        size = steps.shape[2]
        paths = itertools.product(range(size), repeat=length)

        def value(path):
            return sum(steps[k, a, b] for k, (a, b) in enumerate(zip((0, *path), path)))

        assert value(tuple(chat_format.viterbi(steps, 0, None))) == pytest.approx(max(map(value, paths)))


def test_stages_one_by_one(spark):
    """Each stage over what the one before kept; rows that a stage must not touch stay."""
    docs = table(spark, SMALL, "documents")
    labels = {r.doc_id: r.toxic for r in table(spark, SMALL, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, SMALL), f"test-{name}")
        rows = docs.collect()
        after = {r.doc_id: None if name == "bpe" else r.text for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "toxicity":
            assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(before)
            assert all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            key = lambda line: line.strip(BLANKS).translate(LOWER)
            owners = {}
            for i, text in before.items():
                for line in (text or "").split("\n"):
                    owners.setdefault(key(line), set()).add(i)
            many = {k for k, ids in owners.items() if k and len(ids) >= corpus_pipeline.LINE_DOCS}
            assert after == {
                i: "\n".join(x for x in (t or "").split("\n") if key(x) not in many) for i, t in before.items()
            }
        elif name == "minhash_dedup":
            root = components(before, linked_texts(before)[1])
            assert set(after) == {i for i in before if root[i] == i}
        elif name == "bpe":
            want = coded(before)
            assert {r.doc_id: r.n_tokens for r in rows} == {i: want[i][0] for i in before}
