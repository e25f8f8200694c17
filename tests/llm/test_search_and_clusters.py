"""Centroid clusters, spelling variants and exact search: brute force, ties, nulls, copies and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocrspark.llm import centroid_clusters, pivot_search, queries, spelling
from ocrspark.llm.common import table

MIDDLE = "/root/testdata/sf0.01"
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


# -- centroid clusters

def test_transform_keeps_distances():
    h = centroid_clusters.transform(64)
    assert (h @ h.T == 64 * np.eye(64)).all()
    changes = (h[:, 1:] != h[:, :-1]).sum(axis=1)
    assert (changes == np.arange(64)).all()
    with pytest.raises(ValueError):
        centroid_clusters.transform(48)


@pytest.mark.parametrize("size", [3, 900, 1 << 23, 1 << 30])
def test_nearest_is_exact(size):
    rng = np.random.default_rng(size)
    x = rng.integers(-size, size, (200, 16))
    centres = np.concatenate([x[:5], x[:2], rng.integers(-size, size, (3, 16))])  # equal centroids: the first wins
    x[50:60] = x[0]
    h = centroid_clusters.transform(16)
    chosen, distance, compared = centroid_clusters.nearest(x @ h.T, centres @ h.T)
    for row, c, d in zip(x.tolist(), chosen, distance):
        all_d = [sum((a - b) ** 2 for a, b in zip(row, centre)) for centre in centres.tolist()]
        assert d == min(all_d) and c == all_d.index(min(all_d))
    assert compared <= x.size * len(centres)


def test_search_drops_centroids_early():
    rng = np.random.default_rng(1)
    level = rng.integers(-1000, 1000, (8, 1)) * 8
    centres = level + rng.integers(-5, 5, (8, 64))
    x = centres[rng.integers(0, 8, 500)] + rng.integers(-5, 5, (500, 64))
    h = centroid_clusters.transform(64)
    compared = centroid_clusters.nearest(x @ h.T, centres @ h.T)[2]
    assert compared < x.size * 8 / 2


def clustered(rows, k, rounds):
    """Centroids and ``(id, cluster, distance)`` by plain loops."""
    centres = [list(v) for _, v in sorted(rows, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        out = []
        for i, v in rows:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        placed = assign()
        for c in range(len(centres)):
            own = [v for (_, v), (_, at, _) in zip(rows, placed) if at == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own)]
    return centres, sorted(assign(), key=repr)


def test_clusters_of_odd_rows(spark):
    rng = random.Random(3)
    good = [(i, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(40)]
    good += [good[0], good[0], (7, [0.5, 0.5, 0.5, 0.5]), (None, [1.0, 0.0, 0.0, 0.25]), (None, [1.0, 0.0, 0.0, 0.25])]
    good += [(k, [9.0, 9.0, 9.0, -9.0]) for k in range(100, 130)]  # a hot group of copies
    odd = [(50, None), (51, []), (52, [1.0, 2.0]), (53, [1.0, None, 1.0, 1.0]), (54, [math.nan, 0.0, 0.0, 0.0]), (55, [math.inf] * 4), (56, [1.0] * 5)]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumns(
        {"cluster": F.lit("old"), "id": F.lit(1), "x": F.lit(2)}
    )
    got = centroid_clusters.cluster(df, k=5, rounds=4, dim=4)
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in good]
    centres, want = clustered(whole, 5, 4)
    assert got.centroids == centres
    assert sorted((tuple(r) for r in got.assigned.select("vec_id", "cluster", "distance").collect()), key=repr) == want
    sums = centroid_clusters.inertia(got).select("cluster", "cluster_inertia", "inertia").distinct().collect()
    assert {r.inertia for r in sums} == {sum(w[2] for w in want)} == {sum(r.cluster_inertia for r in sums)}
    few = centroid_clusters.cluster(df.where("vec_id in (1, 2)"), k=5, rounds=2, dim=4)
    assert len(few.centroids) == 2 and few.assigned.count() == 2
    none = centroid_clusters.cluster(df.limit(0), k=5, rounds=2, dim=4)
    assert none.centroids == [] and centroid_clusters.inertia(none).count() == 0


def test_large_components(spark):
    df = spark.createDataFrame([(1, [3e4, 0.0]), (2, [-3e4, 1.0]), (3, [3e4, 0.5])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.distance for r in centroid_clusters.cluster(df, k=1, rounds=0, dim=2).assigned.collect()}
    assert sorted(got.values())[0] == 0 and max(got.values()) > 2**51
    with pytest.raises(Exception, match="cannot be computed"):
        centroid_clusters.cluster(df.selectExpr("vec_id", "array(1e18D, 0D) as embedding"), k=1, rounds=0, dim=2)


# -- spelling variants

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def test_composition_gives_each_pair_once():
    rng = random.Random(5)
    for _ in range(60):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 80))})
        a = spelling.Acceptor(words)
        assert a.words[a.start] == len(words)
        got = [tuple(sorted(p)) for p in spelling.accepted_pairs(a)]
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i, j in itertools.combinations(range(len(words)), 2) if one_edit(words[i], words[j])}


def test_acceptor_is_minimal():
    words = sorted(x + "ation" for x in "abcdefgh")
    assert len(spelling.Acceptor(words).arcs) == 7


def variants(docs, least_length=5, least_count=3, one_in=97, times=2):
    """Rows of the operator by counting and by deletion neighbourhoods."""
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    owners = {}
    for w in words:
        for k in range(len(w)):
            owners.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (left, right), own in owners.items():
        own = own | ({left + right} & words.keys())
        for a, b in itertools.combinations(own, 2):
            assert one_edit(a, b)
            near[a].add(b)
            near[b].add(a)
    form = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: v if v is not None and words[v] >= times * words[w] else None for w, v in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items())


def test_variants_of_whole_documents(spark):
    docs = table(spark, MIDDLE, "documents")
    want = variants([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = queries.QUERIES["op12_spelling"](spark, MIDDLE).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len({r[5] for r in want}) < len(want)


def test_variants_of_odd_texts(spark):
    long_words = [f"prefix{'abcdefgh'[i]}{'abcdefgh'[j]}{'mnopqrst'[k]}end" for i in range(8) for j in range(8) for k in range(8)]
    chain = ["steady"] * 40 + ["stead"] * 18 + ["steed"] * 8 + ["steel"] * 3
    texts = [
        (1, " ".join(chain)), (2, None), (3, ""), (4, "1234 -- ×÷ ab"), (None, "Étage étage ÉTAGE etage " * 3), (None, "naïve Naïve NAÏVE"),
        (5, " ".join(long_words * 3)), (6, "aaaaaa aaaaa aaaaaaa " * 4), (6, "aaaaaa aaaaa aaaaaaa " * 4), (7, "z" * 40_000 + " "),
        (7, "z" * 40_000), (7, "z" * 40_000), (8, "z" * 39_999 + " ") , (8, "z" * 39_999), (8, "z" * 39_999), (9, "tie" * 2 + " " + "tia" * 2),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(1), "path": F.lit("p")})
    for most in (4096, 3):  # small partitions are cut again and again
        got = spelling.variants(df, most=most).select("word", "n", "n_near", "form", "form_n", "root").collect()
        assert sorted(tuple(r) for r in got) == variants(texts)
    roots = {r.word: r.root for r in got}
    assert roots["steel"] == roots["steed"] == "steady"
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.variants(df.where("doc_id in (2, 3, 4)")).count() == 0


def test_checksum_rule(spark):
    runs = [f"w{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame([(3, w) for w in runs], "doc string, run string")
    got = {r.run: r.word for r in df.select("run", spelling.worn(F.col("run"), F.col("doc"), 7).alias("word")).collect()}
    for w in runs:
        h = zlib.crc32(f"3:{w}".encode())
        assert got[w] == (w[: h % 3] + w[h % 3 + 1 :] if h % 7 == 0 else w)
    assert any(len(w) == 2 for w in got.values())


# -- exact search

def searched(rows, k):
    """Best others of every query row by all products."""
    out = []
    for a, (q, v, asks) in enumerate(rows):
        if asks:
            others = [
                (-sum(x * y for x, y in zip(v, w)), i is None, i or 0, i) for b, (i, w, _) in enumerate(rows) if b != a and len(w) == len(v)
            ]
            out += [(q, r, o[3], -o[0]) for r, o in enumerate(sorted(others)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [None, 64])
def test_search_of_odd_rows(spark, monkeypatch, block):
    if block:  # blocks of few vectors and queries
        monkeypatch.setattr(pivot_search, "BLOCK_BYTES", block)
        monkeypatch.setattr(pivot_search, "QUERY_BYTES", block)
    rng = random.Random(9)
    good = [(i, [rng.gauss(0, 1 + i % 3) for _ in range(3)]) for i in range(120)]
    good += [(k, [0.5, 0.5, 0.5]) for k in range(200, 260)]  # a hot group of copies
    good += [(10, good[10][1]), (10, [3.0, 3.0, 3.0]), (20, [0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (None, [4.0, 4.0, 4.0])]
    good += [(30, []), (40, []), (41, []), (50, [1.0, 1.0]), (51, [1.0]), (60, [2.0])]
    odd = [(70, None), (80, [None, 1.0, 1.0]), (90, [math.nan, 1.0, 1.0]), (100, [math.inf, 0.0, 0.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumns({"d": F.lit("clash"), "ids": F.lit(1), "query": F.lit("q")})
    whole = [(i, [math.floor(1024 * x) for x in v], i is not None and i % 10 == 0) for i, v in good]
    got = pivot_search.top_products(df, F.col("vec_id") % 10 == 0, k=4, pivots=5, rings=3, sample_rows=50)
    assert sorted((tuple(r) for r in got.select("query_id", "rank", "id", "score").collect()), key=repr) == searched(whole, 4)
    assert pivot_search.top_products(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert pivot_search.top_products(df, F.lit(None).cast("boolean")).count() == 0
    alone = pivot_search.top_products(df.where("vec_id = 50"), F.col("vec_id") % 10 == 0)
    assert alone.count() == 0


def test_triangle_inequality_leaves_rings_out():
    """Rings far from a query are not asked for once its k-th score is known."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-20, 20, (100, 8)) + c for c in rng.integers(-3000, 3000, (6, 8))])
    index = pivot_search.fit(x, int(pivot_search.norms(x).max()), 6, 2)
    d = pivot_search._distances(x, index, True)
    pivot = d.argmin(axis=1)
    ring = (d[np.arange(len(x)), pivot][:, None] > index.edges[pivot]).sum(axis=1)
    cells = sorted(set(zip(pivot.tolist(), ring.tolist())))
    own = [d[(pivot == p) & (ring == r), p] for p, r in cells]
    index.cells, index.least, index.greatest = np.array(cells), np.array([o.min() for o in own]), np.array([o.max() for o in own])
    scores = pivot_search.products(x[:10], x)
    kth = np.sort(scores, axis=1)[:, -5]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(10)), pa.array([8] * 10, pa.int32()), pivot_search.whole_vectors.lists(x[:10]), pa.array(kth)], ["node", "dim", "vec", "kth"]
    )
    shared = type("B", (), {"value": {8: index}})
    asked = 0
    for out in pivot_search._wanted([batch], shared, 0, None):
        for node, rings in zip(out.column("node").to_pylist(), out.column("cells").to_pylist()):
            wanted = {(c["pivot"], c["ring"]) for c in rings}
            best = np.flatnonzero(scores[node] >= kth[node])
            assert {(int(pivot[b]), int(ring[b])) for b in best} <= wanted
            asked += len(wanted)
    assert asked < 10 * len(cells)
