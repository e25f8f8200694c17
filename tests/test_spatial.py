"""Overlap join and alignment against brute force, with boxes of every size and stacks of copies."""

import random

import pytest

from ocrspark.operators import evaluate, spatial


def share(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0 or a[2] <= a[0] or a[3] <= a[1]:
        return 0.0
    return float(w) * float(h) / (float(a[2] - a[0]) * float(a[3] - a[1]))


def random_boxes(rng, n, reach):
    """Boxes from one pixel to the whole page, some with negative edges, some empty."""
    out = []
    for i in range(n):
        size = 2 ** rng.randrange(0, reach)
        l, t = rng.randrange(-300, 3000), rng.randrange(-300, 3000)
        w, h = rng.randrange(0, size + 1), rng.randrange(0, max(2, size // rng.choice((1, 4, 50))))
        out.append((1 + i % 2, rng.randrange(2), i, l, t, l + w, t + h))
    return out


def boxes_df(spark, rows, p):
    return spark.createDataFrame(rows, f"doc_id bigint, page_no int, {p}id int, {p}l int, {p}t int, {p}r int, {p}b int")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlap_join_is_exact(spark, seed):
    rng = random.Random(seed)
    a, b = random_boxes(rng, 250, 8), random_boxes(rng, 250, 14)
    b.append((1, 0, 999, -(2**31), -(2**31), 2**31 - 1, 2**31 - 1))
    got = spatial.overlap_join(boxes_df(spark, a, "a_"), boxes_df(spark, b, "b_"), "a_", "b_")
    found = sorted((r.a_id, r.b_id, r.overlap) for r in got.collect())
    want = sorted(
        (x[2], y[2], share(x[3:], y[3:])) for x in a for y in b if x[:2] == y[:2] and share(x[3:], y[3:]) > 0.5
    )
    assert len(want) > 100
    assert found == want


def test_left_anchor_is_exact(spark):
    rng = random.Random(4)
    a, b = random_boxes(rng, 300, 8), random_boxes(rng, 200, 13)
    got = spatial.overlap_join(boxes_df(spark, a, "a_"), boxes_df(spark, b, "b_"), "a_", "b_", anchor="left")
    want = sorted(
        (x[2], y[2])
        for x in a
        for y in b
        if x[:2] == y[:2] and y[3] <= x[3] < y[5] and 2 * y[4] <= x[4] + x[6] < 2 * y[6]
    )
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == want


@pytest.mark.parametrize("limit", [-1, 1 << 20])
def test_anchor_of_each_box(spark, limit):
    """Both ways of finding the pairs, broadcast and shuffled, for boxes of either anchor."""
    rng = random.Random(11)
    a, b = random_boxes(rng, 300, 8), random_boxes(rng, 200, 13)
    right = boxes_df(spark, b, "b_").selectExpr("*", "if(b_id % 2 = 0, 'centre', 'left') as anchor")
    got = spatial.anchored_join(boxes_df(spark, a, "a_"), right, "a_", "b_", "anchor", limit=limit)
    want = sorted(
        (x[2], y[2])
        for x in a
        for y in b
        if x[:2] == y[:2]
        and (
            share(x[3:], y[3:]) > 0.5
            if y[2] % 2 == 0
            else y[3] <= x[3] < y[5] and y[4] < y[6] and 2 * y[4] <= x[4] + x[6] < 2 * y[6]
        )
    )
    assert len(want) > 100
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == want
    assert spatial.anchored_join(boxes_df(spark, a, "a_"), right.limit(0), "a_", "b_", "anchor", limit=limit).count() == 0
    with pytest.raises(Exception, match="unknown anchor"):
        spatial.anchored_join(right.select("doc_id", "page_no", "b_id"), right.selectExpr("* except (anchor)", "'top' as anchor"), "a_", "b_", "anchor")


WORDS = "doc_id bigint, page_no int, line_no int, word_no int, word_id string, text string, conf int, l int, t int, r int, b int"


def words_df(spark, boxes, text="x"):
    rows = [(d, p, i // 10, i % 10, f"w{i}", f"{text}{i % 7}", i % 101, l, t, r, b)
            for d, p, i, l, t, r, b in boxes]
    return spark.createDataFrame(rows, WORDS)


def brute_align(gt, ocr):
    pairs = [(share(o[3:], g[3:]), g, o) for o in ocr for g in gt if g[:2] == o[:2]]
    pairs = [p for p in pairs if p[0] > 0.5]
    best_g = {}
    best_o = {}
    for ov, g, o in pairs:
        if g[2] not in best_g or (-ov, o[2]) < best_g[g[2]][0]:
            best_g[g[2]] = ((-ov, o[2]), o[2])
        if o[2] not in best_o or (-ov, g[2]) < best_o[o[2]][0]:
            best_o[o[2]] = ((-ov, g[2]), g[2])
    return sorted((g, o) for g, (_, o) in best_g.items() if best_o[o][1] == g)


def pair_ids(pairs):
    return sorted((int(r.g_word_id[1:]), int(r.o_word_id[1:])) for r in pairs.collect())


@pytest.mark.parametrize("seed", [5, 6])
def test_align_is_mutual_best(spark, seed):
    rng = random.Random(seed)
    gt = random_boxes(rng, 200, 10)
    ocr = [(d, p, i, l + rng.randrange(-3, 4), t, r, b) for d, p, i, l, t, r, b in gt] + [
        (d, p, i + 1000, l, t, r, b) for d, p, i, l, t, r, b in rng.sample(gt, 80)
    ]
    got = evaluate.align(words_df(spark, gt), words_df(spark, ocr))
    assert pair_ids(got) == brute_align(gt, ocr)


def test_stack_of_copies_stays_small(spark):
    """20,000 words in one box on either side would give 400 million candidate pairs."""
    n = 20000
    box = spark.range(n).selectExpr(
        "1L as doc_id", "0 as page_no", "cast(id as int) as line_no", "0 as word_no",
        "concat('w', id) as word_id", "'x' as text", "90 as conf", "0 as l", "0 as t", "50 as r", "16 as b",
    )
    stats = evaluate.eval_versions(box, box).collect()
    assert [(r.total, r.correct, r.missed, r.extra) for r in stats] == [(n, 1, n - 1, n - 1)]


def test_status_and_counts_agree(spark):
    rng = random.Random(7)
    gt = random_boxes(rng, 200, 9)
    ocr = [(d, p, i, l + 1, t, r, b) for d, p, i, l, t, r, b in gt if i % 5]
    ocr += [(d, p, 1000 + i, *box) for d, p, i, *box in random_boxes(rng, 30, 9)]
    g, o = words_df(spark, gt), words_df(spark, ocr, "X")
    by_status = evaluate.eval_page(evaluate.word_status(g, o))
    by_count = evaluate.eval_versions(g, o)
    assert sorted(map(tuple, by_status.collect())) == sorted(map(tuple, by_count.collect()))
    for r in by_count.collect():
        assert r.total == r.correct + r.incorrect + r.missed


def test_self_alignment_has_no_errors(spark):
    # Words side by side, as on a page; each is its own best partner.
    gt = [(1, 0, i, 60 * (i % 10), 20 * (i // 10), 60 * (i % 10) + 50, 20 * (i // 10) + 16) for i in range(100)]
    words = words_df(spark, gt)
    stats = evaluate.wer(evaluate.eval_versions(words, words)).collect()
    assert [(r.total, r.wer, r.wer_display) for r in stats] == [(100, 0.0, 0.0)]
    assert evaluate.conflicts(words, words).count() == 0


def test_wer_without_words_is_null(spark):
    words = words_df(spark, [(1, 0, 0, 0, 0, 50, 16)])
    stats = evaluate.wer(evaluate.eval_versions(words.filter("false"), words)).collect()
    assert [(r.total, r.extra, r.wer) for r in stats] == [(0, 1, None)]
