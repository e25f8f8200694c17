"""Benchmark passages in training texts: every place that can reach the threshold, then local alignment of words.

Two equal words that follow each other in an alignment are neighbours, or words one place apart, in item
and text, or at least two words are skipped or replaced between them. The first kind adds 2 or 1 to the
score, the second nothing. So an alignment that reaches the threshold holds a known number of equal pairs
of words, and they lie on near offsets. Each text is looked up in an index of the pairs of the items, and
the places that hold enough of them are aligned by Smith-Waterman: no pair of text and item is missed,
however common its words are and however it was edited, and a frequent pair makes no rows.

The index goes to the tasks in parts of bounded size, one pass over the texts each; a test set of a million
words is one part. Texts are not shuffled and need no id.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ocrspark.llm import shingles
from ocrspark.llm.common import U64, session, slices, stored, text_prints, word_codes

#: Items of fewer words are looked for as a whole.
SEED_WORDS = 3
#: Words of the items in one part of the index, so that a part takes some 40 MB.
PART_WORDS = 1 << 20
#: Bits of the filter of pairs for each pair in the index.
FILTER_RATIO = 16
#: Alignment scores of an equal word, a different word and a skipped word.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells aligned at once, and places looked up at once.
CELLS, PLACES = 1 << 18, 1 << 20


def _hashes(text: pa.Array) -> tuple[list[int], np.ndarray]:
    """Offsets and hashes of the words of every text, without case and outer punctuation."""
    ends, codes, words = word_codes(text)
    bare = pa.array([w.strip(string.punctuation) or w for w in words.to_pylist()], pa.string())
    return ends.tolist(), shingles.word_hashes(bare)[codes] if len(codes) else np.zeros(0, U64)


def _pairs(words: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of the pairs of words that lie ``apart`` places from each other."""
    return words[:-apart] * shingles.STEP + words[apart:]


def _items(batches):
    for batch in batches:
        ends, hashes = _hashes(batch.column("text"))
        words = [hashes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(words, pa.binary())], ["item", "words"])


@dataclass
class Index:
    """Items and the places of their pairs of words, ordered by the hash of the pair."""

    ids: np.ndarray
    words: list[np.ndarray]
    size: np.ndarray
    #: Offsets that an alignment of the item can spread over, and what its pairs have to add up to.
    spread: np.ndarray
    need: np.ndarray
    grams: np.ndarray
    #: Where the places of each pair start; item, word and whether the two words are neighbours.
    starts: np.ndarray
    item: np.ndarray
    at: np.ndarray
    close: np.ndarray
    bits: np.ndarray


def index(ids: list[int], words: list[np.ndarray], n: int, threshold: float) -> Index:
    """The index of items with at least one word each.

    An alignment of m equal words that costs c scores 2m - c, which must reach t = 2 * threshold * size.
    The m - 1 pairs of words that follow each other add 2, 1 or at most 0, so those that add
    something come to t - 2 at least; and c is 2m - t at most, by which its offsets differ.
    """
    size = np.array([len(w) for w in words], np.int64)
    target = MATCH * threshold * size
    parts = []
    for k, w in enumerate(words):
        if len(w) < n:
            whole = shingles.windows(w, n)
            parts.append((whole, np.full(1, k), np.zeros(1, np.int64), np.ones(1, bool)))
            continue
        for apart in (1, 2):
            pairs = _pairs(w, apart)
            parts.append((pairs, np.full(len(pairs), k), np.arange(len(pairs)), np.full(len(pairs), apart == 1)))
    gram, item, at, close = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(gram, kind="stable")
    gram, starts = np.unique(gram[order], return_index=True)
    bits = 1 << max(16, int(FILTER_RATIO * len(gram)).bit_length())
    bitmap = np.zeros(bits // 8, np.uint8)
    spot = gram & U64(bits - 1)
    np.bitwise_or.at(bitmap, (spot >> U64(3)).astype(np.int64), np.uint8(1) << (spot & U64(7)).astype(np.uint8))
    return Index(
        np.array(ids, np.int64), words, size, np.maximum(1, np.floor(MATCH * size - target + 1e-9)).astype(np.int64),
        np.where(size < n, 1, np.maximum(1, np.ceil(target - MATCH - 1e-9))).astype(np.int64),
        gram, np.r_[starts, len(item)], item[order].astype(np.int32), at[order].astype(np.int32), close[order], bitmap,
    )


def _known(x: Index, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs that the index has, and their numbers there."""
    spot = gram & U64(8 * len(x.bits) - 1)
    hit = np.flatnonzero(x.bits[(spot >> U64(3)).astype(np.int64)] >> (spot & U64(7)).astype(np.uint8) & 1)
    number = np.minimum(np.searchsorted(x.grams, gram[hit]), len(x.grams) - 1)
    real = x.grams[number] == gram[hit]
    return hit[real], number[real]


def _found(x: Index, ends: np.ndarray, hashes: np.ndarray, n: int):
    """Words, numbers in the index and closeness of all its pairs in the texts, in the order of words."""
    doc_end = np.repeat(ends[1:], np.diff(ends))
    out = []
    for apart in (1, 2):
        hit, number = _known(x, _pairs(hashes, apart))
        inside = hit + apart < doc_end[hit]
        out.append((hit[inside], number[inside], np.full(int(inside.sum()), apart == 1)))
    for width in np.unique(x.size[x.size < n]).tolist():
        if len(hashes) >= width:
            hit, number = _known(x, shingles.windows(hashes, width))
            inside = hit + width <= doc_end[hit]
            out.append((hit[inside], number[inside], np.ones(int(inside.sum()), bool)))
    hit, number, close = (np.concatenate(c) for c in zip(*out))
    order = np.argsort(hit, kind="stable")
    return hit[order], number[order], close[order]


def _windows(x: Index, ends: np.ndarray, hashes: np.ndarray, n: int):
    """``(text, item, first, last)``: stretches of offsets whose pairs can add up to an alignment.

    Offsets are cut into stretches as wide as an alignment can spread, so it lies in two that
    follow each other, named by the first. Pairs are looked up in overlapping spans of words.
    """
    hit, number, close = _found(x, ends, hashes, n)
    many = np.r_[0, np.cumsum(x.starts[number + 1] - x.starts[number])]
    overlap, base = int((x.size + x.spread).max()) + 2, int(x.size.max())
    start = 0
    while start < len(hit):
        stop = int(np.searchsorted(many, many[start] + PLACES, "right")) - 1
        stop = max(stop, int(np.searchsorted(hit, hit[start] + 2 * overlap)))
        here = slice(start, stop)
        count = x.starts[number[here] + 1] - x.starts[number[here]]
        row = np.repeat(np.arange(start, stop), count)
        entry = np.arange(len(row)) + np.repeat(x.starts[number[here]] - (np.cumsum(count) - count), count)
        # what is left of an item of which a text has too little anywhere is most of all rows
        doc = np.searchsorted(ends, hit[row], "right") - 1
        item = x.item[entry].astype(np.int64)
        weight = np.where(close[row] & x.close[entry], 2, 1)
        first = int(doc[0]) if len(doc) else 0
        pair = (doc - first) * len(x.ids) + item
        if len(pair) and int(pair.max()) < 8 * len(pair) + (1 << 20):
            total = np.bincount(pair, weight)[pair]
        else:
            _, back = np.unique(pair, return_inverse=True)
            total = np.bincount(back, weight)[back]
        left = total >= x.need[item]
        row, entry, doc, item, weight, pair = (c[left] for c in (row, entry, doc, item, weight, pair))
        if len(row):
            at = x.at[entry].astype(np.int64)
            stretch = (hit[row] - ends[doc] - at) // x.spread[item] + base + 1
            wide = int(stretch.max()) + 2
            key, back = np.unique(pair * wide + stretch, return_inverse=True)
            # a word of the item counts once in a stretch, with its best pair
            best = np.unique((back * base + at) * 2 + weight - 1)
            best = best[np.r_[best[1:] >> 1 != best[:-1] >> 1, True]]
            total = np.bincount(best // (2 * base), (best & 1) + 1, len(key))
            able = np.unique(np.r_[key, key - 1])
            sums = np.zeros(len(able))
            sums[np.searchsorted(able, key)] += total
            sums[np.searchsorted(able, key - 1)] += total
            able = able[sums >= x.need[able // wide % len(x.ids)]]
            last = None
            for pair, stretch in zip((able // wide).tolist(), (able % wide - base - 1).tolist()):
                if last and last[0] == pair and last[1] == last[2] == stretch - 1:
                    last = (pair, last[1], stretch)
                    continue
                if last:
                    yield first + last[0] // len(x.ids), last[0] % len(x.ids), last[1], last[2]
                last = (pair, stretch, stretch)
            if last:
                yield first + last[0] // len(x.ids), last[0] % len(x.ids), last[1], last[2]
        start = len(hit) if stop >= len(hit) else int(np.searchsorted(hit, hit[stop] - overlap))


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair of word sequences, and the passage word where it ends.

    Rows of the table are filled for all pairs together. Skips within the row are a running
    maximum, as each costs the same.
    """
    wide, high = max(len(p) for p in passages), max(len(i) for i in items)
    text = np.zeros((len(items), wide), U64)
    for k, p in enumerate(passages):
        text[k, : len(p)] = p
    real = np.arange(wide)[None, :] < np.array([len(p) for p in passages])[:, None]
    ramp = -GAP * np.arange(wide + 1)
    above = np.zeros((len(items), wide + 1), np.int64)
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for r in range(high):
        live = np.array([len(i) > r for i in items])
        word = np.array([i[r] if len(i) > r else 0 for i in items], U64)
        gain = np.where((text == word[:, None]) & real & live[:, None], MATCH, MISMATCH)
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(above[:, :-1] + gain, above[:, 1:] + GAP)
        row = np.maximum(row, 0)
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp
        top = row[:, 1:].max(axis=1)
        better = live & (top > best)
        end[better] = row[better, 1:].argmax(axis=1)
        best[better] = top[better]
        above = np.where(live[:, None], row, above)
    return best, end


def _aligned(batches, shared, n: int, threshold: float):
    """Scores of all places of the texts that reach the threshold."""
    x = shared.value
    for whole in batches:
        for batch in slices(whole, "text"):
            ends, hashes = _hashes(batch.column("text"))
            ids, ends = batch.column("id").to_pylist(), np.asarray(ends)
            jobs = []
            for doc, item, first, last in _windows(x, ends, hashes, n):
                size, spread = int(x.size[item]), int(x.spread[item])
                start = max(0, first * spread)
                text = hashes[ends[doc] : ends[doc + 1]]
                passage = text[start : (last + 2) * spread + size]
                if len(passage):
                    jobs.append((doc, item, passage, start))
            jobs.sort(key=lambda j: len(j[2]))
            out = []
            while jobs:
                k = max(1, CELLS // len(jobs[-1][2]) // 4)
                part, jobs = jobs[-k:], jobs[:-k]
                score, end = align([x.words[j[1]] for j in part], [j[2] for j in part])
                out += [
                    (ids[j[0]], int(x.ids[j[1]]), s / (MATCH * int(x.size[j[1]])), j[3] + e)
                    for j, s, e in zip(part, score.tolist(), end.tolist())
                ]
            cols = list(zip(*[o for o in out if o[2] >= threshold])) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.column("id").type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()),
                 pa.array(cols[3], pa.int64())],
                ["id", "item", "score", "last_word"],
            )


def contaminated(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", n: int = SEED_WORDS, threshold: float = 0.5,
) -> DataFrame:
    """``(id, item, score, last_word)`` for every text and test item that align.

    ``score`` is the best local alignment of the item's words with the text, divided by that of
    the item with itself: 1 for a full copy. Rows reach ``threshold``; ``last_word`` is the
    text's word (from 0) at which the best alignment ends.

    - Every pair that reaches ``threshold`` is found, whatever its edits. Only an item of fewer than ``n``
      words is looked for as a whole, and one so short that a single equal word would do (at most
      ``1 / threshold`` words) needs a pair of equal words.
    - Null and blank texts and items align with nothing. Words are compared without case of A-Z and
      without punctuation at their ends.
    - Rows that share an id are one document and count with their best score; documents with a
      null id come back as one row per item with a null id.
    - Equal items are each found. Items with one id count with their best score; items with a
      null id are ignored.
    - Texts of any length are handled whole, other columns are ignored, and an empty table on
      either side gives an empty result.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    best = _scores(texts, items, item_col, item_text_col, n, threshold).groupBy("id", "item").agg(
        F.max(F.struct("score", (-F.col("last_word")).alias("back"))).alias("best")
    )
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best.score").alias("score"),
        (-F.col("best.back")).alias("last_word"),
    )


def leaks(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", n: int = SEED_WORDS, threshold: float = 0.5,
) -> DataFrame:
    """``(id, t1, t2)`` of the rows of ``df`` that align with an item, as in :func:`contaminated`.

    A row without an id is told from others by the print of its text (see ``text_prints``).
    """
    key, text = F.col(id_col).cast("long"), F.col(text_col)
    t1, t2 = text_prints(key, text)
    texts = df.select(F.struct(key.alias("id"), t1.alias("t1"), t2.alias("t2")).alias("id"), text.alias("text"))
    return _scores(texts, items, item_col, item_text_col, n, threshold).select("id.id", "id.t1", "id.t2").distinct()


def _scores(
    texts: DataFrame, items: DataFrame, item_col: str, item_text_col: str, n: int, threshold: float
) -> DataFrame:
    """``(id, item, score, last_word)`` of all places of ``(id, text)`` that reach ``threshold``; any type of id."""
    spark = session(texts.sparkSession)
    tests = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    bench = stored(
        tests.where("item is not null").mapInArrow(_items, "item long, words binary").where("octet_length(words) > 0")
        .distinct(), "items",
    )
    total = bench.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = -(-total // (8 * PART_WORDS))
    schema = T.StructType.fromDDL("item long, score double, last_word long")
    schema, passes = T.StructType([T.StructField("id", texts.schema["id"].dataType), *schema.fields]), []
    n = max(n, 2)  # one word has no pair
    for k in range(parts):
        rows = bench.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k).collect()  # one part, see PART_WORDS
        if rows:
            part = index([r.item for r in rows], [np.frombuffer(r.words, U64) for r in rows], n, threshold)
            scan = partial(_aligned, shared=spark.sparkContext.broadcast(part), n=n, threshold=threshold)
            passes.append(texts.mapInArrow(scan, schema))
    return reduce(DataFrame.unionAll, passes) if passes else spark.createDataFrame([], schema)
