"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, and so do the pairs of features that explain
most of what the single features leave. The tables are learned by cyclic boosting: round after
round each feature in turn gets a shallow tree on the current residuals, added at a small rate,
so correlated features share their effect. A score adds one table entry per feature and pair.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ocrspark.llm import labelled
from ocrspark.llm.common import session, slices, widened, word_codes

#: Bound of the labelled rows sampled for training.
SAMPLE_ROWS = 20000
BINS, PAIR_BINS, ROUNDS, RATE, LEAVES, PAIRS = 48, 8, 250, 0.08, 4, 6
#: Weight that holds a leaf with few rows near zero, and least weight of a leaf.
SHRINK, LEAST = 2.0, 1.0

#: Byte classes counted in a text.
CLASSES = {
    "upper": np.r_[65:91], "lower": np.r_[97:123], "digit": np.r_[48:58], "end": np.frombuffer(b".,;:?!", np.uint8),
    "bang": np.frombuffer(b"!", np.uint8), "symbol": np.frombuffer(b"#$%&*+/<=>@\\^_|~{}[]", np.uint8),
    "quote": np.frombuffer(b"\"'`()-", np.uint8), "wide": np.r_[128:256], "line": np.r_[10:11], "blank": np.r_[9:14, 32:33],
}
FEATURES = (
    "words", "word_length", "distinct_words", "top_word", "repeated_words", "distinct_pairs", "line_words",
    "distinct_lines", "longest_word", *CLASSES,
)


def features(text: pa.Array) -> np.ndarray:
    """A row of numbers for every whole text; zeros for a null, empty or blank one."""
    n = len(text)
    out = np.zeros((n, len(FEATURES)))
    text = pc.fill_null(text, "")
    ends, codes, words = word_codes(text)
    sizes = np.diff(ends)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    long = lengths[codes] if len(codes) else np.zeros(0, np.int64)
    again = np.r_[False, codes[1:] == codes[:-1]] if len(codes) else np.zeros(0, bool)
    for k, line in enumerate(text.to_pylist()):
        if not sizes[k]:
            continue
        a, b = int(ends[k]), int(ends[k + 1])
        own = codes[a:b]
        counts = np.unique(own, return_counts=True)[1]
        pairs = len(np.unique(own[:-1] * len(words) + own[1:])) / (b - a - 1) if b - a > 1 else 1.0
        lines = [x for x in line.split("\n") if x]
        out[k, :9] = (
            np.log1p(b - a), long[a:b].mean(), len(counts) / (b - a), counts.max() / (b - a), again[a + 1 : b].mean() if b - a > 1 else 0,
            pairs, np.log1p((b - a) / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), np.log1p(long[a:b].max()),
        )
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    bytes_ = np.maximum(1, np.diff(offsets))
    for k, (name, members) in enumerate(CLASSES.items(), 9):
        table = np.zeros(256, bool)
        table[members] = True
        total = np.r_[0, np.cumsum(table[data], dtype=np.int64)]
        out[:, k] = (total[offsets[1:]] - total[offsets[:-1]]) / bytes_
    out[sizes == 0] = 0
    return out


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]
    base: float


def _cells(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]) if len(edges) else np.zeros((0, len(x)), int)


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def _gain(g, h):
    return g * g / (h + SHRINK)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Value of every bin in the best tree of a few leaves over ordered bins."""
    parts = [(0, len(g))]
    sum_g, sum_h = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            cut = np.arange(a + 1, b)
            if not len(cut):
                continue
            gl, hl = sum_g[cut] - sum_g[a], sum_h[cut] - sum_h[a]
            gr, hr = sum_g[b] - sum_g[cut], sum_h[b] - sum_h[cut]
            gain = _gain(gl, hl) + _gain(gr, hr) - _gain(gl + gr, hl + hr)
            gain[(hl < LEAST) | (hr < LEAST)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (a, b), int(cut[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (sum_g[b] - sum_g[a]) / (sum_h[b] - sum_h[a] + SHRINK)
    return out


def cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Value of every cell, and the gain, of the best tree that cuts a grid once in each direction."""
    cg, ch = (np.pad(np.cumsum(np.cumsum(m, 0), 1), ((1, 0), (1, 0))) for m in (g, h))

    def quarters(c):
        a = c[1:-1, 1:-1]
        top, left, all_ = c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return np.stack([a, top - a, left - a, all_ - top - left + a])

    qg, qh = quarters(cg), quarters(ch)
    if not qg.size:
        return np.zeros_like(g), 0.0
    gain = _gain(qg, qh).sum(axis=0) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = qg[:, i, j] / (qh[:, i, j] + SHRINK)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Model of labelled feature rows; with one class or no rows it scores the prior."""
    n = len(y)
    rate = (y.sum() + 1) / (n + 2)
    if n < 2 or y.min() == y.max():
        return Model([], [], [], [], [], float(np.log(rate / (1 - rate))))
    edges, coarse = _edges(x, BINS), _edges(x, PAIR_BINS)
    cells, blocks = _cells(x, edges), _cells(x, coarse)
    tables = [np.zeros(len(e) + 1) for e in edges]
    base = float(np.log(rate / (1 - rate)))
    value = np.full(n, base)

    def residual():
        p = 1 / (1 + np.exp(-value))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k, cell in enumerate(cells):
            g, h = residual()
            size = len(tables[k])
            step = RATE * shallow_tree(np.bincount(cell, g, size), np.bincount(cell, h, size))
            tables[k] += step
            value += step[cell]
    shape = [len(e) + 1 for e in coarse]

    def grid(i, j, v):
        return np.bincount(blocks[i] * shape[j] + blocks[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = residual()
    found = [
        (cross_tree(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(len(shape)) for j in range(i + 1, len(shape))
    ]
    pairs = [(i, j) for gain, i, j in sorted(found, reverse=True)[:PAIRS] if gain > 0]
    pair_tables = [np.zeros((shape[i], shape[j])) for i, j in pairs]
    for _ in range(rounds // 2):
        for k, (i, j) in enumerate(pairs):
            g, h = residual()
            step = RATE * cross_tree(grid(i, j, g), grid(i, j, h))[0]
            pair_tables[k] += step
            value += step[blocks[i], blocks[j]]
    return Model(edges, tables, pairs, coarse, pair_tables, base)


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    value = np.full(len(x), model.base)
    for cell, t in zip(_cells(x, model.edges), model.tables):
        value += t[cell]
    blocks = _cells(x, model.pair_edges)
    for (i, j), t in zip(model.pairs, model.pair_tables):
        value += t[blocks[i], blocks[j]]
    return 1 / (1 + np.exp(-np.clip(value, -500, 500)))


def _measured(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            x = features(batch.column("text"))
            rows = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())
            )
            yield pa.RecordBatch.from_arrays([batch.column("id"), rows, batch.column("label")], ["id", "x", "label"])


def train(
    df: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Model from at most ``rows`` labelled documents (see :func:`labelled.sample`)."""
    session(df.sparkSession)
    chosen = labelled.sample(df, labels, label, rows, id_col, text_col)
    got = chosen.mapInArrow(_measured, "id long, x array<double>, label int").toArrow().sort_by("id")
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, got["label"].to_numpy().astype(float))


def _scored(batches, at: int, fields, model):
    for whole in batches:
        for batch in slices(whole, whole.schema.names[at]):
            score = scores(model.value, features(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], fields)


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with a score from 0 to 1 for every whole text.

    Null, empty and blank texts have zeros for features and are scored by them. Rows are scored
    one by one, so repeated rows, null ids and ties need no rule. A column of the name of the score is
    replaced, others pass through; an empty table gives an empty result.
    """
    spark = session(df.sparkSession)
    df = df.drop(score_col).withColumn(text_col, F.col(text_col).cast("string"))
    out = widened(df, **{score_col: "double"})
    shared = spark.sparkContext.broadcast(model)
    return df.mapInArrow(partial(_scored, at=df.columns.index(text_col), fields=out.names, model=shared), out)
