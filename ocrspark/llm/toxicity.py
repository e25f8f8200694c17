"""Convolutional text classifier for toxicity.

A word and its beginnings are hashed into an embedding table and their vectors added up, so that
words of one stem share what is learned. Filters of several widths run over whole texts, each
keeps its maximum, and a logistic layer scores the maxima. Training is plain numpy with
Adagrad; only the window that holds a maximum gets a gradient. All labelled texts take part: they
are cut into units that a task can hold, each takes some passes from the same state, and the mean of
their changes is the next state. Scoring is a
map over the texts: a filter is linear, so words are projected once per slice and added up.
Thresholds for decisions are calibrated by language on rows that training has not seen; the
language is no input of the score.
"""

from __future__ import annotations

import copy
import pickle
import string
import zlib
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ocrspark.llm import labelled
from ocrspark.llm.common import session, slices, stored, widened, word_codes

#: Buckets of the embedding table, its width, filter widths and filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 12
#: Lengths of the beginnings hashed besides the word; with it they are packed into 64 bits.
STEMS = (3, 4, 5)
#: Share of the labelled rows that is kept for calibration, passes over the rest.
CALIBRATION, EPOCHS = 0.2, 12
#: Bounds of a unit in rows and words; a longer text is a unit of its own.
UNIT_ROWS, UNIT_WORDS = 8000, 1 << 22
#: With several units: passes between two meetings, and meetings.
PASSES, MEETINGS = 2, 3
#: Buckets whose changes are merged together, and steps of the scores that several units are calibrated by.
BLOCK, STEPS = 1 << 10, 1 << 12
BATCH, RATE, DECAY = 32, 0.08, 1e-5
#: Bound in words of the texts of a training step; a longer text is a step of its own.
BATCH_WORDS = 1 << 17
#: Least rows of each class for a language to get a threshold of its own.
LEAST_ROWS = 20
#: Words handled at once.
CHUNK = 1 << 15
#: Padding words after each text, so that every word starts a window of each width.
PAD = max(WIDTHS)


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    prior: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5


@dataclass
class State:
    """A model in training, with the sums of squared gradients that Adagrad divides by."""

    model: Model
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    prior: float = 1e-3

    def dense(self) -> np.ndarray:
        """All but the embedding as one vector."""
        m = self.model
        parts = [*m.filters, m.bias, m.out, *self.filters, self.bias, self.out, np.array([m.prior, self.prior])]
        return np.concatenate([p.ravel() for p in parts]).astype(np.float64)

    def move(self, change: np.ndarray) -> None:
        """Add a change of :meth:`dense`."""
        m, at = self.model, 0
        for part in (*m.filters, m.bias, m.out, *self.filters, self.bias, self.out):
            part += change[at : at + part.size].reshape(part.shape).astype(part.dtype)
            at += part.size
        m.prior += float(change[at])
        self.prior += float(change[at + 1])


def word_buckets(words: pa.Array) -> np.ndarray:
    """Packed buckets of every word, without punctuation at its ends, and of its beginnings.

    Bucket 0 is that of the padding and of beginnings that are the whole word.
    """
    out = np.zeros((len(words), 1 + len(STEMS)), np.uint16)
    for k, word in enumerate(words.to_pylist()):
        bare = word.strip(string.punctuation) or word
        out[k, 0] = zlib.crc32(bare.encode()) % (BUCKETS - 1) + 1
        for j, size in enumerate(STEMS, 1):
            if len(bare) > size:
                out[k, j] = zlib.crc32(bare[:size].encode(), size) % (BUCKETS - 1) + 1
    return out.view(np.int64).ravel()


def unpacked(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words).view(np.uint16).reshape(len(words), 1 + len(STEMS))


def _tokens(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            ends, codes, words = word_codes(batch.column("text"))
            buckets = word_buckets(words)[codes] if len(codes) else np.zeros(0, np.int64)
            words = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(buckets))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), words, batch.column("label"), batch.column("lang")], ["id", "words", "label", "lang"]
            )


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sequence with padding after each text, the starts and the ends of the texts in it."""
    sizes = np.array([len(t) for t in texts]) + PAD
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    flat = np.zeros(int(sizes.sum()), np.int64)
    for s, t in zip(starts, texts):
        flat[s : s + len(t)] = t
    return flat, starts, starts + np.maximum(sizes - PAD, 1)


def _filtered(x: np.ndarray, filters: list[np.ndarray]) -> list[np.ndarray]:
    """Answers of the filters of each width at every word."""
    out = []
    for w in filters:
        y = x @ w[0]
        for j in range(1, len(w)):
            y[:-j] += x[j:] @ w[j]
        out.append(y)
    return out


def _steps(order: np.ndarray, sizes: np.ndarray):
    """Rows of each training step: a bounded number of texts and of words, or one text."""
    start = words = 0
    for k, size in enumerate(sizes[order].tolist()):
        if k > start and (k - start == BATCH or words + size > BATCH_WORDS):
            yield order[start:k]
            start, words = k, 0
        words += size
    yield order[start:]


def _start(rate: float, rng: np.random.Generator) -> State:
    """The state before training, for a share ``rate`` of label 1."""
    f = FILTERS * len(WIDTHS)
    model = Model(
        rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(f, np.float32), np.abs(rng.normal(0, 0.3, f)).astype(np.float32), float(np.log(rate / (1 - rate))),
    )
    model.embedding[0] = 0
    small = lambda v: np.full(np.shape(v), 1e-3, np.float32)
    return State(model, small(model.embedding), [small(w) for w in model.filters], small(model.bias), small(model.out))


def _tops(model: Model, own: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Places and values of the maxima of every text, and the vectors of the words at given places."""
    if len(own) <= 2 * BATCH_WORDS:
        x = model.embedding[own].sum(axis=1)
        answers = _filtered(x, model.filters)
        at = np.stack([
            np.concatenate([y[s:e].argmax(axis=0) + s for y in answers])
            for s, e in zip(starts.tolist(), ends.tolist())
        ])
        top = np.concatenate([np.take_along_axis(y, at[:, i * FILTERS : (i + 1) * FILTERS], 0) for i, y in enumerate(answers)], axis=1)
        return at, top, x.__getitem__
    vectors = lambda places: model.embedding[own[places]].sum(axis=-2)
    f = FILTERS * len(WIDTHS)
    at, top = np.zeros((len(starts), f), np.int64), np.full((len(starts), f), -np.inf, np.float32)
    for k, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
        for s in range(start, end, CHUNK):  # overlapping stretches; of equal maxima the first counts
            answers = np.concatenate(_filtered(vectors(np.arange(s, min(s + CHUNK, end) + PAD - 1)), model.filters), axis=1)
            answers = answers[: min(CHUNK, end - s)]
            places = answers.argmax(axis=0)
            values = answers[places, np.arange(f)]
            better = values > top[k]
            at[k, better], top[k, better] = places[better] + s, values[better]
    return at, top, vectors


def _pass(state: State, texts: list[np.ndarray], buckets: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> None:
    """One pass of training over all texts, in random order."""
    model = state.model
    sizes = np.array([len(t) for t in texts])
    for rows in _steps(rng.permutation(len(texts)), sizes):
        flat, starts, ends = _padded([texts[r] for r in rows])
        own = buckets[flat]
        at, top, vectors = _tops(model, own, starts, ends)
        hidden = np.maximum(top + model.bias, 0)
        score = 1 / (1 + np.exp(-(hidden @ model.out + model.prior)))
        wrong = ((score - labels[rows]) / len(rows)).astype(np.float32)
        g_out = hidden.T @ wrong
        g_hidden = np.outer(wrong, model.out) * (hidden > 0)
        g_bias = g_hidden.sum(axis=0)
        g_rows, g_vals = [], []
        for i, w in enumerate(model.filters):
            part = slice(i * FILTERS, (i + 1) * FILTERS)
            g, places = g_hidden[:, part], at[:, part]
            g_w = np.zeros_like(w)
            for j in range(len(w)):
                g_w[j] = np.einsum("bf,bfd->df", g, vectors(places + j))
                g_x = (g[:, :, None] * w[j].T[None]).reshape(-1, DIM)
                g_rows.append(own[places + j].reshape(-1))
                g_vals.append(np.repeat(g_x, own.shape[1], axis=0))
            g_w += DECAY * w
            state.filters[i] += g_w * g_w
            w -= RATE * g_w / np.sqrt(state.filters[i])
        ids, inverse = np.unique(np.concatenate(g_rows), return_inverse=True)
        g_e = np.zeros((len(ids), DIM), np.float32)
        np.add.at(g_e, inverse, np.concatenate(g_vals))
        g_e += DECAY * model.embedding[ids]
        g_e[ids == 0] = 0
        state.embedding[ids] += g_e * g_e
        model.embedding[ids] -= RATE * g_e / np.sqrt(state.embedding[ids])
        for seen, value, g in ((state.bias, model.bias, g_bias), (state.out, model.out, g_out + DECAY * model.out)):
            seen += g * g
            value -= RATE * g / np.sqrt(seen)
        g = float(wrong.sum())
        state.prior += g * g
        model.prior -= RATE * g / state.prior**0.5


def fit(texts: list[np.ndarray], words: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """A model of texts given as indexes into the packed ``words``, of which the first is the padding.

    With one class or no rows its score is the prior alone.
    """
    rng = np.random.default_rng(seed)
    n = len(texts)
    state = _start((labels.sum() + 1) / (n + 2), rng)
    if n < 2 or labels.min() == labels.max():
        state.model.out[:] = 0
        return state.model
    buckets = unpacked(words)
    for _ in range(epochs):
        _pass(state, texts, buckets, labels, rng)
    return state.model


def scores(model: Model, texts: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """Score of each text, given as indexes into the packed ``words``, of which the first is the padding."""
    used = model.embedding[unpacked(words)].sum(axis=1)
    tables = [[used @ m for m in w] for w in model.filters]
    best = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)

    def pool(rows, parts):
        flat, starts, ends = _padded(parts)
        cuts = np.stack([starts, ends], axis=1).ravel()
        for i, steps in enumerate(tables):
            y = steps[0][flat]
            for j in range(1, len(steps)):
                y[:-j] += steps[j][flat[j:]]
            top = np.maximum.reduceat(y, cuts, axis=0)[::2]
            part = slice(i * FILTERS, (i + 1) * FILTERS)
            best[rows, part] = np.maximum(best[rows, part], top)

    rows, parts, size = [], [], 0
    for k, t in enumerate(texts):
        if len(t) > CHUNK:  # overlapping stretches; the maximum over them is that of the text
            for s in range(0, len(t), CHUNK):
                whole = t[s : s + CHUNK + PAD - 1]
                pool([k], [whole])
            continue
        rows.append(k)
        parts.append(t)
        size += len(t)
        if size > CHUNK:
            pool(rows, parts)
            rows, parts, size = [], [], 0
    if rows:
        pool(rows, parts)
    value = np.maximum(best + model.bias, 0).astype(np.float64) @ model.out.astype(np.float64) + model.prior
    return 1 / (1 + np.exp(-np.clip(value, -500, 500)))


def calibrate(model: Model, score: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> None:
    """Thresholds with the best F1, by language where both classes have enough rows."""

    def best(mask) -> float | None:
        s, y = score[mask], labels[mask]
        if (y == 1).sum() < LEAST_ROWS or (y == 0).sum() < LEAST_ROWS:
            return None
        order = np.argsort(-s, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
        k = int(f1.argmax())
        below = s[order[k + 1]] if k + 1 < len(s) else 0.0
        # the middle of the gap, and never so low or high that a few rows decide
        return float(np.clip((s[order[k]] + below) / 2, 0.2, 0.8))

    model.threshold = best(np.ones(len(labels), bool)) or 0.5
    for lang in {x for x in langs if x is not None}:
        own = best(np.array([x == lang for x in langs], bool))
        if own is not None:
            model.thresholds[lang] = own


def _read(hashed: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Texts as indexes into packed words, these words, labels, and which rows are kept for calibration."""
    words, y = hashed["words"].combine_chunks(), hashed["label"].to_numpy().astype(np.float32)
    ends = words.offsets.to_numpy()
    known, flat = np.unique(words.values.to_numpy(zero_copy_only=False), return_inverse=True)
    known, flat = np.r_[0, known], flat + 1
    texts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return texts, known, y, np.arange(len(texts)) % round(1 / CALIBRATION) == 0


def _trained(batches, epochs: int):
    """The model of all rows, which are a single unit, pickled."""
    rows = [b for b in batches if b.num_rows]
    hashed = pa.Table.from_batches(rows).sort_by("id") if rows else None
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_model(hashed, epochs))], pa.binary())], ["model"])


def _model(hashed: pa.Table | None, epochs: int) -> Model:
    if hashed is None:
        return fit([], np.zeros(1, np.int64), np.zeros(0, np.float32), epochs)
    texts, known, y, late = _read(hashed)
    model = fit([t for t, x in zip(texts, late) if not x], known, y[~late], epochs)
    if late.any():
        kept = [t for t, x in zip(texts, late) if x]
        calibrate(model, scores(model, kept, known), y[late], [v for v, x in zip(hashed["lang"].to_pylist(), late) if x])
    return model


def _units(batches, rows: int, words: int):
    """``(number, rows)`` of each unit: rows of one part in their order, cut where they reach a bound."""
    held, n, size, now, count = [], 0, 0, None, 0
    for batch in batches:
        start = 0
        sizes = pc.list_value_length(batch.column("words")).to_pylist()
        for k, (part, more) in enumerate(zip(batch.column("part").to_pylist(), sizes)):
            if n and (part != now or n == rows or size + more > words):
                held.append(batch.slice(start, k - start))
                yield (now << 32) + count, pa.Table.from_batches(held).sort_by("id")
                held, n, size, start, count = [], 0, 0, k, count + 1 if part == now else 0
            now, n, size = part, n + 1, size + more
        held.append(batch.slice(start))
    if n:
        yield (now << 32) + count, pa.Table.from_batches(held).sort_by("id")


_CHANGES = "block int, unit long, weight long, ids binary, change binary"


def _changes(batches, shared, rows: int, words: int, meeting: int):
    """What some passes over a unit change: rows of the embedding by block, and everything else as block -1."""
    for unit, hashed in _units(batches, rows, words):
        state = copy.deepcopy(shared.value)
        texts, known, y, late = _read(hashed)
        texts, y = [t for t, x in zip(texts, late) if not x], y[~late]
        if not texts:
            continue
        rng, buckets = np.random.default_rng([meeting, unit]), unpacked(known)
        for _ in range(PASSES):
            _pass(state, texts, buckets, y, rng)
        old = shared.value
        ids = np.flatnonzero((state.embedding != old.embedding).any(axis=1))
        moved = np.concatenate([state.model.embedding[ids] - old.model.embedding[ids], state.embedding[ids] - old.embedding[ids]], axis=1)
        out = [(-1, b"", (state.dense() - old.dense()).tobytes())]
        cuts = np.searchsorted(ids, np.arange(0, BUCKETS + 1, BLOCK))
        for block, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if b > a:
                out.append((block, (ids[a:b] - block * BLOCK).astype(np.int32).tobytes(), moved[a:b].tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int32()), pa.array([unit] * len(out), pa.int64()), pa.array([len(texts)] * len(out), pa.int64()),
             pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["block", "unit", "weight", "ids", "change"]
        )


def _merged(batches):
    """The mean change of each block, in which a unit weighs by its rows; a bucket's mean is over the units that changed it.

    Rows come sorted by block and unit, so sums are the same at every run.
    """
    now, total, weight = None, None, None

    def done():
        mean = (total / np.maximum(weight, 1)).astype(np.float64 if now < 0 else np.float32)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["block", "change"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != now:
                if now is not None:
                    yield done()
                now = row["block"]
                total, weight = (0.0, 0) if now < 0 else (np.zeros((BLOCK, 2 * DIM)), np.zeros((BLOCK, 1)))
            if now < 0:
                total, weight = total + row["weight"] * np.frombuffer(row["change"], np.float64), weight + row["weight"]
            else:
                ids = np.frombuffer(row["ids"], np.int32)
                total[ids] += row["weight"] * np.frombuffer(row["change"], np.float32).reshape(-1, 2 * DIM).astype(np.float64)
                weight[ids] += row["weight"]
    if now is not None:
        yield done()


def _late(batches, shared, rows: int, words: int):
    """Language, step of the score and label of the rows kept for calibration."""
    for _, hashed in _units(batches, rows, words):
        texts, known, y, late = _read(hashed)
        score = scores(shared.value, [t for t, x in zip(texts, late) if x], known)
        step = np.minimum((score * STEPS).astype(np.int32), STEPS - 1)
        yield pa.RecordBatch.from_arrays(
            [hashed["lang"].filter(pa.array(late)).combine_chunks(), pa.array(step), pa.array(y[late].astype(np.int32))], ["lang", "step", "label"]
        )


def _in_units(hashed: DataFrame, rows: int, words: int, share: float) -> Model:
    """A model and thresholds of any number of units. The driver holds the state of training only, whatever the rows."""
    sc = hashed.sparkSession.sparkContext
    state = _start(share, np.random.default_rng(5))
    for meeting in range(MEETINGS):
        shared = sc.broadcast(state)
        changes = hashed.mapInArrow(partial(_changes, shared=shared, rows=rows, words=words, meeting=meeting), _CHANGES)
        merged = changes.repartition("block").sortWithinPartitions("block", "unit").mapInArrow(_merged, "block int, change binary").collect()
        state = copy.deepcopy(state)
        for block, change in merged:
            if block < 0:
                state.move(np.frombuffer(change, np.float64))
                continue
            change = np.frombuffer(change, np.float32).reshape(BLOCK, 2 * DIM)
            own = slice(block * BLOCK, (block + 1) * BLOCK)
            state.model.embedding[own] += change[:, :DIM]
            state.embedding[own] += change[:, DIM:]
        shared.unpersist()
    model = state.model
    shared = sc.broadcast(model)
    late = hashed.mapInArrow(partial(_late, shared=shared, rows=rows, words=words), "lang string, step int, label int")
    steps = stored(late.groupBy("lang", "step").agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no")), "steps")
    totals = steps.where("lang is not null").groupBy("lang").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    totals = totals.where((F.col("yes") >= LEAST_ROWS) & (F.col("no") >= LEAST_ROWS)).select("lang")
    everything = steps.groupBy("step").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    model.threshold = _limit(everything) or 0.5
    by_lang: dict[str, list] = {}
    for r in steps.join(totals, "lang").collect():
        by_lang.setdefault(r.lang, []).append(r)
    for lang, own in by_lang.items():
        model.thresholds[lang] = _limit(own)
    return model


def _limit(steps: list) -> float | None:
    """The threshold with the best F1 of counts by step of the score, as :func:`calibrate` takes it of single scores."""
    steps = sorted(steps, key=lambda r: -r.step)
    yes, no = np.array([r.yes for r in steps]), np.array([r.no for r in steps])
    if yes.sum() < LEAST_ROWS or no.sum() < LEAST_ROWS:
        return None
    at = (np.array([r.step for r in steps]) + 0.5) / STEPS
    f1 = 2 * np.cumsum(yes) / (np.cumsum(yes + no) + yes.sum())
    k = int(f1.argmax())
    return float(np.clip((at[k] + (at[k + 1] if k + 1 < len(at) else 0.0)) / 2, 0.2, 0.8))


def train(
    df: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = UNIT_ROWS, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang", epochs: int = EPOCHS, words: int = UNIT_WORDS,
) -> Model:
    """Model and thresholds from all labelled documents, whole texts of any length (see :func:`labelled.every`).

    Up to ``rows`` rows and ``words`` words are a single unit: one task takes ``epochs`` passes and the
    driver gets the model only. More are cut into units of at most that size. These take some passes from the
    same state, several times over, and what they change is averaged in between; thresholds come from counts of all
    rows kept for calibration. Words are written once, as hashed buckets. Runs jobs when it is called.
    """
    session(df.sparkSession)
    # only these columns are taken, so no other name of the input can clash
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    chosen, part = labelled.every(own, known, "label", rows, "id", "text", ("lang",))
    hashed = chosen.select("id", "text", "label", "lang").mapInArrow(_tokens, "id long, words array<long>, label int, lang string")
    # a part keeps its order in one file, so units are the same at every run
    hashed = stored(hashed.withColumn("part", part).sortWithinPartitions("part", F.xxhash64("id"), "id"), "hashed")
    n, size, yes = hashed.agg(F.count("*"), F.sum(F.size("words")), F.sum("label")).first()
    if n > rows or (size or 0) > words:
        if 0 < yes < n:
            return _in_units(hashed, rows, words, (yes + 1) / (n + 2))
        state = _start((yes + 1) / (n + 2), np.random.default_rng(5))
        state.model.out[:] = 0
        return state.model
    fitted = hashed.coalesce(1).mapInArrow(partial(_trained, epochs=epochs), "model binary").collect()
    # a plan that Spark knows to be empty has no task
    return pickle.loads(fitted[0].model) if fitted else _model(None, epochs)


def _scored(batches, at: int, fields, model):
    for whole in batches:
        for batch in slices(whole, whole.schema.names[at]):
            ends, codes, words = word_codes(batch.column(at))
            codes = codes + 1
            texts = [codes[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            score = scores(model.value, texts, np.r_[0, word_buckets(words)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], fields)


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with a score from 0 to 1 for every whole text.

    Null, empty and blank texts get the score of a text of padding. Rows are scored one by one, so
    repeated rows, null ids and tied scores need no rule. A column of the name of the score is
    replaced, others pass through; an empty table gives an empty result.
    """
    spark = session(df.sparkSession)
    df = df.drop(score_col).withColumn(text_col, F.col(text_col).cast("string"))
    out = widened(df, **{score_col: "double"})
    shared = spark.sparkContext.broadcast(model)
    return df.mapInArrow(partial(_scored, at=df.columns.index(text_col), fields=out.names, model=shared), out)


def rejected(model: Model, score_col: str = "score", lang_col: str = "lang"):
    """Condition for a score to reach the threshold of its row's language."""
    limit = F.lit(model.threshold)
    for lang, value in sorted(model.thresholds.items()):
        limit = F.when(F.col(lang_col) == lang, value).otherwise(limit)
    return F.col(score_col) >= limit
