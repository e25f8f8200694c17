"""Roles of transcript turns by a hidden Markov model, and turns rendered in one form.

The states are the roles, the observations are features of lines: a speaker marker, length, a
question mark, and whether the line opens a turn. Viterbi decoding is a product of matrices over
(max, +), so a conversation need not be one task: matrices of consecutive turns are multiplied in
blocks, blocks again, until one block per conversation is left, and the best path is then laid
down the same levels.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ocrspark.llm.common import session, stored

ROLES = ("system", "user", "assistant")
#: Words that mark a speaker at the start of a line, followed by a colon.
MARKERS = {
    "system": ("system", "instruction", "instructions"),
    "user": ("user", "human", "question", "q", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model"),
}
#: Upper bounds of the length classes of a line, in characters.
LENGTHS = (20, 60, 150, 400)
#: Turns multiplied in one step.
SPAN = 256
#: Count added to every transition and observation.
PRIOR = 0.5
#: Probability that a line without marker stays with the role of the line before.
STAY = 0.999
N_OBS = (len(ROLES) + 1) * 2 * (len(LENGTHS) + 1) * 2
START = len(ROLES)


def marker_pattern(role: str) -> str:
    return rf"^(?i)\s*[\[*#<|]*\s*(?:{'|'.join(MARKERS[role])})\s*[\]*>|]*\s*:"


def observation(line: Column, opens: Column) -> Column:
    """Code of a line's features."""
    marker = F.lit(0)
    for k, role in enumerate(ROLES):
        marker = F.when(line.rlike(marker_pattern(role)), k + 1).otherwise(marker)
    length = F.lit(0)
    for bound in LENGTHS:
        length = length + (F.char_length(line) > bound).cast("int")
    asks = F.rtrim(line).endswith("?").cast("int")
    return ((marker * 2 + opens.cast("int")) * (len(LENGTHS) + 1) + length) * 2 + asks


def _marked(line: Column) -> Column:
    return line.rlike("|".join(marker_pattern(r) for r in ROLES))


def lines_of(df: DataFrame, conv: str, order: str, text: str) -> DataFrame:
    """Distinct turns ``(conv, turn, h, codes)`` with a feature code per line."""
    cut = df.select(
        F.col(conv).cast("long").alias("conv"), F.col(order).cast("long").alias("turn"), F.xxhash64(text).alias("h"),
        F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"),
    )
    codes = F.transform("lines", lambda x, k: observation(x, k == 0).cast("int"))
    return cut.select("conv", "turn", "h", codes.alias("codes")).dropDuplicates(["conv", "turn", "h"])


def train(df: DataFrame, conv: str = "conv_id", order: str = "turn", text: str = "text", role: str = "role") -> dict:
    """Log probabilities counted over all labelled turns; the counts are a table of fixed size.

    Rows whose role is null or unknown are left out. A transition is counted between turns
    whose numbers follow one another in a conversation; a turn 0 starts one.
    """
    known = df.where(F.col(role).isin(*ROLES)).select(
        F.col(conv).cast("long").alias("conv"), F.col(order).cast("long").alias("turn"), F.col(role).alias("role"),
        F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"),
    )
    seen = known.select(
        "role", F.explode(F.transform("lines", lambda x, k: observation(x, k == 0).cast("int"))).alias("code")
    ).groupBy("role", "code").count()
    turns = known.select("conv", "turn", "role")
    steps = turns.alias("x").join(
        turns.select("conv", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before")), ["conv", "turn"]
    ).groupBy("before", "role").count()
    starts = turns.where("turn = 0").groupBy("role").count()
    emit = np.full((len(ROLES), N_OBS), PRIOR)
    move = np.full((len(ROLES) + 1, len(ROLES)), PRIOR)
    for r in seen.collect():
        emit[ROLES.index(r["role"]), r["code"]] += r["count"]
    for r in steps.collect():
        move[ROLES.index(r["before"]), ROLES.index(r["role"])] += r["count"]
    for r in starts.collect():
        move[START, ROLES.index(r["role"])] += r["count"]
    return {"emit": np.log(emit / emit.sum(axis=1, keepdims=True)), "move": np.log(move / move.sum(axis=1, keepdims=True))}


def steps_of(codes: list[int], model: dict) -> np.ndarray:
    """Matrix of each line: score of a role here after a role (or the start) before."""
    stay = np.full((len(ROLES) + 1, len(ROLES)), np.log((1 - STAY) / (len(ROLES) - 1)))
    np.fill_diagonal(stay, np.log(STAY))
    stay[START] = model["move"][START]
    codes = np.asarray(codes)
    marker = codes // (2 * (len(LENGTHS) + 1) * 2)
    opens = (codes // ((len(LENGTHS) + 1) * 2)) % 2 == 1
    turn = (opens | (marker > 0))[:, None, None]
    # a speaker's name decides far more than the counts of a corpus in which it hardly occurs
    named = np.where((marker[:, None] > 0) & (marker[:, None] - 1 != np.arange(len(ROLES))), -30.0, 0.0)
    return np.where(turn, model["move"], stay) + (model["emit"][:, codes].T + named)[:, None, :]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best score over the role between two stretches, for every role before and after."""
    return (a[:, :, None] + b[None, : len(ROLES), :]).max(axis=1)


def viterbi(steps: np.ndarray, before: int, last: int | None) -> list[int]:
    """Best roles at the end of each step, given the role before and, if known, the last one."""
    score, back = steps[0][before], []
    for m in steps[1:]:
        ways = score[:, None] + m[: len(ROLES)]
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    path = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _matrix(rows) -> pa.Array:
    return pa.array([np.asarray(m, np.float64).tobytes() for m in rows], pa.binary())


def _matrices(column) -> np.ndarray:
    return np.stack([np.frombuffer(m, np.float64).reshape(len(ROLES) + 1, len(ROLES)) for m in column])


def _turns(batches, model):
    """The matrix of each turn."""
    for batch in batches:
        out = []
        for codes in batch.column("codes").to_pylist():
            steps = steps_of(codes, model.value)
            m = steps[0]
            for s in steps[1:]:
                m = product(m, s)
            out.append(m)
        cols = [batch.column(c) for c in ("conv", "turn", "h", "pos", "codes")]
        yield pa.RecordBatch.from_arrays([*cols, _matrix(out)], ["conv", "turn", "h", "pos", "codes", "m"])


def _spans(batches):
    """Rows of whole ``(conv, span)`` blocks of batches sorted by them."""
    rest = []
    for batch in batches:
        rows = rest + batch.to_pylist()
        cut = len(rows)
        while cut and (rows[cut - 1]["conv"], rows[cut - 1]["span"]) == (rows[-1]["conv"], rows[-1]["span"]):
            cut -= 1
        start = 0
        for k in range(1, cut + 1):
            if k == cut or (rows[k]["conv"], rows[k]["span"]) != (rows[start]["conv"], rows[start]["span"]):
                if k > start:
                    yield rows[start:k]
                start = k
        rest = rows[cut:]
    if rest:
        yield rest


def _up(batches):
    out = ([], [], [])
    for rows in _spans(batches):
        steps = _matrices([r["m"] for r in rows])
        m = steps[0]
        for s in steps[1:]:
            m = product(m, s)
        for col, v in zip(out, (rows[0]["conv"], rows[0]["span"], m)):
            col.append(v)
        if len(out[0]) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), _matrix(out[2])], ["conv", "pos", "m"])
            out = ([], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), _matrix(out[2])], ["conv", "pos", "m"])


def _down(batches):
    out = []
    for rows in _spans(batches):
        first = rows[0]
        ends = viterbi(_matrices([r["m"] for r in rows]), first["before"], first["last"])
        for r, before, last in zip(rows, [first["before"], *ends], ends):
            out.append((r["conv"], r["pos"], before, last))
        if len(out) >= 1000:
            yield _bounds(out)
            out = []
    yield _bounds(out)


def _bounds(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv", "pos", "before", "last"])


def _roles(batches, model):
    """The role of every line of a turn."""
    for batch in batches:
        paths = [
            viterbi(steps_of(codes, model.value), before, last)
            for codes, before, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "before", "last")))
        ]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv", "turn", "h", "pos")), pa.array(paths, pa.list_(pa.int32()))],
            ["conv", "turn", "h", "pos", "path"],
        )


def decode(df: DataFrame, model: dict, conv: str = "conv_id", order: str = "turn", text: str = "text", span: int = SPAN) -> DataFrame:
    """``(conv, turn, h, pos, path)``: the role of every line of the distinct turns of ``df``."""
    spark = session(df.sparkSession)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(model)
    ordered = lines_of(df, conv, order, text).orderBy("conv", "turn", "h")
    # numbered in the sorted order: ids rise over the partitions of a sort
    numbered = stored(ordered.withColumn("pos", F.monotonically_increasing_id()), "ordered")
    turns = stored(
        numbered.mapInArrow(
            partial(_turns, model=shared), "conv long, turn long, h long, pos long, codes array<int>, m binary"
        ), "turn-matrices",
    )
    levels = [turns.select("conv", "pos", "m")]

    def by_span(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "conv", "span").sortWithinPartitions("conv", "span", "pos")

    many = True
    while many:
        spans = levels[-1].withColumn("span", F.floor(F.col("pos") / span))
        up = stored(by_span(spans).mapInArrow(_up, "conv long, pos long, m binary"), "span-matrices")
        levels.append(up)
        ends = up.groupBy("conv").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
        many = not ends.where("a <> b").isEmpty()
    bounds = levels.pop().select(
        "conv", "pos", F.lit(START).alias("before"), F.lit(None).cast("int").alias("last")
    )
    for rows in reversed(levels):
        above = bounds.withColumnsRenamed({"conv": "c", "pos": "p"})
        spans = rows.withColumn("span", F.floor(F.col("pos") / span))
        met = spans.join(above, spans["conv"].eqNullSafe(above["c"]) & (spans["span"] == above["p"])).drop("c", "p")
        bounds = stored(by_span(met).mapInArrow(_down, "conv long, pos long, before int, last int"), "span-bounds")
    return turns.join(bounds.select("pos", "before", "last"), "pos").mapInArrow(
        partial(_roles, model=shared), "conv long, turn long, h long, pos long, path array<int>"
    )


def format_chat(
    df: DataFrame, model: dict, conv: str = "conv_id", order: str = "turn", text: str = "text", span: int = SPAN
) -> DataFrame:
    """``(conv, turn, block, role, rendered)``: one row per turn, a text with markers giving several.

    A turn starts at each row of ``df`` and at each line with a speaker marker; the marker is taken
    off. It is rendered as ``<|role|>``, the text and ``<|end|>`` on lines of their own.

    - Any role column is ignored; roles come from the lines alone. A null or empty text is one
      empty line and a turn.
    - Null conversation ids are one conversation, a null turn number comes first, turns with
      one number follow the hash of their text. Equal rows count once in the model and all get
      the same roles.
    - A conversation of any length is decoded in bounded blocks. An empty table gives an empty
      result; other columns are ignored.
    """
    paths = stored(decode(df, model, conv, order, text, span), "paths")
    texts = df.select(
        F.col(conv).cast("long").alias("c"), F.col(order).cast("long").alias("t"), F.xxhash64(text).alias("g"),
        F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"),
    )
    met = texts.join(
        paths, texts["c"].eqNullSafe(paths["conv"]) & texts["t"].eqNullSafe(paths["turn"]) & (texts["g"] == paths["h"])
    )
    opens = F.transform("lines", lambda x, k: (k == 0) | _marked(x))
    starts = F.filter(F.transform(opens, lambda x, k: F.when(x, k)), lambda x: x.isNotNull())
    cut = met.select(
        "c", "t", "lines", "path", F.posexplode(starts).alias("block", "start"), starts.alias("starts")
    )
    size = F.coalesce(F.get("starts", F.col("block") + 1), F.size("lines")) - F.col("start")
    own = F.slice("lines", F.col("start") + 1, size)
    any_marker = "|".join(marker_pattern(r) for r in ROLES)
    body = F.trim(F.regexp_replace(F.array_join(own, "\n"), any_marker, ""))
    names = F.array(*map(F.lit, ROLES))
    role = F.get(names, F.get("path", F.col("start")))
    return cut.select(
        F.col("c").alias(conv), F.col("t").alias(order), F.col("block").cast("long").alias("block"), role.alias("role"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("\n<|end|>")).alias("rendered"),
    )
