"""Lines that repeat across documents, found by two Bloom filters and confirmed exactly.

The first filter holds lines seen once, the second lines seen again. Both are built bit by bit:
a bit set by a second line moves on to the second filter, so a line that occurs twice always has
all its bits there, whichever tasks met it. Only lines that the second filter suspects are
shuffled; their SHA-256 digests are counted exactly. A line that is wrongly suspected costs a
shuffled row and changes no result.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ocrspark.llm.common import BLANKS, binary_rows, quoted, session, slices, stored, unused, widened

#: Bits a part of the filters covers; parts travel as sorted 16-bit offsets.
PART_BITS = 1 << 15
#: Filter bits per line, and the least and most bits of a filter (1 to 32 MB on the driver and in a task).
BITS_PER_LINE, LEAST_BITS, MOST_BITS = 16, 1 << 23, 1 << 28
DIGEST = 32
NONE = bytes(DIGEST)


def line_key(line: bytes) -> bytes:
    """Blanks stripped at both ends, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def _digests(batches, min_chars: int):
    """One digest per line of a text, all zero for a line too short to be dropped."""
    for whole in batches:
        for batch in slices(whole, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                keys = [line_key(x) for x in (text or "").encode().split(b"\n")]
                out.append(b"".join([
                    hashlib.sha256(k).digest()
                    if len(k) >= min_chars and (min_chars < 2 or len(k.decode()) >= min_chars) and k else NONE
                    for k in keys
                ]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array(out, pa.binary())], ["id", "h", "digests"]
            )


def _lines(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, np.uint8).reshape(-1, DIGEST)


def _places(lines: np.ndarray, bits: int) -> np.ndarray:
    """Four filter positions per digest."""
    return (np.ascontiguousarray(lines).view(np.uint64) % np.uint64(bits)).astype(np.int64)


def _marks(batches, bits: int):
    """For each part of the filter the positions met once and more than once in a batch."""
    for batch in batches:
        seen = []
        for digests in batch.column("digests").to_pylist():
            lines = _lines(b"".join({digests[k : k + DIGEST] for k in range(0, len(digests), DIGEST)} - {NONE}))
            seen.append(_places(lines, bits).ravel())
        at, n = np.unique(np.concatenate(seen or [np.zeros(0, np.int64)]), return_counts=True)
        part = at // PART_BITS
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(at) else np.zeros(0, int)
        rows = [(int(part[s]), at[s:e] % PART_BITS, n[s:e]) for s, e in zip(cuts, np.r_[cuts[1:], len(at)])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1][r[2] == 1].astype(np.uint16).tobytes() for r in rows], pa.binary()),
                pa.array([r[1][r[2] > 1].astype(np.uint16).tobytes() for r in rows], pa.binary()),
            ],
            ["part", "once", "again"],
        )


def _merged(batches):
    """The second filter of each part that came to this task."""
    once, again = {}, {}
    for batch in batches:
        for part, o, a in zip(*(batch.column(k).to_pylist() for k in range(3))):
            first = once.setdefault(part, np.zeros(PART_BITS, bool))
            second = again.setdefault(part, np.zeros(PART_BITS, bool))
            o, a = np.frombuffer(o, np.uint16), np.frombuffer(a, np.uint16)
            second[o[first[o]]] = True
            first[o] = True
            first[a] = second[a] = True
    parts = sorted(p for p in again if again[p].any())
    if parts:
        bits = np.packbits(np.stack([again[p] for p in parts]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), binary_rows(bits)], ["part", "bits"])


def _suspects(batches, seen_again):
    """Distinct lines of each document that the second filter knows, with their numbers."""
    bitmap = seen_again.value
    bits = len(bitmap) * 8
    for batch in batches:
        rows = ([], [], [], [])
        for row, h, digests in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "digests"))):
            lines = _lines(digests)
            at = _places(lines, bits)
            hit = (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1) & lines.any(axis=1)
            numbers = {}
            for k in np.flatnonzero(hit).tolist():
                numbers.setdefault(digests[k * DIGEST : (k + 1) * DIGEST], []).append(k)
            for digest, ks in numbers.items():
                for col, v in zip(rows, (row, h, digest, ks)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()),
                pa.array(rows[3], pa.list_(pa.int32())),
            ],
            ["id", "h", "digest", "numbers"],
        )


def _cut(batches, at: int, fields):
    """Texts without the lines whose numbers the last column lists."""
    for whole in batches:
        for batch in slices(whole, whole.schema.names[at]):
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                lines, drop = (text or "").split("\n"), set(drop or ())
                texts.append("\n".join([x for k, x in enumerate(lines) if k not in drop]) if drop else text or "")
                n_lines.append(len(lines))
                n_dropped.append(len(drop))
            cols = [batch.column(k) for k in range(batch.num_columns - 1)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], fields
            )


def seen_twice(digests: DataFrame, bits: int):
    """Bitmap of the lines that occur at least twice, of ``bits`` bits, a broadcast of fixed size."""
    spark = digests.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = digests.select("digests").mapInArrow(partial(_marks, bits=bits), "part int, once binary, again binary")
    parts = stored(marks.repartition(tasks, "part").mapInArrow(_merged, "part int, bits binary"), "seen-again")
    out = np.zeros(bits // 8, np.uint8)
    width = PART_BITS // 8
    for row in parts.toLocalIterator():
        out[row.part * width : (row.part + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(out)


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 1,
    keep: str = "first",
) -> DataFrame:
    """``df`` with repeated lines dropped from the text, and columns ``n_lines`` and ``n_dropped``.

    Lines are cut at \\n and compared by :func:`line_key`; keys of at least ``min_chars`` code
    points found in at least ``min_docs`` documents are repeated. ``keep="first"`` leaves the
    occurrence with the least id and line number, ``keep="none"`` drops all.

    - A null or empty text is one empty line, which is never dropped; the text comes back empty.
    - Rows that share an id count as one document, null ids too, and each such row loses its
      lines. Equal rows are treated alike: all of them hold the first occurrence or none.
    - A line that repeats within one document only is not repeated.
    - Input columns named ``n_lines`` or ``n_dropped`` are replaced, all others pass through.
      An empty table gives an empty result.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep must be 'first' or 'none'")
    spark = session(df.sparkSession)
    df = df.drop("n_lines", "n_dropped")
    text = F.col(quoted(text_col))
    df = df.withColumn(text_col, text.cast("string"))
    ids, print_ = F.col(quoted(id_col)).cast("long"), F.xxhash64(text)
    digests = stored(
        df.select(ids.alias("id"), print_.alias("h"), text.alias("text"))
        .mapInArrow(partial(_digests, min_chars=min_chars), "id long, h long, digests binary"), "line-digests",
    )
    n = digests.agg(F.sum(F.expr(f"octet_length(digests) div {DIGEST}"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(1, int(n * BITS_PER_LINE - 1).bit_length())))
    seen_again = seen_twice(digests, bits)
    suspects = stored(
        digests.mapInArrow(
            partial(_suspects, seen_again=seen_again), "id long, h long, digest binary, numbers array<int>"
        ), "suspects",
    )
    first = F.struct(F.col("id").isNull().alias("last"), "id", F.col("numbers")[0].alias("line"), "h")
    by_doc = suspects.groupBy("digest", "id").agg(F.min(first).alias("first"))
    repeated = stored(
        by_doc.groupBy("digest").agg(F.count("*").alias("docs"), F.min("first").alias("first"))
        .where(F.col("docs") >= min_docs).select("digest", "first"), "repeated",
    )
    found = suspects.join(repeated, "digest")
    if keep == "first":
        here = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
        found = found.withColumn("numbers", F.when(here, F.expr("slice(numbers, 2, size(numbers))")).otherwise(F.col("numbers")))
    # equal rows name the same lines, and the set keeps them once
    own_id, own_h, their_id, their_h, drop = unused(df, "_id", "_h", "_their_id", "_their_h", "_drop")
    drops = stored(
        found.select("id", "h", "numbers").groupBy("id", "h").agg(F.flatten(F.collect_set("numbers")).alias("numbers")), "drops",
    ).toDF(their_id, their_h, drop)
    left = df.withColumns({own_id: ids, own_h: print_})
    joined = left.join(
        drops, F.col(own_id).eqNullSafe(F.col(their_id)) & (F.col(own_h) == F.col(their_h)), "left"
    ).select(*[quoted(c) for c in df.columns], drop)
    out = widened(df, n_lines="bigint", n_dropped="bigint")
    return joined.mapInArrow(partial(_cut, at=df.columns.index(text_col), fields=out.names), out)
