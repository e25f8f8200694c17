"""Tables on shared storage, Arrow batches of bounded size, words and hashes of whole texts."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ocrspark.session import stored, tune  # noqa: F401  (operators take it from here)

#: White space of the word contracts: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Rows in an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 1000

U64 = np.uint64


#: Name of the archive in which Spark ships this package to its Python workers.
ARCHIVE = "ocrspark-package.zip"


def session(spark: SparkSession) -> SparkSession:
    """The session with bounded Arrow batches, and the package known to its Python workers."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # here keys that are part of others can be hot
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    sc = spark.sparkContext
    if not any(f.endswith(ARCHIVE) for f in sc.listFiles):
        package = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="package-")) / ARCHIVE
        with zipfile.ZipFile(path, "w") as z:
            for f in package.rglob("*.py"):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(path))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition in which null equals null."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def text_prints(key: Column, text: Column) -> tuple[Column, Column]:
    """128-bit print of the text of a row without an id, which tells it from others; null where there is an id."""
    return tuple(F.when(key.isNull(), h) for h in (F.xxhash64(text), F.xxhash64(F.lit(1), text)))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def quoted(name: str) -> str:
    """``name`` as a reference to the column of that name, dots and blanks included."""
    return "`" + name.replace("`", "``") + "`"


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with more columns."""
    more = [T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in columns.items()]
    return T.StructType([*df.schema.fields, *more])


def in_fifths(key: Column) -> Column:
    """Whether a row is held out: crc32 of its id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part take at most ``limit`` bytes or are one text."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def word_codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text, A-Z lower-cased.

    Returns the offsets of each text's words, a code per word and the words that the
    codes name. Null and blank texts have no words.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    words = parts.flatten().dictionary_encode()
    ends = parts.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)
    keep = real[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    return before[ends], codes[keep], words.dictionary


def binary_rows(values: np.ndarray) -> pa.Array:
    """One binary per row of a two-dimensional array."""
    values = np.ascontiguousarray(values)
    width = values.shape[1] * values.itemsize if values.ndim == 2 else 0
    offsets = np.arange(len(values) + 1, dtype=np.int64) * width
    if offsets[-1] < 2**31:
        return pa.Array.from_buffers(
            pa.binary(), len(values), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.tobytes())]
        )
    raise ValueError("a batch must stay below 2 GB")


def rows_of(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Inverse of :func:`binary_rows` for rows of ``width`` values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]].view(dtype).reshape(len(column), width)
