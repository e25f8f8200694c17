"""WARC archives: written as one gzip stream, normalised to a member per record, read by an index.

Many archives arrive as one gzip stream over the whole file, in which no record can be reached
without inflating all before it. The normaliser inflates such a stream once, writes every record as
its own gzip member and a sidecar index of offsets beside the archive, after which any record is
read by a seek.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ocrspark.llm.common import session, stored
from ocrspark.session import scratch_dir

CRLF, RECORD_END = "\r\n", "\r\n\r\n"
#: Payloads below this size are never revisits.
LEAST_PAYLOAD = 100
#: Date written into records, as the pages have none.
DATE = "2000-01-01T00:00:00Z"
#: Compressed bytes read at a time.
READ = 1 << 20
INDEX = "path string, offset long, length long, record_id string"


def _record_id(page, digest):
    hexes = F.md5(F.concat_ws("/", page.cast("string"), digest))
    cut = [F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One column ``value``: the WARC record of each page.

    Of pages with equal payloads of at least ``LEAST_PAYLOAD`` bytes the one with the least id is a
    response and the others revisit it. Null payloads are empty. Rows with one id and payload are
    written as often as they occur and are all responses or all revisits. A null id is never the
    least unless all are null, in which case all are responses. A null url leaves its header out.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    df = pages.select(
        F.col(id_col).cast("long").alias("id"), F.regexp_replace(url_col, r"[\r\n]+", " ").alias("url"),
        payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("bytes"),
    )
    heads = df.where(F.col("bytes") >= LEAST_PAYLOAD).select("id", "digest")
    first = stored(
        heads.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
        .select("digest", "first"), "first-payloads",
    )
    again = stored(
        heads.join(first, "digest").where("not id <=> first").select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "first")
        .distinct(), "revisits",
    )
    met = df.join(again, F.col("id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
    revisit = F.col("first").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit(RECORD_END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))

    def header(name, value):
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    return met.withColumn("block", block).select(
        F.concat(
            F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(CRLF),
            header("WARC-Record-ID", _record_id(F.col("id"), F.col("digest"))),
            header("WARC-Date", F.lit(DATE)), header("WARC-Target-URI", F.col("url")),
            header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
            F.when(revisit, F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                header("WARC-Refers-To", _record_id(F.col("first"), F.col("digest"))),
                header("X-Refers-To-Page", F.col("first").cast("string")),
            )).otherwise(""),
            header("X-Page-Id", F.col("id").cast("string")), header("X-Payload-Length", F.col("bytes").cast("string")),
            F.lit("Content-Type: application/http; msgtype=response\r\n"),
            header("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF), F.col("block"),
        ).alias("value")
    )


def write_monolithic(records_: DataFrame, path: str) -> None:
    """Archives under ``path``, a file per partition, each one gzip stream."""
    records_.write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Hadoop style name."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def inflated(stream) -> Iterator[bytes]:
    """Contents of a gzip stream of one or more members, piece by piece."""
    engine, started = zlib.decompressobj(31), False
    while data := stream.read(READ):
        while data:
            started = True
            yield engine.decompress(data)
            data = engine.unused_data
            if engine.eof:
                engine, started = zlib.decompressobj(31), False
                data = data.lstrip(b"\0")  # padding after a member
    if started:
        raise ValueError("the gzip stream ends within a member")


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records with their ends; only the record at hand is held."""
    held = bytearray()
    end = RECORD_END.encode()
    pieces = iter(pieces)

    def fill(size: int) -> bool:
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        at = held.find(end)
        while at < 0:
            start = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError("a record ends within its headers")
            at = held.find(end, start)
        size = at + 4 + int(headers(bytes(held[:at])).get("content-length", 0)) + len(end)
        if not fill(size) or held[size - 4 : size] != end:
            raise ValueError("a record ends before its content")
        yield bytes(held[:size])
        del held[:size]


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(CRLF)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def normalise_file(source: str, target: str) -> list[tuple[str, int, int, str]]:
    """Write ``target`` with a member per record and ``target.idx``; returns the index.

    Both files are written under passing names and moved when they are whole, so a task that is
    lost or runs twice leaves either nothing or the same files.
    """
    (files, path), (out_files, out) = place(source), place(target)
    out_files.create_dir(out.rpartition("/")[0], recursive=True)
    passing = f"{out}.{uuid.uuid4().hex}"
    index, offset = [], 0
    with files.open_input_stream(path, compression=None) as stream, out_files.open_output_stream(passing, compression=None) as sink:
        for record in split_records(inflated(stream)):
            member = gzip.compress(record, 6, mtime=0)
            sink.write(member)
            head = headers(record[: record.find(RECORD_END.encode())])
            index.append((target, offset, len(member), head.get("warc-record-id", "")))
            offset += len(member)
    with out_files.open_output_stream(f"{passing}.idx") as sink:
        sink.write("".join(f"{o} {n} {r}\n" for _, o, n, r in index).encode())
    out_files.move(f"{passing}.idx", f"{out}.idx")
    out_files.move(passing, out)
    return index


def _normalised(batches, folder: str):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows = normalise_file(path, f"{folder}/{path.rpartition('/')[2].partition('.')[0]}.warc.gz")
            for k in range(0, len(rows), 10_000):
                cols = list(zip(*rows[k : k + 10_000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3])],
                    ["path", "offset", "length", "record_id"],
                )


def normalise(spark, source: str, target: str) -> DataFrame:
    """Normalise every ``*.gz`` archive of a folder; the index of all of them as a stored table.

    A file is one task's work, streamed: memory holds one record, whatever the file's size. Files
    without records give an empty archive. A cut or damaged file stops the job with an error.
    """
    session(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    return stored(files.mapInArrow(partial(_normalised, folder=target), INDEX), "warc-index")


def _read(batches):
    opened = (None, None)
    for batch in batches:
        out = []
        for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
            if opened[0] != path:
                files, name = place(path)
                opened = (path, files.open_input_file(name))
            record = gzip.decompress(opened[1].read_at(length, offset))
            cut = record.find(RECORD_END.encode())
            head = headers(record[:cut])
            payload = record[cut + 4 : -4].partition(RECORD_END.encode())[2]
            page, refers = head.get("x-page-id"), head.get("x-refers-to-page")
            kind = head["warc-type"]
            if kind == "revisit":
                size, digest = int(head["x-payload-length"]), head["warc-payload-digest"].partition(":")[2]
            else:
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            out.append((page and int(page), size, digest, kind, refers and int(refers)))
        cols = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)],
            ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        )


def read_records(index: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every record of an index.

    Size and digest of a response are those of the payload that is read; a revisit has no payload and
    states those of the record it refers to.
    """
    session(index.sparkSession)
    return index.mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, normalise them and read them back by the index."""
    spark = pages.sparkSession
    raw, done = scratch_dir(spark, "warc-stream"), scratch_dir(spark, "warc")
    write_monolithic(records(pages), raw)
    return read_records(normalise(spark, raw, done))
