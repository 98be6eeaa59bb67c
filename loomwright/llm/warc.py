"""WARC archives in Zstandard with a shared dictionary: writer and validating reader.

File format: a skippable frame (magic 0x184D2A5D) that holds the dictionary (itself
plain or one zstandard frame), then one zstandard frame a record. The reader takes the
dictionary from the file, decodes frame by frame in bounded memory, and checks that a
frame holds exactly one record, that the header block is well formed, that lengths
agree, and that block and payload have the digests the header states.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, materialize, shared_dir

#: Fixed values of the formats.
DICT_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")

#: A writer starts its next file after this many bytes; its dictionary comes from its first records.
FILE_BYTES = 64 << 20
DICT_BYTES, DICT_SAMPLE_RECORDS, DICT_SAMPLE_BYTES = 32 << 10, 200, 2 << 20
READ_BYTES = 1 << 20

RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_uri(page: str | None) -> str:
    return "<urn:nopage>" if page is None else f"<urn:page:{quote(page, safe='')}>"


def make_record(record_id: str, uri: str, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit record (no payload, but its digest) if ``refers_to`` is given."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if refers_to else payload)
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
        ("WARC-Block-Digest", "sha1:" + sha1_base32(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to:
        fields += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields (lower-case names) and ``block`` and ``payload`` of one whole record; ValueError if it is not valid."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC header")
    fields: dict = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"malformed header line {line[:60]!r}")
        key = name.decode().lower()
        if key in fields and key != "warc-concurrent-to":
            raise ValueError(f"{key} is repeated")
        fields[key] = value.decode().strip()
    if missing := [k for k in NEEDED if k not in fields]:
        raise ValueError(f"missing {', '.join(missing)}")
    if not fields["content-length"].isdecimal():
        raise ValueError("Content-Length is no number")
    if not re.fullmatch(r"<[^<>\s]+>", fields["warc-record-id"]):
        raise ValueError("WARC-Record-ID is no <uri>")
    if not re.match(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z$", fields["warc-date"]):
        raise ValueError("WARC-Date is no UTC timestamp")
    if fields["warc-type"] not in TYPES:
        raise ValueError(f"unknown WARC-Type {fields['warc-type'][:30]}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, the frame holds {len(rest) - 4}")
    block = rest[:n]
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found or not http.startswith(b"HTTP/"):
            raise ValueError("the block is no HTTP message")
    for key, part in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        stated = fields.get(key, "")
        if stated.startswith("sha1:") and not (key == "warc-payload-digest" and fields["warc-type"] == "revisit") and stated[5:] != sha1_base32(part):
            raise ValueError(f"{key} doesn't match")
    if fields["warc-type"] == "revisit" and not fields.get("warc-refers-to") and not fields.get("warc-payload-digest"):
        raise ValueError("a revisit record that refers to nothing")
    return fields | {"block": block, "payload": payload}


class ArchiveWriter:
    """Writes records to one Arrow output stream; holds back the first ones to make the dictionary."""

    def __init__(self, out, level: int):
        self.out, self.level = out, level
        self.held: list[bytes] | None = []
        self.size = self.count = 0

    def add(self, record: bytes) -> None:
        self.count += 1
        if self.held is None:
            self._put(self.zstd.compress(record))
            return
        self.held.append(record)
        if len(self.held) >= DICT_SAMPLE_RECORDS or sum(map(len, self.held)) >= DICT_SAMPLE_BYTES:
            self._begin()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        import zstandard

        try:
            made = zstandard.train_dictionary(DICT_BYTES, self.held)
        except zstandard.ZstdError:  # too few samples: the records' first bytes serve as they are
            sample = b"".join(r[:512] for r in self.held)[:DICT_BYTES]
            made = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw = made.as_bytes()
        self._put(struct.pack("<II", DICT_FRAME, len(raw)) + raw)
        self.zstd = zstandard.ZstdCompressor(level=self.level, dict_data=made, write_checksum=True)
        held, self.held = self.held, None
        for r in held:
            self._put(self.zstd.compress(r))

    def close(self) -> None:
        if self.held is not None:
            self._begin()
        self.out.close()


def read_frames(stream) -> Iterator[bytes]:
    """The decoded bytes of each frame of an archive, given a binary stream; ValueError if it is damaged."""
    import zstandard

    def exactly(n: int) -> bytes:
        data = b""
        while len(data) < n and (more := stream.read(n - len(data))):
            data += more
        if len(data) < n:
            raise ValueError("the file ends within a frame")
        return data

    magic, size = struct.unpack("<II", exactly(8))
    if magic != DICT_FRAME:
        raise ValueError("the file doesn't begin with a dictionary frame")
    raw = exactly(size)
    if raw[:4] == struct.pack("<I", ZSTD_FRAME):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    rest = b""
    while True:
        if not rest:
            rest = stream.read(READ_BYTES)
            if not rest:
                return
        one, parts = zstd.decompressobj(), []
        try:
            while True:
                parts.append(one.decompress(rest))
                if one.eof:
                    rest = one.unused_data
                    break
                rest = stream.read(READ_BYTES)
                if not rest:
                    raise ValueError("the file ends within a frame")
        except zstandard.ZstdError as e:
            raise ValueError(f"damaged frame: {e}") from e
        yield b"".join(parts)


def with_duplicates(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``pages`` with ``__refers_to``: the largest id among equal payloads, null for that row itself.

    Only the keys of payloads that occur more than once are joined back: the payloads
    themselves aren't shuffled unless those keys outgrow a broadcast.
    """
    key = F.sha1(F.coalesce(F.col(payload_col), F.lit("")))
    size = F.octet_length(F.coalesce(F.col(payload_col), F.lit("")))
    many = (
        pages.groupBy(key.alias("__key"), size.alias("__size"))
        .agg(F.max(id_col).alias("__first"), F.count("*").alias("__n"))
        .where("__n > 1")
        .drop("__n")
    )
    many = materialize(many, "equal-payloads")
    joined = pages.join(broadcast_if_small(many), (key == F.col("__key")) & (size == F.col("__size")), "left")
    other = F.when(~F.col(id_col).eqNullSafe(F.col("__first")), F.col("__first"))
    return joined.withColumn("__refers_to", other).drop("__key", "__size", "__first")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", level: int = 3, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record for each row of ``pages`` and return the manifest (``path``, ``n_records``).

    Of rows with equal payloads those with the largest id are responses, the others
    revisit it. Null payloads are empty, null urls are ``urn:none``; ids of any type are
    written percent-encoded (``<urn:page:...>``), null ones as ``<urn:nopage>``. A repeated
    task writes new names; the manifest lists the files of the attempts that succeeded.
    An empty table writes no file.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    rows = with_duplicates(pages.select(id_col, url_col, payload_col), id_col, payload_col).select(
        F.col(id_col).cast("string"), url_col, payload_col, F.col("__refers_to").cast("string")
    )
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done, writer = [], None
        for batch in batches:
            for page, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(store.open_output_stream(f"{root}/{name}", compression=None), level)
                writer.add(
                    make_record(
                        page_uri(page),
                        url or "urn:none",
                        (payload or "").encode(),
                        refers_to if refers_to is None else page_uri(refers_to),
                    )
                )
                if writer.size >= file_bytes:
                    writer.close()
                    done.append((f"{folder}/{name}", writer.count))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((f"{folder}/{name}", writer.count))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "n_records"])

    return materialize(rows.mapInArrow(run, schema), "warc-files")


def read_archives(paths: DataFrame, payload: bool = True, permissive: bool = False) -> DataFrame:
    """The records of the archives in column ``path``, one row each (``RECORD``), a file a task.

    ``payload=False`` leaves the payload column null. A damaged file or record raises
    ValueError; with ``permissive`` it gives a row with ``error`` set instead, and reading
    goes on after a damaged record, not after a damaged frame.
    """
    spark = paths.sparkSession
    n = paths.count()

    def row(path: str, data: bytes) -> tuple:
        r = parse_record(data)
        return (
            path,
            r["warc-type"],
            r["warc-record-id"],
            r.get("warc-target-uri"),
            r.get("warc-refers-to"),
            r.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            len(r["payload"]) if r["warc-type"] != "revisit" else None,
            r["payload"] if payload else None,
            None,
        )

    def rows(path: str) -> Iterator[tuple]:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        try:
            with store.open_input_stream(name, compression=None) as stream:
                for data in read_frames(stream):
                    try:
                        yield row(path, data)
                    except ValueError as e:
                        if not permissive:
                            raise
                        yield (path, *[None] * 7, str(e))
        except ValueError as e:
            if not permissive:
                raise ValueError(f"{path}: {e}") from e
            yield (path, *[None] * 7, str(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(RECORD)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for r in rows(path):
                    held.append(r)
                    size += len(r[7] or b"")
                    if len(held) >= 2000 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in held], schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in held], schema)

    spread = paths.select("path").repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism)))
    return spread.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives, read them back, and report each page's payload.

    ``payload_bytes`` of a revisit record is that of the response it refers to, looked
    up among the records that were read. The responses that are referred to have one row
    an id, so a payload that a third of all pages share is a small side of the join. Ids
    come back in their own type, whatever characters they hold; a null id stays null.
    """
    records = materialize(read_archives(write_archives(pages, id_col, url_col, payload_col), payload=False), "records")

    def page(c):
        own = F.when(F.col(c).startswith("<urn:page:"), F.url_decode(F.regexp_extract(c, r"^<urn:page:([^>]*)>$", 1)))
        return own.cast(pages.schema[id_col].dataType)

    of = records.select(
        page("record_id").alias(id_col),
        page("refers_to").alias("refers_to"),
        "record_type",
        "payload_bytes",
        "payload_digest",
    )
    asked = of.where("refers_to is not null").select(F.col("refers_to").alias("_asked")).distinct()
    responses = of.where("record_type = 'response'").join(broadcast_if_small(asked), F.col(id_col) == F.col("_asked"), "left_semi")
    known = responses.groupBy(F.col(id_col).alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    known = broadcast_if_small(materialize(known, "responses"))
    return of.join(known, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left").select(
        id_col, F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )



#: DuckDB SQL for ``round_trip`` over ``pages``: base32 is spelled out from the bits of the hex digest.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, array_to_string(list_transform(string_split(sha1(html), ''), lambda c:
  ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM g"""
