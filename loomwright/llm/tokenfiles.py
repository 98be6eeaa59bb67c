"""Token ids in seekable zstandard files, and readers that decompress only what is asked for.

File format (a valid zstandard file)::

    one independent zstandard frame a document: its ids as little-endian uint32
    skippable frame 0x184D2A5D: the documents' ids as little-endian int64, and one
        byte each that is 1 where the id is null
    skippable frame 0x184D2A5E, the seek table: for each document's frame its
        compressed size, decompressed size and the low 32 bits of the XXH64 of its
        decompressed bytes (uint32 each); then the number of frames (uint32), a
        descriptor byte 0x80 (checksums present) and 0x8F92EAB1

Documents are encoded and compressed where they are read. The finished frames, less than
the texts, go to ranges of ids, whose limits are quantiles of the ids alone, and are sorted
there; each partition copies them into files of a bounded size, and a manifest of files
(not of documents) gives every file its offset in the whole token stream.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MEMO_WORDS, broadcast_if_small, materialize, pieces, shared_dir
from .letters import doubtful

INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: The split pattern of the vocabulary's byte-level pre-tokenizer (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Writers of few ids.
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
#: A byte that UTF-8 never has.
NO_TEXT = b"\xc0"
#: Ranges of ids are at most so many; what null ids count as where ranges are found.
MOST_RANGES, LEAST_ID = 20_000, -(1 << 63)
#: Compressed bytes after which a writer starts its next file.
FILE_BYTES = 64 << 20

MANIFEST = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
FRAME = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("range", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("check", T.LongType()),
        T.StructField("frame", T.BinaryType()),
    ]
)
READ = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


class LibraryEncoder:
    """Ids of whole texts from a byte-level ``tokenizers`` file, as little-endian uint32 bytes.

    Texts are cut at single spaces; the parts that a batch brings for the first time are
    split by the vocabulary's pattern together, and the library's model encodes each new
    word. Texts in which a part ends in white space (which could belong together with the
    next one) are split whole; texts with special strings, or with characters on whose
    classes Unicode versions differ, go to the library as they are.
    """

    def __init__(self, path: str, pattern: str = SPLIT, memo: int = MEMO_WORDS):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.find = regex.compile(pattern).findall
        self.to_chars = {b: c for b, c in enumerate(byte_chars())}
        self.parts: dict[str, bytes | bool] = {}
        self.words: dict[str, bytes] = {}
        self.long: list[str] = []  # words too long to be kept after their batch
        self.memo = memo
        self.plain = True
        for probe in ("a b c\n d, e!f 1 2\u3000x it's été", "x" * 40 + " \U0001f600\u0301 y", "a  b\n\n c \td "):
            self.plain = self.plain and next(self.encode_batch([probe])) == self._by_library(probe)

    def _by_library(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_words(self, words: set[str]) -> None:
        """Encode the words that aren't known; a byte that no text has stands between them."""
        new = list(words.difference(self.words))
        if new:
            tokenize, chars = self.lib.model.tokenize, NO_TEXT.join([w.encode() for w in new]).decode("latin-1").translate(self.to_chars)
            for word, c in zip(new, chars.split(self.to_chars[NO_TEXT[0]])):
                ids = [t.id for t in tokenize(c)]
                self.words[word] = PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)
                if len(word) > 100:
                    self.long.append(word)

    def _learn_parts(self, parts: set[str]) -> None:
        """Encode the parts that aren't known, each with the space before it; false for those that end in white space."""
        new = [p for p in parts if p and not p[-1].isspace()]
        self.parts.update(dict.fromkeys(parts.difference(new), False))
        if new:
            words = self.find(" " + " ".join(new))
            self._learn_words(set(words))
            ids = list(map(self.words.__getitem__, words))
            # no part has a space within, so the words that begin with one begin the parts
            starts = [k for k, w in enumerate(words) if w[0] == " "]
            for part, a, b in zip(new, starts, [*starts[1:], len(words)], strict=True):
                self.parts[part] = ids[a] if b == a + 1 else b"".join(ids[a:b])

    def _split_whole(self, text: str) -> bytes:
        words = self.find(text)
        self._learn_words(set(words))
        return b"".join(map(self.words.__getitem__, words))

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        for memo in (self.parts, self.words):
            if len(memo) > self.memo:
                memo.clear()
        get, cut, need, odd = self.parts.get, [], set(), doubtful
        for text in texts:
            if not self.plain or any(s in text for s in self.special) or not text.isascii() and odd(text):
                cut.append(None)
                continue
            first, *parts = text.split(" ")
            known = list(map(get, parts))
            places = []  # of parts that aren't known yet
            k = -1
            for _ in range(known.count(None)):
                places.append(k := known.index(None, k + 1))
            need.update([parts[k] for k in places])
            # a space behind white space may belong to the word before it: such texts are split whole
            whole = bool(parts) and (not first or first[-1].isspace())
            cut.append((first, parts, known, places, whole))
        self._learn_parts(need)
        for text, found in zip(texts, cut):
            if found is None:
                yield self._by_library(text)
                continue
            first, parts, known, places, whole = found
            for k in places:
                known[k] = self.parts[parts[k]]
            if whole or False in known:
                yield self._split_whole(text)
            else:
                yield self._split_whole(first) + b"".join(known)
        for memo, long in ((self.parts, [p for p in need if len(p) > 100]), (self.words, self.long)):
            for x in long:
                memo.pop(x, None)
        self.long.clear()


def byte_chars() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


_OPEN: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """One encoder a worker process, kept from task to task."""
    if path not in _OPEN:
        _OPEN[path] = LibraryEncoder(path)
    return _OPEN[path]


class FrameWriter:
    """Writes one file to an Arrow output stream."""

    def __init__(self, out):
        self.out = out
        self.ids: list[int | None] = []
        self.table: list[bytes] = []
        self.size = self.tokens = 0

    def add(self, doc_id: int | None, frame: bytes, size: int, check: int) -> None:
        self.out.write(frame)
        self.size += len(frame)
        self.tokens += size // 4
        self.ids.append(doc_id)
        self.table.append(struct.pack("<III", len(frame), size, check & 0xFFFFFFFF))

    def close(self) -> None:
        index = struct.pack(f"<{len(self.ids)}q", *[x or 0 for x in self.ids]) + bytes(x is None for x in self.ids)
        table = b"".join(self.table) + struct.pack("<IBI", len(self.table), 0x80, FOOTER_MAGIC)
        for magic, body in ((INDEX_MAGIC, index), (TABLE_MAGIC, table)):
            self.out.write(struct.pack("<II", magic, len(body)) + body)
        self.out.close()


class FrameReader:
    """Random access to the documents of one file; reads the tail, then only the frames asked for."""

    def __init__(self, file):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        self.table = list(struct.iter_unpack("<III", self._at(at := size - 9 - 12 * n, 12 * n)))
        if struct.unpack("<II", self._at(at - 8, 8)) != (TABLE_MAGIC, 12 * n + 9):
            raise ValueError("the seek table's frame has another size")
        at -= 8 + 9 * n
        if struct.unpack("<II", self._at(at - 8, 8)) != (INDEX_MAGIC, 9 * n):
            raise ValueError("the frame of document ids has another size")
        ids, null = struct.unpack(f"<{n}q", self._at(at, 8 * n)), self._at(at + 8 * n, n)
        self.ids = [None if e else x for x, e in zip(ids, null)]
        self.offsets = [0, *accumulate(t[0] for t in self.table)]
        if self.offsets[-1] != at - 8:
            raise ValueError("the seek table doesn't cover the frames")

    def _at(self, offset: int, n: int) -> bytes:
        if offset < 0 or len(data := self.file.read_at(n, offset)) != n:
            raise ValueError("the file ends too soon")
        return data

    def document(self, k: int) -> bytes:
        """The id bytes of the k-th document, checked against its checksum."""
        import xxhash

        packed, size, check = self.table[k]
        data = self.zstd.decompress(self._at(self.offsets[k], packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data


def id_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Ids that part the documents into ranges of about equal numbers; an id of many rows comes several times.

    Ranges hold about 128 MB of text or a million documents in large tables, and there are at most
    ``MOST_RANGES`` of them (beyond that they grow). Null ids count as the smallest.
    """
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    n = min(MOST_RANGES, max((size or 0) >> 27, rows >> 20, min(8 * cores, max((size or 0) >> 21, rows >> 14)), 1), max(1, rows))
    if n == 1:
        return []
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID))
    return docs.select(F.percentile_approx(ids, [k / n for k in range(1, n)], 100_000)).first()[0] or []


def ranges_of(ids: np.ndarray, checks: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The range of each row; where several limits equal its id, the row's hash decides between theirs."""
    low, high = np.searchsorted(limits, ids, "left"), np.searchsorted(limits, ids, "right")
    part = (checks.astype("i8").view("u8") >> np.uint64(32)).astype("f8") / 2**32
    # signed hashes are sorted, so the upper half of the unsigned ones comes first
    return low + np.floor((high - low + 1) * ((part + 0.5) % 1.0)).astype("i8")


def encode_frames(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, level: int = 1, id_col: str = "doc_id", text_col: str = "text", limits: list[int] = ()
) -> DataFrame:
    """``doc_id``, its ``range``, and the ``frame`` of every whole text's ids with ``end_id``; ``size`` and ``check`` (XXH64) of what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        import xxhash
        import zstandard

        lib, end = encoder(tokenizer_path), struct.pack("<I", end_id)
        zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        bounds = np.array(limits, "i8")
        gc.disable()  # memos hold a million objects, none in a cycle
        try:
            for batch in (p for b in batches for p in pieces(b)):
                made = [ids + end for ids in lib.encode_batch([x or "" for x in batch.column(1).to_pylist()])]
                checks = np.array([xxhash.xxh64_intdigest(x) for x in made], "u8").view("i8")
                doc_ids = pc.fill_null(batch.column(0), LEAST_ID).to_numpy()
                columns = [
                    batch.column(0),
                    pa.array(ranges_of(doc_ids, checks, bounds), pa.int32()),
                    pa.array([len(x) for x in made], pa.int64()),
                    pa.array(checks),
                    pa.array(map(zstd.compress, made), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, FRAME.names)
        finally:
            gc.enable()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FRAME)


def write_tokens(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, level: int = 1, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Encode every whole text, append ``end_id``, write files in ascending id order.

    Returns the manifest: ``path``, ``n_docs``, ``n_tokens`` and ``first_token`` (tokens
    of all files before) of each file. Null and empty texts have the end id only; null
    ids come first; rows of one id follow each other in the order of their tokens' hashes,
    so an id of any number of rows is spread over partitions. Ids must be integers (others
    raise ValueError). An empty table gives an empty manifest. A repeated task writes new
    names, and only the files of the attempts that succeeded are in the manifest.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must be an integer column: the files' order is that of numbers")
    folder = shared_dir(spark, "tokens")
    limits = id_ranges(docs, id_col, text_col)
    frames = encode_frames(docs, tokenizer_path, end_id, level, id_col, text_col, limits)
    ordered = frames.repartitionById(len(limits) + 1, F.col("range")).sortWithinPartitions("doc_id", "check")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, done, writer = TaskContext.get().partitionId(), [], None

        def close():
            writer.close()
            done.append((part, len(done), name, len(writer.ids), writer.tokens))

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "frame", "size", "check"))):
                if writer is None:
                    name = f"{part:06d}-{uuid.uuid4().hex}.zst"
                    writer = FrameWriter(store.open_output_stream(f"{root}/{name}", compression=None))
                writer.add(*row)
                if writer.size >= file_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
            MANIFEST.names,
        )

    files = materialize(ordered.mapInArrow(run, MANIFEST), "token-files")
    # offsets in two steps, so that no task meets all files: within blocks of parts, and over the blocks
    blocked = files.withColumn("block", F.floor(F.col("part") / 1000))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    offsets = sums.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("block").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return blocked.join(broadcast_if_small(offsets), "block").select(
        F.concat(F.lit(folder + "/"), "path").alias("path"),
        "n_docs",
        "n_tokens",
        (F.col("offset") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("first_token"),
    )


def read_tokens(manifest: DataFrame, wanted: frozenset[int] | None = None) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of the documents in the files.

    ``wanted``: only the frames of these ids are read and decompressed. Damaged files
    raise ValueError.
    """
    spark = manifest.sparkSession
    n = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    reader, rows = FrameReader(file), []
                    for k, (doc_id, (_, size, _)) in enumerate(zip(reader.ids, reader.table)):
                        if wanted is None or doc_id in wanted:
                            rows.append((doc_id, start, size // 4, zlib.crc32(reader.document(k))))
                        start += size // 4
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], READ.names)

    spread = manifest.select("path", "first_token").repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism)))
    return spread.mapInArrow(run, READ)
