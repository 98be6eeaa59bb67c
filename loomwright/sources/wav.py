"""WAV files as a Spark data source: headers alone, samples in blocks, and a committed writer.

``spark.dataSource.register(WavFiles)`` (or ``register(spark)``) makes the format known:

- ``spark.read.format("wav").load(folder)`` lists the .wav files below a folder: what their headers say,
  durations among it, without a look at the samples;
- with ``.option("block", n)`` it reads samples, one row for every n of them (channels averaged, -1 to 1), as
  ``clip``, ``block``, ``samples``, ``rate``, ``error``, which is what ``operators.blocks`` takes;
  a long file is split over many tasks;
- ``write`` (below) writes blocks of clips as mono 16-bit files.

A file that can't be read is a row with an ``error`` and nothing else, and doesn't end the query.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .sinks import FileSink, NamedFiles, file_system

HEADERS = "path string, bytes long, rate int, channels int, bits int, encoding string, n_samples long, seconds double, error string"
BLOCKS = "clip string, block int, samples array<double>, rate int, error string"
#: Format tags of WAV headers: PCM, floating point, and the tag that an extension holds the real one.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Files of a partition where only headers are read; bytes of samples that a task reads.
FILES, TASK_BYTES = 512, 32 << 20
#: Samples and rows after which a task hands blocks on.
BATCH_SAMPLES, BATCH_ROWS = 1 << 17, 1024


@dataclass
class Header:
    rate: int
    channels: int
    bits: int
    tag: int
    start: int  # of the samples
    n_samples: int  # of each channel

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8


def read_header(read_at: Callable[[int, int], bytes], size: int) -> Header:
    """The header of a RIFF file of ``size`` bytes, chunk by chunk; ``read_at(offset, n)`` reads.

    Chunks other than the format's are stepped over. A data chunk that claims more than there
    is (as streams write it) goes on to the end of the file.
    """
    start = read_at(0, 12)
    if len(start) < 12 or start[:4] != b"RIFF" or start[8:] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, form = 12, None
    while at + 8 <= size:
        kind, n = struct.unpack("<4sI", read_at(at, 8))
        if kind == b"fmt ":
            form = read_at(at + 8, min(n, 40))
            if len(form) < 16:
                raise ValueError("the format chunk is too short")
        elif kind == b"data":
            if form is None:
                raise ValueError("samples come before their format")
            tag, channels, rate, _, frame, bits = struct.unpack("<HHIIHH", form[:16])
            if tag == EXTENSIBLE and len(form) >= 26:
                tag = struct.unpack("<H", form[24:26])[0]
            if (tag, bits) not in ((PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)):
                raise ValueError(f"samples of format {tag} and {bits} bits aren't supported")
            if not channels or not rate or frame != channels * bits // 8:
                raise ValueError("the format contradicts itself")
            return Header(rate, channels, bits, tag, at + 8, min(n, size - at - 8) // frame)
        at += 8 + n + n % 2
    raise ValueError("there are no samples")


def decoded(data: bytes, header: Header) -> np.ndarray:
    """Samples from -1 to 1, channels averaged, of whole frames."""
    if header.tag == FLOAT:
        x = np.frombuffer(data, f"<f{header.bits // 8}").astype("f8")
    elif header.bits == 8:
        x = (np.frombuffer(data, "u1").astype("f8") - 128) / 128
    elif header.bits == 24:  # in the upper bytes of a 32-bit number
        wide = np.zeros((len(data) // 3, 4), "u1")
        wide[:, 1:] = np.frombuffer(data, "u1").reshape(-1, 3)
        x = wide.reshape(-1).view("<i4") / float(1 << 31)
    else:
        x = np.frombuffer(data, f"<i{header.bits // 8}") / float(1 << header.bits - 1)
    return x if header.channels == 1 else x.reshape(-1, header.channels).mean(axis=1)


def wav_header(n: int, rate: int) -> bytes:
    """The header of a mono file of ``n`` samples of 16 bits."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * n, b"WAVE", b"fmt ", 16, PCM, 1, rate, 2 * rate, 2, 16, b"data", 2 * n)


def pcm16(x: np.ndarray) -> bytes:
    """16-bit samples: cut to -1 to 1, times 32767, cut to integers; those that aren't numbers are 0."""
    return (np.clip(np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0), -1.0, 1.0) * 32767.0).astype("<i2").tobytes()


@dataclass
class _Headers(InputPartition):
    files: list[tuple[str, int]]


@dataclass
class _Samples(InputPartition):
    """Blocks ``first`` to ``last`` of files; of files whose header can't be read the error."""

    parts: list[tuple[str, int, int, str | None]]


class WavReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, block: int | None):
        self.path, self.schema, self.block = path, schema, block

    def _listed(self) -> list[tuple[str, int]]:
        fs, root = file_system(self.path)
        one = fs.get_file_info(root)
        found = [one] if one.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        some = [i for i in found if i.type == pafs.FileType.File and i.path.lower().endswith(".wav") and "/_" not in i.path[len(root) :]]
        return sorted((i.path, i.size) for i in some)

    def partitions(self) -> list[InputPartition]:
        files = self._listed()
        if self.block is None:
            return [_Headers(files[k : k + FILES]) for k in range(0, len(files), FILES)] or [_Headers([])]
        # sizes alone part the samples: headers are read by the tasks, and blocks beyond a file's end don't exist
        parts: list[InputPartition] = []
        held, size = [], 0
        for path, n in files:
            blocks = max(1, -(-n // self.block))  # a sample has a byte at least
            each = max(1, TASK_BYTES // (self.block * 2))
            if n <= TASK_BYTES:
                held.append((path, 0, blocks, None))
                size += n
                if size >= TASK_BYTES:
                    parts.append(_Samples(held))
                    held, size = [], 0
            else:
                parts += [_Samples([(path, k, min(k + each, blocks), None)]) for k in range(0, blocks, each)]
        return [*parts, _Samples(held)] if held or not parts else parts

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        schema = to_arrow_schema(self.schema)
        if isinstance(partition, _Headers):
            rows = [self._header_row(fs, path, size) for path, size in partition.files]
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in schema.names} for r in rows], schema)
            return
        rows, held = [], 0
        for path, first, last, _ in partition.parts:
            for row in self._blocks(fs, path, first, last):
                rows.append({k: row.get(k) for k in schema.names})
                held += len(row.get("samples", ()))
                if held >= BATCH_SAMPLES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    @staticmethod
    def _header_row(fs: pafs.FileSystem, path: str, size: int) -> dict:
        row = {"path": path, "bytes": size}
        try:
            with fs.open_input_file(path) as f:
                h = read_header(lambda at, n: f.read_at(n, at), size)
        except (ValueError, struct.error, OSError) as e:
            return row | {"error": str(e)}
        encoding = "float" if h.tag == FLOAT else "pcm"
        return row | {"rate": h.rate, "channels": h.channels, "bits": h.bits, "encoding": encoding, "n_samples": h.n_samples, "seconds": h.n_samples / h.rate}

    def _blocks(self, fs: pafs.FileSystem, path: str, first: int, last: int) -> Iterator[dict]:
        try:
            with fs.open_input_file(path) as f:
                h = read_header(lambda at, n: f.read_at(n, at), f.size())
                for k in range(first, min(last, -(-h.n_samples // self.block))):
                    n = min(self.block, h.n_samples - k * self.block)
                    data = f.read_at(n * h.frame, h.start + k * self.block * h.frame)
                    yield {"clip": path, "block": k, "samples": decoded(data, h), "rate": h.rate}
        except (ValueError, struct.error, OSError) as e:
            if not first:
                yield {"clip": path, "error": str(e)}


class WavFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return BLOCKS if self.options.get("block") else HEADERS

    def reader(self, schema: StructType) -> WavReader:
        block = self.options.get("block")
        if block is not None and int(block) < 1:
            raise ValueError("blocks hold one sample at least")
        return WavReader(self.options["path"], schema, int(block) if block else None)

    def writer(self, schema: StructType, overwrite: bool) -> FileSink:
        if {"clip", "block", "samples", "n"} - {f.name for f in schema.fields}:
            raise ValueError("WAV files are written from clip, block, samples and n (see write)")
        return _WavSink(self.options["path"], overwrite, int(self.options.get("rate", 24000)))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray]]:
    """Clip, its number of samples, and the samples of all rows of a clip that stand together."""
    clips, n, samples = batch.column("clip").to_pylist(), batch.column("n"), batch.column("samples")
    first = 0
    for k in range(1, len(clips) + 1):
        if k == len(clips) or clips[k] != clips[first]:
            yield clips[first], n[first].as_py(), samples.slice(first, k - first).flatten().to_numpy(zero_copy_only=False).astype("f8")
            first = k


class _WavSink(FileSink):
    """Clips as mono files of 16 bits, sample by sample as they come."""

    def __init__(self, folder: str, overwrite: bool, rate: int):
        super().__init__(folder, overwrite)
        self.rate = rate

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
        rows = (r for b in batches for r in _runs(b))
        held = next(rows, None)

        def content(clip: str, n: int) -> Iterator[bytes]:
            nonlocal held
            yield wav_header(n, self.rate)
            while held is not None and held[0] == clip:
                yield pcm16(held[2])
                held = next(rows, None)

        while held is not None:
            yield f"{held[0]}.wav", content(held[0], held[1])


def register(spark: SparkSession) -> None:
    """Make the formats ``wav`` and ``named_files`` known to the session."""
    for source in (WavFiles, NamedFiles):
        spark.dataSource.register(source)


def write(blocks: DataFrame, folder: str, rate: int = 24000, overwrite: bool = False) -> None:
    """Each clip's blocks as the file ``<clip>.wav``.

    A clip's samples pass through one task block by block, since they are one file; headers
    hold lengths counted before, so nothing is held or written twice. Clips of a
    null name are refused.
    """
    register(blocks.sparkSession)
    lengths = blocks.groupBy("clip").agg(F.sum(F.greatest(F.size("samples"), F.lit(0)).cast("long")).alias("n"))
    b, m = blocks.select("clip", "block", "samples").alias("b"), lengths.alias("m")
    rows = b.join(m, F.col("b.clip").eqNullSafe(F.col("m.clip"))).select(F.col("b.clip").cast("string").alias("clip"), "b.block", F.col("b.samples").cast("array<double>").alias("samples"), "m.n")
    rows = rows.repartition("clip").sortWithinPartitions("clip", "block")
    rows.write.format("wav").option("rate", rate).mode("overwrite" if overwrite else "append").save(folder)
