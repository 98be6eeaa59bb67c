"""Helpers shared by the corpus operators: shared storage, bounded broadcasts, batching."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of at most this many are broadcast after having been counted.
BROADCAST_ROWS = 200_000
#: ... and so many bytes, as their values are measured.
BROADCAST_BYTES = 32 << 20
#: Documents, and about so many bytes of text, that a Python worker takes up at once. (Arrow
#: batches themselves are bounded in bytes by Spark's own setting, 64 MB.)
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
#: ... and by this one in the jobs that are run here.
ARROW_BYTES = 4 << 20
#: Entries of a worker's memo of words; it is emptied when full, results never depend on it.
MEMO_WORDS = 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent a temporary folder is taken, but only in local
    mode; on a cluster that would be a folder of one machine, so it is refused. What a
    lazy result reads stays there until the caller removes it (see ``scratch``).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:
        base = f"file://{base}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _SCRATCH:
        made.append(path)
    return path


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Folders made by ``shared_dir`` within the block are deleted after it, but for those taken from the list.

    Results that still read such folders must have been written elsewhere before.
    """
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield made
    finally:
        _SCRATCH.remove(made)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there.

    Arrow batches are kept small while the job runs, since a batch of whole texts is held
    by the JVM and by a Python worker at once; the session's setting is put back after it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    bound = spark.conf.get(_BYTES_SETTING)
    spark.conf.set(_BYTES_SETTING, str(ARROW_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BYTES_SETTING, bound)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of materialized tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._shared_folder)


def _bytes_of(field: T.StructField) -> Column:
    """About how many bytes a value of the column takes."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, T.ArrayType):
        return 32 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return F.lit(32 * len(kind.fields) if isinstance(kind, T.StructType) else 8)


def broadcast_if_small(df: DataFrame, rows: int | None = None, size: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` (``BROADCAST_ROWS``) rows and about ``size`` (``BROADCAST_BYTES``) bytes, else as it is.

    The check reads at most ``rows + 1`` rows; beyond the bounds the planner falls back to
    a shuffled join, which adaptive execution can split.
    """
    rows, size = BROADCAST_ROWS if rows is None else rows, BROADCAST_BYTES if size is None else size
    each = sum((_bytes_of(f) for f in df.schema.fields), F.lit(16))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.sum(each)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def pieces(batch: pa.RecordBatch, text: int = 1, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` rows whose texts have about ``size`` bytes at most, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for k, n in enumerate(lengths.tolist()):
        if k > first and (k - first == rows or total + n > size):
            yield batch.slice(first, k - first)
            first, total = k, 0
        total += n
    if first < len(lengths):
        yield batch.slice(first)


def give_back() -> None:
    """Return memory that this process no longer uses to the machine.

    Called at the end of a task: Python workers stay for later tasks and stages, beside
    whose memory and the JVM's their former peaks would otherwise count.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_KEPT: dict = {}


def kept(key, make: Callable[[], object]):
    """What ``make`` gives, one a worker process; kept from task to task until another key is asked for.

    A worker serves the stages of a pipeline one after another and holds the model of the last one only.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    make: Callable[[], Callable[[list[str]], Iterable[tuple]]],
    schema: T.StructType,
    rows: int = BATCH_ROWS,
    size: int = BATCH_BYTES,
) -> DataFrame:
    """Apply a function of whole texts, batch by batch, beside the unchanged id.

    ``make`` is called once a task and returns a function from a list of texts
    (null: empty) to one tuple a text. It gets at most ``rows`` texts of about ``size``
    bytes at once. Other columns aren't read.
    """
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *schema.fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields]
        work = make()
        for batch in (p for b in batches for p in pieces(b, 1, rows, size)):
            done = list(work([x or "" for x in batch.column(1).to_pylist()]))
            columns = [pa.array([r[k] for r in done], types[k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *names])
        give_back()

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, out)
