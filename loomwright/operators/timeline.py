"""Timelines of segments, word times, subtitle cues and the interval join."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X

#: Fixed values of the subtitle format.
RATE = 24000
CUE_CHARS, CUE_SECONDS, CUE_LEAST, CUE_GAP, WORD_LEAST = 84, 6.0, 0.9, 0.04, 0.05


def spoken_samples(text: Column, rate: int = RATE) -> Column:
    """The length law of the stand-in voice: 15 characters a second, 0.4 s at least."""
    return F.floor(F.greatest(F.lit(0.4), F.length(text) / 15.0) * rate)


def timeline(segments: DataFrame, rate: int = RATE) -> DataFrame:
    """``segments`` with ``s0`` and ``s1``, the samples at which each starts and ends.

    A running sum per script of what came before; segments whose ``samples`` are 0 (or
    null) are dropped first and take no time; a null pause is none. Without that column
    the length law applies.
    """
    rows = segments if "samples" in segments.columns else segments.withColumn("samples", spoken_samples(F.col("text"), rate))
    rows = rows.where("samples > 0")
    before = Window.partitionBy("script_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("samples") + F.floor(F.coalesce("pause", F.lit(0.0)) * rate)).over(before), F.lit(0))
    return rows.withColumn("s0", start.cast("long")).withColumn("s1", (F.col("s0") + F.col("samples")).cast("long")).drop("samples")


def word_times(spans: DataFrame) -> DataFrame:
    """Words of each segment (``t0`` .. ``t1`` seconds), the time shared out by their lengths."""
    words = F.array_remove(F.split("text", X.SPACE), "")
    rows = spans.select("script_id", "seq", F.col("t0").alias("a"), F.col("t1").alias("b"), F.posexplode(words).alias("pos", "word"))
    w = Window.partitionBy("script_id", "seq")
    size = F.greatest(F.length("word"), F.lit(1))
    total = F.sum(size).over(w)
    upto = F.sum(size).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    length = F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).otherwise(0.12 * F.count("*").over(w))
    return rows.select(
        "script_id", "seq", "pos", "word",
        (F.col("a") + length * (upto - size) / total).alias("t0"),
        (F.col("a") + length * upto / total).alias("t1"),
    )


def fill_times(words: DataFrame) -> DataFrame:
    """Times of words that have none, between the known ones before and after in their segment.

    ``words``: ``script_id``, ``seq``, ``pos``, ``word``, ``t0``, ``t1`` (null: unknown) and
    the segment's ``a`` and ``b``. A run of unknown words shares the gap by length; a gap
    of nothing gives 0.12 s a word.
    """
    w = Window.partitionBy("script_id", "seq").orderBy("pos")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.col("t0").isNotNull()
    rows = words.withColumn("run", F.when(~known, F.count(F.when(known, 1)).over(back)))
    rows = rows.withColumn("left", F.coalesce(F.last("t1", ignorenulls=True).over(back), F.col("a")))
    rows = rows.withColumn("right", F.coalesce(F.first("t0", ignorenulls=True).over(ahead), F.col("b")))
    r = Window.partitionBy("script_id", "seq", "run")
    size = F.greatest(F.length("word"), F.lit(1))
    total, upto = F.sum(size).over(r), F.sum(size).over(r.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    gap = F.when(F.col("right") > F.col("left"), F.col("right") - F.col("left")).otherwise(0.12 * F.count("*").over(r))
    return rows.select(
        "script_id", "seq", "pos", "word",
        F.coalesce("t0", F.col("left") + gap * (upto - size) / total).alias("t0"),
        F.coalesce("t1", F.col("left") + gap * upto / total).alias("t1"),
    )


def _cues_of_words(rows: DataFrame) -> DataFrame:
    """Greedy cues (``script_id``, ``seq``, ``k``, ``t0``, ``t1``, ``text``) of each segment's words, in one pass over them.

    Times are made monotone first: no start before the last end, ``WORD_LEAST`` long at least, within the
    segment. A cue is closed before it grows too long, and after a clause once it is long enough.
    Segments are dealt out and sorted; a task holds one cue.
    """
    keys = [rows.schema["script_id"], rows.schema["seq"]]
    schema = T.StructType([*keys, *T.StructType.fromDDL("k int, t0 double, t1 double, text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        clause = re.compile("[,;:—–]$").search
        segment, at, k, words, begin, end, chars = None, 0.0, 0, [], 0.0, 0.0, 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal k, words, chars
            if words:
                out.append((*segment, k, begin, end, " ".join(words)))
                k, words, chars = k + 1, [], 0

        def made() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], f.type) for n, f in enumerate(types)], schema=types)
            out.clear()
            return done

        for batch in batches:
            for script, seq, word, t0, t1, a, b in zip(*(batch.column(c).to_pylist() for c in ("script_id", "seq", "word", "t0", "t1", "a", "b"))):
                if (script, seq) != segment:
                    close()
                    segment, at, k = (script, seq), a or 0.0, 0
                word, last = word or "", float("inf") if b is None else b
                start = min(at if t0 is None else max(t0, at), last)
                at = min(start + WORD_LEAST if t1 is None else max(t1, start + WORD_LEAST), last)
                size = chars + len(word)
                if words and (size > CUE_CHARS or at - begin > CUE_SECONDS):
                    close()
                if not words:
                    begin = start
                words.append(word)
                chars, end = chars + len(word) + 1, at
                if size > CUE_CHARS * 0.6 and clause(word):
                    close()
            yield made()
        close()
        yield made()

    return rows.repartition("script_id", "seq").sortWithinPartitions("script_id", "seq", "pos").mapInArrow(run, schema)


def cues(spans: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """``script_id``, ``cue_no`` (from 1), ``t0``, ``t1`` and ``text`` of the subtitle cues.

    ``spans``: segments with ``t0`` and ``t1`` in seconds; ``words``: their timed words
    (default: ``word_times``). Cues shorter than ``CUE_LEAST`` are lengthened up to the
    next one's start less ``CUE_GAP``.
    """
    timed = (word_times(spans) if words is None else words).select("script_id", "seq", "pos", "word", "t0", "t1")
    bound = spans.select("script_id", "seq", F.col("t0").cast("double").alias("a"), F.col("t1").cast("double").alias("b"))
    rows = _cues_of_words(timed.join(bound, ["script_id", "seq"])).withColumn("text", X.wrap_line(F.col("text")))
    w = Window.partitionBy("script_id").orderBy("seq", "k")
    limit = F.coalesce(F.lead("t0").over(w) - CUE_GAP, F.col("t1") + CUE_LEAST)
    longer = F.when(F.col("t1") - F.col("t0") < CUE_LEAST, F.greatest(F.col("t1"), F.least(F.col("t0") + CUE_LEAST, limit))).otherwise(F.col("t1"))
    return rows.select("script_id", F.row_number().over(w).alias("cue_no"), "t0", longer.alias("t1"), "text")


def srt(cue_rows: DataFrame) -> DataFrame:
    """``script_id`` and ``srt``, the subtitle file of each script."""
    block = F.concat_ws("\n", F.col("cue_no").cast("string"), F.concat(X.srt_time(F.col("t0")), F.lit(" --> "), X.srt_time(F.col("t1"))), F.col("text"), F.lit(""))
    return cue_rows.groupBy("script_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_no", block.alias("b")))), lambda x: x["b"]), "\n").alias("srt"))


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float) -> DataFrame:
    """Rows whose open spans overlap: ``left.hi > right.lo`` and ``left.lo < right.hi``, equal in ``on``.

    A span has a level: the least k such that a bucket of ``width`` * 2**k is as long as it, so it lies
    in two buckets of that level at most, however long it is. A pair meets at the level of its longer
    span: spans are dealt into buckets of their own level, and those of the other side that aren't longer into
    buckets of each level that occurs (found by a short query when the join is made). A pair that shares two buckets is
    kept in the first. Spans with a null end overlap nothing.
    """

    def level(span: tuple[str, str]) -> Column:
        length = F.greatest(F.col(span[1]) - F.col(span[0]), F.lit(0.0))
        return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length / width, F.lit(1.0))))).cast("int")

    def levels(df: DataFrame, span: tuple[str, str]) -> Column:
        found = sorted(r[0] for r in df.select(level(span).alias("k")).where("k IS NOT NULL").distinct().collect())  # at most one a doubling
        return F.array(*[F.lit(k) for k in found]).cast("array<int>")

    def dealt(df: DataFrame, span: tuple[str, str], ks: Column, name: str) -> DataFrame:
        rows = df.where(F.col(span[0]).isNotNull() & F.col(span[1]).isNotNull()).withColumn("__level", F.explode(ks))
        lo, hi = (F.floor(F.col(c) / (width * F.pow(F.lit(2.0), "__level"))) for c in span)
        return rows.withColumn(f"__{name}", lo).withColumn("__bucket", F.explode(F.sequence(lo, F.greatest(lo, hi))))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        (llo, lhi), (rlo, rhi) = left_span, right_span
        pairs = a.join(b, [*on, "__level", "__bucket"]).where((F.col(lhi) > F.col(rlo)) & (F.col(llo) < F.col(rhi)) & (F.col("__bucket") == F.greatest("__l", "__r")))
        return pairs.drop("__level", "__bucket", "__l", "__r")

    of_left, of_right = levels(left, left_span), levels(right, right_span)
    own_left, own_right = level(left_span), level(right_span)
    longer_left = met(dealt(left, left_span, F.array(own_left), "l"), dealt(right, right_span, F.filter(of_left, lambda k: k >= own_right), "r"))
    longer_right = met(dealt(left, left_span, F.filter(of_right, lambda k: k > own_left), "l"), dealt(right, right_span, F.array(own_right), "r"))
    return longer_left.unionByName(longer_right)
