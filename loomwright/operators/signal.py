"""Signal operators on array columns, as built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _doubles(pcm: Column) -> Column:
    return pcm.cast("array<double>")


def peak(pcm: Column) -> Column:
    """The greatest magnitude, 0 of an empty clip."""
    return F.coalesce(F.array_max(F.transform(_doubles(pcm), lambda x: F.abs(x))), F.lit(0.0))


def mean_square(pcm: Column) -> Column:
    """Mean of squares in double precision, 0 of an empty clip."""
    total = F.aggregate(_doubles(pcm), F.lit(0.0), lambda s, x: s + x * x)
    return F.when(F.size(pcm) > 0, total / F.size(pcm)).otherwise(0.0)


def frame_peaks(pcm: Column, frame: Column) -> Column:
    """The peak of each whole frame of ``frame`` samples."""
    n = F.floor(F.size(pcm) / frame).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: peak(F.slice(pcm, i * frame + 1, frame)))


def trim_bounds(peaks: Column, size: Column, frame: Column, rate: Column, threshold_db: float = -42.0, margin: float = 0.04) -> Column:
    """struct(first, last): sample bounds left after silence is cut at both ends, with a margin."""
    level = F.greatest(F.lit(10 ** (threshold_db / 20)), F.array_max(peaks) * 0.02)
    loud = F.transform(peaks, lambda p: p > level)
    head = F.array_position(loud, True) - 1
    tail = F.size(loud) - F.array_position(F.reverse(loud), True)
    some = (F.size(peaks) >= 2) & (F.array_position(loud, True) > 0)
    first = F.greatest(F.lit(0), (head * frame - margin * rate).cast("int"))
    last = F.least(size, ((tail + 1) * frame + margin * rate).cast("int"))
    return F.struct(F.when(some, first).otherwise(0).alias("first"), F.when(some, last).otherwise(size).alias("last"))


def fade(pcm: Column, n: Column) -> Column:
    """Linear ramps over the first and last ``n`` samples, at most half of the clip each."""
    size = F.size(pcm)
    m = F.least(n, F.floor(size / 2).cast("int"))
    ramp = lambda k: F.least(k / (m - 1), F.lit(1.0))
    faded = F.transform(_doubles(pcm), lambda x, i: x * ramp(i) * ramp(size - 1 - i))
    return F.when(m > 1, faded).otherwise(_doubles(pcm))


def normalize_peak(pcm: Column, peak_db: float = -1.0) -> Column:
    """The clip scaled to a peak; a silent one stays."""
    p = peak(pcm)
    return F.when(p < 1e-6, _doubles(pcm)).otherwise(F.transform(_doubles(pcm), lambda x: x * (10 ** (peak_db / 20) / p)))


def level_gain(clips: DataFrame, by: str, pcm_col: str = "pcm", limit_db: float = 4.0) -> DataFrame:
    """``clips`` with ``gain_db``: what brings each clip's RMS to its group's median, within limits."""
    w = Window.partitionBy(by)
    rms = F.sqrt(mean_square(F.col(pcm_col))) + 1e-9
    rows = clips.withColumn("rms", rms)
    gain = F.greatest(F.lit(-limit_db), F.least(F.lit(limit_db), 20 * F.log10(F.median("rms").over(w) / F.col("rms"))))
    return rows.withColumn("gain_db", F.when(F.count("*").over(w) < 2, 0.0).otherwise(gain))


def quietest_cut(peaks: Column, share: float = 0.15) -> Column:
    """The index of the quietest frame among the last ``share`` of the frames, the first among equals."""
    n = F.size(peaks)
    start = F.floor(n * (1 - share)).cast("int")
    tail = F.slice(peaks, start + 1, n - start)
    return start + F.array_position(tail, F.array_min(tail)).cast("int") - 1


def _percentile(sorted_: Column, q: float) -> Column:
    """Linear interpolation between the ranks of a sorted array."""
    at = (F.size(sorted_) - 1) * q
    low = F.floor(at).cast("int")
    a, b = F.get(sorted_, low), F.coalesce(F.get(sorted_, low + 1), F.get(sorted_, low))
    return a + (b - a) * (at - low)


def voice_findings(clips: DataFrame, pcm_col: str = "pcm", rate_col: str = "rate", least_s: float = 4.0, good_s: float = 8.0, most_s: float = 30.0) -> DataFrame:
    """``clips`` with ``findings``: array of struct(level, rule) on whether a clip can serve as a voice sample.

    Levels are error, warning and ok. A silent clip ends after that finding; frame rules
    need ten frames of 20 ms. The thresholds, here and in the defaults, are fixed values.
    """
    pcm, rate = F.col(pcm_col), F.col(rate_col)
    size = F.size(pcm)
    frame = F.greatest(F.lit(1), (rate * 0.02).cast("int"))
    rows = clips.withColumns({"__peak": peak(pcm), "__frames": F.array_sort(frame_peaks(pcm, frame)), "__s": size / rate})
    frames, top, s = F.col("__frames"), F.col("__peak"), F.col("__s")
    rows = rows.withColumns({"__lo": _percentile(frames, 0.1), "__hi": _percentile(frames, 0.9)})
    lo, hi = F.col("__lo"), F.col("__hi")
    quiet = F.size(F.filter(frames, lambda f: f < F.greatest(lo * 2, hi * 0.08))) / F.size(frames)
    clipped = F.size(F.filter(_doubles(pcm), lambda x: F.abs(x) >= 0.999))
    say = lambda level, rule: F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))
    framed = F.size(frames) >= 10
    first = [
        F.when(s < least_s, say("error", "too short")).when(s < good_s, say("warning", "short")).when(s > most_s, say("ok", "long")).otherwise(say("ok", "duration")),
        F.when(rate < 16000, say("warning", "low rate")),
    ]
    rest = [
        F.when(clipped > size * 0.001, say("warning", "clipping")),
        F.when(top < 0.05, say("warning", "quiet")),
        F.when(framed & (hi > 1e-6), F.when(lo <= 1e-9, say("ok", "clean")).when(20 * F.log10(hi / lo) < 12, say("warning", "noise")).otherwise(say("ok", "signal to noise"))),
        F.when(framed & (quiet > 0.45), say("warning", "pauses")),
    ]
    found = F.when(top < 1e-6, F.array_compact(F.array(*first, say("error", "silent")))).otherwise(F.array_compact(F.array(*first, *rest)))
    return rows.withColumn("findings", found).drop("__peak", "__frames", "__s", "__lo", "__hi")
