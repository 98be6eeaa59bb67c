"""The mastering chain over clips in blocks: long recordings pass through many tasks, a block at a time.

What concerns a whole clip (its mean, peak, loudness, noise floors) are grouped aggregates of one short row a
block; everything else is done block by block with what ``operators.blocks`` carries over their
edges. Stages are written to the shared folder, so a lost executor repeats one stage's tasks.
"""

from __future__ import annotations

import cmath
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import small, written
from . import blocks as B
from .mastering import K_HIGHPASS, K_SHELF, LOUDNESS_OFFSET, MODES, PEAK_DB, SILENT_LUFS, TARGET_LUFS, _rbj

#: Fixed values of the chain: frames, steps of gain curves, filters, and the settings of its stages.
FRAME, STEP = 1024, 32
HIGHPASS = (("highpass", 80.0, 0.0, 0.5412), ("highpass", 80.0, 0.0, 1.3066))
EQUALIZER = (("lowshelf", 140.0, 1.5, 0.707), ("peak", 350.0, -2.0, 1.0), ("peak", 3200.0, 2.0, 0.8), ("highshelf", 9000.0, -1.0, 0.707))
NOISE_DB = {"chuan": 9.0, "manh": 14.0}
COMPRESS = {"chuan": (-22.0, 2.5), "manh": (-26.0, 3.5)}
ESS_HZ, ESS_DB, ESS_SLOPE, ESS_MOST = (5000.0, 9000.0), -26.0, 0.6, 6.0


def sections(rate: int, *made: tuple[str, float, float, float]) -> B.Sections:
    """Second-order sections of (kind, frequency, gain, q)."""
    out = []
    for kind, freq, gain, q in made:
        b, a = _rbj(kind, freq, rate, gain, q)
        out.append((*b.tolist(), *a[1:].tolist()))
    return tuple(out)


def bandpass(low: float, high: float) -> B.Sections:
    """A Butterworth band-pass of order 2 (two sections) between two frequencies, as shares of half the rate.

    The low-pass prototype's poles are moved to the band and to the unit circle's plane by the bilinear transform.
    """
    w1, w2 = 4 * math.tan(math.pi * low / 2), 4 * math.tan(math.pi * high / 2)
    width, centre, gain, poles = w2 - w1, w1 * w2, 1.0 + 0j, []
    for p in (cmath.exp(0.75j * math.pi), cmath.exp(-0.75j * math.pi)):
        half = p * width / 2
        for s in (half + cmath.sqrt(half * half - centre), half - cmath.sqrt(half * half - centre)):
            gain /= 4 - s
            poles.append((4 + s) / (4 - s))
    gain = (gain * 16 * width**2).real
    # the two sections take a pole each with its conjugate
    upper = sorted((p for p in poles if p.imag > 1e-12), key=abs)
    if len(upper) < 2:  # a band so wide that poles are real
        real = sorted(p.real for p in poles)
        pairs = [(real[0] + real[1], real[0] * real[1]), (real[2] + real[3], real[2] * real[3])] if not upper else [(2 * upper[0].real, abs(upper[0]) ** 2)] + [(sum(x.real for x in poles if abs(x.imag) <= 1e-12), math.prod(x.real for x in poles if abs(x.imag) <= 1e-12))]
    else:
        pairs = [(2 * p.real, abs(p) ** 2) for p in upper]
    (s1, p1), (s2, p2) = pairs
    return ((gain, 0.0, -gain, -s1, p1), (1.0, 0.0, -1.0, -s2, p2))


def _per_clip(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """``blocks`` with the columns of one row a clip."""
    b, v = blocks.alias("b"), small(written(values, "clip-values")).alias("v")
    more = [F.col(f"v.{c}") for c in values.columns if c != "clip"]
    return b.join(v, F.col("b.clip").eqNullSafe(F.col("v.clip"))).select("b.clip", "b.block", "b.samples", *more)


def _summed(blocks: DataFrame, work) -> DataFrame:
    """``work(matrix)``, one number a row, as the column ``value``."""
    made = B._mapped(blocks, lambda x: (work(x)[:, None],), {"value": B._DOUBLES})
    return made.select("clip", F.get("value", F.lit(0)).alias("value"))


def peaks(blocks: DataFrame) -> DataFrame:
    """``clip`` and its greatest absolute sample ``peak``."""
    return _summed(blocks, lambda x: np.abs(x).max(axis=1, initial=0.0)).groupBy("clip").agg(F.max("value").alias("peak"))


def loudness(blocks: DataFrame, rate: int) -> DataFrame:
    """``clip`` and its ungated loudness ``lufs``: the weighted signal's mean square; of clips under 0.1 s the least value."""
    (f, g, q), (f2, q2) = K_SHELF, K_HIGHPASS
    weighted = B.filtered(blocks, sections(rate, ("highshelf", f, g, q), ("highpass", f2, 0.0, q2)))
    power = _summed(weighted, lambda y: (y * y).sum(axis=1)).groupBy("clip").agg(F.sum("value").alias("power"))
    n = B.lengths(blocks)
    p, m = power.alias("p"), n.alias("m")
    joined = p.join(m, F.col("p.clip").eqNullSafe(F.col("m.clip"))).select("p.clip", "power", "n")
    level = LOUDNESS_OFFSET + 10 * F.log10(F.col("power") / F.col("n") + 1e-12)
    return joined.select("clip", F.when(F.col("n") >= rate // 10, level).otherwise(F.lit(SILENT_LUFS)).alias("lufs"))


def _turned(blocks: DataFrame, factors: DataFrame) -> DataFrame:
    """``blocks`` times the ``factor`` of their clip."""
    rows = _per_clip(blocks, factors)
    rows = rows.select("clip", "block", "samples", F.array("factor").alias("factor"))
    return B._mapped(rows, lambda x, f: (x * f,), {"samples": B._DOUBLES}, ("samples", "factor"))


def without_mean(blocks: DataFrame) -> DataFrame:
    total = _summed(blocks, lambda x: x.sum(axis=1)).groupBy("clip").agg(F.sum("value").alias("total"))
    t, m = total.alias("t"), B.lengths(blocks).alias("m")
    mean = t.join(m, F.col("t.clip").eqNullSafe(F.col("m.clip"))).select("t.clip", (F.col("total") / F.greatest(F.col("n"), F.lit(1))).alias("mean"))
    rows = _per_clip(blocks, mean).select("clip", "block", "samples", F.array("mean").alias("mean"))
    return B._mapped(rows, lambda x, m: (x - m,), {"samples": B._DOUBLES}, ("samples", "mean"))


def at_peak(blocks: DataFrame, peak_db: float) -> DataFrame:
    """Each clip turned so that its peak is at ``peak_db``; silent ones stay as they are."""
    factor = F.when(F.col("peak") >= 1e-6, 10 ** (peak_db / 20) / F.col("peak")).otherwise(1.0)
    return _turned(blocks, peaks(blocks).select("clip", factor.alias("factor")))


def deessed(blocks: DataFrame, size: int, rate: int) -> DataFrame:
    """The band of sharp consonants turned down where it is loud."""
    high = min(0.99, ESS_HZ[1] / (rate / 2))
    band = written(B.filtered(blocks, bandpass(min(high * 0.9, ESS_HZ[0] / (rate / 2)), high)), "band")
    level = B.sliding_means(band, size, max(1, int(rate * 0.005)))
    x, b, v = blocks.alias("x"), band.alias("b"), level.alias("v")
    same = lambda y: F.col("x.clip").eqNullSafe(F.col(f"{y}.clip")) & (F.col("x.block") == F.col(f"{y}.block"))
    rows = x.join(b, same("b")).join(v, same("v")).select("x.clip", "x.block", F.col("x.samples").alias("samples"), F.col("b.samples").alias("band"), F.col("v.samples").alias("level"))

    def turned(x: np.ndarray, band: np.ndarray, level: np.ndarray):
        down = np.minimum(np.maximum(0.0, 20 * np.log10(level + 1e-9) - ESS_DB) * ESS_SLOPE, ESS_MOST)
        return (x - band * (1 - 10 ** (-down / 20)),)

    return B._mapped(rows, turned, {"samples": B._DOUBLES}, ("samples", "band", "level"))


def _turned_down(blocks: DataFrame, wanted: DataFrame, size: int, rate: int, attack_ms: float, release_ms: float) -> DataFrame:
    """``blocks`` turned down by smoothed decibels, of which ``wanted`` has one for every ``STEP`` samples."""
    up, down = (math.exp(-1.0 / max(1e-6, rate / STEP * ms / 1000)) for ms in (attack_ms, release_ms))
    curve = written(B.smoothed(wanted, up, down), "gain-curve")
    near = B.neighbourhoods(curve, size // STEP, 0, 1)  # the next block's first point ends the last stretch

    def drawn(v: np.ndarray, own: int):
        at, n = np.arange(own * STEP) / STEP, v.shape[1]
        k = np.minimum(np.floor(at).astype("i8"), n - 1)
        return (v[:, k] + (at - k).clip(0, 1) * (v[:, np.minimum(k + 1, n - 1)] - v[:, k]),)

    whole = B._mapped(near, drawn, {"samples": B._DOUBLES}, ("samples",), ("own",))
    x, g = blocks.alias("x"), whole.alias("g")
    same = F.col("x.clip").eqNullSafe(F.col("g.clip")) & (F.col("x.block") == F.col("g.block"))
    rows = x.join(g, same).select("x.clip", "x.block", F.col("x.samples").alias("samples"), F.col("g.samples").alias("decibels"))
    return B._mapped(rows, lambda x, g: (x * 10 ** (g[:, : x.shape[1]] / -20),), {"samples": B._DOUBLES}, ("samples", "decibels"))


def compressed(blocks: DataFrame, size: int, rate: int, threshold_db: float, ratio: float) -> DataFrame:
    """Levels above the threshold come closer to it."""
    squares = B.sliding_means(blocks, size, max(1, int(rate * 0.003)), 2)

    def wanted(mean: np.ndarray):
        level = np.sqrt(np.maximum(mean[:, ::STEP], 0.0)) + 1e-9
        return (np.maximum(0.0, 20 * np.log10(level) - threshold_db) * (1 - 1 / ratio),)

    return _turned_down(blocks, B._mapped(squares, wanted, {"samples": B._DOUBLES}), size, rate, 10.0, 150.0)


def limited(blocks: DataFrame, size: int, rate: int, ceiling_db: float = PEAK_DB) -> DataFrame:
    """Peaks stay below the ceiling; clips that do, or are shorter than 0.01 s, are left alone."""
    ceiling = 10 ** (ceiling_db / 20)
    p, m = peaks(blocks).alias("p"), B.lengths(blocks).alias("m")
    needs = p.join(m, F.col("p.clip").eqNullSafe(F.col("m.clip"))).select("p.clip", ((F.col("peak") > ceiling) & (F.col("n") >= rate // 100)).alias("needs"))
    rows = written(_per_clip(blocks, needs), "to-limit")
    loud, quiet = rows.where("needs").drop("needs"), rows.where("NOT needs").drop("needs")
    top = B.sliding_peaks(loud, size, max(1, int(rate * 0.003)))
    wanted = B._mapped(top, lambda x: (np.maximum(0.0, 20 * np.log10((x[:, ::STEP] + 1e-9) / ceiling)),), {"samples": B._DOUBLES})
    down = _turned_down(loud, wanted, size, rate, 0.5, 80.0)
    return B._mapped(down, lambda x: (np.clip(x, -ceiling, ceiling),), {"samples": B._DOUBLES}).unionByName(B._with_samples(quiet))


def mastered(blocks: DataFrame, size: int, rate: int, mode: str = "chuan", target: float = TARGET_LUFS, peak_db: float = PEAK_DB) -> DataFrame:
    """The chain over clips in blocks of ``size`` samples (a multiple of ``STEP``): cleaning, equalizing, levelling to a loudness, limiting.

    ``tat`` and clips under 0.1 s only have their peak set; ``nhe`` skips cleaning and compression. Clips under
    0.25 s keep their noise. Samples that aren't numbers are 0, results lie between -1 and 1.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if size % STEP:
        raise ValueError(f"blocks have a multiple of {STEP} samples")
    cut = lambda x: B._mapped(x, lambda v: (np.clip(v, -1.0, 1.0),), {"samples": B._DOUBLES})
    if mode == "tat":
        return cut(at_peak(B._with_samples(blocks), peak_db))
    all_clips = written(_per_clip(B._with_samples(blocks), B.lengths(blocks)), "clips")
    long, short = all_clips.where(F.col("n") >= rate // 10), at_peak(all_clips.where(F.col("n") < rate // 10).drop("n"), peak_db)
    x = written(B.filtered(without_mean(long.drop("n")), sections(rate, *HIGHPASS)), "filtered")
    if mode != "nhe":
        some = _per_clip(x, B.lengths(x)).where(F.col("n") >= rate // 4).drop("n")
        brief = _per_clip(x, B.lengths(x)).where(F.col("n") < rate // 4).drop("n")
        x = written(B.denoised(some, size, FRAME, NOISE_DB[mode]).unionByName(brief), "denoised")
        x = written(deessed(x, size, rate), "deessed")
    x = written(B.filtered(x, sections(rate, *EQUALIZER)), "equalized")
    if mode != "nhe":
        x = written(compressed(x, size, rate, *COMPRESS[mode]), "compressed")
    for _ in range(2):
        gap = target - F.col("lufs")
        needs = (F.col("lufs") > SILENT_LUFS) & (F.abs(gap) >= 0.3)
        levels = loudness(x, rate).select("clip", needs.alias("needs"), F.pow(F.lit(10.0), gap / 20).alias("factor"))
        rows = written(_per_clip(x, levels), "levelled")
        louder = rows.where("needs").select("clip", "block", "samples", F.array("factor").alias("factor"))
        louder = written(B._mapped(louder, lambda x, f: (x * f,), {"samples": B._DOUBLES}, ("samples", "factor")), "louder")
        x = written(limited(louder, size, rate, peak_db).unionByName(B._with_samples(rows.where("NOT needs"))), "levelled")
    return cut(limited(x, size, rate, peak_db).unionByName(short))
