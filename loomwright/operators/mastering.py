"""Audio processing of whole clips in numpy, applied to an array column in Arrow batches.

Filters run as convolution with their impulse response (cut where it has died away), so
there is no loop over samples; a clip is one row, and clips spread over the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the loudness weighting and of the mastering chain.
K_SHELF = (1681.974450955533, 3.999843853973347, 0.7071752369554196)
K_HIGHPASS = (38.13547087602444, 0.5003270373238773)
LOUDNESS_OFFSET, SILENT_LUFS = -0.691, -70.0
TARGET_LUFS, PEAK_DB = -16.0, -1.5
MODES = ("tat", "nhe", "chuan", "manh")


def _rbj(kind: str, freq: float, rate: int, gain_db: float = 0.0, q: float = math.sqrt(0.5)) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a second-order section by the well-known cookbook formulas."""
    w = 2 * math.pi * min(freq, 0.49 * rate) / rate
    c, alpha, amp = math.cos(w), math.sin(w) / (2 * q), 10 ** (gain_db / 40)
    if kind == "highpass":
        b, a = [(1 + c) / 2, -(1 + c), (1 + c) / 2], [1 + alpha, -2 * c, 1 - alpha]
    elif kind == "bandpass":
        b, a = [alpha, 0.0, -alpha], [1 + alpha, -2 * c, 1 - alpha]
    elif kind == "peak":
        b, a = [1 + alpha * amp, -2 * c, 1 - alpha * amp], [1 + alpha / amp, -2 * c, 1 - alpha / amp]
    else:
        s = 1 if kind == "highshelf" else -1
        r = 2 * math.sqrt(amp) * alpha
        b = [amp * ((amp + 1) + s * (amp - 1) * c + r), -2 * s * amp * ((amp - 1) + s * (amp + 1) * c), amp * ((amp + 1) + s * (amp - 1) * c - r)]
        a = [(amp + 1) - s * (amp - 1) * c + r, 2 * s * ((amp - 1) - s * (amp + 1) * c), (amp + 1) - s * (amp - 1) * c - r]
    return np.array(b) / a[0], np.array(a) / a[0]


@lru_cache(64)
def _response(sections: tuple) -> np.ndarray:
    """Impulse response of a cascade of (kind, freq, rate, gain, q), cut below 1e-9 of its peak."""
    x = np.zeros(1 << 15)
    x[0] = 1.0
    for s in sections:
        b, a = _rbj(*s)
        y, y1, y2, x1, x2 = np.empty_like(x), 0.0, 0.0, 0.0, 0.0
        for k, v in enumerate(x.tolist()):
            out = b[0] * v + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
            x2, x1, y2, y1 = x1, v, y1, out
            y[k] = out
        x = y
    live = np.flatnonzero(np.abs(x) > 1e-9 * np.abs(x).max())
    return x[: live[-1] + 1]


def filtered(x: np.ndarray, *sections: tuple) -> np.ndarray:
    """``x`` through the cascade, by overlap-add in blocks; block size doesn't matter."""
    h = _response(tuple(sections))[: max(1, len(x))]
    block, out = min(1 << 16, max(1, len(x))), np.zeros(len(x) + len(h))
    size = 1 << (block + len(h)).bit_length()
    spectrum = np.fft.rfft(h, size)
    for k in range(0, len(x), block):
        part = x[k : k + block]
        y = np.fft.irfft(np.fft.rfft(part, size) * spectrum, size)[: len(part) + len(h) - 1]
        out[k : k + len(y)] += y
    return out[: len(x)]


def loudness(x: np.ndarray, rate: int) -> float:
    """Ungated loudness; clips under 0.1 s and silent ones give the least value."""
    if len(x) < 0.1 * rate:
        return SILENT_LUFS
    (f, g, q), (f2, q2) = K_SHELF, K_HIGHPASS
    power = float(np.mean(filtered(x, ("highshelf", f, rate, g, q), ("highpass", f2, rate, 0.0, q2)) ** 2))
    return max(SILENT_LUFS, LOUDNESS_OFFSET + 10 * math.log10(power)) if power > 1e-10 else SILENT_LUFS


def _sliding_max(x: np.ndarray, n: int) -> np.ndarray:
    """Maximum over n samples on either side, by doubling."""
    width, out, have = 2 * n + 1, np.pad(x, n, mode="constant"), 1
    while have < width:
        step = min(have, width - have)
        out = np.maximum(out[: len(out) - step], out[step:])
        have += step
    return out


def _smooth(x: np.ndarray, rate: float, attack_ms: float, release_ms: float) -> np.ndarray:
    """One-pole smoothing whose constant depends on the direction."""
    up, down = (math.exp(-1000.0 / (rate * max(ms, 1e-3))) for ms in (attack_ms, release_ms))
    out, y = np.empty_like(x), float(x[0]) if len(x) else 0.0
    for k, v in enumerate(x.tolist()):
        a = up if v > y else down
        y = a * y + (1 - a) * v
        out[k] = y
    return out


STEP = 32


def _apply_gain(x: np.ndarray, gain_db: np.ndarray) -> np.ndarray:
    """A gain curve of one value every ``STEP`` samples, drawn through by straight lines."""
    return x * 10 ** (np.interp(np.arange(len(x)), np.arange(len(gain_db)) * STEP, gain_db) / 20)


def compress(x: np.ndarray, rate: int, threshold_db: float = -22.0, ratio: float = 2.5, attack_ms: float = 10.0, release_ms: float = 150.0) -> np.ndarray:
    """Levels above the threshold come closer to it."""
    if len(x) < 0.1 * rate:
        return x
    n = max(1, int(0.003 * rate))
    total = np.concatenate(([0.0], np.cumsum(x * x)))
    at = np.arange(0, len(x), STEP)
    low, high = np.maximum(at - n // 2, 0), np.minimum(at + n // 2 + 1, len(x))
    level = 10 * np.log10((total[high] - total[low]) / (high - low) + 1e-12)
    over = np.maximum(level - threshold_db, 0) * (1 - 1 / ratio)
    return _apply_gain(x, -_smooth(over, rate / STEP, attack_ms, release_ms))


def limit(x: np.ndarray, rate: int, ceiling_db: float = PEAK_DB, look_ms: float = 3.0, release_ms: float = 80.0) -> np.ndarray:
    """Peaks stay below the ceiling: gain from the sliding maximum, then a hard clip."""
    if not len(x):
        return x
    ceiling = 10 ** (ceiling_db / 20)
    top = _sliding_max(np.abs(x), max(1, int(look_ms / 1000 * rate)))[::STEP]
    over = np.maximum(20 * np.log10(np.maximum(top, 1e-9) / ceiling), 0)
    return np.clip(_apply_gain(x, -_smooth(over, rate / STEP, 0.1, release_ms)), -ceiling, ceiling)


def _frames(x: np.ndarray, size: int = 1024, hop: int = 512) -> tuple[np.ndarray, np.ndarray]:
    window = np.hanning(size + 1)[:-1]
    padded = np.pad(x, (size, size + (-len(x)) % hop))
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, size)[::hop] * window, axis=1), window


def _unframe(spectrum: np.ndarray, n: int, size: int = 1024, hop: int = 512) -> np.ndarray:
    parts = np.fft.irfft(spectrum, size, axis=1)
    out = np.zeros(hop * (len(parts) - 1) + size)
    for k, p in enumerate(parts):  # Hann windows half a size apart add up to one
        out[k * hop : k * hop + size] += p
    return out[size : size + n]


def denoise(x: np.ndarray, rate: int, depth_db: float = 9.0) -> np.ndarray:
    """Each frequency loses what its quietest tenth of frames holds, ``depth_db`` at most."""
    if len(x) < 0.25 * rate:
        return x
    spectrum, _ = _frames(x)
    size = np.abs(spectrum)
    floor = np.percentile(size[2:-2] if len(size) > 8 else size, 10, axis=0)
    gain = np.clip((size - 1.5 * floor) / np.maximum(size, 1e-12), 10 ** (-depth_db / 20), 1.0)
    padded = np.pad(gain, ((1, 1), (0, 0)), mode="edge")
    return _unframe(spectrum * (padded[:-2] + padded[1:-1] + padded[2:]) / 3, len(x))


def deess(x: np.ndarray, rate: int, threshold_db: float = -26.0, most_db: float = 6.0) -> np.ndarray:
    """The band from 5 to 9 kHz is turned down where it is loud."""
    if len(x) < 0.1 * rate or rate < 11000:
        return x
    centre = math.sqrt(5000 * min(9000, 0.45 * rate))
    band = filtered(x, ("bandpass", centre, rate, 0.0, centre / 4000))
    level = _sliding_max(np.abs(band), max(1, int(0.002 * rate)))[::STEP]
    over = np.clip((20 * np.log10(np.maximum(level, 1e-9)) - threshold_db) * 0.6, 0, most_db)
    return x - band + _apply_gain(band, -_smooth(over, rate / STEP, 1.0, 60.0))


def stretch(x: np.ndarray, rate: int, speed: float) -> np.ndarray:
    """Duration divided by ``speed`` (0.5 to 2) at the same pitch: overlapped frames placed where they fit best."""
    speed = min(2.0, max(0.5, speed))
    if abs(speed - 1) < 0.01 or len(x) < 0.1 * rate:
        return x
    size = int(0.04 * rate) // 2 * 2
    hop, reach = size // 2, int(0.008 * rate)
    window = np.hanning(size + 1)[:-1]
    n = max(1, int(len(x) / speed) // hop)
    padded = np.pad(x, (reach, size + reach + int(hop * speed)))
    out, at = np.zeros(hop * n + size), 0
    for k in range(n):
        ideal = int(k * hop * speed)
        if k:
            want = padded[reach + at + hop : reach + at + hop + size]
            field = padded[ideal : ideal + size + 2 * reach]
            views = np.lib.stride_tricks.sliding_window_view(field, len(want))[: 2 * reach + 1]
            at = ideal - reach + int(np.argmax(views @ want / (np.sqrt((views * views).sum(axis=1)) + 1e-9)))
        out[k * hop : k * hop + size] += padded[reach + at : reach + at + size] * window
    return out[: int(len(x) / speed)]


def shift_pitch(x: np.ndarray, rate: int, semitones: float) -> np.ndarray:
    """Pitch moved by up to six semitones at the same duration."""
    semitones = min(6.0, max(-6.0, semitones))
    if abs(semitones) < 0.05 or len(x) < 2:
        return x
    longer = stretch(x, rate, 2 ** (-semitones / 12))
    return np.interp(np.linspace(0, len(longer) - 1, len(x)), np.arange(len(longer)), longer)


def master(x: np.ndarray, rate: int, mode: str = "chuan", target: float = TARGET_LUFS, peak_db: float = PEAK_DB) -> np.ndarray:
    """The chain: cleaning, equalizing, levelling to a loudness, limiting. ``tat`` only sets the peak, ``nhe`` skips cleaning and compression."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    x = np.nan_to_num(np.asarray(x, "f8"), nan=0.0, posinf=0.0, neginf=0.0)
    top = float(np.abs(x).max(initial=0.0))
    if mode == "tat" or len(x) < 0.1 * rate or top < 1e-6:
        return x * (10 ** (peak_db / 20) / top) if top >= 1e-6 else x
    x = filtered(x - x.mean(), *[("highpass", 80.0, rate, 0.0, q) for q in (0.5412, 1.3066)])
    strong = mode == "manh"
    if mode != "nhe":
        x = deess(denoise(x, rate, 14.0 if strong else 9.0), rate)
    bands = [("lowshelf", 140.0, rate, 1.0, 0.7071), ("peak", 350.0, rate, -1.5, 1.0), ("peak", 3200.0, rate, 1.5, 0.9), ("highshelf", 9000.0, rate, 1.0, 0.7071)]
    x = filtered(x, *bands)
    if mode != "nhe":
        x = compress(x, rate, -26.0 if strong else -22.0, 3.5 if strong else 2.5)
    for _ in range(2):
        gap = target - loudness(x, rate)
        if abs(gap) <= 0.3:
            break
        x = limit(x * 10 ** (gap / 20), rate, peak_db)
    return np.clip(np.nan_to_num(limit(x, rate, peak_db)), -1.0, 1.0)


def on_clips(f: Callable[..., np.ndarray], pcm: Column, rate: Column, *more: Column) -> Column:
    """``f(samples, rate, ...)`` of each clip as an array<float> column; null clips stay null."""

    @F.pandas_udf("array<float>")
    def run(clips: pd.Series, rates: pd.Series, *rest: pd.Series) -> pd.Series:
        rows = zip(clips, rates, *rest)
        return pd.Series([None if c is None else f(np.asarray(c, "f8"), int(r), *m).astype("f4") for c, r, *m in rows], dtype=object)

    return run(pcm, rate, *more)


def loudness_of(pcm: Column, rate: Column) -> Column:
    """The loudness of each clip."""

    @F.pandas_udf("double")
    def run(clips: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else loudness(np.asarray(c, "f8"), int(r)) for c, r in zip(clips, rates)], dtype="float64")

    return run(pcm, rate)


def stand_in_voice(text: Column, rate: int = 24000) -> Column:
    """The stand-in for a speech model: a faded 150 Hz tone as long as the length law says."""
    seconds = F.greatest(F.lit(0.4), F.length(text) / 15.0)
    at = F.sequence(F.lit(0), F.floor(seconds * rate).cast("int") - 1)
    return F.transform(at, lambda i: F.lit(0.25) * F.sin(2 * math.pi * 150.0 * i / rate) * F.least(F.lit(1.0), i / rate * 20, (seconds - i / rate) * 20))


def prepare_sample(x: np.ndarray, rate: int, start: float | None = None, end: float | None = None, most_s: float = 30.0) -> np.ndarray:
    """A voice sample: the wanted stretch without silence at its ends, cut at a quiet frame near the limit, peak at -3 dBFS."""
    x = np.asarray(x, "f8")[int(max(0.0, start or 0.0) * rate) : int(end * rate) if end else None]
    frame = max(1, int(rate * 0.01))
    if len(x) >= 2 * frame:
        peaks = np.abs(x[: len(x) // frame * frame].reshape(-1, frame)).max(axis=1)
        loud = np.flatnonzero(peaks > max(10 ** (-42 / 20), 0.02 * peaks.max()))
        if len(loud):
            x = x[max(0, int(loud[0] * frame - 0.08 * rate)) : int((loud[-1] + 1) * frame + 0.08 * rate)]
    most, step = int(most_s * rate), max(1, int(rate * 0.02))
    if len(x) > most:
        tail = x[int(most * 0.85) : most]
        frames = np.abs(tail[: len(tail) // step * step].reshape(-1, step)).max(axis=1) if len(tail) >= step else np.zeros(0)
        x = x[: int(most * 0.85) + int(frames.argmin()) * step if len(frames) >= 5 else most]
    top = float(np.abs(x).max(initial=0.0))
    return x * (10 ** (-3 / 20) / top) if top >= 1e-6 else x
