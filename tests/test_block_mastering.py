"""The mastering chain in blocks against the whole clip, stage by stage, by the definitions."""

import cmath
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_blocks import check, cut, denoise, loop_filter, loop_smooth, whole

from loomwright.operators import block_mastering as M
from loomwright.operators import blocks as B

RATE = 8000
RNG = np.random.default_rng(11)
T = np.arange(9000) / RATE
VOICE = 0.25 * np.sin(2 * np.pi * 220 * T) * (np.sin(2 * np.pi * 1.3 * T) > -0.3) + 0.1 * np.sin(2 * np.pi * 3300 * T) * (np.sin(2 * np.pi * 4 * T) > 0.8) + RNG.normal(0, 0.01, 9000) + 0.05
CLIPS = {"voice": VOICE, "brief": VOICE[:1500] * 2, "click": VOICE[:300], "silent": np.zeros(3000)}


def means(x, width, power):
    before = width // 2
    wide = np.abs(np.pad(x, (before, width - 1 - before), mode="edge")) ** power
    return np.array([wide[k : k + width].mean() for k in range(len(x))])


def down(x, wanted, attack, release):
    a = [math.exp(-1.0 / (RATE / 32 * ms / 1000)) for ms in (attack, release)]
    curve = loop_smooth(wanted, *a)
    return x * 10 ** (np.interp(np.arange(len(x)), np.arange(len(curve)) * 32, curve) / -20)


def limit(x, peak_db=-1.5):
    top = 10 ** (peak_db / 20)
    if np.abs(x).max() <= top or len(x) < RATE // 100:
        return x
    n = int(RATE * 0.003)
    peak = np.array([np.abs(x[max(0, k - n) : k + n + 1]).max() for k in range(len(x))])
    return np.clip(down(x, np.maximum(0, 20 * np.log10((peak[::32] + 1e-9) / top)), 0.5, 80), -top, top)


def lufs(x):
    if len(x) < RATE // 10:
        return -70.0
    (f, g, q), (f2, q2) = M.K_SHELF, M.K_HIGHPASS
    y = loop_filter(x, M.sections(RATE, ("highshelf", f, g, q), ("highpass", f2, 0.0, q2)))
    return -0.691 + 10 * math.log10((y * y).mean() + 1e-12)


def master(x, mode="chuan"):
    if mode == "tat" or len(x) < RATE // 10:
        p = np.abs(x).max()
        return np.clip(x * 10 ** (-1.5 / 20) / p if p >= 1e-6 else x, -1, 1)
    x = loop_filter(x - x.mean(), M.sections(RATE, *M.HIGHPASS))
    if mode != "nhe":
        if len(x) >= RATE // 4:
            x = denoise(x, 1024, M.NOISE_DB[mode])
        high = min(0.99, 9000 / (RATE / 2))
        band = loop_filter(x, M.bandpass(min(high * 0.9, 5000 / (RATE / 2)), high))
        gain = np.minimum(np.maximum(0, 20 * np.log10(means(band, int(RATE * 0.005), 1) + 1e-9) + 26) * 0.6, 6)
        x = x - band * (1 - 10 ** (gain / -20))
    x = loop_filter(x, M.sections(RATE, *M.EQUALIZER))
    if mode != "nhe":
        threshold, ratio = M.COMPRESS[mode]
        level = np.sqrt(means(x, int(RATE * 0.003), 2)) + 1e-9
        x = down(x, (np.maximum(0, 20 * np.log10(level) - threshold) * (1 - 1 / ratio))[::32], 10, 150)
    for _ in range(2):
        at = lufs(x)
        if at <= -70 or abs(-16 - at) < 0.3:
            break
        x = limit(x * 10 ** ((-16 - at) / 20))
    return np.clip(limit(x), -1, 1)


@pytest.mark.parametrize("size,mode", [(512, "chuan"), (9216, "manh"), (320, "nhe"), (512, "tat")])
def test_chain(spark, size, mode):
    out = M.mastered(cut(spark, size, CLIPS), size, RATE, mode)
    check(out, {c: master(x, mode) for c, x in CLIPS.items()}, 1e-7)
    if mode == "chuan":
        got = whole(out)
        assert abs(lufs(got["voice"]) + 16) < 1.5 and np.abs(got["voice"]).max() <= 10 ** (-1.5 / 20) + 1e-12
        assert np.abs(whole(M.mastered(cut(spark, 2048, CLIPS), 2048, RATE))["voice"] - got["voice"]).max() < 1e-7  # blocks don't matter


def test_bandpass_response():
    """Of order 2: gain 1 at the centre, half the power at the edges, none at the ends."""
    for low, high in ((0.2, 0.4), (0.4167, 0.75), (0.01, 0.9), (0.891, 0.99)):
        s = M.bandpass(low, high)

        def at(share):
            z, h = cmath.exp(-1j * math.pi * share), 1.0
            for b0, b1, b2, a1, a2 in s:  # noqa: B023
                h *= (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
            return abs(h)

        edge = lambda x: math.tan(math.pi * x / 2)
        assert at(2 / math.pi * math.atan(math.sqrt(edge(low) * edge(high)))) == pytest.approx(1, abs=1e-6)
        assert at(low) == pytest.approx(math.sqrt(0.5), abs=1e-6) and at(high) == pytest.approx(math.sqrt(0.5), abs=1e-6)
        assert at(1e-9) < 1e-6 and at(1 - 1e-9) < 1e-6
        assert all(a2 < 1 and abs(a1) < 1 + a2 for *_, a1, a2 in s)  # stable


def test_refused(spark):
    df = cut(spark, 64, {"a": VOICE[:100]})
    for bad in (lambda: M.mastered(df, 48, RATE), lambda: M.mastered(df, 64, RATE, "loud")):
        with pytest.raises(ValueError):
            bad()
    assert M.mastered(df.limit(0), 64, RATE).count() == 0


def test_levels(spark):
    df = cut(spark, 512, CLIPS)
    got = {r["clip"]: r["lufs"] for r in M.loudness(df, RATE).collect()}
    assert all(got[c] == pytest.approx(lufs(x), abs=1e-6) for c, x in CLIPS.items())
    assert {r["clip"]: r["peak"] for r in M.peaks(df).collect()} == {c: np.abs(x).max() for c, x in CLIPS.items()}
    assert B.lengths(df).agg(F.sum("n")).first()[0] == sum(map(len, CLIPS.values()))
