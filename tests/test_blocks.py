"""Signals in blocks against plain loops over whole clips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.operators import blocks

RNG = np.random.default_rng(7)
CLIPS = {"long": RNG.normal(0, 0.3, 5003), "even": RNG.normal(0, 0.5, 512), "one": np.array([0.7]), "zeros": np.zeros(40), None: RNG.normal(0, 0.2, 100)}
SCHEMA = "clip string, block int, samples array<double>"


def cut(spark, size, clips=CLIPS):
    rows = [(c, k // size, x[k : k + size].tolist()) for c, x in clips.items() for k in range(0, len(x), size)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def whole(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["block"]):
        out.setdefault(r["clip"], []).extend(r["samples"])
    return {c: np.array(x) for c, x in out.items()}


def check(df, expected, close=1e-9):
    got = whole(df)
    assert set(got) == set(expected)
    for c, x in expected.items():
        assert len(got[c]) == len(x) and np.abs(got[c] - x).max(initial=0) <= close, c


SECTIONS = ((0.98, -1.96, 0.98, -1.95, 0.955), (1.2, -0.5, 0.1, -1.2, 0.4), (0.3, 0.2, 0.1, 0.5, -0.2))


def loop_filter(x, sections=SECTIONS):
    for b0, b1, b2, a1, a2 in sections:
        p = q = 0.0
        y = np.empty(len(x))
        for k, v in enumerate(x.tolist()):
            y[k] = b0 * v + p
            p, q = b1 * v - a1 * y[k] + q, b2 * v - a2 * y[k]
        x = y
    return x


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_filters(spark, size):
    clips = CLIPS if size > 1 else {"even": CLIPS["even"], None: CLIPS[None]}
    check(blocks.filtered(cut(spark, size, clips), SECTIONS), {c: loop_filter(x) for c, x in clips.items()})


def test_blocks_of_unlike_lengths(spark):
    x, edges = CLIPS["long"], [0, 3, 3, 700, 705, 4000, 5003]
    rows = [("a", k, x[a:b].tolist()) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    df = spark.createDataFrame(rows, SCHEMA)
    check(blocks.filtered(df, SECTIONS), {"a": loop_filter(x)})
    check(blocks.smoothed(df, 0.8, 0.99), {"a": loop_smooth(x, 0.8, 0.99)})


def test_a_clip_in_many_tasks(spark):
    x = RNG.normal(0, 1, 1000)
    df = spark.createDataFrame([("a", k, x[k * 10 : k * 10 + 10].tolist()) for k in range(100)], SCHEMA).repartition(100, "block", F.rand(1))
    out = blocks.filtered(df, SECTIONS)
    assert out.rdd.getNumPartitions() >= 100 and out.select(F.spark_partition_id()).distinct().count() > 50
    check(out, {"a": loop_filter(x)})


def loop_smooth(x, up, down, y=0.0):
    out = np.empty(len(x))
    for k, v in enumerate(x.tolist()):
        a = up if v > y else down
        y = out[k] = a * y + (1 - a) * v
    return out


@pytest.mark.parametrize("size,up,down", [(1, 0.07, 0.98), (7, 0.875, 0.991), (64, 0.99, 0.6), (64, 0.875, 0.991), (3000, 0.5, 0.5)])
def test_attack_and_release(spark, size, up, down):
    clips = {c: x for c, x in CLIPS.items() if size > 1 or len(x) < 600}
    check(blocks.smoothed(cut(spark, size, clips), up, down), {c: loop_smooth(x, up, down) for c, x in clips.items()})
    if size == 64:
        check(blocks.smoothed(cut(spark, size), up, down, 0.4), {c: loop_smooth(x, up, down, 0.4) for c, x in clips.items()})
        with pytest.raises(ValueError):
            blocks.smoothed(cut(spark, size), 0.5, 1.0)


@pytest.mark.parametrize("size,n", [(64, 64), (64, 200), (7, 30), (10, 0)])
def test_sliding_windows(spark, size, n):
    peaks = {c: np.array([np.abs(x[max(0, k - n) : k + n + 1]).max() for k in range(len(x))]) for c, x in CLIPS.items()}
    check(blocks.sliding_peaks(cut(spark, size), size, n), peaks, 0)
    for width in (n + 1, n + 2):
        before = width // 2
        means = {}
        for c, x in CLIPS.items():
            wide = np.abs(np.pad(x, (before, width - 1 - before), mode="edge")) ** 2
            means[c] = np.array([wide[k : k + width].mean() for k in range(len(x))])
        check(blocks.sliding_means(cut(spark, size), size, width, 2), means)


def test_neighbourhoods(spark):
    rows = blocks.neighbourhoods(cut(spark, 64), 64, 100, 3).where("clip = 'long'").collect()
    x = CLIPS["long"]
    for r in rows:
        a, n = r["block"] * 64, min(64, len(x) - r["block"] * 64)
        assert (r["left"], r["own"]) == (min(100, a), n) and r["samples"] == x[max(0, a - 100) : a + n + 3].tolist()
    assert len(rows) == 79
    with pytest.raises(ValueError):
        blocks.neighbourhoods(cut(spark, 64), 64, -1, 0)


@pytest.mark.parametrize("size", [7, 6000])
def test_curves(spark, size):
    rng, rows, expected = np.random.default_rng(size), [], {}
    for c, x in CLIPS.items():
        at = np.unique(rng.uniform(-50, len(x) + 50, {"long": 300, "even": 3, "one": 1, "zeros": 0}.get(c, 20)))
        y = rng.normal(0, 5, len(at))
        rows += [(c, float(p), float(v)) for p, v in zip(at, y)]
        expected[c] = np.interp(np.arange(len(x)), at, y) if len(at) else np.zeros(len(x))
    rows += [("even", None, 1.0), ("even", 3.0, None), ("other", 3.0, 9.0), rows[5]]
    curve = blocks.interpolated(cut(spark, size), spark.createDataFrame(rows, "clip string, position double, value double"), size)
    check(curve, expected)
    check(blocks.with_gain(cut(spark, size), curve), {c: x * 10 ** (-expected[c] / 20) for c, x in CLIPS.items()})


@pytest.mark.parametrize("size,ratio", [(64, 1.3), (64, 0.4), (7, 3.0), (100, 1e6)])
def test_resampling(spark, size, ratio):
    expected = {}
    for c, x in CLIPS.items():
        m = max(1, int(np.round(len(x) / ratio)))
        expected[c] = np.interp(np.linspace(0, len(x) - 1, m), np.arange(len(x)), x)
    out = blocks.resampled(cut(spark, size), size, ratio)
    check(out, expected)
    assert all(len(r["samples"]) == size or r["block"] == max(len(expected[r["clip"]]) - 1, 0) // size for r in out.collect())
    with pytest.raises(ValueError):
        blocks.resampled(out, size, 0)


def denoise(x, frame, depth=9.0):
    """By the definition, frame by frame."""
    hop, n = frame // 2, len(x)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    count = -(-n // hop) + 1
    wide = np.zeros((count + 1) * hop)
    wide[hop : hop + n] = x
    z = np.array([np.fft.rfft(w * wide[k * hop : k * hop + frame]) / w.sum() for k in range(count)])
    level = np.abs(z)
    floor = np.percentile(level, 10, axis=0)
    gain = np.clip((level - 1.5 * floor) / (level + 1e-9), 10 ** (-depth / 20), 1)
    near = [[max(k - 1, 0), k, min(k + 1, count - 1)] for k in range(count)]
    z = z * np.array([gain[k].mean(axis=0) for k in near])
    out, weight = np.zeros(len(wide)), np.zeros(len(wide))
    for k in range(count):
        out[k * hop : k * hop + frame] += w * np.fft.irfft(z[k] * w.sum(), frame)
        weight[k * hop : k * hop + frame] += w * w
    return (out / np.maximum(weight, 1e-10))[hop : hop + n]


@pytest.mark.parametrize("size,frame", [(100, 64), (30, 64), (6000, 256)])
def test_denoising(spark, size, frame):
    check(blocks.denoised(cut(spark, size), size, frame), {c: denoise(x, frame) for c, x in CLIPS.items()})
    floors = {r["clip"]: r["floor"] for r in blocks.noise_floors(cut(spark, size), size, frame).collect()}
    assert set(floors) == set(CLIPS) and all(len(f) == frame // 2 + 1 for f in floors.values())
    with pytest.raises(ValueError):
        blocks.denoised(cut(spark, size), size, 15)


def test_pieces_become_blocks(spark):
    x = CLIPS["long"]
    rows = [("a", k, x[k : k + 37].tolist()) for k in range(0, len(x), 37)] + [("b", 0, [1.0]), ("c", 0, [])]
    pieces = spark.createDataFrame(rows, "clip string, position long, samples array<double>")
    made = blocks.as_blocks(pieces, 500)
    check(made, {"a": x, "b": np.array([1.0])}, 0)
    assert made.count() == 12


def test_odd_blocks(spark):
    rows = [("a", 0, None), ("b", 0, []), ("c", 0, [None, 1.0, None, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("state", F.lit("x"))
    c = np.array([0.0, 1.0, 0.0, 2.0])
    nothing = {"a": np.empty(0), "b": np.empty(0)}
    points = spark.createDataFrame([("a", 0.0, 1.0)], "clip string, position double, value double")
    check(blocks.filtered(df, SECTIONS), nothing | {"c": loop_filter(c)})
    check(blocks.filtered(df.drop("state"), ()).where("clip <> 'c'"), nothing)
    check(blocks.smoothed(df, 0.2, 0.9), nothing | {"c": loop_smooth(c, 0.2, 0.9)})
    check(blocks.sliding_peaks(df, 4, 1), nothing | {"c": np.array([1.0, 1, 2, 2])})
    check(blocks.interpolated(df, points, 4), nothing | {"c": np.zeros(4)})
    check(blocks.resampled(df, 4, 2.0), nothing | {"c": np.interp([0, 3], range(4), c)})
    check(blocks.denoised(df, 4, 4), nothing | {"c": denoise(c, 4)})
    for f in (lambda d: blocks.filtered(d, SECTIONS), lambda d: blocks.smoothed(d, 0.2, 0.9), lambda d: blocks.sliding_peaks(d, 4, 1), lambda d: blocks.resampled(d, 4, 2.0), lambda d: blocks.denoised(d, 4, 4)):
        empty = f(df.limit(0))
        assert empty.count() == 0 and isinstance(empty.schema["samples"].dataType, T.ArrayType) and {"clip", "block", "samples"} == set(empty.columns)


def test_real_filter_over_a_long_clip(spark):
    """The loudness weighting's high-pass, whose poles lie close to 1, over blocks of unlike sizes."""
    from loomwright.operators import mastering

    b, a = mastering._rbj("highpass", 38.13547087602444, 24000, 0.0, 0.5003270373238773)
    s = ((*b.tolist(), *a[1:].tolist()),)
    x = np.random.default_rng(3).normal(0, 0.2, 60_000) + 0.1
    expected = loop_filter(x, s)
    for size in (4096, 50_000):
        check(blocks.filtered(cut(spark, size, {"a": x}), s), {"a": expected})
    assert math.isclose(expected[-1000:].mean(), 0, abs_tol=0.05)
