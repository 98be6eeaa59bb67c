import json
import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import align, mastering, signal
from loomwright.sources import files
from loomwright.streaming import jobs


def test_arrays(spark):
    x = [0.0] * 16 + [0.5, -0.8] * 16 + [0.0] * 16
    df = spark.createDataFrame([(0, x), (1, []), (2, [0.0] * 64)], "i int, pcm array<double>")
    peaks = signal.frame_peaks(F.col("pcm"), F.lit(8))
    rows = {
        r["i"]: r
        for r in df.select(
            "i", signal.peak(F.col("pcm")).alias("peak"), signal.mean_square(F.col("pcm")).alias("ms"), peaks.alias("p"),
            signal.trim_bounds(peaks, F.size("pcm"), F.lit(8), F.lit(100), margin=0.02).alias("cut"), signal.fade(F.col("pcm"), F.lit(8)).alias("f"),
        ).collect()
    }
    assert rows[0]["peak"] == 0.8 and rows[1]["peak"] == 0 and rows[1]["ms"] == 0
    assert rows[0]["p"] == [0, 0, 0.8, 0.8, 0.8, 0.8, 0, 0]
    assert tuple(rows[0]["cut"]) == (14, 50) and tuple(rows[1]["cut"]) == (0, 0) and tuple(rows[2]["cut"]) == (0, 64)
    assert len(rows[0]["f"]) == 64 and rows[1]["f"] == []


def test_findings(spark):
    rate = 16000
    t = np.arange(rate * 10) / rate
    voice = (0.4 * np.sin(2 * np.pi * 200 * t) * (np.sin(2 * np.pi * 0.5 * t) > 0)).tolist()
    df = spark.createDataFrame([(0, voice, rate), (1, [0.0] * 100, 8000)], "i int, pcm array<double>, rate int")
    got = {r["i"]: [tuple(f) for f in r["findings"]] for r in signal.voice_findings(df).collect()}
    assert ("ok", "duration") in got[0] and ("warning", "pauses") in got[0]
    assert got[1] == [("error", "too short"), ("warning", "low rate"), ("error", "silent")]


def test_mastering():
    rate = 24000
    t = np.arange(rate * 2) / rate
    x = 0.2 * np.sin(2 * np.pi * 150 * t) * (0.6 + 0.4 * np.sin(2 * np.pi * t))
    for mode in mastering.MODES[1:]:
        y = mastering.master(x, rate, mode)
        assert len(y) == len(x) and np.abs(y).max() <= 10 ** (-1.5 / 20) + 1e-9 and abs(mastering.loudness(y, rate) + 16) < 0.5
    assert np.isclose(np.abs(mastering.master(x, rate, "tat")).max(), 10 ** (-1.5 / 20))
    tone = np.sin(2 * np.pi * 997 * np.arange(96000) / 48000)
    assert abs(mastering.loudness(tone, 48000) + 3.01) < 0.4
    high = [("highpass", 80.0, rate, 0.0, q) for q in (0.5412, 1.3066)]
    level = lambda f: 20 * math.log10(math.sqrt(2 * np.mean(mastering.filtered(np.sin(2 * np.pi * f * t), *high)[rate:] ** 2)))
    assert level(45) < -17 and abs(level(140)) < 0.5
    assert abs(len(mastering.stretch(x, rate, 1.5)) - len(x) / 1.5) < 2 and len(mastering.shift_pitch(x, rate, 2)) == len(x)
    spectrum, _ = mastering._frames(x)
    assert np.allclose(mastering._unframe(spectrum, len(x)), x, atol=1e-9)


@pytest.mark.parametrize("few", [0, 10**9])
@pytest.mark.parametrize("small", [align.SMALL, 0])
def test_align_equals_whole_table(small, few, monkeypatch):
    """Any shape, against the plain table, ties and empty words included."""
    import random

    monkeypatch.setattr(align, "SMALL", small)
    monkeypatch.setattr(align, "FEW_CELLS", few)
    random.seed(8)

    def slow(a, b):
        s = lambda x, y: 2.0 if x and x == y else 0.6 if x and y and x[:3] == y[:3] else -1.2
        t = [[-1.0 * (i + j) if not i or not j else 0.0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = max(t[i - 1][j - 1] + s(a[i - 1], b[j - 1]), t[i - 1][j] - 1.0, t[i][j - 1] - 1.0)
        got, i, j = [-1] * len(a), len(a), len(b)
        while i and j:
            if t[i][j] == t[i - 1][j - 1] + s(a[i - 1], b[j - 1]):
                i, j = i - 1, j - 1
                got[i] = j if s(a[i], b[j]) > 0 else -1
            elif t[i][j] == t[i - 1][j] - 1.0:
                i -= 1
            else:
                j -= 1
        return got

    words = ["", "a", "b", "abcd", "abce", "abcf", "x", "yy"]
    for _ in range(400):
        a, b = ([random.choice(words) for _ in range(random.randint(0, 30))] for _ in "ab")
        assert align.align(a, b) == slow(a, b), (a, b)


def test_align_long_segments():
    """More than 4,000,000 cells: one word in ten isn't heard, and every other one finds its place."""
    a = [f"{k:04d}" for k in range(3000)]
    b = [w for k, w in enumerate(a) if k % 10]
    got = align.align(a, b)
    assert len(a) * len(b) > 4_000_000 and sum(g >= 0 and b[g] == x for x, g in zip(a, got)) == len(b)


def test_align():
    assert align.align(["a", "b", "c"], ["a", "c"]) == [0, -1, 1]
    assert align.align(["hello"], ["help"]) == [0] and align.align(["x"], ["y"]) == [-1]
    assert align.align([], ["a"]) == [] and align.align(["a"], []) == [-1]


def test_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/a_b.txt", "w", encoding="utf-8-sig") as f:
        f.write("x y\r\nz")
    with open(f"{folder}/c.json", "w") as f:
        json.dump({"kenh": {"terco": {"model": "english", "voice": None}}}, f)
    assert [(r["file_name"], r["text"]) for r in files.read_texts(spark, folder).collect()] == [("a_b.txt", "x y\nz")]
    assert [(r["channel"], r["settings"]) for r in files.read_channels(spark, f"{folder}/c.json").collect()] == [("TERCO", {"model": "english", "voice": None})]
    df = spark.createDataFrame([([0.5, -2.0, float("nan")], 8000)], "pcm array<double>, rate int")
    with open(f"{folder}/v.wav", "wb") as f:
        f.write(df.select(files.wav_bytes(F.col("pcm"), F.col("rate"))).first()[0])
    row = files.read_wav(spark, folder).first()
    assert row["rate"] == 8000 and row["error"] is None and np.allclose(row["pcm"], [16383 / 32768, -32767 / 32768, 0])
    with open(f"{folder}/bad.wav", "wb") as f:
        f.write(b"RIFF?")
    bad = files.read_wav(spark, folder).where("path LIKE '%bad.wav'").first()
    assert bad["error"] and bad["pcm"] is None and bad["rate"] is None
    nulls = spark.createDataFrame([(None, 8000), ([0.5], None)], "pcm array<double>, rate int")
    assert [r[0] for r in nulls.select(files.wav_bytes(F.col("pcm"), F.col("rate"))).collect()] == [None, None]


def test_aligned_times_of_nulls(spark):
    rows = [(1, 0, None, None, ["a"], [0.0], [1.0]), (1, 1, ["A", None], ["a", None], None, None, None), (1, 2, ["A", "B"], ["a", None], ["a"], [0.5], [1.5]), (None, None, ["A"], ["a"], ["a"], [None], [2.0])]
    df = spark.createDataFrame(rows, "script_id long, seq int, words array<string>, norms array<string>, heard array<string>, t0 array<double>, t1 array<double>")
    got = sorted(map(tuple, align.aligned_times(df).collect()), key=str)
    assert got == sorted([(1, 1, 0, "A", None, None), (1, 1, 1, None, None, None), (1, 2, 0, "A", 0.5, 1.5), (1, 2, 1, "B", None, None), (None, None, 0, "A", None, 2.0)], key=str)


def test_streams(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    calls = [(1, 0, 0.0, "quota", 50.0), (1, 1, 1.0, "ok", 0.0)], [(1, 2, 2.0, "ok", 0.0), (1, 3, 60.0, "ok", 0.0)]
    schema = "ring long, call long, at double, outcome string, wait_s double"
    for k, rows in enumerate(calls):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = jobs.key_ring_stream(stream, keys=2).writeStream.format("memory").queryName("ring").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["call"]: r["key"] for r in spark.table("ring").collect()}
    assert got[0] == 0 and got[1] == 1 and len(got) == 4
