"""WAV files and file sinks, kept results, recognizers, tracked jobs, model shares."""

import tempfile
import datetime
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import channels, recognize, timeline
from loomwright.sources import results, sinks, wav
from loomwright.streaming import progress


def riff(data, tag=1, channels=1, rate=8000, bits=16, before=b"", claims=None, extensible=False):
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if extensible:
        form += struct.pack("<HHIH14s", 22, bits, 0, tag, b"\0" * 14)
    body = b"WAVE" + before + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data) if claims is None else claims) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


X = np.array([0.0, 0.5, -0.5, 0.25, -1.0, 0.125])
GOOD = {
    "a16.wav": riff((X * 32768).astype("<i2").tobytes()),
    "b8.WAV": riff((X * 128 + 128).astype("u1").tobytes(), bits=8),
    "sub/c24.wav": riff(b"".join(struct.pack("<i", int(x * (1 << 23)))[:3] for x in X), bits=24),
    "d32.wav": riff((X * (1 << 31)).astype("<i4").tobytes(), bits=32),
    "f32.wav": riff(X.astype("<f4").tobytes(), tag=3, bits=32),
    "f64.wav": riff(X.astype("<f8").tobytes(), tag=3, bits=64, extensible=True),
    "odd.wav": riff((X * 32768).astype("<i2").tobytes(), before=b"LIST\x03\0\0\0abc\0"),
    "open.wav": riff((X * 32768).astype("<i2").tobytes(), claims=0xFFFFFFFF),
    "two.wav": riff(np.repeat(X * 32768, 2).astype("<i2").tobytes(), channels=2),
    "none.wav": riff(b""),
}
BAD = {"x1.wav": b"", "x2.wav": b"hello world, no sound", "x3.wav": riff(b"", tag=2, bits=4), "x4.wav": riff(b"")[:36], "x5.wav": riff(b"\0" * 4, channels=0)}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("wav")
    for name, content in {**GOOD, **BAD, "other.txt": b"x", "_writing-1/y.wav": GOOD["a16.wav"]}.items():
        os.makedirs(os.path.dirname(root / name), exist_ok=True)
        (root / name).write_bytes(content)
    return str(root)


def test_headers(spark, folder):
    wav.register(spark)
    rows = {os.path.relpath(r["path"], folder): r for r in spark.read.format("wav").load(f"file://{folder}").collect()}
    assert set(rows) == {*GOOD, *BAD}
    for name, r in rows.items():
        assert r["bytes"] == len({**GOOD, **BAD}[name])
        if name in BAD:
            assert r["error"] and r["n_samples"] is None and r["seconds"] is None
        else:
            n = 0 if name == "none.wav" else 6
            assert (r["error"], r["n_samples"], r["seconds"], r["rate"]) == (None, n, n / 8000, 8000)
    assert rows["two.wav"]["channels"] == 2 and rows["f64.wav"]["encoding"] == "float" and rows["sub/c24.wav"]["bits"] == 24


def test_durations_touch_headers_only():
    content = riff(b"\0" * 10_000_000, before=b"LIST" + struct.pack("<I", 5_000_000) + b"\0" * 5_000_000)
    read = []

    def read_at(at, n):
        read.append(n)
        return content[at : at + n]

    h = wav.read_header(read_at, len(content))
    assert h.n_samples == 5_000_000 and sum(read) < 100


def test_samples_in_blocks(spark, folder, monkeypatch):
    wav.register(spark)
    for size in (4, 100):
        got = {}
        for r in sorted(spark.read.format("wav").option("block", size).load(folder).collect(), key=lambda r: r["block"] or 0):
            name = os.path.relpath(r["clip"], folder)
            if r["error"]:
                assert name in BAD and r["samples"] is None
                got[name] = None
            else:
                assert len(r["samples"]) == min(size, 6 - size * r["block"])
                got.setdefault(name, []).extend(r["samples"])
        assert set(got) == {*GOOD, *BAD} - {"none.wav"}
        assert all(np.allclose(v, X, atol=1e-7) for v in got.values() if v is not None)
    monkeypatch.setattr(wav, "TASK_BYTES", 20)
    reader = wav.WavReader(folder, None, 4)
    parts = reader.partitions()
    assert len(parts) > len(GOOD) and all(len(p.parts) == 1 for p in parts if p.parts[0][2] - p.parts[0][1] < 8 and p.parts[0][1])
    with pytest.raises(Exception, match="one sample"):
        spark.read.format("wav").option("block", 0).load(folder).count()


def test_written_files(spark, tmp_path):
    out = f"{tmp_path}/out"
    x = np.random.default_rng(1).uniform(-1.2, 1.2, 1000)
    x[5], x[6] = np.nan, np.inf
    rows = [("long", k, x[k * 100 : k * 100 + 100].tolist()) for k in range(10)] + [("dir/b", 0, [0.5, None]), ("empty", 0, [])]
    blocks = spark.createDataFrame(rows, "clip string, block int, samples array<double>").repartition(4)
    wav.write(blocks, out, rate=1000)
    expected = (np.clip(np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0), -1, 1) * 32767).astype("<i2").tobytes()
    assert (tmp_path / "out/long.wav").read_bytes() == riff(expected, rate=1000)
    assert (tmp_path / "out/dir/b.wav").read_bytes() == riff(struct.pack("<hh", 16383, 0), rate=1000)
    assert (tmp_path / "out/empty.wav").read_bytes() == riff(b"", rate=1000)
    assert sorted(os.listdir(out)) == ["dir", "empty.wav", "long.wav"]
    with pytest.raises(Exception, match="FileExists|exists"):
        wav.write(blocks, out, rate=1000)
    wav.write(blocks.where("clip = 'empty'"), out, rate=2000, overwrite=True)
    assert (tmp_path / "out/empty.wav").read_bytes() == riff(b"", rate=2000) and len(os.listdir(out)) == 3


def test_failed_writes_leave_nothing(spark, tmp_path):
    wav.register(spark)
    out = tmp_path / "out"
    fails = F.udf(lambda k: "x" if k < 90 else 1 // 0, "string")
    rows = spark.range(100).repartition(5).select(F.concat(F.lit("f"), "id").alias("name"), fails("id").alias("content"))
    for bad in (rows, spark.createDataFrame([("a", "1"), ("a", "2")], "name string, content string"), spark.createDataFrame([("../a", "1")], "name string, content string"), spark.createDataFrame([(None, "1")], "name string, content string")):
        with pytest.raises(Exception):
            bad.write.format("named_files").mode("append").save(str(out))
        assert not out.exists() or os.listdir(out) == []
    ok = spark.createDataFrame([("a.txt", "é"), ("s/b.txt", None)], "name string, content string")
    ok.write.format("named_files").mode("append").save(str(out))
    assert (out / "a.txt").read_text() == "é" and (out / "s/b.txt").read_bytes() == b"" and sorted(os.listdir(out)) == ["a.txt", "s"]
    with pytest.raises(Exception, match="columns"):
        ok.select("name").write.format("named_files").mode("append").save(str(out))
    # an attempt that Spark doesn't accept: its files go with the job's folder
    sink = sinks._NamedFiles(str(out), False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"name": ["c"], "content": [b"1"]})
    lost, kept = sink.write(iter([batch])), sink.write(iter([batch]))
    assert lost.files != kept.files
    sink.commit([kept, None])
    assert sorted(os.listdir(out)) == ["a.txt", "c", "s"]


def test_results_are_kept(spark, tmp_path):
    store = results.ResultStore(spark, str(tmp_path / "store"), "n int")
    done = spark.sparkContext.accumulator(0)

    def compute(rows):
        def size(text):
            done.add(1)
            return None if text is None else len(text)

        return rows.select("key", F.udf(size, "int")("text").alias("n"))

    def run(rows, settings=None):
        before = done.value
        df = spark.createDataFrame(rows, "id int, text string, name string")
        out = store.computed(df, compute, ["text"], settings or {"a": 1}, F.col("name"))
        got = sorted((r["id"], r["n"]) for r in out.collect())
        return got, done.value - before

    rows = [(1, "one", "v_1"), (2, "three", "v_2"), (3, "one", "w_1"), (4, None, "w_2"), (5, "", "w_3")]
    expected = [(1, 3), (2, 5), (3, 3), (4, None), (5, 0)]
    assert run(rows) == (expected, 4)  # equal contents once
    assert run(rows) == (expected, 0) and len(store.runs()) == 1
    assert run([*rows[:1], (2, "changed", "v_2"), *rows[2:]]) == ([(1, 3), (2, 7), *expected[2:]], 1)
    assert run(rows, {"a": 2})[1] == 4  # other settings, other results
    n = store.read().count()
    assert store.evict("v_") == 5 and store.read().count() == n - 5 and store.evict("v_") == 0 and len(store.runs()) == 1
    assert run(rows)[1] == 2
    with pytest.raises(Exception):
        store.computed(spark.createDataFrame([(9, "new", "x")], "id int, text string, name string"), lambda r: r.select("key", (F.raise_error("no")).cast("int").alias("n")), ["text"], {"a": 1})
    assert store.read().where("name = 'x'").count() == 0
    assert store.computed(spark.createDataFrame([], "id int, text string, name string"), compute, ["text"], {}).count() == 0
    # runs at once that append the same keys count once
    store.read().write.parquet(f"{store.path}/run-00000099-x")
    assert store.read().count() == store.read().dropDuplicates(["key"]).count()


def test_keys_tell_contents_apart(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("n", "ab"), (None, None), ("v1:a", None)]
    df = spark.createDataFrame(rows, "x string, y string").select(results.content_key(["x", "y"], {}).alias("k"))
    assert df.distinct().count() == len(rows)


SCHEMA = "clip string, block int, samples array<double>"


def test_recognizers(spark):
    class Fails(recognize.Recognizer):
        def __init__(self):
            self.sum = 0.0

        def feed(self, samples):
            self.sum += samples.sum()
            if self.sum > 100:
                raise RuntimeError("too loud")

        def words(self):
            return [(" said ", 0, 10), ("  ", 1, 2), ("again", 10, 24)] if self.sum < 50 else [("broken",)]

    rows = [("a", k, [0.1] * 10) for k in range(5)] + [("loud", 0, [60.0]), ("loud", 1, [60.0]), ("broken", 0, [70.0]), (None, 0, None)]
    blocks = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert recognize.recognized(blocks).count() == 0
    got = sorted(map(tuple, recognize.recognized(blocks, Fails, rate=10).collect()), key=str)
    assert got == sorted([(c, *w) for c in ("a", None) for w in ((0, "said", 0.0, 1.0), (1, "again", 1.0, 2.4))], key=str)


def test_without_a_recognizer_times_follow_from_the_text(spark):
    spans = spark.createDataFrame([("s", 0, "two words", 1.0, 2.0), ("s", 1, "one", 2.5, 3.0)], "script_id string, seq int, text string, t0 double, t1 double")
    words = timeline.word_times(spans)
    blocks = spark.createDataFrame([("s", 0, [0.0] * 10)], SCHEMA)
    heard = recognize.recognized(blocks).withColumnRenamed("clip", "script_id")
    known = words.drop("t0", "t1").join(heard.select("script_id", "word", "t0", "t1"), ["script_id", "word"], "left").join(spans.select("script_id", "seq", F.col("t0").alias("a"), F.col("t1").alias("b")), ["script_id", "seq"])
    filled = timeline.fill_times(known).select("script_id", "seq", "pos", "t0", "t1")
    near = lambda df: [(*r[:3], round(r[3], 9), round(r[4], 9)) for r in sorted(map(tuple, df.collect()))]
    assert near(filled) == near(words.select("script_id", "seq", "pos", "t0", "t1"))


@pytest.mark.parametrize("size,gap", [(1, 0), (7, 0), (7, 3), (1000, 2)])
def test_loud_stretches_cross_blocks(size, gap):
    x = np.random.default_rng(size).normal(0, 1, 500)
    r = recognize.LoudStretches(0.8, gap)
    for k in range(0, 500, size):
        r.feed(x[k : k + size])
    loud, expected = np.flatnonzero(np.abs(x) > 0.8).tolist(), []
    for k in loud:
        if expected and k - expected[-1][1] <= gap:
            expected[-1][1] = k + 1
        else:
            expected.append([k, k + 1])
    assert [[a, b] for _, a, b in r.words()] == expected


EVENTS = "job long, ts timestamp, event long, state string, k int, n int"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def test_legal_and_illegal_steps():
    step = lambda held, t, state, k=None, n=None: progress.advanced(held, t, t, state, k, n, 100)
    held, out = step(None, 0, "done")
    assert held is None and out[0][-1] == "refused"
    held, _ = step(None, 0, "waiting")
    assert step(held, 1, "done")[1][0][-1] == "refused"
    held, _ = step(held, 10, "running", 2, 5)
    assert step(held, 11, "running", 1, 5)[1][0][-1] == "refused" and step(held, 9, "done")[1][0][-1] == "refused"
    assert step(held, 11, "running", None, 5)[1][0][-1] == "refused" and step(held, 11, "nonsense")[1][0][-1] == "refused"
    end, out = step(held, 20, "done")
    assert end is None and out == [(20, 20, "done", 2, 5, "accepted")]
    again, out = step(held, 111, "running", 1, 3)
    assert [r[-1] for r in out] == ["no news", "accepted"] and out[0][:5] == (110, 10, "failed", 2, 5) and again == ("running", 1, 3, 111, 111)


def test_streams_and_tables_agree(spark, tmp_path):
    """Late events, missing ones, and jobs that are given up by a timer."""
    batches = [
        [(1, at(0), 1, "waiting", None, None), (1, at(1), 2, "running", 1, 3), (2, at(2), 3, "running", 0, 2), (3, at(3), 4, "waiting", None, None)],
        [(1, at(20), 5, "running", 0, 3), (1, at(21), 6, "running", 3, 3), (2, at(22), 7, "failed", None, None), (4, at(23), 8, "done", None, None)],
        [(1, at(30), 9, "done", None, None), (2, at(35), 11, "waiting", None, None)],
        [(9, at(300), 12, "waiting", None, None)],
        [(9, at(320), 13, "running", 1, 1), (3, at(2), 10, "running", 1, 9), (2, at(310), 14, "done", None, None)],  # the second is late
        [(9, at(340), 15, "done", None, None)],
    ]
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/b{k}")
        part = next(f for f in os.listdir(tmp_path / f"b{k}") if f.endswith(".parquet"))
        os.makedirs(folder, exist_ok=True)
        os.rename(tmp_path / f"b{k}" / part, folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (k + 1, k + 1))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
        query = progress.tracked_stream(stream, 3600, "10 minutes").writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        got = sorted(map(str, spark.table("tracked").collect()))
    finally:
        spark.conf.unset(provider)
    kept = [r for b in batches for r in b if r[2] != 10]
    table = progress.tracked(spark.createDataFrame(kept, EVENTS), 3600)
    assert got == sorted(map(str, table.collect()))
    notes = {(r["job"], r["event"]): r["note"] for r in table.collect()}
    assert notes[(3, 4)] == "no news" and notes[(2, 11)] == "no news" and notes[(2, 14)] == "refused" and notes[(1, 5)] == "refused" and notes[(1, 9)] == "accepted"


def test_tracked_odd_tables(spark):
    rows = [(None, at(0), 1, "waiting", None, None), (1, None, 2, "waiting", None, None), (1, at(0), None, None, None, None), (1, at(0), 3, "waiting", None, None), (1, at(0), 3, "waiting", None, None)]
    got = progress.tracked(spark.createDataFrame(rows, EVENTS), 60).collect()
    assert sorted((r["event"] or 0, r["note"]) for r in got) == [(0, "refused"), (3, "accepted"), (3, "refused")]
    assert progress.tracked(spark.createDataFrame([], EVENTS), 60).count() == 0


def test_models_are_loaded_few_times(spark):
    rng = np.random.default_rng(4)
    rows = [("big" if k % 3 == 0 else f"m{k % 40:02d}", f"item{k}", float(rng.integers(1, 20))) for k in range(6000)] + [(None, "x", None), ("free", "y", -5.0)]
    items = spark.createDataFrame(rows, "model string, name string, cost double")
    out = channels.packed_by_model(items, 8)
    assert out.count() == len(rows) and out.columns == [*items.columns, "part"]
    got = out.withColumn("at", F.spark_partition_id()).collect()
    assert all(r["at"] == r["part"] for r in got)
    costs = [sum(max(r["cost"] or 0, 0) for r in got if r["part"] == p) for p in range(8)]
    assert max(costs) < 1.1 * np.mean(costs)
    loads = {(r["model"], r["part"]) for r in got}
    assert len(loads) <= len({r[0] for r in rows}) + 8 - 1 and len([1 for m, _ in loads if m == "big"]) >= 3
    assert channels.packed_by_model(items.limit(0), 8).count() == 0
    none = channels.packed_by_model(items.withColumn("cost", F.lit(0)), 4).select("part").distinct().collect()
    assert [r[0] for r in none] == [0]


def test_commit_messages_are_short():
    """What tasks send to the driver is little more than the names of their files."""
    import pickle
    from types import SimpleNamespace

    from loomwright.sources import sinks

    with tempfile.TemporaryDirectory(dir="/tmp") as folder:
        sink = sinks._NamedFiles(folder, False)
        sink.files = lambda rows: ((f"s/U{k}.txt", iter([b"x"])) for k in range(500))
        sent = sink.write(iter([]))
        assert len(pickle.dumps(sent)) < 30 * 500
        sink.commit([sent, None])
        assert len(os.listdir(f"{folder}/s")) == 500 and os.listdir(folder) == ["s"]


def test_queue_is_listed_by_few_tasks(spark):
    """Files of a batch aren't looked up in a task each; the session's setting stays."""
    from loomwright.streaming import jobs

    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with tempfile.TemporaryDirectory(dir="/tmp") as folder:
        os.makedirs(f"{folder}/in")
        for k in range(120):
            with open(f"{folder}/in/{k}.txt", "w") as f:
                f.write(f"a\n{k}")
        stream = jobs.write_available(jobs.script_queue(spark, f"{folder}/in"), f"{folder}/out")
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(stream.runId)) for s in tracker.getJobInfo(j).stageIds]
        assert stages and max(s.numTasks for s in stages if s) <= spark.sparkContext.defaultParallelism
        assert {tuple(r) for r in spark.read.parquet(f"{folder}/out").select("file_name", "text").collect()} == {(f"{k}.txt", f"a\n{k}") for k in range(120)}
    assert spark.conf.get(name) == before


def test_short_blocks_come_in_common_batches(spark):
    """Blocks of many small files aren't handed on one by one, and are what was written."""
    import numpy as np
    from pyspark.sql.types import StructType

    from loomwright.sources import wav

    rng = np.random.default_rng(1)
    clips = {f"c{k}": [rng.uniform(-1.2, 1.2, rng.integers(0, 9)).tolist() if (k + b) % 5 else None for b in range(7)] for k in range(30)}
    rows = spark.createDataFrame([(c, b, x) for c, bs in clips.items() for b, x in enumerate(bs)], "clip string, block int, samples array<double>")
    with tempfile.TemporaryDirectory(dir="/tmp") as folder:
        wav.write(rows, folder, rate=8000)
        reader = wav.WavReader(folder, StructType.fromDDL(wav.BLOCKS), 4)
        batches = [b for p in reader.partitions() for b in reader.read(p)]
        assert len(batches) == 1
        got = {}
        for r in batches[0].to_pylist():
            got.setdefault(os.path.basename(r["clip"])[:-4], []).extend(r["samples"])
    for c, bs in clips.items():
        assert got.get(c, []) == [int(max(-1.0, min(1.0, v)) * 32767) / 32768 for x in bs for v in x or ()], c


def test_wav_query_sums_whole_numbers(spark):
    from loomwright.plans import job_queries

    plan = job_queries.s7_wav_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and "rint(" in plan.lower()
