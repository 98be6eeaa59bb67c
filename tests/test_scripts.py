"""Segmentation, timelines and subtitles against traced expectations."""

import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.operators import segment, timeline

SELF_TEST = """# comment
[INTRO]
Hello there.
This is line two of the same paragraph. Mr. Smith paid 3.5 million dollars.

New paragraph after a blank line.
---

Block three ends with an explicit pause.
[nghi=2.5]
Final block here.
"""


def scripts(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "script_id long, text string")


def pauses(spark, text, **kw):
    rows = segment.segments(scripts(spark, text), segment.Pauses(**kw)).orderBy("seq").collect()
    return [(r["text"], r["pause"]) for r in rows]


def test_self_test_script(spark):
    rows = timeline.timeline(segment.segments(scripts(spark, SELF_TEST))).orderBy("seq").collect()
    assert [(r["text"], r["pause"], r["s0"], r["s1"]) for r in rows] == [
        ("Hello there.", 0.30, 0, 19200),
        ("This is line two of the same paragraph.", 0.30, 26400, 88800),
        ("Mr. Smith paid 3.5 million dollars.", 0.85, 96000, 152000),
        ("New paragraph after a blank line.", 1.60, 172400, 225200),
        ("Block three ends with an explicit pause.", 2.50, 263600, 327600),
        ("Final block here.", 0.50, 387600, 414800),
    ]
    spans = timeline.timeline(segment.segments(scripts(spark, SELF_TEST))).withColumns({"t0": F.col("s0") / 24000, "t1": F.col("s1") / 24000})
    srt = timeline.srt(timeline.cues(spans)).first()["srt"]
    assert srt.startswith("1\n00:00:00,000 --> 00:00:00,900\nHello there.\n\n2\n00:00:01,100 --> 00:00:03,700\n")
    assert "00:00:16,150 --> 00:00:17,283" in srt


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("A bb.\n[nghi=0.2]\n\nC dd.", [0.85, 0.5]),
        ('Um dois.<break time="1s"/><break time="2s"/> Tres quatro.', [2.0, 0.5]),
        ('Um dois. <break time="99s"/> Tres quatro.', [30.0, 0.5]),
        ("Um dois. <break/> Tres quatro.", [0.5, 0.5]),
        ('Um dois.\n\n<break time="2500ms"/>\n\nTres quatro.', [2.5, 0.5]),
        ("", []),
        ("# only\n\n---", []),
    ],
)
def test_pauses(spark, text, expected):
    assert [p for _, p in pauses(spark, text)] == pytest.approx(expected)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Level 1. Junior. Level 12. Junior.", ["Level 1. Junior.", "Level 12.", "Junior."]),
        ("Section 12. 500 items", ["Section 12. 500 items"]),
        ("Go! ... Then we left.", ["Go!", "... Then we left."]),
        ("He said \"Stop.\" Then left.", ['He said "Stop."', "Then left."]),
        ("In the U.S. it costs $85,000. Fine", ["In the U.S. it costs $85,000.", "Fine"]),
        ("Wait... what? Yes", ["Wait... what?", "Yes"]),
        ("   ", []),
    ],
)
def test_sentences(text, expected):
    assert X.sentences_of(text) == expected


def test_columns(spark):
    row = spark.range(1).select(
        X.srt_time(F.lit(59.9996)).alias("carry"),
        X.srt_time(F.lit(-1.0)).alias("zero"),
        X.slug(F.lit("Flat vector stickman illustration of a junior accountant at work")).alias("slug"),
        X.slug(F.lit("!!!")).alias("none"),
        X.channel_key(F.lit("terco1_beat.txt")).alias("key"),
        X.image_channel_key(F.lit("loi_TERCO1_beat.txt")).alias("retry"),
        X.normalize_word(F.lit("Ação!")).alias("word"),
        X.wrap_line(F.lit("one two three four five six seven eight nine ten")).alias("wrapped"),
        X.pause_seconds(F.lit("[NGHỈ 2,5 s]")).alias("pause"),
        X.output_name(F.lit(1234), F.lit("a b")).alias("name"),
    ).first()
    assert row["carry"] == "00:01:00,000" and row["zero"] == "00:00:00,000"
    assert row["slug"] == "flat_vector_stickman_illustration_of_a" and row["none"] == "anh"
    assert row["key"] == "TERCO1" and row["retry"] == "TERCO1" and row["word"] == "acao"
    assert row["wrapped"].count("\n") == 1 and row["pause"] == 2.5 and row["name"] == "1234_a_b.png"


def test_cue_invariants(spark):
    text = "word, " * 60 + "end. Short one."
    spans = timeline.timeline(segment.segments(scripts(spark, text))).withColumns({"t0": F.col("s0") / 24000, "t1": F.col("s1") / 24000})
    rows = timeline.cues(spans).orderBy("cue_no").collect()
    assert " ".join(r["text"].replace("\n", " ") for r in rows) == " ".join(text.split())
    assert all(r["t1"] > r["t0"] for r in rows)
    assert all(a["t1"] <= b["t0"] + 1e-9 for a, b in zip(rows, rows[1:]))


def test_fill_times(spark):
    rows = [(0, 1, 0, "ab", None, None), (0, 1, 1, "cd", 1.0, 2.0), (0, 1, 2, "a", None, None), (0, 1, 3, "bcd", None, None)]
    df = spark.createDataFrame(rows, "script_id long, seq int, pos int, word string, t0 double, t1 double").withColumns({"a": F.lit(0.0), "b": F.lit(4.0)})
    got = [x for r in timeline.fill_times(df).orderBy("pos").collect() for x in (r["t0"], r["t1"])]
    assert got == pytest.approx([0.0, 1.0, 1.0, 2.0, 2.0, 2.5, 2.5, 4.0])


def test_interval_join_has_each_pair_once(spark):
    left = spark.createDataFrame([(i, i * 0.7, i * 0.7 + (i % 5)) for i in range(60)], "l long, a0 double, a1 double")
    right = spark.createDataFrame([(i, i * 0.5, i * 0.5 + (i % 3)) for i in range(60)], "r long, b0 double, b1 double")
    got = sorted((x["l"], x["r"]) for x in timeline.interval_join(left, right, [], ("a0", "a1"), ("b0", "b1"), 1.5).collect())
    a, b = left.collect(), right.collect()
    assert got == sorted((x["l"], y["r"]) for x in a for y in b if x["a1"] > y["b0"] and x["a0"] < y["b1"])


def test_interval_join_of_spans_of_unlike_lengths(spark):
    import random

    rng = random.Random(1)

    def spans(name, p):
        rows = []
        for k in range(150):
            lo = rng.uniform(-1e4, 1e4) if k % 5 else float(rng.randrange(-20, 20))
            rows.append((k, k % 3 if k % 11 else None, lo, lo + rng.choice((0.0, 1.0, -2.0, 3.7, 64.0, 1e3, 1e6))))
        rows += [(900, 1, None, 5.0), (901, 1, 0.0, None), (902, 1, -1e9, 1e9)]
        return spark.createDataFrame(rows, f"{name} long, g long, {p}0 double, {p}1 double")

    left, right = spans("l", "a"), spans("r", "b")
    joined = timeline.interval_join(left, right, ["g"], ("a0", "a1"), ("b0", "b1"), 2.0)
    assert set(joined.columns) == {"g", "l", "a0", "a1", "r", "b0", "b1"}
    got = sorted((x["l"], x["r"]) for x in joined.collect())
    a, b = left.where("a0 + a1 + g IS NOT NULL").collect(), right.where("b0 + b1 + g IS NOT NULL").collect()
    assert got == sorted((x["l"], y["r"]) for x in a for y in b if x["g"] == y["g"] and x["a1"] > y["b0"] and x["a0"] < y["b1"])
    assert timeline.interval_join(left.limit(0), right, ["g"], ("a0", "a1"), ("b0", "b1"), 2.0).count() == 0
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_null_pauses_and_ties(spark):
    from loomwright.operators import timeline
    from loomwright.streaming import jobs

    rows = [(1, k, "x" * 30, None if k == 2 else 0.5) for k in range(1, 4)]
    got = timeline.timeline(spark.createDataFrame(rows, "script_id long, seq int, text string, pause double")).orderBy("seq").collect()
    assert [(r["s0"], r["s1"]) for r in got] == [(0, 48000), (60000, 108000), (108000, 156000)]
    import datetime

    at = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([("a", at, 2, "done"), ("a", at, 1, "running"), ("b", at, 1, "waiting")], "job string, ts timestamp, event int, state string")
    assert {r["job"]: r["state"] for r in jobs.latest_states(events).collect()} == {"a": "done", "b": "waiting"} == {r["job"]: r["state"] for r in jobs.job_states(events).collect()}


def test_sentences_token_by_token():
    """Against a plain walk over all tokens."""
    import random

    from loomwright.functions import text as X

    def walk(text):
        out, held, word, tokens = [], [], "", text.split()
        for k, token in enumerate(tokens):
            held.append(token)
            body = token.rstrip(".!?…\"'”’)]")
            pieces = [p for p in X._OPENERS.split(body) if p]
            word = pieces[-1] if pieces else word
            end = X._END.search(token)
            if end:
                last, after = X._base(word), tokens[k + 1] if k + 1 < len(tokens) else ""
                small = len(last) <= 1 or last in X.ABBREVIATIONS or after[:1].islower() or (last.isdigit() and after[:1].isdigit())
                if any(c in "!?" for c in end[1]) or not small:
                    out.append(" ".join(held))
                    held, word = [], ""
        return [*out, " ".join(held)] if held else out

    random.seed(3)
    parts = ["Mr", "Level", "12", "1", "word", "Été", "(no", "a.b", '"Yes', ".", "...", "!", "?!", "…", ")", '."', "”", " ", " ", "  ", "\n", "\u00a0", "U.S", "é"]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 25)))
        assert X.sentences_of(text) == walk(text), text


def test_cues_of_a_long_segment(spark):
    """Twenty thousand words in one segment, against a plain loop; null times and words among them."""
    import random

    rng = random.Random(2)
    words, t = [], 0.0
    for k in range(20_000):
        t += rng.choice((0.0, 0.1, 0.3, 2.0, 6.5))
        words.append((k, rng.choice(("a", "wordy", "x" * 30, "clause,", "y" * 60 + ";", None)), t if k % 50 else None, t + rng.choice((0.0, 0.02, 0.4)) if k % 70 else None))
    end = t - 5.0
    cues, now, at = [], [], 0.0
    for _, word, t0, t1 in words:
        word = word or ""
        start = min(max(t0 if t0 is not None else at, at), end)
        at = min(max(t1 if t1 is not None else start + 0.05, start + 0.05), end)
        size = sum(len(w) + 1 for w, *_ in now) + len(word)
        if now and (size > 84 or at - now[0][1] > 6.0):
            cues.append(now)
            now = []
        now.append((word, start, at))
        if size > 84 * 0.6 and word[-1:] in (",", ";"):
            cues.append(now)
            now = []
    cues += [now] if now else []
    spans = spark.createDataFrame([("s", 0, 0.0, end)], "script_id string, seq int, t0 double, t1 double")
    timed = spark.createDataFrame([("s", 0, *w) for w in words], "script_id string, seq int, pos int, word string, t0 double, t1 double")
    got = timeline.cues(spans, timed).orderBy("cue_no").collect()
    assert len(got) == len(cues) and [r["cue_no"] for r in got] == list(range(1, len(cues) + 1))
    assert [r["t0"] for r in got] == [c[0][1] for c in cues]
    assert [r["text"].split() for r in got] == [" ".join(w for w, *_ in c).split() for c in cues]


def test_slug_of_long_texts(spark):
    """The beginning decides where it has enough words, else the whole text; results are those of the whole text's words."""
    import re
    import time
    import unicodedata

    def whole(t):
        flat = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
        w = re.sub("[^A-Za-z0-9]+", "_", flat).strip("_")
        cut = w[:46].rstrip("_")
        return "anh" if not w else w.lower() if len(w) <= 46 else (re.sub("_[^_]*$", "", cut) if "_" in cut[27:] else cut).lower()

    texts = ["", "é" * 400, "!" * 1000 + "Late wörds " * 9, "a" + "-" * 367 + "b" * 46, "ab " * 15 + "." * 400 + "c", "Été à la " * 200, "x" * 46 + "?" * 900, "x" * 46 + "?" * 900 + "y", "e\u0301" * 300, " " * 368 + "end"]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "k int, t string")
    assert [r[0] for r in rows.orderBy("k").select(X.slug(F.col("t"))).collect()] == [*map(whole, texts), None]
    long = spark.range(400, numPartitions=1).select(F.repeat(F.concat("id", F.lit(" wörd, ")), 4000).alias("t")).cache()
    long.count()

    def seconds(c):
        began = time.time()
        long.select(F.sum(F.length(c))).collect()
        return time.time() - began

    plain = F.regexp_replace(X.strip_accents(F.col("t")), "[^A-Za-z0-9]+", "_")
    seconds(plain), seconds(X.slug(F.col("t")))
    assert seconds(X.slug(F.col("t"))) < 0.5 * seconds(plain)
    long.unpersist()


def test_aligned_words_are_handed_on_in_parts():
    """However many segments a batch has, a worker holds few of their words; lists of any kind of null pass."""
    import pyarrow as pa

    from loomwright.operators import align

    n = 3000
    words = [f"w{k}" for k in range(12)]
    heard = [w for k, w in enumerate(words) if k % 7 != 3]
    times = [float(k) for k in range(len(heard))]
    columns = [[k for k in range(n)], [1] * n, [words] * (n - 1) + [None], [words] * n, [heard] * n, [times] * n, [times] * n]
    kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.string())] * 3, *[pa.list_(pa.float64())] * 2]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["script_id", "seq", "words", "norms", "heard", "t0", "t1"])
    parts = list(align._aligned_batches(iter([batch])))
    assert max(map(len, parts)) < align.WORDS + len(words)
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    at = {w: float(k) for k, w in enumerate(heard)}
    assert rows == [(s, 1, k, w, at.get(w), at.get(w)) for s in range(n - 1) for k, w in enumerate(words)]


def test_speech_timing_splits_sentences_once(spark):
    """Segments and words are written once, not made again for each of their uses."""
    from loomwright.plans import queries

    plan = queries.l10_speech_timing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "conversations" not in plan
