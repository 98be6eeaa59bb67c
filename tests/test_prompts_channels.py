from pyspark.sql import functions as F

from loomwright.operators import attempts, channels, prompts
from loomwright.sources import files


def test_blocks_or_lines(spark):
    texts = [
        ("lines.txt", "a b\nc d\n# no\n2. e f"),
        ("blocks.txt", "[P] an elderly\nwoman\n\nsecond\nblock"),
        ("forced.txt", "[#7] x\n[#0] y\n[P] 2. [#12] z"),
        ("empty.txt", "\n\n# x"),
    ]
    rows = prompts.parse_prompts(spark.createDataFrame(texts, "file_name string, text string")).collect()
    got = {n: sorted((r["number"], r["text"], r["tagged"]) for r in rows if r["file_name"] == n) for n, _ in texts}
    assert got["lines.txt"] == [(1, "a b", False), (2, "c d", False), (3, "e f", False)]
    assert got["blocks.txt"] == [(1, "an elderly woman", True), (2, "second block", False)]
    assert got["forced.txt"] == [(2, "y", False), (7, "x", False), (12, "z", True)]
    assert got["empty.txt"] == []


def test_routing(spark):
    cases = [
        ("golden hour light, no people", False, "auto", "pollinations", "nobody"),
        ("anything", True, "auto", "gemini", "tagged"),
        ("Uma multidão rezando", False, "auto", "gemini", "person: rezando"),
        ("without a person", False, "auto", "pollinations", "nobody"),
        ("no people but people", False, "auto", "gemini", "person: people"),
        ("a piano man on stage", False, "auto", "pollinations", "nobody"),
        ("a statue", False, "auto", "gemini", "maybe: statue"),
        ("a woman", False, "pollinations", "pollinations", "forced: pollinations"),
        ("stick figure drawing", False, "auto", "gemini", "person: figure"),
        ("", False, "auto", "pollinations", "nobody"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, text string, tagged boolean, model string")
    got = {r["i"]: (r["engine"], r["reason"]) for r in prompts.route(df).collect()}
    words = list(prompts.PEOPLE)
    expected = {i: (c[3], c[4]) for i, c in enumerate(cases)}
    expected[2] = ("gemini", f"person: {min(('multidao', 'rezando'), key=words.index)}")
    assert got == expected


def test_explicit_null_overrides(spark):
    dim = spark.createDataFrame([("A", {"model": None}), ("B", {})], "channel string, settings map<string,string>")
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    got = {r["key"]: (r["config"]["model"], r["known"]) for r in channels.resolve(items, dim, {"model": "english"}).collect()}
    assert got == {"a": (None, True), "b": ("english", True), "c": ("english", False)}
    forced = channels.resolve(items, dim, {"model": "english"}, force_model="x").select("config.model").distinct().collect()
    assert [r[0] for r in forced] == ["x"]


def test_retries(spark):
    cases = [
        (["ok"], "gemini", True, (True, "gemini", 1)),
        (["transient", "transient", "ok"], "gemini", True, (True, "gemini", 3)),
        (["transient"] * 3 + ["ok"], "gemini", True, (True, "pollinations", 4)),
        (["transient"] * 3 + ["ok"], "gemini", False, (False, "gemini", 3)),
        (["permanent", "transient", "transient", "ok"], "gemini", True, (True, "pollinations", 4)),
        (["permanent", "ok"], "gemini", False, (False, "gemini", 1)),
        (["permanent", "ok"], "pollinations", True, (False, "pollinations", 1)),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, o array<string>, e string, f boolean")
    got = df.select("i", attempts.settle(F.col("o"), F.col("e"), F.col("f")).alias("s")).collect()
    assert {r["i"]: tuple(r["s"]) for r in got} == {i: c[3] for i, c in enumerate(cases)}


def test_key_ring(spark):
    log = [(1, 0, 0.0, "ok", 0.0), (1, 1, 1.0, "quota", 100.0), (1, 2, 2.0, "quota", 100.0), (1, 3, 3.0, "ok", 0.0), (1, 4, 103.0, "dead", 0.0), (1, 5, 104.0, "ok", 0.0)]
    df = spark.createDataFrame(log, "ring long, call long, at double, outcome string, wait_s double")
    assert [r["key"] for r in attempts.key_ring(df, keys=2).orderBy("call").collect()] == [0, 1, 0, -1, 1, 0]


def test_retry_file_reads_back(spark):
    failed = spark.createDataFrame([("a.txt", 4, "wheat field", "bad\nthing"), ("a.txt", 9, "sea", None)], "file_name string, number int, text string, error string")
    again = files.retry_file(failed)
    rows = prompts.parse_prompts(again).collect()
    assert sorted((r["file_name"], r["number"], r["text"]) for r in rows) == [("loi_a.txt", 4, "wheat field"), ("loi_a.txt", 9, "sea")]


def test_error_order(spark):
    rows = [(429, "API_KEY_INVALID", ""), (403, "", ""), (400, "", "API key not valid"), (400, "", "unknown imageSize"), (400, None, None), (500, "", ""), (404, "", "")]
    df = spark.createDataFrame(rows, "code int, reason string, message string")
    got = [r[0] for r in df.select(attempts.error_class(F.col("code"), F.col("reason"), F.col("message"))).collect()]
    assert got == ["quota", "dead key", "dead key", "transient", "permanent", "transient", "permanent"]
