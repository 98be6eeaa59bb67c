import base64
import json

import numpy as np
from pyspark.sql import functions as F

from loomwright.operators import attempts, channels, mastering


def test_replies(spark):
    image = {"inlineData": {"mimeType": "image/png", "data": base64.b64encode(b"x1").decode()}}
    replies = [
        {"candidates": [{"content": {"parts": [{"text": "hi"}, image]}}]},
        {"candidates": [{"content": None, "finishReason": "SAFETY"}]},
        {"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": "no"}]}}]},
        {"promptFeedback": {"blockReason": "OTHER"}},
        {},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(replies)] + [(9, "no json"), (10, None)], "i int, r string")
    got = {r["i"]: (r["c"]["image"] and bytes(r["c"]["image"]), r["c"]["outcome"]) for r in df.select("i", attempts.reply_image(F.col("r")).alias("c")).collect()}
    assert got[0] == (b"x1", "ok") and [got[i][1] for i in (1, 2, 3, 4, 9, 10)] == ["permanent", "transient", "permanent", "transient", "transient", "transient"]


def test_request_body(spark):
    refused = [[], ["imageSize"], ["imageConfig", "responseModalities"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(refused)], "i int, r array<string>")
    got = {x["i"]: json.loads(x["b"]) for x in df.select("i", attempts.request_body(F.lit("p"), F.lit("16:9"), F.lit("2K"), F.col("r")).alias("b")).collect()}
    assert got[0]["generationConfig"] == {"responseModalities": ["IMAGE"], "imageConfig": {"aspectRatio": "16:9", "imageSize": "2K"}}
    assert got[1]["generationConfig"]["imageConfig"] == {"aspectRatio": "16:9"} and "generationConfig" not in got[2]
    assert got[2]["contents"] == [{"role": "user", "parts": [{"text": "p"}]}]


def test_upsert_and_keys(spark):
    old = spark.createDataFrame([("Terco", {"model": "a", "speed": "1"}), ("X", {})], "channel string, settings map<string,string>")
    new = spark.createDataFrame([("TERCO", {"model": "b"}), ("NEW", {"model": "c"})], "channel string, settings map<string,string>")
    got = {r["channel"]: r["settings"] for r in channels.upsert(old, new).collect()}
    assert got == {"Terco": {"model": "b", "speed": "1"}, "X": {}, "NEW": {"model": "c"}}
    row = spark.range(1).select(
        channels.add_key(F.array(F.lit("k1"), F.lit(""), F.lit("DAN_API_KEY_1")), F.lit(" 'k2', ")).alias("a"),
        channels.add_key(F.array(F.lit("k1")), F.lit("k1")).alias("b"),
        channels.valid_name(F.lit("terco1")).alias("c"),
        channels.valid_name(F.lit("../x")).alias("d"),
    ).first()
    assert row["a"] == ["k1", "k2"] and row["b"] == ["k1"] and row["c"] and not row["d"]


def test_voice_sample(spark):
    rate = 8000
    x = np.concatenate([np.zeros(rate), 0.3 * np.sin(np.arange(40 * rate) * 0.3), np.zeros(rate)])
    y = mastering.prepare_sample(x, rate)
    assert 25 * rate <= len(y) <= 30 * rate and np.isclose(np.abs(y).max(), 10 ** (-3 / 20))
    assert len(mastering.prepare_sample(x, rate, 2.0, 5.0)) == 3 * rate
    row = spark.range(1).select(mastering.stand_in_voice(F.lit("x" * 30), 1000).alias("v")).first()
    assert len(row["v"]) == 2000 and abs(row["v"][0]) < 1e-9 and max(row["v"]) <= 0.25


def test_backoff_waits_for_cooling_keys(spark):
    """The longer of the back-off and the earliest end of cooling, as the reference has it."""
    rows = [(1, 1, False, 10.0), (1, 2, False, 500.0), (1, 3, True, 500.0), (1, 4, False, 2000.0), (1, 5, False, -5.0), (1, 6, False, None)]
    log = spark.createDataFrame(rows, "user_id long, event_id long, ok boolean, until double")
    got = attempts.backoff(log, cooling=F.col("until")).orderBy("event_id").collect()
    assert [r["wait"] for r in got] == [60.0, 500.0, None, 2000.0, 120.0, 240.0]
    assert [r["wait"] for r in attempts.backoff(log).orderBy("event_id").collect()] == [60.0, 120.0, None, 60.0, 120.0, 240.0]


def test_checked_updates(spark):
    from loomwright.operators import channels

    rows = [(" ab1 ", "english", "v.wav", "nhe", 1.23456, 0.005, 0.3, 0.85), ("a-b", "english", "", "nhe", 1.0, 0.0, 0.3, 0.8), ("C", "klingon", "", "loud", 1.0, 0.0, 0.3, 0.8), ("D", "english", "", "loud", 1.0, 0.0, None, 0.8), (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "channel string, model string, giong string, hau_ky string, toc_do double, cao_do double, nghi_ngan double, nghi_dai double")
    got = [(r["channel"], r["error"], r["settings"]) for r in channels.checked_updates(df, ("english", "spanish")).collect()]
    assert got[0] == ("AB1", None, {"model": "english", "voice": "v.wav", "hau_ky": "nhe", "toc_do": "1.235", "cao_do": "0.0", "nghi_ngan": "0.3", "nghi_dai": "0.85"})
    assert [g[1] for g in got[1:]] == ["name", "model", "hau_ky", "name"] and all(g[2] is None for g in got[1:])


def test_image_channels(spark):
    from loomwright.operators import channels

    text = "map<string,string>"
    dim = spark.createDataFrame([("a", {"model": " Gemini "}), ("B", {"model": "odd", "thu_muc_ra": " out/b "}), ("c", {"model": "gemini", "cam_du_phong": "false"})], f"channel string, settings {text}")
    items = spark.createDataFrame([(1, "A"), (2, "b"), (3, "C"), (4, "x"), (5, None)], "i int, key string")
    got = {r["i"]: tuple(r)[2:] for r in channels.resolve_images(items, dim).collect()}
    assert got[1] == ("gemini", True, "ANH_RA/A", True) and got[2] == ("auto", False, "out/b", True) and got[3] == ("gemini", False, "ANH_RA/C", True)
    assert got[4] == ("auto", False, "ANH_RA/X", False) and got[5][3] is False


def test_merged_config(spark):
    import pytest

    from loomwright.sources import files

    defaults = {"anh": {"dinh_dang": "png", "min_kb": 5}, "kenh": {"TERCO": {"model": "auto"}}, "uu_tien": ["A"], "khoa": "k"}
    docs = ['﻿{"anh": {"min_kb": 9, "moi": true}, "kenh": {"X": {"model": "gemini"}}, "khoa": "z", "them": 1}', "{}"]
    df = spark.createDataFrame([(d,) for d in docs], "v string").coalesce(1)
    one, two = (r[0] for r in df.select(files.merged_config(df["v"], defaults)).collect())
    assert one["sections"]["anh"] == {"dinh_dang": "png", "min_kb": "9", "moi": "true"} and list(one["sections"]["kenh"]) == ["X"]
    assert one["values"] == {"uu_tien": '["A"]', "khoa": "z", "them": "1"}
    assert two["sections"]["anh"] == {"dinh_dang": "png", "min_kb": "5"} and list(two["sections"]["kenh"]) == ["TERCO"] and two["values"]["khoa"] == "k"
    bad = spark.createDataFrame([("{nonsense",)], "v string")
    with pytest.raises(Exception, match="MALFORMED"):
        bad.select(files.merged_config(bad["v"], defaults)).collect()
