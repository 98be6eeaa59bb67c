"""Queries of the channel, prompt, request and timing operators; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import attempts, channels, prompts, segment, timeline
from ..sources import files
from .queries import _CUES_SQL, _FILL_SQL, _SEGMENTS_SQL, _route_sql, query, scripts, table

TEXTS = "map<string,string>"


def _pick(values, n):
    """The value whose turn it is, by number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _list(values) -> str:
    """A DuckDB list of strings."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- channels ---------------------------------------------------------------------------


@query(
    """SELECT c_custkey, CASE WHEN n_nationkey % 4 IN (0, 1) THEN ['auto', 'gemini'][1 + n_nationkey % 4] ELSE 'auto' END AS model,
  CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 2 = 0 ELSE coalesce(n_nationkey % 4 = 1, false) END AS no_fallback,
  CASE WHEN n_nationkey % 5 = 0 THEN 'out/' || n_nationkey ELSE 'ANH_RA/N' || CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END END AS output, n_nationkey IS NOT NULL AS known
FROM customer LEFT JOIN nation ON CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END = n_nationkey"""
)
def c4_image_channels(spark, sf_dir):
    """Items of image channels: models known, unknown and in odd case; folders and fallbacks given or not; every fifth item undeclared."""
    k = F.col("n_nationkey")
    fallback = F.when(k % 3 == 0, F.when(k % 2 == 0, "true").otherwise("false"))
    folder = F.when(k % 5 == 0, F.concat(F.lit(" out/"), k)).otherwise("")
    given = F.create_map(F.lit("model"), _pick(["auto", " Gemini ", "other", ""], k), F.lit("cam_du_phong"), fallback, F.lit("thu_muc_ra"), folder)
    settings = F.map_filter(given, lambda _, v: v.isNotNull())
    dimension = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), k).alias("channel"), settings.alias("settings"))
    key = F.concat(F.lit("N"), F.when(F.col("c_custkey") % 5 == 0, -1).otherwise(F.col("c_nationkey")))
    return channels.resolve_images(table(spark, sf_dir, "customer").select("c_custkey", key.alias("key")), dimension).drop("key")


@query(
    """SELECT c_custkey, 'english' AS model, CASE WHEN c_nationkey % 2 = 0 THEN 'fast' ELSE 'plain' END AS speed FROM customer"""
)
def c5_forced_settings(spark, sf_dir):
    """A forced model reaches every item, declared or not; a file-wide setting lies between default and channel."""
    n = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    dimension = n.select(F.col("n_nationkey").cast("string").alias("channel"), F.create_map(F.lit("speed"), F.lit("fast"), F.lit("model"), F.lit("spanish")).alias("settings"))
    items = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("key"))
    out = channels.resolve(items, dimension, {"model": "portuguese", "speed": "plain"}, force_model="english")
    return out.select("c_custkey", "config.model", "config.speed")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'line' END, CASE WHEN o_orderkey % 3 = 0 THEN 'file' END, CASE WHEN o_orderkey % 2 = 0 THEN 'environment' END, 'default') AS chosen FROM orders")
def c6_first_given(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        channels.first_given(F.when(k % 5 == 0, "line"), F.when(k % 3 == 0, "file"), F.when(k % 2 == 0, "environment"), F.lit("default")).alias("chosen"),
    )


def _flat(c):
    """A map as ``key=value`` pairs in the order of the keys."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), ",")


@query(
    """WITH o AS (SELECT n_nationkey AS k, n_name AS channel FROM nation WHERE n_nationkey % 3 <> 0),
u AS (SELECT n_nationkey AS k, lower(n_name) AS channel FROM nation WHERE n_nationkey % 2 = 0)
SELECT coalesce(o.channel, u.channel) AS channel, CASE WHEN u.k IS NULL THEN 'model=old,speed=' || o.k WHEN o.k IS NULL THEN 'model=new,voice=v' || u.k
  ELSE 'model=new,speed=' || o.k || ',voice=v' || u.k END AS settings FROM o FULL JOIN u ON o.k = u.k"""
)
def k3_upserts(spark, sf_dir):
    """Settings of some nations' channels merged into those of others, names in another case."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string")
    old = n.where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("channel"), F.create_map(F.lit("model"), F.lit("old"), F.lit("speed"), k).alias("settings"))
    new = n.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("channel"), F.create_map(F.lit("model"), F.lit("new"), F.lit("voice"), F.concat(F.lit("v"), k)).alias("settings"))
    return channels.upsert(old, new).select("channel", _flat(F.col("settings")).alias("settings"))


@query(
    """WITH e AS (SELECT *, ['ok1', 'a-b', ' up ', ''][1 + event_id % 4] AS name, ['english', 'klingon', 'spanish'][1 + event_id % 3] AS model, ['nhe', 'loud', 'tat', 'chuan', 'manh'][1 + event_id % 5] AS mode FROM events),
c AS (SELECT *, CASE WHEN name IN ('a-b', '') THEN 'name' WHEN model = 'klingon' THEN 'model' WHEN mode = 'loud' THEN 'hau_ky' END AS error FROM e)
SELECT event_id, upper(trim(name)) AS channel, error, CASE WHEN error IS NULL THEN mode END AS hau_ky, CASE WHEN error IS NULL AND event_id % 7 <> 0 THEN 'v.wav' END AS voice,
  CASE WHEN error IS NULL THEN (event_id % 1000) / 8 END AS toc_do FROM c"""
)
def k4_checked_updates(spark, sf_dir):
    """Settings sent from the page, with bad names, models and modes among them."""
    k = F.col("event_id")
    sent = table(spark, sf_dir, "events").select(
        k, _pick(["ok1", "a-b", " up ", ""], k).alias("channel"), _pick(["english", "klingon", "spanish"], k).alias("model"), _pick(["nhe", "loud", "tat", "chuan", "manh"], k).alias("hau_ky"),
        F.when(k % 7 == 0, "").otherwise("v.wav").alias("giong"), ((k % 1000) / 8).alias("toc_do"), F.lit(0.0).alias("cao_do"), F.lit(0.3).alias("nghi_ngan"), F.lit(0.85).alias("nghi_dai"),
    )
    rows, s = channels.checked_updates(sent, ("english", "spanish"), keep=("event_id",)), F.col("settings")
    return rows.select("event_id", "channel", "error", s["hau_ky"].alias("hau_ky"), s["voice"].alias("voice"), s["toc_do"].cast("double").alias("toc_do"))


_KEYS = (" 'k2', ", "", "k1", '"DAN_API_KEY"', "k3")


@query(
    f"""WITH k AS (SELECT event_id, regexp_replace(regexp_replace(trim({_list(_KEYS)}[1 + event_id % 5]), '^["'',]+', ''), '["'',]+$', '') AS new, ['k1', '', 'x DAN_API_KEY x'] AS had FROM events),
f AS (SELECT event_id, new, list_filter(had, lambda x: x <> '' AND NOT contains(x, 'DAN_API_KEY')) AS kept FROM k)
SELECT event_id, array_to_string(CASE WHEN new = '' OR list_contains(kept, new) THEN kept ELSE list_append(kept, new) END, ',') AS keys FROM f"""
)
def k11_added_keys(spark, sf_dir):
    """One more key for a list that holds a blank and a placeholder."""
    had = F.array(F.lit("k1"), F.lit(""), F.lit("x DAN_API_KEY x"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(channels.add_key(had, _pick(_KEYS, F.col("event_id"))), ",").alias("keys"))


@query("SELECT p_partkey, regexp_full_match(upper(split_part(p_name, ' ', 1)), '[A-Z0-9]+') AS one, regexp_full_match(upper(p_name), '[A-Z0-9]+') AS whole FROM part")
def p9_valid_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", channels.valid_name(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("one"), channels.valid_name(F.col("p_name")).alias("whole"))


@query(
    """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'dinh_dang=jpg,min_kb=' || n_nationkey || ',moi=true' ELSE 'dinh_dang=png,min_kb=5' END AS anh,
  CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'TERCO' END AS kenh, CASE WHEN n_nationkey % 5 = 0 THEN 'z' ELSE 'k' END AS khoa FROM nation"""
)
def s6_merged_config(spark, sf_dir):
    """Documents laid over defaults: sections merged key by key, the channels taken whole, plain values replaced."""
    k = F.col("n_nationkey")
    parts = F.array_compact(
        F.array(
            F.when(k % 2 == 0, F.concat(F.lit('"anh": {"dinh_dang": "jpg", "moi": true, "min_kb": '), k, F.lit("}"))),
            F.when(k % 3 == 0, F.concat(F.lit('"kenh": {"'), "n_name", F.lit('": {"model": "auto"}}'))),
            F.when(k % 5 == 0, F.lit('"khoa": "z"')),
        )
    )
    document = F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
    merged = files.merged_config(document, {"anh": {"dinh_dang": "png", "min_kb": 5}, "kenh": {"TERCO": {}}, "khoa": "k"})
    rows = table(spark, sf_dir, "nation").select("n_nationkey", merged.alias("c"))
    return rows.select(
        "n_nationkey", _flat(F.col("c.sections")["anh"]).alias("anh"), F.array_join(F.map_keys(F.col("c.sections")["kenh"]), ",").alias("kenh"), F.col("c.values")["khoa"].alias("khoa")
    )


# --- prompts and requests -------------------------------------------------------------------

_FRONTS = ("[#7] [P] 3. - ", "[P][p] ", "12) ", "- * ", "[# 4 ][#9] ", "1. 2. 3. 4. 5. ", "", "[#0] 10: ", "• [P] 3- ", "99999. ")


@query(
    f"""WITH RECURSIVE c(event_id, pass, text, tagged, forced) AS (
  SELECT event_id, 0, {_list(_FRONTS)}[1 + event_id % 10] || 'a ' || event_type || '  ', false, CAST(NULL AS INT) FROM events
  UNION ALL SELECT event_id, pass + 1, regexp_replace(regexp_replace(regexp_replace(rest, '^\\s*\\[\\s*[Pp]\\s*\\]\\s*', ''), '^\\s*\\d{{1,4}}\\s*[.)\\-:]\\s+', ''), '^\\s*[-*•]\\s+', ''),
    tagged OR regexp_matches(rest, '^\\s*\\[\\s*[Pp]\\s*\\]'), coalesce(number, forced)
  FROM (SELECT *, regexp_replace(text, '^\\s*\\[\\s*#\\s*(\\d+)\\s*\\]\\s*', '') AS rest, TRY_CAST(nullif(regexp_extract(text, '^\\s*\\[\\s*#\\s*(\\d+)\\s*\\]', 1), '') AS INT) AS number FROM c WHERE pass < 4))
SELECT event_id, trim(text) AS text, tagged, forced FROM c WHERE pass = 4"""
)
def t11_clean_lines(spark, sf_dir):
    """Prompts behind numbers, tags and bullets of every kind; no more than four of one kind go."""
    line = F.concat(_pick(_FRONTS, F.col("event_id")), F.lit("a "), "event_type", F.lit("  "))
    return table(spark, sf_dir, "events").select("event_id", prompts.clean_line(line).alias("c")).select("event_id", "c.*")


@query(
    _route_sql()
    .replace("SELECT event_id, event_id % 11 = 0 AS tagged, CASE event_id % 17 WHEN 0 THEN 'gemini' WHEN 1 THEN 'pollinations' ELSE 'auto' END AS model", "SELECT conv_id, turn, false AS tagged, 'auto' AS model")
    .replace(_route_sql().partition("strip_accents(lower(")[2].partition(")) AS t FROM events")[0], "text")
    .replace("FROM events", "FROM conversations")
    .replace("SELECT event_id, CASE", "SELECT conv_id, turn, CASE")
)
def p1_text_routing(spark, sf_dir):
    """The router over whole turns of conversations."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lit(False).alias("tagged"), F.lit("auto").alias("model"))
    return prompts.route(rows).select("conv_id", "turn", "engine", "reason")


_HEADS = ("89504E470D0A1A0A", "FFD8FFE000104A46", "5249464624000000", "4749463839610000", "255044462D312E34", "")


@query(
    f"""WITH c AS (SELECT event_id, {_list(_HEADS)}[1 + event_id % 6] AS head, len({_list(_HEADS)}[1 + event_id % 6]) // 2 + 256 * (event_id % 20) AS size FROM events),
k AS (SELECT *, CASE WHEN starts_with(head, '89504E47') THEN 'png' WHEN starts_with(head, 'FFD8FF') THEN 'jpg' WHEN starts_with(head, '52494646') THEN 'webp' WHEN starts_with(head, '47494638') THEN 'gif' ELSE '' END AS kind FROM c)
SELECT event_id, kind, kind <> '' AND size >= 2 * 1024 AS accepted FROM k"""
)
def p5_images(spark, sf_dir):
    """Bytes with the heads of image files and others, of various sizes."""
    k = F.col("event_id")
    content = F.concat(F.unhex(_pick(_HEADS, k)), F.encode(F.repeat(F.lit("x"), (256 * (k % 20)).cast("int")), "UTF-8"))
    return table(spark, sf_dir, "events").select(k, F.coalesce(attempts.image_kind(content), F.lit("")).alias("kind"), attempts.image_accepted(content, 2).alias("accepted"))


_FIELD_TEXTS = ("Unknown name imageSize", "aspectRatio and imageConfig", "responseModalities: imageSize", "nothing", "", "imageConfig")


@query(
    f"""WITH m AS (SELECT event_id, {_list(_FIELD_TEXTS)}[1 + event_id % 6] AS text FROM events)
SELECT event_id, coalesce(list_filter(['imageSize', 'aspectRatio', 'imageConfig', 'responseModalities'], lambda f: contains(text, f))[1], '') AS field FROM m"""
)
def p11_rejected_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(attempts.rejected_field(_pick(_FIELD_TEXTS, F.col("event_id"))), F.lit("")).alias("field"))


_REPLIES = (
    '{"candidates": [{"content": {"parts": [{"text": "hi"}, {"inlineData": {"mimeType": "image/png", "data": "eDE="}}]}}]}',
    '{"candidates": [{"content": null, "finishReason": "SAFETY"}]}',
    '{"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": "no"}]}}]}',
    '{"promptFeedback": {"blockReason": "OTHER"}}',
    "no json",
    '{"candidates": [{"content": {"parts": [{"inline_data": {"mime_type": "image/jpeg", "data": "eTI="}}]}}]}',
)


@query(
    f"""WITH m AS (SELECT event_id, {_list(_REPLIES)}[1 + event_id % 6] AS text FROM events),
j AS (SELECT event_id, CAST(CASE WHEN json_valid(text) THEN text ELSE '{{}}' END AS JSON) AS j FROM m),
p AS (SELECT event_id, j, list_filter(json_extract(j, '$.candidates[*].content.parts[*]'), lambda x: starts_with(coalesce(json_extract_string(x, '$.inlineData.mimeType'), json_extract_string(x, '$.inline_data.mime_type'), ''), 'image/'))[1] AS part FROM j),
d AS (SELECT event_id, j, coalesce(json_extract_string(part, '$.inlineData.data'), json_extract_string(part, '$.inline_data.data')) AS data FROM p)
SELECT event_id, coalesce(decode(from_base64(data)), '') AS image, CASE WHEN data IS NOT NULL THEN 'ok'
  WHEN coalesce(json_extract_string(j, '$.promptFeedback.blockReason'), '') <> '' OR coalesce(json_extract_string(j, '$.candidates[0].finishReason') IN ('IMAGE_SAFETY', 'PROHIBITED_CONTENT', 'SAFETY', 'BLOCKLIST', 'RECITATION'), false) THEN 'permanent'
  ELSE 'transient' END AS outcome FROM d"""
)
def p13_replies(spark, sf_dir):
    """Replies with images in two spellings, blocked, empty and unreadable ones."""
    rows = table(spark, sf_dir, "events").select("event_id", attempts.reply_image(_pick(_REPLIES, F.col("event_id"))).alias("r"))
    return rows.select("event_id", F.coalesce(F.decode("r.image", "UTF-8"), F.lit("")).alias("image"), "r.outcome")


@query(
    """WITH e AS (SELECT event_id, 'p' || event_id AS prompt, event_id % 2 = 0 AS ratio, event_id % 3 = 0 AND event_id % 5 <> 0 AS size, event_id % 7 <> 0 AS image, event_id % 11 <> 0 AS kinds FROM events),
c AS (SELECT *, image AND (ratio OR size) AS has FROM e)
SELECT event_id, '{"contents":[{"role":"user","parts":[{"text":"' || prompt || '"}]}]' || CASE WHEN kinds OR has THEN ',"generationConfig":{' || CASE WHEN kinds THEN '"responseModalities":["IMAGE"]' ELSE '' END
  || CASE WHEN kinds AND has THEN ',' ELSE '' END || CASE WHEN has THEN '"imageConfig":{' || CASE WHEN ratio THEN '"aspectRatio":"16:9"' ELSE '' END || CASE WHEN ratio AND size THEN ',' ELSE '' END
  || CASE WHEN size THEN '"imageSize":"2K"' ELSE '' END || '}' ELSE '' END || '}' ELSE '' END || '}' AS body FROM c"""
)
def p14_requests(spark, sf_dir):
    """Request bodies less the settings that are empty or have been refused."""
    k = F.col("event_id")
    refused = F.array_compact(F.array(F.when(k % 5 == 0, "imageSize"), F.when(k % 7 == 0, "imageConfig"), F.when(k % 11 == 0, "responseModalities")))
    body = attempts.request_body(F.concat(F.lit("p"), k), F.when(k % 2 == 0, "16:9").otherwise(""), F.when(k % 3 == 0, "2K").otherwise(""), refused)
    return table(spark, sf_dir, "events").select(k, body.alias("body"))


@query(
    """SELECT 'loi_' || user_id || '.txt' AS file_name, string_agg('# bad reply ' || event_type || chr(10) || '[#' || event_id || '] prompt of ' || event_type, chr(10) || chr(10) ORDER BY event_id) AS text
FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id"""
)
def k6_retry_files(spark, sf_dir):
    """Failed prompts of each file, errors of several lines on one."""
    failed = table(spark, sf_dir, "events").where("event_type in ('error', 'signup')")
    return files.retry_file(
        failed.select(F.concat("user_id", F.lit(".txt")).alias("file_name"), F.col("event_id").alias("number"), F.concat(F.lit("prompt of "), "event_type").alias("text"), F.concat(F.lit("bad\n reply\t"), "event_type").alias("error"))
    )


# --- timing ----------------------------------------------------------------------------------

_MARKERS = ("[pause: 1,5 s]", "[NGHỈ 2.25]", "[nghi=3]", "[pause]", "plain", "[Pause 10s]")


@query(
    f"""WITH m AS (SELECT event_id, {_list(_MARKERS)}[1 + event_id % 6] AS line FROM events)
SELECT event_id, CAST(replace(nullif(regexp_extract(line, '(?i)\\[\\s*(?:nghi|nghỉ|pause)\\s*[=:]?\\s*([0-9]+(?:[.,][0-9]+)?)\\s*s?\\s*\\]', 1), ''), ',', '.') AS DOUBLE) AS seconds FROM m"""
)
def t3_pause_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.pause_seconds(_pick(_MARKERS, F.col("event_id"))).alias("seconds"))


@query(
    f"""WITH {_SEGMENTS_SQL}, smp AS (SELECT *, CASE WHEN seq % 5 <> 0 THEN 24000 * (1 + seq % 3) END AS samples FROM segments),
left_ AS (SELECT * FROM smp WHERE samples > 0)
SELECT script_id, CAST(seq AS INT) AS seq, CAST(coalesce(sum(samples + CAST(floor(CAST(pause AS DOUBLE) * 24000) AS BIGINT)) OVER (PARTITION BY script_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s0 FROM left_"""
)
def l2_dropped_segments(spark, sf_dir):
    """Every fifth segment has failed: it takes no time."""
    rows = segment.segments(scripts(spark, sf_dir)).withColumn("samples", F.when(F.col("seq") % 5 != 0, 24000 * (1 + F.col("seq") % 3)))
    return timeline.timeline(rows).select("script_id", "seq", "s0")


@query(
    f"""WITH RECURSIVE {_CUES_SQL},
known AS (SELECT script_id, seq, pos, word, a, b, CASE WHEN pos % 4 = 1 THEN t0 END AS t0, CASE WHEN pos % 4 = 1 THEN t1 END AS t1 FROM timed),
{_FILL_SQL}
SELECT script_id, CAST(seq AS INT) AS seq, CAST(pos AS INT) AS pos, CAST(floor(t0 * 1e4 + 0.5) AS BIGINT) AS t0_e4, CAST(floor(t1 * 1e4 + 0.5) AS BIGINT) AS t1_e4 FROM filled"""
)
def l5_filled_times(spark, sf_dir):
    """Every fourth word has a time; the others share what lies between, by their lengths."""
    rows = timeline.timeline(segment.segments(scripts(spark, sf_dir)))
    spans = rows.withColumn("t0", F.col("s0") / timeline.RATE).withColumn("t1", F.col("s1") / timeline.RATE)
    words = timeline.word_times(spans).join(spans.select("script_id", "seq", F.col("t0").alias("a"), F.col("t1").alias("b")), ["script_id", "seq"])
    known = words.withColumns({t: F.when(F.col("pos") % 4 == 1, F.col(t)) for t in ("t0", "t1")})
    return timeline.fill_times(known).select("script_id", "seq", "pos", *[F.floor(F.col(t) * 1e4 + 0.5).alias(f"{t}_e4") for t in ("t0", "t1")])


# --- files -----------------------------------------------------------------------------------


def _little_endian(value: str) -> str:
    return f"printf('%02x%02x%02x%02x', {value} % 256, {value} // 256 % 256, {value} // 65536 % 256, {value} // 16777216)"


@query(
    f"""WITH p AS (SELECT vec_id, len(embedding) AS n, array_to_string(list_transform(list_transform(embedding, lambda x: CAST(trunc(greatest(-1, least(1, CAST(x AS DOUBLE))) * 32767) AS BIGINT)),
  lambda v: printf('%02x%02x', (v + 65536) % 256, (v + 65536) // 256 % 256)), '') AS samples FROM embeddings)
SELECT vec_id, '52494646' || {_little_endian("(36 + 2 * n)")} || '57415645666d74201000000001000100' || {_little_endian("8000")} || {_little_endian("16000")} || '0200100064617461' || {_little_endian("(2 * n)")} || samples AS wav FROM p"""
)
def k1_wav_files(spark, sf_dir):
    """Vectors as mono 16-bit WAV files, byte for byte."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lower(F.hex(files.wav_bytes(F.col("embedding"), F.lit(8000)))).alias("wav"))
