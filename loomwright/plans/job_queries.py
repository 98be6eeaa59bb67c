"""Queries of files, kept results, recognizers, jobs and model shares; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import channels, recognize, timeline
from ..sources import files, results, wav
from ..sources.shared import shared_path
from ..streaming import jobs, progress
from .block_queries import vectors
from .queries import query, table
from .request_queries import k6_retry_files

# --- files --------------------------------------------------------------------------------------


@query(
    """WITH x AS (SELECT vec_id // 100 AS c, vec_id, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings),
v AS (SELECT c, CAST(trunc(greatest(-1, least(1, CAST(e AS DOUBLE))) * 32767) AS BIGINT) AS v, row_number() OVER (PARTITION BY c ORDER BY vec_id, i) - 1 AS pos FROM x)
SELECT 'v' || c AS clip, 8000 AS rate, count(*) AS n_samples, count(*) / 8000.0 AS seconds, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (pos % 1000 + 1)) AS BIGINT) AS weighted FROM v GROUP BY c"""
)
def s7_wav_files(spark, sf_dir):
    """A hundred vectors a clip, written as WAV files by one job, listed by their headers, and read back in blocks."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.floor(F.col("vec_id") / 100).cast("string")).alias("clip"), F.col("vec_id").alias("block"), F.col("embedding").alias("samples")
    )
    folder = shared_path(spark, "wav-files")
    wav.write(rows, folder, rate=8000)
    clip = lambda c: F.regexp_extract(c, r"([^/]+)\.wav$", 1)
    heads = spark.read.format("wav").load(folder).select(clip("path").alias("clip"), "rate", "n_samples", "seconds")
    blocks = spark.read.format("wav").option("block", 1000).load(folder).select("clip", F.posexplode("samples").alias("at", "v"))
    value = F.rint(F.col("v") * 32768).cast("long")  # whole numbers; round() would go by decimals
    sums = blocks.groupBy("clip").agg(F.sum(value).alias("total"), F.sum(value * (F.col("at") + 1)).alias("weighted"))
    return heads.join(sums.withColumn("clip", clip("clip")), "clip")


@query(
    """SELECT 'loi_' || user_id || '.txt' AS file_name, string_agg('# bad reply ' || event_type || chr(10) || '[#' || event_id || '] prompt of ' || event_type, chr(10) || chr(10) ORDER BY event_id) AS text
FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id"""
)
def k6_written_files(spark, sf_dir):
    """Retry files written by the tasks, committed together, and read back."""
    wav.register(spark)
    folder = shared_path(spark, "retry-files")
    k6_retry_files(spark, sf_dir).select(F.col("file_name").alias("name"), F.col("text").alias("content")).write.format("named_files").mode("append").save(folder)
    read = spark.read.format("binaryFile").load(folder)
    return read.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), F.decode("content", "UTF-8").alias("text"))


def _user_texts(spark, sf_dir):
    """A text file for each user, with a byte-order mark, unlike line ends and no-break spaces."""
    line = F.concat(F.col("event_id").cast("string"), F.lit("\u00a0"), F.col("event_type"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"])
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(lines, "\r\n").alias("text"))
    return rows.select(F.concat(F.lit("s/U"), "user_id", F.lit("_x."), F.when(F.col("user_id") % 2 == 0, "txt").otherwise("TXT")).alias("name"), F.concat(F.lit("\ufeff"), "text", F.lit("\r\rend")).alias("content"))


_USER_TEXTS_SQL = """t AS (SELECT user_id, string_agg(event_id || ' ' || event_type, chr(10) ORDER BY event_id) || chr(10) || chr(10) || 'end' AS text FROM events GROUP BY user_id)"""


@query(f"""WITH {_USER_TEXTS_SQL} SELECT 'U' || user_id || '_x.' || CASE WHEN user_id % 2 = 0 THEN 'txt' ELSE 'TXT' END AS file_name, 'U' || user_id AS channel, text FROM t""")
def s3_script_files(spark, sf_dir):
    """Scripts written as files below a folder, found there and read as clean text, with their channels."""
    wav.register(spark)
    folder = shared_path(spark, "scripts")
    _user_texts(spark, sf_dir).write.format("named_files").mode("append").save(folder)
    return files.read_texts(spark, folder).select("file_name", X.channel_key(F.col("file_name")).alias("channel"), "text")


@query("""SELECT upper(n_name) AS channel, 'm' || n_regionkey AS model, CASE WHEN n_nationkey % 3 > 0 THEN 'v' || n_nationkey END AS voice, CAST(len(string_split(n_name, ' ')) AS INT) AS n_words FROM nation""")
def s5_channel_files(spark, sf_dir):
    """A JSON document of channels, made from the nations, written and read; notes hold quotes and line ends."""
    wav.register(spark)
    comment = F.concat(F.lit('"q\\ \n'), "n_name")
    own = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("model").alias("k"), F.concat(F.lit("m"), "n_regionkey").alias("v")), F.struct(F.lit("note").alias("k"), comment.alias("v")),
        F.when(F.col("n_nationkey") % 3 > 0, F.struct(F.lit("voice").alias("k"), F.concat(F.lit("v"), "n_nationkey").alias("v"))),
    )))
    nations = table(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(F.struct(F.lower("n_name"), own))).alias("m"))  # a fixed dimension of 25 rows
    document = nations.select(F.lit("channels.json").alias("name"), F.concat(F.lit("\ufeff"), F.to_json(F.struct(F.col("m").alias("kenh")))).alias("content"))
    folder = shared_path(spark, "channels")
    document.write.format("named_files").mode("append").save(folder)
    read = files.read_channels(spark, f"{folder}/channels.json")
    return read.select("channel", F.col("settings")["model"].alias("model"), F.col("settings")["voice"].alias("voice"), (F.size(F.split(F.col("settings")["note"], " ")) - 1).alias("n_words"))


@query(f"""WITH {_USER_TEXTS_SQL} SELECT 'U' || user_id || '_x.txt' AS file_name, CAST(len(string_split(text, chr(10))) AS INT) AS n_lines FROM t WHERE user_id % 2 = 0""")
def k7_script_queue(spark, sf_dir):
    """Scripts that lie in a folder, taken up by a stream until none is left (only files named .txt)."""
    wav.register(spark)
    folder, out = shared_path(spark, "queue"), shared_path(spark, "queued")
    _user_texts(spark, sf_dir).write.format("named_files").mode("append").save(folder)
    rows = jobs.script_queue(spark, f"{folder}/s")
    lines = F.size(F.split(F.regexp_replace(X.clean_text(F.col("text")), "\r\n?", "\n"), "\n"))
    jobs.write_available(rows.select("file_name", lines.alias("n_lines")), out)
    return spark.read.parquet(out)


# --- kept results --------------------------------------------------------------------------------

_SETTINGS = '{"rate": 24000}'


@query(
    f"""WITH k AS (SELECT conv_id, turn, text, sha256('{_SETTINGS}' || chr(10) || CASE WHEN text IS NULL THEN 'n' ELSE 'v' || length(text) || ':' || text END) AS key FROM conversations)
SELECT conv_id, turn, key, CAST(floor(greatest(0.4, length(text) / 15.0) * 24000) AS BIGINT) AS samples FROM k"""
)
def k8_kept_results(spark, sf_dir):
    """Spoken lengths of all turns: a first run computes each different text once, a second finds every one of them."""
    store = results.ResultStore(spark, shared_path(spark, "kept-results"), "samples long")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    spoken = lambda rows: rows.select("key", timeline.spoken_samples(F.col("text")).cast("long").alias("samples"))
    for _ in range(2):
        out = store.computed(turns, spoken, ["text"], {"rate": 24000})
    return out.select("conv_id", "turn", "key", "samples")


# --- recognizers ---------------------------------------------------------------------------------


@query(
    """WITH x AS (SELECT vec_id, unnest(range(64)) AS i, abs(CAST(unnest(embedding) AS DOUBLE)) > 0.15 AS loud FROM embeddings),
l AS (SELECT vec_id, i, i - lag(i) OVER (PARTITION BY vec_id ORDER BY i) AS step FROM x WHERE loud),
g AS (SELECT vec_id, i, sum(CASE WHEN step <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT vec_id, CAST(g - 1 AS INT) AS pos, round(min(i) / 1000.0, 6) AS t0, round((max(i) + 1) / 1000.0, 6) AS t1 FROM g GROUP BY vec_id, g"""
)
def l10_loud_stretches(spark, sf_dir):
    """A recognizer of loud stretches over vectors in blocks, as a table function for each clip."""
    heard = recognize.recognized(vectors(spark, sf_dir), lambda: recognize.LoudStretches(0.15, 1), rate=1000)
    return heard.select(F.col("clip").alias("vec_id"), "pos", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


# --- jobs ----------------------------------------------------------------------------------------

_PATIENCE = 6 * 3600
_STATES = {"signup": "waiting", "view": "running", "click": "running", "purchase": "done", "error": "failed"}


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id AS job, epoch_us(ts) AS tm, event_id AS event,
  CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _STATES.items())} END AS state, CASE WHEN event_type IN ('view', 'click') THEN event_id % 7 END AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w(job, rn, st, k, tm, ev, lost, note, o_state, o_k) AS (
  SELECT DISTINCT job, CAST(0 AS BIGINT), '', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), NULL::STRUCT(t BIGINT, ev BIGINT, k BIGINT), '', '', CAST(NULL AS BIGINT) FROM e
  UNION ALL
  SELECT job, rn, CASE WHEN NOT ok THEN b WHEN state IN ('done', 'failed') THEN '' ELSE state END,
    CASE WHEN ok THEN CASE WHEN state = 'running' OR b = '' THEN ek ELSE wk END WHEN b <> '' THEN wk END,
    CASE WHEN ok THEN eat ELSE wat END, CASE WHEN ok THEN event ELSE wev END,
    CASE WHEN is_lost THEN {{'t': wat + {_PATIENCE}000000, 'ev': wev, 'k': wk}} END,
    CASE WHEN ok THEN 'accepted' ELSE 'refused' END, state, CASE WHEN ok AND state <> 'running' AND b <> '' THEN wk ELSE ek END
  FROM (SELECT *, ((b = '' AND state IN ('waiting', 'running')) OR (b = 'waiting' AND state IN ('running', 'failed')) OR (b = 'running' AND state IN ('running', 'done', 'failed')))
      AND NOT (b = 'running' AND state = 'running' AND ek < coalesce(wk, 0)) AS ok
    FROM (SELECT w.job, e.rn, e.state, e.k AS ek, e.tm AS eat, e.event, w.k AS wk, w.tm AS wat, w.ev AS wev, w.st <> '' AND e.tm - w.tm > {_PATIENCE}000000 AS is_lost,
        CASE WHEN w.st <> '' AND e.tm - w.tm > {_PATIENCE}000000 THEN '' ELSE w.st END AS b
      FROM w JOIN e ON e.job = w.job AND e.rn = w.rn + 1))),
o AS (SELECT w.job, e.tm, e.event, o_state AS state, o_k AS k, note FROM w JOIN e USING (job, rn)
  UNION ALL SELECT job, lost.t, lost.ev, 'failed', lost.k, 'no news' FROM w WHERE lost IS NOT NULL
  UNION ALL SELECT w.job, w.tm + {_PATIENCE}000000, w.ev, 'failed', w.k, 'no news' FROM w JOIN (SELECT job, max(rn) AS rn FROM e GROUP BY job) USING (job, rn)
    WHERE st <> '' AND (SELECT max(tm) FROM e) - w.tm > {_PATIENCE}000000)
SELECT job, make_timestamp(tm) AS ts, event, state, CAST(k AS INT) AS k, CAST(CASE WHEN k IS NOT NULL THEN 7 END AS INT) AS n, note FROM o"""
)
def x7_tracked_jobs(spark, sf_dir):
    """Users as jobs: refusals, progress and time-outs, by the fold that the stream uses."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _STATES.items() for x in kv]), F.col("event_type"))
    runs = F.col("event_type").isin("view", "click")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("event"), kind.alias("state"),
        F.when(runs, F.col("event_id") % 7).alias("k"), F.when(runs, 7).alias("n"),
    )
    return progress.tracked(events, _PATIENCE).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_MODELS_SQL = ", ".join(f"('{m}', '{channels.LANGUAGES[m.split('_')[0]]}')" for m in channels.MODELS)


@query(f"""WITH m(model, language) AS (VALUES {_MODELS_SQL}), d AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT model, language, coalesce(n, 0) AS n_documents FROM m LEFT JOIN d ON language = lang""")
def s11_models(spark, sf_dir):
    """The models, with how many documents each could read."""
    found = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("n"))
    return channels.models(spark).join(found, "language", "left").select("model", "language", F.coalesce("n", F.lit(0)).alias("n_documents"))


_PARTS = 16


@query(
    f"""WITH c AS (SELECT event_id, event_type AS model, CAST(round(value * 100) AS BIGINT) AS cost FROM events),
m AS (SELECT model, sum(cost) AS total FROM c GROUP BY model),
s AS (SELECT model, total, coalesce(sum(total) OVER (ORDER BY model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(total) OVER () / {_PARTS} AS width FROM m)
SELECT event_id, model, CAST(least({_PARTS - 1}, floor((before + ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 * total) / width)) AS INT) AS part FROM c JOIN s USING (model)"""
)
def c7_model_shares(spark, sf_dir):
    """Events as tasks of their type's model: where each runs so that models are loaded few times."""
    items = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), F.round(F.col("value") * 100).cast("long").alias("cost"))
    return channels.packed_by_model(items, _PARTS, name="event_id").select("event_id", "model", F.col("part"))

