"""Queries of the operators over the driver's tables, each with SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import align, attempts, channels, prompts, segment, signal, timeline
from ..sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as scripts: turns in order, parted by a blank line."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("script_id")).agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n\n").alias("text"))


# --- text -----------------------------------------------------------------------------

_KIND_SQL = r"""CASE WHEN line = '' THEN 'blank' WHEN starts_with(line, '#') OR starts_with(line, '//') THEN 'comment'
  WHEN regexp_full_match(line, '[-=_*~]{3,}') THEN 'rule'
  WHEN regexp_full_match(line, '(?i)\[\s*(?:nghi|nghỉ|pause)\s*[=:]?\s*([0-9]+(?:[.,][0-9]+)?)\s*s?\s*\]') THEN 'pause'
  WHEN regexp_full_match(line, '\[[^\]]{0,60}\]') THEN 'direction' ELSE 'content' END"""


@query(
    f"""WITH l AS (SELECT lang, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS line FROM documents)
SELECT lang, {_KIND_SQL} AS kind, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l GROUP BY ALL"""
)
def t2_line_kinds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(X.clean_text(F.col("text")), "\n")).alias("line"))
    line = X.trim_space(F.col("line"))
    return docs.select("lang", line.alias("line")).groupBy("lang", X.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


_SCRIPTS_SQL = "scripts AS (SELECT conv_id AS script_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
_BLOCKS_SQL = (
    _SCRIPTS_SQL
    + r""", l0 AS (SELECT script_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM scripts),
l AS (SELECT script_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM l0),
k AS (SELECT * FROM (SELECT *, """
    + _KIND_SQL
    + r""" AS kind FROM l) WHERE kind NOT IN ('comment', 'direction')),
f AS (SELECT *, kind = 'content' AND coalesce(lag(kind) OVER w, '') <> 'content' AS first FROM k WINDOW w AS (PARTITION BY script_id ORDER BY pos)),
b AS (SELECT *, sum(CAST(first AS INT)) OVER (PARTITION BY script_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM f),
v AS (SELECT *, CASE kind WHEN 'blank' THEN 0.85 WHEN 'rule' THEN 1.6 WHEN 'pause' THEN CAST(replace(regexp_extract(line, '[0-9]+(?:[.,][0-9]+)?'), ',', '.') AS DOUBLE) END AS v,
  max(CASE WHEN kind = 'pause' THEN pos END) OVER (PARTITION BY script_id, block) AS forced FROM b WHERE block > 0),
g AS (SELECT script_id, block, string_agg(line, ' ' ORDER BY pos) FILTER (kind = 'content') AS text, max(v) FILTER (forced IS NULL OR pos >= forced) AS pause FROM v GROUP BY script_id, block),
blocks AS (SELECT script_id, block, text, coalesce(greatest(pause, CASE WHEN block = max(block) OVER (PARTITION BY script_id) THEN 0.5 END), 0.5) AS pause FROM g)"""
)


@query(f"WITH {_BLOCKS_SQL} SELECT script_id, CAST(block AS BIGINT) AS block, text, CAST(pause AS DOUBLE) AS pause FROM blocks")
def t4_blocks(spark, sf_dir):
    rows = segment.blocks(scripts(spark, sf_dir))
    return rows.select("script_id", F.col("block").cast("long").alias("block"), "text", "pause")


def _sentences_sql(source: str) -> str:
    """CTEs that end in ``sents`` (id, seq, sentence), from ``source`` (id, text)."""
    abbreviations = ", ".join(f"'{a}'" for a in X.ABBREVIATIONS)
    return (
        f"tk0 AS (SELECT id, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM (SELECT id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM {source})),"
        r"""tk1 AS (SELECT *, lead(tok) OVER (PARTITION BY id ORDER BY pos) AS nxt, regexp_extract(tok, '([.!?…]+)["''”’)\]]*$', 1) AS term,
  regexp_extract(rtrim(tok, '.!?…"''”’)]'), '[^\s(\["''“‘]+$') AS word FROM tk0),
tk2 AS (SELECT *, strip_accents(lower(coalesce(last_value(nullif(word, '') IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING), ''))) AS lw FROM tk1),
tk3 AS (SELECT *, CASE WHEN term = '' THEN 0 WHEN regexp_matches(term, '[!?]') THEN 1"""
        f" WHEN length(lw) <= 1 OR lw IN ({abbreviations}) THEN 0"
        r""" WHEN regexp_matches(coalesce(nxt, ''), '^\p{Ll}') THEN 0 WHEN regexp_full_match(lw, '[0-9]+') AND regexp_matches(coalesce(nxt, ''), '^[0-9]') THEN 0 ELSE 1 END AS cut FROM tk2),
tk4 AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM tk3),
sents AS (SELECT id, CAST(1 + sid AS BIGINT) AS seq, string_agg(tok, ' ' ORDER BY pos) AS sentence FROM tk4 GROUP BY id, sid)"""
    )


@query(f"WITH src AS (SELECT doc_id AS id, text FROM documents), {_sentences_sql('src')} SELECT id AS doc_id, seq, sentence FROM sents")
def t8_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("seq", "sentence")).select("doc_id", (F.col("seq") + 1).cast("long").alias("seq"), "sentence")


_SEGMENTS_SQL = (
    _BLOCKS_SQL
    + ", src AS (SELECT script_id * 100000 + block AS id, text FROM blocks), "
    + _sentences_sql("src")
    + r""", seg AS (SELECT b.script_id, b.block, s.seq AS i, s.sentence AS text,
  CASE WHEN s.seq = max(s.seq) OVER (PARTITION BY b.script_id, b.block) THEN b.pause ELSE 0.3 END AS p
  FROM sents s JOIN blocks b ON s.id = b.script_id * 100000 + b.block),
segments AS (SELECT script_id, row_number() OVER w AS seq, text, CASE WHEN lead(text) OVER w IS NULL THEN 0.5 ELSE p END AS pause
  FROM seg WINDOW w AS (PARTITION BY script_id ORDER BY block, i))"""
)


@query(f"WITH {_SEGMENTS_SQL} SELECT script_id, CAST(seq AS INT) AS seq, text, CAST(pause AS DOUBLE) AS pause FROM segments")
def t9_segments(spark, sf_dir):
    return segment.segments(scripts(spark, sf_dir))


def marked_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as scripts whose turns are parted by blank lines, rules, pause markers and break tags, in turn."""
    after = F.element_at(F.array(*[F.lit(x) for x in _MARKS]), (F.col("turn") % len(_MARKS) + 1).cast("int"))
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat("text", after).alias("text"))))
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("script_id")).agg(F.array_join(F.transform(turns, lambda t: t["text"]), "").alias("text"))


#: What follows a turn, by its number: the separators, markers and tags of the script format.
_MARKS = (
    "\n\n", "\n---\n", "\n[pause: 1,5 s]\n", ' <break time="700ms"/> ', "\n# note\n[loud]\n\n[nghi=0.2]\n\n",
    ' <break/> <break strength="strong"/> ', "\n[nghỉ 2]\n***\n", " <b>bold</b> ",
)
_MARKED_SQL = (
    _BLOCKS_SQL.replace(
        _SCRIPTS_SQL,
        "scripts AS (SELECT conv_id AS script_id, string_agg(text || [" + ", ".join("'" + m.replace("\n", "' || chr(10) || '") + "'" for m in _MARKS) + f"][1 + turn % {len(_MARKS)}], '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)",
    )
    + r""", cut AS (SELECT *, string_split_regex(text, '<break[^>]*>') AS pieces, regexp_extract_all(text, '<break[^>]*>') AS tags FROM blocks),
fr AS (SELECT script_id, block, pause, len(pieces) AS n, unnest(range(1, len(pieces) + 1)) AS frag, unnest(pieces) AS piece, tags FROM cut),
fs AS (SELECT script_id, block, pause, frag, frag = n AS last, script_id * 10000000 + block * 1000 + frag AS id,
  trim(regexp_replace(regexp_replace(piece, '</?[a-zA-Z][^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text,
  CASE WHEN tags[frag] LIKE '%700ms%' THEN 0.7 WHEN tags[frag] LIKE '%strong%' THEN 0.9 WHEN tags[frag] IS NOT NULL THEN 0.5 END AS break_s FROM fr),
src AS (SELECT id, text FROM fs), """
    + _sentences_sql("src")
    + r""", rw AS (SELECT fs.*, s.seq AS i, s.sentence, CASE WHEN s.seq < max(s.seq) OVER (PARTITION BY fs.id) THEN 0.3 ELSE coalesce(break_s, CASE WHEN last THEN pause END, 0.3) END AS own FROM fs LEFT JOIN sents s USING (id)),
nm AS (SELECT *, count(sentence) OVER (PARTITION BY script_id ORDER BY block, frag, i ROWS UNBOUNDED PRECEDING) AS seq FROM rw),
gp AS (SELECT script_id, seq, max(sentence) AS text, max(own) FILTER (sentence IS NOT NULL) AS own, arg_max(break_s, block * 1000 + frag) FILTER (sentence IS NULL AND break_s IS NOT NULL) AS over FROM nm WHERE seq > 0 GROUP BY ALL)"""
)


@query(
    f"""WITH {_MARKED_SQL} SELECT script_id, CAST(seq AS INT) AS seq, text,
  CAST(CASE WHEN seq = max(seq) OVER (PARTITION BY script_id) THEN 0.5 ELSE coalesce(over, own) END AS DOUBLE) AS pause FROM gp"""
)
def t9_marked_segments(spark, sf_dir):
    """Segments of scripts with every kind of separator, marker, direction, comment and tag."""
    return segment.segments(marked_scripts(spark, sf_dir))


_TIMELINE_SQL = (
    _SEGMENTS_SQL
    + r""", smp AS (SELECT *, CAST(floor(greatest(0.4, length(text) / 15.0) * 24000) AS BIGINT) AS samples FROM segments),
tl AS (SELECT *, CAST(coalesce(sum(samples + CAST(floor(CAST(pause AS DOUBLE) * 24000) AS BIGINT)) OVER (PARTITION BY script_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s0 FROM smp)"""
)


@query(f"WITH {_TIMELINE_SQL} SELECT script_id, CAST(seq AS INT) AS seq, text, CAST(pause AS DOUBLE) AS pause, s0, s0 + samples AS s1 FROM tl")
def l1_timeline(spark, sf_dir):
    return timeline.timeline(segment.segments(scripts(spark, sf_dir)))


def _spans(spark, sf_dir):
    rows = timeline.timeline(segment.segments(scripts(spark, sf_dir)))
    return rows.withColumn("t0", F.col("s0") / timeline.RATE).withColumn("t1", F.col("s1") / timeline.RATE)


@query(
    f"WITH {_TIMELINE_SQL}"
    r""", sp AS (SELECT script_id, seq, s0 / 24000 AS a, (s0 + samples) / 24000 AS b, string_split(text, ' ') AS w FROM tl),
wd AS (SELECT script_id, seq, a, b, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM sp),
cum AS (SELECT *, sum(greatest(length(word), 1)) OVER (PARTITION BY script_id, seq) AS total,
  sum(greatest(length(word), 1)) OVER (PARTITION BY script_id, seq ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM wd)
SELECT script_id, CAST(seq AS INT) AS seq, CAST(pos AS INT) AS pos, word, CAST(floor((a + (b - a) * (upto - greatest(length(word), 1)) / total) * 1e4 + 0.5) AS BIGINT) AS t0_e4, CAST(floor((a + (b - a) * upto / total) * 1e4 + 0.5) AS BIGINT) AS t1_e4 FROM cum"""
)
def l5_word_times(spark, sf_dir):
    rows = timeline.word_times(_spans(spark, sf_dir))
    return rows.select("script_id", "seq", "pos", "word", *[F.floor(F.col(t) * 1e4 + 0.5).alias(f"{t}_e4") for t in ("t0", "t1")])


_CUES_SQL = (
    _TIMELINE_SQL
    + r""", sp AS (SELECT script_id, seq, s0 / 24000 AS a, (s0 + samples) / 24000 AS b, string_split(text, ' ') AS w FROM tl),
wd AS (SELECT script_id, seq, a, b, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM sp),
cum AS (SELECT *, sum(greatest(length(word), 1)) OVER (PARTITION BY script_id, seq) AS total,
  sum(greatest(length(word), 1)) OVER (PARTITION BY script_id, seq ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM wd),
timed AS (SELECT script_id, seq, pos, word, a, b, a + (b - a) * (upto - greatest(length(word), 1)) / total AS t0, a + (b - a) * upto / total AS t1 FROM cum),
held AS (SELECT script_id, seq, pos, word, b, least(greatest(t0, a), b) AS t0, least(greatest(t1, least(greatest(t0, a), b) + 0.05), b) AS t1 FROM timed WHERE pos = 0
UNION ALL SELECT x.script_id, x.seq, x.pos, x.word, x.b, least(greatest(x.t0, h.t1), x.b), least(greatest(x.t1, least(greatest(x.t0, h.t1), x.b) + 0.05), x.b)
  FROM held h JOIN timed x ON x.script_id = h.script_id AND x.seq = h.seq AND x.pos = h.pos + 1),
packed AS (SELECT script_id, seq, pos, word, t0, t1, 0 AS k, t0 AS began, length(word) + 1 AS chars, regexp_matches(word, '[,;:—–]$') AND length(word) > 50.4 AS shut FROM held WHERE pos = 0
UNION ALL SELECT x.script_id, x.seq, x.pos, x.word, x.t0, x.t1, p.k + CAST(fresh AS INT), CASE WHEN fresh THEN x.t0 ELSE p.began END,
  CASE WHEN fresh THEN 0 ELSE p.chars END + length(x.word) + 1, regexp_matches(x.word, '[,;:—–]$') AND planned > 50.4
  FROM (SELECT *, pos + 1 AS next FROM packed) p JOIN held x ON x.script_id = p.script_id AND x.seq = p.seq AND x.pos = p.next,
  LATERAL (SELECT CASE WHEN p.shut THEN 0 ELSE p.chars END + length(x.word) AS planned), LATERAL (SELECT p.shut OR planned > 84 OR x.t1 - p.began > 6.0 AS fresh)),
lined AS (SELECT script_id, seq, k, min(t0) AS t0, max(t1) AS t1, string_agg(word, ' ' ORDER BY pos) AS x, list(word ORDER BY pos) AS w FROM packed GROUP BY ALL),
half AS (SELECT *, greatest(1, len(list_filter(range(1, len(w) + 1), lambda k: length(array_to_string(w[1 : k], ' ')) <= length(x) / 2))) AS n FROM lined),
wrapped AS (SELECT *, CASE WHEN length(x) <= 42 OR n >= len(w) THEN x ELSE array_to_string(w[1 : n], ' ') || chr(10) || array_to_string(w[n + 1 : len(w)], ' ') END AS text,
  lead(t0) OVER (PARTITION BY script_id ORDER BY seq, k) AS next FROM half),
cues AS (SELECT script_id, CAST(row_number() OVER (PARTITION BY script_id ORDER BY seq, k) AS INT) AS cue_no, t0,
  CASE WHEN t1 - t0 < 0.9 THEN greatest(t1, least(t0 + 0.9, coalesce(next - 0.04, t1 + 0.9))) ELSE t1 END AS t1, text FROM wrapped)"""
)


@query(
    f"""WITH RECURSIVE {_CUES_SQL}
SELECT script_id, cue_no, CAST(floor(t0 * 1e4 + 0.5) AS BIGINT) AS t0_e4, CAST(floor(t1 * 1e4 + 0.5) AS BIGINT) AS t1_e4, text FROM cues"""
)
def l7_cues(spark, sf_dir):
    rows = timeline.cues(_spans(spark, sf_dir))
    return rows.select("script_id", "cue_no", *[F.floor(F.col(t) * 1e4 + 0.5).alias(f"{t}_e4") for t in ("t0", "t1")], "text")


def _stamp_sql(t: str) -> str:
    ms = f"CAST(round_even(greatest({t}, 0) * 1000, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query(
    f"""WITH RECURSIVE {_CUES_SQL}
SELECT script_id, string_agg(cue_no || chr(10) || {_stamp_sql("t0")} || ' --> ' || {_stamp_sql("t1")} || chr(10) || text || chr(10), chr(10) ORDER BY cue_no) AS srt FROM cues GROUP BY script_id"""
)
def k2_subtitles(spark, sf_dir):
    return timeline.srt(timeline.cues(_spans(spark, sf_dir)))


#: Alignment of the lists x and y of ``both_``: tables row by row, then the way back (``mi`` of x meets ``mj`` of y).
_ALIGN_SQL = """grid AS (SELECT script_id, seq, x, y, 0 AS i, list_transform(range(0, len(y) + 1), lambda j: -1.0 * j) AS cur, CAST([] AS DOUBLE[]) AS sc, CAST([] AS INT[]) AS moves FROM both_
UNION ALL SELECT script_id, seq, x, y, i, cur, sc, list_transform(range(1, len(y) + 1), lambda j: CASE WHEN cur[j + 1] = prev[j] + sc[j] THEN 0 WHEN cur[j + 1] = prev[j + 1] - 1.0 THEN 1 ELSE 2 END)
  FROM (SELECT *, list_reduce(list_transform(range(1, len(y) + 1), lambda j: [CAST(j AS DOUBLE)]),
    lambda acc, v: list_append(acc, greatest(prev[CAST(v[1] AS INT)] + sc[CAST(v[1] AS INT)], prev[CAST(v[1] AS INT) + 1] - 1.0, acc[-1] - 1.0)), [-1.0 * i]) AS cur
    FROM (SELECT script_id, seq, x, y, i + 1 AS i, cur AS prev, list_transform(y, lambda w: CASE WHEN x[i + 1] <> '' AND x[i + 1] = w THEN 2.0 WHEN x[i + 1] <> '' AND w <> '' AND left(x[i + 1], 3) = left(w, 3) THEN 0.6 ELSE -1.2 END) AS sc
      FROM grid WHERE i < len(x)))),
steps AS MATERIALIZED (SELECT script_id, seq, i, list_transform(range(1, len(moves) + 1), lambda j: CASE WHEN moves[j] = 0 AND sc[j] > 0 THEN 3 ELSE moves[j] END) AS moves FROM grid WHERE i > 0),
path AS (SELECT script_id, seq, CAST(len(x) AS BIGINT) AS i, CAST(len(y) AS BIGINT) AS j, CAST(NULL AS BIGINT) AS mi, CAST(NULL AS BIGINT) AS mj FROM both_
UNION ALL SELECT p.script_id, p.seq, CASE WHEN g.moves[p.j] = 2 THEN p.i ELSE p.i - 1 END, CASE WHEN g.moves[p.j] = 1 THEN p.j ELSE p.j - 1 END,
  CASE WHEN g.moves[p.j] = 3 THEN p.i END, CASE WHEN g.moves[p.j] = 3 THEN p.j END
  FROM path p JOIN steps g ON g.script_id = p.script_id AND g.seq = p.seq AND g.i = p.i WHERE p.i > 0 AND p.j > 0)"""


@query(
    f"""WITH RECURSIVE {_CUES_SQL},
both_ AS (SELECT script_id, seq, list(norm ORDER BY pos) AS x, list(norm ORDER BY pos) FILTER (pos % 7 <> 3) AS y, list(t0 ORDER BY pos) FILTER (pos % 7 <> 3) AS h0, list(t1 ORDER BY pos) FILTER (pos % 7 <> 3) AS h1
  FROM (SELECT *, regexp_replace(strip_accents(lower(word)), '[^0-9a-z]', '', 'g') AS norm FROM timed) GROUP BY ALL),
{_ALIGN_SQL}
SELECT t.script_id, CAST(t.seq AS INT) AS seq, CAST(t.pos AS INT) AS pos, t.word, CAST(floor(h0[mj] * 1e4 + 0.5) AS BIGINT) AS t0_e4, CAST(floor(h1[mj] * 1e4 + 0.5) AS BIGINT) AS t1_e4
FROM timed t JOIN both_ USING (script_id, seq) LEFT JOIN (SELECT * FROM path WHERE mi IS NOT NULL) m ON m.script_id = t.script_id AND m.seq = t.seq AND m.mi = t.pos + 1"""
)
def l4_alignment(spark, sf_dir):
    """Script words against what a recognizer would hear that drops each seventh word."""
    words = timeline.word_times(_spans(spark, sf_dir)).withColumn("norm", X.normalize_word(F.col("word")))
    item = F.struct("pos", "word", "norm", "t0", "t1")
    heard = F.when(F.col("pos") % 7 != 3, item)
    rows = words.groupBy("script_id", "seq").agg(F.array_sort(F.collect_list(item)).alias("all"), F.array_sort(F.collect_list(heard)).alias("some"))
    found = align.aligned_times(
        rows.select("script_id", "seq", F.col("all.word").alias("words"), F.col("all.norm").alias("norms"), F.col("some.norm").alias("heard"), F.col("some.t0").alias("t0"), F.col("some.t1").alias("t1"))
    )
    return found.select("script_id", "seq", "pos", "word", *[F.floor(F.col(t) * 1e4 + 0.5).alias(f"{t}_e4") for t in ("t0", "t1")])


#: Times of words that have none (see ``timeline.fill_times``), from ``known`` to ``filled``.
_FILL_SQL = """around AS (SELECT *, coalesce(last_value(t1 IGNORE NULLS) OVER (PARTITION BY script_id, seq ORDER BY pos ROWS UNBOUNDED PRECEDING), a) AS l,
  coalesce(first_value(t0 IGNORE NULLS) OVER (PARTITION BY script_id, seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b) AS r,
  count(t0) OVER (PARTITION BY script_id, seq ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run, greatest(length(word), 1) AS size FROM known),
share AS (SELECT *, sum(CASE WHEN t0 IS NULL THEN size END) OVER w AS total, sum(CASE WHEN t0 IS NULL THEN size END) OVER (PARTITION BY script_id, seq, run ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto,
  count(*) FILTER (t0 IS NULL) OVER w AS n FROM around WINDOW w AS (PARTITION BY script_id, seq, run)),
gap AS (SELECT *, CASE WHEN r > l THEN r - l ELSE 0.12 * n END AS g FROM share),
filled AS (SELECT script_id, seq, pos, word, a, b, coalesce(t0, l + g * (upto - size) / total) AS t0, coalesce(t1, l + g * upto / total) AS t1 FROM gap)"""
_TIMED_SQL, _PACK_SQL = _CUES_SQL[: _CUES_SQL.index(",\nheld AS")], _CUES_SQL[_CUES_SQL.index(",\nheld AS") :]


@query(
    f"""WITH RECURSIVE {_TIMED_SQL},
nt AS (SELECT *, regexp_replace(strip_accents(lower(word)), '[^0-9a-z]', '', 'g') AS norm FROM timed),
said AS (SELECT script_id, seq, list(norm ORDER BY pos) AS x FROM nt GROUP BY ALL),
heard AS (SELECT script_id, norm AS h, t0 + 0.1 AS h0, t1 + 0.1 AS h1 FROM nt WHERE pos % 7 <> 3),
near AS (SELECT DISTINCT script_id, seq, a - 0.25 AS a0, b + 0.25 AS b0 FROM timed),
met AS (SELECT script_id, seq, list(h ORDER BY h0, h1, h) AS y, list(h0 ORDER BY h0, h1, h) AS h0, list(h1 ORDER BY h0, h1, h) AS h1 FROM near JOIN heard USING (script_id) WHERE h1 > a0 AND h0 < b0 GROUP BY ALL),
both_ AS (SELECT script_id, seq, x, coalesce(y, []) AS y, h0, h1 FROM said LEFT JOIN met USING (script_id, seq)),
{_ALIGN_SQL},
known AS (SELECT t.script_id, t.seq, t.pos, t.word, t.a, t.b, h0[mj] AS t0, h1[mj] AS t1
  FROM timed t JOIN both_ USING (script_id, seq) LEFT JOIN (SELECT * FROM path WHERE mi IS NOT NULL) m ON m.script_id = t.script_id AND m.seq = t.seq AND m.mi = t.pos + 1),
{_FILL_SQL}{_PACK_SQL.replace("FROM timed", "FROM filled").replace("JOIN timed", "JOIN filled")}
SELECT script_id, cue_no, CAST(floor(t0 * 1e4 + 0.5) AS BIGINT) AS t0_e4, CAST(floor(t1 * 1e4 + 0.5) AS BIGINT) AS t1_e4, text FROM cues"""
)
def l10_speech_timing(spark, sf_dir):
    """From recognized words to cues: words meet their segments, are aligned, gaps are filled, and cues packed.

    The recognizer is played by the spoken words a tenth of a second late, each seventh
    missing; words lie in a segment that they overlap within 0.25 s. Segments and words are used many times
    and therefore written once.
    """
    spans = written(_spans(spark, sf_dir).select("script_id", "seq", "text", "t0", "t1"), "spans")
    words = written(timeline.word_times(spans).withColumn("norm", X.normalize_word(F.col("word"))), "words")
    heard = words.where("pos % 7 <> 3").select("script_id", F.col("norm").alias("h"), (F.col("t0") + 0.1).alias("h0"), (F.col("t1") + 0.1).alias("h1"))
    near = spans.select("script_id", "seq", (F.col("t0") - 0.25).alias("a0"), (F.col("t1") + 0.25).alias("b0"))
    met = timeline.interval_join(heard, near, ["script_id"], ("h0", "h1"), ("a0", "b0"), 10.0)
    met = met.groupBy("script_id", "seq").agg(F.array_sort(F.collect_list(F.struct("h0", "h1", "h"))).alias("some"))
    said = words.groupBy("script_id", "seq").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "norm"))).alias("all"))
    pairs = said.join(met, ["script_id", "seq"], "left").select(
        "script_id", "seq", F.col("all.word").alias("words"), F.col("all.norm").alias("norms"),
        *[F.coalesce(F.col(f"some.{c}"), F.array().cast(f"array<{kind}>")).alias(name) for c, name, kind in (("h", "heard", "string"), ("h0", "t0", "double"), ("h1", "t1", "double"))],
    )
    timed = align.aligned_times(pairs).join(spans.select("script_id", "seq", F.col("t0").alias("a"), F.col("t1").alias("b")), ["script_id", "seq"])
    rows = timeline.cues(spans, timeline.fill_times(timed))
    return rows.select("script_id", "cue_no", *[F.floor(F.col(t) * 1e4 + 0.5).alias(f"{t}_e4") for t in ("t0", "t1")], "text")


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(greatest(CAST(value AS DOUBLE) / 10, 0), 30)
  WHEN event_id % 3 = 1 THEN least(greatest(floor(value) / 1000, 0), 30)
  ELSE CASE event_id % 5 WHEN 0 THEN 0.1 WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 3 THEN 0.9 ELSE 1.5 END END AS seconds FROM events"""
)
def t6_break_seconds(spark, sf_dir):
    """Break tags of three kinds made from event values."""
    e = table(spark, sf_dir, "events")
    strength = F.element_at(F.array(*[F.lit(s) for s in ("x-weak", "weak", "medium", "strong", "x-strong")]), (F.col("event_id") % 5 + 1).cast("int"))
    tag = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('<break time="'), (F.col("value") / 10).cast("decimal(20,6)").cast("string"), F.lit('s"/>')))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("<BREAK time='"), F.floor("value").cast("string"), F.lit("ms' />")))
        .otherwise(F.concat(F.lit('<break strength="'), strength, F.lit('"/>')))
    )
    return e.select("event_id", X.break_seconds(tag).alias("seconds"))


@query(
    r"""WITH w AS (SELECT lang, regexp_replace(strip_accents(lower(unnest(string_split_regex(text, '\s+')))), '[^0-9a-z]', '', 'g') AS word FROM documents)
SELECT lang, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL"""
)
def t13_normalized_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = docs.select("lang", F.explode(F.split("text", X.SPACE)).alias("w")).select("lang", X.normalize_word(F.col("w")).alias("word"))
    return words.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))


@query(
    r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(strip_accents(text), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS whole FROM documents),
c AS (SELECT *, regexp_replace(left(whole, 46), '_+$', '') AS cut FROM s)
SELECT doc_id, printf('%03d_', CAST(doc_id AS BIGINT)) || CASE WHEN whole = '' THEN 'anh' WHEN length(whole) <= 46 THEN lower(whole)
  WHEN contains(substring(cut, 28), '_') THEN lower(regexp_replace(cut, '_[^_]*$', '')) ELSE lower(cut) END || '.png' AS name FROM c"""
)
def t15_output_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.output_name(F.col("doc_id"), F.col("text")).alias("name"))


@query(
    """WITH m AS (SELECT event_id, CAST(round_even(greatest(value, 0) * 1000, 0) AS BIGINT) AS ms FROM events)
SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp FROM m"""
)
def t17_time_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.srt_time(F.col("value")).alias("stamp"))


@query("SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS INT) AS n_words FROM conversations")
def t18_word_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.word_count(F.col("text")).alias("n_words"))


# --- prompts ---------------------------------------------------------------------------


@query(
    "WITH "
    + _SCRIPTS_SQL
    + r""", l0 AS (SELECT script_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM scripts),
l AS (SELECT script_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM l0),
b AS (SELECT *, sum(CAST(line = '' AS INT)) OVER (PARTITION BY script_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM l),
k AS (SELECT * FROM b WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '//')),
m AS (SELECT script_id, count(DISTINCT block) AS nb, count(*) AS nl FROM k GROUP BY 1),
p AS (SELECT k.script_id, CASE WHEN nb >= 2 AND nl / nb > 1.3 THEN block ELSE pos END AS part, string_agg(line, ' ' ORDER BY pos) AS source FROM k JOIN m USING (script_id) GROUP BY ALL)
SELECT CAST(script_id AS VARCHAR) AS file_name, CAST(row_number() OVER (PARTITION BY script_id ORDER BY part) AS INT) AS number, source FROM p"""
)
def t10_prompts(spark, sf_dir):
    files = scripts(spark, sf_dir).select(F.col("script_id").cast("string").alias("file_name"), "text")
    return prompts.parse_prompts(files).select("file_name", "number", "source")


#: Prompt texts for the router; the query deals them to events.
_SCENES = (
    "an empty street at dawn, no people", "a woman by the window", "two monks without the crowd", "statue in the park",
    "no person but people far away", "uma multidão rezando", "sem pessoas na praia", "golden wheat field", "a man and a silhouette",
    "shadows on a wall, no one", "free of any humans, a chapel", "handmade pottery on a table",
)


def _route_sql() -> str:
    scenes = ", ".join("'" + s + "'" for s in _SCENES)
    deny = rf"(?:{'|'.join(prompts.DENIALS)})(?:\s+(?:{'|'.join(prompts.ARTICLES)})){{0,2}}\s*"
    lists = " UNION ALL ".join(
        f"SELECT {k} AS grp, unnest([{', '.join(repr(w) for w in words)}]) AS kw, generate_subscripts([{', '.join(repr(w) for w in words)}], 1) AS ord"
        for k, words in ((1, prompts.PEOPLE), (2, prompts.UNSURE))
    )
    return f"""WITH e AS (SELECT event_id, event_id % 11 = 0 AS tagged, CASE event_id % 17 WHEN 0 THEN 'gemini' WHEN 1 THEN 'pollinations' ELSE 'auto' END AS model,
  strip_accents(lower([{scenes}][1 + event_id % {len(_SCENES)}])) AS t FROM events),
kw AS ({lists}),
texts AS (SELECT DISTINCT t FROM e),
hit AS (SELECT t, arg_min(kw, grp * 1000 + ord) AS kw, min(grp) AS grp FROM texts, kw
  WHERE regexp_matches(regexp_replace(t, '{deny}' || kw || '($|[^a-z0-9])', '|', 'g'), '(^|[^a-z0-9])' || kw || '($|[^a-z0-9])') GROUP BY t)
SELECT event_id, CASE WHEN model <> 'auto' THEN model WHEN tagged OR kw IS NOT NULL THEN 'gemini' ELSE 'pollinations' END AS engine,
  CASE WHEN model <> 'auto' THEN 'forced: ' || model WHEN tagged THEN 'tagged' WHEN grp = 1 THEN 'person: ' || kw
  WHEN grp = 2 THEN 'maybe: ' || kw ELSE 'nobody' END AS reason
FROM e LEFT JOIN hit USING (t)"""


@query(_route_sql())
def p1_routing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    scene = F.element_at(F.array(*[F.lit(s) for s in _SCENES]), (F.col("event_id") % len(_SCENES) + 1).cast("int"))
    model = F.when(F.col("event_id") % 17 == 0, "gemini").when(F.col("event_id") % 17 == 1, "pollinations").otherwise("auto")
    rows = e.select("event_id", scene.alias("text"), (F.col("event_id") % 11 == 0).alias("tagged"), model.alias("model"))
    return prompts.route(rows).select("event_id", "engine", "reason")


# --- channels and queues -----------------------------------------------------------------


@query(
    r"""SELECT p_partkey, upper(coalesce(nullif(regexp_extract(replace(p_name, ' ', '_'), '^([A-Za-z0-9]+)[_\-. ]', 1), ''), replace(p_name, ' ', '_'))) AS key FROM part"""
)
def c1_channel_keys(spark, sf_dir):
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(".txt"))
    return table(spark, sf_dir, "part").select("p_partkey", X.image_channel_key(name).alias("key"))


@query(
    """SELECT c_custkey, CASE WHEN n_nationkey % 3 = 0 THEN 'spanish' WHEN n_nationkey % 3 = 1 THEN NULL ELSE 'english' END AS model,
  CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE '1.0' END AS speed, n_nationkey IS NOT NULL AS known
FROM customer LEFT JOIN nation ON CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END = n_nationkey"""
)
def c3_settings(spark, sf_dir):
    """Every fifth item belongs to a channel that is not declared."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    text = "map<string,string>"
    model = F.when(k % 3 == 0, F.create_map(F.lit("model"), F.lit("spanish"))).when(k % 3 == 1, F.create_map(F.lit("model"), F.lit(None).cast("string"))).otherwise(F.create_map().cast(text))
    speed = F.when(k % 2 == 0, F.create_map(F.lit("speed"), k.cast("string"))).otherwise(F.create_map().cast(text))
    dimension = n.select(k.cast("string").alias("channel"), F.map_concat(model, speed).alias("settings"))
    key = F.when(F.col("c_custkey") % 5 == 0, -1).otherwise(F.col("c_nationkey")).cast("string")
    items = table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"))
    out = channels.resolve(items, dimension, {"model": "english", "speed": "1.0"})
    return out.select("c_custkey", "config.model", "config.speed", "known")


@query(
    """SELECT o_orderkey, CAST(coalesce(list_position(['1-URGENT', '2-HIGH'], o_orderpriority) - 1, 2) AS INT) AS priority,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(list_position(['1-URGENT', '2-HIGH'], o_orderpriority) - 1, 2), o_orderkey) AS INT) AS place FROM orders"""
)
def c8_priorities(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders").withColumn("priority", channels.priority(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]))
    return rows.select("o_orderkey", "priority", F.row_number().over(Window.partitionBy("o_custkey").orderBy("priority", "o_orderkey")).alias("place"))


@query(
    """SELECT d.source, count(*) AS n_waiting, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality >= 1) GROUP BY d.source"""
)
def c9_unfinished(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("bytes"))
    rows = channels.unfinished(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), done, "doc_id", 1)
    return rows.groupBy("source").agg(F.count("*").alias("n_waiting"), F.sum("n_chars").alias("n_chars"))


@query(
    """WITH v AS (SELECT DISTINCT upper(split_part(p_name, ' ', 1)) AS stem, split_part(p_name, ' ', 1) || '.wav' AS file FROM part),
c AS (SELECT DISTINCT c_mktsegment AS channel, CASE WHEN length(c_mktsegment) % 2 = 0 THEN 'COLD' ELSE 'NOBODY' END AS voice FROM customer)
SELECT 'ok' AS kind, channel AS name FROM c WHERE voice IN (SELECT stem FROM v)
UNION ALL SELECT 'missing voice', channel FROM c WHERE voice NOT IN (SELECT stem FROM v)
UNION ALL SELECT 'unused voice', file FROM v WHERE stem NOT IN (SELECT voice FROM c)"""
)
def c11_audit(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(".wav")).alias("file")).distinct()
    named = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("channel")).distinct()
    return channels.audit(named.withColumn("voice", F.when(F.length("channel") % 2 == 0, "cold").otherwise("nobody")), files)


@query(
    r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages)
SELECT path, min(page_id) AS page_id FROM p GROUP BY path"""
)
def s1_queue(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return channels.first_per_path(pages, "path", "page_id").select("path", "page_id")


@query(
    """SELECT event_type, CAST(count(*) FILTER (value >= 50) AS BIGINT) AS n_ok, CAST(count(*) FILTER (NOT value >= 50) AS BIGINT) AS n_failed,
  count(*) AS n_all, round(sum(value), 2) AS seconds FROM events GROUP BY event_type"""
)
def g1_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") >= 50).alias("ok"), F.col("value").alias("seconds"))
    return channels.summary(e, ["event_type"]).withColumn("seconds", F.round("seconds", 2))


# --- joins and attempts ---------------------------------------------------------------------


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t FROM events)
SELECT v.event_id AS view_id, c.event_id AS click_id FROM e v JOIN e c ON v.user_id = c.user_id AND v.event_type = 'view' AND c.event_type = 'click'
AND v.t + 600 > c.t - 600 AND v.t - 600 < c.t + 600"""
)
def l3_interval_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))

    def side(kind, p):
        return e.where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{kind}_id"), "user_id", (F.col("t") - 600).alias(f"{p}0"), (F.col("t") + 600).alias(f"{p}1"))

    return timeline.interval_join(side("view", "a"), side("click", "b"), ["user_id"], ("a0", "a1"), ("b0", "b1"), 1200.0).select("view_id", "click_id")


@query(
    """WITH e AS (SELECT *, event_type <> 'error' AS ok, epoch_us(ts) / 1e6 AS t FROM events),
r AS (SELECT *, coalesce(sum(CAST(ok AS INT)) OVER w, 0) AS run, greatest(0.0, max(t + 30 * value) OVER w - t) AS cooling
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1 AS k FROM r)
SELECT event_id, CAST(k AS INT) AS k, CASE WHEN NOT ok THEN round(greatest(CAST(least(60 * pow(2, k), 900) AS DOUBLE), coalesce(cooling, 0)), 3) END AS wait FROM k"""
)
def x3_backoff(spark, sf_dir):
    """Failed calls wait by their number since the last success, or until the key is free that earlier calls heat up."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", (F.col("event_type") != "error").alias("ok"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    log = e.withColumn("cooling", F.greatest(F.lit(0.0), F.max(F.col("t") + 30 * F.col("value")).over(before) - F.col("t")))
    return attempts.backoff(log, cooling=F.coalesce("cooling", F.lit(0.0))).select("event_id", "k", F.round("wait", 3).alias("wait"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, t AS start FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_id, e.n, greatest(e.t, r.start + 900) FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, round(start, 3) AS start FROM r"""
)
def l11_spaced_calls(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    e = e.withColumn("order", F.struct("ts", "event_id"))
    return attempts.spaced_starts(e, 900.0, "user_id", "order", "t").select("event_id", F.round("start", 3).alias("start"))


_CODES = "[429, 401, 400, 400, 400, 404, 503, 418, 403, 200][1 + event_id % 10]"
_MESSAGES = "['quota', '', 'API key not valid.', 'Unknown name \"imageSize\"', 'bad request', 'no model', 'busy', 'teapot', '', ''][1 + event_id % 10]"


@query(
    f"""WITH e AS (SELECT event_id, {_CODES} AS code, {_MESSAGES} AS message, CASE WHEN event_id % 13 = 0 THEN 'RESOURCE_EXHAUSTED' ELSE '' END AS reason FROM events)
SELECT event_id, CASE WHEN code = 429 OR reason = 'RESOURCE_EXHAUSTED' THEN 'quota' WHEN code IN (401, 403) THEN 'dead key'
  WHEN code = 400 AND contains(message, 'API key not valid') THEN 'dead key' WHEN code = 400 AND contains(message, 'imageSize') THEN 'transient'
  WHEN code >= 500 THEN 'transient' ELSE 'permanent' END AS outcome,
  CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 90 + 2 AS DOUBLE) ELSE 60.0 END AS wait_s FROM e"""
)
def p10_error_classes(spark, sf_dir):
    k = (F.col("event_id") % 10 + 1).cast("int")
    code = F.element_at(F.array(*[F.lit(c) for c in (429, 401, 400, 400, 400, 404, 503, 418, 403, 200)]), k)
    messages = ("quota", "", "API key not valid.", 'Unknown name "imageSize"', "bad request", "no model", "busy", "teapot", "", "")
    message = F.element_at(F.array(*[F.lit(m) for m in messages]), k)
    reason = F.when(F.col("event_id") % 13 == 0, "RESOURCE_EXHAUSTED").otherwise("")
    delay = F.when(F.col("event_id") % 4 == 0, F.concat((F.col("event_id") % 90).cast("string"), F.lit("s"))).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", attempts.error_class(code, reason, message).alias("outcome"), attempts.retry_delay(delay).alias("wait_s"))


_OUTCOME = {"error": "transient", "signup": "permanent", "click": "transient", "view": "ok", "purchase": "ok"}


@query()
def x4_retries(spark, sf_dir):
    """Each user's events as the outcomes of one prompt's calls."""
    outcome = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _OUTCOME.items()])
    calls = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", outcome.alias("o")))).alias("calls"))
    settled = attempts.settle(F.transform("calls", lambda x: x["o"]), F.when(F.col("user_id") % 3 == 0, "pollinations").otherwise("gemini"), F.col("user_id") % 2 == 0)
    return calls.select("user_id", settled.alias("s")).select("user_id", "s.*")


@query()
def x1_key_ring(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "error", "quota").otherwise("ok")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return attempts.key_ring(e.select(F.col("user_id").alias("ring"), F.col("event_id").alias("call"), at.alias("at"), outcome.alias("outcome"), F.col("value").alias("wait_s")))


def _job_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("event"), F.col("event_type").alias("state"))


@query(
    """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, user_id AS job, last(event_type ORDER BY ts, event_id) AS state, count(*) AS n FROM events GROUP BY ALL"""
)
def x7_job_states(spark, sf_dir):
    from ..streaming import jobs

    return jobs.job_states(_job_events(spark, sf_dir)).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "job", "state", "n")


@query("SELECT user_id AS job, last(event_type ORDER BY ts, event_id) AS state, CAST(max(ts) AS TIMESTAMP) AS since FROM events GROUP BY user_id")
def x7_latest_states(spark, sf_dir):
    from ..streaming import jobs

    return jobs.latest_states(_job_events(spark, sf_dir)).withColumn("since", F.col("since").cast("timestamp_ntz"))


@query(
    """WITH g AS (SELECT o_orderkey, 100 + o_orderkey % 3000 AS w, 100 + (o_orderkey * 7) % 2000 AS h FROM orders),
s AS (SELECT o_orderkey, greatest(CAST(round_even(w * greatest(1920 / w, 1080 / h), 0) AS INT), 1920) AS w, greatest(CAST(round_even(h * greatest(1920 / w, 1080 / h), 0) AS INT), 1080) AS h FROM g)
SELECT o_orderkey, w, h, CAST((w - 1920) // 2 AS BIGINT) AS x, CAST((h - 1080) // 2 AS BIGINT) AS y FROM s"""
)
def p7_cover_crop(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", attempts.cover_crop(100 + k % 3000, 100 + (k * 7) % 2000).alias("c")).select("o_orderkey", "c.*")


# --- signal -----------------------------------------------------------------------------------


@query(
    """SELECT vec_id, round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS peak,
  round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(embedding), 6) AS mean_square FROM embeddings"""
)
def g4_levels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(signal.peak(F.col("embedding")), 6).alias("peak"), F.round(signal.mean_square(F.col("embedding")), 6).alias("mean_square"))


_FRAMES = "list_transform(range(0, 8), lambda k: list_max(list_transform(embedding[k * 8 + 1 : k * 8 + 8], lambda x: abs(CAST(x AS DOUBLE)))))"


@query(
    f"""WITH f AS (SELECT vec_id, unnest({_FRAMES}) AS peak, generate_subscripts({_FRAMES}, 1) - 1 AS frame FROM embeddings)
SELECT vec_id, CAST(frame AS INT) AS frame, round(peak, 6) AS peak FROM f"""
)
def g8_frame_peaks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", signal.frame_peaks(F.col("embedding"), F.lit(8)).alias("p"))
    return e.select("vec_id", F.posexplode("p").alias("frame", "peak")).withColumn("peak", F.round("peak", 6))


@query(
    f"""WITH f AS (SELECT vec_id, {_FRAMES} AS p FROM embeddings),
l AS (SELECT vec_id, list_transform(p, lambda x: x > greatest(0.15, list_max(p) * 0.02)) AS loud FROM f)
SELECT vec_id, CASE WHEN list_contains(loud, true) THEN greatest(0, (list_position(loud, true) - 1) * 8 - 3) ELSE 0 END AS first,
  CASE WHEN list_contains(loud, true) THEN least(64, (8 - list_position(list_reverse(loud), true) + 1) * 8 + 3) ELSE 64 END AS last FROM l"""
)
def d1_trim(spark, sf_dir):
    import math

    pcm = F.col("embedding")
    e = table(spark, sf_dir, "embeddings").withColumn("p", signal.frame_peaks(pcm, F.lit(8)))
    cut = signal.trim_bounds(F.col("p"), F.size(pcm), F.lit(8), F.lit(100), 20 * math.log10(0.15), 0.03)
    return e.select("vec_id", cut.alias("c")).select("vec_id", F.col("c.first").cast("long").alias("first"), F.col("c.last").cast("long").alias("last"))


@query(
    """WITH r AS (SELECT vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(embedding)) + 1e-9 AS rms FROM embeddings)
SELECT vec_id, CASE WHEN count(*) OVER (PARTITION BY label) < 2 THEN 0.0 ELSE round(greatest(-4.0, least(4.0, 20 * log10(median(rms) OVER (PARTITION BY label) / rms))), 4) + 0.0 END AS gain_db FROM r"""
)
def d15_level_gain(spark, sf_dir):
    return signal.level_gain(table(spark, sf_dir, "embeddings"), "label", "embedding").select("vec_id", (F.round("gain_db", 4) + 0.0).alias("gain_db"))


@query(
    """WITH n AS (SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS p, embedding FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE) * (pow(10, -0.05) / p)))), 4) AS total,
  round(list_sum(list_transform(range(0, 64), lambda i: abs(CAST(embedding[i + 1] AS DOUBLE)) * least(i / 7, 1.0) * least((63 - i) / 7, 1.0))), 4) AS faded FROM n"""
)
def d5_normalize_fade(spark, sf_dir):
    pcm = F.col("embedding")
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x)), 4)
    return table(spark, sf_dir, "embeddings").select("vec_id", total(signal.normalize_peak(pcm)).alias("total"), total(signal.fade(pcm, F.lit(8))).alias("faded"))


@query(
    """WITH f AS (SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS top,
  len(list_filter(embedding, lambda x: abs(CAST(x AS DOUBLE)) >= 0.999)) AS clipped,
  list_sort(list_transform(range(0, 32), lambda k: greatest(abs(CAST(embedding[2 * k + 1] AS DOUBLE)), abs(CAST(embedding[2 * k + 2] AS DOUBLE))))) AS p FROM embeddings),
q AS (SELECT *, list_aggregate(p, 'quantile_cont', 0.1) AS lo, list_aggregate(p, 'quantile_cont', 0.9) AS hi FROM f)
SELECT vec_id, array_to_string(list_filter(['error:too short', 'warning:low rate', CASE WHEN top < 1e-6 THEN 'error:silent' END, CASE WHEN top >= 1e-6 AND clipped > 0.064 THEN 'warning:clipping' END,
  CASE WHEN top >= 1e-6 AND top < 0.05 THEN 'warning:quiet' END,
  CASE WHEN top >= 1e-6 AND hi > 1e-6 THEN CASE WHEN lo <= 1e-9 THEN 'ok:clean' WHEN 20 * log10(hi / lo) < 12 THEN 'warning:noise' ELSE 'ok:signal to noise' END END,
  CASE WHEN top >= 1e-6 AND len(list_filter(p, lambda x: x < greatest(lo * 2, hi * 0.08))) / 32 > 0.45 THEN 'warning:pauses' END], lambda x: x IS NOT NULL), ',') AS findings FROM q"""
)
def p8_voice_findings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("rate", F.lit(100))
    return signal.voice_findings(e, "embedding", "rate").select("vec_id", F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["level"], f["rule"])), ",").alias("findings"))


@query()
def d16_mastering(spark, sf_dir):
    """Vectors as short clips, repeated to 0.8 s, through the mastering chain."""
    from ..operators import mastering

    clip = F.flatten(F.array_repeat("embedding", 10))
    e = table(spark, sf_dir, "embeddings").select("vec_id", clip.alias("pcm"), F.lit(800).alias("rate"))
    mode = F.element_at(F.array(*[F.lit(m) for m in mastering.MODES]), (F.col("vec_id") % 4 + 1).cast("int"))
    e = e.withColumn("mastered", mastering.on_clips(mastering.master, F.col("pcm"), F.col("rate"), mode))
    return e.select("vec_id", F.size("mastered").alias("n_samples"), F.round(mastering.loudness_of(F.col("mastered"), F.col("rate")), 3).alias("lufs"))


@query(
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents),
w AS (SELECT doc_id, length(x) AS size, unnest(string_split(x, ' ')) AS word, generate_subscripts(string_split(x, ' '), 1) AS k FROM t),
c AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - 1 AS upto, count(*) OVER (PARTITION BY doc_id) AS all_words FROM w),
n AS (SELECT doc_id, greatest(1, count(*) FILTER (upto <= size / 2)) AS n, any_value(all_words) AS all_words FROM c GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) FILTER (k <= n) || chr(10) || string_agg(word, ' ' ORDER BY k) FILTER (k > n) AS two FROM c JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(x) <= 42 OR n >= n.all_words THEN x ELSE two END AS lines FROM t JOIN n USING (doc_id) JOIN l USING (doc_id)"""
)
def t16_wrapped_lines(spark, sf_dir):
    """Whole texts as two lines."""
    whole = F.trim(F.regexp_replace("text", X.SPACE, " "))
    return table(spark, sf_dir, "documents").select("doc_id", X.wrap_line(whole).alias("lines"))


@query(
    f"""WITH f AS (SELECT vec_id, {_FRAMES} AS p FROM embeddings)
SELECT vec_id, CAST(4 + list_position(p[5 : 8], list_min(p[5 : 8])) - 1 AS INT) AS frame FROM f"""
)
def g9_quietest_frame(spark, sf_dir):
    peaks = table(spark, sf_dir, "embeddings").select("vec_id", signal.frame_peaks(F.col("embedding"), F.lit(8)).alias("p"))
    return peaks.select("vec_id", signal.quietest_cut(F.col("p"), 0.5).alias("frame"))


@query(
    """WITH f AS (SELECT DISTINCT s_nationkey, 'V' || s_nationkey || '_' || s_suppkey % 3 || '.wav' AS file FROM supplier),
c AS (SELECT n_nationkey, 'V' || n_nationkey AS channel, 'V' || n_nationkey || '_1' AS voice FROM nation)
SELECT channel, voice, arg_min(file, CASE WHEN upper(voice) || '.wav' = file THEN '0' ELSE '1' END || file) AS file
FROM c LEFT JOIN f ON c.n_nationkey = f.s_nationkey GROUP BY channel, voice"""
)
def s9_voice_files(spark, sf_dir):
    from ..sources import files

    key, kind = F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 3).cast("string")
    found = table(spark, sf_dir, "supplier").select(F.concat(F.lit("V"), key, F.lit("_"), kind, F.lit(".wav")).alias("file")).distinct()
    name = F.concat(F.lit("V"), F.col("n_nationkey").cast("string"))
    named = table(spark, sf_dir, "nation").select(name.alias("channel"), F.concat(name, F.lit("_1")).alias("voice"))
    return files.find_voice(named, found)
