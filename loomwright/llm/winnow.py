"""Benchmark decontamination by winnowing, on built-in functions only.

Every text keeps the least hash of the k-grams in each window of ``span`` words, so a
shared span of ``span`` words or more has the same least hash on both sides and can't be
missed. Training fingerprints (runs of windows with one least hash) are joined with the
benchmark's; only the windows of matching runs are then compared word by word, and
windows that overlap or adjoin extend to whole shared spans.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

SPAN, K = 10, 5
#: Fixed value: what stands between words once A-Z are lower case.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The lower-cased words of a whole text (null: none)."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, GAPS), "")


def _gram(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)])


def _upto(n: Column) -> Column:
    """0 .. n - 1, empty where n is 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def _short_runs(words: Column, n: Column, size: int) -> Column:
    """Each window of ``size`` words as a run of its own."""
    return F.transform(
        _upto(n - size + 1),
        lambda i: F.struct(F.lit(size).alias("size"), _gram(words, i, size).alias("fp"), i.alias("first"), i.alias("last")),
    )


def _with_runs(df: DataFrame, span: int, k: int, short: list[int]) -> DataFrame:
    """``df`` (with ``words``) and ``runs``: fingerprint ``fp`` of the windows ``first`` .. ``last`` of ``size`` words.

    ``short``: sizes below ``span``, for items shorter than a window; each of their windows
    is a run with its own hash. Explode ``runs`` with explode_outer: for explode the planner
    adds a filter on the array's size, which it pushes down, and evaluates all of it again.
    """
    w, n = F.col("words"), F.size("words")
    df = df.withColumn("kgrams", F.transform(_upto(F.when(n >= span, n - k + 1).otherwise(0)), lambda i: _gram(w, i, k)))
    g = F.col("kgrams")
    df = df.withColumn("least", F.transform(_upto(n - span + 1), lambda i: F.least(*[F.get(g, i + j) for j in range(span - k + 1)])))
    low = F.col("least")
    df = df.withColumn("starts", F.filter(_upto(n - span + 1), lambda i: ~F.get(low, i).eqNullSafe(F.get(low, i - 1))))
    at = F.col("starts")
    runs = F.zip_with(
        at,
        F.slice(at, 2, F.size(at)),
        lambda a, b: F.struct(F.lit(span).alias("size"), F.get(low, a).alias("fp"), a.alias("first"), F.coalesce(b - 1, n - span).alias("last")),
    )
    for size in short:
        runs = F.concat(runs, _short_runs(w, n, size))
    return df.withColumn("runs", runs).drop("kgrams", "least", "starts")


def _windows(words: Column, first: Column, last: Column, size: Column) -> Column:
    return F.transform(
        F.sequence(first, last),
        lambda i: F.struct(size.alias("size"), i.alias("at"), F.array_join(F.slice(words, i + 1, size), " ").alias("window")),
    )


def _hit_rows(
    docs: DataFrame, benchmark: DataFrame, span: int, k: int, id_col: str, text_col: str, item_col: str, item_text_col: str
) -> tuple[DataFrame, DataFrame]:
    """(a row for each of ``docs``: ``id``, ``text_hash``, ``n_words``, ``n_hit`` and ``classes``; ``class`` -> ``items``).

    A class is a set of items that have some windows in common: documents meet windows, of
    which there is one row each, however many items hold them.
    """
    if not 1 <= k <= span:
        raise ValueError("k must be at most span")
    item = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    item = materialize(item, "items")
    short = sorted(r[0] for r in item.select(F.size("words").alias("n")).where(F.col("n") < span).distinct().collect())  # fewer than span rows
    runs = _with_runs(item, span, k, short).withColumn("run", F.explode_outer("runs"))
    # a short size only counts for items that are that short
    runs = runs.where((F.col("run.size") == span) | (F.col("run.size") == F.size("words")))
    prints = materialize(runs.select("run.size", "run.fp").distinct(), "item-prints")
    windows = runs.withColumn("win", F.explode_outer(_windows(F.col("words"), F.col("run.first"), F.col("run.last"), F.col("run.size")))).select("win.size", "win.window", "item")
    windows = windows.groupBy("size", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    windows = materialize(windows.withColumn("class", F.sha2(F.array_join("items", "\0"), 256)), "item-windows")
    classes = windows.groupBy("class").agg(F.first("items").alias("items"))

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    found = (
        _with_runs(rows, span, k, short)
        .select("id", "text_hash", F.explode_outer("runs").alias("run"))
        .select("id", "text_hash", "run.*")
        .join(broadcast_if_small(prints), ["size", "fp"], "left_semi")
        .groupBy("id", "text_hash")
        .agg(F.collect_set(F.struct("size", "first", "last")).alias("runs"))
    )
    found = materialize(found, "matching-runs").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "runs")
    same = rows["id"].eqNullSafe(F.col("_id")) & (rows["text_hash"] == F.col("_hash"))
    w = F.col("words")
    wins = F.flatten(F.transform("runs", lambda r: _windows(w, r["first"], r["last"], r["size"])))
    checked = materialize(
        rows.join(broadcast_if_small(found), same, "left").select("id", "text_hash", F.size("words").cast("long").alias("n_words"), F.when(F.col("runs").isNotNull(), wins).alias("wins")),
        "candidate-windows",
    )
    shared = (
        checked.where("wins is not null")
        .select("id", "text_hash", F.explode("wins").alias("win"))
        .select("id", "text_hash", "win.*")
        .join(broadcast_if_small(windows.select("size", "window", "class")), ["size", "window"])
        .groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"))
        .agg(F.collect_set(F.struct("at", "size")).alias("at"), F.array_sort(F.collect_set("class")).alias("classes"))
    )
    same = checked["id"].eqNullSafe(F.col("_id")) & (checked["text_hash"] == F.col("_hash"))
    places = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1))))
    n_hit = F.when(F.col("at").isNull(), 0).otherwise(F.size(places)).cast("long")
    return checked.join(shared, same, "left").select("id", "text_hash", "n_words", n_hit.alias("n_hit"), "classes"), classes


def hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: ``id``, ``text_hash``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``items`` (sorted strings).

    A window is ``span`` consecutive words of an item, or all words of a shorter one; a
    document word inside an occurrence of a window is hit. Null and empty texts have no
    words and hit nothing; items without words have no windows; items without an id hit
    but aren't named. Rows are told apart by id and text, so repeated and null ids are
    safe. An empty benchmark hits nothing. Sets of items are made and digested once for
    each combination of classes, not for each document.
    """
    rows, classes = _hit_rows(docs, benchmark, span, k, id_col, text_col, item_col, item_text_col)
    rows = materialize(rows.withColumn("key", F.sha2(F.array_join("classes", ","), 256)), "hit-rows")
    sets = rows.where("key is not null").groupBy("key").agg(F.first("classes").alias("classes"))
    sets = sets.select("key", F.explode("classes").alias("class")).join(classes, "class")
    sets = sets.groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    digest = lambda items: F.sha2(F.array_join(items, ","), 256)
    sets = materialize(sets.select("_key", "items", F.size("items").cast("long").alias("n_items"), digest("items").alias("items_sha256")), "item-sets")
    none = F.array().cast("array<string>")
    return rows.join(broadcast_if_small(sets), F.col("key") == F.col("_key"), "left").select(
        "id",
        "text_hash",
        "n_words",
        "n_hit",
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", digest(none)).alias("items_sha256"),
        F.coalesce("items", none).alias("items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` of every document (see ``hits``)."""
    return hits(docs, benchmark, id_col=id_col, **kw).select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, k: int = K, item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, unchanged, that share no window with the benchmark."""
    bad = _hit_rows(docs, benchmark, span, k, id_col, text_col, item_col, item_text_col)[0].where("n_hit > 0")
    bad = materialize(bad.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    return docs.join(
        broadcast_if_small(bad), docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__hash")), "left_anti"
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bi AS (
  SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS t FROM bi
), di AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size
), hit AS (
  SELECT DISTINCT di.doc_id, di.size, di.i, bw.item_id
  FROM di JOIN bw ON bw.size = di.size AND bw.t = array_to_string(di.w[di.i : di.i + di.size - 1], ' ')
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
