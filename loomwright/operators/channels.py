"""Channel settings, work queues, audits and run summaries: joins against small dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: The voice models and the languages that their names begin with.
MODELS = (
    "english", "english_2026-01", "english_2026-04", "portuguese", "portuguese_24l", "french_24l",
    "german", "german_24l", "italian", "italian_24l", "spanish", "spanish_24l",
)
LANGUAGES = {"english": "en", "portuguese": "pt", "french": "fr", "german": "de", "italian": "it", "spanish": "es"}


def models(spark: SparkSession, names: tuple[str, ...] = MODELS) -> DataFrame:
    """The dimension of models: ``model``, ``language`` (null if its name begins with none)."""
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.regexp_extract("model", "^[a-z]+", 0)]
    return spark.createDataFrame([(n,) for n in names], "model string").select("model", language.alias("language"))


def first_per_path(files: DataFrame, path_col: str = "path", order_col: str = "pos") -> DataFrame:
    """A queue without repeated paths; the first mention stays."""
    w = Window.partitionBy(path_col).orderBy(order_col)
    return files.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def layered(defaults: dict[str, object], file_level: Column, channel: Column) -> Column:
    """One struct from three layers of string maps: later layers win, an explicit null too."""
    fields = []
    for name, value in defaults.items():
        base = F.lit(value).cast("string")
        for layer in (file_level, channel):
            base = F.when(F.map_contains_key(F.coalesce(layer, F.create_map().cast("map<string,string>")), name), layer[name]).otherwise(base)
        fields.append(base.alias(name))
    return F.struct(*fields)


def resolve(items: DataFrame, channels: DataFrame, defaults: dict[str, object], key_col: str = "key", force_model: str | None = None) -> DataFrame:
    """``items`` with the settings of their channel (``channel``, upper case, and map ``settings``), else the defaults.

    ``known`` tells whether the channel is declared. ``force_model`` replaces the model of
    every item, declared or not. The channels are a dimension of one row a channel.
    """
    joined = items.join(channels.select(F.upper("channel").alias("__channel"), "settings"), F.upper(key_col) == F.col("__channel"), "left")
    none = F.create_map().cast("map<string,string>")
    out = joined.withColumn("config", layered(defaults, none, F.col("settings"))).withColumn("known", F.col("__channel").isNotNull())
    if force_model is not None:
        out = out.withColumn("config", F.col("config").withField("model", F.lit(force_model)))
    return out.drop("__channel", "settings")


def resolve_images(items: DataFrame, channels: DataFrame, key_col: str = "key", folder: str = "ANH_RA") -> DataFrame:
    """``items`` with the ``model``, ``no_fallback`` and ``output`` folder of their image channel, and whether it is ``known``.

    An unknown model is ``auto``; without a setting of its own only a forced first engine
    forbids falling back; without a folder the channel's key below ``folder`` is taken.
    """
    joined = items.join(channels.select(F.upper("channel").alias("__channel"), F.col("settings").alias("__set")), F.upper(key_col) == F.col("__channel"), "left")
    model = F.lower(F.trim(F.col("__set")["model"]))
    model = F.when(model.isin("auto", "gemini", "pollinations"), model).otherwise("auto")
    given = F.nullif(F.trim(F.col("__set")["thu_muc_ra"]), F.lit(""))
    return joined.select(
        *[items[f"`{c}`"] for c in items.columns],
        model.alias("model"),
        F.coalesce(F.lower(F.col("__set")["cam_du_phong"]) == "true", model == "gemini").alias("no_fallback"),
        F.coalesce(given, F.concat_ws("/", F.lit(folder), F.upper(key_col))).alias("output"),
        F.col("__channel").isNotNull().alias("known"),
    )


def by_model(items: DataFrame) -> DataFrame:
    """Rows dealt out by model and sorted by model and name, so that each model is loaded once a task."""
    return items.repartition("model").sortWithinPartitions("model", "name")


def model_shares(items: DataFrame, partitions: int, cost: str = "cost") -> DataFrame:
    """``model``, ``total`` (its cost) and ``before`` (that of the models in front of it), and the ``width`` of a partition.

    Models lie one after another on a line as long as all costs, by name; a partition is a
    stretch of it. One short row a model.
    """
    totals = items.groupBy("model").agg(F.sum(F.greatest(F.coalesce(F.col(cost).cast("double"), F.lit(0.0)), F.lit(0.0))).alias("total"))
    w = Window.orderBy(F.col("model").asc_nulls_first())  # over models, not items
    before = F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return totals.select("model", "total", before.alias("before"), (F.sum("total").over(Window.partitionBy()) / partitions).alias("width"))


def packed_by_model(items: DataFrame, partitions: int, cost: str = "cost", name: str = "name") -> DataFrame:
    """``items`` dealt out so that partitions cost about the same and each model is loaded few times.

    A model larger than a partition is split over several, small ones share one: an item lies at the
    place of its model's stretch that a hash of its ``name`` gives, so all partitions together load at most
    models + partitions - 1 times, and the heaviest exceeds the mean only by what the hash leaves uneven and
    one item's cost. Within partitions items are sorted by model and name. Negative and null costs count as 0.
    """
    shares = model_shares(items, partitions, cost).alias("s")
    rows = items.alias("i").join(F.broadcast(shares) if shares.limit(100_001).count() <= 100_000 else shares, F.col("i.model").eqNullSafe(F.col("s.model")))
    place = F.conv(F.left(F.md5(F.col(f"i.{name}").cast("string")), F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))
    at = F.when(F.col("s.width") > 0, (F.col("s.before") + F.coalesce(place, F.lit(0.0)) * F.col("s.total")) / F.col("s.width")).otherwise(0.0)
    part = F.least(F.floor(at), F.lit(partitions - 1)).cast("int").alias("part")
    return rows.select("i.*", part).repartitionById(partitions, "part").sortWithinPartitions("model", name)


def priority(key: Column, wanted: list[str]) -> Column:
    """Place of the key in a priority list, its length if it isn't there."""
    at = F.array_position(F.array(*[F.lit(x) for x in wanted]), key) if wanted else F.lit(0)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(wanted))).cast("int")


def unfinished(items: DataFrame, outputs: DataFrame, on: str, least_bytes: int = 0) -> DataFrame:
    """Items that have no output of at least ``least_bytes`` yet."""
    done = outputs.where(F.col("bytes") >= least_bytes).select(on)
    return items.join(done, on, "left_anti")


def audit(channels: DataFrame, voices: DataFrame) -> DataFrame:
    """``kind`` (ok, missing voice, unused voice) and ``name``: channels against voice files."""
    stem = F.upper(F.regexp_extract("file", r"^([A-Za-z0-9]+)", 1))
    v, c = voices.select("file", stem.alias("stem")), channels.select("channel", F.upper("voice").alias("voice"))
    used = c.join(v, c["voice"] == v["stem"], "left_semi").select(F.lit("ok").alias("kind"), F.col("channel").alias("name"))
    missing = c.join(v, c["voice"] == v["stem"], "left_anti").select(F.lit("missing voice"), "channel")
    unused = v.join(c, c["voice"] == v["stem"], "left_anti").select(F.lit("unused voice"), "file")
    return used.union(missing).union(unused)


def summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Counts of outcomes, per group; partial counts merge, so any partitioning gives the same."""
    return results.groupBy(*by).agg(
        F.count_if(F.col("ok")).alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.count("*").alias("n_all"), F.sum("seconds").alias("seconds")
    )


def upsert(channels: DataFrame, updates: DataFrame) -> DataFrame:
    """``channels`` (``channel``, map ``settings``) with updates of the same columns merged in.

    Names are compared without case and keep the case they have; only the settings given
    are replaced, and unknown channels are added.
    """
    new = updates.select(F.upper("channel").alias("__key"), F.col("channel").alias("__name"), F.col("settings").alias("__set"))
    both = channels.join(new, F.upper("channel") == F.col("__key"), "full_outer")
    none = F.create_map().cast("map<string,string>")
    given = F.coalesce("__set", none)
    rest = F.map_filter(F.coalesce("settings", none), lambda k, v: ~F.map_contains_key(given, k))
    return both.select(F.coalesce("channel", "__name").alias("channel"), F.map_concat(rest, given).alias("settings"))


#: Settings saved from the page, and the places after the point that they keep.
SAVED = {"toc_do": 3, "cao_do": 2, "nghi_ngan": 3, "nghi_dai": 3}


def checked_updates(updates: DataFrame, models: tuple[str, ...], modes: tuple[str, ...] = ("tat", "nhe", "chuan", "manh"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep``, ``channel``, ``settings`` (a map of strings, for ``upsert``) and ``error`` of settings sent from the page.

    ``updates``: ``channel``, ``model``, ``giong``, ``hau_ky`` and the numbers of ``SAVED``.
    Names are trimmed and upper-cased; a bad name, model or mode is an error (the first of
    them; then there are no settings). Numbers are rounded; an empty voice isn't set.
    """
    name = F.upper(F.trim("channel"))
    error = (
        F.when(~F.coalesce(valid_name(name), F.lit(False)), "name")
        .when(~F.coalesce(F.col("model").isin(*models), F.lit(False)), "model")
        .when(~F.coalesce(F.col("hau_ky").isin(*modes), F.lit(False)), "hau_ky")
    )
    numbers = [x for k, places in SAVED.items() for x in (F.lit(k), F.bround(F.col(k).cast("double"), places).cast("string"))]
    every = F.create_map(F.lit("model"), F.col("model"), F.lit("voice"), F.nullif(F.col("giong"), F.lit("")), F.lit("hau_ky"), F.col("hau_ky"), *numbers)
    return updates.select(*keep, name.alias("channel"), F.when(error.isNull(), F.map_filter(every, lambda k, v: v.isNotNull())).alias("settings"), error.alias("error"))


def valid_name(name: Column) -> Column:
    """Whether a channel's name is of letters and digits only."""
    return F.upper(name).rlike("^[A-Z0-9]+$")


def first_given(*values: Column) -> Column:
    """The first value that is given: command line, file, environment, default."""
    return F.coalesce(*values)


def add_key(keys: Column, key: Column, placeholder: str = "DAN_API_KEY") -> Column:
    """An array of keys with one more, stripped of quotes and commas; no blanks, placeholders or repeats."""
    clean = F.regexp_replace(F.trim(key), "^[\"',]+|[\"',]+$", "")
    kept = F.filter(keys, lambda k: (k != "") & ~F.contains(k, F.lit(placeholder)))
    return F.when(clean == "", kept).otherwise(F.array_distinct(F.concat(kept, F.array(clean))))
