"""Quality rules whose cutoffs adapt to each language and source.

Features of a text are arrays and strings worked on by built-in functions in one
projection: no shuffle, no Python. Quantile sketches (KLL) of the rates are built per
language and source and merged upwards to languages and to the corpus; a group's limits
are drawn towards its language's, and those towards the corpus's, the more the fewer
documents it has. The limits are a small table that is joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

#: The blanks that part words, and the characters counted as symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rate:
    """A rate, the least spread assumed of it, and whether low values are also odd."""

    name: str
    least_spread: float
    two_sided: bool = False


RATES = (
    Rate("symbols_per_word", 0.05),
    Rate("upper_share", 0.05),
    Rate("dup_line_share", 0.20),
    Rate("repeat_share", 0.10),
    Rate("word_length", 1.0, True),
)
#: Documents that a parent's limits count as beside a group's own.
PARENT_DOCS = 100.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def with_features(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the counts and rates of each whole text (null: no words) as ``prefix`` + name.

    ``n_repeat_words``: hashes of the 3-word windows are sorted with their places, so a
    window found twice has an equal neighbour; the sorted places of such windows give
    the words they cover. Texts all of whose windows differ skip the sort.
    """
    t, p = F.coalesce(F.col(text_col), F.lit("")), prefix
    w, n, grams, places = (f"__{x}" for x in ("words", "n", "grams", "places"))
    one = F.lit(1)
    sized = docs.withColumn(w, _words(t)).withColumn(n, F.size(w))
    hashed = sized.withColumn(
        grams,
        F.when(F.col(n) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.col(n) - 3, F.lit(0))),
                lambda i: F.xxhash64(F.get(F.col(w), i), F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)),
            )
        ),
    )
    ordered = hashed.withColumn(
        places,
        F.when(
            F.size(F.array_distinct(grams)) < F.size(grams),
            F.sort_array(F.transform(F.col(grams), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    sorted_ = F.col(places)
    repeated = F.sort_array(
        F.transform(
            F.filter(
                sorted_,
                lambda x, i: (x["h"] == F.get(sorted_, i - one)["h"]) | (x["h"] == F.get(sorted_, i + one)["h"]),
            ),
            lambda x: x["i"],
        )
    )
    ordered = ordered.withColumn("__at", repeated)
    at = F.col("__at")
    # each repeated window covers up to its third word, or up to the next one's first; after the last stands null, which least() passes over
    covered = F.aggregate(
        F.zip_with(F.slice(at, 2, F.size(at)), at, lambda b, a: F.least(F.lit(3), b - a)), F.lit(0), lambda x, y: x + y
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    counted = ordered.withColumn("__lines", lines).withColumns(
        {
            f"{p}n_words": F.col(n).cast("long"),
            f"{p}word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
            f"{p}n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            f"{p}n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            f"{p}n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            f"{p}n_lines": F.size("__lines").cast("long"),
            f"{p}n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
        }
    )
    rates = {
        f"{p}symbols_per_word": F.col(f"{p}n_symbols") / F.nullif(f"{p}n_words", F.lit(0)),
        f"{p}upper_share": F.col(f"{p}n_upper") / F.nullif(f"{p}word_chars", F.lit(0)),
        f"{p}dup_line_share": F.col(f"{p}n_dup_lines") / F.nullif(f"{p}n_lines", F.lit(0)),
        f"{p}repeat_share": F.col(f"{p}n_repeat_words") / F.nullif(f"{p}n_words", F.lit(0)),
        f"{p}word_length": F.col(f"{p}word_chars") / F.nullif(f"{p}n_words", F.lit(0)),
        f"{p}base_failed": (F.col(f"{p}n_words") < 50) | (100 * F.col(f"{p}n_repeat_words") > 50 * F.col(f"{p}n_words")),
    }
    return counted.withColumns(rates).drop(w, n, grams, places, "__at", "__lines", f"{p}n_lines", f"{p}n_upper")


def limits(features: DataFrame, spread: float = 3.0, weight: float = PARENT_DOCS, k: int = 200, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang``, ``source`` and for each rate ``low_*`` and ``high_*``, from sketches merged upwards.

    High is the upper quartile plus ``spread`` times the quartiles' distance (at least
    the rate's least spread), low likewise. A group's limits are drawn towards its
    language's as if by ``weight`` documents of that, and those towards the corpus's, so
    small groups lean on what is known of larger ones and no size is a threshold. Nulls
    are a language and a source of their own.
    """
    rates = [r.name for r in RATES]
    group = features.groupBy(F.col(lang_col).alias("lang"), F.col(source_col).alias("source")).agg(
        F.count("word_length").alias("n"), *[F.kll_sketch_agg_double(r, F.lit(k)).alias(r) for r in rates]
    )
    group = materialize(group, "sketches")
    merge = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, F.lit(k)).alias(r) for r in rates]]
    by_lang, whole = group.groupBy("lang").agg(*merge), group.agg(*merge)

    def bounds(df: DataFrame, level: str) -> DataFrame:
        out = {}
        for r in RATES:
            q1, q3 = (F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(r.name, F.lit(q))) for q in (0.25, 0.75))
            width = spread * F.greatest(q3 - q1, F.lit(r.least_spread))
            out[r.name] = F.struct((q1 - width if r.two_sided else F.lit(None).cast("double")).alias("low"), (q3 + width).alias("high"))
        return df.select(*[c for c in ("lang", "source") if c in df.columns], F.col("n").alias(f"n_{level}"), F.struct(*[v.alias(k) for k, v in out.items()]).alias(level))

    g, by = bounds(group, "group"), bounds(by_lang, "language").withColumnRenamed("lang", "l")
    corpus = bounds(whole, "corpus").select("corpus.*").first()  # one row of two numbers a rate
    joined = g.join(by, g["lang"].eqNullSafe(by["l"]), "left")

    def drawn(own: Column, n: Column, parent: Column) -> Column:
        return F.coalesce((own * n + parent * weight) / (n + weight), own, parent)

    def chosen(rate: str, side: str) -> Column:
        of_all = F.lit(corpus[rate][side]).cast("double")
        of_lang = drawn(F.col(f"language.{rate}.{side}"), F.col("n_language"), of_all)
        return drawn(F.col(f"group.{rate}.{side}"), F.col("n_group"), of_lang).alias(f"{side}_{rate}")

    return joined.select("lang", "source", *[chosen(r, side) for r in rates for side in ("low", "high")])


def with_verdict(features: DataFrame, bounds: DataFrame, prefix: str = "", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``features`` with ``prefix`` + ``kept``: false if the base rule failed or a rate is out of bounds."""
    b = bounds.select(F.struct(*bounds.columns).alias("__bounds"))
    joined = features.join(
        broadcast_if_small(b),
        F.col(lang_col).eqNullSafe(F.col("__bounds.lang")) & F.col(source_col).eqNullSafe(F.col("__bounds.source")),
        "left",
    )
    odd = F.lit(False)
    for r in RATES:
        x = F.col(prefix + r.name)
        odd = odd | F.coalesce(x > F.col(f"__bounds.high_{r.name}"), F.lit(False)) | F.coalesce(x < F.col(f"__bounds.low_{r.name}"), F.lit(False))
    return joined.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & ~odd).drop("__bounds")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, the counts, ``base_failed`` and ``kept`` of every document.

    Texts are read once: counts and rates are written to the shared folder, sketched and
    joined with their group's limits. Null and empty texts have no words and fail the
    base rule; null languages and sources form groups; repeated and null ids give a row
    for each row; an empty table gives an empty table.
    """
    few = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col), F.col(source_col))
    features = materialize(with_features(few, text_col).drop(text_col), "features")
    return with_verdict(features, limits(features, lang_col=lang_col, source_col=source_col), "", lang_col, source_col).select(id_col, *COUNTS, "base_failed", "kept")


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, unchanged, that the rules keep.

    Texts are read once: rows are written with their counts and rates, which are sketched,
    and filtered when they are read again.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    few = docs.select(row, F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    rows = materialize(with_features(few, "text").drop("text"), "features")
    return with_verdict(rows, limits(rows)).where("kept").select("row.*")
