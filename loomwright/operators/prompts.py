"""Prompt lists: parsing, numbering and routing to an engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Words that show a person, in order of precedence.
PEOPLE = (
    "woman", "women", "man", "men", "person", "people", "human", "humans",
    "face", "faces", "hand", "hands", "child", "children", "kid", "kids",
    "boy", "boys", "girl", "girls", "baby", "monk", "monks", "priest", "nun",
    "pastor", "preacher", "figure", "figures", "crowd", "crowds", "praying",
    "prayer", "kneeling", "portrait", "family", "couple", "worker", "workers",
    "employee", "doctor", "nurse", "engineer", "teacher", "student", "soldier",
    "elderly", "grandmother", "grandfather", "jesus", "christ", "mary",
    "stickman", "stick figure", "businessman", "businesswoman", "ceo",
    "manager", "chef", "farmer", "pilot", "lawyer", "athlete", "singer",
    "mulher", "mulheres", "homem", "homens", "pessoa", "pessoas", "rosto",
    "maos", "mao", "crianca", "criancas", "monge", "padre", "freira", "fiel",
    "fieis", "multidao", "rezando", "orando", "ajoelhado", "ajoelhada",
    "familia", "senhora", "senhor", "povo", "devoto", "devota", "sacerdote",
)
#: Words that may show one.
UNSURE = (
    "silhouette", "shadow", "shadows", "statue", "sculpture", "mannequin",
    "reflection", "eyes", "eye", "body", "skin", "arm", "arms", "leg", "legs",
    "shoulder", "congregation", "audience", "team", "group", "wedding",
    "funeral", "procession", "pilgrim", "angel", "angels", "saint", "santa",
    "santo", "anjo", "anjos", "estatua", "sombra", "silhueta", "olhos",
    "corpo", "grupo", "casamento", "procissao", "peregrino",
)
#: What denies the word after it, and what may stand between.
DENIALS = (
    "no", "not", "non", "without", "sans", "minus", "devoid of", "free of",
    "empty of", "absent", "avoid", "exclude", "zero",
    "sem", "nenhum", "nenhuma", "nem", "sin", "ningun", "ninguna",
)
ARTICLES = ("a", "an", "the", "any", "other", "um", "uma", "el", "la")
#: Characters before a word within which it is denied.
DENIAL_REACH = 24


def mentions(text: Column, word: Column) -> Column:
    """Whether a whole word stands in accent-free lower-case text at least once without a denial before it.

    Denied occurrences are blanked out first: a denial and up to two articles right before
    the word, which begin at most ``DENIAL_REACH`` characters before it.
    """
    whole = F.concat(F.lit(r"(?<![a-z0-9])\Q"), word, F.lit(r"\E(?![a-z0-9])"))
    before = rf"(?:{'|'.join(DENIALS)})(?:\s+(?:{'|'.join(ARTICLES)})){{0,2}}\s*"
    denied = F.concat(F.lit(rf"(?s)(?=.{{1,{DENIAL_REACH}}}"), whole, F.lit(f"){before}"), whole)
    return F.regexp_like(F.regexp_replace(text, denied, F.lit("|")), whole)


def first_mentioned(text: Column, words: tuple[str, ...]) -> Column:
    """The first word of the list that ``mentions`` finds, or null; only words that stand in the text are looked at."""
    there = F.regexp_extract_all(text, F.lit(rf"(?<![a-z0-9])(?=({'|'.join(words)})(?![a-z0-9]))"), F.lit(1))
    some = F.array_intersect(F.array(*[F.lit(w) for w in words]), there)
    return F.get(F.filter(some, lambda w: mentions(text, w)), F.lit(0))


def route(prompts: DataFrame) -> DataFrame:
    """``prompts`` (``text``, ``tagged``, ``model``) with ``engine`` and ``reason``.

    Precedence: the channel's model, the tag, a word that shows a person, one that may,
    else the other engine.
    """
    norm = prompts.withColumn("__norm", X.strip_accents(F.lower("text")))
    open_ = F.col("model").isin("gemini", "pollinations")
    rows = norm.withColumn("__who", F.when(~open_ & ~F.col("tagged"), first_mentioned(F.col("__norm"), PEOPLE)))
    rows = rows.withColumn("__may", F.when(~open_ & ~F.col("tagged") & F.col("__who").isNull(), first_mentioned(F.col("__norm"), UNSURE)))
    return rows.withColumns(
        {
            "engine": F.when(open_, F.col("model")).when(F.col("tagged") | F.col("__who").isNotNull() | F.col("__may").isNotNull(), "gemini").otherwise("pollinations"),
            "reason": F.when(open_, F.concat(F.lit("forced: "), "model"))
            .when(F.col("tagged"), "tagged")
            .when(F.col("__who").isNotNull(), F.concat(F.lit("person: "), "__who"))
            .when(F.col("__may").isNotNull(), F.concat(F.lit("maybe: "), "__may"))
            .otherwise("nobody"),
        }
    ).drop("__norm", "__who", "__may")


def clean_line(line: Column) -> Column:
    """struct(text, tagged, forced): a prompt without its tags, numbering and bullets.

    Each of four passes takes at most one of each kind from the front; the last forced
    number counts.
    """
    number, tag = r"^(?U)\s*\[\s*#\s*(\d+)\s*\]\s*", r"^(?U)\s*\[\s*[Pp]\s*\]\s*"

    def one_pass(s, _):
        forced = F.nullif(F.regexp_extract(s["text"], number, 1), F.lit("")).cast("int")
        t = F.regexp_replace(s["text"], number, "")
        tagged = t.rlike(tag)
        t = F.regexp_replace(t, tag, "")
        t = F.regexp_replace(F.regexp_replace(t, r"^(?U)\s*\d{1,4}\s*[.)\-:]\s+", ""), r"^(?U)\s*[-*•]\s+", "")
        return F.struct(t.alias("text"), (s["tagged"] | tagged).alias("tagged"), F.coalesce(forced, s["forced"]).alias("forced"))

    start = F.struct(line.alias("text"), F.lit(False).alias("tagged"), F.lit(None).cast("int").alias("forced"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, one_pass, lambda s: F.struct(X.trim_space(s["text"]).alias("text"), s["tagged"].alias("tagged"), s["forced"].alias("forced")))


def parse_prompts(files: DataFrame, name_col: str = "file_name", text_col: str = "text") -> DataFrame:
    """``file_name``, ``number``, ``source``, ``text``, ``tagged`` of every prompt of each file.

    A file is read by blocks (parted by blank lines) if it has two or more of them and more
    than 1.3 lines in each on average, else by lines. Comments are left out; a forced
    number other than 0 replaces the prompt's place.
    """
    trimmed = F.transform(F.split(X.clean_text(F.col(text_col)), "\n"), lambda x: X.trim_space(x))
    rows = files.select(F.col(name_col).alias("file_name"), F.posexplode(trimmed).alias("pos", "line"))
    file = Window.partitionBy("file_name").orderBy("pos")
    rows = rows.withColumn("block", F.sum((F.col("line") == "").cast("int")).over(file.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("line <> '' and not startswith(line, '#') and not startswith(line, '//')")
    whole = Window.partitionBy("file_name")
    n_blocks = F.size(F.collect_set("block").over(whole))
    by_block = (n_blocks >= 2) & (F.count("*").over(whole) / n_blocks > 1.3)
    rows = rows.withColumn("part", F.when(by_block, F.col("block")).otherwise(F.col("pos")))
    parts = rows.groupBy("file_name", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("source"))
    clean = parts.withColumn("c", clean_line(F.col("source"))).where("c.text <> ''")
    place = F.row_number().over(Window.partitionBy("file_name").orderBy("part"))
    return clean.withColumn("place", place).select(
        "file_name", F.when(F.col("c.forced") != 0, F.col("c.forced")).otherwise(F.col("place")).alias("number"), "source", "c.text", "c.tagged"
    )
