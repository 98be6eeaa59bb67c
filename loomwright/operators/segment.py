"""Scripts to spoken segments: lines, blocks, fragments, sentences and the pause after each.

Rows carry their position; every window is per script, and text leaves its script's
partition only in the two groupings by script.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


@dataclass(frozen=True)
class Pauses:
    """Seconds: within a block, after a block, after a ruled block, at the end. The defaults are fixed values."""

    short: float = 0.30
    long: float = 0.85
    section: float = 1.60
    tail: float = 0.50


def lines(scripts: DataFrame, script_col: str = "script_id", text_col: str = "text") -> DataFrame:
    """``script_id``, ``pos``, ``line`` (trimmed) and ``kind`` of every line; null texts have none.

    Script ids tell scripts apart: the lines of rows with the same id are taken for one
    script and interleave by their places, so ids are made unique before.
    """
    split = F.split(X.clean_text(F.col(text_col)), "\n")
    rows = scripts.select(F.col(script_col).alias("script_id"), F.posexplode(split).alias("pos", "line"))
    return rows.withColumn("line", X.trim_space(F.col("line"))).withColumn("kind", X.line_kind(F.col("line")))


def blocks(scripts: DataFrame, pauses: Pauses = Pauses(), script_col: str = "script_id", text_col: str = "text") -> DataFrame:
    """``script_id``, ``block``, ``text`` and ``pause`` of every block of content lines.

    The separators after a block are folded in order: a pause marker sets its value, any
    other raises the pause to its own at least. The end of the script is one more
    separator. Comments and directions neither count nor close; separators before the
    first block are ignored.
    """
    each = lines(scripts, script_col, text_col).where("kind not in ('comment', 'direction')")
    each = each.withColumn("content", F.col("kind") == "content")
    w = Window.partitionBy("script_id").orderBy("pos")
    first = F.col("content") & ~F.coalesce(F.lag("content").over(w), F.lit(False))
    each = each.withColumn("first", first).withColumn("block", F.sum(F.col("first").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("block > 0")
    value = F.when(F.col("kind") == "blank", pauses.long).when(F.col("kind") == "rule", pauses.section).otherwise(X.pause_seconds(F.col("line")))
    parts = each.groupBy("script_id", "block").agg(
        F.array_sort(F.collect_list(F.when(F.col("content"), F.struct("pos", "line")))).alias("said"),
        F.array_sort(F.collect_list(F.when(~F.col("content"), F.struct("pos", value.alias("v"), (F.col("kind") == "pause").alias("forced"))))).alias("seps"),
    )
    end = F.struct(F.lit(2147483647).alias("pos"), F.lit(pauses.tail).alias("v"), F.lit(False).alias("forced"))
    last = F.col("block") == F.max("block").over(Window.partitionBy("script_id"))
    seps = F.when(last, F.concat("seps", F.array(end))).otherwise(F.col("seps"))
    pause = F.aggregate(seps, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull() | x["forced"], x["v"]).otherwise(F.greatest(a, x["v"])))
    text = F.regexp_replace(F.array_join(F.transform("said", lambda s: s["line"]), " "), X.PAUSE, " ")
    return parts.select("script_id", "block", text.alias("text"), pause.alias("pause"))


def fragments(block_rows: DataFrame) -> DataFrame:
    """Blocks cut at break tags: ``frag``, ``text`` (plain), ``break_s`` after it, ``last`` of its block."""
    cut = F.split("text", X.BREAK)
    tags = F.regexp_extract_all("text", F.lit(f"({X.BREAK})".replace("(?i)", "", 1).join(["(?i)", ""])), F.lit(1))
    pieces = F.transform(cut, lambda x, i: F.struct(x.alias("text"), F.get(F.col("__tags"), i).alias("tag")))
    rows = block_rows.withColumn("__tags", tags).withColumn("__n", F.size(cut)).select(
        "script_id", "block", "pause", "__n", F.posexplode(pieces).alias("frag", "piece")
    )
    return rows.select(
        "script_id", "block", "pause", "frag",
        X.plain(F.col("piece.text")).alias("text"),
        F.when(F.col("piece.tag").isNotNull(), X.break_seconds(F.col("piece.tag"))).alias("break_s"),
        (F.col("frag") == F.col("__n") - 1).alias("last"),
    )


def segments(scripts: DataFrame, pauses: Pauses = Pauses(), script_col: str = "script_id", text_col: str = "text") -> DataFrame:
    """``script_id``, ``seq`` (from 1), ``text`` and ``pause`` of every sentence.

    A fragment's last sentence takes the break's seconds, else its block's pause if it
    ends the block; a break that stands alone replaces the pause of the sentence before
    it; the script's last sentence takes the tail.
    """
    frags = fragments(blocks(scripts, pauses, script_col, text_col)).withColumn("sents", X.sentences(F.col("text")))
    n = F.size("sents")
    rows = frags.withColumn("sents", F.when(n == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("sents"))).select(
        "*", F.posexplode("sents").alias("i", "sentence"), F.size("sents").alias("n")
    )
    own = F.when(F.col("i") < F.col("n") - 1, pauses.short).when(F.col("break_s").isNotNull(), F.col("break_s")).when(F.col("last"), F.col("pause")).otherwise(pauses.short)
    w = Window.partitionBy("script_id").orderBy("block", "frag", "i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", own).withColumn("seq", F.count("sentence").over(w)).where("seq > 0")
    order = F.struct("block", "frag", "i")
    said = F.col("sentence").isNotNull()
    out = rows.groupBy("script_id", "seq").agg(
        F.max("sentence").alias("text"),
        F.max(F.when(said, F.col("own"))).alias("own"),
        F.max_by("break_s", F.when(~said & F.col("break_s").isNotNull(), order)).alias("over"),
    )
    last = F.col("seq") == F.max("seq").over(Window.partitionBy("script_id"))
    return out.select("script_id", F.col("seq").cast("int").alias("seq"), "text", F.when(last, pauses.tail).otherwise(F.coalesce("over", "own")).alias("pause"))
