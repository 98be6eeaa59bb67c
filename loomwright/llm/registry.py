"""The driver-facing queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, counts, langid, licenses, quality, runs, shards, simhash, spelling, tokenfiles, toxicity, warc, winnow
from .common import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(documents(spark, sf_dir))
    return langid.identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return bpe.encode_documents(
        documents(spark, sf_dir), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256")
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return tokenfiles.read_tokens(tokenfiles.write_tokens(documents(spark, sf_dir), P.path("byte_bpe_50k.json")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return counts.count_tokens(documents(spark, sf_dir), P.path("piece_bpe_32k.model"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
        "n_offending",
        "worst_start",
        "worst_end",
    )


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where the last part of one document in ten is overwritten by repeats of its first words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    own = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    cut = docs.select("doc_id", "text", own.alias("own"), F.floor(h / 10).alias("g"))
    n = F.size("own")
    start = (F.col("g") % n).cast("int")
    placed = cut.select("doc_id", "text", "own", "g", F.when(n > 0, start).alias("a"))
    rest = n - F.col("a")
    period = (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int")
    repeats = F.flatten(F.array_repeat(F.slice("own", F.col("a") + 1, period), F.ceil(rest / period).cast("int")))
    changed = F.array_join(F.concat(F.slice("own", F.lit(1), F.col("a")), F.slice(repeats, F.lit(1), rest)), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return runs.periodic_runs(repeated_tails(documents(spark, sf_dir)), outputs)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(documents(spark, sf_dir), N_SHARDS)


def lost_letter(doc_id: object) -> Callable[[str], str]:
    """Deletes a letter of one word in 31, as a checksum of the id and the word decides (none without an id)."""
    before = None if doc_id is None else crc32(f"{doc_id}:".encode())

    def change(word: str) -> str:
        if before is None or (h := crc32(word.encode(), before)) % 31:
            return word
        k = h % len(word)
        return word[:k] + word[k + 1 :]

    return change


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(documents(spark, sf_dir), change=lost_letter).where("n >= 2"))


N_SHARDS = 8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_warc,
        op3_winnowing,
        op4_licenses,
        op5_byte_bpe,
        op6_simhash,
        op7_quality,
        op8_token_files,
        op9_token_counts,
        op10_toxicity,
        op11_periodic_runs,
        op12_sharding,
        op13_spelling_variants,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.SQL,
    "op3_winnowing": winnow.SQL,
    "op4_licenses": licenses.oracle(),
    "op11_periodic_runs": runs.SQL,
    "op12_sharding": shards.oracle(N_SHARDS),
    "op13_spelling_variants": spelling.SQL,
}
