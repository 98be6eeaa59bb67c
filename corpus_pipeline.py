"""The corpus pipeline: five of the corpus operators, one after another.

Each stage takes what its predecessor kept, written as Parquet and read again, and
returns the columns of ``documents``; the last returns what the encoder makes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwright.llm import bpe, langid, neardup, quality, winnow
from loomwright.llm.common import discard, documents, materialize, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.keep_documents(docs, langid.train(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of texts with a similarity of 0.8 or more; of its repeated rows one."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return winnow.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and the digests of each document's tokens and of what they decode to; written, as small Arrow batches hold for jobs run here only."""
    import public_tokenizers as P

    return materialize(bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256")), "encoded")


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", encoding),
]

#: Quantile sketches and the trained text model have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result written to the shared folder and read again.

    What a stage wrote on its way is deleted when its result is written, and a result when
    the next one is; only what the last one wrote stays.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as folders:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            folders.remove(docs._shared_folder)
        if before is not None:
            discard(before)
        before = docs
    result = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)
    return result
