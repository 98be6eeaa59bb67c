"""Readers of script, prompt, configuration and WAV files, and the writers beside them."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .wav import decoded, pcm16, read_header, wav_header


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path``, ``file_name`` and ``text`` of every .txt file below the paths, each path once."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,TXT}").load(path)
    text = X.clean_text(F.decode("content", "UTF-8"))
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), text.alias("text")).dropDuplicates(["path"])


def read_channels(spark: SparkSession, path: str, section: str = "kenh") -> DataFrame:
    """``channel`` (upper case) and ``settings`` (a map of strings) from a JSON document of named channels.

    A document that can't be parsed has no channels, so that defaults apply.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    parsed = F.from_json("v", f"struct<`{section}`:map<string,map<string,string>>>")
    return text.select(F.explode(parsed[section]).alias("channel", "settings")).select(F.upper("channel").alias("channel"), "settings")


def merged_config(document: Column, defaults: dict[str, dict[str, object] | object], whole: tuple[str, ...] = ("kenh",)) -> Column:
    """struct(sections, values) of a JSON document laid over defaults; one that can't be parsed fails the query.

    Sections (objects in the defaults) are merged key by key, but those in ``whole`` are
    taken as the document has them; everything else is replaced. ``sections`` maps names to
    maps of texts, ``values`` names to texts (JSON where they aren't strings).
    """
    texts = "map<string,string>"
    none = F.create_map().cast(texts)
    given = F.coalesce(F.from_json(F.regexp_replace(document, "^\ufeff", ""), texts, {"mode": "FAILFAST"}), none)
    merged = [F.lit(k) for k, v in defaults.items() if isinstance(v, dict)]
    sections = []
    for name, value in defaults.items():
        if isinstance(value, dict):
            flat = [F.lit(x if isinstance(x, str) else json.dumps(x)) for kv in value.items() for x in kv]
            own = F.create_map(*flat) if flat else none
            user = F.from_json(given[name], texts)
            kept = F.when(F.lit(name in whole) & user.isNotNull(), none).otherwise(F.map_filter(own, lambda k, _: ~F.map_contains_key(F.coalesce(user, none), k)))  # noqa: B023
            sections += [F.lit(name), F.map_concat(kept, F.coalesce(user, none))]
    plain = [F.lit(x if isinstance(x, str) else json.dumps(x)) for kv in defaults.items() if not isinstance(kv[1], dict) for x in kv]
    base = F.create_map(*plain) if plain else none
    own = F.map_filter(given, lambda k, _: ~F.array_contains(F.array(*merged).cast("array<string>"), k))
    values = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)
    return F.struct((F.create_map(*sections) if sections else F.create_map().cast(f"map<string,{texts}>")).alias("sections"), values.alias("values"))


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``rate``, ``seconds``, ``pcm`` (mono, -1 to 1) and ``error`` of every .wav file: whole clips a row, for short ones.

    A file that can't be read has an error and nulls. Long recordings are read in blocks, and durations
    from headers alone, by the data source ``sources.wav``.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{wav,WAV}").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    h = read_header(lambda at, n: content[at : at + n], len(content))  # noqa: B023
                    out.append((p, h.rate, h.n_samples / h.rate, decoded(content[h.start : h.start + h.n_samples * h.frame], h), None))
                except (ValueError, struct.error) as e:
                    out.append((p, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "rate", "seconds", "pcm", "error"]).astype({"rate": "Int32"})

    return rows.select("path", "content").mapInPandas(run, "path string, rate int, seconds double, pcm array<float>, error string")


def wav_bytes(pcm: Column, rate: Column) -> Column:
    """A mono 16-bit WAV file: samples clipped to 1, scaled by 32767 and cut to integers; NaN and infinite ones are 0. Null without samples or rate."""

    @F.pandas_udf("binary")
    def encode(clips: pd.Series, rates: pd.Series) -> pd.Series:
        made = [None if x is None or pd.isna(r) else wav_header(len(x), int(r)) + pcm16(np.asarray(x, "f8")) for x, r in zip(clips, rates)]
        return pd.Series(made, dtype=object)

    return encode(pcm, rate)


def find_voice(channels: DataFrame, files: DataFrame) -> DataFrame:
    """``channels`` (``channel``, ``voice``) with ``file``: the declared one, else the first whose name starts with the channel."""
    stem = F.upper(F.regexp_replace("file", r"\.[^.]+$", ""))
    f = files.select("file", stem.alias("__stem"), F.regexp_extract(stem, r"^([A-Z0-9]+)", 1).alias("__key"))
    declared = channels.join(f, F.upper("voice") == f["__stem"]).select("channel", "voice", F.lit(0).alias("rank"), "file")
    named = channels.join(f, F.upper("channel") == f["__key"]).select("channel", "voice", F.lit(1).alias("rank"), "file")
    none = channels.select("channel", "voice", F.lit(2).alias("rank"), F.lit(None).cast("string").alias("file"))
    every = declared.union(named).union(none)
    return every.groupBy("channel", "voice").agg(F.min_by("file", F.struct("rank", "file")).alias("file"))


def retry_file(failed: DataFrame) -> DataFrame:
    """``file_name`` and ``text`` of a retry file for failed prompts (``number``, ``text``, ``error``).

    The file reads back to the same numbers; errors stand in comments of one line.
    """
    line = F.concat(F.lit("# "), F.regexp_replace(F.coalesce("error", F.lit("")), r"\s+", " "), F.lit("\n[#"), F.col("number"), F.lit("] "), F.col("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("l")))), lambda x: x["l"]), "\n\n")
    return failed.groupBy("file_name").agg(body.alias("text")).select(F.concat(F.lit("loi_"), "file_name").alias("file_name"), "text")
