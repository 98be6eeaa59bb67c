"""Reproducible shuffles into shards by a Feistel permutation of row numbers.

Rows are numbered by their id over the whole table; a Feistel network permutes the numbers
0 .. n-1, and the permuted number's remainder and quotient by the number of shards are
a row's shard and slot. The network permutes a power of two below 2n; a number that leaves
0 .. n-1 is sent through it again until it falls inside (cycle walking), which keeps it
a permutation. Shard and slot of any row, and the row at any slot, can be computed
from the row's number, n and the seed alone, without a look at other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize
from .runs import SQL_CRC, sql_crc32

#: An even number of rounds, so that the halves of odd widths are back in place.
ROUNDS, SEED = 6, 42
_LOW31 = (1 << 31) - 1
_FACTORS = (1_566_083_941, 1_812_433_253)


def round_keys(seed: int) -> list[int]:
    """31-bit keys of the rounds, from SplitMix64."""
    keys, mask = [], (1 << 64) - 1
    for k in range(1, ROUNDS + 1):
        z = (seed * ROUNDS + k) * 0x9E3779B97F4A7C15 & mask
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        keys.append((z ^ z >> 31) & _LOW31)
    return keys


def widths(n: int) -> tuple[int, int]:
    """Bits of the left and of the right half of the numbers below n."""
    bits = max(2, (n - 1).bit_length())
    if bits > 62:
        raise ValueError("too many rows")
    return bits // 2, bits - bits // 2


def _mixed(half: np.ndarray, key: int) -> np.ndarray:
    t = (half ^ key) * _FACTORS[0] >> 9 & _LOW31
    return (t ^ t >> 13) * _FACTORS[1] >> 11 & _LOW31


def _network(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    a, b = widths(n)
    keys = round_keys(seed)
    left, right = x >> b, x & (1 << b) - 1
    if back:
        for k in reversed(range(ROUNDS)):  # undo: (left, right) came from (right ^ f(left), left)
            size = a if k % 2 == 0 else b
            left, right = right ^ (_mixed(left, keys[k]) & (1 << size) - 1), left
    else:
        for k in range(ROUNDS):
            size = a if k % 2 == 0 else b
            left, right = right, left ^ (_mixed(right, keys[k]) & (1 << size) - 1)
    return left << b | right


def permute(numbers: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Where the permutation of 0 .. n-1 sends each number (``back``: where it comes from)."""
    x = np.asarray(numbers, "i8")
    if len(x) and not 0 <= x.min() <= x.max() < n:
        raise ValueError("row numbers lie between 0 and n - 1")
    x = _network(x, n, seed, back)
    while len(out := np.flatnonzero(x >= n)):
        x[out] = _network(x[out], n, seed, back)
    return x


def shard_and_slot(numbers: np.ndarray, n: int, shards: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each row number and its slot there."""
    x = permute(numbers, n, seed)
    return x % shards, x // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = SEED) -> np.ndarray:
    """The row numbers at places of shards."""
    return permute(np.asarray(slot, "i8") * shards + shard, n, seed, back=True)


def numbered(rows: DataFrame, *order: str | Column) -> tuple[DataFrame, int]:
    """``rows`` with their ``number`` from 0 on in the given order, over the whole table, and how many there are.

    Ranges of the order are sorted each on its own and written to the shared folder; the
    running sum over their sizes (one row for each range, not for each row) gives
    every range its first number. Rows equal in ``order`` come in any order.
    """
    spark, place = rows.sparkSession, F.monotonically_increasing_id()  # range << 33 | place within
    ranged = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", place.alias("_place")), "numbered")
    part = F.shiftright("_place", 33)
    sizes = ranged.groupBy(part.alias("_range")).count().orderBy("_range").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_range"], total))
        total += r["count"]
    first = broadcast_if_small(spark.createDataFrame(starts, "_range long, _first long"))
    number = F.col("_first") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(first, part == first["_range"]).select(*[F.col(f"`{c}`") for c in rows.columns], number.alias("number")), total


def _with_places(rows: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    """``shard`` and ``slot`` instead of ``number``."""

    @F.pandas_udf("shard int, slot long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for numbers in batches:
            shard, slot = shard_and_slot(numbers.to_numpy(), n, shards, seed)
            yield pd.DataFrame({"shard": shard.astype("i4"), "slot": slot})

    others = [F.col(f"`{c}`") for c in rows.columns if c != "number"]
    return rows.select(*others, place("number").alias("_at")).select(*others, "_at.shard", "_at.slot")


def assign(docs: DataFrame, shards: int, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of every row.

    The law is ``rows``: the shards' counts differ by at most one and slots have no
    gaps, whatever ids or texts say; with another number of shards rows move freely, so
    ``grown_shard`` is null, and equal texts are dealt out like any other rows. ``size`` is
    the text's bytes in UTF-8 and one more (null texts: 1), ``text_crc32`` that of null and empty texts 0.
    Numbers follow the id (null first), then checksum and size; rows alike in all three
    are interchangeable. Only these narrow columns are sorted and shuffled.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(docs[id_col].alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows, n = numbered(materialize(narrow, "sizes"), F.col("id").asc_nulls_first(), "text_crc32", "size")
    placed = _with_places(rows, n, shards, seed)
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", rows_a_file: int = 1_000_000) -> DataFrame:
    """Write whole rows as Parquet below ``path/shard=K`` in slot order, and return the table.

    Rows get the places that ``assign`` gives them. Files hold consecutive slots and are
    named in their order, about ``rows_a_file`` rows each, so a large shard is many
    files and no task's work grows with it. Whole rows are shuffled twice: into the order
    of ids, and into that of slots. Columns named ``shard`` or ``slot`` are replaced.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot", "number")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows, n = numbered(docs.select(*others), F.col(id_col).asc_nulls_first(), F.crc32(text), F.octet_length(text))
    placed = _with_places(rows, n, shards, seed)
    files = max(shards, -(-n // rows_a_file))
    by_slot = placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    by_slot.write.partitionBy("shard").mode("errorifexists").parquet(path)
    return docs.sparkSession.read.parquet(path)


def oracle(shards: int, seed: int = SEED) -> str:
    """DuckDB SQL of ``assign`` over ``documents``: one recursion step a round, repeated while a number is outside."""
    keys = ", ".join(map(str, round_keys(seed)))
    once = f"((xor(b, keys[k % {ROUNDS} + 1]) * {_FACTORS[0]}) >> 9) & {_LOW31}"
    twice = f"((xor(t, t >> 13) * {_FACTORS[1]}) >> 11) & {_LOW31}"
    return f"""
WITH RECURSIVE {SQL_CRC}, sized AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, {sql_crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS number, count(*) OVER () AS n FROM sized
), ring AS (
  SELECT greatest(2, length(bin(max(n) - 1))) // 2 AS wa, (greatest(2, length(bin(max(n) - 1))) + 1) // 2 AS wb, [{keys}] AS keys, max(n) AS total FROM numbered
), walk(number, k, a, b, value) AS (
  SELECT number, 0, number >> wb, number & ((1 << wb) - 1), NULL::BIGINT FROM numbered, ring
  UNION ALL
  SELECT number, k + 1, b, c, CASE WHEN (k + 1) % {ROUNDS} = 0 THEN (b << wb) | c END
  FROM (
    SELECT *, xor(a, ({twice}) & ((1 << CASE WHEN k % 2 = 0 THEN wa ELSE wb END) - 1)) AS c
    FROM (SELECT *, {once} AS t FROM walk, ring WHERE value IS NULL OR value >= total)
  )
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (value % {shards})::INT AS shard, value // {shards} AS slot, NULL::INT AS grown_shard
FROM numbered JOIN walk USING (number), ring WHERE value < total
"""
