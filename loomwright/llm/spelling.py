"""Spelling variants: words one edit apart, found by bands of letter-parity masks.

A word's mask has a bit for each letter (other code points share some more): whether it
occurs an odd number of times. An inserted or deleted letter flips one bit, a replaced one at most
two, so of three bands of the mask one is equal in words of one length that are near, and one
of any two in words of lengths that differ by one. Words are joined on equal bands with
the length, compared by mask, then verified letter by letter. Since an edit also leaves the
part of the word before it or after it alone, keys hold that half as well: large vocabularies
crowd the few hundred values of a band, and with it comparisons no longer grow with their
square. No pair is lost, and nothing is capped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, pieces
from .runs import SQL_CRC, sql_crc32

#: Letters by frequency, dealt out to the bands in turn; other code points by remainder.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
N_BITS, N_BANDS = 63, 3
BANDS = [sum(1 << b for b in range(k, N_BITS, N_BANDS)) for k in range(N_BANDS)]
#: Words that a task counts before it hands them on.
HELD_WORDS = 200_000


def bit_of(letter: str) -> int:
    place = LETTERS.find(letter)
    return place if place >= 0 else len(LETTERS) + ord(letter) % (N_BITS - len(LETTERS))


def parity_mask(word: str) -> int:
    mask = 0
    for letter in word:
        mask ^= 1 << bit_of(letter)
    return mask


def word_counts(
    docs: DataFrame,
    shortest: int = 7,
    change: Callable[[object], Callable[[str], str]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``word`` and ``n``, its occurrences in all texts, of every run of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased).

    Words of fewer than ``shortest`` code points are left out. ``change``, called with a
    row's id, gives a function that words of ``shortest`` code points and more pass through first.
    Texts are counted document by document; tasks hand on sums, which are added up by word.
    """
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        find = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}").findall  # greedy: whole runs
        held: Counter[str] = Counter()

        def sums():
            return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], schema.names)

        for batch in (p for b in batches for p in pieces(b)):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                found = Counter(find(text.encode().lower().decode()))  # of bytes: only A-Z
                if change is None:
                    held.update(found)
                    continue
                changed = change(key)
                for word, n in found.items():
                    word = changed(word)
                    if len(word) >= shortest:
                        held[word] += n
            if len(held) > HELD_WORDS:
                yield sums()
                held.clear()
        if held:
            yield sums()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def with_masks(words: DataFrame) -> DataFrame:
    """``word``, ``n``, its ``size`` in code points and its ``mask``, written to the shared folder."""

    @F.pandas_udf("long")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits: dict[str, int] = {}
        for some in batches:
            made = []
            for word in some:
                m = 0
                for letter in word:
                    bit = bits.get(letter)
                    if bit is None:
                        bit = bits[letter] = 1 << bit_of(letter)
                    m ^= bit
                made.append(m)
            yield pd.Series(made, dtype="int64")

    return materialize(words.select("word", "n", F.length("word").alias("size"), mask("word").alias("mask")), "words")


def _keyed(words: DataFrame, size: Column, bands: int, before: Column, after: Column) -> DataFrame:
    """Each word once for each band and each half (what stands before and after the middle)."""
    keys = [
        F.struct(F.xxhash64(size, F.lit(band), F.col("mask").bitwiseAND(F.lit(BANDS[band])), F.lit(side), part).alias("key"), F.lit(band).alias("band"), F.lit(side).alias("side"))
        for band in range(bands)
        for side, part in enumerate((before, after))
    ]
    return words.select("word", "n", "size", "mask", F.inline(F.array(*keys)))


def _pairs(left: DataFrame, right: DataFrame, ordered: bool) -> DataFrame:
    """Near words of equal keys, each pair once."""
    x, y = left.alias("x"), right.alias("y")
    differs = F.col("x.mask").bitwiseXOR(F.col("y.mask"))
    # bands and halves are those of the first key that the two share
    first = F.when(F.col("x.band") == 0, F.lit(True))
    for band in range(1, N_BANDS):
        earlier = F.lit(True)
        for k in range(band):
            earlier = earlier & (differs.bitwiseAND(F.lit(BANDS[k])) != 0)
        first = first.when(F.col("x.band") == band, earlier)
    half = F.floor(F.col("x.size") / 2).cast("int")
    condition = (F.col("x.key") == F.col("y.key")) & (F.bit_count(differs) <= (2 if ordered else 1))
    if ordered:
        condition = condition & (F.col("x.word") < F.col("y.word"))
    condition = (
        condition
        & (F.col("x.band") == F.col("y.band"))
        & first
        & ((F.col("x.side") == 0) | (F.left(F.col("x.word"), half) != F.left(F.col("y.word"), half)))
        & (F.levenshtein("x.word", "y.word", 1) == 1)
    )
    return x.join(y, condition).select(F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n"))


def near_words(words: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` (with their counts ``a_n``, ``b_n``) of words one edit apart, each once, from ``with_masks``' table."""
    half = F.floor(F.col("size") / 2).cast("int")
    own = _keyed(words, F.col("size"), N_BANDS, F.left("word", half), F.substring("word", half + 1, F.col("size")))
    shorter = _keyed(words, F.col("size"), N_BANDS - 1, F.left("word", half), F.substring("word", half + 1, F.col("size")))
    # of the longer word what remains of its halves when a letter is taken out before or behind the middle
    less = F.col("size") - 1
    middle = F.floor(less / 2).cast("int")
    longer = _keyed(words, less, N_BANDS - 1, F.left("word", middle), F.substring("word", middle + 2, F.col("size")))
    return _pairs(own, own, True).union(_pairs(shorter, longer, False))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and the ``root`` that its chain of ``form`` leads to, for every word with a form.

    Chains are halved in every round (pointer doubling). They can't have cycles if counts
    grow along them, and their length is at most the logarithm of the greatest count.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialize(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        now = after
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every row of ``word``, ``n``.

    Words are distinct and not null. Near words differ by exactly one inserted, deleted or replaced code point. The
    form is the near word of the greatest n (ties: the smallest in code-point order) if
    that is at least ``factor`` (2 or more) times the word's own n, else null; the root is where
    forms lead in the end, the word itself without one. An empty table gives an empty table.
    """
    if factor < 2:
        raise ValueError("forms must be more frequent than their words")
    known = with_masks(words)
    pairs = near_words(known)
    near = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word")).alias("near")), F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("word")).alias("near")))))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    enough = -F.col("best.less") >= factor * F.col("n")
    found = materialize(
        known.join(best, "word", "left").select(
            "word", F.when(enough, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n")
        ),
        "near-words",
    )
    discard(known)
    led = roots(found.where("form IS NOT NULL"))
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = rf"""
WITH RECURSIVE {SQL_CRC}, found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), counted AS (
  SELECT doc_id, w, count(*) AS n FROM found WHERE length(w) >= 7 GROUP BY doc_id, w
), hashed AS (
  SELECT w, n, {sql_crc32("doc_id || ':' || w")} AS h FROM counted, crc
), words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n FROM pairs GROUP BY word
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), led(word, root) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT led.word, formed.form FROM led JOIN formed ON led.root = formed.word WHERE formed.form IS NOT NULL
)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT led.word, led.root FROM led JOIN formed ON led.root = formed.word WHERE formed.form IS NULL) l USING (word)
"""
