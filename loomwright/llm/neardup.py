"""Near-duplicates by shingle similarity: min-hash bands, SimHash pivot tables and distance, exact verification.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more differ in
about ten bits of a 64-bit SimHash, far more than blocks of equal bits can bridge. Their
candidates are therefore sought by min-hash: ``BANDS`` keys, each of ``ROWS`` minima, one of which is
equal for 998 in 1,000 pairs of similarity 0.8 and for more above. Of texts with an equal
key those are discarded whose numbers of shingles rule the similarity out, then those whose rows of the
pivot distance table (Hamming distances of the fingerprint to fixed references) differ by more than
``FAR`` in any coordinate, then those whose fingerprints themselves do, and the rest are verified by
the exact similarity of their shingle sets.

A crowded key isn't paired with itself: its rows are compared with a few heads, and those found
similar become one group. Of the rows outside the key's largest group those stay that may be similar to a row
of another group, and of the largest group those that may be to one of them: two semi-joins, which make no pairs. What is left
is compared in full if it is little, else by four times as many heads, and so on. No pair of different groups that
may be similar stays untried, a group of near copies costs about one comparison a copy, whatever its size,
and only new links between groups are put into components.

Copies that were changed too much belong to none, and would be compared with every row of their key. What
keeps them apart is known beforehand: shingles of their own, which no other text of the crowded keys
has, lie in no intersection, nor do others whose bit in a map of the shingles isn't set in the other's map. With those counted, a
pair's similarity has an exact upper bound; pairs below the bound are never made, and rows of which the least are their own are the first heads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, discard, give_back, materialize, pieces
from .simhash import N_PIVOTS, SEED, _signed, components, pivots

BANDS, ROWS = 20, 6
#: Bits in which fingerprints of similar texts may differ: at a similarity of 0.8 about 9.7 +- 2.9 do.
FAR = 22
#: Keys of at most so many rows are compared in full; others with so many heads in the first round.
FULL, HEADS = 64, 4
#: Words of 64 bits in the maps of common shingles.
MAP_WORDS = 16

_FACTORS = pivots(BANDS * ROWS) | np.uint64(1)


def shingle_hashes(text: str, shingle: int = 5) -> np.ndarray:
    """XXH64 of every shingle of the text's words (A-Z lower-cased), in order; of fewer words the whole is one, of none there is one as well."""
    import xxhash

    words = text.encode().lower().split()
    n = max(1, len(words) - shingle + 1)
    grams = zip(*(words[k : k + n] for k in range(shingle))) if n > 1 else [words]
    hash_of, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((hash_of(join(g), SEED) for g in grams), "u8", n)


def fingerprint_of(hashes: np.ndarray) -> int:
    ones = np.zeros(64, "i8")
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].astype(">u8").view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def band_keys(distinct: np.ndarray) -> list[int]:
    """A key for each band: the hash of the least values of its ``ROWS`` hash functions."""
    import xxhash

    least = np.full(len(_FACTORS), np.iinfo("u8").max, "u8")
    for k in range(0, len(distinct), 512):
        np.minimum(least, (distinct[k : k + 512, None] * _FACTORS).min(axis=0), out=least)
    return [_signed(xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k)) for k in range(BANDS)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


_SKETCH = "fp long, text_hash long, n int, keys array<long>"


def _with_sketch(text: str, shingle: int):
    @F.pandas_udf(_SKETCH)
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for texts in batches:
            made = []
            for t in texts:
                t = t or ""
                hashes = shingle_hashes(t, shingle)
                distinct = np.unique(hashes)
                made.append((_signed(fingerprint_of(hashes)), _signed(xxhash.xxh64_intdigest(t.encode(), SEED)), len(distinct), band_keys(distinct)))
            yield pd.DataFrame(made, columns=["fp", "text_hash", "n", "keys"])
        give_back()

    return sketch.asNondeterministic()(text)


def _near(x: str, y: str, least: float):
    """Whether sizes, pivot tables and fingerprints of two sides allow the similarity.

    A pivot table's row is made of the fingerprint where it is needed, which takes less than to shuffle it.
    """
    sizes = F.least(f"{x}.n", f"{y}.n") >= least * F.greatest(f"{x}.n", f"{y}.n")
    a, b = F.col(f"{x}.fp"), F.col(f"{y}.fp")
    refs = [F.lit(_signed(int(p))) for p in pivots(N_PIVOTS)]
    largest = F.greatest(*[F.abs(F.bit_count(a.bitwiseXOR(p)) - F.bit_count(b.bitwiseXOR(p))) for p in refs])
    return sizes & (largest <= FAR) & (F.bit_count(a.bitwiseXOR(b)) <= FAR)


def _own_allow(x: str, y: str, least: float):
    """Whether what one of two texts of crowded keys has and the other can't have allows the similarity.

    That is the shingles of its own (``own``), and at least one more for every bit that only its map has. The
    intersection is ``m`` at most, what is left of either, and the union has ``m`` less than both sizes.
    """

    def left(p: str, q: str):
        only = [F.bit_count(F.col(f"{p}.map")[k].bitwiseAND(F.bitwise_not(F.col(f"{q}.map")[k]))) for k in range(MAP_WORDS)]
        return F.col(f"{p}.n") - F.col(f"{p}.own") - sum(only[1:], only[0])

    def allowed(m):
        return (1 + least) * m + 1e-6 >= least * (F.col(f"{x}.n") + F.col(f"{y}.n"))

    owned = F.least(F.col(f"{x}.n") - F.col(f"{x}.own"), F.col(f"{y}.n") - F.col(f"{y}.own"))
    return allowed(owned) & allowed(left(x, y)) & allowed(left(y, x))


def _own_shingles(some: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``number``, ``own`` and ``map`` of the texts in ``some``: how many of its shingles no other of them has, and the bits of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.unique(shingle_hashes(text or "", shingle)).view("i8")
                for k in range(0, len(found), 65536):
                    some = found[k : k + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number, "i8")), pa.array(some)], ["number", "hash"])
        give_back()

    hashes = texts.join(broadcast_if_small(some), "number", "left_semi").select("number", "text").mapInArrow(run, "number long, hash long")
    hashes = materialize(hashes, "crowded-shingles")
    single = hashes.groupBy("hash").agg(F.count("*").alias("many"), F.min("number").alias("number")).where("many = 1").select("number", "hash")
    # all are counted by bit, and those of their own taken off again: they would count twice if they had a bit
    place = F.pmod(F.col("hash"), F.lit(64 * MAP_WORDS)).alias("place")
    marks = hashes.select("number", place, F.lit(1).alias("all"), F.lit(0).alias("alone")).union(single.select("number", place, F.lit(0), F.lit(1)))
    counted = marks.groupBy("number", "place").agg(F.sum("all").alias("all"), F.sum("alone").alias("alone"))
    bit = F.when(F.col("all") > F.col("alone"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))).otherwise(F.lit(0).cast("long"))
    words = [F.bit_or(F.when(F.floor(F.col("place") / 64) == k, bit).otherwise(F.lit(0).cast("long"))) for k in range(MAP_WORDS)]
    out = materialize(counted.groupBy("number").agg(F.sum("alone").cast("int").alias("own"), F.array(*words).alias("map")), "own-shingles")
    discard(hashes)
    return out


def _crowded_rows(live: DataFrame, sizes: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Rows of crowded keys with ``own`` and ``map``, without those that ``own`` leaves too few common shingles for any similarity; all are ``outside``."""
    rows = materialize(live.join(broadcast_if_small(sizes.where(F.col("count") > FULL).select("key")), "key", "left_semi"), "crowded-keys")
    some = materialize(rows.select("number").distinct(), "crowded-texts")
    own = _own_shingles(some, texts, shingle)
    allowed = rows.join(broadcast_if_small(own), "number").where(F.col("n") - F.col("own") + 1e-6 >= least * F.col("n"))
    out = materialize(allowed.withColumn("outside", F.lit(True)), "crowded-rows")
    discard(rows, some, own)
    return out


def _full_pairs(rows: DataFrame, near) -> DataFrame:
    """The pairs (``a`` < ``b``) of each key's rows that are of different groups and ``near`` (a condition on ``x`` and ``y``)."""
    x, y = rows.alias("x"), rows.alias("y")
    both = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.number") < F.col("y.number")) & (F.col("x.group") != F.col("y.group")) & near)
    return both.select(F.col("x.number").alias("a"), F.col("y.number").alias("b"))


def _may_link(least: float):
    """Whether rows ``x`` and ``y`` of crowded keys are of one key and different groups, and may be similar."""
    return (F.col("x.key") == F.col("y.key")) & (F.col("x.group") != F.col("y.group")) & _own_allow("x", "y", least) & _near("x", "y", least)


def _heads(crowded: DataFrame, n_heads: int) -> DataFrame:
    """So many rows of each key outside its largest group, those first of which the least are their own."""
    salt = F.pmod(F.xxhash64("number"), F.lit(n_heads)).alias("salt")
    heads = crowded.where("outside").groupBy("key", salt).agg(F.min(F.struct("own", "number", "group", "fp", "n", "map")).alias("h"))
    return materialize(heads.select("key", "h.*"), "key-heads")


def _head_pairs(crowded: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """The pairs (``a`` < ``b``) of heads and all rows of other groups of their key."""
    large = crowded.alias("x").join(broadcast_if_small(heads).alias("y"), _may_link(least))
    return large.select(F.least("x.number", "y.number").alias("a"), F.greatest("x.number", "y.number").alias("b"))


def _open_rows(crowded: DataFrame, heads: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """What is left to compare: the rows that may be similar to one of another group of their key, heads left out.

    Of two rows of different groups one at least is ``outside`` the key's largest group. Whether such a row has a partner is a
    semi-join, which makes one row at most of each; partners in the largest group are looked up from the few that have.
    """
    rest = crowded.drop("group", "outside").join(broadcast_if_small(heads.select("key", "number")), ["key", "number"], "left_anti")
    rest = rest.join(broadcast_if_small(groups), rest["number"] == groups["node"], "left")
    rest = materialize(rest.select("key", "number", "fp", "n", "own", "map", F.coalesce("root", "number").alias("group")), "crowded-rest")
    main = rest.groupBy("key", "group").count().groupBy("key").agg(F.max_by("group", F.struct("count", "group")).alias("main"), F.count("*").alias("many"))
    main = materialize(main.where("many > 1").select("key", "main"), "main-groups")
    mixed = rest.join(broadcast_if_small(main), "key").withColumn("outside", F.col("group") != F.col("main")).drop("main")
    mixed = materialize(mixed, "mixed-rows")
    some = materialize(mixed.where("outside").alias("x").join(broadcast_if_small(mixed).alias("y"), _may_link(least), "left_semi"), "open-rows")
    partners = mixed.where("NOT outside").alias("x").join(broadcast_if_small(some).alias("y"), _may_link(least), "left_semi")
    out = materialize(some.union(partners), "crowded-rows")
    discard(rest, main, mixed, some)
    return out


def _merged(groups: DataFrame | None, found: DataFrame) -> DataFrame:
    """``groups`` (``node``, ``root``) with new links: only the roots of what they link are put into components."""
    if groups is None:
        return components(found)
    for side in ("a", "b"):
        found = found.join(broadcast_if_small(groups), found[side] == groups["node"], "left").withColumn(side, F.coalesce("root", side)).select("a", "b")
    new = components(found)
    moved = broadcast_if_small(new.select(F.col("node").alias("before"), F.col("root").alias("after")))
    kept = groups.join(moved, groups["root"] == F.col("before"), "left").select("node", F.coalesce("after", "root").alias("root"))
    out = materialize(kept.union(new), "groups")
    discard(groups, new)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs whose texts (``number``, ``text``) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, 2)):
            known: dict[str | None, np.ndarray] = {}

            def of(t):
                if t not in known:
                    known[t] = np.unique(shingle_hashes(t or "", shingle))  # noqa: B023
                return known[t]  # noqa: B023

            kept = [similarity(of(x), of(y)) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))
        give_back()

    few = broadcast_if_small(pairs)
    first = texts.select(F.col("number").alias("a"), F.col("text").alias("first")).join(few, "a")
    needed = broadcast_if_small(pairs.select("b").distinct())
    second = texts.select(F.col("number").alias("b"), F.col("text").alias("second")).join(needed, "b", "left_semi")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return first.join(second, "b").select("a", "b", "first", "second").mapInArrow(run, schema)


def similar_groups(distinct: DataFrame, texts: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``node`` and ``root`` (its least member) of every number that is similar to a smaller one.

    ``distinct``: ``number``, ``fp``, ``n``, ``keys``, one row for each different text; ``texts``:
    ``number``, ``text``.
    """
    live = materialize(distinct.select(F.explode("keys").alias("key"), "number", F.col("number").alias("group"), "fp", "n"), "band-keys")
    sizes = materialize(live.groupBy("key").count().where("count > 1"), "key-sizes")
    crowded = _crowded_rows(live, sizes, texts, shingle, least)
    near = _near("x", "y", least)
    full = live.join(broadcast_if_small(sizes.where(F.col("count") <= FULL).select("key")), "key")
    tried = groups = None
    n_heads = HEADS
    while True:
        heads = _heads(crowded, n_heads)
        pairs = _full_pairs(full, near).union(_head_pairs(crowded, heads, least)).distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "candidates")
        tried = pairs if tried is None else tried.union(pairs)
        groups = _merged(groups, materialize(_verified(pairs, texts, shingle, least), "links"))
        rows = _open_rows(crowded, heads, groups, least)
        discard(crowded, heads)
        sizes = materialize(rows.groupBy("key").count(), "key-sizes")
        if not sizes.limit(1).count():
            return groups
        few = F.col("count") <= FULL
        full, near = rows.join(broadcast_if_small(sizes.where(few).select("key")), "key"), _may_link(least)
        crowded = materialize(rows.join(broadcast_if_small(sizes.where(~few).select("key")), "key"), "crowded-rows")
        n_heads *= 4


def keep_one(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, with one document of each group of similar texts.

    Groups are connected by similarities of ``least`` or more between sets of ``shingle``-word
    shingles (of a text with fewer words the whole is its only shingle; texts without words, null and empty
    ones too, are similar to each other). The row of the least id stays (null ids last;
    among equal ids the one of the least text hash); of wholly repeated rows one stays. An empty table gives an empty table.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(row, docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    marked = marked.select("row", "id", _with_sketch("text", shingle).alias("sketch"), F.monotonically_increasing_id().alias("number"))
    rows = materialize(marked.select("row", "id", "number", "sketch.*"), "sketches")
    same = ["text_hash", "fp"]  # one row for each different text goes on
    texts = materialize(rows.groupBy(*same).agg(F.min("number").alias("number"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys")), "different-texts")
    groups = similar_groups(texts, rows.select("number", F.col(f"row.`{text_col}`").alias("text")), shingle, least)
    rooted = texts.join(groups, texts["number"] == groups["node"], "left").select(*same, F.coalesce("root", "number").alias("root"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "number").alias("order")
    placed = rows.select("id", "number", *same).join(rooted, same).select("root", "number", order)
    first = placed.groupBy("root").agg(F.min("order").alias("first"), F.count("*").alias("many")).where("many > 1").select("root", F.col("first.number").alias("stays"))
    first = materialize(first, "group-heads")
    gone = materialize(placed.join(broadcast_if_small(first), "root").where("number <> stays").select("number"), "duplicates")
    return rows.join(broadcast_if_small(gone), "number", "left_anti").select("row.*")
