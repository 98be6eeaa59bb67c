"""SimHash near-duplicates over pivot distance tables.

Every text becomes a 64-bit fingerprint; two are linked if at most ``max_distance``
bits differ. Pivots (fixed reference fingerprints) give each distinct fingerprint a
row of Hamming distances. By the triangle inequality two linked fingerprints differ
by at most ``max_distance`` in every coordinate, so a pair whose largest coordinate
difference is greater is discarded, and only the survivors are compared bit by bit.

Pivot tables alone leave a quadratic number of pairs to look at, since distances to
random pivots crowd around 32. Pairs are therefore looked up within blocks: the 64
bits are cut into ``blocks`` parts, and fingerprints with at most ``max_distance``
different bits agree in at least ``blocks - max_distance`` of them, so each choice of
that many parts is one key. No pair within the distance is lost. Exact copies are one
fingerprint, and in a block only links that join two groups are kept, so a group of
copies of any size costs a linear number of links. Blocks crowded by many fingerprints
are split on Spark: their rows agree in the key, so of ``max_distance + 1`` parts of the
other bits one is equal in a linked pair, and the key is made longer by it. A block that
is left has at most ``CROWDED`` rows, so the comparisons of a row are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, discard, materialize

SEED = 42
#: Reference fingerprints, made by a rule: splitmix64 of 1, 2, 3, ...
N_PIVOTS = 16
#: Blocks of more rows are split by longer keys; rows that a task holds before it works off their blocks.
CROWDED, HELD = 3_000, 100_000


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """n fixed 64-bit reference fingerprints."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return z ^ z >> np.uint64(31)


def pivot_table(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint (row) to each reference (column)."""
    return np.bitwise_count(prints[:, None] ^ refs[None, :])


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """The SimHash of one text (0 if it has no words)."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: only A-Z, only the six ASCII blanks
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = zip(*(words[k : k + n] for k in range(shingle))) if n > 1 else [words]
    hash_of, join = xxhash.xxh64_intdigest, b" ".join
    h = np.fromiter((hash_of(join(g), SEED) for g in grams), "u8", n)
    ones = np.zeros(64, "i8")
    for k in range(0, n, 65536):  # a very long text keeps to bounded memory
        bits = np.unpackbits(h[k : k + 65536].astype(">u8").view("u1").reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> Column:
    """struct(fp, text_hash): the SimHash and the XXH64 of every whole text (null: empty), as longs."""

    @F.pandas_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("text_hash", T.LongType())]))
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for texts in batches:
            made = [(_signed(fingerprint(t or "", shingle)), _signed(xxhash.xxh64_intdigest((t or "").encode(), SEED))) for t in texts]
            yield pd.DataFrame(made, columns=["fp", "text_hash"], dtype="int64")

    return both.asNondeterministic()(docs[text_col])


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of bit positions, cut into parts of about equal size."""
    edges = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:])]


def _block_keys(fp, max_distance: int, blocks: int):
    """Array of one struct(key, mask) for each choice of blocks - max_distance parts of the fingerprint."""
    part = _cut(list(range(64)), blocks)
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - max_distance)):
        mask = F.lit(_signed(sum(part[c] for c in chosen)))
        keys.append(F.struct(F.xxhash64(F.lit(n), fp.bitwiseAND(mask)).alias("key"), mask.alias("mask")))
    return F.array(*keys)


_KEYED = T.StructType([T.StructField("fp", T.LongType()), T.StructField("key", T.LongType()), T.StructField("mask", T.LongType())])


def _longer_keys(rows: DataFrame, max_distance: int) -> DataFrame:
    """The rows of crowded blocks under longer keys.

    Rows of a block agree in the key's bits (``mask``), so the bits in which two linked
    ones differ all lie outside: of ``max_distance + 1`` parts of those one is equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, key, mask = (batch.column(n).to_numpy() for n in ("fp", "key", "mask"))
            for own in np.unique(mask):
                at = np.flatnonzero(mask == own)
                for part in _cut([b for b in range(64) if not int(own) >> b & 1], max_distance + 1):
                    new = np.full(len(at), _signed(int(own) % (1 << 64) | part))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[at], key[at], new)], _KEYED.names)

    longer = rows.select("fp", "key", "mask").mapInArrow(run, _KEYED)
    return longer.select("fp", F.xxhash64("key", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "mask")


def _bounded_blocks(keyed: DataFrame, max_distance: int, most: int) -> DataFrame:
    """``fp`` and ``key`` of all rows, in blocks of at most ``most`` rows.

    Crowded blocks are split on Spark until none is left. It ends: every round cuts the
    bits outside the key by a part, and k bits outside hold at most 2^k fingerprints.
    """
    parts = []
    while True:
        crowded = keyed.groupBy("key").count().where(F.col("count") > most).select("key")
        crowded = materialize(crowded, "crowded-blocks")
        if not crowded.limit(1).count():
            discard(crowded)
            parts.append(keyed.select("fp", "key"))
            break
        some = broadcast_if_small(crowded)
        parts.append(keyed.join(some, "key", "left_anti").select("fp", "key"))
        keyed = materialize(_longer_keys(keyed.join(some, "key", "left_semi"), max_distance), "longer-keys")
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def _small_block_links(prints: np.ndarray, keys: np.ndarray, refs: np.ndarray, max_distance: int):
    """Linked pairs (positions) of rows with equal keys, rows being sorted by key."""
    table = pivot_table(prints, refs).astype("i1")
    for step in range(1, len(keys)):
        at = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(at):
            return
        near = (np.abs(table[at] - table[at + step]).max(axis=1)) <= max_distance
        at = at[near]
        at = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= max_distance]
        yield at, at + step


def _large_block_links(prints: np.ndarray, refs: np.ndarray, max_distance: int):
    """Links that span the groups within one block: each fingerprint is reached once.

    What a frontier reaches leaves the block, so a dense group of near copies costs as
    many comparisons as it has members, not their square.
    """
    table = pivot_table(prints, refs).astype("i1")
    left = np.arange(len(prints))
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            near = np.abs(table[left, 0] - table[one, 0]) <= max_distance
            for c in range(1, table.shape[1], 5):
                some = np.flatnonzero(near)
                if not len(some):
                    break
                near[some] = np.abs(table[left[some], c : c + 5] - table[one, c : c + 5]).max(axis=1) <= max_distance
            some = np.flatnonzero(near)
            some = some[np.bitwise_count(prints[left[some]] ^ prints[one]) <= max_distance]
            if len(some):
                found = left[some]
                yield np.full(len(found), one), found
                frontier.extend(found.tolist())
                left = np.delete(left, some)


def links(
    distinct: DataFrame, max_distance: int = 3, blocks: int = 5, n_pivots: int = N_PIVOTS, large: int = 64, most: int = CROWDED
) -> DataFrame:
    """Links (``a``, ``b``) between the distinct fingerprints of column ``fp``.

    Within a block of more than ``large`` rows only links that span its groups are
    returned, else all; either way the connected components are those of all links.
    A block's rows pass through one task, whole partitions of blocks at a time; keys are
    64 / blocks * (blocks - max_distance) bits wide. Blocks of more than ``most`` rows are
    first split by longer keys, so what a task holds at once is bounded whatever the rows.
    """
    if not 0 < max_distance < blocks:
        raise ValueError("blocks must exceed max_distance")
    if most < 1 << max_distance + 1:
        raise ValueError("blocks of so few rows may not be split further")
    refs = pivots(n_pivots)
    keyed = distinct.select("fp", F.inline(_block_keys(F.col("fp"), max_distance, blocks)))
    rows = _bounded_blocks(keyed, max_distance, most).repartition("key").sortWithinPartitions("key", "fp")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def emit(prints, pairs):
        for a, b in pairs:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(prints[a].view("i8")), pa.array(prints[b].view("i8"))], ["a", "b"])

    def work(keys, prints):
        bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        sizes = np.diff(bounds)
        small = np.repeat(sizes <= large, sizes)
        yield from emit(p := prints[small], _small_block_links(p, keys[small], refs, max_distance))
        for k in np.flatnonzero(sizes > large):
            yield from emit(p := prints[bounds[k] : bounds[k + 1]], _large_block_links(p, refs, max_distance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count, full = 0, HELD
        for batch in batches:
            held.append((batch.column("key").to_numpy(), batch.column("fp").to_numpy().view("u8")))
            count += len(batch)
            if count >= full:
                keys, prints = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(keys, keys[-1]))  # the last block may go on
                if cut:
                    yield from work(keys[:cut], prints[:cut])
                held, count = [(keys[cut:], prints[cut:])], len(keys) - cut
                full = max(HELD, 2 * count)
        if count:
            yield from work(*(np.concatenate(x) for x in zip(*held)))

    return rows.select("key", "fp").mapInArrow(run, schema).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) of every node in the edges (``a``, ``b``).

    Alternating large-star and small-star steps; each is two grouped aggregations, the
    number of rounds is logarithmic in practice, and the edges of every round are written
    to the shared folder. Self links and repeated edges are harmless.
    """
    current = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = materialize(small, "edges")
        discard(current)
        # a star forest: each node has one edge, and no centre is itself a leaf
        leaves = after.groupBy("u").count()
        many = leaves.where("count > 1").limit(1).count()
        deep = 0 if many else after.join(leaves.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        current = after
        if not many and not deep:
            out = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._shared_folder = current._shared_folder
            return out


def _grouped(prints: DataFrame, max_distance: int) -> DataFrame:
    """``fp``, ``root`` and ``component_id`` (least ``id`` of the component) of each distinct fingerprint of ``prints``."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    found = components(links(distinct.select("fp"), max_distance))
    # nodes are fingerprints; a component's id is the least of its members' first ids
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    out = materialize(rooted.join(least, "root").select("fp", "root", "component_id"), "components")
    discard(distinct, found)
    return out


def near_duplicates(docs: DataFrame, max_distance: int = 3, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, ``fingerprint`` (16 hex digits) and ``component_id`` of every document.

    ``component_id`` is the smallest id among the documents reachable over links of at
    most ``max_distance`` bits. Null and empty texts have the fingerprint zero and are
    linked like any other. A row with a null id gets its fingerprint's component, and is
    null only if no document there has an id; repeated ids give repeated rows. An empty
    table gives an empty table.
    """
    prints = materialize(docs.select(docs[id_col].alias("id"), with_fingerprint(docs, text_col, shingle)["fp"].alias("fp")), "fingerprints")
    groups = _grouped(prints, max_distance)
    return prints.join(groups, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_distance: int = 3, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, unchanged, with one document of each group of near-duplicates.

    The row of the least id stays (null ids last; among equal ids the one of the least
    text hash); of wholly repeated rows one stays. Rows are written once with their
    fingerprint and a number; the numbers of those that go are then taken out, which
    shuffles texts only if they outgrow a broadcast.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(row, docs[id_col].alias("id"), with_fingerprint(docs, text_col, shingle).alias("print"))
    rows = materialize(marked.select("row", "id", "print.*", F.monotonically_increasing_id().alias("number")), "fingerprints")
    prints = rows.select("id", "fp", "text_hash", "number")
    groups = _grouped(prints, max_distance)
    placed = prints.join(groups.select("fp", "root"), "fp").select("root", "number", F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "number").alias("order"))
    first = placed.groupBy("root").agg(F.min("order").alias("first"), F.count("*").alias("n")).where("n > 1").select("root", F.col("first.number").alias("stays"))
    first = materialize(first, "group-heads")
    gone = materialize(placed.join(broadcast_if_small(first), "root").where("number <> stays").select("number"), "duplicates")
    discard(first, groups)
    return rows.join(broadcast_if_small(gone), "number", "left_anti").select("row.*")
