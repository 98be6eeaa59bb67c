"""Operators 11 to 13 against brute-force versions."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import registry, runs, shards, spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, number string, word string, n int, shard string"


def brute_runs(words, times=4, shortest=6):
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(shortest, times * p):
                found.setdefault((i, j - i + p), p)
            i = j
    return sorted((s, m, p) for (s, m), p in found.items())


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            t = []
            while len(t) < rng.randrange(0, 90):
                block = [rng.randrange(rng.choice((1, 2, 3, 50))) for _ in range(rng.randrange(1, 9))]
                t += block * rng.choice((1, 1, 2, 4, 5, 9)) + block[: rng.randrange(3)]
            texts.append(t)
        times, shortest = rng.choice(((4, 6), (2, 2), (3, 9)))
        assert runs.find_runs(texts, times, shortest) == [brute_runs(t, times, shortest) for t in texts]


def test_runs_of_long_texts():
    assert runs.find_runs([[7] * 5000]) == [[(0, 5000, 1)]]
    x = list(range(1000))
    assert runs.find_runs([[5000] + x * 5 + x[:10], [], x]) == [[(1, 5010, 1000)], [], []]
    with pytest.raises(ValueError):
        runs.find_runs([[1, 1]], times=1)


def test_range_minima_and_extensions():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 1000, 700).astype("i4")
    a, b = np.sort(rng.integers(0, 700, (2, 3000)), axis=0)
    assert runs.RangeMin(v).least(a, b).tolist() == [v[x : y + 1].min() for x, y in zip(a, b)]
    s = rng.integers(0, 2, 200)
    a, b = rng.integers(0, 200, (2, 2000))
    a, b = a[a != b], b[a != b]
    common = lambda x, y: next((k for k in range(200) if max(x, y) + k == 200 or s[x + k] != s[y + k]), 200)
    assert runs.Extensions(s).of(a, b).tolist() == [common(x, y) for x, y in zip(a, b)]


def test_runs_of_odd_tables(spark):
    rows = [(None, "a a a a a a b", None, None, 1, None), (1, None, None, None, 1, None), (1, "", "x", "y", 1, "z"), (1, "", "x", "y", 1, "z"), (2, " \n\t", None, None, 1, None), (3, "x y " * 200_000, None, None, 1, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r[0], r[1], tuple(map(tuple, r[2])), r[3]) for r in runs.periodic_runs(docs, ("n_words", "runs", "collapsed")).collect()}
    assert got == {(None, 7, ((0, 6, 1),), "a b"), (1, 0, (), ""), (2, 0, (), ""), (3, 200_000, ((0, 200_000, 1),), "x y")}
    assert runs.periodic_runs(docs).count() == 6 and runs.periodic_runs(docs.limit(0)).count() == 0
    none = runs.periodic_runs(docs.where("text = ''"), ("n_runs", "start", "length", "period", "exponent_milli")).first()
    assert tuple(none)[1:] == (0, None, None, None, None)


def test_repeated_tails_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r[0]: r[1] for r in registry.repeated_tails(docs).collect()}
    changed = 0
    for i, text in ((r["doc_id"], r["text"]) for r in docs.collect()):
        words, h = (text or "").encode().split(), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            changed += 1
        assert (texts[i] or "").encode().split() == words
    assert changed


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 100, 1000, 4097])
def test_permutation(n):
    for seed in (0, 42):
        all_rows = np.arange(n)
        to = shards.permute(all_rows, n, seed)
        assert sorted(to.tolist()) == all_rows.tolist()
        assert (shards.permute(to, n, seed, back=True) == all_rows).all()
        shard, slot = shards.shard_and_slot(all_rows, n, 8, seed)
        assert (shards.row_at(shard, slot, n, 8, seed) == all_rows).all()
    if n == 4097:
        assert (to != shards.permute(all_rows, n, 1)).mean() > 0.99
        spread = np.abs(np.diff(to)).mean() / n  # a random order has a third
        assert 0.3 < spread < 0.37
        counts = np.bincount((to[: n // 4] * 16 // n), minlength=16)
        assert counts.min() > 40 and counts.max() < 90


def test_large_permutations():
    n = (1 << 40) + 12345
    some = np.random.default_rng(1).integers(0, n, 10_000)
    to = shards.permute(some, n)
    assert (shards.permute(to, n, back=True) == some).all() and len(np.unique(to)) == len(np.unique(some))
    with pytest.raises(ValueError):
        shards.permute(np.array([n]), n)


def test_assigned_shards(spark):
    rows = [(k if k % 5 else None, "é" * (k % 4) if k % 7 else None, "n", "w", 1, "s") for k in range(101)] + [(3, "x", "n", "w", 1, "s")] * 20
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for m in (1, 8, 200):
        got = shards.assign(docs, m).collect()
        slots = {}
        for r in got:
            slots.setdefault(r["shard"], []).append(r["slot"])
            assert r["law"] == "rows" and r["grown_shard"] is None
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert sum(map(len, slots.values())) == 121 and set(slots) == set(range(min(m, 121)))
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    text = lambda t: (t or "").encode()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1, len(text(t)) + 1, zlib.crc32(text(t))) for i, t, *_ in rows)
    again = shards.assign(docs.repartition(7), 8)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(again) == key(shards.assign(docs, 8))  # layouts don't matter
    assert shards.assign(docs.limit(0), 8).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("shard", F.lit("old"))
    back = shards.write_shards(docs, f"file://{tmp_path}/shards", 8, rows_a_file=10)
    assert set(back.columns) == {*docs.columns, "slot"}
    expected = {(r["doc_id"], r["shard"], r["slot"]) for r in shards.assign(docs, 8).collect()}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in back.collect()} == expected
    assert back.join(docs.drop("shard"), ["doc_id", "text"]).count() == docs.where("text IS NOT NULL").count()
    of = back.select(F.input_file_name().alias("f"), "shard", "slot").groupBy("f", "shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n")).collect()
    assert len(of) > 8 and all(r["b"] - r["a"] + 1 == r["n"] for r in of)  # consecutive slots in every file


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n):
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= 10 * n[a] else None
    out = set()
    for a in n:
        root = a
        while form[root] is not None:
            root = form[root]
        out.add((a, form[a], root, n[a], len(near[a]), form[a] and n[form[a]]))
    return out


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    words = {}
    for _ in range(60):
        base = "".join(rng.choice("abeñéx×") for _ in range(rng.randrange(1, 12)))
        words.setdefault(base, rng.choice((200, 3000)))
        for _ in range(8):
            k = rng.randrange(len(base) + 1)
            other = rng.choice((base[:k] + rng.choice("abéz") + base[k:], base[:k] + base[k + 1 :], base[:k] + rng.choice("abéz") + base[k + 1 :]))
            words.setdefault(other, rng.choice((1, 2, 20, 21, 300)))
    words.pop("", None)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = brute_variants(words)
    assert set(map(tuple, got.collect())) == expected and got.count() == len(words)
    assert len({r for _, f, r, *_ in expected if f and r != f}) > 0  # chains of forms occur
    assert spelling.variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(df, factor=1)


def test_masks_differ_in_two_bits_at_most():
    rng = random.Random(2)
    letters = spelling.LETTERS + "".join(map(chr, range(0xC0, 0x100)))
    assert len(set(spelling.LETTERS)) == 26 and sum(spelling.BANDS) == (1 << spelling.N_BITS) - 1
    for _ in range(2000):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 15)))
        k = rng.randrange(len(w))
        x = spelling.parity_mask(w) ^ spelling.parity_mask(w[:k] + rng.choice(letters) + w[k + 1 :])
        y = spelling.parity_mask(w) ^ spelling.parity_mask(w[:k] + w[k + 1 :])
        assert x.bit_count() in (0, 2) and y.bit_count() == 1
        assert any(not x & band for band in spelling.BANDS) and sum(not y & band for band in spelling.BANDS) == 2


def test_word_counts(spark):
    rows = [(1, "ÀBCDEFGH àbcdefgh Àbcdefgh1xyzxyzx\nÀbcdefgh ÿ÷×ÿ÷×ÿ", "n", "w", 1, "s"), (None, "Abcdefg-abcdefg ĀABCDEFG", None, None, None, None), (2, None, "n", "w", 1, "s"), (2, "", "n", "w", 1, "s"), (3, "abcdefg " * 100_000, "n", "w", 1, "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert dict(map(tuple, spelling.word_counts(docs).collect())) == {"Àbcdefgh": 3, "àbcdefgh": 1, "xyzxyzx": 1, "ÿ÷×ÿ÷×ÿ": 1, "abcdefg": 100_003}
    assert spelling.word_counts(docs, shortest=8).count() == 2
    assert spelling.word_counts(docs.limit(0)).count() == 0
    drops = spelling.word_counts(docs, change=lambda key: lambda word: word[1:] if key == 1 else word)
    assert dict(map(tuple, drops.collect())) == {"bcdefgh": 4, "abcdefg": 100_003}
    lost = [w for w in ("word%d" % k for k in range(1000)) if registry.lost_letter(7)(w) != w]
    assert lost == [w for w in ("word%d" % k for k in range(1000)) if zlib.crc32(f"7:{w}".encode()) % 31 == 0] and lost
    assert registry.lost_letter(None)("abc") == "abc"


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_sharding", "op13_spelling_variants"])
def test_queries_equal_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    sql = duckdb.sql(registry.ORACLE_SQL[name].replace("FROM documents", f"FROM '{SF}/documents.parquet'"))
    assert sorted(df.columns) == sorted(sql.columns)
    at = [sql.columns.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[k] for k in at)) for r in sql.fetchall())
