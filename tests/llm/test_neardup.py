"""Groups of similar texts against all pairs."""

import random

import numpy as np
import pytest

from loomwright.llm import neardup, simhash

SCHEMA = "doc_id long, text string, root string, number string, n int"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def brute_kept(rows):
    """(id, text) of the row that stays of each group, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k])
    return sorted(min(i for i, _ in g) for g in groups.values())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def clusters(seed, n_groups, members, length, edits):
    rng = random.Random(seed)
    rows = []
    for g in range(n_groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        rows += [" ".join(base)] * 2
        for _ in range(members):
            rows.append(edited(rng, base, rng.choice(edits)))
    rng.shuffle(rows)
    return list(enumerate(rows))


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "r", "x", 1) for i, t in rows], SCHEMA).repartition(3)
    out = neardup.keep_one(docs)
    assert out.columns == docs.columns
    return sorted(r["doc_id"] for r in out.collect())


def test_groups_equal_all_pairs(spark):
    rows = clusters(1, 25, 4, 120, (0, 1, 2, 3, 5, 8))
    assert kept(spark, rows) == brute_kept(rows)


@pytest.mark.parametrize("full,heads", [(4, 1), (10, 3)])
def test_crowded_keys(spark, monkeypatch, full, heads):
    """Large groups of near copies, chains among them, through rounds of heads."""
    monkeypatch.setattr(neardup, "FULL", full)
    monkeypatch.setattr(neardup, "HEADS", heads)
    rows = clusters(2, 2, 60, 150, (0, 1, 2, 3, 4))
    assert kept(spark, rows) == brute_kept(rows)


def test_changed_copies_are_not_compared_in_full(spark, monkeypatch):
    """Copies that were changed too much are similar to none: few of their pairs are verified, and the groups are those of all pairs."""
    tried = []
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *rest: tried.append(pairs.count()) or verified(pairs, *rest))
    monkeypatch.setattr(neardup, "FULL", 8)
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = list(enumerate(edited(rng, base, rng.choice((1, 2, 4, 5, 6, 7, 8))) for _ in range(220)))
    assert kept(spark, rows) == brute_kept(rows)
    assert sum(tried) < 12 * len(rows), tried  # 10,404 without the bound


def test_rounds_do_not_repeat_work(spark, monkeypatch):
    """Two groups of near copies in the same keys, and copies that belong to neither: few rounds, and every link is put into components once."""
    edges, links = [], []
    components, verified = neardup.components, neardup._verified

    def counted(pairs, *rest):
        links.append(verified(pairs, *rest).count())
        return verified(pairs, *rest)

    monkeypatch.setattr(neardup, "components", lambda found: edges.append(found.count()) or components(found))
    monkeypatch.setattr(neardup, "_verified", counted)
    monkeypatch.setattr(neardup, "FULL", 8)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    other = edited(rng, base, 6).split()
    rows = [edited(rng, b, rng.choice((0, 1, 2, 3, 5, 8))) for b in (base, other) for _ in range(110)]
    rows = list(enumerate(rows))
    assert kept(spark, rows) == brute_kept(rows)
    assert len(links) <= 3 and sum(edges) == sum(links) > 0, (edges, links)


def test_pivot_tables_discard(spark):
    """A pair goes whose pivot distances differ too much, and none whose fingerprints are near enough."""
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(60)] + [int(p) for p in neardup.pivots(4)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.choice((3, 22, 23, 40)))) for p in prints]
    rows = spark.createDataFrame([(k, simhash._signed(p), 10) for k, p in enumerate(prints)], "k int, fp long, n int")
    x, y = rows.alias("x"), rows.alias("y")
    near = x.crossJoin(y).where(neardup._near("x", "y", 0.8)).selectExpr("x.k", "y.k").collect()
    assert {tuple(r) for r in near} == {(i, j) for i, p in enumerate(prints) for j, q in enumerate(prints) if (p ^ q).bit_count() <= neardup.FAR}
    plan = x.crossJoin(y).where(neardup._near("x", "y", 0.8))._jdf.queryExecution().optimizedPlan().toString()
    assert str(simhash._signed(int(neardup.pivots(16)[-1]))) in plan


def test_recall_at_the_bound():
    """Pairs of similarity just above 0.8: at least one key is equal, and few bits differ."""
    rng = random.Random(3)
    missed = far = n = 0
    for _ in range(1500):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        a, b = " ".join(base), edited(rng, base, 7)
        x, y = neardup.shingle_hashes(a), neardup.shingle_hashes(b)
        u, v = np.unique(x), np.unique(y)
        s = neardup.similarity(u, v)
        assert s == len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        if s >= 0.78:
            n += 1
            missed += not any(p == q for p, q in zip(neardup.band_keys(u), neardup.band_keys(v)))
            far += (neardup.fingerprint_of(x) ^ neardup.fingerprint_of(y)).bit_count() > neardup.FAR
    assert n > 500 and missed <= 0.02 * n and far <= 0.002 * n
    assert neardup.fingerprint_of(neardup.shingle_hashes(a, 3)) == simhash.fingerprint(a, 3)


def test_odd_rows(spark):
    long = "word " * 100_000 + "end"
    rows = [(None, None), (5, ""), (4, " \n"), (7, "A b"), (6, "a B"), (None, "a b"), (8, "a b c"), (9, long), (2, long), (2, long), (3, "x " + long)]
    assert kept(spark, [(i, t) for i, t in rows if i is not None]) == [2, 3, 4, 6, 8]  # few different shingles: 2 of 3 are common
    docs = spark.createDataFrame([(i, t, "r", "x", 1) for i, t in rows], SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in neardup.keep_one(docs).collect()) == [(2, long), (3, "x " + long), (4, " \n"), (6, "a B"), (8, "a b c")]
    assert neardup.keep_one(docs.limit(0)).count() == 0
    assert [r["doc_id"] for r in neardup.keep_one(docs.where("doc_id IS NULL")).collect()] == [None, None]
