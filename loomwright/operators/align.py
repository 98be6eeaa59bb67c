"""Global alignment of script words with recognized words, one group a segment."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores of equal words, equal beginnings, unlike words and a gap.
SAME, START, UNLIKE, GAP = 2.0, 0.6, -1.2, -1.0
#: Tables of at most so many cells are filled cell by cell, and those of at most so many bytes of
#: steps by diagonals that are worked off once instead of twice; results don't depend on either.
FEW_CELLS, SMALL = 2500, 1 << 20
#: Segments that are taken from a batch at once, and words that are handed on together.
SEGMENTS, WORDS = 64, 4096


def _numbers(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of both lists, equal for equal words; empty words match nothing."""
    known: dict[str, int] = {}
    x = [known.setdefault(w, len(known)) if w else -1 for w in a]
    y = [known.setdefault(w, len(known)) if w else -2 for w in b]
    return np.array(x, "i8"), np.array(y, "i8")


def align(a: list[str], b: list[str]) -> list[int]:
    """For each word of ``a`` the place of its partner in ``b``, or -1; diagonal steps win ties, then up.

    Cells are worked off by anti-diagonals (i + j = d). Two in every sqrt(n + m) are kept, and
    on the way back the steps of one such run at a time are found again: memory grows with
    min(n, m) * sqrt(n + m), and lists of any length are aligned.
    """
    if len(a) * len(b) <= FEW_CELLS:
        return _align_cells(a, b)
    return _align(a, b, rows=len(a) <= len(b))  # arrays go by the shorter side


def _align_cells(a: list[str], b: list[str]) -> list[int]:
    """``align`` of short lists, where arrays would cost more than they save."""
    n, m = len(a), len(b)
    got = [-1] * n
    heads = [w[:3] for w in b]
    last = [GAP * j for j in range(m + 1)]
    steps = []
    for i, word in enumerate(a, 1):
        head, here, moves = word[:3], [GAP * i], []
        for j in range(1, m + 1):
            other = b[j - 1]
            both = last[j - 1] + ((SAME if word == other else START if head == heads[j - 1] else UNLIKE) if word and other else UNLIKE)
            up, left = last[j] + GAP, here[j - 1] + GAP
            best = both if both >= up and both >= left else up if up >= left else left
            here.append(best)
            moves.append(0 if best == both else 1 if best == up else 2)
        steps.append(moves)
        last = here
    i, j = n, m
    while i and j:
        move = steps[i - 1][j - 1]
        if move == 0:
            i, j = i - 1, j - 1
            if a[i] and b[j] and a[i][:3] == heads[j]:
                got[i] = j
        elif move == 1:
            i -= 1
        else:
            j -= 1
    return got


def _align(a: list[str], b: list[str], rows: bool) -> list[int]:
    """``rows``: arrays are indexed by the place in ``a``, else in ``b``."""
    n, m = len(a), len(b)
    got = [-1] * n
    if not n or not m:
        return got
    p, q = (a, b) if rows else (b, a)
    (word_p, word_q), (head_p, head_q) = _numbers(p, q), _numbers([w[:3] for w in p], [w[:3] for w in q])
    size, other = len(p), len(q)

    def scores(lo: int, hi: int, d: int) -> np.ndarray:
        """Scores of the pairs that the cells lo..hi of diagonal d end on."""
        mine, theirs = slice(lo - 1, hi), slice(d - hi - 1, d - lo)
        same, start = word_p[mine] == word_q[theirs][::-1], head_p[mine] == head_q[theirs][::-1]
        return np.where(same, SAME, np.where(start, START, UNLIKE))

    def step(d: int, before: np.ndarray, last: np.ndarray, steps: np.ndarray | None) -> np.ndarray:
        """Diagonal d from the two before it; ``steps`` takes 0 (diagonal), 1 (up) or 2 (left)."""
        here = np.empty(size + 1)
        lo, hi = max(1, d - other), min(size, d - 1)
        if lo <= hi:
            both = before[lo - 1 : hi] + scores(lo, hi, d)
            along, across = last[lo - 1 : hi] + GAP, last[lo : hi + 1] + GAP
            up, left = (along, across) if rows else (across, along)
            best = np.maximum(np.maximum(both, up), left)
            here[lo : hi + 1] = best
            if steps is not None:
                steps[lo : hi + 1] = np.where(best == both, 0, np.where(best == up, 1, 2))
        if d <= other:
            here[0] = GAP * d
        if d <= size:
            here[d] = GAP * d
        return here

    few = (size + 1) * (n + m) <= SMALL  # then the steps of all diagonals are kept at once
    every = n + m if few else isqrt(n + m) + 1
    found = np.empty((n + m - 1, size + 1), "i1") if few else None
    before, last = np.zeros(size + 1), np.zeros(size + 1)
    last[:2] = GAP
    kept = {}
    for d in range(2, n + m + 1):
        if (d - 2) % every == 0:
            kept[d] = before, last
        before, last = last, step(d, before, last, found[d - 2] if few else None)
    i, j, first = n, m, 2 if few else n + m + 1
    while i and j:
        d = i + j
        if d < first:  # the run of diagonals that holds this cell
            first = d - (d - 2) % every
            before, last = kept.pop(first)
            found = np.empty((d - first + 1, size + 1), "i1")
            for k in range(first, d + 1):
                before, last = last, step(k, before, last, found[k - first])
        move = found[d - first, i if rows else j]
        if move == 0:
            i, j = i - 1, j - 1
            if a[i] and b[j] and a[i][:3] == b[j][:3]:
                got[i] = j
        elif move == 1:
            i -= 1
        else:
            j -= 1
    return got


_ALIGNED = "script_id long, seq int, pos int, word string, t0 double, t1 double"
_ALIGNED_ARROW = pa.schema([("script_id", pa.int64()), ("seq", pa.int32()), ("pos", pa.int32()), ("word", pa.string()), ("t0", pa.float64()), ("t1", pa.float64())])


def _aligned_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with times, handed on whenever ``WORDS`` are done: a worker's memory doesn't grow with its batches' rows."""
    out: list[list] = [[] for _ in _ALIGNED_ARROW]

    def made() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _ALIGNED_ARROW)], schema=_ALIGNED_ARROW)
        for x in out:
            x.clear()
        return done

    for batch in batches:
        for k in range(0, len(batch), SEGMENTS):
            for script, seq, words, norms, heard, t0, t1 in zip(*(c.to_pylist() for c in batch.slice(k, SEGMENTS).columns)):
                if words is None:
                    continue
                found = align(norms, heard)[: len(words)]
                n = len(found)
                for x, new in zip(out, ([script] * n, [seq] * n, range(n), words[:n], [t0[j] if j >= 0 else None for j in found], [t1[j] if j >= 0 else None for j in found])):
                    x.extend(new)
                if len(out[0]) >= WORDS:
                    yield made()
    yield made()
    pa.default_memory_pool().release_unused()


def aligned_times(pairs: DataFrame) -> DataFrame:
    """Script words with the times of the recognized words they align with.

    ``pairs``: ``script_id``, ``seq``, ``words`` (script words), ``norms`` (normalized),
    ``heard`` (normalized), ``t0`` and ``t1`` (arrays). Returns one row a word, times null
    where nothing aligns. A null array is empty, a null word aligns with none.
    """
    listed = [F.coalesce(F.transform(c, lambda w: F.coalesce(w, F.lit(""))), F.array().cast("array<string>")).alias(c) for c in ("norms", "heard")]

    rows = pairs.select("script_id", "seq", "words", *listed, "t0", "t1").mapInArrow(_aligned_batches, _ALIGNED)
    times = [F.when(~F.isnan(t), F.col(t)).alias(t) for t in ("t0", "t1")]
    return rows.select("script_id", "seq", "pos", "word", *times)
