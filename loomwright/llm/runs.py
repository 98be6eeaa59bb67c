"""Periodic runs of words: stretches that repeat a block several times over.

For each period p a harmonic grid of positions 0, p, 2p, ... is laid over the words. A
stretch of ``times`` periods covers ``times`` grid positions, whose words are equal; from
such positions jp and (j+1)p the longest common extensions forward and backward give the
whole stretch. Extensions come from suffix arrays of the words and of the reversed
words: the common extension of two positions is the least LCP value between their ranks, a range
minimum query. All grids together have n ln n positions; the equality of words, looked
at first, leaves few pairs to query, and only documents with such pairs get suffix arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

#: Documents and bytes of text whose words are laid out together; results don't depend on them.
ROWS, BYTES = 2000, 8 << 20

_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
#: What ``periodic_runs`` can return of a document.
OUTPUTS = {
    "n_words": T.LongType(),
    "n_runs": T.LongType(),
    "start": T.LongType(),
    "length": T.LongType(),
    "period": T.LongType(),
    "exponent_milli": T.LongType(),
    "runs": T.ArrayType(_RUN),
    "runs_sha256": T.StringType(),
    "collapsed": T.StringType(),
    "collapsed_sha256": T.StringType(),
}


class RangeMin:
    """Least values of ranges: prefixes and suffixes of blocks, and a sparse table over whole blocks."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        rows = np.full((len(values) // self.BLOCK + 1, self.BLOCK), np.iinfo("i4").max, "i4")
        self.values = rows.reshape(-1)
        self.values[: len(values)] = values
        self.upto = np.minimum.accumulate(rows, axis=1).reshape(-1)
        self.since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.table = [rows.min(axis=1)]
        while (width := 1 << len(self.table) - 1) * 2 <= len(rows):
            self.table.append(np.minimum(self.table[-1][:-width], self.table[-1][width:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value from each ``low`` to each ``high``, both included."""
        first, last = low // self.BLOCK, high // self.BLOCK
        out = np.minimum(self.since[low], self.upto[high])
        between = last - first - 1
        for k in range(len(self.table)):
            at = np.flatnonzero((between >= 1 << k) & (between < 2 << k))
            if len(at):
                t = self.table[k]
                out[at] = np.minimum(out[at], np.minimum(t[first[at] + 1], t[last[at] - (1 << k)]))
        one = np.flatnonzero(first == last)
        if len(one):
            at, end = low[one], high[one]
            least = self.values[at]
            for _ in range(self.BLOCK - 1):
                at = np.minimum(at + 1, end)
                least = np.minimum(least, self.values[at])
            out[one] = least
        return out


class Extensions:
    """Longest common extensions of two positions, from a suffix array, its LCP values and range minima."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        rank = np.unique(symbols, return_inverse=True)[1].reshape(-1).astype("i4")
        ranks, width = [np.append(rank, -1)], 1  # of prefixes of 1, 2, 4, ... symbols
        while n and rank.max() < n - 1:
            key = rank.astype("i8") * (n + 1)
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, "i4")
            rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
            ranks.append(np.append(rank, -1))
            width *= 2
        self.rank = rank
        suffixes = np.empty(n, "i4")
        suffixes[rank] = np.arange(n, dtype="i4")
        left, right = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(max(n - 1, 0), "i4")
        for k in range(len(ranks) - 1, -1, -1):
            step = (ranks[k][left] == ranks[k][right]).astype("i4") << k
            common += step
            left += step
            right += step
        self.minima = RangeMin(common)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` on equal those from ``b`` on (``a`` and ``b`` differ)."""
        x, y = self.rank[a], self.rank[b]
        return self.minima.least(np.minimum(x, y), np.maximum(x, y) - 1)


def _grid_pairs(symbols: np.ndarray, ends: Sequence[int], times: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid positions with ``times`` equal words a period apart, and the periods.

    ``ends[p]`` is where the symbols of documents end that are long enough for period p.
    """
    places, periods = [], []
    for p in range(1, len(ends)):
        grid = symbols[: ends[p] : p]
        same = grid[1:] == grid[:-1]
        some = same[: len(same) - times + 2]
        for k in range(1, times - 1):
            some = some & same[k : len(same) - times + 2 + k]
        if some.any():
            j = np.flatnonzero(some)
            places.append(j * p)
            periods.append(np.full(len(j), p))
    if not places:
        return np.empty(0, "i8"), np.empty(0, "i8")
    return np.concatenate(places), np.concatenate(periods)


def find_runs(texts: Sequence[Sequence[int]], times: int = 4, shortest: int = 6) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each sequence of word numbers (0 or more), by start, then period."""
    if times < 2:
        raise ValueError("a run repeats its period at least twice")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    least = max(shortest, times)
    order = sorted((k for k, t in enumerate(texts) if len(t) >= least), key=lambda k: -len(texts[k]))
    if not order:
        return out

    def lay(which):
        """Symbols one after another, each document closed by a symbol of its own; where documents begin."""
        size = np.array([len(texts[k]) for k in which])
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        symbols = np.empty(begin[-1], "i8")
        for n, k in enumerate(which):
            symbols[begin[n] : begin[n + 1] - 1] = texts[k]
        symbols[begin[1:] - 1] = -1 - np.arange(len(which))
        return symbols, begin

    symbols, begin = lay(order)
    periods = np.arange(len(texts[order[0]]) // times + 1)
    enough = np.searchsorted([-len(texts[k]) for k in order], -times * periods, "right")  # documents come longest first
    at, period = _grid_pairs(symbols, begin[enough].tolist(), times)
    doc = np.searchsorted(begin, at, "right") - 1
    inside = at + (times - 1) * period < begin[doc + 1] - 1
    at, period, doc = at[inside], period[inside], doc[inside]
    if not len(at):
        return out
    named, doc = np.unique(doc, return_inverse=True)  # documents that need suffix arrays
    at = at - begin[named[doc]]
    symbols, begin = lay([order[k] for k in named])
    at = at + begin[doc]
    n = len(symbols)
    forward = Extensions(symbols).of(at, at + period)
    backward = np.zeros(len(at), "i4")
    some = np.flatnonzero(at > 0)
    backward[some] = Extensions(symbols[::-1]).of(n - at[some], n - at[some] - period[some])
    length = period + forward + backward
    long = length >= np.maximum(shortest, times * period)
    start, length, period, doc = (at - backward)[long], length[long], period[long], doc[long]
    # of equal stretches the least period counts
    by = np.lexsort((period, length, start))
    start, length, period, doc = start[by], length[by], period[by], doc[by]
    first = (np.diff(start, prepend=-1) != 0) | (np.diff(length, prepend=-1) != 0)
    start, length, period, doc = start[first], length[first], period[first], doc[first]
    by = np.lexsort((period, start))
    for s, m, p, d in zip((start - begin[doc])[by].tolist(), length[by].tolist(), period[by].tolist(), doc[by].tolist()):
        out[order[named[d]]].append((s, m, p))
    return out


def collapsed(words: list[bytes], runs: Iterable[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that stand in a run after its first period."""
    gone = np.zeros(len(words) + 1, "i8")
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def strongest(runs: Sequence[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run that repeats most (greatest length / period; ties: least start, then period)."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(
    docs: DataFrame,
    outputs: Sequence[str] = ("n_runs", "runs", "collapsed"),
    times: int = 4,
    shortest: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The id of every document with ``outputs`` (see ``OUTPUTS``) of its runs.

    Words are what white space of ASCII parts. A run is a stretch of words whose smallest
    period is q, at least ``times`` * q and ``shortest`` words long, that no neighbouring
    word extends. ``start``, ``length``, ``period`` and ``exponent_milli`` are those of
    the strongest run, null without runs; ``collapsed`` are the words, joined by
    single spaces, without those after a run's first period. Null, empty and blank texts have no words and no
    runs. One row comes back for each row, whatever its id (null and repeated ids too);
    other columns are dropped; an empty table gives an empty table. A document passes
    through one task; its arrays take some hundred bytes a word.
    """
    schema = T.StructType([T.StructField(n, OUTPUTS[n]) for n in outputs])

    def make():
        def work(texts: list[str]) -> Iterator[tuple]:
            number: dict[bytes, int] = {}
            cut = [t.encode().split() for t in texts]  # of bytes: only the six ASCII blanks part words
            numbered = [np.array([number.setdefault(w, len(number)) for w in words], "i8") for words in cut]
            for words, runs in zip(cut, find_runs(numbered, times, shortest)):
                kept = b" ".join(collapsed(words, runs) if runs else words)
                best = strongest(runs)
                of = dict(zip(("start", "length", "period"), best or (None,) * 3)) | {
                    "n_words": len(words),
                    "n_runs": len(runs),
                    "exponent_milli": best and 1000 * best[1] // best[2],
                    "runs": [dict(zip(("start", "length", "period"), r)) for r in runs],
                    "runs_sha256": hashlib.sha256(b"".join(b"%d,%d,%d\n" % r for r in runs)).hexdigest(),
                    "collapsed": kept.decode() if "collapsed" in outputs else None,
                    "collapsed_sha256": hashlib.sha256(kept).hexdigest(),
                }
                yield tuple(of[n] for n in outputs)

        return work

    return map_texts(docs, id_col, text_col, make, schema, ROWS, BYTES)


SQL_CRC = """bits(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8)"""


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a string's UTF-8 bytes; needs ``SQL_CRC``'s table ``crc`` at hand."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


SQL = rf"""
WITH RECURSIVE {SQL_CRC}, hashed AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own, {sql_crc32("doc_id::VARCHAR")} AS h
  FROM documents, crc
), planted AS (
  SELECT r, doc_id, own, len(own) AS n, coalesce(h % 10 = 0 AND len(own) > 0, false) AS changes,
         CASE WHEN len(own) > 0 THEN (h // 10) % len(own) END AS a, (h // 10) % 8 + 3 AS parts
  FROM hashed
), words AS (
  SELECT r, n, unnest(range(n)) AS i,
         unnest(list_transform(range(n), lambda i: CASE WHEN changes AND i >= a THEN own[a + (i - a) % (1 + (n - a) // parts) + 1] ELSE own[i + 1] END)) AS word
  FROM planted
), equal AS (
  SELECT x.r, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= x.n
), placed AS (
  SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM equal
), stretches AS (
  SELECT r, p, min(i) AS s, count(*) + p AS m FROM placed GROUP BY r, p, island HAVING count(*) + p >= greatest(6, 4 * p)
), runs AS (
  SELECT r, s, m, min(p) AS p FROM stretches GROUP BY r, s, m
), summed AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || m || ',' || p || chr(10), '' ORDER BY s, p) AS listed,
         arg_min({{'s': s, 'm': m, 'p': p}}, (-(m::DOUBLE / p), s, p)) AS best
  FROM runs GROUP BY r
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS rest FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE x.r = w.r AND w.i >= x.s + x.p AND w.i < x.s + x.m) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS "start", best.m AS length, best.p AS period, 1000 * best.m // best.p AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM planted LEFT JOIN summed USING (r) LEFT JOIN kept USING (r)
"""
