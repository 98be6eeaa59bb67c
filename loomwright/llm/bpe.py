"""Byte-level BPE encoding and decoding by corpus-level merge replay.

All new words of a batch of about 4 MB of documents form one corpus. Their bytes lie in
one linked list; an inverted index leads from each mergeable token pair (keyed by the
rank of the pair's merge) to its places in all words. Merges are replayed in rank
order over the whole index, all places of a rank at once, and each touches only its two
neighbours. Words are independent of each other, so the replay of a part of the corpus
equals that of the whole, and Spark deals the documents out without any shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property
from heapq import heappop, heappush
from itertools import chain, pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import MEMO_WORDS, kept, map_texts
from .letters import Splitter, kinds_of_tiktoken

#: Bytes of a word of usual length, words that are worth arrays, and places of a rank that aren't;
#: symbols that are replayed together and documents that are taken up at once, which bound the
#: memory. Results don't depend on them.
USUAL, MANY, FEW, SYMBOLS = 64, 2000, 12, 1 << 19
CORPUS_ROWS, CORPUS_BYTES = 10_000, 4 << 20

#: What ``encode_documents`` can return of a document.
OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "ids_sha256": T.StringType(),
    "decoded": T.BinaryType(),
    "decoded_sha256": T.StringType(),
}


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Pairs(dict):
    """left << 20 | right -> the token that the pair makes, or -1; filled as pairs are met."""

    def __init__(self, ranks: dict[bytes, int], bytes_of: dict[int, bytes]):
        super().__init__()
        self.ranks, self.bytes_of = ranks, bytes_of

    def __missing__(self, key: int) -> int:
        made = self[key] = self.ranks.get(self.bytes_of[key >> 20] + self.bytes_of[key & 0xFFFFF], -1)
        return made


class MergeReplay:
    """Encodes words by replaying the merges of a rank table over all of them at once."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= 1 << 20:
            raise ValueError("ranks of 2**20 and more aren't supported")
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.pairs = _Pairs(ranks, self.bytes_of)

    def encode(self, words: Sequence[bytes]) -> list[list[int]]:
        """The ids of each word, as the lowest-rank-first, leftmost-first greedy merge gives them.

        Many words of usual length are replayed in arrays, few or long ones in lists.
        """
        usual = [k for k, w in enumerate(words) if len(w) <= USUAL]
        if len(usual) < MANY:
            return self._in_lists(words)
        out: list[list[int]] = [[]] * len(words)
        begin = size = 0
        for end, k in enumerate(usual, 1):
            size += len(words[k]) + 1
            if size >= SYMBOLS or end == len(usual):
                for k, ids in zip(usual[begin:end], self._in_arrays([words[k] for k in usual[begin:end]])):
                    out[k] = ids
                begin, size = end, 0
        long = [k for k, w in enumerate(words) if len(w) > USUAL]
        for k, ids in zip(long, self._in_lists([words[k] for k in long])):
            out[k] = ids
        return out

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all mergeable pairs (left << 20 | right), sorted, and the ranks of their merges."""
        ranks = self.ranks
        pairs = sorted(
            (ranks[t[:k]] << 20 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        )
        return np.array([k for k, _ in pairs] + [1 << 62]), np.array([r for _, r in pairs] + [-1], "i4")

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where they don't merge (ends of words are negative)."""
        keys, ranks = self.table
        key = left.astype("i8") << 20 | right
        at = np.searchsorted(keys, key)
        return np.where(keys[at] == key, ranks[at], -1)

    def _in_arrays(self, words: Sequence[bytes]) -> list[list[int]]:
        """A rank at a time over all its places; of several places in a word the first, the others come back after lower ranks."""
        size = np.array([len(w) for w in words])
        ends = np.cumsum(size + 1)
        symbols = np.array(self.byte_id, "i4")[np.frombuffer(b"\0" + b"\0".join(words) + b"\0", "u1")]
        symbols[0] = symbols[ends] = -1  # ends of words
        word = np.r_[-1, np.repeat(np.arange(len(words)), size + 1)].astype("i4")
        n = len(symbols)
        after, before = np.arange(1, n + 1, dtype="i4"), np.arange(-1, n - 1, dtype="i4")
        now = np.append(self._ranks(symbols[:-1], symbols[1:]), -1).astype("i4")  # rank of the pair that begins at each place
        some = np.flatnonzero(now >= 0)
        some = some[np.argsort(now[some], kind="stable")]
        cuts = np.flatnonzero(np.diff(now[some], prepend=-1))
        index = {int(now[x[0]]): x.tolist() for x in np.split(some, cuts[1:])} if len(some) else {}
        heap = sorted(index)
        pairs = self.pairs
        if len(pairs) > 2_000_000:
            pairs.clear()
        sym, aft, bef, cur, wrd = (memoryview(x) for x in (symbols, after, before, now, word))
        while heap:
            rank = heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            if len(places) < FEW:
                made, rest, last = [], [], -1
                for i in sorted(places):
                    if cur[i] != rank:
                        continue
                    if wrd[i] == last:
                        rest.append(i)
                        continue
                    last, j = wrd[i], aft[i]
                    k, q = aft[j], bef[i]
                    sym[i], sym[j], cur[j] = rank, -2, -1
                    aft[i], bef[k] = k, i
                    r = cur[i] = pairs[rank << 20 | c] if (c := sym[k]) >= 0 else -1
                    if r >= 0:
                        made.append((r, i))
                    if (z := sym[q]) >= 0:
                        r = cur[q] = pairs[z << 20 | rank]
                        if r >= 0:
                            made.append((r, q))
            else:
                i = np.array(places)
                i = i[now[i] == rank]
                i.sort()
                first = np.diff(word[i], prepend=-1) != 0
                rest, i = i[~first].tolist(), i[first]
                j = after[i]
                k, q = after[j], before[i]
                symbols[i], symbols[j], now[j] = rank, -2, -1
                after[i], before[k] = k, i
                right = now[i] = self._ranks(np.full(len(i), rank), symbols[k])
                left = self._ranks(symbols[q], np.full(len(i), rank))
                inside = symbols[q] >= 0
                now[q[inside]] = left[inside]
                x, y = right >= 0, left >= 0
                made = zip(right[x].tolist() + left[y].tolist(), i[x].tolist() + q[y].tolist())
            if rest:
                index[rank] = rest
                heappush(heap, rank)
            for r, i in made:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
                    heappush(heap, r)
        left = np.flatnonzero(symbols >= 0)
        ids, counts = symbols[left].tolist(), np.bincount(word[left], minlength=len(words))
        return [ids[a:b] for a, b in pairwise([0, *np.cumsum(counts).tolist()])]

    def _in_lists(self, words: Sequence[bytes]) -> list[list[int]]:
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        pairs, byte_id = self.pairs, self.byte_id
        symbols: list[int] = []
        ends: list[int] = []
        for w in words:
            symbols += [byte_id[b] for b in w]
            ends.append(len(symbols))
            symbols.append(-1)  # ends the word
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        index: defaultdict[int, list[int]] = defaultdict(list)  # rank -> places of the left part of a pair
        for i, (a, b) in enumerate(pairwise(symbols)):
            if a >= 0 <= b and (r := pairs[a << 20 | b]) >= 0:
                index[r].append(i)
        heap = sorted(index)
        while heap:
            rank = heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            wait_to, waiting = -1, []
            for i in places:
                a, j = symbols[i], after[i]
                b = symbols[j]
                if a < 0 or b < 0 or pairs[a << 20 | b] != rank:
                    continue  # a neighbour has changed since
                if i < wait_to:
                    waiting.append(i)
                    continue
                symbols[i], symbols[j] = rank, -2
                k = after[i] = after[j]
                before[k] = i
                lower = False
                if (c := symbols[k]) >= 0 and (r := pairs[rank << 20 | c]) >= 0:
                    if r not in index:
                        heappush(heap, r)
                    index[r].append(i)
                    lower = r < rank
                p = before[i]
                if (z := symbols[p]) >= 0 <= p and (r := pairs[z << 20 | rank]) >= 0:
                    if r not in index:
                        heappush(heap, r)
                    index[r].append(p)
                    lower = lower or r < rank
                if lower:  # that merge comes first; the word's other places of this rank wait
                    while symbols[k] != -1:
                        k = after[k]
                    wait_to = k
            if waiting:
                if rank not in index:
                    heappush(heap, rank)
                index[rank] += waiting
        return [[x for x in symbols[s:e] if x >= 0] for s, e in zip(chain([0], (e + 1 for e in ends)), ends)]


class ByteBpe:
    """Encoder and decoder of whole texts with a bounded memo of words."""

    def __init__(self, ranks_path: str, pattern: str, memo: int = MEMO_WORDS):
        self.replay = MergeReplay(read_ranks(ranks_path))
        self.find = Splitter(pattern, kinds_of_tiktoken(pattern))
        self.place: dict[str, int] = {}  # word -> its place among the values
        self.values: list[bytes] = []  # ids of 4 bytes each: a third of what numbers in a tuple take
        self.memo = memo

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        whole, corpus = self.replay.ranks, [w.encode() for w in words]
        done = iter(self.replay.encode([w for w in corpus if w not in whole]))
        # a word that is a token takes its id, as the library does
        return (array("I", (whole[w],) if w in whole else next(done)).tobytes() for w in corpus)

    def encode_batch(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text; the new words of all of them are one corpus."""
        place, values = self.place, self.values
        if len(values) > self.memo:
            place.clear()
            values.clear()
        cut, new = [], []
        for text in texts:
            words = self.find(text)
            at = list(map(place.get, words))
            if None in at:
                for k, known in enumerate(at):
                    if known is None:
                        word = words[k]
                        if (known := place.get(word)) is None:
                            known = place[word] = len(values) + len(new)
                            new.append(word)
                        at[k] = known
            cut.append(array("I", at))
        first = len(values)
        values += self._encode_words(new)
        get = values.__getitem__
        for at in cut:
            yield array("I", b"".join(map(get, at))).tolist()
        for k, word in enumerate(new, first):
            if len(word) > 200:  # not kept after its batch
                del place[word]
                values[k] = b""

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.replay.bytes_of.__getitem__, ids))


def codec(ranks_path: str, pattern: str) -> ByteBpe:
    """One codec a worker process, kept from task to task."""
    return kept(("bpe", ranks_path, pattern), lambda: ByteBpe(ranks_path, pattern))


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    outputs: Sequence[str] = ("n_tokens", "ids"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every whole text, decode the ids again, and return the id with ``outputs``.

    Null and empty texts have no ids and decode to nothing. One row comes back
    for each row, whatever its id (null and repeated ids too); other columns are
    dropped. An empty table gives an empty table. ``ranks_path`` must exist on
    the executors.
    """
    schema = T.StructType([T.StructField(n, OUTPUTS[n]) for n in outputs])
    decodes = any(n.startswith("decoded") for n in outputs)

    def make():
        bpe = codec(ranks_path, pattern)
        digits = {i: str(i) for i in bpe.replay.bytes_of}

        def work(texts):
            for ids in bpe.encode_batch(texts):
                raw = bpe.decode(ids) if decodes else b""
                of = {
                    "n_tokens": lambda: len(ids),
                    "ids": lambda: ids,
                    "ids_sha256": lambda: hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest(),
                    "decoded": lambda: raw,
                    "decoded_sha256": lambda: hashlib.sha256(raw).hexdigest(),
                }
                yield tuple(of[n]() for n in outputs)

        return work

    return map_texts(docs, id_col, text_col, make, schema, CORPUS_ROWS, CORPUS_BYTES)
