"""Token counts of a piece-BPE model without making tokens.

A word is a linked list of characters; a heap gives the adjacent pair of the best
score (leftmost first among equals) again and again. The count is the number of
initial symbols less the merges, plus what byte fallback adds for characters the
vocabulary lacks. No identifiers are made.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import MEMO_WORDS, map_texts
from .words import Memo

#: What the model writes for a space.
SPACE = "▁"
_ODD = re.compile(f"  |^ | $|{SPACE}")
_RUNS = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")

SCHEMA = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
)


def read_pieces(path: str) -> dict[str, int]:
    """piece -> rank (0: merged first), of the normal pieces of a model file.

    Only models that leave the text as it is, put one space before it and fall
    back to bytes are understood; others are refused.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.decode(sp.encode("  ﬁ a")) != "  ﬁ a" or sp.encode("a", out_type=str)[0][:1] != SPACE or len(sp.encode("\U000f0000")) != 5:
        raise ValueError(f"{path}: another normalization or no byte fallback")
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    ids.sort(key=lambda i: -sp.get_score(i))
    pieces = {sp.id_to_piece(i): k for k, i in enumerate(ids)}
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError(f"{path}: pieces span words")
    return pieces


class PieceCounter:
    def __init__(self, path: str, memo: int = MEMO_WORDS):
        self.rank = read_pieces(path)
        self.joins = {a + b for p in self.rank for a, b in pairwise(p)}
        self.words = Memo(lambda words: map(self._count_part, words), memo)
        self.runs = Memo(lambda runs: map(self._count, runs), memo)

    def _count(self, run: str) -> int:
        """Tokens of a run of characters each two of which may meet in a piece."""
        rank = self.rank
        if run in rank and len(run) == 1:
            return 1
        symbols = list(run)
        n = len(symbols)
        heap = [(r, i, 2) for i, (a, b) in enumerate(pairwise(symbols)) if (r := rank.get(a + b)) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            _, i, size = heappop(heap)
            a = symbols[i]
            if not a or (j := after[i]) >= n or len(a) + len(symbols[j]) != size:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = (a := a + symbols[j]), ""
            left -= 1
            if (k := after[j]) < n:
                before[k] = i
                if (r := rank.get(a + symbols[k])) is not None:
                    heappush(heap, (r, i, size + len(symbols[k])))
            after[i] = k
            if (p := before[i]) >= 0 and (r := rank.get(symbols[p] + a)) is not None:
                heappush(heap, (r, p, size + len(symbols[p])))
        return left + sum(len(s.encode()) - 1 for s in symbols if s and s not in rank)

    def _count_part(self, part: str) -> int:
        """Tokens of a part, cut first where no piece holds the two characters side by side."""
        joins, cut = self.joins, [0]
        cut += [i for i, (a, b) in enumerate(pairwise(part), 1) if a + b not in joins]
        if len(cut) == 1:
            return self._count(part)
        cut.append(len(part))
        runs = [part[a:b] for a, b in pairwise(cut)]
        self.runs.learn(need := set(runs))
        total = sum(map(self.runs.__getitem__, runs))
        self.runs.forget_long(need)
        return total

    def count_batch(self, texts: list[str]):
        """Tokens of each text."""
        split = []
        for t in texts:
            if _ODD.search(t):
                split.append(_RUNS.split(SPACE + t.replace(" ", SPACE)))
            else:
                split.append([SPACE + w for w in t.split(" ")] if t else [])
        self.words.learn(need := set(chain.from_iterable(split)))
        for s in split:
            yield sum(map(self.words.__getitem__, s))
        self.words.forget_long(need)


_OPEN: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """One counter a worker process, kept from task to task."""
    if path not in _OPEN:
        _OPEN[path] = PieceCounter(path)
    return _OPEN[path]


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every whole text.

    Null and empty texts have no bytes and no tokens. One row comes back for each
    row, whatever its id; other columns are dropped. Nothing is shuffled.
    """

    def make():
        tokens = counter(model_path)

        def work(texts):
            for text, n in zip(texts, tokens.count_batch(texts)):
                yield len(text.encode()), n, n > limit

        return work

    return map_texts(docs, id_col, text_col, make, SCHEMA)
