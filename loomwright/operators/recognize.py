"""The seam of speech recognition: a table function that users fill.

A recognizer is an object that is fed a clip's blocks in order and then asked for its words. Spark calls
it through a table function, laterally for each clip (PARTITION BY clip ORDER BY block), so clips are
recognized side by side and only one block of each is held. Without a recognizer, and for
clips where it fails, there are no words, and times follow from the text alone
(``timeline.fill_times``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class Recognizer:
    """Hears nothing. Recognizers derive from this."""

    def feed(self, samples: np.ndarray) -> None:
        """The next samples of the clip."""

    def words(self) -> Iterable[tuple[str, float, float]]:
        """Word, start and end (in samples), in order, once the clip has ended."""
        return ()


class LoudStretches(Recognizer):
    """Voice activity: stretches of samples above a level, parted by more than ``gap`` quieter ones; each is the word ``word``."""

    def __init__(self, level: float, gap: int = 0, word: str = "*"):
        self.level, self.gap, self.word = level, gap, word
        self.at, self.found = 0, []

    def feed(self, samples: np.ndarray) -> None:
        loud = np.flatnonzero(np.abs(samples) > self.level) + self.at
        self.at += len(samples)
        if not len(loud):
            return
        cut = np.flatnonzero(np.diff(loud) > self.gap + 1)
        stretches = list(zip(loud[np.r_[0, cut + 1]].tolist(), (loud[np.r_[cut, len(loud) - 1]] + 1).tolist()))
        if self.found and stretches[0][0] - self.found[-1][1] <= self.gap:
            stretches[0] = (self.found.pop()[0], stretches[0][1])
        self.found += stretches

    def words(self) -> Iterable[tuple[str, float, float]]:
        return [(self.word, a, b) for a, b in self.found]


def recognized(blocks: DataFrame, make: Callable[[], Recognizer] = Recognizer, rate: int = 24000) -> DataFrame:
    """``clip``, ``pos``, ``word``, ``t0`` and ``t1`` (seconds) of what a recognizer hears in clips in blocks.

    ``make`` is called once for each clip. A recognizer that raises, or whose words
    can't be read, gives no rows for its clip. Words are stripped, blank ones left out; null samples are 0.
    """
    clip = blocks.schema["clip"].dataType

    class Heard:
        def __init__(self):
            self.worker, self.clip, self.failed = None, None, False

        def eval(self, row: Row) -> Iterator[tuple]:
            if not self.failed:
                try:
                    if self.worker is None:
                        self.worker, self.clip = make(), row["clip"]
                    self.worker.feed(np.nan_to_num(np.array(row["samples"] or [], "f8")))
                except Exception:  # whatever a recognizer raises, its clip has no words
                    self.failed = True
            yield from ()

        def terminate(self) -> Iterator[tuple]:
            if self.failed or self.worker is None:
                return
            try:
                words = [(str(w).strip(), float(a) / rate, float(b) / rate) for w, a, b in self.worker.words()]
            except Exception:
                return
            for pos, (word, t0, t1) in enumerate(w for w in words if w[0]):
                yield self.clip, pos, word, t0, t1

    heard = F.udtf(Heard, returnType=f"clip {clip.simpleString()}, pos int, word string, t0 double, t1 double")
    rows = blocks.select("clip", "block", F.col("samples").cast("array<double>").alias("samples"))
    return heard(rows.asTable().partitionBy("clip").orderBy("block"))
