"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A sentence's probability is a logistic function of its words; a document's is the
noisy-or of its sentences' (it is toxic if any sentence is). Maximizing the likelihood of
document labels through the noisy-or moves the weight to the sentences that explain them,
which are then the offending ones. Fitted on a bounded sample, applied to whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, map_texts

#: At most so many labelled documents of each class are fitted on, in the order of a hash of their ids.
SAMPLE_EACH = 3000
#: ... and of at most so many characters of text together, and of one document.
SAMPLE_CHARS, LONGEST = 64 << 20, 1 << 20
#: Documents of class 1 that must hold a feature.
LEAST_DOCS = 5
PREFIXES = (4, 5, 6, 7)
_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGE = " \t\r\x0b\x0c\"'()[]{}<>,;:*#$%&|-_/\\«»„“”‘’¿¡"

MODEL = T.StructType([T.StructField("feature", T.StringType()), T.StructField("weight", T.DoubleType())])
SCORES = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("n_sentences", T.LongType()),
        T.StructField("n_offending", T.LongType()),
        T.StructField("worst_start", T.LongType()),
        T.StructField("worst_end", T.LongType()),
    ]
)


def features_of(token: str) -> list[str]:
    """The word itself and its beginnings."""
    w = token.strip(_EDGE)
    return ["=" + w, *[w[:k] for k in PREFIXES if len(w) >= k]] if w else []


def noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """1 - product of (1 - p) over the sentences of each of n documents."""
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def gradient(w: np.ndarray, b: float, rows: np.ndarray, cols: np.ndarray, docs: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the weighted mean log-likelihood of the documents' labels ``y`` under the noisy-or of their sentences.

    Sentence k belongs to document ``docs[k]``; ``rows`` and ``cols`` list the features of sentences.
    """
    p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[cols], len(docs)), -60, 60)))
    whole = np.clip(noisy_or(p, docs, len(y)), 1e-9, 1 - 1e-9)
    dz = p * np.where(y[docs] > 0, (1 - whole[docs]) / whole[docs], -1.0) * weight[docs]
    return np.bincount(cols, dz[rows], len(w)), float(dz.sum())


def fit(texts: list[str], labels: list[int], steps: int = 200, l2: float = 5e-5, share: float | None = None) -> dict[str, float]:
    """Weights of features, and the bias under the empty key; empty if a class is missing.

    Screening keeps the features that are over-represented in documents of class 1.
    Sentences without any of them score 0, so clean text of any length adds nothing.
    ``share``: that of class 1 among all labelled documents (default: as in the sample),
    by which documents are weighted, so that a sample of equal classes means the same.
    """
    y = np.array(labels, "f8")
    if not len(y) or y.min() == y.max():
        return {}
    seen = [Counter(), Counter()]
    for text, label in zip(texts, labels):
        seen[label].update({f for t in set(text.lower().replace("\n", " ").replace(".", " ").replace("!", " ").replace("?", " ").split()) for f in features_of(t)})
    n1, n0 = y.sum(), len(y) - y.sum()
    names = []
    for f, c in seen[1].items():
        if c >= LEAST_DOCS:
            p1, p0 = (c + 0.5) / (n1 + 1), (seen[0][f] + 0.5) / (n0 + 1)
            if np.log(p1 / p0) / np.sqrt(1 / (c + 0.5) + 1 / (seen[0][f] + 0.5)) > 2:
                names.append(f)
    names.sort()
    column = {f: k for k, f in enumerate(names)}
    rows, cols, docs = [], [], []
    for d, text in enumerate(texts):
        for m in _SENTENCE.finditer(text):
            found = [column[f] for t in m[0].lower().split() for f in features_of(t) if f in column]
            if found:
                rows += [len(docs)] * len(found)
                cols += found
                docs.append(d)
    if not docs:
        return {}
    rows, cols, docs = np.array(rows), np.array(cols), np.array(docs)
    share = n1 / len(y) if share is None else share
    weight = np.where(y > 0, share / n1, (1 - share) / n0)
    w, b = np.zeros(len(names)), -2.0
    m1, m2, mb1, mb2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam on the mean log-likelihood
        g, gb = gradient(w, b, rows, cols, docs, y, weight)
        g -= l2 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.999 * mb2 + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w += 0.1 * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-9)
        b += 0.1 * (mb1 / c1) / (np.sqrt(mb2 / c2) + 1e-9)
    return {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3} | {"": float(b)}


def train(docs: DataFrame, labels: DataFrame, sample_each: int = SAMPLE_EACH, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 2) -> dict[str, float]:
    """The model, fitted in one task on at most 2 * ``sample_each`` documents and ``SAMPLE_CHARS`` characters.

    Rows whose crc32(id as text) mod 4 is ``fold`` are never used, nor rows with a null
    label, nor documents longer than ``LONGEST``. If an id has several labels the greatest
    counts; of several texts the first in order. What the driver collects, the weights of
    the sample's over-represented features, is bounded by the sample.
    """
    rows = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != fold))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).alias("_label"))
    )
    counted = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    if len(counted) < 2:
        return {}
    share = counted[1] / (counted[0] + counted[1])
    order = [F.xxhash64("_id"), F.col("_id")]
    some = rows.where("_label = 1").orderBy(*order).limit(sample_each).union(rows.where("_label = 0").orderBy(*order).limit(sample_each))
    short = docs.where(F.coalesce(F.length(text_col), F.lit(0)) <= LONGEST)
    sample = short.join(broadcast_if_small(some), docs[id_col] == F.col("_id")).groupBy("_id", "_label").agg(F.min(text_col).alias("_text"))
    # the sample is some thousand rows; each class is cut where its texts reach half of the characters
    upto = Window.partitionBy("_label").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sample = sample.withColumn("_chars", F.sum(F.coalesce(F.length("_text"), F.lit(0))).over(upto)).where(F.col("_chars") <= SAMPLE_CHARS // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, got_labels, texts = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            got_labels += batch.column(1).to_pylist()
            texts += [t or "" for t in batch.column(2).to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: ids[k])
        model = fit([texts[k] for k in order], [int(got_labels[k]) for k in order], share=share)
        yield pa.RecordBatch.from_arrays([pa.array(list(model), pa.string()), pa.array(list(model.values()), pa.float64())], ["feature", "weight"])

    return {r["feature"]: r["weight"] for r in sample.select("_id", "_label", "_text").coalesce(1).mapInArrow(run, MODEL).collect()}


class _Weights(dict):
    """token -> weight, filled as tokens are met and emptied when too large; 0 for unknown ones."""

    def __init__(self, model: Mapping[str, float], limit: int = 500_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, token: str) -> float | None:
        known = [self.model[f] for f in features_of(token.lower()) if f in self.model]
        value = sum(known) if known else None
        if len(token) < 100:
            self[token] = value
        return value


class Scorer:
    def __init__(self, model: Mapping[str, float]):
        self.bias = model.get("", 0.0)
        self.weights = _Weights({f: w for f, w in model.items() if f})

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, probability) of each sentence with a known feature."""
        if len(self.weights) > self.weights.limit:
            self.weights.clear()
        get = self.weights.__getitem__
        for m in _SENTENCE.finditer(text):
            known = [x for x in map(get, m[0].split()) if x is not None]
            if known:
                z = self.bias + sum(known)
                yield m.start(), m.end(), 1 / (1 + float(np.exp(-max(-60.0, min(60.0, z)))))

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or of the sentences, and those sentences."""
        found = list(self.sentences(text))
        clean = 1.0
        for _, _, p in found:
            clean *= 1 - p
        return 1 - clean, found


def score(docs: DataFrame, model: Mapping[str, float], threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``score`` and where the offending sentences are, of every whole text.

    ``n_offending``: sentences of at least ``threshold``; ``worst_start`` and ``worst_end``:
    characters of the worst of them (the first among equals), null if there is none. Null
    and empty texts score 0. One row comes back for each row. Only the text is an input.
    """

    def make():
        scorer = Scorer(model)

        def work(texts):
            for text in texts:
                total, found = scorer.document(text)
                bad = [s for s in found if s[2] >= threshold]
                worst = max(bad, key=lambda s: (s[2], -s[0]), default=(None, None, 0))
                yield total, sum(1 for _ in _SENTENCE.finditer(text)), len(bad), worst[0], worst[1]

        return work

    return map_texts(docs, id_col, text_col, make, SCORES)


def offending_sentences(docs: DataFrame, model: Mapping[str, float], threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each sentence of at least ``threshold``: id, ``start``, ``end``, ``p`` and ``sentence``."""
    fields = [("start", T.LongType()), ("end", T.LongType()), ("p", T.DoubleType()), ("sentence", T.StringType())]
    item = T.StructType([T.StructField(n, t) for n, t in fields])

    def make():
        scorer = Scorer(model)

        def work(texts):
            for text in texts:
                yield ([{"start": a, "end": b, "p": p, "sentence": text[a:b]} for a, b, p in scorer.sentences(text) if p >= threshold],)

        return work

    found = map_texts(docs, id_col, text_col, make, T.StructType([T.StructField("found", T.ArrayType(item))]))
    return found.select(id_col, F.inline("found"))
