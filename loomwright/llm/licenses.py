"""License scans: fixed phrases, and an exact set-similarity join with license templates.

Templates are few and fixed, so their index goes to every task with the code. Tokens are
ordered by how often they occur in all documents, rare ones first (a grouped count over
the whole table, of the templates' vocabulary only: other tokens can't be shared). A
template T stands in a text where some run of consecutive words, a quarter longer than T,
holds at least ``threshold`` of T's distinct tokens.

Candidates come from blocks: of a text's words, runs twice as long as that, begun every
half of it, so each such run lies within a block. A block B that holds one must share
``need = ceil(threshold * |T|)`` tokens with T:

* prefix filter: the first ``|T| - need + 1`` tokens of T and the first ``|B| - need + 1``
  of B have one in common;
* length filter: ``|B| >= need``;
* positional filter: the common token and what follows it on both sides can still give
  ``need`` tokens.

Survivors are verified by counting, first in the block and then in every run of the text.
No template that meets the threshold is lost, however long it is and wherever lines end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts
from .license_texts import TEMPLATES

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
THRESHOLD = Fraction(4, 5)
#: Byte table: A-Z become lower case, gaps become blanks.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The words of a text, as UTF-8 with A-Z in lower case."""
    return text.encode().translate(_TABLE).split()


def run_words(template: str) -> int:
    """Consecutive words within which a template must stand."""
    return -(-5 * len(words_of(template)) // 4)


class TemplateIndex:
    """Finds every template that a block of words contains to at least the threshold."""

    def __init__(self, templates: Mapping[str, str], rank: Mapping[bytes, int], threshold: Fraction = THRESHOLD):
        self.rank = rank
        self.tokens = {label: sorted({rank[w] for w in words_of(text)}) for label, text in templates.items()}
        if not all(self.tokens.values()):
            raise ValueError("a template has no words")
        self.need = {label: max(1, ceil(threshold * len(t))) for label, t in self.tokens.items()}
        self.least = min(self.need.values())
        self.prefix: dict[int, list[tuple[str, int]]] = {}
        for label, tokens in self.tokens.items():
            for i, t in enumerate(tokens[: len(tokens) - self.need[label] + 1]):
                self.prefix.setdefault(t, []).append((label, i))

    def match(self, block: set[int]) -> dict[str, int]:
        """label -> shared tokens of each template that the block (its words' ranks) meets."""
        tokens = sorted(block)
        n, found, tried = len(tokens), {}, set()
        for j, t in enumerate(tokens[: n - self.least + 1] if n >= self.least else ()):
            for label, i in self.prefix.get(t, ()):
                template, need = self.tokens[label], self.need[label]
                if label in tried or n < need:
                    continue
                tried.add(label)  # this is their first common token: earlier ones would have led here before
                if min(len(template) - i, n - j) < need:
                    continue
                shared = len(block.intersection(template))
                if shared >= need:
                    found[label] = shared
        return found


def ranks_of(templates: Mapping[str, str], counts: Mapping[bytes, int]) -> dict[bytes, int]:
    """The templates' words in the order of their frequency, the rarest first."""
    vocabulary = {w for t in templates.values() for w in words_of(t)}
    return {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


class Scanner:
    """All templates, in one index for each size of blocks."""

    def __init__(self, templates: Mapping[str, str], counts: Mapping[bytes, int], threshold: Fraction = THRESHOLD):
        self.rank = ranks_of(templates, counts)
        self.run = {label: run_words(text) for label, text in templates.items()}
        sizes: dict[int, dict[str, str]] = {}
        for label, text in templates.items():
            sizes.setdefault(1 << (self.run[label] - 1).bit_length(), {})[label] = text
        self.indexes = {half: TemplateIndex(some, self.rank, threshold) for half, some in sorted(sizes.items())}
        first = set().union(*[i.prefix for i in self.indexes.values()])
        self.prefix_words = frozenset(w for w, k in self.rank.items() if k in first)

    def _best(self, places: list[int], ranks: list[int], run: int) -> int:
        """The most distinct tokens within ``run`` consecutive words, of tokens at sorted places."""
        best, a, within = 0, 0, Counter()
        for place, r in zip(places, ranks):
            within[r] += 1
            while place - places[a] >= run:
                within[ranks[a]] -= 1
                if not within[ranks[a]]:
                    del within[ranks[a]]
                a += 1
            best = max(best, len(within))
        return best

    def match(self, words: list[bytes]) -> dict[str, Fraction]:
        """label -> best containment of each template that stands in the words."""
        if self.prefix_words.isdisjoint(words):
            return {}
        at = [(k, r) for k, w in enumerate(words) if (r := self.rank.get(w)) is not None]
        found = {}
        for half, index in self.indexes.items():
            blocks: dict[int, set[int]] = {}
            for k, r in at:
                blocks.setdefault(k // half, set()).add(r)
            candidates: set[str] = set()
            for b, mine in blocks.items():  # a block is two halves
                candidates.update(index.match(mine | blocks[b + 1] if b + 1 in blocks else mine))
            for label in candidates:
                tokens = frozenset(index.tokens[label])
                places, ranks = zip(*[x for x in at if x[1] in tokens])
                shared = self._best(places, ranks, self.run[label])
                if shared >= index.need[label]:
                    found[label] = Fraction(shared, len(tokens))
        return found


def token_counts(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often each word of a fixed vocabulary stands in all texts; at most that many rows reach the driver."""
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(w for w in words_of(text or "") if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(text_col).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def scan(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: Fraction = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Phrases and templates found in every whole text.

    ``n_base`` counts all places of phrases, ``first_word`` and ``last_word`` are the
    least and greatest start (words from 0, null without places). ``labels`` holds the
    phrases' labels and those of the templates that stand in the text. ``score`` is 1 with
    a phrase, else the best containment, else 0. Null and empty texts have no words. One
    row comes back for each row, whatever its id.
    """
    vocabulary = frozenset(w for t in templates.values() for w in words_of(t))
    counts = token_counts(docs, vocabulary, text_col)
    wanted = [(tuple(words_of(p)), label) for p, label in phrases.items()]

    def make():
        scanner = Scanner(templates, counts, threshold)
        firsts = frozenset(p[0] for p, _ in wanted)

        def work(texts):
            for text in texts:
                words = words_of(text)
                starts, base = [], set()
                if not firsts.isdisjoint(words):
                    for phrase, label in wanted:
                        k = -1
                        for _ in range(words.count(phrase[0])):
                            k = words.index(phrase[0], k + 1)
                            if tuple(words[k : k + len(phrase)]) == phrase:
                                starts.append(k)
                                base.add(label)
                best = scanner.match(words)
                yield (
                    len(words),
                    len(starts),
                    min(starts, default=None),
                    max(starts, default=None),
                    ",".join(sorted(base)),
                    ",".join(sorted(base | set(best))),
                    1.0 if base else float(max(best.values(), default=0)),
                )

        return work

    return map_texts(docs, id_col, text_col, make, SCHEMA)


def oracle() -> str:
    """DuckDB SQL for ``scan`` over ``documents``: every run of words is looked at, without blocks."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    phrases = ", ".join(f"('{p}', {len(words_of(p))}, '{label}')" for p, label in PHRASES.items())
    rows = []
    for label, text in TEMPLATES.items():
        tokens = sorted(w.decode() for w in set(words_of(text)))
        rows.append(f"('{label}', [{', '.join(repr(t) for t in tokens)}], {ceil(THRESHOLD * len(tokens))}, {run_words(text)})")
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, {word}) AS w FROM d),
phrases(phrase, size, label) AS (VALUES {phrases}),
templates(label, tokens, need, run) AS (VALUES {", ".join(rows)}),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
places AS (SELECT doc_id, i - 1 AS place, label FROM spots, phrases WHERE array_to_string(w[i : i + size - 1], ' ') = phrase),
tokens AS (SELECT label, need, run, len(tokens) AS size, unnest(tokens) AS token FROM templates),
near AS (SELECT doc_id, label FROM (SELECT doc_id, unnest(list_distinct(w)) AS token FROM w) JOIN tokens USING (token) GROUP BY doc_id, label, need HAVING count(*) >= need),
words AS (SELECT doc_id, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS i FROM w WHERE doc_id IN (SELECT doc_id FROM near)),
spot AS (SELECT doc_id, label, need, run, size, token, i FROM words JOIN tokens USING (token) SEMI JOIN near USING (doc_id, label)),
runs AS (SELECT a.doc_id, a.label, a.i, a.need, a.size, count(DISTINCT b.token) AS shared
  FROM spot a JOIN spot b ON a.doc_id = b.doc_id AND a.label = b.label AND b.i BETWEEN a.i AND a.i + a.run - 1 GROUP BY ALL),
met AS (SELECT doc_id, label, max(shared / size) AS share FROM runs WHERE shared >= need GROUP BY ALL),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
own AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id),
labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels.labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE CAST(coalesce(share, 0) AS DOUBLE) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN labels USING (doc_id)"""
