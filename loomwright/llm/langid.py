"""Language identification by Bayesian fusion of several kinds of evidence.

* the text: naive Bayes over letter trigrams of words, tempered so that a long text counts
  as a bounded number of independent trigrams; one class, ``und``, expects all trigrams
  alike and so takes what none of the languages explains;
* the language that the markup declares, and the one that the address's country suffix
  suggests: how far either can be trusted is counted from the table itself;
* the host: priors smoothed down the tree of its suffixes, from the whole table over the
  last label and each longer suffix to the host; a page's own share is left out.

Counts are sums of text-only posteriors in grouped aggregations, so no label is needed for
the pages themselves. The text model is fitted on a bounded sample of labelled documents.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, broadcast_if_small, discard, give_back, kept, materialize

UNKNOWN = "und"
#: Bound of the text model: labelled documents it is fitted on.
SAMPLE_DOCS = 8000
#: ``und`` expects so many different trigrams (or all that the model has, if they are more).
UND_GRAMS = 20_000
#: A text counts as so many independent trigrams at most.
GRAM_WEIGHT = 100
#: Pseudo-counts of the priors' parents and of the trust in declarations.
PARENT_WEIGHT, TRUST_WEIGHT = 20.0, 10.0
#: Documents whose best language has a smaller posterior are rejected.
LEAST_POSTERIOR = 0.6
#: Country suffixes that suggest one language.
SUFFIXES = {
    "at": "de", "au": "en", "br": "pt", "cl": "es", "co": "es", "de": "de", "es": "es", "fr": "fr",
    "ie": "en", "it": "it", "mx": "es", "nl": "nl", "nz": "en", "pl": "pl", "pt": "pt", "uk": "en", "us": "en",
}

_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^<>]*>")
#: Numbers that a worker keeps of known words; results don't depend on it.
MEMO_CELLS = 1_500_000
#: Words of texts of more characters are cut one after another rather than at once.
LONG_TEXT = 1 << 20
#: Posteriors of less than this aren't counted.
LEAST_SHARE = 1e-9


def visible_text(page: str) -> str:
    """The text of an HTML page without scripts, styles, comments and tags."""
    return html_lib.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page)))


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[k : k + 3] for k in range(len(w) - 2)]


class TextModel:
    """Log-probabilities of trigrams by language; the last language is ``und``.

    The counts stay in a table of the shared folder (``gram``, ``lang``, ``n``); a worker
    reads them when it scores its first text. Only the sums of each language travel along.
    """

    def __init__(self, path: str, totals: dict[str, int], n_grams: int):
        names = sorted(totals)
        self.path, self.languages = path, [*names, UNKNOWN]
        size = max(n_grams, UND_GRAMS)
        rest = np.array([totals[x] + 0.5 * size for x in names])
        #: log-probability of a trigram that the language's sample lacks
        self.base = np.append(np.log(0.5 / rest), -math.log(size))

    @cached_property
    def table(self) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
        """gram -> place, and for each gram (compressed rows) its languages and what it adds to their base."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        rows = pq.read_table(root, filesystem=store, columns=["gram", "lang", "n"]).sort_by([("gram", "ascending"), ("lang", "ascending")])
        place = {x: k for k, x in enumerate(self.languages)}
        gram: dict[str, int] = {}
        at = np.array([gram.setdefault(g, len(gram)) for g in rows["gram"].to_pylist()], "i8")
        langs = np.array([place[x] for x in rows["lang"].to_pylist()], "i4")
        adds = np.log1p(2.0 * rows["n"].to_numpy().astype("f8"))
        return gram, np.searchsorted(at, np.arange(len(gram) + 1)), langs, adds

    @cached_property
    def memo(self) -> tuple[dict[str, int], np.ndarray]:
        return {}, np.zeros((max(16, MEMO_CELLS // len(self.languages)), len(self.languages)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "memo")}

    def _learn(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word (row) in each language."""
        gram, start, langs, adds = self.table
        found = [(k, g) for k, w in enumerate(words) for x in grams(w) if (g := gram.get(x)) is not None]
        out = np.outer([len(w) for w in words], self.base)  # a word has as many trigrams as letters
        if found:
            word, g = np.array(found).T
            size = start[g + 1] - start[g]
            each = np.repeat(start[g] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            cell = np.repeat(word, size) * len(self.languages) + langs[each]
            out += np.bincount(cell, adds[each], out.size).reshape(out.shape)
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Trigrams of each whole text, tempered log-likelihoods, and the text's own posteriors (zeros without letters)."""
        known, rows = self.memo
        n, ll = np.zeros(len(texts), "i8"), np.zeros((len(texts), len(self.languages)))
        for k, text in enumerate(texts):
            words = (m[0] for m in _WORD.finditer(text.lower())) if len(text) > LONG_TEXT else iter(_WORD.findall(text.lower()))
            while part := Counter(islice(words, 10_000)):  # a very long text keeps to bounded memory
                new = [w for w in part if w not in known]
                if len(known) + len(new) > len(rows):
                    known.clear()
                    new = list(part)
                if len(new) <= len(rows):
                    rows[len(known) : len(known) + len(new)] = self._learn(new)
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    ll[k] += np.fromiter(part.values(), "f8", len(part)) @ rows[list(map(known.__getitem__, part))]
                else:  # more languages than the memo has room for
                    for w, times in part.items():
                        ll[k] += times * self._learn([w])[0]
                n[k] += sum(len(w) * times for w, times in part.items())
        ll *= (np.minimum(n, GRAM_WEIGHT) / np.maximum(n, 1))[:, None]
        return n, ll, np.where(n[:, None] > 0, _softmax(ll), 0.0)


def _softmax(scores: np.ndarray) -> np.ndarray:
    """exp(scores) of each row, scaled to a sum of 1."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _share(sizes: list[int], total: int) -> int:
    """The greatest n for which the first n of each group are ``total`` together at most; 1 at least."""
    left, rest = total, sorted(sizes)
    for k, size in enumerate(rest):
        n = left // (len(rest) - k)
        if size > n:
            return max(1, n)
        left -= size
    return max(1, total)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_DOCS) -> TextModel:
    """A text model from at most ``sample`` labelled documents, the first of each language in the order of a hash of their ids.

    All languages have the same share of the sample; what the rarer ones leave goes to the
    others, so none is lost in a large table (as long as there are no more languages than
    documents in the sample). All their trigrams are in the model. Rows with a null or
    empty label or a null id are left out.
    """
    from pyspark.sql import Window

    known = labelled.where((F.col(lang_col) != "") & F.col(id_col).isNotNull())
    ids = known.select(F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id"))
    sizes = ids.groupBy("_lang").agg(F.approx_count_distinct("_id").alias("n")).orderBy(F.desc("n"), "_lang").limit(sample).collect()
    each = _share([r["n"] for r in sizes], sample)
    # the hashes that give about twice the share: what is ranked is bounded too
    upto = {r["_lang"]: min(1.0, (2 * each + 100) / max(1, r["n"])) for r in sizes}
    hashed = F.xxhash64("_id")
    bounds = labelled.sparkSession.createDataFrame([(k, min(2**63 - 1, int(p * 2**64) - 2**63)) for k, p in upto.items()], "_lang string, _upto long")
    some = ids.join(F.broadcast(bounds), "_lang").where(hashed <= F.col("_upto")).select("_lang", "_id").distinct()
    some = some.withColumn("_k", F.row_number().over(Window.partitionBy("_lang").orderBy(hashed, "_id"))).where(F.col("_k") <= each)
    same = (known[id_col] == F.col("_id")) & (known[lang_col] == F.col("_lang"))
    rows = known.join(broadcast_if_small(some), same, "left_semi").select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang:
                    mine = found.setdefault(lang, Counter())
                    for w, n in Counter(_WORD.findall((text or "").lower())).items():
                        for g in grams(w):
                            mine[g] += n
        flat = [(lang, g, n) for lang, c in found.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], schema.names)
        del found, flat
        give_back()

    counted = materialize(rows.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-model")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    return TextModel(counted._shared_folder, totals, counted.select("gram").distinct().count())


def text_evidence(model: TextModel, text: Column, is_html: bool = False) -> Column:
    """struct(n, ll, p): trigrams, tempered log-likelihoods and posteriors of each whole text (null: empty)."""
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("ll", numbers), T.StructField("p", numbers)])

    @F.pandas_udf(schema)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = kept(("language", model.path), lambda: model)
        for texts in batches:
            parts = [own.score([visible_text(t or "") if is_html else t or "" for t in texts[k : k + BATCH_ROWS]]) for k in range(0, len(texts), BATCH_ROWS)]
            n, ll, p = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, "i8"), [], [])
            yield pd.DataFrame({"n": n, "ll": list(ll), "p": list(p)})
        give_back()

    # said not to be deterministic, so that the planner doesn't call it once for each field that is read
    return score.asNondeterministic()(text)


def host_of(url: Column) -> Column:
    """The host of an address in lower case; null where there is none."""
    return F.nullif(F.lower(F.rtrim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1), F.lit("."))), F.lit(""))


def parents(host: Column) -> Column:
    """The nodes of a host in the tree of suffixes, from its last label to itself.

    ``a.b.co.uk``: uk, co.uk, b.co.uk, a.b.co.uk. Numeric addresses, and names longer than
    a host name can be (253 characters), are nodes of their own below the root.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    whole = host.rlike(r"^[\[\d][\d.:a-fA-F\]]*$") | (F.length(host) > 253)
    tree = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat_ws(".", F.slice(labels, n - k + 1, k)))
    return F.when(whole, F.array(host)).otherwise(tree)


def evidence(model: TextModel, text: Column, declared: Column | None = None, host: Column | None = None, url: Column | None = None, is_html: bool = False) -> dict[str, Column]:
    """Columns ``text`` (see ``text_evidence``), ``declared``, ``suffix``, ``host`` and ``nodes``.

    Unknown kinds of evidence are null and then say nothing. A declaration counts if the
    model has that language, or that of its primary subtag. ``host`` is a name without
    parents; the host of ``url`` has those of the tree of suffixes.
    """
    none = F.lit(None).cast("string")
    known = F.array(*[F.lit(x) for x in model.languages[:-1]]).cast("array<string>")
    own_host = host if host is not None else host_of(url) if url is not None else none
    nodes = F.when(own_host.isNotNull(), F.array(own_host) if url is None else parents(own_host))
    said = [F.trim(declared), F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})", 1))] if declared is not None else []
    label = F.regexp_extract(own_host, r"([^.]+)$", 1) if url is not None else none
    suffix = F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in SUFFIXES.items()])
    return {
        "text": text_evidence(model, text, is_html),
        "declared": F.coalesce(none, *[F.when(F.array_contains(known, x), x) for x in said]),
        "suffix": F.when(F.array_contains(known, suffix), suffix),
        "host": own_host,
        "nodes": nodes,
    }


def posteriors(
    languages: list[str], whole: np.ndarray, trust: dict[str, np.ndarray],
    n: np.ndarray, ll: np.ndarray, p: np.ndarray, declared: list, suffix: list, counts: list,
) -> np.ndarray:
    """Posteriors of the languages (columns) of each page; ``counts``: flat (level, language, sum) of its host's nodes.

    Priors go from the corpus down the tree, each level smoothed with ``PARENT_WEIGHT``
    pseudo-counts of its parent; the page's own share is taken out of every count.
    """
    size = len(languages)
    own = np.where((n[:, None] > 0) & (p > LEAST_SHARE), p, 0.0)
    prior = np.maximum(whole - own, 0.0) + 1.0
    prior /= prior.sum(axis=1, keepdims=True)
    triples = [np.reshape(c if c is not None else [], (-1, 3)) for c in counts]
    row = np.repeat(np.arange(len(triples)), [len(t) for t in triples])
    flat = np.concatenate(triples) if triples else np.zeros((0, 3))
    depth = np.array([t[:, 0].max() + 1 if len(t) else 0 for t in triples])
    for level in range(int(depth.max(initial=0))):
        mine = flat[:, 0] == level
        seen = np.zeros((len(triples), size))
        seen[row[mine], flat[mine, 1].astype("i8")] = flat[mine, 2]
        seen = np.maximum(seen - own, 0.0)
        here = (seen + PARENT_WEIGHT * prior) / (seen.sum(axis=1, keepdims=True) + PARENT_WEIGHT)
        prior = np.where((depth > level)[:, None], here, prior)
    place = {x: k for k, x in enumerate(languages[:-1])}
    said = sum(trust[kind][[place.get(x, -1) for x in values]] for kind, values in (("declared", declared), ("suffix", suffix)))
    return _softmax(ll + np.log(prior) + said)


class Fusion:
    """Priors of hosts and trust in declarations, counted from materialized evidence rows.

    Counts are kept in long form (one row for each language with a posterior above
    ``LEAST_SHARE``), so neither plans nor rows grow with the square of the languages.
    """

    def __init__(self, rows: DataFrame, model: TextModel):
        self.languages = langs = model.languages
        p = F.posexplode("text.p").alias("k", "p")
        seen = rows.where("text.n > 0").select("declared", "suffix", "host", "nodes", p).where(F.col("p") > LEAST_SHARE)
        seen = seen.groupBy("declared", "suffix", "host", "nodes", "k").agg(F.sum("p").alias("p"))
        # one row for each host, kind of declaration and language: all that follows is read from it
        seen = materialize(seen, "language-counts")
        self.trust = {kind: self._trust(seen, kind) for kind in ("declared", "suffix")}
        self.whole = np.zeros(len(langs))
        for r in seen.groupBy("k").agg(F.sum("p").alias("p")).collect():  # a row a language
            self.whole[r["k"]] = r["p"]
        by_host = seen.where("host is not null").groupBy("host", "nodes", "k").agg(F.sum("p").alias("p"))
        by_host = by_host.select("host", "k", "p", F.posexplode("nodes").alias("level", "node"))
        by_node = materialize(by_host.groupBy("node", "k").agg(F.sum("p").alias("s")), "node-counts")
        own = by_host.select("host", "level", "node").distinct()
        joined = own.join(broadcast_if_small(by_node), "node").groupBy("host").agg(
            F.flatten(F.collect_list(F.array(F.col("level").cast("double"), F.col("k").cast("double"), "s"))).alias("counts")
        )
        self.hosts = materialize(joined.withColumnRenamed("host", "_host"), "host-counts")
        discard(seen, by_node)

    def _trust(self, seen: DataFrame, kind: str) -> np.ndarray:
        """log P(stated | language), a row for each stated language; the last row, for none, is 0."""
        known, n = self.languages[:-1], len(self.languages)
        place, stated = {x: k for k, x in enumerate(known)}, np.zeros((n, n))
        for r in seen.where(F.col(kind).isNotNull()).groupBy(kind, "k").agg(F.sum("p").alias("p")).collect():
            stated[place[r[kind]], r["k"]] = r["p"]
        expected = np.full((n - 1, n), 0.2 / max(1, len(known) - 1))
        np.fill_diagonal(expected, 0.8)
        expected[:, -1] = 1 / max(1, len(known))
        out = np.zeros((n, n))
        out[:-1] = np.log((stated[:-1] + TRUST_WEIGHT * expected) / (stated.sum(axis=0) + TRUST_WEIGHT))
        return out

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``found``: struct(language, posterior, rejected)."""
        languages, whole, trust = self.languages, self.whole, self.trust
        schema = T.StructType([T.StructField("language", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

        @F.pandas_udf(schema)
        def fuse(n: pd.Series, ll: pd.Series, p: pd.Series, declared: pd.Series, suffix: pd.Series, counts: pd.Series) -> pd.DataFrame:
            found = []
            for a in range(0, len(n), BATCH_ROWS):
                part = slice(a, a + BATCH_ROWS)
                size = n[part].to_numpy()
                post = posteriors(languages, whole, trust, size, np.stack(ll[part]), np.stack(p[part]), list(declared[part]), list(suffix[part]), list(counts[part]))
                best = post.argmax(axis=1)
                for k, top, x in zip(size.tolist(), best.tolist(), post.max(axis=1).tolist()):
                    lang = languages[top] if k else UNKNOWN
                    found.append((lang, x, lang == UNKNOWN or x < LEAST_POSTERIOR))
            return pd.DataFrame(found, columns=schema.names)

        joined = rows.join(broadcast_if_small(self.hosts), F.col("host") == F.col("_host"), "left").drop("_host")
        found = fuse.asNondeterministic()("text.n", "text.ll", "text.p", "declared", "suffix", "counts")
        return joined.withColumn("found", found).drop("counts")


def identify_pages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, ``language``, ``posterior``, ``declared``, ``n_grams`` and ``rejected`` of every page.

    Null and empty pages, and those without letters, are ``und`` and rejected. Pages
    without a usable declaration, suffix or host are judged by what there is. Of languages
    with equal posteriors the first in alphabetical order is taken, ``und`` last. One row
    comes back for each row; an empty table gives an empty table.
    """
    declared = F.regexp_extract(F.col(html_col), r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    columns = evidence(model, F.col(html_col), declared, url=F.col(url_col), is_html=True)
    rows = materialize(pages.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in columns.items()]), "language-evidence")
    return Fusion(rows, model).apply(rows).select(
        F.col("id").alias(id_col),
        F.col("found.language").alias("language"),
        F.round("found.posterior", 6).alias("posterior"),
        "declared",
        F.col("text.n").alias("n_grams"),
        F.col("found.rejected").alias("rejected"),
    )


def keep_documents(docs: DataFrame, model: TextModel, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, unchanged, whose language can be told; the source stands for the host.

    Texts are scored once: rows are written with their evidence, counted, and filtered
    when they are read again.
    """
    columns = evidence(model, F.col(text_col), F.col(lang_col), host=F.col(source_col))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = materialize(docs.select(row, *[c.alias(k) for k, c in columns.items()]), "language-evidence")
    return Fusion(rows, model).apply(rows).where("not found.rejected").select("row.*")
