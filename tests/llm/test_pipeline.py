import corpus_pipeline

from loomwright.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    result = corpus_pipeline.run(spark, SF)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns, name
        ids = {r[0] for r in after.select("doc_id").collect()}
        assert ids <= {r[0] for r in kept.select("doc_id").collect()}
        kept = docs.where(docs.doc_id.isin(list(ids)))
    assert {r["doc_id"] for r in result.collect()} == ids


def test_names():
    assert len(corpus_pipeline.STAGES) == 5 and {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 14))


def test_stages_take_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "!" * 50_000, "xx", None, 1)], docs.schema)
    for table in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, SF).collect()


def test_encoding_takes_small_arrow_batches(spark, monkeypatch):
    """While texts are encoded, Arrow batches are as small as those of the other stages; only what the last stage wrote stays."""
    from pathlib import Path

    from pyspark.sql import DataFrameWriter

    from loomwright.llm import common

    seen, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: seen.append((path, spark.conf.get(common._BYTES_SETTING))) or write(self, path, *a, **b))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("*"))
    result = corpus_pipeline.run(spark, SF)
    assert "ids_sha256" in result.columns and "/encoded-" in seen[-1][0] and {x for _, x in seen} == {str(common.ARROW_BYTES)}
    assert [p.name.split("-")[0] for p in set(shared.glob("*")) - before] == ["encoded"] and result.count() > 0


def test_run_equals_brute_force(spark):
    """From the first stage's output on: rules with exact quantiles, all pairs, all windows, the library's tokens."""
    import hashlib
    import re
    from collections import Counter

    import numpy as np
    import public_tokenizers as P
    import tiktoken

    from loomwright.llm import bpe, quality

    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def rates(t):
        w = word.findall(t)
        seen = Counter(zip(w, w[1:], w[2:]))
        repeated = len({i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for k in range(3)})
        lines = [x for x in t.split("\n") if word.search(x)]
        chars, n = sum(map(len, w)), len(w)
        if not n:
            return None
        upper = sum(c.isupper() for c in t)
        return n < 50 or 100 * repeated > 50 * n, (len(re.findall(r"[#*$%&|<>]", t)) / n, upper / chars, (len(lines) - len(set(lines))) / len(lines), repeated / n, chars / n)

    of = {i: rates(t) for i, t in texts.items()}
    place = {r["doc_id"]: (r["lang"], r["source"]) for r in first.collect()}

    def limits(some):
        values = np.array([of[i][1] for i in some if of[i]])
        q1, q3 = np.quantile(values, [0.25, 0.75], axis=0, method="inverted_cdf")
        width = 3 * np.maximum(q3 - q1, [r.least_spread for r in quality.RATES])
        return len(values), np.array([np.where([r.two_sided for r in quality.RATES], q1 - width, -9), q3 + width])

    def fits(i):
        """Limits of the group, drawn towards the language's, and those towards the corpus's."""
        lang, source = place[i]
        bounds = limits(of)[1]
        for some in ([j for j in of if place[j][0] == lang], [j for j in of if place[j] == (lang, source)]):
            n, own = limits(some)
            bounds = (own * n + bounds * quality.PARENT_DOCS) / (n + quality.PARENT_DOCS)
        return (np.array(of[i][1]) <= bounds[1]).all() and (np.array(of[i][1]) >= bounds[0]).all()

    kept = sorted(i for i, r in of.items() if r and not r[0] and fits(i))

    def shingles(t):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = {i: shingles(texts[i]) for i in kept}
    root = {i: i for i in kept}
    near = [(i, j) for i in kept for j in kept if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in range(10):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    gap = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: gap.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = lower(r["text"])
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    clean = [i for i in kept if root[i] == i and not any(tuple(w[k : k + s]) in windows for w in [lower(texts[i])] for s in sizes for k in range(len(w) - s + 1))]
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expected = {i: hashlib.sha256(",".join(map(str, lib.encode_ordinary(texts[i]))).encode()).hexdigest() for i in clean}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()} == expected
