"""Queries of signals in blocks: vectors as clips in blocks of eight samples; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import block_mastering, blocks, mastering
from ..sources.shared import written
from .queries import query, table

SIZE, RATE = 8, 24000


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a clip in blocks."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * SIZE + 1, F.lit(SIZE)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip"), F.posexplode(cut).alias("block", "samples"))


def samples(found: DataFrame, digits: int = 6) -> DataFrame:
    each = found.select(F.col("clip").alias("vec_id"), (F.col("block") * SIZE).alias("first"), F.posexplode("samples").alias("at", "value"))
    return each.select("vec_id", (F.col("first") + F.col("at")).cast("long").alias("pos"), (F.round("value", digits) + 0.0).alias("value"))


#: Samples of all vectors, numbered from 0.
_X = "x AS (SELECT vec_id, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def _sections(*made) -> blocks.Sections:
    """Sections of the equalizer's own formulas."""
    out = []
    for kind, freq, gain, q in made:
        b, a = mastering._rbj(kind, freq, RATE, gain, q)
        out.append((*b.tolist(), *a[1:].tolist()))
    return tuple(out)


#: Two sections of the high-pass filter, here at a frequency that short clips feel.
FILTER = _sections(("highpass", 1500.0, 0.0, 0.5412), ("highpass", 1500.0, 0.0, 1.3066))


def _filter_sql(sections: blocks.Sections) -> str:
    """Recursion over the samples of each vector, the two states of every section carried along (transposed direct form)."""
    y, names, moved = "v", [], []
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        out = f"({b0!r} * {y} + p{k})"
        names += [f"p{k}", f"q{k}"]
        moved += [f"{b1!r} * {y} - ({a1!r}) * {out} + q{k}", f"{b2!r} * {y} - ({a2!r}) * {out}"]
        y = out
    zero = ", ".join("CAST(0 AS DOUBLE)" for _ in names)
    return f"""WITH RECURSIVE w(vec_id, pos, y, {", ".join(names)}) AS (
  SELECT vec_id, 0, CAST(NULL AS DOUBLE), {zero} FROM embeddings
  UNION ALL SELECT vec_id, pos + 1, {y}, {", ".join(moved)}
  FROM (SELECT w.*, CAST(embedding[pos + 1] AS DOUBLE) AS v FROM w JOIN embeddings USING (vec_id) WHERE pos < 64))
SELECT vec_id, CAST(pos - 1 AS BIGINT) AS pos, round(y, 6) + 0.0 AS value FROM w WHERE pos > 0"""


@query(_filter_sql(FILTER))
def d7_filtered_blocks(spark, sf_dir):
    return samples(blocks.filtered(vectors(spark, sf_dir), FILTER))


UP, DOWN = 0.35, 0.9


@query(
    f"""WITH RECURSIVE w(vec_id, pos, y) AS (
  SELECT vec_id, 0, CAST(0 AS DOUBLE) FROM embeddings
  UNION ALL SELECT vec_id, pos + 1, CASE WHEN v > y THEN {UP} ELSE {DOWN} END * y + (1 - CASE WHEN v > y THEN {UP} ELSE {DOWN} END) * v
  FROM (SELECT w.*, CAST(embedding[pos + 1] AS DOUBLE) AS v FROM w JOIN embeddings USING (vec_id) WHERE pos < 64))
SELECT vec_id, CAST(pos - 1 AS BIGINT) AS pos, round(y, 6) + 0.0 AS value FROM w WHERE pos > 0"""
)
def d11_smoothed_blocks(spark, sf_dir):
    return samples(blocks.smoothed(vectors(spark, sf_dir), UP, DOWN))


@query(
    f"""WITH {_X} SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(max(abs(v)) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING), 6) AS value FROM x"""
)
def d13_sliding_peaks(spark, sf_dir):
    """Windows of 11 samples on either side, wider than a block."""
    return samples(blocks.sliding_peaks(vectors(spark, sf_dir), SIZE, 11))


#: Curve points lie 7.5 samples apart, from sample 2 on; vectors divisible by 10 have but every fifth, or none if divisible by 100.
_POINTS = """p AS (SELECT vec_id, 2 + 7.5 * k AS px, abs(CAST(embedding[k + 1] AS DOUBLE)) * 30 AS py FROM embeddings, range(9) r(k)
  WHERE vec_id % 10 > 0 OR (k % 5 = 1 AND vec_id % 100 > 0))"""


@query(
    f"""WITH {_X}, {_POINTS},
a AS (SELECT x.vec_id, pos, v, max(px) FILTER (px <= pos) AS x0, min(px) FILTER (px > pos) AS x1 FROM x LEFT JOIN p USING (vec_id) GROUP BY ALL),
g AS (SELECT a.*, p.py AS y0, q.py AS y1 FROM a LEFT JOIN p ON a.vec_id = p.vec_id AND a.x0 = p.px LEFT JOIN p q ON a.vec_id = q.vec_id AND a.x1 = q.px)
SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(v * pow(10, -CASE WHEN x0 IS NULL THEN coalesce(y1, 0) WHEN x1 IS NULL THEN y0 ELSE y0 + (pos - x0) / (x1 - x0) * (y1 - y0) END / 20), 6) + 0.0 AS value FROM g"""
)
def d14_gain_curves(spark, sf_dir):
    """Vectors turned down by curves of another rate than theirs."""
    v, k = vectors(spark, sf_dir), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")
    points = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", k).where("vec_id % 10 > 0 OR (k % 5 = 1 AND vec_id % 100 > 0)")
    points = points.select(F.col("vec_id").alias("clip"), (2 + 7.5 * F.col("k")).alias("position"), (F.abs(F.get("embedding", "k").cast("double")) * 30).alias("value"))
    return samples(blocks.with_gain(v, blocks.interpolated(v, points, SIZE)))


RATIO = 1.3


@query(
    f"""WITH n AS (SELECT vec_id, embedding, CAST(round(64 / {RATIO}) AS INT) AS m FROM embeddings),
a AS (SELECT vec_id, embedding, unnest(range(m)) AS pos, m FROM n),
b AS (SELECT *, least(pos * (63 / (m - 1)), 63) AS p FROM a)
SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(CAST(embedding[CAST(floor(p) AS INT) + 1] AS DOUBLE) + (p - floor(p)) * (CAST(embedding[least(CAST(floor(p) AS INT) + 2, 64)] AS DOUBLE) - CAST(embedding[CAST(floor(p) AS INT) + 1] AS DOUBLE)), 6) + 0.0 AS value FROM b"""
)
def d4_resampled_blocks(spark, sf_dir):
    return samples(blocks.resampled(vectors(spark, sf_dir), SIZE, RATIO))


FRAME, HOP = 16, 8


@query(
    f"""WITH {_X}, win AS (SELECT range AS j, 0.5 - 0.5 * cos(2 * pi() * range / {FRAME}) AS h FROM range({FRAME})),
tw AS (SELECT j, h, b, cos(2 * pi() * j * b / {FRAME}) AS c, sin(2 * pi() * j * b / {FRAME}) AS s FROM win, (SELECT range AS b FROM range({FRAME // 2 + 1}))),
f AS (SELECT vec_id, k, b, sum(v * h * c) / {HOP} AS re, -sum(v * h * s) / {HOP} AS im FROM x, (SELECT range AS k FROM range({64 // HOP + 1})) kk, tw
  WHERE j = pos - (k * {HOP} - {HOP}) GROUP BY vec_id, k, b),
m AS (SELECT *, sqrt(re * re + im * im) AS size FROM f),
fl AS (SELECT vec_id, b, quantile_cont(size, 0.1) AS floor FROM m GROUP BY vec_id, b),
g AS (SELECT m.*, greatest({10 ** (-9 / 20)!r}, least(1.0, (size - 1.5 * floor) / (size + 1e-9))) AS gain FROM m JOIN fl USING (vec_id, b)),
sm AS (SELECT *, (gain + coalesce(lag(gain) OVER w, gain) + coalesce(lead(gain) OVER w, gain)) / 3 AS mean FROM g WINDOW w AS (PARTITION BY vec_id, b ORDER BY k)),
y AS (SELECT vec_id, k * {HOP} - {HOP} + j AS pos, h, sum(CASE WHEN b IN (0, {FRAME // 2}) THEN 1 ELSE 2 END * mean * (re * c - im * s)) / {FRAME} * {HOP} * h AS part
  FROM sm JOIN tw USING (b) GROUP BY vec_id, k, j, h)
SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(sum(part) / sum(h * h), 6) + 0.0 AS value FROM y WHERE pos BETWEEN 0 AND 63 GROUP BY vec_id, pos"""
)
def d9_denoised_blocks(spark, sf_dir):
    return samples(blocks.denoised(vectors(spark, sf_dir), SIZE, FRAME))


@query()
def d16_mastered_blocks(spark, sf_dir):
    """A hundred vectors a clip through the mastering chain, in blocks of half a clip; what comes out is measured."""
    at = F.col("vec_id") % 100 * 64
    pieces = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("clip"), at.alias("position"), F.col("embedding").alias("samples"))
    done = written(block_mastering.mastered(blocks.as_blocks(pieces, 3200), 3200, 8000), "mastered")
    n, peak, lufs = blocks.lengths(done), block_mastering.peaks(done), block_mastering.loudness(done, 8000)
    return n.join(peak, "clip").join(lufs, "clip").select("clip", F.col("n").alias("n_samples"), F.round("peak", 6).alias("peak"), F.round("lufs", 4).alias("lufs"))
