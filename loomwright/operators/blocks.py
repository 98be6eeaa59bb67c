"""Signals in blocks: a clip is rows ``clip``, ``block``, ``samples``, so that a long one passes through many tasks.

Blocks are numbered from 0 without gaps, (``clip``, ``block``) is unique, and all blocks of a clip
but its last hold ``size`` samples where a function takes that argument (``filtered``
and ``smoothed`` take blocks of any lengths). No function gathers a clip: what crosses
block edges is either a short summary of each block, passed on along the clip in order, or a
few samples of its neighbours. A null clip is a clip like others, null samples are 0, a null
block of samples is empty. Results are ``clip``, ``block``, ``samples`` (array<double>).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import small, written

Sections = tuple[tuple[float, float, float, float, float], ...]
_DOUBLES = T.ArrayType(T.DoubleType())


# --- blocks ---------------------------------------------------------------------------


def as_blocks(pieces: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` samples from pieces (``clip``, ``position`` of the first sample, ``samples``) that cover a clip without gaps.

    A piece is cut at block edges; the shares of a block, ordered by their positions, make it up.
    """
    n = F.size("samples")
    of = F.explode(F.sequence(F.floor(F.col("position") / size), F.floor((F.col("position") + n - 1) / size))).alias("block")
    cut = pieces.where(n > 0).select("clip", "position", F.col("samples").cast(_DOUBLES).alias("samples"), of)
    low = F.greatest(F.lit(0), F.col("block") * size - F.col("position")).cast("int")
    high = F.least(F.size("samples"), (F.col("block") + 1) * size - F.col("position")).cast("int")
    shares = cut.select("clip", "block", F.struct((F.col("position") + low).alias("at"), F.slice("samples", low + 1, high - low).alias("samples")).alias("share"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list("share")), lambda s: s["samples"]))
    return shares.groupBy("clip", "block").agg(joined.alias("samples"))


def neighbourhoods(blocks: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """``blocks`` with up to ``before`` samples of what precedes them and ``after`` of what follows, however many blocks those span.

    ``left`` samples in front and all behind the ``own`` ones belong to neighbours. Rows are dealt out
    by clip and block, so a clip's blocks stay spread over the tasks.
    """
    if min(size, before + 1, after + 1) < 1:
        raise ValueError("size must be positive, before and after not negative")
    shift = F.explode(F.sequence(F.lit(-(-(-after // size))), F.lit(-(-before // size)))).alias("shift")
    sent = blocks.select("clip", "block", F.coalesce(F.col("samples").cast(_DOUBLES), F.array().cast(_DOUBLES)).alias("samples"), shift)
    first, target = F.col("block") * size, (F.col("block") + F.col("shift")) * size
    low = (F.greatest(first, target - before) - first).cast("int")
    high = (F.least(first + F.size("samples"), target + size + after) - first).cast("int")
    part = F.when(high > low, F.slice("samples", low + 1, high - low)).otherwise(F.array().cast(_DOUBLES))
    sent = sent.where((F.col("shift") == 0) | (high > low)).select(
        "clip", (F.col("block") + F.col("shift")).alias("block"), "shift", F.struct(F.col("block").alias("of"), part.alias("samples")).alias("part")
    )
    whole = F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["samples"]))
    n = F.size("part.samples")
    rows = sent.groupBy("clip", "block").agg(
        whole.alias("samples"), F.sum(F.when(F.col("shift") > 0, n).otherwise(0)).cast("int").alias("left"), F.sum(F.when(F.col("shift") == 0, n)).cast("int").alias("own")
    )
    return rows.where("own IS NOT NULL")


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of arrays, and where each array begins and ends."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype("f8", copy=True)
    values[np.isnan(values)] = 0.0
    return values, np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])


def _arrays(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values))


def _alike(*counts: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Rows with equal counts, which are worked off as one matrix."""
    if len(counts[0]):
        kinds, of = np.unique(np.stack(counts, axis=1), axis=0, return_inverse=True)
        for k, kind in enumerate(kinds.tolist()):
            yield tuple(kind), np.flatnonzero(of.reshape(-1) == k)


def _mapped(rows: DataFrame, work: Callable, returns: dict[str, T.DataType], arrays: tuple[str, ...] = ("samples",), numbers: tuple[str, ...] = ()) -> DataFrame:
    """``clip``, ``block`` and what ``work`` returns, called once for all rows of a batch alike in array lengths and ``numbers``.

    It gets a matrix for each of ``arrays`` and an integer for each of ``numbers``, and gives
    a matrix for each array and a vector for each number that it returns.
    """
    schema = T.StructType([rows.schema["clip"], rows.schema["block"], *[T.StructField(n, t) for n, t in returns.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [_values(batch.column(name)) for name in arrays]
            whole = [batch.column(name).to_numpy(zero_copy_only=False).astype("i8") for name in numbers]
            done = []
            for kind, at in _alike(*[np.diff(edges) for _, edges in read], *whole):
                matrices = [values[edges[at][:, None] + np.arange(n)] for (values, edges), n in zip(read, kind)]
                done.append((at, work(*matrices, *kind[len(read) :])))
            columns = []
            for k, kind in enumerate(returns.values()):
                if isinstance(kind, T.ArrayType):
                    size = np.zeros(len(batch), "i8")
                    for at, out in done:
                        size[at] = out[k].shape[1]
                    edges = np.concatenate([[0], np.cumsum(size)])
                    values = np.empty(edges[-1])
                    for at, out in done:
                        values[edges[at][:, None] + np.arange(out[k].shape[1])] = out[k]
                    columns.append(_arrays(values, edges))
                else:
                    values = np.zeros(len(batch), "i8")
                    for at, out in done:
                        values[at] = out[k]
                    columns.append(pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("clip"), batch.column("block"), *columns], schema.names)

    return rows.select("clip", "block", *arrays, *numbers).mapInArrow(run, schema)


def _with_samples(rows: DataFrame) -> DataFrame:
    return rows.select("clip", "block", F.coalesce(F.col("samples").cast(_DOUBLES), F.array().cast(_DOUBLES)).alias("samples"))


# --- what is passed on from block to block --------------------------------------------


def _passed_on(summaries: DataFrame, start: list[float], step: Callable) -> DataFrame:
    """``clip``, ``block`` and the ``state`` before it, from one short row a block.

    ``step(batch)`` gives a function of row numbers and their states (a matrix) to the
    states after them. Rows come in order of clip and block; what is held is one state
    and a batch. Different clips of a batch are taken together.
    """
    schema = T.StructType([summaries.schema["clip"], summaries.schema["block"], T.StructField("state", _DOUBLES)])
    first = np.array([start])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, None
        for batch in batches:
            if not len(batch):
                continue
            clips = batch.column("clip")
            codes = pc.fill_null(clips.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype("i8")
            begins = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1) != 0)
            lengths = np.diff(np.append(begins, len(batch)))
            state = np.repeat(first, len(begins), axis=0)
            if carried is not None and clips[0].as_py() == last:
                state[0] = carried
            order = np.argsort(-lengths, kind="stable")  # longest first, so those that go on are in front
            begins, lengths, state = begins[order], lengths[order], state[order]
            after, out = step(batch), np.empty((len(batch), first.shape[1]))
            for t in range(int(lengths[0])):
                on = int(np.searchsorted(-lengths, -t, "left"))
                at = begins[:on] + t
                out[at] = state[:on]
                state[:on] = after(at, state[:on])
            last, carried = clips[len(batch) - 1].as_py(), state[int(np.argmax(order))]
            yield pa.RecordBatch.from_arrays([clips, batch.column("block"), _arrays(out.reshape(-1), np.arange(len(batch) + 1) * first.shape[1])], schema.names)

    return summaries.repartition("clip").sortWithinPartitions("clip", "block").mapInArrow(run, schema)


def _with_states(blocks: DataFrame, states: DataFrame) -> DataFrame:
    b, s = blocks.alias("b"), small(written(states, "block-states")).alias("s")
    same = F.col("b.clip").eqNullSafe(F.col("s.clip")) & (F.col("b.block") == F.col("s.block"))
    return b.join(s, same).select("b.clip", "b.block", "b.samples", "s.state")


# --- filters --------------------------------------------------------------------------


def _system(sections: Sections) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Sections one after another as one linear system: its state moves by z' = A z + B x, its output is C z + D x."""
    a, b, c, d = np.empty((0, 0)), np.empty(0), np.empty(0), 1.0
    for b0, b1, b2, a1, a2 in sections:
        enters = np.array([b1 - a1 * b0, b2 - a2 * b0])
        a = np.block([[a, np.zeros((len(a), 2))], [np.outer(enters, c), np.array([[-a1, 1.0], [-a2, 0.0]])]])
        b, c, d = np.append(b, enters * d), np.append(b0 * c, [1.0, 0.0]), b0 * d
    return a, b, c, d


@lru_cache(16)
def _kernels(sections: Sections, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For n samples: what the state adds to each output, what each input adds to the state after them, and the impulse response."""
    a, b, c, d = _system(sections)
    seen, kept, power = c[None, :], b[None, :], a
    while len(seen) < n:
        seen, kept, power = np.vstack([seen, seen @ power]), np.vstack([kept, kept @ power.T]), power @ power
    return seen[:n], kept[:n][::-1], np.append(d, seen[: n - 1] @ b)


def _convolved(x: np.ndarray, response: np.ndarray) -> np.ndarray:
    """Each row convolved with the response, cut to its length."""
    n = x.shape[1]
    if n <= 64:
        apart = np.arange(n)[:, None] - np.arange(n)
        return x @ np.where(apart >= 0, response[np.maximum(apart, 0)], 0.0).T
    size = 1 << (2 * n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(response, size), size)[:, :n]


def filtered(blocks: DataFrame, sections: Sections) -> DataFrame:
    """The blocks of each clip through a cascade of second-order sections (b0, b1, b2, a1, a2; a0 is 1), as if it were filtered at once.

    A block gives the state that it would leave when it is entered at rest. The states are passed on along
    the clip, each moved by the transition of a block's length, joined back, and what the
    state before a block adds is added to its outputs from rest. Samples are read twice
    and shuffled only if the states (one short row a block) outgrow a broadcast.
    """
    sections = tuple(tuple(map(float, s)) for s in sections)
    blocks = _with_samples(blocks)
    if not sections:
        return blocks

    def ends(x: np.ndarray):
        n = x.shape[1]
        return (x @ _kernels(sections, n)[1] if n else np.zeros((len(x), 2 * len(sections)))), n

    def step(batch: pa.RecordBatch):
        n, end = batch.column("n").to_numpy(), _values(batch.column("end"))[0].reshape(len(batch), -1)
        moves = {k: np.linalg.matrix_power(_system(sections)[0], k).T for k in np.unique(n).tolist()}

        def after(at: np.ndarray, state: np.ndarray) -> np.ndarray:
            moved, sizes = np.empty_like(state), n[at]
            for k in np.unique(sizes).tolist():
                some = sizes == k
                moved[some] = state[some] @ moves[k]
            return moved + end[at]

        return after

    def outputs(x: np.ndarray, state: np.ndarray):
        if not x.shape[1]:
            return (x,)
        seen, _, response = _kernels(sections, x.shape[1])
        return (_convolved(x, response) + state @ seen.T,)

    summaries = _mapped(blocks, ends, {"end": _DOUBLES, "n": T.LongType()})
    states = _passed_on(summaries, [0.0] * 2 * len(sections), step)
    return _mapped(_with_states(blocks, states), outputs, {"samples": _DOUBLES}, ("samples", "state"))


# --- attack and release ---------------------------------------------------------------

#: Slopes below this add nothing to a number of usual size; a line that isn't there.
_FLAT, _NONE = 1e-18, -1e300


class _Lines:
    """Functions y -> max over k of (up**k * down**(steps - k) * y + line[k]), each the outcome of ``steps`` steps.

    One step towards v is the greater of two rising lines, up * y + (1 - up) * v and down
    * y + (1 - down) * v, if the attack (up) is the faster of the two. Steps composed are
    an upper envelope with one line for each number of attacks among them. Lines whose slope is as
    good as none are held as one, the last.
    """

    def __init__(self, up: float, down: float):
        self.logs = np.log(up), np.log(down)
        self.most = int(np.ceil(np.log(_FLAT) / self.logs[0])) if up > 0 else 1
        self.up, self.down = up, down

    def slopes(self, steps: np.ndarray, width: int) -> np.ndarray:
        k = np.arange(width)
        rest = steps[..., None] - k
        return np.where((rest < 0) | (k >= self.most), 0.0, np.exp(k * self.logs[0] + np.maximum(rest, 0) * self.logs[1]))

    def at(self, line: np.ndarray, steps: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (self.slopes(steps, line.shape[-1]) * y[..., None] + line).max(axis=-1)

    def of(self, v: np.ndarray) -> np.ndarray:
        return np.stack([(1 - self.down) * v, (1 - self.up) * v], axis=-1)

    def after(self, line: np.ndarray, steps: np.ndarray, first: np.ndarray, first_steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The functions ``line`` of what the functions ``first`` give."""
        width = min(line.shape[-1] + first.shape[-1] - 1, self.most + 1)
        out = np.full((*line.shape[:-1], width), _NONE)
        slope = self.slopes(steps, line.shape[-1])
        for k in range(line.shape[-1]):
            some = slope[..., k : k + 1] * first + line[..., k : k + 1]
            inside = min(some.shape[-1], width - k)
            np.maximum(out[..., k : k + inside], some[..., :inside], out=out[..., k : k + inside])
            if inside < some.shape[-1]:
                np.maximum(out[..., -1], some[..., inside:].max(axis=-1), out=out[..., -1])
        return out, steps + first_steps

    def tree(self, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Functions of single steps, of pairs of steps, of pairs of those, up to that of the whole row."""
        n = v.shape[1]
        full = 1 << max(0, n - 1).bit_length()
        line, steps = np.full((len(v), full, 2), _NONE), np.zeros((len(v), full), "i8")
        line[:, :n], steps[:, :n] = self.of(v), 1
        line[:, n:, 0] = 0.0  # no step
        levels = [(line, steps)]
        while levels[-1][0].shape[1] > 1:
            line, steps = levels[-1]
            levels.append(self.after(line[:, 1::2], steps[:, 1::2], line[:, ::2], steps[:, ::2]))
        return levels


def smoothed(blocks: DataFrame, up: float, down: float, start: float = 0.0) -> DataFrame:
    """One-pole smoothing y = a * y + (1 - a) * v, where a is ``up`` while v is above y, else ``down`` (0 < up, down < 1), from ``start`` on.

    A block's effect on y is composed from those of its halves, down to single steps (an upper
    envelope of lines). The whole blocks' functions are passed on along the clip, and each block
    works out the values between from the y before it: first its halves', then their halves'.
    """
    if not (0 < up < 1 and 0 < down < 1):
        raise ValueError("the coefficients lie between 0 and 1")
    sign = 1.0 if up <= down else -1.0  # a slower attack is a faster release of the negative
    lines = _Lines(min(up, down), max(up, down))
    blocks = _with_samples(blocks)

    def whole(v: np.ndarray):
        if not v.shape[1]:
            return np.zeros((len(v), 1)), 0
        line, steps = lines.tree(sign * v)[-1]
        return line[:, 0], steps[:, 0]

    def step(batch: pa.RecordBatch):
        steps = batch.column("steps").to_numpy()
        values, edges = _values(batch.column("line"))
        sizes = np.diff(edges)

        def after(at: np.ndarray, state: np.ndarray) -> np.ndarray:
            out = np.empty_like(state)
            for n in np.unique(sizes[at]).tolist():
                some = np.flatnonzero(sizes[at] == n)
                rows = at[some]
                out[some, 0] = lines.at(values[edges[rows][:, None] + np.arange(n)], steps[rows], state[some, 0])
            return out

        return after

    def between(v: np.ndarray, state: np.ndarray):
        if not v.shape[1]:
            return (v,)
        levels, y = lines.tree(sign * v), state
        for line, steps in levels[-2::-1]:
            halves = np.empty((len(v), line.shape[1]))
            halves[:, ::2] = y
            halves[:, 1::2] = lines.at(line[:, ::2], steps[:, ::2], y)
            y = halves
        y = y[:, : v.shape[1]]
        return (sign * (lines.slopes(np.ones((), "i8"), 2) * y[..., None] + lines.of(sign * v)).max(axis=-1),)

    summaries = _mapped(blocks, whole, {"line": _DOUBLES, "steps": T.LongType()})
    states = _passed_on(summaries, [sign * start], step)
    return _mapped(_with_states(blocks, states), between, {"samples": _DOUBLES}, ("samples", "state"))


# --- what neighbours lend -------------------------------------------------------------


def _padded(x: np.ndarray, left: int, own: int, before: int, after: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (before - left, after - (x.shape[1] - left - own))))


def sliding_peaks(blocks: DataFrame, size: int, n: int) -> DataFrame:
    """The greatest absolute value of the n samples on either side of each sample and its own, across block edges.

    Each row is cut into stretches of 2n + 1; a window spans the end of one and the
    beginning of the next, so suffix maxima of the one and prefix maxima of the other give it.
    """
    width = 2 * n + 1

    def peaks(x: np.ndarray, left: int, own: int):
        padded = np.abs(_padded(x, left, own, n, n))
        rows = np.pad(padded, ((0, 0), (0, -padded.shape[1] % width))).reshape(len(x), -1, width)
        upto = np.maximum.accumulate(rows, axis=2).reshape(len(x), -1)
        since = np.maximum.accumulate(rows[:, :, ::-1], axis=2)[:, :, ::-1].reshape(len(x), -1)
        return (np.maximum(since[:, :own], upto[:, width - 1 : width - 1 + own]),)

    return _mapped(neighbourhoods(blocks, size, n, n), peaks, {"samples": _DOUBLES}, ("samples",), ("left", "own"))


def sliding_means(blocks: DataFrame, size: int, width: int, power: int = 1) -> DataFrame:
    """The mean of the ``width`` absolute values (to a power) around each sample, width // 2 of them before it; ends of clips are repeated."""
    before, after = width // 2, width - 1 - width // 2

    def means(x: np.ndarray, left: int, own: int):
        right = x.shape[1] - left - own
        padded = np.abs(np.pad(x, ((0, 0), (before - left, after - right)), mode="edge")) ** power
        return (np.lib.stride_tricks.sliding_window_view(padded, width, axis=1).mean(axis=2),)

    return _mapped(neighbourhoods(blocks, size, before, after), means, {"samples": _DOUBLES}, ("samples",), ("left", "own"))


# --- curves and rates -----------------------------------------------------------------


def interpolated(blocks: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """The curve through ``points`` (``clip``, ``position``, ``value``) at every sample of ``blocks``.

    Straight lines between points, wherever they lie between samples; the first and the last value go on
    to the ends. A block takes the points within it and, by an as-of window over one short row a block, the
    last point before and the first behind. Clips without points give 0. Points of a null
    position or value don't count; of several at a position the one of the greatest value.
    """
    of = points.where("position IS NOT NULL AND value IS NOT NULL").groupBy("clip", F.col("position").cast("double").alias("x")).agg(F.max(F.col("value").cast("double")).alias("y"))
    inside = of.groupBy("clip", F.greatest(F.floor(F.col("x") / size), F.lit(-1)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    inside = written(inside, "curve-points")
    edges = inside.select("clip", "block", F.element_at("p", 1).alias("first"), F.element_at("p", -1).alias("last"))
    b, e = blocks.select("clip", "block").alias("b"), edges.alias("e")
    same = F.col("b.clip").eqNullSafe(F.col("e.clip")) & (F.col("b.block") == F.col("e.block"))
    own = F.col("b.block").isNotNull()
    grid = b.join(e, same, "full").select(
        F.when(own, F.col("b.clip")).otherwise(F.col("e.clip")).alias("clip"), F.coalesce("b.block", "e.block").alias("block"), own.alias("own"), "e.first", "e.last"
    )
    w = Window.partitionBy("clip")
    # backwards for the points behind, since frames grow from their first row
    behind = F.last("first", ignorenulls=True).over(w.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.last("last", ignorenulls=True).over(w.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    edge = grid.select("clip", "block", "own", behind.alias("behind"), ahead.alias("ahead")).where("own").drop("own")
    empty = F.array().cast("array<struct<x:double,y:double>>")
    some = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(empty)
    n, d, p = blocks.select("clip", "block", F.greatest(F.size("samples"), F.lit(0)).alias("n")).alias("n"), edge.alias("d"), inside.alias("p")
    joined = n.join(d, F.col("n.clip").eqNullSafe(F.col("d.clip")) & (F.col("n.block") == F.col("d.block"))).join(
        p, F.col("n.clip").eqNullSafe(F.col("p.clip")) & (F.col("n.block") == F.col("p.block")), "left"
    )
    near = F.concat(some("d.ahead"), F.coalesce("p.p", empty), some("d.behind")).alias("near")
    rows = joined.select("n.clip", "n.block", "n.n", near).select("clip", "block", "n", F.col("near.x").alias("x"), F.col("near.y").alias("y"))

    def drawn(x: np.ndarray, y: np.ndarray, n: int, block: int):
        if not x.shape[1] or not n:
            return (np.zeros((len(x), n)),)
        at = block * size + np.arange(n, dtype="f8")
        # rows of one block number alike in length: points before each sample, counted by row
        k = np.clip((x[:, :, None] <= at).sum(axis=1), 1, max(1, x.shape[1] - 1)) if x.shape[0] * x.shape[1] * n <= 1 << 20 else np.stack([np.clip(np.searchsorted(r, at, "right"), 1, max(1, len(r) - 1)) for r in x])
        low = np.arange(len(x))[:, None]
        if x.shape[1] == 1:
            return (np.repeat(y, n, axis=1),)
        x0, x1, y0, y1 = x[low, k - 1], x[low, k], y[low, k - 1], y[low, k]
        share = np.clip((at - x0) / (x1 - x0), 0.0, 1.0)
        return (y0 + share * (y1 - y0),)

    return _mapped(rows.withColumn("number", F.col("block")), drawn, {"samples": _DOUBLES}, ("x", "y"), ("n", "number"))


def with_gain(blocks: DataFrame, decibels: DataFrame) -> DataFrame:
    """``blocks`` turned down by ``decibels``, a curve of equal blocks."""
    b, g = blocks.alias("b"), decibels.alias("g")
    same = F.col("b.clip").eqNullSafe(F.col("g.clip")) & (F.col("b.block") == F.col("g.block"))
    joined = b.join(g, same).select("b.clip", "b.block", "b.samples", F.col("g.samples").alias("decibels"))
    return _mapped(joined, lambda x, g: (x * 10 ** (g / -20),), {"samples": _DOUBLES}, ("samples", "decibels"))


def lengths(blocks: DataFrame) -> DataFrame:
    """``clip`` and its number ``n`` of samples."""
    return blocks.groupBy("clip").agg(F.sum(F.greatest(F.size("samples"), F.lit(0)).cast("long")).alias("n"))


def resampled(blocks: DataFrame, size: int, ratio: float) -> DataFrame:
    """Each clip drawn anew with round(n / ratio) samples (one at least) at equal distances from its first to its last.

    A block works out the samples that lie in it or between it and its neighbour, which lends one; they are
    cut into blocks of ``size`` again. Clips without samples stay so.
    """
    if not ratio > 0:
        raise ValueError("the ratio must be positive")
    many = small(written(lengths(blocks), "clip-lengths")).alias("m")
    near = neighbourhoods(blocks, size, 0, 1).alias("b")
    rows = near.join(many, F.col("b.clip").eqNullSafe(F.col("m.clip"))).select("b.*", F.col("m.n").alias("n"), F.col("b.block").alias("number"))

    def drawn(x: np.ndarray, own: int, n: int, block: int):
        m = max(1, int(np.round(n / ratio)))
        apart = (n - 1) / (m - 1) if m > 1 else 0.0
        first = block * size
        low, high = (max(0, int(first / apart) - 2), min(m, int((first + own) / apart) + 3)) if apart else (0, m)
        at = np.arange(low, high)
        place = np.minimum(at * apart, n - 1.0)
        inside = (place >= first) & (place < first + own)
        at, place = at[inside], place[inside]
        if not len(at):
            return np.zeros((len(x), 0)), -1
        k = np.floor(place).astype("i8") - first
        share = place - np.floor(place)
        return x[:, k] + share * (x[:, np.minimum(k + 1, x.shape[1] - 1)] - x[:, k]), at[0]

    made = _mapped(rows, drawn, {"samples": _DOUBLES, "position": T.LongType()}, ("samples",), ("own", "n", "number"))
    none = _with_samples(blocks).where("block = 0 AND size(samples) = 0")
    return as_blocks(made, size).unionByName(none.select("clip", F.col("block").cast("long").alias("block"), "samples"))


# --- noise ----------------------------------------------------------------------------


def _spectra(x: np.ndarray, frame: int) -> tuple[np.ndarray, np.ndarray]:
    """Spectra of frames half a frame apart, of rows that begin with the first one, and the window."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    views = np.lib.stride_tricks.sliding_window_view(x, frame, axis=1)[:, :: frame // 2]
    return np.fft.rfft(views * window, axis=2) / window.sum(), window


def _frames_of(x: np.ndarray, left: int, own: int, size: int, block: int, n: int, frame: int, more: int) -> tuple[np.ndarray, int, int]:
    """The samples that the frames around a block need (zeros beyond the clip), the first frame's number, and how many frames there are.

    Frame k covers half a frame on either side of sample k * frame / 2, k from 0 to
    ceil(n / (frame / 2)). ``more`` frames on either side of those that touch the block are included.
    """
    hop = frame // 2
    begin, last = block * size, -(-n // hop)
    low = max(0, begin // hop - more)
    high = min(last, -(-(begin + own) // hop) + more)
    first, end = low * hop - hop, high * hop + hop
    have = begin - left
    out = np.zeros((len(x), end - first))
    a, b = max(first, have), min(end, have + x.shape[1])
    out[:, a - first : b - first] = x[:, a - have : b - have]
    return out, low, high - low + 1


def noise_floors(blocks: DataFrame, size: int, frame: int, quantile: float = 0.1) -> DataFrame:
    """``clip`` and ``floor``, an array: what each frequency's quietest frames hold (a quantile of the frames, between ranks by straight lines).

    Every frame is a row of the block that its middle lies in; the order statistic is taken per
    clip and frequency by a window that spills, so the number of a clip's frames isn't bounded.
    """
    hop = frame // 2
    near = _with_lengths(neighbourhoods(blocks, size, frame, frame), blocks)

    def sizes(x: np.ndarray, left: int, own: int, n: int, block: int):
        begin = block * size
        low, high = -(-begin // hop), -(-(begin + own) // hop) - 1
        if begin + own == n:
            high = -(-n // hop)  # the last frames
        if not n or high < low:
            return (np.zeros((len(x), 0)),)
        padded, first, _ = _frames_of(x, left, own, size, block, n, frame, 1)
        spectra = np.abs(_spectra(padded, frame)[0])[:, low - first : high - first + 1]
        return (spectra.reshape(len(x), -1),)

    bins = frame // 2 + 1
    made = _mapped(near, sizes, {"sizes": _DOUBLES}, ("samples",), ("left", "own", "n", "number"))
    each = made.select("clip", F.posexplode("sizes").alias("at", "value")).select("clip", (F.col("at") % bins).alias("bin"), "value")
    w = Window.partitionBy("clip", "bin")
    ranked = each.select("clip", "bin", "value", F.row_number().over(w.orderBy("value")).alias("rank"), F.count("*").over(w).alias("many"))
    place = quantile * (F.col("many") - 1) + 1
    beside = ranked.where((F.col("rank") == F.floor(place)) | (F.col("rank") == F.floor(place) + 1))
    share = place - F.floor(place)
    weight = F.when(F.col("rank") == F.floor(place), 1 - share).otherwise(share)
    floors = beside.groupBy("clip", "bin").agg(F.sum(weight * F.col("value")).alias("value"))
    return floors.groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "value"))), lambda s: s["value"]).alias("floor"))


def _with_lengths(near: DataFrame, blocks: DataFrame) -> DataFrame:
    many = small(written(lengths(blocks), "clip-lengths")).alias("m")
    b = near.alias("b")
    return b.join(many, F.col("b.clip").eqNullSafe(F.col("m.clip"))).select("b.*", "m.n", F.col("b.block").alias("number"))


def denoised(blocks: DataFrame, size: int, frame: int, depth_db: float = 9.0) -> DataFrame:
    """Each frequency turned down where it holds little more than its noise floor, by ``depth_db`` at most.

    A frame's gain is (size - 1.5 floors) / size, at least the depth and at most 1, and its mean
    over the frame and its neighbours (at the ends: itself again) counts; frames are laid over
    each other by their windows. Blocks work out the frames that touch them from what neighbours lend.
    """
    if frame % 2:
        raise ValueError("frames have an even number of samples")
    least = 10 ** (-abs(depth_db) / 20)
    near = written(_with_lengths(neighbourhoods(blocks, size, 2 * frame, 2 * frame), blocks), "neighbourhoods").alias("b")
    floors = small(written(noise_floors(blocks, size, frame), "noise-floors"), 20_000).alias("f")
    rows = near.join(floors, F.col("b.clip").eqNullSafe(F.col("f.clip")), "left").select("b.*", F.coalesce("f.floor", F.array().cast(_DOUBLES)).alias("floor"))

    def cleaned(x: np.ndarray, floor: np.ndarray, left: int, own: int, n: int, block: int):
        hop, begin = frame // 2, block * size
        if not own:
            return (np.zeros((len(x), 0)),)
        padded, first, count = _frames_of(x, left, own, size, block, n, frame, 1)
        spectra, window = _spectra(padded, frame)
        level = np.abs(spectra)
        gain = np.clip((level - 1.5 * floor[:, None]) / (level + 1e-9), least, 1.0)
        gain = np.pad(gain, ((0, 0), (1, 1), (0, 0)), mode="edge")
        gain = (gain[:, :-2] + gain[:, 1:-1] + gain[:, 2:]) / 3
        parts = np.fft.irfft(spectra * gain * window.sum(), frame, axis=2) * window
        total, weight = np.zeros_like(padded), np.zeros(padded.shape[1])
        for half in (0, 1):  # every sample lies in two frames: their first and their second halves
            piece = slice(half * hop, half * hop + hop)
            span = slice(half * hop, half * hop + count * hop)
            total[:, span] += parts[:, :, piece].reshape(len(x), -1)
            weight[span] += np.tile(window[piece] ** 2, count)
        at = begin - (first * hop - hop)
        return ((total / np.where(weight > 1e-10, weight, 1.0))[:, at : at + own],)

    return _mapped(rows, cleaned, {"samples": _DOUBLES}, ("samples", "floor"), ("left", "own", "n", "number"))
