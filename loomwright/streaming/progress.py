"""Jobs with progress, refusals and time-outs, on streams and on tables alike.

Events say that a job is ``waiting``, ``running`` (step k of n), ``done`` or ``failed``. A job moves from
waiting to running and ends done or failed; progress doesn't go back. Events that break this, or are
older than the job's last one, are refused and change nothing. A job without news for longer than
``patience`` has failed at that moment. What comes after a job's end begins the
job anew, if it may begin one: an ended job leaves no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Which states may follow which ("" is none yet).
FOLLOWS = {"": {"waiting", "running"}, "waiting": {"running", "failed"}, "running": {"running", "done", "failed"}}
ENDS = {"done", "failed"}
#: What a job's state is: its name, step k of n, the time of its last event in microseconds, and that event.
STATE = "state string, k int, n int, at long, event long"
OUT = "job long, at long, event long, state string, k int, n int, note string"


def advanced(held: tuple | None, at: int, event: int, state: str, k: int | None, n: int | None, patience: int) -> tuple[tuple | None, list[tuple]]:
    """The job's state after one event, and rows (at, event, state, k, n, note) about it.

    ``note`` is accepted, refused or no news. Times are microseconds.
    """
    out: list[tuple] = []
    if held is not None and at - held[3] > patience:
        out.append(_lost(held, patience))
        held = None
    before = held[0] if held else ""
    back = held is not None and (at < held[3] or (state == "running" == before and (k is None or k < (held[1] or 0))))
    if state not in FOLLOWS[before] or back:
        return held, [*out, (at, event, state, k, n, "refused")]
    if held is not None and state != "running":
        k, n = held[1], held[2]  # an end keeps the progress
    out.append((at, event, state, k, n, "accepted"))
    return (None if state in ENDS else (state, k, n, at, event)), out


def _lost(held: tuple, patience: int) -> tuple:
    return held[3] + patience, held[4], "failed", held[1], held[2], "no news"


def _or_none(x):
    return None if x is None or pd.isna(x) else int(x)


class Tracker(StatefulProcessor):
    """The jobs of a stream: one short row a running job, dropped with its end, and a timer for each."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at", "event"], kind="stable")
        held, out = self.held.get() if self.held.exists() else None, []
        for r in pdf.itertuples():
            held, some = advanced(held, int(r.at), int(r.event), r.state, _or_none(r.k), _or_none(r.n), self.patience)
            out += some
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.held.clear()
        else:
            self.held.update(tuple(held))
            self.handle.registerTimer((held[3] + self.patience) // 1000 + 1)
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            held = self.held.get()
            self.held.clear()
            yield _frame(key[0], [_lost(held, self.patience)])

    def close(self) -> None:
        pass


def _frame(job: int, rows: list[tuple]) -> pd.DataFrame:
    names = ["at", "event", "state", "k", "n", "note"]
    pdf = pd.DataFrame(rows, columns=names).astype({"k": "Int32", "n": "Int32"})
    pdf.insert(0, "job", job)
    return pdf


def _rows(events: DataFrame) -> DataFrame:
    return events.select(F.col("job").cast("long").alias("job"), "ts", F.unix_micros("ts").alias("at"), F.col("event").cast("long").alias("event"), "state", F.col("k").cast("int").alias("k"), F.col("n").cast("int").alias("n"))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("job", F.timestamp_micros("at").alias("ts"), "event", "state", "k", "n", "note")


def tracked_stream(events: DataFrame, patience_s: int, delay: str = "10 minutes") -> DataFrame:
    """``job``, ``ts``, ``event``, ``state``, ``k``, ``n`` and ``note`` of every event, and of every job that is given up.

    ``events``: ``job`` (long), ``ts``, ``event``, ``state``, ``k``, ``n``. Events later than the watermark (``delay``)
    are dropped; a job is given up when the watermark has passed its patience. Append mode; needs the RocksDB
    state store.
    """
    rows = _rows(events.where("job IS NOT NULL AND ts IS NOT NULL")).withWatermark("ts", delay)
    out = rows.groupBy("job").transformWithStateInPandas(Tracker(patience_s * 1_000_000), OUT, "Append", "EventTime")
    return _named(out)


def tracked(events: DataFrame, patience_s: int, until: int | None = None) -> DataFrame:
    """``tracked_stream`` over a table: the same rows once all events are in and the time is that of the last event of all.

    Jobs are parted and sorted by time; a task folds event after event and holds one job's
    state. Events without a job or time are left out. ``until`` (microseconds) sets another time.
    """
    patience = patience_s * 1_000_000
    rows = _rows(events.where("job IS NOT NULL AND ts IS NOT NULL"))
    now = rows.agg(F.max("at")).first()[0] if until is None else until
    schema = T.StructType.fromDDL(OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        job, held = None, None
        for batch in batches:
            out = []
            for j, at, event, state, k, n in zip(*(batch.column(c).to_pylist() for c in ("job", "at", "event", "state", "k", "n"))):
                if j != job:
                    if held is not None and now - held[3] > patience:
                        out.append((job, *_lost(held, patience)))
                    job, held = j, None
                held, some = advanced(held, at, event, state, k, n, patience)
                out += [(j, *r) for r in some]
            yield _batch(out, to_arrow_schema(schema))
        if held is not None and now - held[3] > patience:
            yield _batch([(job, *_lost(held, patience))], to_arrow_schema(schema))

    return _named(rows.drop("ts").repartition("job").sortWithinPartitions("job", "at", "event").mapInArrow(run, schema))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)
