"""Streams: the script queue, the states of jobs, and the key ring."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def script_queue(spark: SparkSession, folder: str, archive: str | None = None) -> DataFrame:
    """Scripts that arrive in a folder, one row a file; finished ones move to ``archive``."""
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", 1000)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file_name"))


def write_available(rows: DataFrame, out: str) -> StreamingQuery:
    """Append all that lies in a stream's folder now to the Parquet table ``out`` (its state is in ``<out>-state``); the ended stream.

    Spark looks up each of a batch's files in a task of its own, thousands of results for the driver; here
    as many tasks as there are cores look up a share each. The session's setting is put back.
    """
    spark, name = rows.sparkSession, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        stream = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
        stream.awaitTermination()  # the source lists by the settings of the session that it was made in
    finally:
        spark.conf.set(name, before)
    return stream


def job_states(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The last state of each job within each hour; late events beyond the watermark are dropped.

    ``events``: ``job``, ``ts`` (timestamp), ``event`` and ``state``; of events at one time
    the one of the greatest ``event`` counts. Works on batches and streams alike.
    """
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "job").agg(F.max_by("state", F.struct("ts", "event")).alias("state"), F.count("*").alias("n")).select(
        F.col("w.start").alias("hour"), "job", "state", "n"
    )


def latest_states(events: DataFrame) -> DataFrame:
    """``job``, its latest ``state`` and ``since`` when, over all events (see ``job_states``).

    On a stream write it in ``update`` mode; its state is one row a job.
    """
    last = F.max(F.struct("ts", "event", "state")).alias("last")
    return events.groupBy("job").agg(last).select("job", F.col("last.state").alias("state"), F.col("last.ts").alias("since"))


def key_ring_stream(calls: DataFrame, keys: int = 3) -> DataFrame:
    """``key_ring`` on a stream: the ring's cooling times and dead keys are kept between batches.

    ``calls``: ``ring``, ``call``, ``at``, ``outcome``, ``wait_s``; calls of a batch are taken
    in the order of ``call``.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until, dead, at = state.get if state.exists else ([0.0] * keys, [False] * keys, 0)
        until, dead = list(until), list(dead)
        got = []
        for r in pd.concat(batches).sort_values("call", kind="stable").itertuples():
            free = [k % keys for k in range(at, at + keys) if not dead[k % keys] and until[k % keys] <= r.at]
            if free:
                at = (free[0] + 1) % keys
                dead[free[0]] |= r.outcome == "dead"
                if r.outcome == "quota":
                    until[free[0]] = r.at + max(5.0, r.wait_s)
            got.append((key[0], r.call, free[0] if free else -1))
        state.update((until, dead, at))
        yield pd.DataFrame(got, columns=["ring", "call", "key"])

    return calls.groupBy("ring").applyInPandasWithState(
        run, "ring long, call long, key int", "until array<double>, dead array<boolean>, at int", "append", GroupStateTimeout.NoTimeout
    )
