"""Results kept by content: what was computed once for a content and settings isn't computed again.

A store is a folder of Parquet tables, one for each run that had something new. Rows of the input get a
key, the hash of their content and the settings; an anti join finds keys that no run
has results for; these, each once, are computed and appended by Spark's own commit, so
a run that fails leaves the store as it was, and what two runs append at once counts once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_key(columns: list[str], settings: dict[str, object]) -> Column:
    """SHA-256 of the columns' values and of settings; nulls differ from any value, and neighbours don't run together."""
    values = [F.when(F.col(f"`{c}`").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string"))) for c in columns]
    return F.sha2(F.concat(F.lit(json.dumps(settings, sort_keys=True)), F.lit("\n"), *values), 256)


class ResultStore:
    """Results below ``path``; ``schema`` is theirs without ``key`` and ``name``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = f"key string, name string, {schema}"

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def runs(self) -> list[str]:
        """Folders of runs that were committed, in order of their names."""
        fs, path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
        if not fs.exists(path(self.path)):
            return []
        found = [str(s.getPath()) for s in fs.listStatus(path(self.path)) if s.isDirectory() and s.getPath().getName().startswith("run-")]
        return sorted(f for f in found if fs.exists(path(f"{f}/_SUCCESS")))

    def read(self) -> DataFrame:
        """All results, one row a key."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*runs)
        return rows if len(runs) == 1 else rows.dropDuplicates(["key"])

    def computed(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], content: list[str], settings: dict[str, object], name: Column | None = None) -> DataFrame:
        """``rows`` with ``key`` and the results of their content.

        ``compute`` gets ``key`` and the content columns of keys without a result, each once, and gives
        ``key`` and the results; a key that it gives none for stays without (nulls here, tried
        again by the next run). ``name`` (of any one row of a key) is what ``evict`` goes by. Only
        keys are shuffled to find what is new, contents only of what is.
        """
        keyed = rows.withColumn("key", content_key(content, settings))
        labelled = keyed.select("key", (F.lit(None).cast("string") if name is None else name).alias("name"), *[F.col(f"`{c}`") for c in content])
        missing = labelled.groupBy("key").agg(F.min("name").alias("name")).join(self.read().select("key"), "key", "left_anti")
        todo = labelled.drop("name").join(missing.select("key"), "key", "left_semi").dropDuplicates(["key"])
        results = [c for c in self.spark.createDataFrame([], self.schema).columns if c not in ("key", "name")]
        new = compute(todo).select("key", *results).join(missing, "key").select("key", "name", *results)
        run = f"{self.path}/run-{len(self.runs()):08d}-{uuid.uuid4().hex}"
        new.write.parquet(run)
        if not self.spark.read.schema(self.schema).parquet(run).limit(1).count():  # nothing was new
            self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(run), True)
        return keyed.join(self.read().select("key", *results), "key", "left")

    def evict(self, prefix: str) -> int:
        """Drop the results whose name begins with ``prefix``; how many.

        What stays is written as one new run before the old ones go.
        """
        old, rows = self.runs(), self.read()
        goes = F.coalesce(F.startswith("name", F.lit(prefix)), F.lit(False))
        n = rows.where(goes).count()
        if n:
            rows.where(~goes).write.parquet(f"{self.path}/run-{len(old):08d}-{uuid.uuid4().hex}")
            for folder in old:
                self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)
        return n
