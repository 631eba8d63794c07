"""Reloading sources as they change: snapshots in, actions out, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.catalog import snapshot_diff

#: The order in which actions are carried out.
ORDER = ("update", "add", "remove")


class Baseline:
    """The last applied snapshot, kept as Parquet in a shared folder, a partition a version; the highest one counts.

    A version's files appear when its write commits, so a restart finds the last whole one.
    """

    def __init__(self, path: str):
        self.path, self.version = path, None

    def _last(self, spark) -> int | None:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            return None
        done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(n) for n in done if n.isdigit()), default=None)

    def read(self, like: DataFrame) -> DataFrame | None:
        if self.version is None:
            self.version = self._last(like.sparkSession)
        return None if self.version is None else like.sparkSession.read.schema(like.schema).parquet(f"{self.path}/{self.version}")

    def write(self, snapshot: DataFrame, version: int) -> None:
        if version == self.version:
            return  # a batch that runs again after a restart: its snapshot was written when all went well
        snapshot.write.mode("overwrite").parquet(f"{self.path}/{version}")
        self.version = version


def reconcile(snapshot: DataFrame, version: int, baseline: Baseline, apply: Callable[[str, DataFrame], None]) -> None:
    """Applies what changed since the baseline, which moves only when all went well. The first snapshot is just recorded."""
    before = baseline.read(snapshot)
    if before is not None:
        actions = snapshot_diff(before, snapshot)
        for action in ORDER:
            apply(action, actions.filter(F.col("action") == action).select("id"))
    baseline.write(snapshot, version)


def watch(source: DataFrame, state: str, checkpoint: str, apply: Callable[[str, DataFrame], None]) -> StreamingQuery:
    """Reconciles every batch of a stream of (id, version); of an id's rows the newest ``ts`` counts.

    Ids not seen again stay: a stream brings changes, and an id goes by a row whose version is null.
    """
    baseline = Baseline(state)

    def step(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("id").agg(F.max_by("version", "ts").alias("version"))
        before = baseline.read(latest)
        if before is not None:
            latest = before.join(latest.select("id"), "id", "left_anti").unionByName(latest)
        reconcile(latest.filter("version is not null"), number, baseline, apply)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_tiles(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of tile writes (ts, z, x, y, tile_data) as counts and bytes a zoom and hour; later rows than ``delay`` are dropped."""
    hours = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "z")
    return hours.agg(F.count("*").alias("n_tiles"), F.sum(F.octet_length("tile_data")).alias("bytes")).select(F.col("window.start").alias("hour"), "z", "n_tiles", "bytes")
