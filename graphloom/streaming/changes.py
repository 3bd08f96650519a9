"""Change events as streams: windowed counts, and fingerprints kept as state between deliveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.snapshots import INDEX, SnapshotIndex
from graphloom.session import delete_folder


def window_counts(events: DataFrame, ts: str, keys: list[str], length: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events per tumbling window and key; on a stream ``late`` bounds how long a window waits for stragglers."""
    e = events.withWatermark(ts, late) if late and events.isStreaming else events
    return e.groupBy(F.window(ts, length).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Runs of events of a key with no pause longer than the gap."""
    e = events.withWatermark(ts, late) if late and events.isStreaming else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), *keys, "n")


class FingerprintStream:
    """foreachBatch target: each micro-batch holds deliveries of snapshots; changes are appended to a table.

    The index is a folder of versions in shared storage, each with the values of the rows it points to. A version is
    written whole before the next batch uses it, and a batch that runs again starts from the version before it, so a
    restart repeats no change. Versions before that one are deleted, so the folder does not grow with the stream.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _index(self, version: int) -> DataFrame | None:
        return self.spark.read.schema(INDEX).parquet(f"{self.folder}/index/v={version}") if version >= 0 else None

    def _values(self, version: int) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/values/v={version}") if version >= 0 else None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        new, old = batch.select("fp_row", "functions"), self._values(epoch - 1)
        values = new if old is None else old.unionByName(new)
        index = SnapshotIndex(self.spark, values, self.buckets, self._index(epoch - 1))
        numbers = [r[0] for r in batch.select("snapshot_no").where("snapshot_no is not null").distinct().orderBy("snapshot_no").collect()]
        parts = [index.apply(batch.where(F.col("snapshot_no") == n), n) for n in numbers]
        for n, part in zip(numbers, parts, strict=True):
            part.write.mode("overwrite").parquet(f"{self.folder}/changes/epoch={epoch}/number={n}")
        index.index.write.mode("overwrite").parquet(f"{self.folder}/index/v={epoch}")
        values.join(index.index.select("fp_row"), "fp_row", "left_semi").write.mode("overwrite").parquet(f"{self.folder}/values/v={epoch}")
        batch.unpersist()
        for name in ("index", "values"):
            delete_folder(self.spark, f"{self.folder}/{name}/v={epoch - 2}")


def start(stream: DataFrame, target: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a stream of deliveries into a foreachBatch target until its source has no more."""
    return stream.writeStream.foreachBatch(target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
