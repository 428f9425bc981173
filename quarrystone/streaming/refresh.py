"""Incremental and streaming refresh.

A folder that gets new files is a stream; each micro-batch goes through the same operators as a
full run.  State lives in Parquet tables of numbered versions, so a batch that is replayed after a
failure finds its version there and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quarrystone.operators.delta import changed_files


class VersionedTable:
    """A small state table; each batch writes a whole new version."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, p, path = self._fs()
        if not fs.exists(p):
            return []
        names = [s.getPath() for s in fs.listStatus(p)]
        return sorted(int(n.getName()[1:]) for n in names if n.getName().startswith("v") and fs.exists(path(n, "_SUCCESS")))

    def read(self, below: int | None = None) -> DataFrame:
        """The newest version (below a number, if given), or no rows."""
        known = [v for v in self.versions() if below is None or v < below]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{known[-1]}") if known else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int, keep: int = 3) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        fs, _, path = self._fs()
        for old in self.versions()[:-keep]:
            fs.delete(path(f"{self.path}/v{old}"), True)


def watch(files: DataFrame, state: VersionedTable, on_change: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follow a stream of (file, hash, content): only rows whose hash is new reach ``on_change``.

    ``state`` has (file, hash).  The latest row of a file within a batch counts: by the column ``modified`` if the
    stream has it (on a tie, the greater hash), and without it, by the hash alone.
    """

    def batch(df: DataFrame, number: int) -> None:
        if number in state.versions():
            return
        known = state.read(number)
        order = F.struct(*(["modified"] if "modified" in df.columns else []), "hash")
        latest = df.groupBy("file").agg(F.max_by(F.struct(*(c for c in df.columns if c != "file")), order).alias("x")).select("file", "x.*").select(*df.columns)
        status = changed_files(latest.select("file", "hash"), known).where("status = 'changed'").select("file")
        on_change(latest.join(status, "file", "left_semi"), number)
        now = latest.select("file", "hash")
        state.write(known.join(now, "file", "left_anti").unionByName(now), number)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def _marked(events: DataFrame, at: str, lateness: str) -> DataFrame:
    """Time as a timestamp (watermarks take no other type), with a watermark on a stream."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, lateness) if rows.isStreaming else rows


def windowed_counts(events: DataFrame, at: str, keys: list[str], value: str, width: str = "1 day", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Extension: counts and sums by time window; on a stream, with a watermark of ``lateness``."""
    rows = _marked(events, at, lateness)
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def session_counts(events: DataFrame, at: str, key: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Extension: events by session of each key."""
    rows = _marked(events, at, lateness)
    return rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def record_history(state: VersionedTable, entry: DataFrame, keep: int = 30) -> None:
    """Upsert today's entry (day, ...): the last of a day counts, the last ``keep`` days stay."""
    versions = state.versions()
    rest = state.read().join(entry.select("day"), "day", "left_anti")
    merged = rest.unionByName(entry).orderBy(F.desc("day")).limit(keep)
    state.write(merged, versions[-1] + 1 if versions else 0)
