"""Incremental indexing by Structured Streaming, listing diffs, and the job's event log."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.merge import snapshot_diff
from ..plans.index import Base, index_documents
from ..sources.files import WANTED, list_files, load_raw
from ..tables import cut


def watch_files(spark: SparkSession, root: str, base: Base, checkpoint: str, provider=None, max_files: int = 100, available_now: bool = True, on_error: Callable[[str, str], None] | None = None):
    """Index new and changed files of a folder as they come, `max_files` a batch (back pressure). A batch that is
    run again after a failure finds its files unchanged and adds nothing. Each file that cannot be loaded is told to on_error."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)
    wanted = files.where(WANTED)

    def index(batch: DataFrame, _: int) -> None:
        loaded = cut(load_raw(batch.select("path", "content", F.unix_timestamp("modificationTime").alias("mtime"))), "loaded")
        index_documents(base, loaded.where("error is null"), provider)
        if on_error is not None:
            for row in loaded.where("error is not null").select("path", "error").toLocalIterator():
                on_error(row["path"], row["error"])

    writer = wanted.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def poll(spark: SparkSession, root: str, before: DataFrame | None, on_change: Callable[[str, str], None]) -> DataFrame:
    """One round of a watcher that sees deletions too: tell each added, changed or removed path since the listing
    before, and return the listing now. The first round tells nothing."""
    now = cut(list_files(spark, root), "listing")
    if before is not None:
        for row in snapshot_diff(before, now, "path", "mtime").orderBy("path").toLocalIterator():
            on_change(row["path"], row["change"])
    return now


class _Changes(StatefulProcessor):
    """Keeps the last time and hash of each path; tells what a sweep finds different, and paths that a later sweep lacks."""

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "mtime long, hash string, sweep long")

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for part in rows:
            if key[0] == "":
                continue  # marks of sweeps
            for mtime, digest, at in part[["mtime", "hash", "at"]].sort_values("at").itertuples(index=False):
                digest = digest if isinstance(digest, str) else None
                old = self.seen.get() if self.seen.exists() else None
                if old is not None and at <= old[2]:
                    continue  # an older sweep, or the same again
                same = old is not None and int(mtime) == old[0]
                if not same:
                    out.append((key[0], "new" if old is None else "touched" if digest is not None and digest == old[1] else "changed", int(at)))
                self.seen.update((int(mtime), old[1] if same and digest is None else digest, int(at)))
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(int(at) + 1)  # not with its own sweep's watermark
        yield pd.DataFrame(out, columns=["path", "change", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # The watermark has passed the last sweep that had the path.
        self.seen.clear()
        yield pd.DataFrame({"path": [key[0]], "change": ["removed"], "at": [expiredTimerInfo.getExpiryTimeInMs() - 1]})

    def close(self) -> None:
        pass


SWEEP = "path string, mtime long, hash string, sweep timestamp"


def sweep(listing: DataFrame, folder: str, at: int) -> None:
    """Append a listing (path, mtime, and hash where it is known) to the sweeps in a folder, in one commit; `at` (epoch seconds)
    rises from sweep to sweep. An empty listing is a sweep too: a row without a path marks its time."""
    known = F.col("hash") if "hash" in listing.columns else F.lit(None)
    rows = listing.select("path", "mtime", known.cast("string").alias("hash"))
    mark = listing.sparkSession.createDataFrame([(None, None, None)], "path string, mtime long, hash string")
    rows.unionByName(mark).withColumn("sweep", F.timestamp_seconds(F.lit(at))).write.mode("append").parquet(folder)


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """path, change (new, touched: same bytes at another time, changed, removed) and sweep, as a stream over the sweeps in a
    folder. State is kept by path and survives restarts; a removal is told once a later sweep, which no longer has the path, has
    moved the watermark past the last one that had it (for it, `sweep` is that last one)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.readStream.schema(SWEEP).option("maxFilesPerTrigger", 1_000_000).parquet(folder).withWatermark("sweep", "0 seconds")
    keyed = rows.withColumns({"path": F.coalesce("path", F.lit("")), "at": F.unix_millis("sweep")}).groupBy("path")
    told = keyed.transformWithStateInPandas(statefulProcessor=_Changes(), outputStructType="path string, change string, at long", outputMode="Append", timeMode="EventTime")
    return told.select("path", "change", F.timestamp_millis("at").alias("sweep"))


class EventLog:
    """Progress of jobs as rows appended to a table; readers go on from where they stopped."""

    SCHEMA = "job string, seq long, phase string, body string, done boolean"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.next = spark, folder, {}

    def writer(self, job: str) -> Callable[[dict], None]:
        import json

        def emit(event: dict) -> None:
            seq = self.next.get(job, 0)
            self.next[job] = seq + 1
            self.spark.createDataFrame([(job, seq, event.get("phase"), json.dumps(event), bool(event.get("done")))], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

        return emit

    def replay(self, job: str, cursor: int = 0) -> DataFrame:
        """Events of a job from a position on, up to its end."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder).where((F.col("job") == job) & (F.col("seq") >= cursor)).orderBy("seq")


def latest_per_key(events: DataFrame, key: str, time: str, watermark: str = "1 hour") -> DataFrame:
    """Streaming or batch: the last event of each key, as an aggregate with bounded state."""
    rows = events.withWatermark(time, watermark) if events.isStreaming else events
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in events.columns if c != key)), time).alias("last")).select(key, "last.*")
