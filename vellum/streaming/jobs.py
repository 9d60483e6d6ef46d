"""Streams over jobs, library items and call metrics.

Micro-batches stand for the reference's timers: a trigger interval and a cap on files per trigger decide how much is
embedded at once.  State is in the query's checkpoint, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vellum.operators import sync, tables, vector

BATCH_TEXTS, FLUSH = 40, "200 milliseconds"
MAX_RETRIES, RETRY_AFTER_MS = 3, 10_000


def embed_stream(texts: DataFrame, folder: str, checkpoint: str, embed=vector.embed_words, dimension: int = 64, available_now: bool = False) -> StreamingQuery:
    """Texts (id, text) embedded as they come; an epoch that is tried again overwrites what it wrote."""

    def write(batch: DataFrame, epoch: int) -> None:
        vector.embedded(batch, "text", embed, dimension, BATCH_TEXTS).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    writer = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=FLUSH)).start()


def reconciled(library: tables.Library, listing: DataFrame, complete: bool) -> int:
    """Deletes papers that came from a remote library and that its listing (key, version) no longer has, with all that
    belongs to them; an incomplete listing deletes nothing.  The number of papers deleted."""
    local = library.table("papers").where("source is not null").select("id", F.col("source").alias("key"), F.lit(0).cast("long").alias("version"))
    gone = sync.sync_plan(listing, local, complete).where("action = 'remove'").join(local.select("key", "id"), "key").select("id")
    n = gone.count()
    if n:
        library.delete_papers(gone)
    return n


def sync_stream(items: DataFrame, library: tables.Library, table: str, checkpoint: str, available_now: bool = False, listing: Callable[[], tuple[DataFrame, bool]] | None = None) -> StreamingQuery:
    """Changed items upserted by key; of an item that changed twice in a batch the newest version counts.  After each batch
    what the remote listing (its rows, and whether it is complete) no longer has is deleted."""

    def write(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), "version").alias("r")).select("r.*")
        library.upsert(table, newest.drop("version"))
        if listing is not None:
            reconciled(library, *listing())

    writer = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


JOB_OUT = "paper_id string, action string, attempt int"


class JobQueue(StatefulProcessor):
    """Jobs of one paper: the attempt that runs, and retries that wait, by the time of their timers."""

    def __init__(self, retry_after_ms: int, max_retries: int):
        self.retry_after_ms, self.max_retries = retry_after_ms, max_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "attempt int")
        self.waiting = handle.getMapState("waiting", "at long", "attempt int")

    def _start(self, attempt: int) -> tuple[str, int]:
        if self.running.exists():
            return "skip", attempt
        self.running.update((attempt,))
        return "start", attempt

    def _ended(self, event: str, now: int) -> tuple[str, int] | None:
        if not self.running.exists():
            return None
        attempt = self.running.get()[0]
        self.running.clear()
        if event == "done":
            return "indexed", attempt
        if event == "failed" and attempt <= self.max_retries:
            at = now + self.retry_after_ms
            # a paper's timers are told apart by their times
            while self.waiting.containsKey((at,)):
                at += 1
            self.waiting.updateValue((at,), (attempt + 1,))
            self.handle.registerTimer(at)
            return "retry", attempt
        return "failed", attempt

    @staticmethod
    def _rows(key, found: list) -> Iterator[pd.DataFrame]:
        out = [(key[0], *x) for x in found if x]
        if out:
            yield pd.DataFrame(out, columns=["paper_id", "action", "attempt"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("at", kind="stable")["event"]
        now = timerValues.getCurrentProcessingTimeInMs()
        yield from self._rows(key, [self._start(1) if e == "submit" else self._ended(e, now) for e in events])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = (expiredTimerInfo.getExpiryTimeInMs(),)
        attempt = self.waiting.getValue(at)[0]
        self.waiting.removeKey(at)
        yield from self._rows(key, [self._start(attempt)])

    def close(self) -> None:
        pass


def job_queue(events: DataFrame, retry_after_ms: int = RETRY_AFTER_MS, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Actions from job events (paper_id, event, at): submit, done, failed, and exhausted for a failure that no retry mends.

    A paper in flight is not started again.  One that failed is no longer in flight: its retry waits for a timer, up to three
    times, and a submit that comes meanwhile starts at once; the retry then starts as soon as its timer ends, or is skipped
    if the paper is in flight.  State and timers are in the checkpoint, so a restart loses no retry.  The session needs the
    RocksDB state store, as ``build_session`` sets it."""
    return events.groupBy("paper_id").transformWithStateInPandas(JobQueue(retry_after_ms, max_retries), JOB_OUT, "append", "ProcessingTime")


def rolling_metrics(calls: DataFrame, window: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Calls, failures and mean latency per kind and sliding window of call time; calls later than ``late`` are dropped."""
    by = calls.withWatermark("created_at", late).groupBy(F.window("created_at", window, slide), "kind")
    return by.agg(F.count(F.lit(1)).alias("calls"), F.sum(F.when(F.col("success"), 0).otherwise(1)).alias("failures"), F.avg("latency_ms").alias("avg_latency_ms"))
