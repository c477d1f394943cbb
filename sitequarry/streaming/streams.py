"""Structured Streaming forms. Each gives what its batch form gives on the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.chunking import chunk
from ..operators.dedup import latest_version
from ..operators.html import documents
from ..operators.monitoring import alerts_of
from ..sources.writers import append_fresh


def page_chunks(pages: DataFrame, kb_id: str = "kb") -> DataFrame:
    """Pages (url, html) to chunks with hashes; stateless, for batch and stream."""
    docs = documents(pages).select(F.col("canonical_url").alias("url"), "title", "text")
    return chunk(docs).withColumn("kb_id", F.lit(kb_id))


def ingest(pages: DataFrame, table: str, checkpoint: str, kb_id: str = "kb", embed: Callable[[DataFrame], DataFrame] | None = None):
    """STR1, STR9: every micro-batch adds the chunks that the table lacks. A batch that is run again adds nothing, so the
    effect is exactly-once; the checkpoint resumes after a crash."""

    def add(batch: DataFrame, _: int) -> None:
        chunks = page_chunks(batch, kb_id)
        append_fresh(embed(chunks) if embed else chunks, table)

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_content(docs: DataFrame, hash_col: str = "content_hash", at: str | None = None, keep: str = "30 days") -> DataFrame:
    """STR2: the first row of each content. With a time column, hashes are forgotten after `keep`; without one, never."""
    if at is None:
        return docs.dropDuplicates([hash_col])
    return docs.withWatermark(at, keep).dropDuplicatesWithinWatermark([hash_col])


def sessions(events: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """STR3."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count("*").alias("events")).select(user, F.col("w.start").alias("first_at"), F.col("w.end").alias("until"), "events")


def sliding_report(calls: DataFrame, at: str = "ts", size: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """STR4."""
    out = calls.withWatermark(at, late).groupBy(F.window(at, size, slide).alias("w"))
    return out.agg(F.count("*").alias("calls"), F.count_if("success").alias("successful"), F.avg("response_time").alias("avg_response_time")).select(F.col("w.start").alias("from_at"), F.col("w.end").alias("to_at"), "calls", "successful", "avg_response_time")


def alerts(calls: DataFrame, errors: DataFrame, health: DataFrame, slow_ms: int = 5000) -> DataFrame:
    """STR5: of streams: each alert as its row comes."""
    return alerts_of(calls, errors, health, slow_ms)


def upsert_latest(pages: DataFrame, table: str, checkpoint: str):
    """STR8: every micro-batch adds its rows to the table as a delta, named by the checkpoint and the batch's number, so one that is run again replaces itself and
    a new checkpoint leaves what is there. Nothing is rewritten; latest() reads the newest row of each key, compact() gathers the deltas."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/delta={name}-{n:012}")

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str, schema: str, key: str = "url", at: str = "fetched_at") -> DataFrame:
    """STR8, SNK5: the newest row of each key in a table of deltas."""
    return latest_version(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(table), key, at)


def compact(spark: SparkSession, table: str, target: str, schema: str, key: str = "url", at: str = "fetched_at") -> None:
    """The newest rows of a table of deltas as the first delta of another table, for readers and streams to go on with."""
    latest(spark, table, schema, key, at).write.mode("errorifexists").parquet(f"{target}/delta=compacted")


def not_older_than(rows: DataFrame, ttl: str, at: str = "fetched_at", now: Column | None = None) -> DataFrame:
    """STR6 over a table: the rows younger than the time to live."""
    return rows.where(F.col(at) > (F.current_timestamp() if now is None else now) - F.expr(f"interval {ttl}"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TtlCache(StatefulProcessor):
    """The time of a key's last fetch, and a timer that clears it once its time to live is over by event time."""

    def __init__(self, ttl_ms: int, key: str, at: str):
        self.ttl_ms, self.key, self.at = ttl_ms, key, at

    def init(self, handle) -> None:
        self.handle = handle
        self.fetched = handle.getValueState("fetched", "at long")

    def _forget_at(self, fetched: int) -> int:
        return -(-fetched // 1000) + self.ttl_ms + 1

    def handleInputRows(self, key, rows, timerValues):
        times = np.sort(np.concatenate([r[self.at].to_numpy("datetime64[us]") for r in rows])).astype(np.int64)
        before = fetched = self.fetched.get()[0] if self.fetched.exists() else None
        hits = []
        for t in times.tolist():
            hits.append(fetched is not None and t - fetched <= self.ttl_ms * 1000)
            fetched = fetched if hits[-1] else t
        if fetched != before:
            if before is not None:
                self.handle.deleteTimer(self._forget_at(before))
            self.fetched.update((fetched,))
            self.handle.registerTimer(self._forget_at(fetched))
        yield pd.DataFrame({self.key: [key[0]] * len(times), self.at: times.astype("datetime64[us]"), "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.fetched.clear()
        yield pd.DataFrame({self.key: pd.Series(dtype=object), self.at: pd.Series(dtype="datetime64[us]"), "hit": pd.Series(dtype=bool)})

    def close(self) -> None:
        pass


def ttl_cache(requests: DataFrame, ttl_seconds: int, key: str = "key", at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """STR6: a keyed cache with a time to live, as state: of each request (key, ts) whether the cache has the key, fetched no longer ago than the time to live;
    what it has not, or not young enough, is fetched then. State is one time for each key that is young enough: an event-time timer clears the others, so it follows the keys of a time to live, not all that
    were ever seen. Requests may come up to `late` out of order; older ones are left out. Timers need the RocksDB state store, which is set for the session's streams."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = requests.schema[key].dataType.simpleString()
    timed = requests.select(key, at).withWatermark(at, late)
    return timed.groupBy(key).transformWithStateInPandas(TtlCache(ttl_seconds * 1000, key, at), f"{key} {kind}, {at} timestamp, hit boolean", "append", "EventTime")


def progress(jobs: DataFrame, table: str, checkpoint: str, every: str | None = "3 seconds"):
    """STR7, SNK9: snapshots of job rows, added as they come, every so often; with every=None, what is there now. A batch that is run again replaces itself."""

    def add(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={n}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return jobs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger).start()
