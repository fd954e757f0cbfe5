"""Structured Streaming forms. Each takes and returns a streaming (or batch) DataFrame; start() runs one until its input is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates(events: DataFrame, *, error: Column, width: str = "5 minutes", slide: str = "30 seconds", late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Events and errors in sliding windows; a window is final once the watermark has passed it."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), *by).agg(F.count("*").alias("events"), F.count_if(error).alias("errors"))
    return out.select(*by, F.col("window.start").alias("start"), "events", "errors")


def averages(events: DataFrame, value: str, *, by: tuple[str, ...], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), *by).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    return out.select(*by, F.col("window.start").alias("start"), "total", "n", (F.col("total") / F.col("n")).alias("mean"))


def pattern_counts(corrections: DataFrame) -> DataFrame:
    """The running count of each (pattern, correction), for update mode."""
    return corrections.groupBy(F.trim("raw_text").alias("pattern"), F.trim("corrected_text").alias("correction")).agg(F.count("*").alias("frequency"), F.max("created_at").alias("last_used"))


def once(events: DataFrame, key: str = "id", *, late: str = "1 hour") -> DataFrame:
    """Each queued item once, whatever is sent again within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, by: str, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    return out.select(by, F.col("session_window.start").alias("start"), "last", "events")


def resolved(orphans: DataFrame, documents: DataFrame, *, wait: str = "1 hour") -> DataFrame:
    """Corrections that came before their document, joined once it comes; those whose document does not come within wait have null."""
    left = orphans.withWatermark("ts", wait).alias("o")
    right = documents.withWatermark("document_ts", wait).alias("d")
    near = F.expr(f"o.document_id = d.document_id and d.document_ts >= o.ts and d.document_ts <= o.ts + interval {wait}")
    return left.join(right, near, "leftOuter").select("o.*", F.col("d.document_ts").alias("document_ts"))


def over_limit(events: DataFrame, by: str, limit: int, *, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count("*").alias("requests"))
    return out.filter(F.col("requests") > limit).select(by, F.col("window.start").alias("start"), "requests")


def reservoir(samples: DataFrame, by: str, key: str, capacity: int, *, seed: int = 42) -> DataFrame:
    """What a bounded sample of each class holds: rows come with the hash of their key, and a class keeps its least ones. The state of a class is its rows, never more than capacity."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    hashed = samples.select(F.col(by).cast("string").alias("group"), F.col(key).cast("long").alias("key"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"))

    def keep(group: tuple, batches, state: GroupState):
        keys, hashes, seen = state.get if state.exists else ([], [], 0)
        rows = dict(zip(keys, hashes, strict=True))
        for batch in batches:
            seen += len(batch)
            rows.update(zip(batch["key"].tolist(), batch["h"].tolist(), strict=True))
            rows = dict(sorted(rows.items(), key=lambda x: (x[1], x[0]))[:capacity])
        state.update((list(rows), list(rows.values()), seen))
        yield pd.DataFrame({"group": [group[0]], "kept": [sorted(rows)], "seen": [seen]})

    return hashed.groupBy("group").applyInPandasWithState(keep, "group string, kept array<long>, seen long", "keys array<long>, hashes array<long>, seen long", "update", GroupStateTimeout.NoTimeout)


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "append") -> None:
    """Run over all that is there, batch by batch, and stop. The checkpoint makes a restart go on where it ended."""
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def every(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, *, seconds: int, until_idle: bool = False, mode: str = "append"):
    """Run a batch every so many seconds; returns the running query, or with until_idle stops it once all that is there has been read."""
    running = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
    if until_idle:
        running.processAllAvailable()
        running.stop()
    return running


def next_runs(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs (name, period and offset in seconds) with due, the next time after now that lies offset behind a whole number of periods since the start of 1970 (a Thursday)."""
    at = F.unix_timestamp(now)
    return jobs.withColumn("due", F.timestamp_seconds((F.floor((at - F.col("offset")) / F.col("period")) + 1) * F.col("period") + F.col("offset")))


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch for rows that are final: each batch has a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
