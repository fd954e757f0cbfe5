"""Registered queries that run as streams: they read all files there are, batch by batch, and return what the sink then holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import streaming
from textloom.streaming import stateful
from textloom.plans.queries import queries, query, table  # noqa: F401
from textloom.sources import stores
from textloom.sources.shared import shared_folder


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream; watermarks need times with a zone."""
    rows = spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{name}*.parquet")
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def unzoned(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in rows.schema.fields if f.dataType.typeName() == "timestamp"})


def settled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Run in update mode into a table that has each key's newest row."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    streaming.start(rows, stores.upsert_batches(f"{folder}/out", keys), f"{folder}/checkpoint", mode="update")
    return unzoned(stores.stored(spark, f"{folder}/out", rows.schema))


def appended(rows: DataFrame) -> DataFrame:
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    streaming.start(rows, streaming.append_batches(f"{folder}/out"), f"{folder}/checkpoint")
    return unzoned(stores.stored(spark, f"{folder}/out", rows.schema))


@query
def st1_stream_reservoir(spark, sf_dir):
    rows = streaming.reservoir(stream(spark, sf_dir, "documents"), "lang", "doc_id", 50)
    return settled(rows, ["group"]).select("group", F.size("kept").cast("long").alias("n"), "seen")


@query
def st1_stream_slots(spark, sf_dir):
    """The documents that a buffer of 100 over all languages keeps, no language under 10 of them that had so many."""
    folder = shared_folder(spark)
    rows = stateful.reservoir(stream(spark, sf_dir, "documents"), "lang", "doc_id", 100, floor=10)
    stateful.start(rows, stores.upsert_batches(f"{folder}/out", ["shard", "slot"], buckets=4), f"{folder}/checkpoint")
    return stores.stored(spark, f"{folder}/out", rows.schema).filter("slot >= 0").select("slot", F.col("key").alias("doc_id"), F.col("kind").alias("lang"))


@query
def st6_stream_alerts(spark, sf_dir):
    """Devices whose events had values over 20 for six hours on end, up to a day before the last event."""
    folder = shared_folder(spark)
    events = stream(spark, sf_dir, "events").withColumn("device", F.col("user_id") % 20)
    rows = stateful.held_alerts(events, F.col("value") > 20, "6 hours", ["device"], late="1 day")
    stateful.start(rows, stores.upsert_batches(f"{folder}/out", ["device", "start"], buckets=4), f"{folder}/checkpoint")
    return unzoned(stores.stored(spark, f"{folder}/out", rows.schema))


@query
def st2_stream_patterns(spark, sf_dir):
    e = stream(spark, sf_dir, "events").select(F.col("event_type").alias("raw_text"), F.col("props").alias("corrected_text"), F.col("ts").alias("created_at"))
    return settled(streaming.pattern_counts(e), ["pattern", "correction"])


@query
def st3_stream_rates(spark, sf_dir):
    out = streaming.rates(stream(spark, sf_dir, "events"), error=F.col("event_type") == "error", width="1 day", slide="12 hours", late="60 days")
    return settled(out, ["start"])


@query
def st5_stream_averages(spark, sf_dir):
    out = streaming.averages(stream(spark, sf_dir, "events"), "value", by=("event_type",), width="1 day", late="60 days")
    return settled(out, ["event_type", "start"]).select("event_type", "start", "n", F.round("mean", 9).alias("mean"))


@query
def st9_stream_once(spark, sf_dir):
    """Every event once, although the queue sends each of them twice."""
    e = stream(spark, sf_dir, "events").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2)))).drop("copy")
    return appended(streaming.once(e, "event_id", late="60 days")).select("event_id", "user_id")


@query
def st14_stream_over_limit(spark, sf_dir):
    out = streaming.over_limit(stream(spark, sf_dir, "events"), "user_id", 4, width="1 day", late="60 days")
    return settled(out, ["user_id", "start"])
