"""Model versions: comparison, gates, and the fold of their events."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the gates.
MIN_IMPROVEMENT, MAX_REGRESSION = 0.005, 0.02


def improvements(runs: DataFrame, *, at: str = "at", cer: str = "cer", samples: str = "samples") -> DataFrame:
    """Training runs in order with the error rate before (1 for the first), the gain, whether it deploys, and the samples so far.

    The history of one model is a few rows; pass the model's column as ``model`` to keep histories apart.
    """
    order = Window.partitionBy("model").orderBy(at)
    before = F.lag(cer, 1, 1.0).over(order)
    gain = F.round(before - F.col(cer), 9)
    return runs.select("*", before.alias("cer_before"), gain.alias("gain"), (gain >= MIN_IMPROVEMENT).alias("deploys"), F.sum(samples).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("total_samples"))


def promotions(events: DataFrame) -> DataFrame:
    """The fold of each model's events (model, at, version, action, cer) in order: promote (rejected if its error rate is more than the gate over the active one's), activate, rollback to a version, delete (not the active one).

    One active version at most. A gate depends on what was active just then, so the fold runs over each model's history. Rows are dealt by
    model and sorted (a sort may spill), and a task reads them batch by batch, whatever the number of models and the length of a history: it holds the known versions of one model at a time.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, active, known = object(), None, {}
        rated = lambda version: known.get(version) is not None and not math.isnan(known[version])
        for batch in batches:
            accepted, actives = [], []
            for model, version, action, cer in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if model != group:
                    group, active, known = model, None, {}
                ok = True
                if action == "register":
                    ok = version not in known
                    if ok:
                        known[version] = cer
                elif action == "promote":
                    gate = active is not None and rated(active) and rated(version)
                    ok = version in known and not (gate and known[version] - known[active] > MAX_REGRESSION)
                    active = version if ok else active
                elif action in ("activate", "rollback"):
                    ok = version in known
                    active = version if ok else active
                elif action == "delete":
                    ok = version in known and version != active
                    if ok:
                        del known[version]
                accepted.append(ok)
                actives.append(active)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(accepted, pa.bool_()), pa.array(actives, pa.string())], names=["model", "at", "version", "action", "accepted", "active"])

    rows = events.select(F.col("model").cast("string").alias("model"), F.col("at").cast("timestamp").alias("at"), F.col("version").cast("string").alias("version"), F.col("action").cast("string").alias("action"), F.col("cer").cast("double").alias("cer"))
    dealt = rows.repartition("model").sortWithinPartitions("model", F.asc_nulls_last("at"), F.asc_nulls_last("version"), "action", "cer")
    return dealt.mapInArrow(fold, "model string, at timestamp, version string, action string, accepted boolean, active string")


def active(versions: DataFrame) -> DataFrame:
    return versions.filter("is_active").groupBy("model").agg(F.max_by(F.struct("version", "cer"), "at").alias("a")).select("model", "a.*")


def history(versions: DataFrame, most: int = 20) -> DataFrame:
    return versions.orderBy(F.desc("at"), "version").limit(most)


def archive_excess(versions: DataFrame, keep: int = 5) -> DataFrame:
    """The versions beyond the newest few of each model, by name."""
    return versions.withColumn("_r", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("version")))).filter(F.col("_r") > keep).drop("_r")


def version_ids(versions: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("model").orderBy("at"))
    return versions.withColumn("version_id", F.format_string("v%03d_%s", n, F.date_format("at", "yyyyMMdd_HHmmss")))


def new_versions(offered: DataFrame, known: DataFrame) -> DataFrame:
    """Offered versions whose name is not taken."""
    return offered.join(known.select("version_name").distinct(), "version_name", "left_anti")


def compare(versions: DataFrame) -> DataFrame:
    """Best, worst and mean of the error rates (least is best) and the accuracy (most is best), with the best one's version."""
    parts = []
    for name, best, worst, by in (("cer", F.min, F.max, F.min_by), ("wer", F.min, F.max, F.min_by), ("accuracy", F.max, F.min, F.max_by)):
        parts.append(versions.agg(F.lit(name).alias("metric"), best(name).alias("best"), worst(name).alias("worst"), F.round(F.avg(name), 6).alias("mean"), by("version", F.struct(name, "version")).alias("best_version")))
    return parts[0].union(parts[1]).union(parts[2])


def summary(versions: DataFrame) -> DataFrame:
    return versions.agg(F.count("*").alias("versions"), F.count_if("is_active").alias("active"), F.min("cer").alias("best_cer"))


def readiness(samples: DataFrame, least: int = 50) -> DataFrame:
    """(model, files, samples, ready) from (model, file)."""
    found = samples.groupBy("model").agg(F.count_distinct("file").alias("files"), F.count("*").alias("samples"))
    return found.withColumn("ready", (F.col("files") >= 1) & (F.col("samples") >= least))


def transitions(changes: DataFrame) -> DataFrame:
    """Changes (region_id, at, corrected_text) at which a text appears: the change, and the count so far."""
    order = Window.partitionBy("region_id").orderBy("at")
    new = F.lag("corrected_text").over(order).isNull() & F.col("corrected_text").isNotNull()
    marked = changes.withColumn("new", new)
    return marked.withColumn("correction_count", F.count_if("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("new").drop("new")


def sorted_by(rows: DataFrame, column: str, *, descending: bool = False, key: str = "version") -> DataFrame:
    """rows in the order of a chosen column, missing values last, ties by key."""
    if column not in rows.columns:
        raise ValueError(f"there is no column {column}")
    order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return rows.orderBy(order, key)


def percent(share, digits: int = 1):
    """A share as text, such as 93.2%."""
    return F.format_string(f"%.{digits}f%%", share * 100)
