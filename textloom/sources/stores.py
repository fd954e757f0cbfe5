"""Tables that are kept up to date: upserts into buckets of keys, and syncs that go on from a stored mark.

Both are safe to repeat: a batch or a sync that was cut off, or is sent again, leaves what one alone would have left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new store. Each should hold what a task can; a store keeps the number that it began with.
BUCKETS = 64
_BUCKET, _BATCH = "bucket", "batch"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def newest(*columns: str) -> dict[str, Callable[[Column], Column]]:
    """For ``upsert``: the row of the newest batch replaces what its key had."""
    return {c: lambda x: F.max_by(x, _BATCH) for c in columns}


def upsert(rows: DataFrame, number: int, path: str, keys: list[str], merge: dict[str, Callable[[Column], Column]], *, buckets: int = BUCKETS) -> None:
    """Merge batch ``number`` of rows into the table below path, which has one row for each value of the keys.

    merge tells for each other column how its values come together (sum, max ...), in the batch and with what is stored. Rows lie in
    buckets of a hash of their keys, and only buckets that the batch touches are read and written anew (by dynamic partition
    overwrite), so the table grows with its keys and not with its batches. Every row carries the batch that touched it last: a
    bucket that has seen this number, or a later one, is left as it is. Numbers must rise.
    """
    spark = rows.sparkSession
    together = lambda df: df.groupBy(_BUCKET, *keys).agg(*(f(F.col(c)).alias(c) for c, f in merge.items()), F.max(_BATCH).alias(_BATCH))
    dealt = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn(_BATCH, F.lit(number).cast("long"))
    new = together(dealt.select(_BUCKET, *keys, *merge, _BATCH))
    if _exists(spark, path):
        held = spark.read.schema(new.schema).parquet(path)
        done = {r[0] for r in held.groupBy(_BUCKET).agg(F.max(_BATCH).alias(_BATCH)).filter(F.col(_BATCH) >= number).collect()}  # numbers of buckets
        new = new.filter(~F.col(_BUCKET).isin(*done)) if done else new
        touched = [r[0] for r in new.select(_BUCKET).distinct().collect()]
        if not touched:
            return
        new = together(held.filter(F.col(_BUCKET).isin(*touched)).select(*new.columns).unionByName(new))
    # columns in the order of the schema that is read, the partition's last
    order = [*keys, *merge, _BATCH, _BUCKET]
    new.select(*order).repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path)


def stored(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The rows of an upserted table. A table that no batch has put a row into has no file to tell its schema: give it where that may be."""
    if schema is None:
        return spark.read.parquet(path).drop(_BUCKET, _BATCH)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def upsert_batches(path: str, keys: list[str], merge: dict[str, Callable[[Column], Column]] | None = None, *, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """``upsert`` for foreachBatch, under the batch's own number; without merge the newest row of a key replaces the one before."""

    def write(batch: DataFrame, number: int) -> None:
        how = merge or newest(*(c for c in batch.columns if c not in keys))
        upsert(batch, number, path, keys, how, buckets=buckets)

    return write


def sync(rows: DataFrame, path: str, *, at: str = "updated_at", key: str = "id", overlap: str = "0 seconds") -> DataFrame:
    """Write what is new in rows since the last sync below path/out, and return it.

    The mark is the newest (time, key) that was written; it is stored in path/mark only after its rows are. What comes late is not lost:
    rows from the mark's time on (or overlap before it) are looked at again, and those that were delivered are left out. A sync
    that ends before its mark is stored is done over and writes to the same place.
    """
    spark = rows.sparkSession
    marks = spark.read.parquet(f"{path}/mark") if _exists(spark, f"{path}/mark") else None
    last = marks.orderBy(F.desc("number")).first() if marks is not None else None
    number = last["number"] + 1 if last else 0
    new, mark_at = rows.filter(F.col(at).isNotNull()), F.lit(last["at"] if last else None).cast(rows.schema[at].dataType)
    if last:
        floor = mark_at - F.expr(f"interval {overlap}")
        sent = spark.read.parquet(f"{path}/out").filter((F.col("sync") < number) & (F.col(at) >= floor)).select(at, key)
        new = new.filter(F.col(at) >= floor).join(sent, [at, key], "left_anti").select(*rows.columns)
    new.withColumn("sync", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/part={number}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/out/part={number}")
    top = written.agg(F.max(F.struct(F.col(at).alias("at"), F.col(key).alias("key"))).alias("m")).filter("m is not null")
    mark = top.select(F.lit(number).alias("number"), F.greatest(F.col("m.at"), mark_at).alias("at"), F.col("m.key").alias("key"))
    if not mark.isEmpty():
        mark.coalesce(1).write.mode("overwrite").parquet(f"{path}/mark/m={number}")
    return written
