"""Writers of the engine's outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_json(rows: DataFrame, path: str, split: str = "split") -> None:
    """Lines of JSON below split=NAME."""
    rows.write.mode("overwrite").partitionBy(split).json(path)


def daily_json(rows: DataFrame, path: str, at: str) -> None:
    """Appended below date=YYYY-MM-DD."""
    rows.withColumn("date", F.to_date(at)).write.mode("append").partitionBy("date").json(path)


def changed_only(rows: DataFrame, before: str = "raw_text", after: str = "corrected_text") -> DataFrame:
    return rows.filter(~F.col(before).eqNullSafe(F.col(after)))


def table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def feedback(rows: DataFrame, path: str, *, split: str = "split", image: str = "crop_base64") -> DataFrame:
    """Writes the training lines (image_path, text, raw_text, confidence, engines) of every split below path/SPLIT, without rows that have no image, and
    path/metadata with the summary that it returns: (split, saved, failed)."""
    has = F.coalesce(F.col(image), F.lit("")) != ""
    line = rows.filter(has).select(split, F.concat(F.lit(f"{path}/images/"), F.col("id"), F.lit(".png")).alias("image_path"), F.col("corrected_text").alias("text"), "raw_text", "confidence", F.map_keys("engines").alias("engines"))
    line.write.mode("overwrite").partitionBy(split).json(f"{path}/lines")
    rows.groupBy(split).agg(F.count_if(has).alias("saved"), F.count_if(~has).alias("failed")).write.mode("overwrite").json(f"{path}/metadata")
    return rows.sparkSession.read.schema(f"{split} string, saved long, failed long").json(f"{path}/metadata")


def append_corrections(rows: DataFrame, path: str, batch: int) -> None:
    """Adds a batch of corrections to the store below path; the same batch again replaces itself."""
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def merge_patterns(counts: DataFrame, new: DataFrame) -> DataFrame:
    """Pattern counts (pattern, correction, frequency, last_used) with those of new corrections added."""
    return counts.unionByName(new.select(*counts.columns)).groupBy("pattern", "correction").agg(F.sum("frequency").alias("frequency"), F.max("last_used").alias("last_used"))


def dictionary_envelope(learned: DataFrame, device: str, at: Column) -> DataFrame:
    """Rows (device, at, entries, total, wrong, correct, count) of an upload: one line for each entry, under the head that all share."""
    head = learned.agg(F.count("*").alias("entries"), F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    return learned.select("wrong", "correct", "count").join(F.broadcast(head)).select(F.lit(device).alias("device"), at.alias("at"), "entries", "total", "wrong", "correct", "count")


def save_learned(learned: DataFrame, path: str, *, entries: int = 10_000) -> None:
    """A line {wrong: {correct, count}} for about every so many entries of the table, in the format that the reader takes; what was there is replaced."""
    entry = F.struct("wrong", F.struct("correct", "count"))
    n = -(-learned.count() // entries) or 1
    parts = learned.groupBy(F.pmod(F.xxhash64("wrong"), F.lit(n)).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    parts.repartition(F.col("part")).write.mode("overwrite").partitionBy("part").text(path)


def due(last: Column, now: Column, seconds: int = 300) -> Column:
    """Whether an upload is due: never done, or so many seconds ago, both times to the nearest second (of two the even one)."""
    second = lambda at: F.rint(F.unix_micros(at.cast("timestamp")) / 1e6)
    return last.isNull() | (second(now) - second(last) >= seconds)


def csv_line(*columns: Column, quoted: Column) -> Column:
    """A line of comma-separated values, of which only one is quoted and has its quotes doubled."""
    return F.concat_ws(",", *columns, F.concat(F.lit('"'), F.replace(quoted, F.lit('"'), F.lit('""')), F.lit('"')))


def text_line(ts: Column, level: Column, category: Column, message: Column) -> Column:
    return F.format_string("[%s] [%s] [%s] %s", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.upper(level), category, message)


def manifest(files: DataFrame) -> DataFrame:
    """(path, length, md5) of binaryFile rows."""
    return files.select("path", "length", F.md5("content").alias("md5"))


def verify(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, state) of every file of a manifest (path, md5) or found: ok, changed, missing or extra."""
    found = manifest(files).select("path", F.col("md5").alias("own"))
    both = expected.select("path", "md5").join(found, "path", "full")
    return both.select("path", F.when(F.col("own").isNull(), "missing").when(F.col("md5").isNull(), "extra").when(F.col("own") == F.col("md5"), "ok").otherwise("changed").alias("state"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
