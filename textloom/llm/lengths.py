"""Token counts by an exact length histogram.

Documents are aggregated by their encoded length (in each task first, so a shuffled row stands for all of a task's documents of a
length). Running sums over the histogram then answer totals, quantiles and truncated totals for every context limit, without another
pass over the texts. The sums run in blocks of lengths, so that no task holds the whole histogram.

Null and empty texts have length 0. Repeated rows count each time. An empty table gives an empty histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import bpe, packed

#: Lengths in a block.
BLOCK = 256


def histogram(docs: DataFrame, *, text: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(length long, n_docs long) for every encoded length."""
    path = ranks_path or bpe.default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held = bpe.encoding(path).encode_ordinary, Counter()
        for batch in batches:
            held.update(len(encode(x.as_py() or "")) for x in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["length", "n_docs"])

    return docs.select(text).mapInArrow(run, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def answers(counts: DataFrame) -> DataFrame:
    """For every length as a context limit: documents of it, over it and up to it, tokens of those up to it, the total when all longer ones are truncated to it, and the share of documents up to it."""
    sums = {"docs": F.sum("n_docs"), "tokens": F.sum(F.col("length") * F.col("n_docs"))}
    blocks = counts.groupBy(F.floor(F.col("length") / BLOCK).alias("block")).agg(*(f.alias(c) for c, f in sums.items()))
    order = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}_before") for c in sums), F.sum("docs").over(Window.partitionBy()).alias("all_docs"))
    own = Window.partitionBy("block").orderBy("length")
    inside = counts.withColumn("block", F.floor(F.col("length") / BLOCK)).select("*", *(f.over(own).alias(f"{c}_inside") for c, f in sums.items()))
    upto = F.col("docs_before") + F.col("docs_inside")
    tokens = F.col("tokens_before") + F.col("tokens_inside")
    return inside.join(blocks, "block").select("length", "n_docs", (F.col("all_docs") - upto).alias("docs_over"), upto.alias("docs_upto"), tokens.alias("tokens_upto"), (tokens + F.col("length") * (F.col("all_docs") - upto)).alias("truncated_tokens"), (upto / F.col("all_docs")).alias("share_upto"))


def at_limits(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """The documents over each limit (limit long) and the total when they are truncated to it, from a histogram: a limit is a length that no further document has."""
    rows = counts.select("length", "n_docs", F.lit(False).alias("asked")).union(limits.select(F.col("limit").cast("long"), F.lit(0).cast("long"), F.lit(True)).distinct())
    held = rows.groupBy("length").agg(F.sum("n_docs").alias("n_docs"), F.max("asked").alias("asked"))
    asked = held.filter("asked").select("length")
    return answers(held.select("length", "n_docs")).join(asked, "length").select(F.col("length").alias("limit"), "docs_over", "truncated_tokens")


def quantile(answered: DataFrame, share: float) -> DataFrame:
    """The least length that so many of all documents don't exceed."""
    return answered.filter(F.col("share_upto") >= share).agg(F.min("length").alias("length"))


def query(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The answers for every length; the histogram is written first, so that texts are encoded once."""
    return answers(packed.table(histogram(docs), folder or packed.shared_folder(docs.sparkSession), "histogram"))
