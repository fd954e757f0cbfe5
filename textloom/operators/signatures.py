"""Candidates of fuzzy and containment joins by equi-joins on pieces of strings; no pair of all strings is made.

``near_pairs``: two strings of lengths m and n whose ratio 2 M / (m + n) reaches r have a common subsequence of L = ceil(r (m + n) / 2)
characters, so d = m + n - 2 L insertions and deletions at most tell them apart. Of d + 1 segments of one of them at least one stands
unchanged in the other: some i-th one with exactly i of those edits before it (let e(i) be the edits before segment i: the last i with
e(i) >= i has e(i + 1) <= i). So it is shifted by i, i - 2 ... -i places, and what is left of d covers the shift behind it. Each string
on the one side is exploded over its segments for every length of a partner, each on the other over the few places where they may stand.

``containing_pairs``: a string holds another only if it holds the other's rarest q-gram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram.
GRAM = 3


def _common(m: Column, n: Column, ratio: Column) -> Column:
    """Characters that strings of these lengths must have in common, in order."""
    return F.greatest(F.ceil((m + n) * ratio / 2 - F.lit(1e-6)).cast("int"), F.lit(1))


def _partners(m: Column, ratio: Column, slack: int | None) -> Column:
    """The lengths of strings that may reach the ratio with one of length m."""
    low, high = F.ceil(m * ratio / (2 - ratio) - F.lit(1e-6)).cast("int"), F.floor(m * (2 - ratio) / ratio + F.lit(1e-6)).cast("int")
    if slack is not None:
        low, high = F.greatest(low, m - slack), F.least(high, m + slack)
    low = F.greatest(low, F.lit(1))
    return F.when(low <= high, F.sequence(low, high))


def near_pairs(words: DataFrame, variants: DataFrame, *, ratios: Sequence[float], slack: int | None = None) -> DataFrame:
    """Pairs (word, ratio, variant) that hold all with an indel or matcher ratio of ``ratio`` or more (and lengths at most slack apart), and few others.

    words (word, ratio: one of ratios) and variants (variant) should be distinct; empty strings have no partner.
    """
    m, n, i, ratio = F.col("m"), F.col("n"), F.col("i"), F.col("ratio")
    room = m + n - 2 * _common(m, n, ratio)
    parts = F.least(room + 1, n)  # with fewer characters than edits, single characters: one at least is common
    start = F.floor(i * n / parts).cast("int")
    size = F.floor((i + 1) * n / parts).cast("int") - start
    # segments of the variants for each length of a word
    right = variants.select("variant", F.length("variant").alias("n"), F.explode(F.array(*(F.lit(float(r)) for r in ratios))).alias("ratio")).filter("n > 0")
    right = right.withColumn("m", F.explode(_partners(n, ratio, slack))).withColumn("i", F.explode(F.sequence(F.lit(0), parts - 1)))
    right = right.select("variant", "ratio", "m", "n", "i", F.substr("variant", start + 1, size).alias("piece"))
    # and where a word may hold them
    left = words.select("word", "ratio", F.length("word").alias("m")).filter("m > 0")
    left = left.withColumn("n", F.explode(_partners(m, ratio, slack))).withColumn("i", F.explode(F.sequence(F.lit(0), parts - 1)))
    exact = parts == room + 1
    shifts = F.when(exact, F.transform(F.sequence(F.lit(0), i), lambda k: 2 * k - i)).otherwise(F.sequence(_common(m, n, ratio) - n, m - _common(m, n, ratio)))
    shifts = F.filter(shifts, lambda x: (x + start >= 0) & (x + start + size <= m) & (~exact | (F.abs(m - n - x) <= room - i)))
    left = left.withColumn("shift", F.explode(shifts)).select("word", "ratio", "m", "n", "i", F.substr("word", start + F.col("shift") + 1, size).alias("piece")).distinct()
    return left.join(right, ["ratio", "m", "n", "i", "piece"]).select("word", "ratio", "variant").distinct()


def grams(x: Column, most: int = GRAM) -> Column:
    """The distinct grams of up to so many characters."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.length(x))), lambda k: F.transform(F.sequence(F.lit(1), F.length(x) - k + 1), lambda at: F.substr(x, at, k)))))


def _whole_grams(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(x) - (GRAM - 1)), lambda at: F.substr(x, at, F.lit(GRAM)))


def containing_pairs(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """All pairs (inner, outer) of distinct non-empty strings where the outer one holds the inner one, by the gram of the inner one that fewest outer ones hold."""
    index = outer.filter("outer <> ''").select("outer", F.explode(grams(F.col("outer"))).alias("gram"))
    frequency = index.filter(F.length("gram") == GRAM).groupBy("gram").agg(F.count("*").alias("held"))
    short = inner.filter((F.length("inner") > 0) & (F.length("inner") <= GRAM)).select("inner", F.col("inner").alias("gram"))
    long = inner.filter(F.length("inner") > GRAM).select("inner", F.explode(_whole_grams(F.col("inner"))).alias("gram"))
    rarest = long.join(frequency, "gram", "left").groupBy("inner").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("least"))
    keyed = rarest.filter("least.held > 0").select("inner", "least.gram").union(short.select("inner", "gram"))
    return keyed.join(index, "gram").filter(F.contains("outer", "inner")).select("inner", "outer")


def first_containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, best) for inner strings that an outer one holds: the least ``value`` of those that hold it. What is no longer than a gram is answered by the index alone."""
    index = outer.filter("outer <> ''").select("outer", "value", F.explode(grams(F.col("outer"))).alias("gram"))
    least = index.groupBy("gram").agg(F.min("value").alias("best"), F.count("*").alias("held"))
    short = inner.filter((F.length("inner") > 0) & (F.length("inner") <= GRAM)).join(least.select(F.col("gram").alias("inner"), "best"), "inner").select("inner", "best")
    long = inner.filter(F.length("inner") > GRAM).select("inner", F.explode(_whole_grams(F.col("inner"))).alias("gram"))
    rarest = long.join(least.select("gram", "held"), "gram", "left").groupBy("inner").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("least"))
    keyed = rarest.filter("least.held > 0").select("inner", "least.gram")
    found = keyed.join(index, "gram").filter(F.contains("outer", "inner")).groupBy("inner").agg(F.min("value").alias("best"))
    return short.union(found)

