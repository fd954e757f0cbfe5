"""Semantic chunks: a text is parted where its vocabulary changes, by lexical cohesion between windows of sentences.

For each gap between two sentences the content words of the ``window`` sentences before and after it are compared (Dice's coefficient of
the sets). A gap is a valley if its neighbours' cohesion is no less, and its depth is how far it lies below the highest cohesion within
``reach`` gaps on either side, both added. Valleys of at least ``depth`` part the text. All of it is built-in functions of one row: no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a content word at least.
CONTENT = 4


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?؟])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def content_words(sentence: Column) -> Column:
    """The distinct words of a sentence that are long enough to tell what it is about."""
    return F.array_distinct(F.filter(F.split(F.lower(sentence), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= CONTENT))


def beside(padded: Column, n: Column, count: int) -> Column:
    """For each of n places an array's elements from there on, as a struct of so many: by shifted copies that are zipped, so that long arrays take time in proportion."""
    return F.arrays_zip(*(F.slice(padded, k + 1, n) for k in range(count)))


def cohesion(padded: Column, n: Column, window: int) -> Column:
    """For each of n gaps between neighbouring sentences (arrays of words, with window - 1 empty ones before and behind) the likeness of the windows around it, from 0 to 1."""

    def likeness(near: Column) -> Column:
        before, after = (F.array_distinct(F.concat(*(near[str(k)] for k in ks))) for ks in (range(window), range(window, 2 * window)))
        return F.coalesce(F.round(2 * F.size(F.array_intersect(before, after)) / F.nullif(F.size(before) + F.size(after), F.lit(0)), 6), F.lit(0.0))

    return F.transform(beside(padded, n, 2 * window), likeness)


def valleys(padded: Column, n: Column, reach: int, depth: float) -> Column:
    """The gaps (counted from 1) at which a text is parted, from n scores with reach nulls before and behind."""

    def deep(near: Column, i: Column) -> Column:
        at = [near[str(k)] for k in range(2 * reach + 1)]
        s, before, after = at[reach], F.coalesce(at[reach - 1], F.lit(2.0)), F.coalesce(at[reach + 1], F.lit(2.0))
        low = F.round(F.greatest(*at[: reach + 1]) + F.greatest(*at[reach:]) - 2 * s, 6) >= depth
        return F.when((s < before) & (s <= after) & low, i + 1)

    return F.filter(F.transform(beside(padded, n, 2 * reach + 1), deep), lambda g: g.isNotNull())


def semantic_chunks(docs: DataFrame, *, text: str = "text", window: int = 3, reach: int = 5, depth: float = 0.2) -> DataFrame:
    """docs with (chunk, chunk_text): the sentences of a text that belong together. Null and blank texts have none.

    Each step is a column of its own and is named several times where it is read, so that none is computed anew for every sentence.
    """
    around = lambda none, n, xs: F.concat(F.array_repeat(none, n), xs, F.array_repeat(none, n))
    rows = docs.withColumn("_s", sentences(F.col(text))).filter("size(_s) > 0").withColumn("_n", F.size("_s") - 1)
    rows = rows.withColumn("_w", around(F.array().cast("array<string>"), window - 1, F.transform("_s", content_words)))
    rows = rows.withColumn("_c", around(F.lit(None).cast("double"), reach, cohesion(F.col("_w"), F.col("_n"), window)))
    rows = rows.withColumn("_edges", F.concat(F.array(F.lit(0)), valleys(F.col("_c"), F.col("_n"), reach, depth), F.array(F.size("_s"))))
    parts = F.zip_with(F.slice("_edges", F.lit(1), F.size("_edges") - 1), F.slice("_edges", F.lit(2), F.size("_edges") - 1), lambda a, b: F.array_join(F.slice("_s", a + 1, b - a), " "))
    return rows.select(*docs.columns, F.posexplode(parts).alias("chunk", "chunk_text"))
