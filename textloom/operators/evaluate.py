"""Error rates of recognised text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.normalize import words
from textloom.functions.similarity import token_distance


def error_rates(rows: DataFrame, *, reference: str = "reference", predicted: str = "predicted", medical: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Character and word error rates over the whole corpus (edits by reference length, not a mean of rates), share of exact rows, and of exact medical ones."""
    a, b = F.coalesce(reference, F.lit("")), F.coalesce(predicted, F.lit(""))
    ratio = lambda x, y: F.round(F.sum(x) / F.nullif(F.sum(y), F.lit(0)), 6)
    columns = [F.count("*").alias("texts"), ratio(F.levenshtein(a, b), F.length(a)).alias("cer"), ratio(token_distance(words(a), words(b)), F.size(words(a))).alias("wer"), F.round(F.avg((a == b).cast("int")), 6).alias("exact")]
    if medical:
        columns.append(F.round(F.avg(F.when(F.col(medical), (a == b).cast("int"))), 6).alias("medical"))
    return rows.groupBy(*(by or [])).agg(*columns)
