"""Votes of several recognition engines on one region, and boxes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.similarity import indel


def vote(rows: list[tuple[str, str, float]], ratio: float = 70.0) -> tuple[str | None, str | None, float | None, int]:
    """(text, engine, confidence, votes) of (engine, text, confidence) in order: texts similar to any member of a group join it; most votes win, then the highest confidence, then the first."""
    groups: list[list[tuple[str, str, float]]] = []
    for row in rows:
        if not (row[1] or "").strip():
            continue
        home = next((g for g in groups if any(indel(row[1], m[1]) > ratio for m in g)), None)
        if home is None:
            groups.append([row])
        else:
            home.append(row)
    if not groups:
        return None, None, None, 0
    best = max(groups, key=lambda g: (len(g), max(m[2] or 0.0 for m in g)))
    return best[0][1], best[0][0], max(m[2] or 0.0 for m in best), len(best)


def ensemble_vote(readings: DataFrame, *, region: str = "region_id", order: str = "ordinal") -> DataFrame:
    """One row for each region of (region, order, engine, text, confidence): the text its engines agree on. A region has as many rows as there are engines."""
    grouped = readings.groupBy(region).agg(F.sort_array(F.collect_list(F.struct(order, "engine", "text", F.col("confidence").cast("double").alias("confidence")))).alias("r"))
    kind = dict(readings.dtypes)[region]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            won = [vote([(x["engine"], x["text"], x["confidence"]) for x in rows]) for rows in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([w[i] for w in won], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.int32())))], names=[region, "text", "engine", "confidence", "votes"])

    return grouped.mapInArrow(run, f"`{region}` {kind}, text string, engine string, confidence double, votes int")


def exact_vote(readings: DataFrame, *, region: str = "region_id", order: str = "ordinal") -> DataFrame:
    """The vote where only equal texts agree; native."""
    groups = readings.filter(F.trim("text") != "").groupBy(region, "text").agg(F.count("*").alias("votes"), F.max("confidence").alias("confidence"), F.min_by("engine", order).alias("engine"), F.min(order).alias("first"))
    best = F.max_by(F.struct("text", "engine", "confidence", "votes"), F.struct("votes", "confidence", -F.col("first")))
    return groups.groupBy(region).agg(best.alias("b")).select(region, "b.*")


def polygon_box(points: Column) -> Column:
    """The box around a polygon given as an array of [x, y]."""
    edge = lambda f, k: f(F.transform(points, lambda p: p[k]))
    return F.struct(edge(F.array_min, 0).alias("x1"), edge(F.array_min, 1).alias("y1"), edge(F.array_max, 0).alias("x2"), edge(F.array_max, 1).alias("y2"))


def padded_box(box: Column, width: Column, height: Column, pad: int = 5) -> Column:
    """A box widened on all sides and cut at the image's edges."""
    return F.struct(F.greatest(box["x1"] - pad, F.lit(0)).alias("x1"), F.greatest(box["y1"] - pad, F.lit(0)).alias("y1"), F.least(box["x2"] + pad, width).alias("x2"), F.least(box["y2"] + pad, height).alias("y2"))


def legacy_columns(regions: DataFrame) -> DataFrame:
    return regions.select("bbox", "text", "confidence", "engine")


def reading_order(pages: DataFrame, page: str, regions: str) -> DataFrame:
    """(page, region_index, region) of an array of regions: the order of detection is the order of reading, and (page, region_index) is unique."""
    return pages.select(page, F.posexplode(regions).alias("region_index", "region"))
