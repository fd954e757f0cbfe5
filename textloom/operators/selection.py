"""Values at given places of a sorted column, without sorting it: bounds from a sketch, exact counts, and only what lies between.

A sketch of every group (merged from all tasks') bounds each place by two values of the column, some 4 / ``ACCURACY`` of its rows
apart whatever their distribution. Then one pass counts exactly what lies below each bound, and how often each value between them
stands; these few are summed up in order. Should a sketch have missed, the group's place is looked for among all its values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.fuzzy import small
from textloom.sources.shared import shared_folder

ACCURACY = 10_000


def as_number(rows: DataFrame, column: str) -> Column:
    """A column as numbers in the same order: times as microseconds."""
    kind = rows.schema[column].dataType.typeName()
    return F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith("timestamp") else F.col(column)


def _written(rows: DataFrame) -> DataFrame:
    """A table of a row for each group (and place), written so that what it took isn't done again by everything that reads it."""
    path = f"{shared_folder(rows.sparkSession)}/places"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def places(rows: DataFrame, by: list[str], x: Column, ranks: dict[str, tuple[float, Callable[[Column], Column]]], also: dict[str, Column] | None = None) -> DataFrame:
    """(by, name, n, value, inside) for every group and rank: the value of x at the rank from 0, and how many of the rows that have this value stand before it.

    ranks: by name a share of the rows where the place about is, and the exact place as a function of their number. Missing values
    don't count. also: further aggregates of the groups' rows, over x as _x.
    """
    held = rows.select(*by, x.alias("_x")).filter("_x is not null")
    near = [min(max(p + e, 0.0), 1.0) for p, _ in ranks.values() for e in (-2 / ACCURACY, 2 / ACCURACY)]
    more = [c.alias(name) for name, c in (also or {}).items()]
    sketch = held.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_x", near, ACCURACY).alias("_b"), *more)
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("long").alias("rank"), F.get("_b", F.lit(2 * k)).alias("low"), F.get("_b", F.lit(2 * k + 1)).alias("high")) for k, (name, (_, f)) in enumerate(ranks.items())))
    groups = _written(sketch.withColumn("_w", wanted).drop("_b"))
    asked = groups.select(*by, "n", "_w")
    found = _written(_settle(held, by, asked))
    missed = found.filter("value is null").select(*by, "name")
    if not missed.isEmpty():
        # bounds that a sketch has missed: every value counts
        none = F.lit(None).cast(held.schema["_x"].dataType)
        open_ = F.transform("_w", lambda w: F.struct(w["name"].alias("name"), w["rank"].alias("rank"), none.alias("low"), none.alias("high")))
        again = _settle(held, by, asked.withColumn("_w", open_)).join(missed, [*by, "name"], "left_semi")
        found = found.filter("value is not null").unionByName(again)
    return found.join(groups.drop("n", "_w"), by) if also else found


def _settle(held: DataFrame, by: list[str], asked: DataFrame) -> DataFrame:
    """What is asked for, of the rows; asked is a written table, which Spark broadcasts if its files are small enough."""
    low, high = lambda w: w["low"].isNotNull() & (F.col("_x") < w["low"]), lambda w: w["high"].isNotNull() & (F.col("_x") > w["high"])
    told = F.filter(F.transform("_w", lambda w: F.when(~high(w), F.struct(w["name"].alias("name"), w["rank"].alias("rank"), F.when(~low(w), F.col("_x")).alias("value")))), lambda t: t.isNotNull())
    keyed = held.join(asked, by).select(*by, "n", F.explode(told).alias("t")).select(*by, "n", "t.*")
    sums = keyed.groupBy(*by, "n", "name", "rank", "value").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "name").orderBy(F.col("value").asc_nulls_first()))
    at = sums.withColumn("before", upto - F.col("c"))
    # the value whose run of equal rows holds the place; none where it lies outside the bounds
    own = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")) & F.col("value").isNotNull()
    best = at.groupBy(*by, "n", "name", "rank").agg(F.max(F.when(own, F.struct("value", "before"))).alias("b"))
    return best.select(*by, "n", "name", F.col("b.value").alias("value"), (F.col("rank") - F.col("b.before")).alias("inside"))


def thresholds(rows: DataFrame, by: list[str], order: list[str], ranks: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """(by, n, a struct for each name): the values of all order columns (as numbers) at each rank; among equal first values the others decide."""
    held = rows.select(*by, *(as_number(rows, c).alias(f"_o{k}") for k, c in enumerate(order))).filter("_o0 is not null")
    at = places(held, by, F.col("_o0"), ranks).select(*by, F.col("name").alias("_name"), "n", F.col("value").alias("_t0"), "inside")
    group = [*by, "_name"]
    for k in range(1, len(order)):
        ties = held.join(small(at.drop("n", "inside")), by).filter(" and ".join(f"_o{j} = _t{j}" for j in range(k))).select(*group, F.col(f"_o{k}").alias("_x"))
        # the place among equal values is what is asked for next, without bounds
        none = F.lit(None).cast(held.schema[f"_o{k}"].dataType)
        asked = at.select(*group, "n", F.array(F.struct(F.lit("place").alias("name"), F.col("inside").alias("rank"), none.alias("low"), none.alias("high"))).alias("_w"))
        at = at.drop("inside").join(_settle(ties, group, asked).select(*group, F.col("value").alias(f"_t{k}"), "inside"), group)
    own = F.struct(*(F.col(f"_t{k}").alias(f"_o{k}") for k in range(len(order))))
    return _written(at.groupBy(*by, "n").agg(*(F.max(F.when(F.col("_name") == name, own)).alias(name) for name in ranks)))
