"""Splits, stratified and weighted samples, replay buffers: deterministic, by hashes of a key instead of a random stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(key: str, seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def uniform(key: str, seed: int = 42) -> Column:
    """A number in (0, 1) for each key."""
    return (F.pmod(hashed(key, seed), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def exact_split(rows: DataFrame, key: str, shares: dict[str, float | int], rest: str, *, order: Column | None = None) -> DataFrame:
    """rows with split: int(n * share) rows for each name (or as many as an integer says), the others rest. Ranks are found in parts of the hash range, or between quantiles of a numeric order, so no task sorts all rows (but rows of one order value meet)."""
    if order is None:
        keyed = rows.withColumn("_h", hashed(key)).withColumn("_p", F.shiftright("_h", 54))  # 1024 parts of a 64-bit hash
    else:
        keyed = rows.withColumn("_h", order)
        bounds = sorted(set(keyed.agg(F.percentile_approx("_h", [k / 256 for k in range(1, 256)], 10000)).first()[0] or []))

        def part(a: int, b: int) -> Column:
            """The number of bounds below the order, known to be from a to b, by halves; 0 for null."""
            m = (a + b) // 2
            return F.lit(a) if a == b else F.when(F.col("_h") > bounds[m], part(m + 1, b)).otherwise(part(a, m))

        keyed = keyed.withColumn("_p", part(0, len(bounds)))
    parts = keyed.groupBy("_p").agg(F.count("*").alias("_c"))
    offsets = parts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_o"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_h", key))).join(F.broadcast(offsets), "_p").withColumn("_r", F.col("_r") + F.col("_o"))
    name, bound = F.lit(rest), F.lit(0)
    out = F.when(F.lit(False), "")
    for split, share in shares.items():
        bound = bound + (F.lit(share) if isinstance(share, int) else F.floor(F.col("_n") * share))
        out = out.when(F.col("_r") <= bound, split)
    return ranked.withColumn("split", out.otherwise(name)).drop("_h", "_p", "_o", "_n", "_r")


def hold_out(rows: DataFrame, key: str, share: float = 0.1, least: int = 20) -> DataFrame:
    """A validation split only where there are more than so many rows, then of one row at least."""
    n = rows.count()
    size = max(1, int(n * share)) if n > least else 0
    return exact_split(rows, key, {"validation": size}, "train") if size else rows.withColumn("split", F.lit("train"))


def simple_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(hashed(key, seed), key).limit(n)


def first_ranks(rows: DataFrame, by: str, n: int, order: list[Column], deal: int = 64) -> DataFrame:
    """The first n rows of each class with their place _r (from 1): a class's rows are dealt over some tasks, and only the first n of each meet."""
    dealt = rows.withColumn("_d", F.pmod(F.monotonically_increasing_id(), F.lit(deal)))
    near = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_d").orderBy(*order))).filter(F.col("_r") <= n).drop("_d", "_r")
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_r") <= n)


def per_class(rows: DataFrame, by: str, n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each class."""
    return first_ranks(rows, by, n, order).drop("_r")


def stratified(rows: DataFrame, by: str, n: int, order: list[Column]) -> DataFrame:
    """Proportional to the classes in their order: min(int(n * share) + 1, size, what is left of n) of each."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("size"))
    total = F.sum("size").over(Window.partitionBy())
    wanted = sizes.withColumn("want", F.least(F.floor(F.lit(n) * F.col("size") / total) + 1, F.col("size")))
    before = F.coalesce(F.sum("want").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = wanted.select(by, F.greatest(F.least(F.col("want"), F.lit(n) - before), F.lit(0)).alias("_take"))
    return first_ranks(rows, by, n, order).join(wanted, by).filter(F.col("_r") <= F.col("_take")).drop("_r", "_take")


def at_ratios(rows: DataFrame, by: str, ratios: dict[str, float], n: int, key: str) -> DataFrame:
    """max(1, int(n * ratio)) rows of each class by hash, n altogether."""
    take = F.create_map(*(x for k, r in ratios.items() for x in (F.lit(k), F.lit(max(1, int(n * r))))))
    return first_ranks(rows, by, n, [hashed(key), F.col(key)]).filter(F.col("_r") <= F.coalesce(take[F.col(by)], F.lit(0))).orderBy("_r", by).limit(n).drop("_r")


def hard(before: Column, confidence: Column, threshold: float = 0.3) -> Column:
    """Whether an example is hard: by its error rate before, else by its confidence."""
    return F.when(before.isNotNull(), before > threshold).otherwise(confidence < 1 - threshold)


def improvement(before: Column, after: Column) -> Column:
    return before - after


def weighted_sample(rows: DataFrame, key: str, weight: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement with chances by weight, by the largest of log(u) / weight."""
    return rows.withColumn("_k", F.log(uniform(key, seed)) / weight).orderBy(F.desc("_k"), key).limit(n).drop("_k")


def miner(rows: DataFrame, text: str, capacity: int) -> DataFrame:
    """The most frequent error texts with their counts, so many at most: what a bounded miner keeps."""
    return rows.groupBy(text).agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), text).limit(capacity)


def miner_statistics(kept: DataFrame, text: str, capacity: int, threshold: float) -> DataFrame:
    """One row: rows that the miner holds, distinct errors, the ten most frequent with their counts, and its settings."""
    each = kept.groupBy(text).agg(F.count("*").alias("frequency"))
    top = each.orderBy(F.desc("frequency"), text).limit(10).agg(F.sort_array(F.collect_list(F.struct((-F.col("frequency")).alias("r"), F.col(text).alias("error")))).alias("t"))
    return each.agg(F.sum("frequency").alias("total_hard"), F.count("*").alias("unique_errors")).join(F.broadcast(top)).select("total_hard", "unique_errors", F.transform("t", lambda t: F.struct(t["error"].alias("error"), (-t["r"]).alias("frequency"))).alias("top_errors"), F.lit(capacity).alias("capacity"), F.lit(threshold).alias("threshold"))


def victims(buffer: DataFrame, by: str, key: str, incoming: str, seed: int = 42) -> DataFrame:
    """The row that goes when one of class incoming comes into a full buffer: of the largest other class (the least name of equals) the first by hash."""
    largest = buffer.filter(F.col(by) != incoming).groupBy(by).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), by).limit(1).select(by)
    return buffer.join(F.broadcast(largest), by, "left_semi").orderBy(hashed(key, seed), key).limit(1)


def class_sample(rows: DataFrame, script: str, key: str, n: int, kind: str, seed: int = 42) -> DataFrame:
    """n rows of one script class, by hash."""
    return simple_sample(rows.filter(F.col(script) == kind), key, n, seed)


def class_floor_reservoir(rows: DataFrame, by: str, key: str, capacity: int, floor: int, seed: int = 42) -> DataFrame:
    """A bounded sample: the first ``floor`` rows by hash of every class, filled up with the first of all others. The same counts as a reservoir with a class floor, for whole tables."""
    return first_ranks(rows, by, capacity, [hashed(key, seed), F.col(key)]).orderBy((F.col("_r") > floor).cast("int"), hashed(key, seed), key).limit(capacity).drop("_r")


def round_robin(rows: DataFrame, cluster: str, n: int, order: list[Column]) -> DataFrame:
    """One row of each cluster in turn, in the given order within clusters."""
    return first_ranks(rows, cluster, n, order).orderBy("_r", cluster).limit(n).drop("_r")


def mixed_batch(parts: list[DataFrame], key: str, n: int) -> DataFrame:
    """The union of several strategies' samples, each row once under its first strategy, n altogether."""
    every = None
    for k, part in enumerate(parts):
        part = part.withColumn("_s", F.lit(k))
        every = part if every is None else every.unionByName(part)
    return every.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_s"))).filter("_r = 1").orderBy("_s", key).limit(n).drop("_r", "_s")


def with_replay(new: DataFrame, replay: DataFrame, key: str, *, exclude_new: bool = True) -> DataFrame:
    return new.unionByName(replay.join(new.select(key), key, "left_anti").select(*new.columns) if exclude_new else replay.select(*new.columns))


def text_features(text: Column, medical: Column, script: Column) -> Column:
    """Nine features: length, words by length, distinct characters, a medical flag, and the script."""
    n = F.greatest(F.length(text), F.lit(1))
    chars = F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))
    count = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    scripts = ("arabic", "latin", "mixed", "numeric", "unknown")
    return F.array(F.least(F.length(text) / 50.0, F.lit(1.0)), count / n, chars / n, medical.cast("double"), *((script == s).cast("double") for s in scripts))
