"""Log and metric analytics over whole tables; textloom.streaming has the streaming forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import selection

RETENTION, MOST = "7 days", 5000


def level(error: Column, status: Column) -> Column:
    return F.when(error.isNotNull(), "error").when(status >= 400, "warn").otherwise("debug")


def search(logs: DataFrame, *, level: str | None = None, category: str | None = None, since=None, until=None, needle: str | None = None, limit: int = 500) -> DataFrame:
    """Newest first; the needle is looked for in the message or the details, whatever its case, and missing details hold nothing."""
    out = logs
    for column, value in (("level", level), ("category", category)):
        out = out.filter(F.col(column) == value) if value is not None else out
    out = out.filter(F.col("ts") >= F.lit(since)) if since is not None else out
    out = out.filter(F.col("ts") <= F.lit(until)) if until is not None else out
    if needle:
        held = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower())) for c in ("message", "details")]
        out = out.filter(held[0] | held[1])
    return out.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def retained(logs: DataFrame, now: Column, most: int = MOST) -> DataFrame:
    return logs.filter(F.col("ts") > now - F.expr(f"interval {RETENTION}")).orderBy(F.desc("ts"), F.desc("id")).limit(most)


def to_upload(logs: DataFrame, *, immediate: bool, batch: int = 50) -> DataFrame:
    return logs.filter(F.col("level").isin("error", "fatal")) if immediate else logs.orderBy(F.desc("ts"), F.desc("id")).limit(batch)


def stats(logs: DataFrame) -> DataFrame:
    """(kind, name, logs): counts by level and by category, the total and the distinct sessions."""
    one = lambda kind, by: logs.groupBy(F.lit(kind).alias("kind"), F.col(by).alias("name")).agg(F.count("*").alias("logs"))
    total = logs.agg(F.count("*").alias("a"), F.count_distinct("session_id").alias("b")).select(F.explode(F.array(F.struct(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("a").alias("logs")), F.struct(F.lit("sessions").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("b").alias("logs")))).alias("x")).select("x.*")
    return one("level", "level").union(one("category", "category")).union(total)


def top_errors(logs: DataFrame, most: int = 10) -> DataFrame:
    return logs.filter("level in ('error', 'fatal')").groupBy("message", "category").agg(F.count("*").alias("n"), F.max("ts").alias("last")).orderBy(F.desc("n"), "message", "category").limit(most)


def health(logs: DataFrame) -> DataFrame:
    """Totals, devices, sessions, and the share of sessions that hold a fatal entry, in percent."""
    crashed = F.count_distinct(F.when(F.col("level") == "fatal", F.col("session_id")))
    return logs.agg(F.count("*").alias("total"), F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"), F.count_if(F.col("level") == "fatal").alias("fatal"), F.count_distinct("device_id").alias("devices"), F.count_distinct("session_id").alias("sessions"), F.round(100 * crashed / F.count_distinct("session_id"), 4).alias("crash_percent"))


def latency(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and the values at index int(n * p) of the sorted ones, which is no interpolated percentile. Missing values don't count."""
    shares = (0.5, 0.95, 0.99)
    ranks = {f"p{int(100 * p)}": (p, lambda n, p=p: F.least(F.floor(n * p), n - 1)) for p in shares}
    at = selection.places(rows, by, F.col(value), ranks, {"mean": F.round(F.avg("_x"), 9)})
    return at.groupBy(*by, "n", "mean").agg(*(F.max(F.when(F.col("name") == p, F.col("value"))).alias(p) for p in ranks))


def degradation(rows: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """Mean of the last quarter over that of the first, by places n // 4 and 3n // 4. Rows without a value of the first order column don't count."""
    edges = selection.thresholds(rows, by, order, {"_first": (0.25, lambda n: F.expr("n div 4")), "_last": (0.75, lambda n: F.expr("3 * n div 4"))})
    own = F.struct(*(selection.as_number(rows, c).alias(f"_o{k}") for k, c in enumerate(order)))
    keyed = rows.filter(F.col(order[0]).isNotNull()).withColumn("_own", own).join(edges, by)
    early, late = F.avg(F.when(F.col("_own") < F.col("_first"), F.col(value))), F.avg(F.when(F.col("_own") >= F.col("_last"), F.col(value)))
    return keyed.groupBy(*by).agg(F.round(early, 9).alias("early"), F.round(late, 9).alias("late"), F.round(late / early, 9).alias("ratio"))


def windowed_rates(rows: DataFrame, *, width: str = "5 minutes", slide: str = "30 seconds", by: list[str] = [], error: Column) -> DataFrame:  # noqa: B006
    """Events a second and the share of errors in sliding windows."""
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    out = rows.groupBy(F.window("ts", width, slide), *by).agg(F.count("*").alias("events"), F.count_if(error).alias("errors"))
    return out.select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "events", "errors", F.round(F.col("events") / seconds, 9).alias("rate"), F.round(F.col("errors") / F.col("events"), 9).alias("error_ratio"))


def bucket_counts(rows: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """Cumulative histogram rows (le, n) as a metrics endpoint exposes them; the last bound is infinity."""
    edges = [*bounds, float("inf")]
    counts = rows.groupBy(*by).agg(*(F.count_if(F.col(value) <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(edges)))
    return counts.select(*by, F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(edges)))).alias("x")).select(*by, "x.le", "x.n")


def histogram_quantile(buckets: DataFrame, share: float, by: list[str]) -> DataFrame:
    """The quantile by linear interpolation within the bucket that holds it; in the last one, the bound below it."""
    rows = F.sort_array(F.collect_list(F.struct("le", "n")))  # as many as there are bounds
    grouped = buckets.groupBy(*by).agg(rows.alias("b")).withColumn("target", F.element_at("b", -1)["n"] * share)
    i = F.array_position(F.transform("b", lambda x: x["n"] >= F.col("target")), True).cast("int")
    grouped = grouped.withColumn("i", i)
    low = F.when(F.col("i") > 1, F.get("b", F.col("i") - 2)["le"]).otherwise(0.0)
    before = F.when(F.col("i") > 1, F.get("b", F.col("i") - 2)["n"]).otherwise(0)
    own = F.get("b", F.col("i") - 1)
    inside = low + (own["le"] - low) * (F.col("target") - before) / F.nullif(own["n"] - before, F.lit(0))
    return grouped.select(*by, F.when(F.element_at("b", -1)["n"] == 0, None).when(F.col("i") == F.size("b"), low).otherwise(inside).alias("quantile"))


def held_alerts(rows: DataFrame, firing: Column, hold: str, by: list[str]) -> DataFrame:
    """Runs of consecutive true evaluations (by ts) that lasted at least hold: start, end, evaluations."""
    order = Window.partitionBy(*by).orderBy("ts")
    marked = rows.withColumn("on", firing).withColumn("run", F.sum((F.coalesce(F.lag("on").over(order), ~F.col("on")) != F.col("on")).cast("int")).over(order))
    runs = marked.filter("on").groupBy(*by, "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("evaluations"))
    return runs.filter(F.col("end") - F.col("start") >= F.expr(f"interval {hold}")).drop("run")


def increases(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """What a counter grew over each series; a drop is a restart and counts from zero."""
    order = Window.partitionBy(*by).orderBy("ts")
    step = F.col(value) - F.lag(value).over(order)
    return rows.withColumn("step", F.when(step < 0, F.col(value)).otherwise(step)).groupBy(*by).agg(F.round(F.sum("step"), 6).alias("increase"))


def over_limit(rows: DataFrame, by: str, limit: int, width: str = "1 minute") -> DataFrame:
    """Fixed windows in which a client sent more than its limit."""
    return rows.groupBy(F.window("ts", width), by).agg(F.count("*").alias("requests")).filter(F.col("requests") > limit).select(by, F.col("window.start").alias("start"), "requests")


def sessions(rows: DataFrame, gap: str, by: str) -> DataFrame:
    out = rows.groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    return out.select(by, F.col("session_window.start").alias("start"), "last", "events", (F.unix_timestamp("last") - F.unix_timestamp(F.col("session_window.start"))).alias("seconds"))


def daily(rows: DataFrame, *columns: Column) -> DataFrame:
    return rows.groupBy(F.to_date("ts").alias("date")).agg(*columns)


def humanize(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%dms", ms.cast("long"))).when(ms < 60000, F.format_string("%.1fs", ms / 1000.0)).otherwise(F.format_string("%.1fm", ms / 60000.0))


def component_health(rows: DataFrame) -> DataFrame:
    """(system, status): healthy if all components (system, component, ok) are."""
    return rows.groupBy("system").agg(F.when(F.bool_and("ok"), "healthy").otherwise("degraded").alias("status"))


def sync_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("device_id", "direction").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
