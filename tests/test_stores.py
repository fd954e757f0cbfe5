"""Upserts and syncs that are cut off, repeated and late; values at ranks of skewed columns."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom.operators import logs, selection
from textloom.plans import stream_queries
from textloom.sources import sinks, stores

MERGE = {"frequency": F.sum, "last_used": F.max}


def counts(spark, rows):
    return spark.createDataFrame(rows, "pattern string, correction string, frequency long, last_used int")


def table(spark, path):
    return {(r["pattern"], r["correction"]): (r["frequency"], r["last_used"]) for r in stores.stored(spark, path).collect()}


def files(path):
    return sorted(f"{p.parent.name}/{p.name}" for p in Path(path).glob("bucket=*/*.parquet"))


def batch(n, seed):
    random.seed(seed)
    return [(f"p{random.randrange(40)}", f"c{random.randrange(3)}", random.randrange(1, 5), seed) for _ in range(n)]


def test_upserts_add_up_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    path, want = str(tmp_path / "t"), {}
    for number in range(4):
        rows = batch(60, number)
        for p, c, n, at in rows:
            old = want.get((p, c), (0, -1))
            want[p, c] = (old[0] + n, max(old[1], at))
        for _ in range(2 if number in (1, 3) else 1):
            stores.upsert(counts(spark, rows), number, path, ["pattern", "correction"], MERGE, buckets=8)
    assert table(spark, path) == want
    before = files(path)
    stores.upsert(counts(spark, batch(60, 2)), 2, path, ["pattern", "correction"], MERGE, buckets=8)  # an earlier one again
    assert table(spark, path) == want and files(path) == before


def test_only_touched_buckets_are_rewritten_and_batches_leave_no_files(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert = lambda rows, k: stores.upsert(counts(spark, rows), k, path, ["pattern", "correction"], MERGE, buckets=16)
    upsert([(f"p{k}", "c", 1, 0) for k in range(200)], 0)
    first = files(path)
    for k in range(1, 6):
        upsert([("p7", "c", 1, k)], k)
    assert len(files(path)) == len(first) and len(set(files(path)) & set(first)) == len(first) - 1
    assert table(spark, path)["p7", "c"] == (6, 5)


def test_a_batch_that_was_cut_off_is_finished(spark, tmp_path):
    """Some buckets have the batch and some don't; the batch again reaches only those."""
    path, rows = str(tmp_path / "t"), [(f"p{k}", "c", 1, 1) for k in range(60)]
    stores.upsert(counts(spark, [(f"p{k}", "c", 1, 0) for k in range(60)]), 0, path, ["pattern", "correction"], MERGE, buckets=8)
    whole = counts(spark, rows).withColumn("b", F.pmod(F.xxhash64("pattern", "correction"), F.lit(8)))
    stores.upsert(whole.filter("b < 3").drop("b"), 1, path, ["pattern", "correction"], MERGE, buckets=8)
    stores.upsert(counts(spark, rows), 1, path, ["pattern", "correction"], MERGE, buckets=8)
    assert set(table(spark, path).values()) == {(2, 1)}


def test_streams_into_a_store_go_on_after_a_restart(spark, tmp_path):
    from textloom import streaming

    (tmp_path / "in").mkdir()
    schema = "pattern string, n long"
    start = lambda: streaming.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").groupBy("pattern").agg(F.sum("n").alias("n")), stores.upsert_batches(f"{tmp_path}/t", ["pattern"], buckets=4), f"{tmp_path}/c", mode="update")
    for k in range(2):
        spark.createDataFrame([("a", 1), (f"b{k}", 2)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    start()
    spark.createDataFrame([("a", 5)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    start()
    start()
    assert {r["pattern"]: r["n"] for r in stores.stored(spark, f"{tmp_path}/t").collect()} == {"a": 7, "b0": 2, "b1": 2}


def test_a_store_without_rows_is_an_empty_table(spark, tmp_path):
    """As of alerts that no device gave."""
    rows = counts(spark, [])
    assert stores.stored(spark, f"{tmp_path}/t", rows.schema).count() == 0
    stores.upsert(rows, 0, f"{tmp_path}/t", ["pattern", "correction"], MERGE, buckets=4)
    assert stores.stored(spark, f"{tmp_path}/t", rows.schema).collect() == []
    stores.upsert(counts(spark, [("a", "b", 1, 2)]), 1, f"{tmp_path}/t", ["pattern", "correction"], MERGE, buckets=4)
    assert [tuple(r) for r in stores.stored(spark, f"{tmp_path}/t", rows.schema).collect()] == [("a", "b", 1, 2)]


def test_alerts_of_events_that_give_none(spark, tmp_path):
    spark.range(50).selectExpr("id AS event_id", "timestamp_seconds(id * 60)::timestamp_ntz AS ts", "id AS user_id", "'a' AS event_type", "1D AS value", "'' AS props").write.parquet(f"{tmp_path}/events.parquet")
    got = stream_queries.st6_stream_alerts(spark, str(tmp_path))
    assert got.columns == ["device", "start", "end", "evaluations"] and got.count() == 0


def test_uploads_are_due_by_rounded_seconds(spark):
    """Half seconds go to the even one, as the SQL's cast of seconds has it."""
    rows = [("00:00:00.600", "00:05:00.500", False), ("00:00:00.400", "00:04:59.600", True), ("00:00:00.500", "00:04:59.500", True), ("00:00:01.500", "00:05:01.400", False), (None, "00:00:00", True), ("00:00:00", None, None)]
    at = spark.createDataFrame(rows, "last string, now string, want boolean").select(*(F.concat(F.lit("2024-01-01 "), c).cast("timestamp_ntz").alias(c) for c in ("last", "now")), "want")
    assert [r["due"] for r in at.select(sinks.due(F.col("last"), F.col("now")).alias("due")).collect()] == [r[2] for r in rows]


def test_sync_delivers_late_rows_of_the_marks_time_once(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    path, schema = str(tmp_path / "s"), "id long, updated_at timestamp, v string"
    rows = [(1, at(1), "a"), (5, at(2), "b")]
    sync = lambda **how: sorted(r["id"] for r in stores.sync(spark.createDataFrame(rows, schema), path, **how).collect())
    assert sync() == [1, 5]
    assert sync() == []
    rows += [(3, at(2), "late, of the same time and a smaller id"), (9, at(2), "late"), (2, at(1), "before the mark"), (7, None, "no time")]
    assert sync() == [3, 9]
    rows += [(10, at(5), "new")]
    assert sync() == [10] and sync() == []
    rows += [(11, at(4), "within the overlap")]
    assert sync() == [] and sync(overlap="2 minutes") == [11] and sync(overlap="2 minutes") == []
    # a sync that ended before its mark was stored is done over
    rows += [(12, at(6), "cut off")]
    stores.sync(spark.createDataFrame(rows, schema), path)
    newest = max((Path(path) / "mark").glob("m=*"), key=lambda p: int(p.name[2:]))
    newest.rename(Path(path) / "lost")
    assert sync() == [12]
    assert spark.read.parquet(f"{path}/out").groupBy("id").count().filter("count > 1").count() == 0


def heavy(n=6000):
    """A heavy tail, an outlier that stretches the range, many ties and missing values."""
    random.seed(9)
    return [("a", random.paretovariate(0.7), k) for k in range(n)] + [("a", 1e15, -1), ("a", None, -2)] + [("b", 7.0, k) for k in range(n)] + [("b", float(k), -k) for k in range(5)] + [("c", 1.0, 1)]


def test_latencies_are_the_sorted_values(spark):
    rows = heavy()
    got = {r["g"]: r for r in logs.latency(spark.createDataFrame(rows, "g string, v double, id long").repartition(6), "v", ["g"]).collect()}
    for g in "abc":
        own = sorted(v for h, v, _ in rows if h == g and v is not None)
        assert got[g]["n"] == len(own) and got[g]["mean"] == pytest.approx(sum(own) / len(own))
        assert [got[g][f"p{p}"] for p in (50, 95, 99)] == [own[min(len(own) * p // 100, len(own) - 1)] for p in (50, 95, 99)]


def test_only_few_values_are_opened(spark, monkeypatch):
    """Of a heavy-tailed column far under 5 % of the rows come to any group of the second pass."""
    seen = []
    held = selection._settle

    def settle(rows, by, asked):
        low = lambda w: w["low"].isNotNull() & (F.col("_x") < w["low"])
        seen.append(rows.join(asked, by).filter(F.exists("_w", lambda w: ~low(w) & (F.col("_x") <= w["high"]))).count())
        return held(rows, by, asked)

    monkeypatch.setattr(selection, "_settle", settle)
    rows = spark.createDataFrame([r for r in heavy(40_000) if r[0] == "a"], "g string, v double, id long").repartition(6)
    logs.latency(rows, "v", ["g"]).collect()
    assert len(seen) == 1 and seen[0] < 0.05 * 40_000


def test_a_sketch_that_misses_is_made_up_for(spark, monkeypatch):
    monkeypatch.setattr(selection, "ACCURACY", 3)
    monkeypatch.setattr(selection.F, "percentile_approx", lambda x, near, accuracy: F.array(*[F.max(x)] * len(near)))
    rows = heavy(400)
    got = {r["g"]: r for r in logs.latency(spark.createDataFrame(rows, "g string, v double, id long"), "v", ["g"]).collect()}
    own = sorted(v for h, v, _ in rows if h == "a" and v is not None)
    assert [got["a"][f"p{p}"] for p in (50, 95, 99)] == [own[len(own) * p // 100] for p in (50, 95, 99)]


def test_quarters_by_time_and_id(spark):
    random.seed(5)
    rows = [(g, datetime.datetime(2024, 1, 1, random.randrange(3)), k, random.random()) for g in "ab" for k in random.sample(range(1000), 101)] + [("a", None, 5, 9.0)]
    df = spark.createDataFrame(rows, "g string, ts timestamp, id long, v double").repartition(4)
    for r in logs.degradation(df, "v", ["ts", "id"], ["g"]).collect():
        own = [v for _, _, v in sorted((t, k, v) for g, t, k, v in rows if g == r["g"] and t)]
        n = len(own)
        early, late = own[: n // 4], own[3 * n // 4 :]
        assert (r["early"], r["late"]) == (pytest.approx(sum(early) / len(early)), pytest.approx(sum(late) / len(late)))


def test_nearest_vectors_go_by_key_where_scores_are_equal(spark, monkeypatch):
    """Copies in any order, over parts of vectors and of queries, and products no larger than a part."""
    from textloom.operators import vectors

    monkeypatch.setattr(vectors, "PART", 7, raising=False)
    monkeypatch.setattr(vectors, "QUERIES", 3, raising=False)
    random.seed(3)
    kinds = [[random.uniform(-1, 1) for _ in range(8)] for _ in range(4)]
    rows = [(k, kinds[k % 4]) for k in range(100)]
    random.shuffle(rows)
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = {}
    for r in sorted(vectors.top_k(v, v.filter("vec_id % 10 = 0"), k=5).collect(), key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append(r["vec_id"])
    for query in range(0, 100, 10):
        assert got[query] == [k for k in range(query % 4, 100, 4) if k != query][:5]


def test_versions_are_read_from_many_arrays(spark, tmp_path, monkeypatch):
    from textloom.plans import source_queries

    monkeypatch.setattr(source_queries, "shared_folder", lambda spark: f"{tmp_path}/shared")
    spark.range(45_000).selectExpr("id AS o_orderkey", "id % 100 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = source_queries.sc18_versions(spark, str(tmp_path))
    assert got.count() == 45_000 and got.distinct().count() == 45_000
    assert len(list(Path(f"{tmp_path}/shared/versions").glob("part-*"))) == 3


def test_office_files_are_unpacked_a_few_at_a_time(spark, monkeypatch):
    """What comes out of a task comes in small batches, whatever the number of files in one of its own."""
    import pyarrow as pa

    from textloom.operators import documents
    from textloom.plans import source_queries

    sizes = []

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            kind = pa.RecordBatch.from_arrays([pa.array([f"{k}.pptx" for k in range(1000)]), pa.array(["pptx"] * 1000), pa.array(["a\nb\nc\nd"] * 1000)], names=["path", "kind", "text"])
            sizes.extend(b.num_rows for b in run(iter([kind])))

    source_queries._office(Rows())
    assert max(sizes) <= documents.FILES and sum(sizes) == 1000
