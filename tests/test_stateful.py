"""Stateful streams against whole tables and replays."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import logs
from textloom.sources import stores
from textloom.streaming import stateful


class Feed:
    """A folder that is read as a stream, file by file, over as many starts as there are batches."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.path, self.schema, self.n = spark, tmp_path, schema, 0
        (tmp_path / "in").mkdir()

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/in/{self.n:04d}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in/*")

    def run(self, out, keys):
        stateful.start(out, stores.upsert_batches(f"{self.path}/out", keys, buckets=3), f"{self.path}/checkpoint")
        return stores.stored(self.spark, f"{self.path}/out")


EVALUATIONS = "series string, ts timestamp, firing boolean"


def alerts(df):
    return {(r["series"], r["start"], r["end"], r["evaluations"]) for r in df.collect()}


def test_alerts_of_a_stream_are_those_of_the_table(spark, tmp_path):
    random.seed(2)
    at = lambda t: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t)
    rows = []
    for s in "abc":
        on = False
        for k in range(80):
            on = on if random.random() < 0.8 else not on
            rows.append((s, at(60 * k + ord(s)), on))
    rows.append(("quiet", at(30), True))  # one evaluation alone holds for no time
    rows.sort(key=lambda r: r[1])
    feed = Feed(spark, tmp_path, EVALUATIONS)
    table = spark.createDataFrame(rows, EVALUATIONS)
    # batches of 40; within each, and between neighbours, out of order by less than the watermark's delay
    batches = [rows[k : k + 40] for k in range(0, len(rows), 40)]
    batches[1].append(batches[0].pop(35))  # a late event
    batches[3].append(batches[2].pop(38))
    for batch in batches:
        random.shuffle(batch)
        feed.add(batch)
    feed.add([("closing", at(100_000), False)])
    firing = F.col("firing")
    got = feed.run(stateful.held_alerts(feed.stream(), firing, "5 minutes", ["series"], late="20 minutes"), ["series", "start"])
    want = logs.held_alerts(table, firing, "5 minutes", ["series"])
    assert alerts(got) == alerts(want) and len(alerts(want)) > 4


def test_an_event_behind_the_watermark_is_left_out_and_a_restart_goes_on(spark, tmp_path):
    at = lambda t: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=t)
    feed = Feed(spark, tmp_path, EVALUATIONS)
    out = lambda: feed.run(stateful.held_alerts(feed.stream(), F.col("firing"), "5 minutes", ["series"], late="2 minutes"), ["series", "start"])
    feed.add([("a", at(k), True) for k in range(4)])
    feed.add([("a", at(k), True) for k in (4, 5, 6, 20)])
    first = out()
    assert [(r["start"], r["end"], r["evaluations"]) for r in first.collect()] == [(at(0), at(6), 7)]
    # started anew from its checkpoint: the false evaluation of minute 3 comes behind the watermark, that of minute 21 does not
    feed.add([("a", at(3), False), ("a", at(21), False), ("a", at(60), True)])
    again = out()
    assert [(r["start"], r["end"], r["evaluations"]) for r in again.collect()] == [(at(0), at(20), 8)]


def rows_of(n, seed, start=0):
    random.seed(seed)
    return [(start + k, random.choices(["latin", "arabic", "mixed", None], [80, 15, 4, 1])[0]) for k in range(n)]


def test_reservoir_is_a_replay_row_by_row(spark, tmp_path):
    feed = Feed(spark, tmp_path, "id long, kind string")
    sizes, batches, at = [40, 300, 5, 400], [], 0
    for k, n in enumerate(sizes):
        rows = rows_of(n, k, at)
        at += n
        u = {r["id"]: r["u"] for r in spark.createDataFrame(rows, "id long, kind string").select("id", stateful.uniform(F.col("id"), 42).alias("u")).collect()}
        batches.append([(i, i, c or "unknown", u[i]) for i, c in rows])
        random.shuffle(rows)
        feed.add(rows)
    got = feed.run(stateful.reservoir(feed.stream(), "kind", "id", 60, floor=8), ["shard", "slot"])
    rows = {r["slot"]: (r["key"], r["kind"]) for r in got.collect()}
    want, seen = replay(batches, 60, 8)
    assert rows.pop(-1) == (None, None) and rows == dict(enumerate(want)) and seen == sum(sizes)
    assert got.filter("slot = -1").first()["seen"] == seen


def replay(batches, capacity, floor):
    """The reservoir row by row."""
    slots, seen = [], 0
    for batch in batches:
        members = {}
        for k, (_, c) in enumerate(slots):
            members.setdefault(c, []).append(k)
        for _, key, name, u in sorted(batch):
            seen += 1
            if len(slots) < capacity:
                members.setdefault(name, []).append(len(slots))
                slots.append((key, name))
                continue
            p = capacity / seen
            if len(members.get(name, [])) <= floor:
                p = max(p, 2 * floor / capacity)
            if u >= p:
                continue
            others = [c for c, own in members.items() if c != name and len(own) > floor]
            if not others:
                others = [name] if members.get(name) else [c for c, own in members.items() if own]
            victim = max(others, key=lambda c: (len(members[c]), c))
            slot = members[victim].pop(int(u * 1e9) % len(members[victim]))
            slots[slot] = (key, name)
            members.setdefault(name, []).append(slot)
    return slots, seen


@pytest.mark.parametrize("shards", [1, 4])
def test_reservoir_keeps_its_capacity_and_its_floor(spark, tmp_path, shards):
    feed = Feed(spark, tmp_path, "id long, kind string")
    feed.add([(k, "rare") for k in range(12)] + [(100 + k, "common") for k in range(400)])
    for b in range(3):
        feed.add([(1000 * (b + 1) + k, "common") for k in range(600)])
    got = feed.run(stateful.reservoir(feed.stream(), "kind", "id", 80, floor=8, shards=shards), ["shard", "slot"]).filter("slot >= 0")
    assert got.count() == 80 == got.select("key").distinct().count()
    # the largest class pays, so the rare one keeps what it has
    dealt = spark.range(12).groupBy(F.pmod(F.xxhash64(F.lit(43), "id"), F.lit(shards))).count().collect()
    assert got.filter("kind = 'rare'").count() >= sum(min(r[1], 8 // shards) for r in dealt)
    assert got.filter("key >= 2000").count() > 20
