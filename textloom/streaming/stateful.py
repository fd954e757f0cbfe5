"""Streams with state of their own: alerts that must hold for a while, and a reservoir over all classes.

Both keep typed state in the RocksDB store (``start`` chooses it for their query), of which a batch rewrites only what it touches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textloom import streaming

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HeldRuns(StatefulProcessor):
    """The run of true evaluations that a series is in, fed in order of time.

    Evaluations wait until the watermark has passed them, as earlier ones may still come; one timer wakes the series when the first of
    them is due. The state is the run (start, end, evaluations) and what waits.
    """

    def __init__(self, hold_us: int, columns: list[str]):
        self.hold_us, self.columns = hold_us, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "start long, last long, n long")
        self.waiting = handle.getListState("waiting", "at long, firing boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple[int, bool]] = []
        for batch in rows:
            new += zip(batch["at"].astype("int64").tolist(), batch["firing"].astype(bool).tolist(), strict=True)
        self.waiting.appendList(new)
        due = min(at for at, _ in new) // 1000 + 1
        timers = list(self.handle.listTimers())
        if not timers or due < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)
        yield self.none(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted((int(at), bool(firing)) for at, firing in self.waiting.get())
        ready = [x for x in held if x[0] // 1000 < passed]
        rest = held[len(ready) :]
        self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        start, last, n = map(int, self.run.get()) if self.run.exists() else (0, 0, 0)
        out = {}
        for at, firing in ready:
            start, last, n = (start if n else at, at, n + 1) if firing else (0, 0, 0)
            if n and last - start >= self.hold_us:
                out[start] = (start, last, n)
        self.run.update((start, last, n)) if n else self.run.clear()
        yield pd.DataFrame([(*key, *x) for x in out.values()], columns=[*self.columns, "start_us", "end_us", "evaluations"]) if out else self.none(key)

    def none(self, key) -> pd.DataFrame:
        return pd.DataFrame({**{c: pd.Series([], dtype="object") for c in self.columns}, **{c: pd.Series([], dtype="int64") for c in ("start_us", "end_us", "evaluations")}})

    def close(self) -> None:
        pass


def held_alerts(evaluations: DataFrame, firing: Column, hold: str, by: list[str], *, late: str = "10 minutes") -> DataFrame:
    """Runs of consecutive true evaluations (by ts) that last at least hold, as ``logs.held_alerts`` has them: (by, start, end, evaluations).

    A run is told as soon as it has lasted long enough, and again as it goes on: the newest row of (by, start) counts. An
    evaluation may come out of order as long as the watermark, late behind the newest one, has not passed it. Update mode.
    """
    hold_us = evaluations.sparkSession.sql(f"select unix_micros(timestamp_seconds(0) + interval {hold})").first()[0]
    rows = evaluations.withWatermark("ts", late).select(*by, "ts", F.unix_micros("ts").alias("at"), firing.alias("firing")).filter("firing is not null")
    kinds = ", ".join(f"`{c}` {evaluations.schema[c].dataType.simpleString()}" for c in by)
    out = rows.groupBy(*by).transformWithStateInPandas(HeldRuns(hold_us, by), f"{kinds}, start_us long, end_us long, evaluations long", "Update", "EventTime")
    return out.select(*by, F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), "evaluations")


def uniform(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that the key tells."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / F.lit(float(1 << 40))


class Slots(StatefulProcessor):
    """One reservoir: rows come in their order, each with a number from 0 to 1 that decides.

    While there is room a row takes the next slot. Later it is taken with the probability capacity / seen, or twice the floor's share
    where its class holds no more than that, and evicts a row of the largest other class over the floor, or where there is none one of its
    own: a class at its floor never pays for another. The state is a map of slots, the classes'
    counts and the number seen; a batch writes the slots that it changed.
    """

    def __init__(self, capacity: int, floor: int):
        self.capacity, self.floor = capacity, floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot int", "key long, kind string")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["order_key", "key"], kind="stable")
        seen = int(self.seen.get()[0]) if self.seen.exists() else 0
        held = {int(s[0]): (int(v[0]), v[1]) for s, v in self.slots.iterator()}
        changed = keep(held, seen, batch["key"].tolist(), batch["kind"].tolist(), batch["u"].to_numpy(), self.capacity, self.floor)
        for slot in changed:
            self.slots.updateValue((slot,), held[slot])
        self.seen.update((seen + len(batch),))
        yield pd.DataFrame({"shard": [key[0]] * (len(changed) + 1), "slot": [*changed, -1], "key": [*(held[s][0] for s in changed), None], "kind": [*(held[s][1] for s in changed), None], "seen": [seen + len(batch)] * (len(changed) + 1)}).astype({"key": "Int64"})

    def close(self) -> None:
        pass


def keep(held: dict[int, tuple[int, str]], seen: int, keys: list[int], classes: list[str], u: np.ndarray, capacity: int, floor: int) -> list[int]:
    """Put the rows of a batch, in their order, into the slots held; returns the slots that changed. Only rows whose number some probability could reach are looked at."""
    changed: set[int] = set()
    members: dict[str, list[int]] = {}
    for slot, (_, name) in sorted(held.items()):
        members.setdefault(name, []).append(slot)
    places = seen + 1 + np.arange(len(keys))
    share = min(1.0, 2 * floor / capacity)
    for i in np.flatnonzero((places <= capacity) | (u < np.maximum(capacity / places, share))).tolist():
        name = classes[i]
        if places[i] <= capacity:
            slot = len(held)
        else:
            few = len(members.get(name, ())) <= floor
            if u[i] >= (max(capacity / places[i], share) if few else capacity / places[i]):
                continue
            others = [c for c, own in members.items() if len(own) > floor and c != name] or ([name] if members.get(name) else list(filter(members.get, members)))
            victim = max(others, key=lambda c: (len(members[c]), c))
            slot = members[victim].pop(int(u[i] * 1e9) % len(members[victim]))
        held[slot] = (keys[i], name)
        members.setdefault(name, []).append(slot)
        changed.add(slot)
    return sorted(changed)


def reservoir(samples: DataFrame, by: str, key: str, capacity: int, *, floor: int = 0, order: str | None = None, shards: int = 1, seed: int = 42) -> DataFrame:
    """The slots of a sample of at most capacity rows over all classes (by), in which no class that had so many rows falls under the floor by others' rows.

    Rows (shard, slot, key, kind: the class, seen), of which the newest of each slot counts; slot -1 only tells how many rows were seen. With shards
    the rows are dealt by a hash of their key to reservoirs of their own, each with its part of capacity and floor, so that tasks share the work. Update mode.
    """
    name = F.coalesce(F.col(by).cast("string"), F.lit("unknown"))
    rows = samples.select(F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(shards)).cast("int").alias("shard"), F.col(order or key).cast("long").alias("order_key"), F.col(key).cast("long").alias("key"), name.alias("kind"), uniform(F.col(key), seed).alias("u"))
    return rows.groupBy("shard").transformWithStateInPandas(Slots(max(1, capacity // shards), floor // shards), "shard int, slot int, key long, kind string, seen long", "Update", "None")


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """``streaming.start`` in update mode, with the store that these states need."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        streaming.start(stream, write, checkpoint, mode="update")
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
