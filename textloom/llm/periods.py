"""Maximal periodic runs of words: where a text goes on repeating its last q words, by divide and conquer over Z-functions.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least max(12, 2 q) words, which no
neighbouring word extends. Words are interned byte for byte within a batch, so runs are sequences of small integers. A run's words stand
in six-word windows that its text repeats, with gaps of five windows at most, so only such stretches are searched, each by the method of Main and Lorentz: halves are searched
for themselves, and Z-functions at the midpoint tell for every period how far it holds to both sides of it. Intervals that go on past
their segment have been found whole in an enclosing one; of the periods of one interval the smallest is its own.

Null, empty and blank texts have no words and no runs. Repeated rows and ids are documents of their own. An empty table gives an empty
result. Texts are whole rows; the work of one is n log n whatever it holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels, packed

#: Words of a run at least, and words of the windows that each run repeats: half as many.
LEAST, WINDOW = 12, 6
#: Bytes of text that are interned together.
TOGETHER = 2 << 20


def z_function(x: np.ndarray) -> np.ndarray:
    """For each place how many elements from there on equal those at the start; 0 for the start itself."""
    n = len(x)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    s = x.tolist()
    left = right = 0
    z = out.tolist()
    for i in np.flatnonzero(x == x[0]).tolist()[1:]:  # elsewhere it is 0
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return np.array(z, np.int64)


def crossing(x: np.ndarray, low: int, mid: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the repetitions of x[low:high] that hold both words beside mid, each as far as it goes in there."""
    u, v = x[low:mid], x[mid:high]
    apart = np.full(1, -1, x.dtype)
    m, n = len(u), len(v)
    back = u[::-1]
    # periods whose second copy lies right of mid: words from mid on against those p later, words before mid against those p later
    p = np.arange(1, n + 1)
    ahead = np.append(z_function(v), 0)[p]
    behind = z_function(np.concatenate([back, apart, v[::-1], back]))[m + 1 + n - p]
    own = np.flatnonzero((ahead + behind >= p) & (ahead + behind + p >= LEAST))
    starts, ends, periods = [mid - behind[own]], [mid + p[own] + ahead[own]], [p[own]]
    # and those whose first copy lies left of it
    p = np.arange(1, m + 1)
    ahead = z_function(np.concatenate([v, apart, u, v]))[n + 1 + m - p]
    behind = np.append(z_function(back), 0)[p]
    own = np.flatnonzero((ahead + behind >= p) & (ahead + behind + p >= LEAST))
    starts, ends, periods = [*starts, mid - p[own] - behind[own]], [*ends, mid + ahead[own]], [*periods, p[own]]
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(periods)


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """The maximal runs of a sequence as (start, length, period), by start and period."""
    n, found, todo = len(x), {}, [(0, len(x))]
    while todo:
        low, high = todo.pop()
        if high - low < LEAST:  # a run is found where it lies whole in a segment
            continue
        mid = (low + high) // 2
        todo += [(low, mid), (mid, high)]
        starts, ends, periods = crossing(x, low, mid, high)
        if len(starts):
            goes_on = (starts == low) & (low > 0) & (x[low - 1] == x[(low - 1 + periods) % n])
            goes_on |= (ends == high) & (high < n) & (x[min(high, n - 1)] == x[high - periods])
            for s, e, p in zip(*(c[~goes_on].tolist() for c in (starts, ends, periods)), strict=True):
                found[s, e] = min(p, found.get((s, e), p))
    return sorted((s, e - s, p) for (s, e), p in found.items())


def stretches(ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, from, to) of the stretches of words that may hold runs: windows of WINDOW words that their text holds again, with gaps under WINDOW."""
    n = len(ids) - WINDOW + 1
    if n < 1:
        return []
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes = text[:n].astype(np.uint64)
    for k in range(WINDOW):
        hashes = kernels.mix(hashes, 80) ^ ids[k : k + n].astype(np.uint64)
    hashes = kernels.mix(hashes, 81)
    whole = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    order = whole[np.argsort(hashes[whole], kind="stable")]
    same = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    if not len(at):
        return []
    new = np.flatnonzero(np.append(True, (np.diff(at) > WINDOW) | (np.diff(text[at]) > 0)))
    last = at[np.append(new[1:], len(at)) - 1] + WINDOW
    return [(t, a, b) for t, a, b in zip(text[at[new]].tolist(), at[new].tolist(), last.tolist(), strict=True) if b - a >= LEAST]


def interned(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the distinct words, each word's index among them, and the index of each text's first word."""
    places = [np.zeros(0, np.int64)]

    def parts() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for part, a, starts, ends in kernels.words_of(data, offsets, lower=False):
            places.append(starts + a)
            yield a, a + len(part), starts, ends

    starts, ends, _, index = kernels.gathered(data, parts())
    return starts, ends, index, np.searchsorted(np.concatenate(places), offsets)


def tail_repeated(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """From which word on a text of n words repeats which number of words, if the contract of the query makes it do so."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def of_batch(texts: pa.Array, keys: list, arrange: Callable[[object, int], tuple[int, int] | None] | None = None) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
    """For each text its number of words, its runs, and its words without those that a run repeats, joined by spaces."""
    data, offsets = kernels.column_bytes(texts)
    starts, ends, ids, first = interned(data, offsets)
    if arrange:
        ids = ids.copy()
        for a, b, key in zip(first[:-1].tolist(), first[1:].tolist(), keys, strict=True):
            if (turn := arrange(key, b - a)) is not None:
                at, period = a + turn[0], turn[1]
                ids[at:b] = ids[at + np.arange(b - at) % period]
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    gone = np.zeros(len(ids) + 1, np.int32)
    for t, a, b in stretches(ids, first):
        base = a - int(first[t])
        for s, length, p in runs(ids[a:b]):
            found[t].append((base + s, length, p))
            gone[a + s + p] += 1
            gone[a + s + length] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    joined = kernels.joined(data, starts[ids[kept]], ends[ids[kept]], np.searchsorted(kept, first))
    return np.diff(first).tolist(), found, joined


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", arrange: Callable[[object, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """(key, n_words long, runs array of (start, length, period), collapsed string) for every row.

    arrange(key, number of words) may give (a, p): word a and those after it are then taken as the p words from a on, over and over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in packed.pieces(batch, text, TOGETHER):
                keys = rows.column(rows.schema.get_field_index(key))
                n, found, joined = of_batch(rows.column(rows.schema.get_field_index(text)), keys.to_pylist(), arrange)
                own = [[{"start": s, "length": m, "period": p} for s, m, p in x] for x in found]
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(own, RUNS), pa.array(joined, pa.binary()).cast(pa.string())], [key, "n_words", "runs", "collapsed"])
                kernels.tidy()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def query(docs: DataFrame) -> DataFrame:
    """Digests of the runs and the collapsed words of every document, with the tails that the contract repeats."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = find(docs, arrange=tail_repeated).select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).alias("lines"), "collapsed")
    length = -F.col("best.length")
    return rows.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
