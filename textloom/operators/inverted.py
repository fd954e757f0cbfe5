"""An inverted file of vectors: coarse lists by k-means, of which a query probes the nearest.

The lists are fitted on a sample of at most ``SAMPLE`` vectors, chosen by hash; every vector is then indexed. How many lists a query
probes is measured on the sample, against all pairs of it. Lists and queries of a list are dealt in parts of ``PART`` and ``ASKED`` rows,
so that a list with a third of all vectors is many tasks' work. ``vectors.top_k`` is the exact way.

Null vectors are in no list. Vectors without length are as near to a query as they are to any other: score 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.vectors import best_of, directions
from textloom.sources.shared import shared_folder

#: Vectors that the lists are fitted on, lists at most, and rows of a list and of its queries that one task compares.
SAMPLE, LISTS, PART, ASKED = 16_384, 4096, 8192, 2048


@dataclass
class Index:
    """Where the vectors lie (key, list, direction), the lists' centres, and how many of them a query probes."""

    folder: str
    key: str
    centres: np.ndarray
    probes: int


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of directions by cosine; an empty one keeps its place."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        held = np.bincount(own, minlength=k) > 0
        centres[held] = sums[held] / np.maximum(np.linalg.norm(sums[held], axis=1, keepdims=True), 1e-12)
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, *, recall: float, k: int, asked: int = 512) -> int:
    """The least number of lists that so many of the k nearest in the sample lie in. A larger table's nearest are nearer, so it needs no more."""
    few = x[:: max(1, len(x) // asked)]
    near = few @ x.T
    near[np.arange(len(few)), np.arange(len(x))[:: max(1, len(x) // asked)]] = -np.inf
    best = np.argpartition(-near, min(k, len(x) - 1), axis=1)[:, :k]
    own = (x @ centres.T).argmax(1)
    place = np.argsort(np.argsort(-(few @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(place[np.arange(len(few))[:, None], own[best]].ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


def build(vectors: DataFrame, folder: str | None = None, *, key: str = "vec_id", vector: str = "embedding", recall: float = 0.95, k: int = 10, sample: int = SAMPLE) -> Index:
    """The index of all vectors, written to the folder."""
    folder = folder or shared_folder(vectors.sparkSession)
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), vector)
    n = rows.count()
    share = min(1.0, 0.9 * sample / max(n, 1))
    chosen = rows if n <= sample else rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
    held = [r[0] for r in chosen.select(vector).limit(sample).collect()]
    x = directions(np.array(held, np.float32)) if held else np.zeros((0, 1), np.float32)
    lists = max(1, min(LISTS, int(math.sqrt(n)), len(x) // 8))
    centres = k_means(x, lists) if len(x) else np.zeros((1, 1), np.float32)
    probes = probes_for(x, centres, recall=recall, k=k) if len(x) > 1 else 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = directions(np.array(batch.column(1).to_pylist(), np.float32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((own @ centres.T).argmax(1), pa.int32()), pa.array(list(own), pa.list_(pa.float32()))], names=[key, "list", "direction"])

    rows.mapInArrow(deal, f"`{key}` long, list int, direction array<float>").write.parquet(f"{folder}/vectors")
    return Index(folder, key, centres, probes)


def search(index: Index, queries: DataFrame, *, vector: str = "embedding", k: int = 10) -> DataFrame:
    """(query, rank, key, score): the k nearest by cosine of each query (key, vector), itself excepted, among the vectors of the lists that it probes."""
    spark, key, centres, probes = queries.sparkSession, index.key, index.centres, index.probes
    held = spark.read.parquet(f"{index.folder}/vectors")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = directions(np.array(batch.column(1).to_pylist(), np.float32))
                near = np.argpartition(-(own @ centres.T), probes - 1, axis=1)[:, :probes]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), probes)), pa.array(near.ravel(), pa.int32()), pa.array(list(np.repeat(own, probes, axis=0)), pa.list_(pa.float32()))], names=["query", "list", "asked"])

    rows = queries.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("query"), vector)
    asked = rows.mapInArrow(ask, "query long, list int, asked array<float>")
    # one row for each list, of which there are LISTS at most
    sizes = held.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).join(asked.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("turns")), "list")
    sizes = F.broadcast(sizes)
    left = held.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64(key), "parts").cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    right = asked.join(sizes, "list").withColumn("turn", F.pmod(F.xxhash64("query"), "turns").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def compare(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        if not vectors.num_rows or not asked.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), key: pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, own = vectors.column(key).to_numpy(), np.array(vectors.column("direction").to_pylist(), np.float32)
        queries, wanted = asked.column("query").to_numpy(), np.array(asked.column("asked").to_pylist(), np.float32)
        scores = wanted @ own.T
        scores[queries[:, None] == ids[None, :]] = -np.inf
        best = np.argpartition(-scores, min(k, len(ids)) - 1, axis=1)[:, :k]
        flat = np.take_along_axis(scores, best, 1).ravel()
        fine = np.isfinite(flat)
        return pa.table({"query": np.repeat(queries, best.shape[1])[fine], key: ids[best].ravel()[fine], "score": flat[fine].astype(np.float64)})

    by = ["list", "part", "turn"]
    found = left.select(*by, key, "direction").groupBy(*by).cogroup(right.select(*by, "query", "asked").groupBy(*by)).applyInArrow(compare, f"query long, `{key}` long, score double")
    return best_of(found, key, k)
