"""Nearest neighbours and clusters of small vectors."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources.shared import shared_folder

#: Vectors and queries that a task of ``top_k`` multiplies at once.
PART, QUERIES = 1024, 256


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def directions(x: np.ndarray) -> np.ndarray:
    """The rows of a matrix at length one; rows without length stay."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if len(x) else x


def best_of(found: DataFrame, key: str, k: int) -> DataFrame:
    """(query, rank, key, score) of the k best of each query; every task leaves out what cannot be among them before rows are exchanged."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", key, "score")


def top_k(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, block: int = 4096) -> DataFrame:
    """(query, rank, key, score): the k nearest vectors by cosine of each query, itself excepted.

    Queries come in blocks of about so many to every task, one scan of the vectors for each block; each task keeps its k best, and only
    those are shuffled. Equal scores go by key.
    """
    blocks = max(1, -(-queries.count() // block))
    own = lambda b: _top_block(vectors, queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b), key, vector, k)
    if blocks == 1:
        return own(0)
    folder = shared_folder(vectors.sparkSession)
    for b in range(blocks):  # the driver holds one block's queries at a time
        own(b).write.parquet(f"{folder}/block={b}")
    return vectors.sparkSession.read.parquet(folder).drop("block")


def _top_block(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    rows = queries.select(F.col(key).alias("q"), F.col(vector).alias("v")).collect()
    ids, held = np.array([r["q"] for r in rows], np.int64), directions(np.array([r["v"] for r in rows], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the k best of each query so far; vectors and queries meet in parts, so a task's memory doesn't follow the queries times a batch
        scores, keys = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows if len(ids) else 0, PART):
                part = batch.slice(a, PART)
                own = part.column(0).to_numpy()
                order = np.argsort(own)
                own, x = own[order], directions(np.array(part.column(1).to_pylist(), np.float64)[order])
                for q in range(0, len(ids), QUERIES):
                    at = slice(q, q + QUERIES)
                    near = np.round(held[at] @ x.T, 12)  # equal vectors have equal scores, wherever they stand in the product
                    near[ids[at, None] == own[None, :]] = -np.inf
                    best = np.argsort(-near, axis=1, kind="stable")[:, :k]
                    both, named = np.concatenate([scores[at], np.take_along_axis(near, best, 1)], 1), np.concatenate([keys[at], own[best]], 1)
                    chosen = np.lexsort((named, -both), axis=1)[:, :k]
                    scores[at], keys[at] = np.take_along_axis(both, chosen, 1), np.take_along_axis(named, chosen, 1)
        fine = np.isfinite(scores)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[fine.ravel()]), pa.array(keys[fine]), pa.array(scores[fine])], names=["query", key, "score"])

    found = vectors.select(key, vector).mapInArrow(run, f"query long, `{key}` long, score double")
    return best_of(found, key, k)


def assign(vectors: DataFrame, centroids: DataFrame, *, key: str = "vec_id", vector: str = "embedding", most: int = 4096) -> DataFrame:
    """(key, cluster, distance) to the nearest of some centroids (cluster, centroid), as one row of arrays beside every vector; of more than ``most`` in blocks by hash, whose least distances are merged."""
    if centroids.limit(most + 1).count() > most:
        blocks = -(-centroids.count() // most)
        parts = [assign(vectors, centroids.filter(F.pmod(F.xxhash64("cluster"), F.lit(2 * blocks)) == b), key=key, vector=vector, most=10 * most) for b in range(2 * blocks)]
        return functools.reduce(DataFrame.union, parts).filter("cluster is not null").groupBy(key).agg(F.min_by(F.struct("cluster", "distance"), F.struct("distance", "cluster")).alias("b")).select(key, "b.*")
    few = F.broadcast(centroids.agg(F.sort_array(F.collect_list(F.struct("cluster", "centroid"))).alias("c")))  # one row
    distances = F.transform("c", lambda c: F.struct(F.round(euclid(F.col(vector), c["centroid"]), 6).alias("d"), c["cluster"].alias("cluster"), euclid(F.col(vector), c["centroid"]).alias("distance")))
    return vectors.join(few).select(key, F.array_min(distances).alias("best")).select(key, F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance"))


def centroids(vectors: DataFrame, by: str, *, vector: str = "embedding") -> DataFrame:
    """The mean vector of each class."""
    rows = vectors.select(F.col(by).alias("cluster"), F.posexplode(vector).alias("i", "x"))
    means = rows.groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centroid"))


def online_clusters(vectors: DataFrame, by: str, *, order: str = "vec_id", vector: str = "embedding", radius: float = 0.5, most: int = 20) -> DataFrame:
    """One pass in order within each value of ``by``: a vector joins the nearest centre, or founds a new one if it is farther than radius and there are fewer than most; centres are running means.

    Rows are dealt by ``by`` and sorted (a sort may spill), and a task reads them batch by batch: it holds the centres of one value at a time and no more.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centres, counts = object(), [], []
        for batch in batches:
            keys, ids, rows = (batch.column(k).to_pylist() for k in range(3))
            out = []
            for key, values in zip(keys, rows, strict=True):
                if key != group:
                    group, centres, counts = key, [], []
                v = np.asarray(values, float)
                d = [np.linalg.norm(v - c) for c in centres]
                k = int(np.argmin(d)) if d else 0
                if not d or (d[k] > radius and len(centres) < most):
                    k = len(centres)
                    centres.append(v)
                    counts.append(1)
                else:
                    counts[k] += 1
                    centres[k] = centres[k] + (v - centres[k]) / counts[k]
                out.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int32())], names=[order, "cluster"])

    rows = vectors.select(F.col(by).alias("_by"), F.col(order).cast("long").alias(order), vector)
    return rows.repartition("_by").sortWithinPartitions("_by", order).mapInArrow(fold, f"`{order}` long, cluster int")


def hybrid(vectors: DataFrame, queries: DataFrame, texts: DataFrame, *, key: str = "vec_id", vector: str = "embedding", text: str = "text", where: Column | None = None, weight: float = 0.7, k: int = 10, block: int = 1024) -> DataFrame:
    """(query, rank, key, score): for each query (key, vector, terms array) the k best by weight * cosine + (1 - weight) * share of its terms that the text holds, of those that where (on texts) lets through.

    Exact: queries come in blocks of about so many to every task, as in top_k; a task tells the terms of a block once for each text, and keeps its k best of a batch.
    """
    held = texts if where is None else texts.filter(where)
    rows = vectors.select(key, vector).join(held.select(key, F.lower(text).alias("_text")), key)
    blocks = max(1, -(-queries.count() // block))
    parts = [_hybrid_block(rows, queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b), key, vector, weight, k) for b in range(blocks)]
    if blocks == 1:
        return parts[0]
    folder = shared_folder(vectors.sparkSession)
    for b, part in enumerate(parts):
        part.write.parquet(f"{folder}/block={b}")
    return vectors.sparkSession.read.parquet(folder).drop("block")


def _hybrid_block(rows: DataFrame, queries: DataFrame, key: str, vector: str, weight: float, k: int) -> DataFrame:
    asked = queries.select(F.col(key).alias("q"), F.col(vector).alias("v"), F.transform("terms", lambda t: F.lower(t)).alias("t")).collect()
    ids, held = np.array([r["q"] for r in asked], np.int64), np.array([r["v"] for r in asked], np.float64)
    held = directions(held)
    terms = sorted({t for r in asked for t in r["t"]})
    # the share of a query's terms as a product of what a text holds with these columns
    shares = np.array([[r["t"].count(t) / max(len(r["t"]), 1) for t in terms] for r in asked]).reshape(len(asked), len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), np.float64)
            if not len(own) or not len(ids):
                continue
            told = np.array([[t in text for t in terms] for text in (y or "" for y in batch.column(2).to_pylist())], float).reshape(len(own), len(terms))
            scores = weight * (held @ directions(x).T) + (1 - weight) * (shares @ told.T)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            flat = np.take_along_axis(scores, best, 1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(own[best].ravel()), pa.array(np.round(flat, 6))], names=["query", key, "score"])

    return best_of(rows.select(key, vector, "_text").mapInArrow(run, f"query long, `{key}` long, score double"), key, k)
