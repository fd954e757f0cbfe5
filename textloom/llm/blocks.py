"""Exact substring deduplication by fixed blocks: what a document repeats of documents with smaller ids goes, word by word.

Every document is a reference: its words are indexed in blocks of half a window that do not overlap. Every document also probes, with
the rolling window of a block's size at every word. A window of ``size`` words holds a whole block of the document that it repeats, so
what has no hit is no repeat. A hit is extended to all windows around it, and those that a smaller document holds as well cover,
together, the maximal exact repeats. Two exchanges between chunks and hash buckets do this, see :mod:`textloom.llm.packed`:

1. each chunk sends the distinct hashes of its rolling windows, cut to a few bits more than the corpus has words (sorted, as
   differences; less than two bytes a word), with a bit for those that are blocks and one for those that several of its documents hold.
   The bucket tells which are blocks somewhere and stand in two documents at least. What the cut hashes confuse is one more hit.
2. for the windows of full size around its hits each chunk sends two independent hashes (some 100 bits together) and the least doc_id,
   once for each distinct window. The bucket tells which stand under a smaller one elsewhere. So a passage that stands everywhere is
   one entry a chunk, and its copies are never paired.

Null doc_ids count as smaller than all others; rows that share a doc_id take nothing from each other. Null, empty and blank texts and
texts of fewer words than a window lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels, packed

U64 = np.uint64
#: Words of a window.
WINDOW = 50
#: Bits of a cut hash beyond those that number the bytes of the corpus.
SPARE = 2


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and two independent hashes of all words, and the index of each text's first word."""
    starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((2, 0), U64)]
    for part, a, s, e in kernels.words_of(data, offsets, lower=False):
        own = kernels.loads(part)
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(np.stack([kernels.span_hash(part, s, e, salt, own) for salt in (0, 1)]))
    s = np.concatenate(starts)
    return s, np.concatenate(ends), np.concatenate(hashes, axis=1), np.searchsorted(s, offsets)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words, from hashes of stretches that double."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, U64)
    out, done, held, width = None, 0, hashes, 1
    while True:
        if k & width:
            part = held[done : done + n]
            out = part if out is None else kernels.mix(kernels.mix(out, 90) + part, 91)
            done += width
        if 2 * width > k:
            return kernels.mix(out, 92)
        held = kernels.mix(kernels.mix(held[:-width], 93) + held[width:], 94)
        width *= 2


def starts_of(first: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The words at which k consecutive ones of a text with ``least`` words or more begin, and the texts."""
    sizes = np.diff(first)
    count = np.where(sizes >= least, sizes - k + 1, 0)
    return np.repeat(first[:-1], count) + kernels.ranges(count), np.repeat(np.arange(len(sizes)), count)


def cut_bits(n_bytes: int, buckets: int) -> int:
    """Bits of a cut hash: as many as number the bytes, and SPARE, but what is left of it in a bucket fits 32."""
    return min(64, 32 + int(math.log2(buckets)), max(16, math.ceil(math.log2(max(2, n_bytes))) + SPARE))


def to_differences(keys: np.ndarray) -> bytes:
    """Sorted integers of 32 bits as differences, byte plane by byte plane, compressed."""
    return packed.squeeze(np.diff(keys, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def from_differences(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(packed.expand(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4")[:, 0], dtype=np.uint32)


class Windows:
    """The windows of a chunk's texts, and the buckets and cut hashes of a corpus of so many bytes."""

    def __init__(self, n_bytes: int, size: int, text: str, key: str):
        self.text, self.key, self.size, self.block = text, key, size, size // 2
        self.buckets = max(4, math.ceil(n_bytes / packed.BUCKET_BYTES))
        self.bits = cut_bits(n_bytes, self.buckets)

    def split(self, keys: np.ndarray) -> list[tuple[int, slice]]:
        """The buckets of keys that are sorted by bucket and rest, with their places."""
        bucket = keys >> U64(32)
        edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        return [(int(bucket[a]), slice(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def cut(self, hashes: np.ndarray) -> np.ndarray:
        """Bucket (upper half) and rest (lower half) of hashes cut to so many bits."""
        short, n = hashes >> U64(64 - self.bits), U64(self.buckets)
        return ((short % n) << U64(32)) | (short // n)

    def probes(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of all rolling windows of a block's size: words where they begin, each one's place among the distinct cut hashes, these, and whether they are blocks and in several texts."""
        at, doc = starts_of(first, self.block, self.size)
        keys, inverse = np.unique(self.cut(rolling(hashes[0], self.block)[at]), return_inverse=True)
        block = np.zeros(len(keys), bool)
        block[inverse[(at - first[doc]) % self.block == 0]] = True
        least, most = np.full(len(keys), len(first)), np.full(len(keys), -1)
        np.minimum.at(least, inverse, doc)
        np.maximum.at(most, inverse, doc)
        return at, inverse, keys, block, least != most

    def around(self, hashes: np.ndarray, first: np.ndarray, got: pa.Table, docs: np.ndarray) -> tuple[np.ndarray, ...]:
        """The windows of full size around the hits of a chunk: words where they begin, doc_ids, each one's place among the distinct ones; cut hash, second hash and least doc_id of these."""
        at, inverse, keys, *_ = self.probes(hashes, first)
        hit = np.zeros(len(keys), bool)
        places = dict(self.split(keys))
        for b, x in zip(packed.column(got, "bucket"), packed.column(got, "hit"), strict=True):
            own = places[b]
            hit[own] = np.unpackbits(np.frombuffer(x, np.uint8), count=own.stop - own.start).astype(bool)
        # hits among the places that a window of full size leaves for a block
        before = np.zeros(hashes.shape[1] + 1, np.int64)
        before[at[hit[inverse]] + 1] = 1
        before = np.cumsum(before)
        whole, doc = starts_of(first, self.size, self.size)
        own = before[whole + self.size - self.block + 1] > before[whole]
        whole, doc = whole[own], docs[doc[own]]
        one, two = self.cut(rolling(hashes[0], self.size)[whole]), rolling(hashes[1], self.size)[whole]
        order = np.lexsort((doc, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        least = order[new]
        return whole, doc, inverse, one[least], two[least], doc[least]


def ask_blocks(chunks: packed.Chunks, own: Windows) -> DataFrame:
    """The distinct windows of a block's size, from every chunk to their buckets."""

    def ask(chunk: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        _, _, hashes, first = words(*kernels.column_bytes(rows.column(own.text)))
        _, _, keys, block, several = own.probes(hashes, first)
        parts = own.split(keys)
        rest = keys.astype(np.uint32)
        columns = [pa.array([b for b, _ in parts], pa.int32()), pa.array([chunk] * len(parts), pa.int64()), pa.array([to_differences(rest[x]) for _, x in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array([np.packbits(f[x]).tobytes() for _, x in parts], pa.binary()) for f in (block, several))], ["bucket", "chunk", "keys", "block", "several"])

    return chunks.each(ask, "bucket int, chunk long, keys binary, block binary, several binary")


def hits(asked: DataFrame) -> DataFrame:
    """(chunk, bucket, hit): which of a chunk's distinct windows are blocks somewhere and stand in two texts at least."""

    def answer(asked: pa.Table) -> pa.Table:
        keys = [from_differences(x) for x in packed.column(asked, "keys")]
        sizes = np.array([len(x) for x in keys])
        block, several = (np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(packed.column(asked, c), sizes, strict=True)]) for c in ("block", "several"))
        _, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        hit = ((np.bincount(inverse, block) > 0) & ((counts > 1) | (np.bincount(inverse, several) > 0)))[inverse]
        return bits_back(asked, hit, sizes, "hit")

    return packed.answered(asked, answer, "chunk long, bucket int, hit binary")


def ask_windows(chunks: packed.Chunks, own: Windows, found: DataFrame) -> DataFrame:
    """The distinct windows of full size around the hits, from every chunk to their buckets."""

    def ask(chunk: int, rows: pa.Table, got: pa.Table) -> pa.Table:
        _, _, hashes, first = words(*kernels.column_bytes(rows.column(own.text)))
        _, _, _, one, two, least = own.around(hashes, first, got, doc_ids(rows, own.key))
        parts = own.split(one)
        rest = one.astype(np.uint32)
        docs = []
        for _, x in parts:
            known, which = np.unique(least[x], return_inverse=True)
            docs.append(packed.squeeze(np.uint32(len(known)).tobytes() + known.tobytes() + which.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()))
        columns = [pa.array([to_differences(rest[x]) for _, x in parts], pa.binary()), pa.array([two[x].tobytes() for _, x in parts], pa.binary()), pa.array(docs, pa.binary())]
        return pa.Table.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([chunk] * len(parts), pa.int64()), *columns], ["bucket", "chunk", "keys", "second", "docs"])

    return chunks.with_answers(found, ask, "bucket int, chunk long, keys binary, second binary, docs binary")


def repeats(asked: DataFrame) -> DataFrame:
    """(chunk, bucket, smaller): which of a chunk's distinct windows stand under a smaller doc_id elsewhere."""

    def docs_of(blob: bytes) -> np.ndarray:
        raw = packed.expand(blob)
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        which = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=4 + 8 * n).reshape(4, -1).T).view(np.uint32)[:, 0]
        return np.frombuffer(raw, np.int64, n, 4)[which]

    def answer(asked: pa.Table) -> pa.Table:
        keys = [from_differences(x) for x in packed.column(asked, "keys")]
        one, two = np.concatenate(keys), np.frombuffer(b"".join(packed.column(asked, "second")), U64)
        docs = np.concatenate([docs_of(x) for x in packed.column(asked, "docs")])
        order = np.lexsort((docs, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        smaller = np.empty(len(order), bool)
        smaller[order] = docs[order] > docs[order][new][np.cumsum(new) - 1]
        return bits_back(asked, smaller, np.array([len(x) for x in keys]), "smaller")

    return packed.answered(asked, answer, "chunk long, bucket int, smaller binary")


def bits_back(asked: pa.Table, found: np.ndarray, sizes: np.ndarray, name: str) -> pa.Table:
    """The answers to those who asked, packed as bits; who would hear of none gets no row."""
    ends = np.cumsum(sizes)
    some = np.flatnonzero(np.add.reduceat(found, ends - sizes) if len(ends) else ends)
    blobs = [np.packbits(found[ends[k] - sizes[k] : ends[k]]).tobytes() for k in some.tolist()]
    return pa.table({"chunk": asked.column("chunk").take(pa.array(some)), "bucket": asked.column("bucket").take(pa.array(some)), name: pa.array(blobs, pa.binary())})


def doc_ids(rows: pa.Table, key: str) -> np.ndarray:
    return pc.fill_null(rows.column(key).cast(pa.int64()), -(2**63)).to_numpy()


def remove_repeats(docs: DataFrame, folder: str | None = None, *, text: str = "text", key: str = "doc_id", size: int = WINDOW, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` (of documents) with n_words, n_removed, spans (first word and the one behind the last of each maximal removed stretch) and kept (the other words, joined by spaces)."""
    folder = folder or packed.shared_folder(docs.sparkSession)
    columns = list(dict.fromkeys([*keep, key, text]))
    chunks = packed.Chunks(docs.select(*columns), folder, text)
    work = Windows(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0, size, text, key)
    found = packed.table(hits(ask_blocks(chunks, work)), folder, "hits")
    smaller = repeats(ask_windows(chunks, work, found))
    kind = {c: docs.schema[c].dataType.simpleString() for c in keep}

    # the windows around the hits are found again from the hits; both answers come to the chunk as one table
    both = found.select("chunk", "bucket", "hit", F.lit(None).cast("binary").alias("smaller")).unionByName(smaller.select("chunk", "bucket", F.lit(None).cast("binary").alias("hit"), "smaller"))

    def cut(_: int, rows: pa.Table, got: pa.Table) -> pa.Table:
        data, offsets = kernels.column_bytes(rows.column(text))
        starts, ends, hashes, first = words(data, offsets)
        is_hit = pc.is_valid(got.column("hit"))
        whole, doc, inverse, one, _, least = work.around(hashes, first, got.filter(is_hit), doc_ids(rows, key))
        smaller, places = np.zeros(len(one), bool), dict(work.split(one))
        later = got.filter(pc.invert(is_hit))
        for b, x in zip(packed.column(later, "bucket"), packed.column(later, "smaller"), strict=True):
            own = places[b]
            smaller[own] = np.unpackbits(np.frombuffer(x, np.uint8), count=own.stop - own.start).astype(bool)
        gone = whole[smaller[inverse] | (doc > least[inverse])] if len(whole) else whole
        edge = np.zeros(len(starts) + 1, np.int32)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + size, -1)
        covered = np.cumsum(edge[:-1]) > 0
        kept = np.flatnonzero(~covered)
        joined = kernels.joined(data, starts[kept], ends[kept], np.searchsorted(kept, first))
        removed = np.append(0, np.cumsum(covered))
        # stretches of one text: a text's first word begins a new one
        begins = covered.copy()
        begins[1:] &= ~covered[:-1]
        edges = first[(first > 0) & (first < len(covered))]
        begins[edges] |= covered[edges]
        stops = np.append(~covered[1:], True)[: len(covered)] & covered
        stops[edges - 1] |= covered[edges - 1]
        b, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        cuts = np.searchsorted(b, first)
        base = np.repeat(first[:-1], np.diff(cuts))
        spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(b - base, pa.int64()), pa.array(e - base, pa.int64())], ["start", "end"]))
        return pa.table({**{c: rows.column(c) for c in keep}, "n_words": np.diff(first), "n_removed": np.diff(removed[first]), "spans": spans, "kept": pa.array(joined, pa.binary()).cast(pa.string())})

    schema = ", ".join([*(f"`{c}` {k}" for c, k in kind.items()), "n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string"])
    return chunks.with_answers(both, cut, schema)


def query(docs: DataFrame, folder: str | None = None) -> DataFrame:
    return remove_repeats(docs, folder).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
