"""Exact substring deduplication with a sparse, hash-compared suffix array.

A string of ``length`` bytes is a repeat if it also starts earlier. Any such string holds an *anchor*: the least of the hashed
32-byte strings in it, so equal strings hold equal anchors at equal offsets, and only anchors (two in seventy bytes) have to
meet. They meet in three steps:

1. each chunk sends a short hash of every anchor and two hashes of its context (everything that a string around it can reach); equal
   contexts within a chunk are settled there, byte by byte;
2. a bucket settles equal contexts across chunks (by 160 bits of independent hashes: to send the bytes of each would move several
   times the input), and tells which anchors also stand in other contexts;
3. of these the chunk sends the context's bytes. Their suffixes to the right and prefixes to the left of the anchor are sorted by
   a merge sort that compares by the longest common extension, found by binary search over prefix polynomial hashes, and each
   extension between neighbours is verified byte by byte (should a hash have misled, all is sorted again by bytes). Two strings are equal when they lie in one run of both orders.

Of an anchor with very many contexts a chunk sends ``SENT`` in step 1, with the number of the others. Where all chunks together
have more than ``MANY``, the contexts never meet: each chunk settles the strings around its own, and sends every distinct one once,
as two independent hashes, to the bucket of the string, which tells where it stands first.

Order: doc_id (null first), then the row's place in the table, then the start. Rows that repeat a doc_id are documents of their
own. Null and empty texts and texts under ``length`` bytes lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels, packed

#: Bytes of an anchor.
ANCHOR = 32
#: Bytes of text in a chunk. Anchors gain little from larger ones, and small rows keep the executors' heaps small.
CHUNK_BYTES = 1 << 20
#: The base of the polynomial hashes.
BASE = 0x9E3779B97F4A7C55
#: Contexts of one anchor that a chunk sends to settle, and the number from which an anchor's contexts are compared string by string.
SENT, MANY = 4, 4096


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, their hashes, and the context [low, high) of each. Long texts are read in overlapping pieces."""
    n, gap = len(data), length - ANCHOR
    places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    low_bits = np.uint64((1 << 24) - 1)
    begins, stops = offsets[:-1], offsets[1:] - length + 1  # starts of whole strings
    begins, stops = begins[stops > begins], stops[stops > begins]
    for a in range(0, max(0, n - length + 1), kernels.SLICE):
        b = min(n - length + 1, a + kernels.SLICE)
        own = slice(np.searchsorted(stops, a, side="right"), np.searchsorted(begins, b))
        if own.start >= own.stop:
            continue
        inside = np.zeros(b - a + 1, np.int32)
        np.add.at(inside, np.maximum(begins[own] - a, 0), 1)
        np.add.at(inside, np.minimum(stops[own] - a, b - a), -1)
        part = data[a : b + length - 1]
        eight = kernels.mix(kernels.loads(part)[: len(part) - 7], 70)
        m = len(part) - ANCHOR + 1
        hashes = eight[:m].copy()
        for k, odd in enumerate((0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F), 1):
            hashes += eight[8 * k : 8 * k + m] * np.uint64(odd)
        hashes = kernels.mix(hashes, 71)
        least = (hashes & ~low_bits) | np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= gap + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < gap + 1:
            least = np.minimum(least[: len(least) - (gap + 1 - width)], least[gap + 1 - width :])
        place = (least & low_bits).astype(np.int64)[np.flatnonzero(np.cumsum(inside[:-1]) > 0)]
        place = place[np.append(True, place[1:] != place[:-1])] if len(place) else place
        places.append(place + a)
        found.append(hashes[place])
    place, own = np.unique(np.concatenate(places), return_index=True)
    text = np.searchsorted(offsets, place, side="right") - 1
    return place, np.concatenate(found)[own], np.maximum(offsets[text], place - gap), np.minimum(offsets[text + 1], place + length)


def local(rows: pa.Table, text: str, key: str, length: int):
    """The anchors of a chunk that are first there with their context, in hash order, and the spans that the others cover.

    Within the chunk equal contexts are told by their bytes, and their two hashes are for the bucket.
    """
    data, offsets = kernels.column_bytes(rows.column(text))
    known = pc.fill_null(rows.column(key).cast(pa.int64()), -(2**63)).to_numpy()
    place, hashes, low, high = anchors(data, offsets, length)
    words, lead = kernels.loads(data), kernels.mix((place - low).astype(np.uint64), 3)
    one, two = (kernels.span_hash(data, low, high, salt, words) ^ lead for salt in (1, 2))
    doc = known[np.searchsorted(offsets, place, side="right") - 1] if len(place) else place
    order = np.lexsort((place, doc, two, one, hashes))
    hashes, one, two, place, low, high, doc = (x[order] for x in (hashes, one, two, place, low, high, doc))
    new = np.ones(len(place), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (np.diff(high - low) != 0)
    again = np.flatnonzero(~new)
    new[again] = ~kernels.same_spans(data, low[again], data, low[again - 1], (high - low)[again])
    return data, offsets, hashes[new], np.stack([one[new], two[new]]), place[new], low[new], high[new], doc[new], low[~new], high[~new]


def flags(hashes: np.ndarray, contexts: np.ndarray, docs: np.ndarray, chunks: np.ndarray, more: np.ndarray, many: int = MANY) -> np.ndarray:
    """0: nothing to do, 1: the same context stands earlier, 2: first of its context, but the anchor has others; and 4 if it has over ``many``, with ``more`` that were not sent. contexts: two hashes each."""
    order = np.lexsort((chunks, docs, contexts[1], contexts[0], hashes))
    h, c = hashes[order], contexts[:, order]
    group = np.ones(len(h), bool)
    group[1:] = h[1:] != h[:-1]
    first = group.copy()
    first[1:] |= (c[:, 1:] != c[:, :-1]).any(0)
    which = np.cumsum(group) - 1
    total = np.bincount(which, first + more[order].astype(float))[which] if len(h) else np.zeros(0)
    out = np.zeros(len(h), np.uint8)
    out[order] = np.where(first, np.where(total > 1, 2, 0), 1) + 4 * (total > many)
    return out


def sent(hashes: np.ndarray, most: int = SENT) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted hashes the places of the first few of each, and how many others each of these stands for."""
    begins = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    size = np.diff(np.append(begins, len(hashes)))
    few = np.flatnonzero(kernels.ranges(size) < most)
    more = np.zeros(len(hashes), np.uint32)
    more[begins] = np.maximum(size - most, 0)
    return few, more[few]


def strings(data: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and documents of the strings around some anchors, each distinct one where it is first, by the first hash; and the starts of the others."""
    last = np.minimum(place, high - length)
    count = np.maximum(last - low + 1, 0)
    starts = np.repeat(low, count) + kernels.ranges(count)
    starts, own = np.unique(starts, return_index=True)
    docs = np.repeat(docs, count)[own]
    words = kernels.loads(data)
    one, two = (kernels.span_hash(data, starts, starts + length, salt, words) for salt in (3, 4))
    order = np.lexsort((starts, docs, two, one))
    one, two, starts, docs = one[order], two[order], starts[order], docs[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return one[new], two[new], starts[new], docs[new], starts[~new]


class Suffixes:
    """Suffixes of one buffer, each with an end, sorted within groups."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.data, self.starts, self.lengths, self.exact = np.append(data, np.uint8(0)), starts, lengths, False
        self.powers = np.full(len(data) + 1, BASE, np.uint64)
        self.powers[0] = 1
        np.cumprod(self.powers, out=self.powers)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:-1], out=self.prefix[1:])

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common bytes of the suffixes x and y, by binary search over the prefix hashes."""
        if self.exact:
            return self.common(x, y)
        a, b = self.starts[x], self.starts[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.lengths[x], self.lengths[y])
        base_a, base_b, up_a, up_b = self.prefix[a], self.prefix[b], self.powers[a], self.powers[b]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (self.prefix[a + mid] - base_a) * up_b == (self.prefix[b + mid] - base_b) * up_a
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common bytes of the suffixes x and y, byte by byte."""
        words, limit = kernels.loads(self.data), np.minimum(self.lengths[x], self.lengths[y])
        out, own, at = np.zeros(len(x), np.int64), np.flatnonzero(limit), 0
        while len(own):
            other = words[self.starts[x[own]] + at] ^ words[self.starts[y[own]] + at]
            least = np.maximum(other & (~other + np.uint64(1)), np.uint64(1))
            out[own] = np.minimum(limit[own], at + np.where(other == 0, 8, np.log2(least.astype(float)).astype(np.int64) // 8))
            own, at = own[(other == 0) & (limit[own] > at + 8)], at + 8
        return out

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.extension(x, y)
        over_x, over_y = self.lengths[x] == n, self.lengths[y] == n
        a = np.where(over_x, -1, self.data[np.minimum(self.starts[x] + n, len(self.data) - 1)].astype(np.int64))
        b = np.where(over_y, -1, self.data[np.minimum(self.starts[y] + n, len(self.data) - 1)].astype(np.int64))
        return (a < b) | (or_equal & (a == b))

    def sort(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The order of the suffixes within their groups [begin, end), given for each suffix; a merge sort, all groups at once."""
        order = np.arange(len(begin))
        size, width = end - begin, 1
        while (size > width).any():
            own = np.flatnonzero(size > width)
            local = own - begin[own]
            run = local // width
            left = run % 2 == 0
            first = np.minimum(begin[own] + np.where(left, run + 1, run - 1) * width, end[own])
            low, high = first.copy(), np.minimum(first + width, end[own])
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                right = self.less(order[mid], order[own[open_]], ~left[open_])
                low[open_[right]] = mid[right] + 1
                high[open_[~right]] = mid[~right]
            merged = order.copy()
            merged[begin[own] + (run - run % 2) * width + local - run * width + low - first] = order[own]
            order, width = merged, 2 * width
        return order

    def neighbours(self, order: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, bool]:
        """Common bytes of each suffix in order with the one before it (-1 at a group's start), and whether the hashes say the same as the bytes."""
        out = np.full(len(order), -1, np.int64)
        at = np.flatnonzero(begin != np.arange(len(order)))
        out[at] = self.common(order[at - 1], order[at])
        return out, self.exact or np.array_equal(out[at], self.extension(order[at - 1], order[at]))


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order within their groups, and each one's common bytes with the one before. Where two strings share a hash, all is sorted again by bytes."""
    held = Suffixes(data, starts, lengths)
    order = held.sort(begin, end)
    common, right = held.neighbours(order, begin)
    if not right:
        held.exact = True
        order = held.sort(begin, end)
        common, _ = held.neighbours(order, begin)
    return order, common


def repeats(hashes: np.ndarray, rank: np.ndarray, data: np.ndarray, lengths: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context: the least and largest offset before its anchor at which a string starts that an earlier context (by rank) holds; (1, 0) if none."""
    gap = length - ANCHOR
    least, most = np.full(len(hashes), 1, np.int64), np.zeros(len(hashes), np.int64)
    if not len(hashes):
        return least, most
    by = np.lexsort((rank, hashes))
    offsets = np.cumsum(lengths) - lengths
    h, lengths, left, offsets = hashes[by], lengths[by], left[by], offsets[by]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    begins = np.flatnonzero(new)
    size = np.diff(np.append(begins, len(h)))
    begin, end = np.repeat(begins, size), np.repeat(begins + size, size)
    right_order, right_common = sorted_suffixes(data, offsets + left, lengths - left, begin, end)
    left_order, left_common = sorted_suffixes(data[::-1].copy(), len(data) - offsets - left, left, begin, end)
    found_least, found_most = np.full(len(h), gap + 1, np.int64), np.full(len(h), -1, np.int64)
    run_right, run_left = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    for before in range(gap + 1):
        run_right[right_order] = np.cumsum(right_common < length - before)
        run_left[left_order] = np.cumsum(left_common < before)
        able = np.flatnonzero((left >= before) & (lengths - left >= length - before) & (end - begin > 1))
        key = run_right[able] * np.int64(len(h) + 1) + run_left[able]
        order = np.argsort(key, kind="stable")  # earlier contexts stand first
        again = order[1:][key[order[1:]] == key[order[:-1]]]
        found_least[able[again]] = np.minimum(found_least[able[again]], before)
        found_most[able[again]] = before
    hit = found_most >= 0
    least[by[hit]], most[by[hit]] = found_least[hit], found_most[hit]
    return least, most


def repeated_spans(docs: DataFrame, folder: str, *, text: str, key: str, length: int, many: int) -> tuple[DataFrame, DataFrame]:
    """The chunks of docs, and for each chunk spans (starts and ends in its bytes) of repeated strings."""
    chunks = packed.Chunks(docs, folder, text, CHUNK_BYTES)
    buckets = packed.bucket_count(docs, text)

    def ask(chunk: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        _, _, hashes, context, _, _, _, doc, _, _ = local(rows, text, key, length)
        few, more = sent(hashes)
        hashes, context, doc = hashes[few], context[:, few], doc[few]
        order, cuts = packed.by_bucket(hashes, buckets)
        base = int(doc.min()) if len(doc) else 0
        wide = next(t for t in (np.uint16, np.uint32, np.uint64) if not len(doc) or int(doc.max()) - base <= np.iinfo(t).max)
        out: list[list] = [[] for _ in range(7)]
        for k in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[k] : cuts[k + 1]]
            ids = np.array([int(x) - base for x in doc[own]], wide) if wide is np.uint64 else (doc[own] - base).astype(wide)
            for column, value in zip(out, (int(k), chunk, (hashes[own] // np.uint64(buckets)).astype(np.uint32).tobytes(), context[:, own].tobytes(), ids.tobytes(), more[own].tobytes() if more[own].any() else b"", base), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *(pa.array(x, pa.binary()) for x in out[2:6]), pa.array(out[6], pa.int64())], ["bucket", "chunk", "hashes", "contexts", "docs", "more", "base"])

    def settle(asked: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint32) for x in packed.column(asked, "hashes")]
        n = np.array([len(x) for x in hashes])
        docs = []
        for x, base, count in zip(packed.column(asked, "docs"), packed.column(asked, "base"), n.tolist(), strict=True):
            ids = np.frombuffer(x, {2: np.uint16, 4: np.uint32, 8: np.uint64}[len(x) // count])
            docs.append((ids + np.uint64(base % 2**64)).astype(np.int64) if ids.dtype == np.uint64 else ids.astype(np.int64) + base)
        more = np.concatenate([np.frombuffer(x, np.uint32) if x else np.zeros(m, np.uint32) for x, m in zip(packed.column(asked, "more"), n.tolist(), strict=True)])
        out = flags(np.concatenate(hashes), np.concatenate([np.frombuffer(x, np.uint64).reshape(2, -1) for x in packed.column(asked, "contexts")], 1), np.concatenate(docs), np.repeat(asked.column("chunk").to_numpy(), n), more, many)
        cuts = np.cumsum(n) - n
        return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "flags": pa.array([out[a : a + m].tobytes() for a, m in zip(cuts, n, strict=True)], pa.binary())})

    asked = chunks.each(ask, "bucket int, chunk long, hashes binary, contexts binary, docs binary, more binary, base long")
    answers = packed.answered(asked, settle, "chunk long, bucket int, flags binary")

    def sift(chunk: int, rows: pa.Table, got: pa.Table) -> pa.Table:
        data, _, hashes, _, place, low, high, doc, low_again, high_again = local(rows, text, key, length)
        few, _ = sent(hashes)
        order, cuts = packed.by_bucket(hashes[few], buckets)
        flag = np.full(len(hashes), 2, np.uint8)  # what was not sent has others
        for k, x in zip(packed.column(got, "bucket"), packed.column(got, "flags"), strict=True):
            flag[few[order[cuts[k] : cuts[k + 1]]]] = np.frombuffer(x, np.uint8)
        begins = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
        heavy = (flag[begins] > 3)[np.cumsum(begins) - 1]
        flag &= 3
        by_string = heavy & (flag == 2)
        one, two, first, first_doc, again = strings(data, *(x[by_string] for x in (place, low, high, doc)), length) if by_string.any() else [place[:0]] * 5
        starts, ends = kernels.covered(np.concatenate([low_again, low[flag == 1], again]), np.concatenate([high_again, high[flag == 1], again + length]))
        out: list[list] = [[-1], [starts.astype(np.int64).tobytes()], [ends.astype(np.int64).tobytes()], [b""], [b""], [b""]]
        order, _ = packed.by_bucket(hashes, buckets)
        mine = order[(flag[order] == 2) & ~heavy[order]]
        bucket = (hashes[mine] % np.uint64(buckets)).astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = mine[a:b]
            sizes = high[own] - low[own]
            for column, value in zip(out, (int(bucket[a]), hashes[own].tobytes(), place[own].astype(np.int64).tobytes(), doc[own].tobytes(), np.stack([place[own] - low[own], sizes]).astype(np.uint16).tobytes(), kernels.gather(data, low[own], sizes).tobytes()), strict=True):
                column.append(value)
        order, cuts = packed.by_bucket(one, buckets) if len(one) else (one, np.zeros(1, np.int64))
        for k in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[k] : cuts[k + 1]]
            for column, value in zip(out, (-2 - int(k), np.stack([one[own], two[own]]).tobytes(), first[own].astype(np.int64).tobytes(), first_doc[own].tobytes(), b"", b""), strict=True):
                column.append(value)
        n = len(out[0])
        return pa.table({"bucket": pa.array(out[0], pa.int32()), "chunk": pa.array([chunk] * n, pa.int64()), **{c: pa.array(x, pa.binary()) for c, x in zip(("hashes", "places", "docs", "sizes", "bytes"), out[1:], strict=True)}})

    found = packed.table(chunks.with_answers(answers, sift, "bucket int, chunk long, hashes binary, places binary, docs binary, sizes binary, bytes binary"), folder, "contexts")

    def compare(asked: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(x, kind) for x in packed.column(asked, name)]
        hashes, places, docs = read("hashes", np.uint64), read("places", np.int64), read("docs", np.int64)
        n = np.array([len(x) for x in hashes])
        left, sizes = (np.concatenate([x.reshape(2, -1)[i] for x in read("sizes", np.uint16)]).astype(np.int64) for i in (0, 1))
        place, chunk = np.concatenate(places), np.repeat(asked.column("chunk").to_numpy(), n)
        rank = np.empty(len(place), np.int64)
        rank[np.lexsort((place, chunk, np.concatenate(docs)))] = np.arange(len(place))
        least, most = repeats(np.concatenate(hashes), rank, np.concatenate(read("bytes", np.uint8)), sizes, left, length)
        starts, ends = place - most, place - least + length
        cuts = np.cumsum(n) - n
        keep = [(a + np.flatnonzero(most[a : a + m] >= least[a : a + m])) for a, m in zip(cuts, n, strict=True)]
        return pa.table({"chunk": asked.column("chunk"), "starts": pa.array([starts[k].tobytes() for k in keep], pa.binary()), "ends": pa.array([ends[k].tobytes() for k in keep], pa.binary())})

    def earlier(asked: pa.Table) -> pa.Table:
        one, two = (np.concatenate([np.frombuffer(x, np.uint64).reshape(2, -1)[i] for x in packed.column(asked, "hashes")]) for i in (0, 1))
        places, docs = ([np.frombuffer(x, np.int64) for x in packed.column(asked, c)] for c in ("places", "docs"))
        n = np.array([len(x) for x in places])
        place = np.concatenate(places)
        order = np.lexsort((place, np.repeat(asked.column("chunk").to_numpy(), n), np.concatenate(docs), two, one))
        again = np.zeros(len(place), bool)
        again[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        cuts = np.cumsum(n) - n
        spans = [kernels.covered(x, x + length) for x in (np.sort(place[a : a + m][again[a : a + m]]) for a, m in zip(cuts, n, strict=True))]
        return pa.table({"chunk": asked.column("chunk"), **{c: pa.array([x[i].tobytes() for x in spans], pa.binary()) for i, c in enumerate(("starts", "ends"))}})

    schema = "chunk long, starts binary, ends binary"
    by_string = packed.answered(found.filter("bucket < -1"), earlier, schema)
    compared = packed.answered(found.filter("bucket >= 0"), compare, schema)
    settled = found.filter("bucket = -1").select("chunk", F.col("hashes").alias("starts"), F.col("places").alias("ends"))
    return chunks, settled.union(compared).union(by_string)


def remove_repeats(docs: DataFrame, folder: str | None = None, *, text: str = "text", key: str = "doc_id", length: int = 100, keep: Sequence[str] = ("doc_id",), characters: bool = False, many: int = MANY) -> DataFrame:
    """The columns in keep, n_bytes, n_removed and n_spans (long), and kept (binary: the remaining bytes, end to end) for each row of docs.

    With characters, kept is a string: a character that a cut splits goes whole.
    """
    folder = folder or packed.shared_folder(docs.sparkSession)
    docs = docs.select(*dict.fromkeys([*keep, key, text]))
    chunks, spans = repeated_spans(docs, folder, text=text, key=key, length=length, many=many)
    fields = [f for f in docs.schema.fields if f.name in keep]

    def cut(chunk: int, rows: pa.Table, got: pa.Table) -> pa.Table:
        data, offsets = kernels.column_bytes(rows.column(text))
        starts, ends = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in packed.column(got, c))]) for c in ("starts", "ends"))
        edges = np.zeros(len(data) + 1, np.int8)
        starts, ends = kernels.covered(starts, ends)
        edges[starts] += 1
        edges[ends] -= 1
        gone = np.cumsum(edges[:-1], dtype=np.int8) > 0
        # a run never crosses from one text into the next, even where both touch
        begins, stops = gone.copy(), gone.copy()
        begins[1:] &= ~gone[:-1]
        stops[:-1] &= ~gone[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begins[inner], stops[inner - 1] = gone[inner], gone[inner - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        text_of = np.searchsorted(offsets, starts, side="right") - 1
        total, runs = (np.bincount(text_of, x, len(offsets) - 1).astype(np.int64) for x in (ends - starts, None))
        bounds = offsets - np.concatenate([[0], np.cumsum(total)])
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data[~gone].tobytes())])
        return pa.table({**{f.name: rows.column(f.name) for f in fields}, "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(total), "n_spans": pa.array(runs), "kept": pa.array([x.as_py().decode(errors="ignore") for x in kept], pa.string()) if characters else kept.cast(pa.binary())})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"n_bytes long, n_removed long, n_spans long, kept {'string' if characters else 'binary'}"])
    return chunks.with_answers(spans, cut, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
