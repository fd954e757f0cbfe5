"""Numpy kernels over UTF-8 buffers: whole Arrow batches at a time, no Python loop over characters."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bytes of text that the kernels take at once; they need some hundred times as many bytes of memory.
SLICE = 1 << 19


def slices(offsets: np.ndarray, limit: int = SLICE) -> list[tuple[int, int]]:
    """Ranges of texts that together have at most limit bytes, or are one text."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        out.append((a, b))
        a = b
    return out


@functools.lru_cache(maxsize=1)
def _libc():
    return ctypes.CDLL(ctypes.util.find_library("c"))


def tidy() -> None:
    """Give freed memory back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        _libc().malloc_trim(0)
    except (AttributeError, OSError):  # another libc
        pass


#: Spans of more bytes than this are hashed one by one with BLAKE2b.
LONG = 512
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)


def loads(data: np.ndarray) -> np.ndarray:
    """At every place the next 8 bytes as one integer, with zeros behind the end; a view of a copy."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0, words: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the spans [start, end), alike wherever a span stands.

    Every 8 bytes go through a finaliser together with what came before, so that no arrangement of repeated parts cancels out, as it
    does in sums of powers modulo 2**64. Hashes with other salts are independent. words: loads(data), if at hand.
    """
    sizes = ends - starts
    out = mix(sizes.astype(U64), 60 + salt)
    long = np.flatnonzero(sizes > LONG)
    for k in long.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
    at, left, words = starts, np.where(sizes > LONG, 0, sizes), loads(data) if words is None else words
    own = np.flatnonzero(left)
    whole = len(own) == len(out)
    at, left = (at, left) if whole else (at[own], left[own])
    held = out if whole else out[own]
    while len(own):
        held = mix(held ^ (words[at] & _MASKS[np.minimum(left, 8)]), 61 + salt)
        out[own] = held
        more = left > 8
        own, at, left, held = own[more], at[more] + 8, left[more] - 8, held[more]
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes of data from starts on are those of other from others on, for so many bytes each."""
    out = np.ones(len(sizes), bool)
    a, b = loads(data), loads(other)
    own, at = np.flatnonzero(sizes), 0
    while len(own):
        left = sizes[own] - at
        out[own] &= (a[starts[own] + at] ^ b[others[own] + at]) & _MASKS[np.minimum(left, 8)] == 0
        own, at = own[out[own] & (left > 8)], at + 8
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct spans, in the order of their hashes, and each span's index among them; equal hashes are checked byte by byte."""
    _, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    inverse = inverse.astype(np.int32)
    sizes = ends - starts
    same = (sizes == sizes[place][inverse]) if len(place) else np.ones(0, bool)
    check = np.flatnonzero(same & (np.arange(len(starts)) != place[inverse])) if len(place) else np.zeros(0, np.int64)
    same[check] = same_spans(data, starts[check], data, starts[place[inverse[check]]], sizes[check])
    others: dict[bytes, int] = {}
    more: list[int] = []
    for k in np.flatnonzero(~same).tolist():
        word = data[starts[k] : ends[k]].tobytes()
        if word not in others:
            others[word] = len(place) + len(more)
            more.append(k)
        inverse[k] = others[word]
    if more:
        place = np.append(place, more)
        order = np.argsort(hashes[place], kind="stable")
        turned = np.empty(len(order), np.int32)
        turned[order] = np.arange(len(order))
        place, inverse = place[order], turned[inverse]
    return place, inverse


def gathered(data: np.ndarray, parts: Iterable[tuple[int, int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the distinct spans of some parts of data, in the order of their hashes, and each span's index among them.

    Parts are (from, to, starts, ends), the latter two counted from where the part begins; only one is looked at in full at a time.
    """
    starts, ends, hashes, index, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, np.int32)], 0
    for a, b, s, e in parts:
        part = data[a:b]
        h = span_hash(part, s, e)
        place, inverse = distinct(part, s, e, h)
        starts.append(s[place] + a)
        ends.append(e[place] + a)
        hashes.append(h[place])
        index.append(inverse + np.int32(total))
        total += len(place)
    s, e, h = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    place, inverse = distinct(data, s, e, h)
    return s[place], e[place], h[place], inverse[np.concatenate(index)]


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as one byte buffer and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space, and for each text the index of its first word (one more at the end)."""
    solid = ~SPACE[data]
    n = len(data)
    begins, ends = solid.copy(), solid.copy()
    if n:
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        begins[edge] |= solid[edge]
        ends[edge - 1] |= solid[edge - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def cuts(data: np.ndarray, offsets: np.ndarray, limit: int | None = None) -> list[tuple[int, int]]:
    """Ranges of about so many bytes that cut no word; a range holds any number of texts, and a long text goes through several."""
    limit = limit or SLICE
    out, a, n = [], 0, len(data)
    while a < n:
        b = min(n, a + limit)
        while b < n:
            white = np.flatnonzero(SPACE[data[b : b + limit]])
            edge = int(offsets[np.searchsorted(offsets, b)])
            found = min(edge, b + int(white[0]) if len(white) else n)
            if found <= b + limit or found == n:
                b = found
                break
            b = min(n, b + limit)
        out.append((a, b))
        a = b
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """The words of all texts in pieces: bytes, where they begin in data, and starts and ends in the piece."""
    for a, b in cuts(data, offsets):
        part = LOWER[data[a:b]] if lower else data[a:b]
        inside = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")] - a
        starts, ends, _ = word_spans(part, inside)
        yield part, a, starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the index of each text's first word."""
    out, first, total, seen = [np.zeros(0, U64)], np.zeros(len(offsets), np.int64), 0, 0
    for part, a, starts, ends in words_of(data, offsets, lower):
        out.append(span_hash(part, starts, ends))
        upto = int(np.searchsorted(offsets, a + len(part), side="right"))
        first[seen:upto] = total + np.searchsorted(starts, offsets[seen:upto] - a)
        seen, total = upto, total + len(starts)
    first[seen:] = total
    return np.concatenate(out), first


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one text; of the whole text if it has fewer words; none if it has none."""
    n = len(words)
    if not n:
        return np.zeros(0, U64)
    if n < k:
        h = U64(n)
        for w in words:
            h = mix(np.array([h]), 7)[0] ^ w
        return mix(np.array([h]), 11)
    h = words[: n - k + 1].copy()
    for j in range(1, k):
        h = mix(h, 5) + words[j : n - k + 1 + j]
    return mix(h, 13)


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after the other."""
    total = int(lengths.sum())
    out = np.arange(total)
    return out - np.repeat(np.cumsum(lengths) - lengths, lengths)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    return data[np.repeat(starts, lengths) + ranges(lengths)]


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that spans cover together; spans that touch are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The spans of each text (the index of its first one, and one more at the end) with a space between them."""
    sizes = ends - starts
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    spaced = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    spaced[np.repeat(begins, sizes) + ranges(sizes)] = gather(data, starts, sizes)
    edge = np.append(begins, len(spaced))[first]
    return [spaced[a : max(a, b - 1)].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
