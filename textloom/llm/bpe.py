"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Each chunk of texts cuts its texts into pre-tokens, keeps their positions, and sends every distinct one that is not itself a
token to a hash bucket. A bucket encodes each distinct word once, whatever number of chunks sent it, and the chunk puts the ids
back by position. Decoding gathers the bytes of the ids from the token-byte table. Words are found by hashes, but told apart by bytes.

Nulls and empty texts have no ids. Repeated rows each get their own row. A very long text stays one row of one chunk, but its words
are cut in pieces between two matches of the pattern. Columns of other tables that clash by name don't matter: only ``text`` is read, ``keep`` is carried.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels, packed

SPACE, WHITE, LETTER, NUMBER, OTHER = range(5)
#: What may follow an apostrophe at the start of a pre-token; fixed by the pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(maxsize=2)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens in the order of their ids, and each one's start and length."""
    by_id = {i: t for t, i in ranks(path).items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    lengths = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


@functools.lru_cache(maxsize=2)
def whole_tokens(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens in ascending order, and their ids."""
    data, starts, lengths = token_table(path)
    hashes = kernels.span_hash(data, starts, starts + lengths)
    order = np.argsort(hashes)
    return hashes[order], order


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the pattern's library."""
    import regex

    at = np.concatenate([np.arange(0xD800, dtype=np.uint32), np.arange(0xE000, 0x110000, dtype=np.uint32)])
    text, out = at.tobytes().decode("utf-32-le"), np.full(0x110000, OTHER, np.uint8)
    for kind, what in ((WHITE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(what, text):
            out[at[m.start() : m.end()]] = kind
    out[0x20] = SPACE
    return out


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the characters of UTF-8 texts begin, their code points and classes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    point = lead.astype(np.int32)
    for floor, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        pick = np.flatnonzero((lead >= floor) & (lead < (0xE0, 0xF0, 0x100)[more - 1]))
        value = (lead[pick] & mask).astype(np.int32)
        for k in range(1, more + 1):
            value = (value << 6) | (data[at[pick] + k] & 0x3F)
        point[pick] = value
    return at, point, classes()[point]


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE bytes that no match of the pattern crosses: they end with a text, or where a character without white
    space is followed by white space or by one of another class (unless that may be a contraction)."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + kernels.SLICE)
        while b < n:
            edge = int(offsets[np.searchsorted(offsets, b)])
            lead = np.flatnonzero((data[b : b + 4] & 0xC0) != 0x80)
            low = b + int(lead[0]) if len(lead) else n
            high = min(n, low + 4096)
            while high < n and data[high] & 0xC0 == 0x80:
                high += 1
            at, point, kind = characters(data[low:high])
            turn = np.flatnonzero((kind[:-1] > WHITE) & (kind[1:] != kind[:-1]) & ~((point[:-1] == 0x27) & (kind[1:] == LETTER)))
            found = min(edge, low + int(at[turn[0] + 1]) if len(turn) else n)
            if found <= high or found == n:
                b = found
                break
            b = high
        yield a, b
        a = b


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the matches of the pattern start in UTF-8 texts; each ends where the next starts or its text ends."""
    at, point, kind = characters(data)
    n = len(at)
    if not n:
        return at
    first = np.zeros(n + 1, bool)  # of a text
    first[np.searchsorted(at, offsets)] = True
    white = kind <= WHITE
    group = np.where(white, WHITE, kind)
    run = first[:n].copy()
    run[1:] |= group[1:] != group[:-1]
    run[0] = True
    after_white = np.zeros(n, bool)
    after_white[1:] = white[:-1] & ~first[1:n]
    after_space = np.zeros(n, bool)
    after_space[1:] = (kind[:-1] == SPACE) & ~first[1:n]
    start = run & (white | ~after_white | ~after_space)
    # the last white character before a word stands apart from those before it
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    start |= last
    # contractions: a single apostrophe that starts a pre-token, with a letter after it
    tick = np.flatnonzero((point == 0x27) & start & ~last & run)
    tick = tick[tick + 1 < n]
    tick = tick[(kind[tick + 1] == LETTER) & ~first[tick + 1]]
    padded = np.append(point, [0, 0])
    ends = np.append(first, [True, True])
    taken = np.zeros(len(tick), np.int64)
    for tail in CONTRACTIONS:
        same = padded[tick + 1] == ord(tail[0])
        if len(tail) > 1:
            same &= (padded[tick + 2] == ord(tail[1])) & ~ends[tick + 2]
        taken[same & (taken == 0)] = len(tail)
    tick, taken = tick[taken > 0], taken[taken > 0]
    start[tick + 1] = False
    rest = tick + 1 + taken
    start[rest[rest < n]] = True
    return at[start]


def chunk_words(rows: pa.Table, text: str, path: str):
    """Pre-tokens of a chunk: bytes, first pre-token of each text, distinct words' starts and ends, which are tokens (id, else -1), index by position, hashes.

    Words are found by a hash and told apart by their bytes.
    """
    data, offsets = kernels.column_bytes(rows.column(text))
    first, seen, total = np.zeros(len(offsets), np.int64), 0, 0

    def spans() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        nonlocal seen, total
        for a, b in pieces(data, offsets):
            upto = int(np.searchsorted(offsets, b, side="right"))
            inside = np.unique(np.clip(offsets[max(0, seen - 1) : upto + 1], a, b)) - a
            starts = pre_tokens(data[a:b], inside)
            first[seen:upto] = total + np.searchsorted(starts, offsets[seen:upto] - a)
            seen, total = upto, total + len(starts)
            yield a, b, starts, np.append(starts[1:], b - a)[: len(starts)]

    starts, ends, keys, inverse = kernels.gathered(data, spans())
    first[seen:] = total
    vocabulary, ids = whole_tokens(path)
    tokens, token_starts, token_sizes = token_table(path)
    at = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
    hit = np.flatnonzero((vocabulary[at] == keys) & (token_sizes[ids[at]] == ends - starts))
    hit = hit[kernels.same_spans(data, starts[hit], tokens, token_starts[ids[at[hit]]], (ends - starts)[hit])]
    known = np.full(len(keys), -1, np.int64)
    known[hit] = ids[at[hit]]
    return data, first, starts, ends, known, inverse, keys


def encode(docs: DataFrame, folder: str | None = None, *, text: str = "text", keep: Sequence[str] = ("doc_id",), ranks_path: str | None = None) -> DataFrame:
    """The columns in keep, n_tokens long and ids binary (little-endian unsigned 32-bit integers) for each row of docs."""
    path = ranks_path or default_ranks()
    folder = folder or packed.shared_folder(docs.sparkSession)
    docs = docs.select(*keep, *([text] if text not in keep else []))
    chunks = packed.Chunks(docs, folder, text, one_query=True)
    buckets = packed.bucket_count(docs, text)

    def ask(chunk: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        data, _, starts, ends, known, _, keys = chunk_words(rows, text, path)
        new = np.flatnonzero(known < 0)
        order, cuts = packed.by_bucket(keys[new], buckets)
        out: list[list] = [[], [], [], []]
        for k in np.flatnonzero(np.diff(cuts)):
            own = new[order[cuts[k] : cuts[k + 1]]]
            lengths = ends[own] - starts[own]
            for column, value in zip(out, (int(k), chunk, packed.squeeze(lengths.astype(np.uint32).tobytes()), packed.squeeze(kernels.gather(data, starts[own], lengths).tobytes())), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["bucket", "chunk", "lengths", "words"])

    def answer(asked: pa.Table) -> pa.Table:
        memo: dict[bytes, bytes] = {}
        own = encoding(path)
        counts, ids = [], []
        for lengths, words in zip(packed.column(asked, "lengths"), packed.column(asked, "words"), strict=True):
            at, found, words = 0, [], packed.expand(words)
            for n in np.frombuffer(packed.expand(lengths), np.uint32).tolist():
                word = words[at : at + n]
                at += n
                got = memo.get(word)
                if got is None:
                    got = memo[word] = array("I", own.encode_ordinary(word.decode())).tobytes()
                found.append(got)
            counts.append(packed.squeeze((np.array([len(x) for x in found], np.uint32) // 4).astype(np.uint32).tobytes()))
            ids.append(packed.squeeze(b"".join(found)))
        return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "counts": pa.array(counts, pa.binary()), "ids": pa.array(ids, pa.binary())})

    asked = chunks.each(ask, "bucket int, chunk long, lengths binary, words binary")
    answers = packed.answered(asked, answer, "chunk long, bucket int, counts binary, ids binary")
    fields = [f for f in docs.schema.fields if f.name in keep]

    def place(chunk: int, rows: pa.Table, got: pa.Table) -> pa.Table:
        _, first, _, _, known, inverse, keys = chunk_words(rows, text, path)
        new = np.flatnonzero(known < 0)
        order, cuts = packed.by_bucket(keys[new], buckets)
        counts = np.ones(len(known), np.int64)
        parts, begin, total = [known[known >= 0].astype(np.uint32)], np.zeros(len(known), np.int64), int((known >= 0).sum())
        begin[known >= 0] = np.arange(total)
        for k, n, ids in zip(packed.column(got, "bucket"), packed.column(got, "counts"), packed.column(got, "ids"), strict=True):
            own = new[order[cuts[k] : cuts[k + 1]]]
            n = np.frombuffer(packed.expand(n), np.uint32).astype(np.int64)
            counts[own] = n
            begin[own] = total + np.cumsum(n) - n
            parts.append(np.frombuffer(packed.expand(ids), np.uint32))
            total += len(parts[-1])
        flat = np.concatenate(parts)
        each = counts[inverse]
        bounds = np.concatenate([[0], np.cumsum(each)])[first]
        ids = np.empty(bounds[-1], np.uint32)
        for a, b in kernels.slices(bounds):
            own = slice(first[a], first[b])
            ids[bounds[a] : bounds[b]] = kernels.gather(flat, begin[inverse[own]], each[own])
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
        return pa.table({**{f.name: rows.column(f.name) for f in fields}, "n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids": raw.cast(pa.binary())})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long", "ids binary"])
    return chunks.with_answers(answers, place, schema)


def decode(encoded: DataFrame, *, ids: str = "ids", name: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """encoded with the bytes of its ids (null and empty ids: none)."""
    path = ranks_path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, lengths = token_table(path)
        for batch in batches:
            raw, offsets = kernels.column_bytes(batch.column(batch.schema.get_field_index(ids)))
            parts, bounds = [], [np.zeros(1, np.int64)]
            for a, b in kernels.slices(offsets):
                which = raw[offsets[a] : offsets[b]].copy().view(np.uint32)
                size = lengths[which]
                bounds.append(np.concatenate([[0], np.cumsum(size)])[(offsets[a + 1 : b + 1] - offsets[a]) // 4] + bounds[-1][-1])
                parts.append(kernels.gather(data, starts[which], size).tobytes())
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(np.concatenate(bounds).tobytes()), pa.py_buffer(b"".join(parts))])
            yield pa.RecordBatch.from_arrays([*batch.columns, out.cast(pa.binary())], [*batch.schema.names, name])
            kernels.tidy()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields), f"`{name}` binary"])
    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs."""
    both = decode(encode(docs))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
