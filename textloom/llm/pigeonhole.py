"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e edits is cut into e + 1 pieces; wherever the item stands in a text with at most e edits, one
piece stands there unchanged. The pieces of all items are found in one pass by an Aho-Corasick automaton, and every hit is
verified on the window around it with Myers' bit-parallel edit distance. Both sides are compared in lower case with each run of
white space as one space.

The items are a query set: their distinct texts are read in blocks of about ``block_bytes``, each block is one pass over the texts,
and its matches are written before the next block is read, so that what the driver and a task hold does not grow with the benchmark.

Null or empty texts and items match nothing. Items under ``1 / rate`` characters have no budget: they must stand unchanged, and with
``whole_words`` (a parameter) between word edges, as a short item would otherwise be found inside words. Repeated items and repeated
rows each give their own matches.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import packed

#: Edits allowed for each character of an item.
RATE = 0.05
#: Bytes of item texts in a block.
BLOCK_BYTES = 4 << 20


def plain(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip().lower()


def distance_within(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of text, and where the first such part ends (Myers' bit vectors)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, where = m, 0
    for j, c in enumerate(text, 1):
        equal = masks.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, where = score, j
    return best, where


class Matcher:
    """The automaton of a block of items (id, text)."""

    def __init__(self, items: Sequence[tuple[int, str | None]], rate: float = RATE, whole_words: bool = True):
        import ahocorasick

        self.whole_words = whole_words
        self.items = [(i, text, int(len(text) * rate)) for i, text in ((i, plain(t)) for i, t in items) if text]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget) in enumerate(self.items):
            cuts = [len(text) * p // (budget + 1) for p in range(budget + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces.setdefault(text[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def matches(self, text: str | None) -> dict[int, int]:
        """Index of each item that stands in text, and its least distance."""
        text = plain(text)
        found: dict[int, int] = {}
        seen: set[tuple[int, int]] = set()
        if not self.items or not text:
            return found
        for end, (size, uses) in self.automaton.iter(text):
            for k, offset in uses:
                start = end + 1 - size - offset
                _, item, budget = self.items[k]
                if found.get(k) == 0 or (k, start) in seen:
                    continue
                seen.add((k, start))
                if not budget:
                    stop = start + len(item)
                    if not self.whole_words or (start == 0 or not text[start - 1].isalnum()) and (stop == len(text) or not text[stop].isalnum()):
                        found[k] = 0
                    continue
                window = text[max(0, start - budget) : start + len(item) + budget]
                best = 0 if item in window else distance_within(item, window)[0]
                if best <= min(budget, found.get(k, budget)):
                    found[k] = best
        return found


def item_texts(items: DataFrame, item_text: str, folder: str) -> DataFrame:
    """(rep long, text) for every distinct text of the items."""
    texts = items.select(F.col(item_text).alias("text")).filter("text is not null").distinct()
    return packed.table(texts.select(F.monotonically_increasing_id().alias("rep"), "text"), folder, "items")


def item_blocks(texts: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    """The texts in blocks, one at a time on the driver."""
    blocks = max(1, math.ceil((texts.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) / block_bytes))
    for b in range(blocks):
        yield [tuple(r) for r in texts.filter(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == b).collect()]


def hits(docs: DataFrame, block: list, *, text: str, key: str, rate: float, whole_words: bool) -> DataFrame:
    """(key, rep long, distance int) for every item of a block that stands in a row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block, rate, whole_words)
        for batch in batches:
            out: list[tuple] = []
            for row, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out += [(row, matcher.items[k][0], best) for k, best in sorted(matcher.matches(x.as_py()).items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=[key, "rep", "distance"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, f"`{key}` long, rep long, distance int")


def matches(docs: DataFrame, items: DataFrame, folder: str | None = None, *, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", rate: float = RATE, whole_words: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, item_key, distance int) for every item that stands in a row of docs with at most rate edits for each of its characters."""
    folder = folder or packed.shared_folder(docs.sparkSession)
    texts = item_texts(items, item_text, folder)
    found = [packed.table(hits(docs, block, text=text, key=key, rate=rate, whole_words=whole_words), folder, f"hits{b}") for b, block in enumerate(item_blocks(texts, block_bytes))]
    ids = items.select(F.col(item_key).cast("long").alias(item_key), F.col(item_text).alias("text")).join(texts, "text").select("rep", item_key)
    return functools.reduce(DataFrame.union, found).join(ids, "rep").select(key, item_key, "distance")


def without_matches(docs: DataFrame, items: DataFrame, folder: str | None = None, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = RATE, whole_words: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no item stands. Of several blocks each drops its rows from what the one before has left."""
    folder = folder or packed.shared_folder(docs.sparkSession)
    for b, block in enumerate(item_blocks(item_texts(items, item_text, folder), block_bytes)):
        if b:
            docs = packed.table(docs, folder, f"left{b}")

        def run(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate, whole_words)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
