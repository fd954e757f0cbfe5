"""Quality filtering by weak supervision.

Nine rules look at a text and vote good, vote bad or abstain. Nobody has labelled anything: expectation-maximisation over the votes
estimates how often each rule votes what on good and on bad texts, and the posterior probability of being good takes the place of a
filter that every rule must pass. The rules' votes make at most 3 ** 9 patterns, so the estimate needs the count of each pattern and
nothing else: the corpus is read once, and what reaches the driver is bounded by the number of rules.

Null, empty and blank texts have no words, fail the base rule and are not kept. Texts of any length are read whole. Repeated rows
are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels, packed

GOOD, BAD, NONE = 0, 1, 2
WINDOW = 5
#: Symbols that the base counts.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"[#*$%&|<>]"[1:-1])] = True
UPPER, LETTERS, MARKS = (np.zeros(256, bool) for _ in range(3))
UPPER[65:91] = True
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
MARKS[list(b".!?")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bare", "n_marks")
#: For each rule: what it looks at; at or past which value it votes good and bad (below or above by their order); else it abstains.
RULES = {
    "length": (lambda f: f["n_words"], 50, 20),
    "word_length": (lambda f: np.abs(f["word_chars"] / np.maximum(f["n_words"], 1) - 5.5), 2.5, 4.5),
    "symbols": (lambda f: f["n_symbols"] / np.maximum(f["n_words"], 1), 0.02, 0.2),
    "duplicate_lines": (lambda f: f["n_dup_lines"] / np.maximum(f["n_lines"], 1), 0.1, 0.3),
    "repeats": (lambda f: f["n_repeat_words"] / np.maximum(f["n_words"], 1), 0.02, 0.1),
    "shouting": (lambda f: f["n_upper"] / np.maximum(f["n_letters"], 1), 0.12, 0.4),
    "letters": (lambda f: f["n_letters"] / np.maximum(f["n_bytes"], 1), 0.75, 0.6),
    "bare_marks": (lambda f: f["n_bare"] / np.maximum(f["n_words"], 1), 0.03, 0.12),
    "marks": (lambda f: np.abs(np.log2(f["n_marks"] / np.maximum(f["n_words"], 1) / 0.067 + 1e-9)), 2.16, 3.16),
}


def _sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])[bounds])


def repeated_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text (words first[k] to first[k + 1]) its words in a window of five that it holds at least twice.

    Windows whose hash comes again are told apart by the bytes of their words.
    """
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.zeros(len(first) - 1, np.int64)
    text = np.searchsorted(first, np.arange(n), side="right") - 1
    inside = np.flatnonzero(np.arange(n) + WINDOW <= first[text + 1])
    windows = kernels.shingles(hashes, WINDOW)[inside] ^ kernels.mix(text[inside].astype(np.uint64), 80)
    ordered = np.sort(windows)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.zeros(len(first) - 1, np.int64)
    at = np.minimum(np.searchsorted(again, windows), len(again) - 1)
    maybe = inside[again[at] == windows]
    words = np.unique((maybe[:, None] + np.arange(WINDOW)).ravel())
    _, exact = kernels.distinct(data, starts[words], ends[words], hashes[words])
    five = exact[np.searchsorted(words, maybe[:, None] + np.arange(WINDOW))]
    _, own, counts = np.unique(np.column_stack([text[maybe], five]), axis=0, return_inverse=True, return_counts=True)
    hit = maybe[counts[own.ravel()] > 1]
    edges = np.zeros(len(hashes) + 1, np.int32)
    edges[hit] += 1
    edges[hit + WINDOW] -= 1
    return _sums(np.cumsum(edges[:-1]) > 0, first)


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and n_bytes of every text. Words and lines are found by hashes and told apart by bytes."""
    data, offsets = kernels.column_bytes(column)
    parts = [_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in kernels.slices(offsets)]
    return {c: np.concatenate([np.zeros(0, np.int64), *(p[c] for p in parts)]) for c in (*COUNTS, "n_bytes")}


def _counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    out = {c: np.zeros(n, np.int64) for c in (*COUNTS, "n_bytes")}
    breaks = np.flatnonzero(data == 10)
    spans, hashes = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], [np.zeros(0, np.uint64)]
    for part, a, starts, ends in kernels.words_of(data, offsets, lower=False):
        b = a + len(part)
        low = int(np.searchsorted(offsets, a, side="right")) - 1
        high = int(np.searchsorted(offsets, b))
        bounds = np.clip(offsets[low : high + 1] - a, 0, b - a)
        solid = ~kernels.SPACE[part]
        bare = np.zeros(len(part), bool)
        bare[starts[ends - starts == 1]] = True
        for name, mask in (("word_chars", solid & ((part & 0xC0) != 0x80)), ("n_symbols", SYMBOLS[part]), ("n_upper", UPPER[part]), ("n_letters", LETTERS[part]), ("n_bare", bare & ~LETTERS[part]), ("n_marks", MARKS[part]), ("n_bytes", solid)):
            out[name][low:high] += _sums(mask, bounds)
        spans.append((starts + a, ends + a))
        hashes.append(kernels.span_hash(part, starts, ends))
    starts, ends = (np.concatenate(x) for x in zip(*spans, strict=True))
    first = np.searchsorted(starts, offsets)
    out["n_words"] = np.diff(first)
    out["n_repeat_words"] = repeated_words(data, starts, ends, np.concatenate(hashes), first)
    # lines with a word: where each word's line begins, once for each
    text = np.repeat(np.arange(n), np.diff(first))
    begin = np.maximum(np.append(breaks + 1, 0)[np.searchsorted(breaks, starts) - 1], offsets[text])
    new = np.append(True, begin[1:] != begin[:-1])[: len(begin)]
    begin, text = begin[new], text[new]
    end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begin)], offsets[text + 1])
    _, line = kernels.distinct(data, begin, end, kernels.span_hash(data, begin, end))
    out["n_lines"] = np.bincount(text, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(np.unique(text * (len(begin) + 1) + line) // (len(begin) + 1), minlength=n)
    return out


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """The rules' votes as one number with a base-3 digit for each rule."""
    out, scale = np.zeros(len(found["n_words"]), np.int64), 1
    for look, good, bad in RULES.values():
        value = look(found)
        up = good > bad
        out += scale * np.where(value >= good if up else value <= good, GOOD, np.where(value <= bad if up else value >= bad, BAD, NONE))
        scale *= 3
    return out


def estimate(patterns: Sequence[int], counts: Sequence[int], rounds: int = 100, prior: float = 0.85) -> np.ndarray:
    """The posterior probability of being good for every pattern, by expectation-maximisation over the counted ones.

    It starts from the belief that a text with no bad vote is good, and that each bad vote speaks against it. Rules are taken as
    independent given the truth; smoothing keeps every rule's rates off 0 and 1.
    """
    rules = len(RULES)
    digits = lambda x: np.asarray(x, np.int64)[:, None] // 3 ** np.arange(rules) % 3
    every, own, weight = digits(np.arange(3**rules)), digits(patterns), np.asarray(counts, float)
    good = np.clip(0.97 - 0.45 * (own == BAD).sum(1), 0.03, 0.97)
    share, rates = prior, np.zeros((2, rules, 3))
    for _ in range(rounds if weight.sum() else 0):
        before = good
        for y, belief in enumerate((good, 1 - good)):
            for vote in range(3):
                rates[y, :, vote] = 1.0 + (weight * belief) @ (own == vote)
        rates /= rates.sum(2, keepdims=True)
        share = (weight @ good + 1) / (weight.sum() + 2)
        logs = [np.log(p) + np.log(rates[y])[np.arange(rules), own].sum(1) for y, p in enumerate((share, 1 - share))]
        good = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
        if np.abs(good - before).max() < 1e-6:
            break
    if not weight.sum():
        return np.full(3**rules, prior)
    logs = [np.log(p) + np.log(rates[y])[np.arange(rules), every].sum(1) for y, p in enumerate((share, 1 - share))]
    return 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))


def judge(docs: DataFrame, folder: str | None = None, *, text: str = "text", keep: Sequence[str] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """The columns in keep, the counts of every row, base_failed, quality double (the posterior) and kept boolean."""
    folder = folder or packed.shared_folder(docs.sparkSession)
    docs = docs.select(*dict.fromkeys([*keep, text]))
    fields = [f for f in docs.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_counts(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in fields), *(pa.array(found[c], pa.int64()) for c in COUNTS), pa.array(votes(found), pa.int64())], names=[*(f.name for f in fields), *COUNTS, "pattern"])
            kernels.tidy()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} long" for c in COUNTS), "pattern long"])
    rows = packed.table(docs.mapInArrow(run, schema), folder, "votes").withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    counted = rows.filter("not base_failed").groupBy("pattern").agg(F.count("*").alias("n")).collect()  # at most 3 ** 9 rows
    posterior = estimate([r["pattern"] for r in counted], [r["n"] for r in counted])
    spark = docs.sparkSession
    judged = F.broadcast(spark.createDataFrame([(r["pattern"], float(posterior[r["pattern"]])) for r in counted], "pattern long, quality double"))
    return rows.join(judged, "pattern", "left").withColumn("kept", F.expr(f"not base_failed and coalesce(quality, 0) >= {least}"))


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
