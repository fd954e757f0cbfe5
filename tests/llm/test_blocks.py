"""Block-anchored deduplication against a brute force over all windows."""

import hashlib
import random
import re

import numpy as np

from textloom.llm import blocks, kernels, packed

SCHEMA = "doc_id long, text string, lang string, source string, chunk string, bucket string, kept string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    """(doc_id, n_words, n_removed, digest) for every row; null ids are the smallest."""
    key = lambda i: float("-inf") if i is None else i
    least, out = {}, []
    split = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in split:
        for k in range(len(w) - size + 1):
            window = tuple(w[k : k + size])
            least[window] = min(least.get(window, key(i)), key(i))
    for i, w in split:
        gone = bytearray(len(w))
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < key(i):
                gone[k : k + size] = b"\1" * size
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


def sample():
    random.seed(7)
    vocabulary = ["".join(random.choice("abcdé") for _ in range(random.randrange(1, 6))) for _ in range(60)]
    text = lambda n: [random.choice(vocabulary) for _ in range(n)]
    long, hot = text(400), text(70)
    texts = [None, "", " \n\t\v ", "one", " ".join(text(49)), " ".join(text(50)), "x " * 300, " ".join(long)]
    for k in range(40):
        a, n = random.randrange(300), random.choice([48, 49, 50, 51, 75, 99, 100])
        texts.append(random.choice([" ", "\n"]).join([*text(random.randrange(60)), *long[a : a + n], *text(random.randrange(60))]))
        texts.append(" ".join([*text(k), *hot[k % 5 :], *text(40 - k)]))
    texts += [texts[9], texts[9], texts[10] + " tail", " ".join(hot).upper(), "x " * 60, "x " * 49, " ".join(hot[:49]), " ".join(hot[-50:]), " ".join(long[:60] + long[:60])]
    rows = [(k, t) for k, t in enumerate(texts)]
    random.shuffle(rows)
    rows += [(7, texts[7]), (7, " ".join(hot)), (None, texts[12]), (None, texts[12]), (-4, "head " + texts[14])]
    return [(i, t, "en", "s", "c", "b", "k", "n") for i, t in rows]


def test_op11_is_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame(sample(), SCHEMA).repartition(4)
    assert sorted((tuple(r) for r in blocks.query(docs).collect()), key=repr) == brute(sample(), 50)
    assert blocks.query(docs.limit(0)).count() == 0
    assert blocks.query(docs.filter("doc_id < 4")).filter("n_removed > 0").count() == 0


def test_spans_are_the_maximal_repeats(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(["a", *words[10:30], "b", *words[40:60]])), (3, " ".join(words[100:107] + ["c", "d"]))]
    got = {r["id"]: r for r in blocks.remove_repeats(spark.createDataFrame(rows, "id long, body string"), text="body", key="id", size=8, keep=("id",)).collect()}
    assert [tuple(s) for s in got[2]["spans"]] == [(1, 21), (22, 42)]
    assert (got[2]["kept"], got[3]["spans"], got[1]["n_removed"]) == ("a b", [], 0)


def test_other_window_sizes(spark):
    docs = spark.createDataFrame(sample(), SCHEMA).repartition(3)
    for size in (7, 32):
        got = sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in blocks.remove_repeats(docs, size=size).collect() if r["doc_id"] is not None)
        assert got == sorted(r for r in brute(sample(), size) if r[0] is not None)


def test_confused_cut_hashes_change_nothing(spark, monkeypatch):
    """With few bits nearly every window is a hit; the second exchange tells them apart."""
    monkeypatch.setattr(blocks, "cut_bits", lambda n_bytes, buckets: 6)
    docs = spark.createDataFrame(sample(), SCHEMA).repartition(2)
    assert sorted((tuple(r) for r in blocks.query(docs).collect()), key=repr) == brute(sample(), 50)


def test_rolling_hashes_are_of_the_words_alone(monkeypatch):
    random.seed(2)
    ids = np.array([random.randrange(3) for _ in range(3000)], np.uint64)
    hashes = kernels.mix(ids, 7)
    for k in (1, 2, 3, 5):
        rolled = blocks.rolling(hashes, k)
        windows = [tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1)]
        assert len(rolled) == len(windows) and len(set(zip(windows, rolled.tolist()))) == len(set(windows)) == len(set(rolled.tolist()))
    keys = np.sort(np.random.default_rng(1).integers(0, 2**32, 1000, np.uint64)).astype(np.uint32)
    assert (blocks.from_differences(blocks.to_differences(keys)) == keys).all()


def test_one_passage_in_many_documents_is_one_entry_a_chunk(spark, tmp_path):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.range(3000).selectExpr("id as doc_id", f"concat('d', id, ' ', '{passage}', ' e', id) as text").repartition(4)
    folder = f"file://{tmp_path}"
    chunks = packed.Chunks(docs, folder)
    own = blocks.Windows(300_000, 50, "text", "doc_id")
    asked = blocks.ask_windows(chunks, own, blocks.hits(blocks.ask_blocks(chunks, own)))
    sent = sum(len(blocks.from_differences(r["keys"])) for r in asked.collect())
    assert sent == 4 * 11 + 2 * 3000  # the passage's own windows once a chunk, and each document's two at its edges
    assert blocks.remove_repeats(docs, f"{folder}/b").selectExpr("sum(n_removed)").first()[0] == 60 * 2999
