"""Periodic runs against a brute force over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from textloom.llm import kernels, periods

SCHEMA = "doc_id long, text string, lang string, runs string, n_runs string, collapsed string, start string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                if j + q - i >= max(12, 2 * q):
                    found.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(kept)))


def sample():
    random.seed(4)
    texts = [None, "", " \n\t\v", "one", "a " * 11, "a " * 12, "x " * 5000, "a b " * 6, "A a " * 6, "ab\x1fcd " * 12, "é 中 😀 " * 9, "a b c d e f g " * 2, "so it goes on and on " * 3 + "end", "a a b a a b a a b a a b a a a a a a a a a a a a a a"]
    for _ in range(150):
        words = [random.choice("abcdefgh"[: random.choice([2, 3, 8])]) for _ in range(random.randrange(1, 120))]
        texts.append(random.choice([" ", "\n", "  "]).join(words))
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [rows[6], rows[13], (None, "a b " * 8)]
    return [(i, t, "en", "r", "n", "c", "s") for i, t in rows]


def test_op12_is_brute_force(spark):
    docs = spark.createDataFrame(sample(), SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in periods.query(docs).collect()), key=repr)
    assert got == sorted(((r[0], *expected(r[0], r[1])) for r in sample()), key=repr)
    assert sum(r[1] > 0 for r in got) > 20
    assert periods.query(docs.limit(0)).count() == 0


def test_runs_and_what_is_left_of_a_text(spark):
    docs = spark.createDataFrame([("k", "so it goes " * 5 + "and stops")], "id string, body string")
    row = periods.find(docs, key="id", text="body").first()
    assert (row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]) == (17, [(0, 15, 3)], "so it goes and stops")


def test_runs_of_random_sequences():
    random.seed(2)
    for _ in range(800):
        n, k = random.randrange(1, 100), random.choice([1, 2, 3, 5])
        words = [random.randrange(k) for _ in range(n)]
        if random.random() < 0.5:
            a = random.randrange(n)
            p = 1 + (n - a) // random.randrange(2, 9)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert periods.runs(np.array(words)) == brute(words)
        # the stretches that are searched hold every run
        assert periods.of_batch(pa.array([" ".join(map(str, words))]), [0])[1][0] == brute(words)


def test_z_function():
    random.seed(3)
    for _ in range(200):
        x = [random.randrange(2) for _ in range(random.randrange(1, 40))]
        assert periods.z_function(np.array(x)).tolist()[1:] == [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(1, len(x))]


def test_long_texts_go_through_in_pieces(monkeypatch):
    """Words are interned across the pieces that one text is read in; a text of one word is no worse than others."""
    monkeypatch.setattr(kernels, "SLICE", 64)
    words = ["alpha", "beta", "gamma", "delta"] * 200 + [f"w{k}" for k in range(300)]
    n, found, joined = periods.of_batch(pa.array([" ".join(words), "same " * 30000]), [0, 1])
    assert (n, found) == ([1100, 30000], [[(0, 800, 4)], [(0, 30000, 1)]])
    assert joined == [" ".join(words[:4] + words[800:]).encode(), b"same"]
