"""Semantic chunks: against a plain reading of the rule, and on texts whose topics are known."""

import random
import re
import time

from textloom.operators import cohesion


def plain(text, window=3, reach=5, depth=0.2):
    s = [x for x in (p.strip(" ") for p in re.split(r"(?<=[.!?؟])\s+", text or "")) if x]
    w = [{t for t in re.split(r"[\W_]+", x.lower()) if len(t) >= 4} for x in s]
    c = []
    for i in range(1, len(s)):
        a, b = set().union(*w[max(0, i - window) : i]), set().union(*w[i : i + window])
        c.append(round(2 * len(a & b) / (len(a) + len(b)), 6) if a or b else 0.0)
    cuts = [i + 1 for i in range(len(c)) if (not i or c[i] < c[i - 1]) and (i + 1 == len(c) or c[i] <= c[i + 1]) and round(max(c[max(0, i - reach) : i + 1]) + max(c[i : i + reach + 1]) - 2 * c[i], 6) >= depth]
    edges = [0, *cuts, len(s)]
    return [" ".join(s[a:b]) for a, b in zip(edges, edges[1:])] if s else []


def chunks(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {k: [] for k in range(len(texts))}
    for r in sorted(cohesion.semantic_chunks(df, **how).collect(), key=lambda r: (r["id"], r["chunk"])):
        out[r["id"]].append(r["chunk_text"])
    return [out[k] for k in range(len(texts))]


def topics(n, seed):
    random.seed(seed)
    sets = [[f"topic{k}word{j}" for j in range(12)] for k in range(n)]
    return [" ".join(random.sample(words, 6)) + "." for words in sets for _ in range(8)]


def test_chunks_are_the_rule(spark):
    random.seed(1)
    vocabulary = ["heart", "valve", "lung", "of", "the", "Breath", "renal", "dose", "école", "قلب"]
    texts = [" ".join(" ".join(random.choice(vocabulary) for _ in range(random.randrange(1, 7))) + random.choice([".", "!", "?", "؟"]) for _ in range(random.randrange(1, 25))) for _ in range(60)]
    texts += ["", None, "   ", "One sentence only", "A. B. C. D.", " ".join(topics(3, 2))]
    assert chunks(spark, texts) == [plain(t) for t in texts]
    assert chunks(spark, texts[:20], window=2, reach=3, depth=0.4) == [plain(t, 2, 3, 0.4) for t in texts[:20]]


def test_topics_are_found(spark):
    got = chunks(spark, [" ".join(topics(5, 4))])[0]
    assert [len({w[:6] for w in c.split()}) for c in got] == [1] * len(got) and len(got) >= 5


def test_long_texts_take_time_in_proportion(spark):
    seconds = []
    for n in (100, 1000):
        text = " ".join(topics(n, 5))
        chunks(spark, [text])
        began = time.time()
        assert len(chunks(spark, [text])[0]) >= n
        seconds.append(time.time() - began)
    assert seconds[1] < 30 * seconds[0]
