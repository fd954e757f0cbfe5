"""Matches of benchmark items against edit distances of all substrings, and quality verdicts against expectation-maximisation in loops."""

import math
import random

import numpy as np
import pyarrow as pa

from textloom.llm import pigeonhole, quality


def least_distance(item, text):
    """Least edits between the item and any part of the text, by the table of all prefixes."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(before[j - 1] + (c != d), before[j] + 1, row[j - 1] + 1)
    return min(row)


def stands_alone(item, text):
    at = text.find(item)
    while at >= 0:
        end = at + len(item)
        if (at == 0 or not text[at - 1].isalnum()) and (end == len(text) or not text[end].isalnum()):
            return True
        at = text.find(item, at + 1)
    return False


def edited(text, n):
    for _ in range(n):
        k = random.randrange(len(text))
        text = random.choice([text[:k] + text[k + 1 :], text[:k] + random.choice("abcxyz ") + text[k:], text[:k] + random.choice("abcxyz") + text[k + 1 :]])
    return text


def test_op9_matches_are_all_within_the_budget(spark):
    random.seed(6)
    words = ["".join(random.choice("abcdé") for _ in range(random.randrange(1, 7))) for _ in range(40)]
    phrase = lambda n: " ".join(random.choice(words) for _ in range(n))
    items = [(k, phrase(random.randrange(1, 14))) for k in range(25)] + [(90, None), (91, "  "), (92, "abc"), (93, "Abc  D")]
    items.append((94, items[3][1].upper()))
    docs = []
    for k in range(90):
        i = random.choice(items)[1] or "x"
        docs.append((k, phrase(random.randrange(12)) + random.choice([" ", "\n", ""]) + edited(i, random.choice([0, 0, 1, 2, 3, 4])) + random.choice([" ", ", ", ""]) + phrase(random.randrange(12))))
    docs += [(200, None), (201, ""), (202, "abc"), (203, "xabcx"), (204, "abc d")]
    want = set()
    for d, text in docs:
        text = pigeonhole.plain(text)
        for i, item in items:
            item = pigeonhole.plain(item)
            budget = int(len(item) * pigeonhole.RATE)
            if item and text and (stands_alone(item, text) if not budget else least_distance(item, text) <= budget):
                want.add((d, i, least_distance(item, text)))
    found = pigeonhole.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in found.collect()} == want and sum(n > 0 for *_, n in want) > 3
    left = pigeonhole.without_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, *_ in want}


def plain_estimate(votes, prior=0.85, rounds=100):
    """Posteriors of documents, each with its votes, one by one."""
    rules = len(quality.RULES)
    good = [min(max(0.97 - 0.45 * v.count(quality.BAD), 0.03), 0.97) for v in votes]
    share, rates = prior, None
    for _ in range(rounds):
        before = list(good)
        rates = [[[1.0] * 3 for _ in range(rules)] for _ in range(2)]
        for v, g in zip(votes, good):
            for r, x in enumerate(v):
                rates[0][r][x] += g
                rates[1][r][x] += 1 - g
        rates = [[[x / sum(row) for x in row] for row in side] for side in rates]
        share = (sum(good) + 1) / (len(votes) + 2)
        good = []
        for v in votes:
            logs = [math.log(p) + sum(math.log(rates[y][r][x]) for r, x in enumerate(v)) for y, p in enumerate((share, 1 - share))]
            good.append(1 / (1 + math.exp(min(max(logs[1] - logs[0], -50), 50))))
        if max(abs(a - b) for a, b in zip(good, before)) < 1e-6:
            break
    return good


def test_op5_verdicts_are_those_of_plain_estimation(spark):
    random.seed(3)
    words = ["".join(random.choice("aeinrst") for _ in range(random.randrange(2, 9))) for _ in range(300)]
    good = [" ".join(random.choice(words) for _ in range(random.randrange(20, 120))).capitalize() + "." for _ in range(120)]
    bad = ["#$ " * random.randrange(1, 30) + " ".join(random.choice(words).upper() for _ in range(random.randrange(12, 40))) + "\n" + ("same line here\n" * random.randrange(0, 6)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(good + bad + ["", None, "one two"])]
    got = {r["doc_id"]: r for r in quality.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    found = quality.text_counts(pa.array([t for _, t in rows]))
    patterns = quality.votes(found).tolist()
    votes = {k: tuple(patterns[i] // 3**r % 3 for r in range(len(quality.RULES))) for i, (k, _) in enumerate(rows)}
    judged = [k for k, _ in rows if not got[k]["base_failed"]]
    want = dict(zip(judged, plain_estimate([votes[k] for k in judged]), strict=True))
    assert len(judged) > 100 and {got[k]["kept"] for k in judged} == {True, False}
    for k, _ in rows:
        if k in want:
            assert abs(got[k]["quality"] - want[k]) < 1e-4 and got[k]["kept"] == (got[k]["quality"] >= 0.5)
        else:
            assert not got[k]["kept"]
    assert np.mean([got[k]["kept"] for k in range(120)]) > 0.9
