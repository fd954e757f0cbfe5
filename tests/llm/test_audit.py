"""The filter audit against brute force, over rows with nulls, blanks, long texts, ties, repeats and clashing columns."""

import re
from collections import defaultdict
from itertools import permutations

import pytest

from textloom.llm import audit

SCHEMA = "doc_id long, text string, lang string, part string, n string, word string, digest string, salt string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sample():
    varied = " ".join(f"w{k}" for k in range(130))
    texts = [varied, varied, varied + " #", " ".join(["SAME"] * 120), "", None, " \t\n\v ", "A", "Ä b", "% " + varied, varied.upper(), "x" * 5000, "ab " * 9000, "un deux", "un deux", varied + " end"]
    rows = [(k, t, ["en", "de", None, ""][k % 4]) for k, t in enumerate(texts)]
    rows += [(90, varied, "en"), (90, varied, "en"), (90, varied, "de"), (90, "other", "en"), (-3, varied, "en"), (None, varied, "en"), (None, varied, "en"), (None, "only here", None)]
    return [(*r, "p", "n", "w", "d", "s") for r in rows]


LABELS = [(0, 1, 0), (2, 1, 0), (3, 0, 1), (3, 0, 0), (8, 1, 1), (90, 1, 0), (None, 1, 1), (777, 1, 1), (9, None, 1)]


def brute(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    fails = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        own = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and t in first and first[t] < i,
        }
        fails.append((lang or "", own, i in good, i in toxic))
    out, total = {}, defaultdict(int)
    for part in {f[0] for f in fails}:
        inside = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                earlier = [any(f[1][y] for y in order[:k]) for f in inside]
                here = [f for f, e in zip(inside, earlier) if f[1][x] and not e]
                total[part, x] += len(here)
                out[part, "".join(order), k + 1] = [
                    sum(not e and not f[1][x] for f, e in zip(inside, earlier)),
                    len(here),
                    sum(e and f[1][x] for f, e in zip(inside, earlier)),
                    sum(f[1][x] and sum(f[1].values()) == 1 for f in inside),
                    sum(f[2] for f in here),
                    sum(f[3] for f in here),
                ]
    return {key: (*v, total[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_op13_is_brute_force(spark, labels):
    docs = spark.createDataFrame(sample(), SCHEMA).repartition(5)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in audit.audit(docs, labels).collect()}
    assert got == brute(sample(), LABELS)


def test_op13_of_an_empty_table(spark, labels):
    assert audit.audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    docs = spark.createDataFrame(sample()[:3], SCHEMA)
    assert audit.audit(docs, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_op13_joins_copies_under_their_salts(spark):
    """A text of many rows is joined back under many keys, a text that stands once under none."""
    rows = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'copy', string(id)) as text", "'en' as lang")
    masked = audit.masks(rows)
    assert masked.selectExpr("sum(if(mask >= 16, n, 0))", "sum(n)").first()[:] == (1333, 4000)
    salts = audit.first_copies(rows.selectExpr("doc_id", "text as digest", f"xxhash64(doc_id) % {audit.SALTS} as salt"))
    assert {r["digest"] for r in salts.collect()} == {"copy"} and salts.count() > audit.SALTS
