"""Index joins of strings against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.similarity import indel, matcher
from textloom.operators import fuzzy, signatures

SF = "/root/testdata/sf0.001"


def strings(n, letters="abc", most=9, seed=1):
    random.seed(seed)
    return sorted({"".join(random.choice(letters) for _ in range(random.randrange(0, most))) for _ in range(n)})


def frames(spark, words, variants):
    return spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(v,) for v in variants], "variant string")


def near(w, v, ratio, slack=None):
    """With a second ratio among those that may be asked for."""
    return signatures.near_pairs(w.withColumn("ratio", F.lit(ratio)), v, ratios=[ratio, 0.95], slack=slack).drop("ratio")


@pytest.mark.parametrize("ratio", [0.3, 0.55, 0.65, 0.75, 0.8, 0.9, 1.0])
def test_near_pairs_hold_every_pair_at_the_ratio(spark, ratio):
    words, variants = strings(120, seed=1), strings(120, seed=2)
    w, v = frames(spark, words, variants)
    got = {tuple(r) for r in near(w, v, ratio).collect()}
    want = {(a, b) for a in words for b in variants if a and b and indel(a, b) / 100 >= ratio}
    assert want <= got
    slack = {tuple(r) for r in near(w, v, ratio, 1).collect()}
    assert {(a, b) for a, b in want if abs(len(a) - len(b)) <= 1} <= slack and all(abs(len(a) - len(b)) <= 1 for a, b in slack)


def test_near_pairs_are_few(spark):
    """Of longer strings over a usual alphabet few pairs of a length are candidates."""
    random.seed(5)
    variants = sorted({"".join(random.choice("abcdefghijklmnoprstuvw") for _ in range(random.randrange(8, 15))) for _ in range(2000)})
    words = [v[:3] + "x" + v[4:] for v in variants[:500]]
    w, v = frames(spark, words, variants)
    got = near(w, v, 0.8, 3).count()
    of_length = sum(abs(len(a) - len(b)) <= 3 for a in words for b in variants)
    assert 500 <= got < of_length / 15


def test_containing_pairs_are_all(spark):
    inner, outer = strings(200, most=7, seed=3), strings(200, most=12, seed=4)
    i = spark.createDataFrame([(x,) for x in inner], "inner string")
    o = spark.createDataFrame([(x, k) for k, x in enumerate(outer)], "outer string, value int")
    want = {(a, b) for a in inner for b in outer if a and a in b}
    assert {tuple(r) for r in signatures.containing_pairs(i, o.select("outer")).collect()} == want
    assert len(signatures.containing_pairs(i, o.select("outer")).collect()) == len(want)
    first = {a: min(k for k, b in enumerate(outer) if a in b) for a, _ in want}
    assert {tuple(r) for r in signatures.first_containing(i, o).collect()} == set(first.items())


def first_similar(word, terms, ratio, either_way):
    return next((t for t in terms if t in word or (either_way and word in t) or matcher(word, t) > ratio), None)


@pytest.mark.parametrize(("ratio", "either_way"), [(0.70, True), (0.75, False)])
def test_first_similar_over_part_names(spark, ratio, either_way):
    parts = spark.read.parquet(f"{SF}/part.parquet").select("p_name", "p_brand", "p_type").distinct()
    terms = parts.select(F.concat_ws(" ", "p_name", "p_brand").alias("variant")).distinct()
    names = sorted(r[0] for r in terms.collect()) + ["ring", "a", "blue b"]
    terms = spark.createDataFrame([(n, n, k) for k, n in enumerate(names)], "variant string, term string, ordinal int")
    words = names[::7] + [n[:5] + n[6:] for n in names[::5]] + [n[2:9] for n in names[::9]] + ["zzzz", "", "x" * 30, "the blue bolt Brand#1 of old", "ar", "r"]
    df = fuzzy.first_similar(spark.createDataFrame([(w,) for w in words] + [(None,)], "word string"), terms, ratio=ratio, either_way=either_way)
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {w: t for w in words if w and (t := first_similar(w, names, ratio, either_way))}
    assert {r["word"]: r["term"] for r in df.collect()} == want


def test_best_match_is_brute_force(spark):
    names = strings(150, "abcd", 10, seed=8)
    words = strings(150, "abcd", 10, seed=9)
    terms = spark.createDataFrame([(n, n.upper(), k) for k, n in enumerate(names)], "variant string, term string, ordinal int")
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for metric, f in (("indel", lambda a, b: indel(a, b) / 100), ("matcher", matcher)):
        want = {}
        for w in words:
            near = [(f(w, n), -k) for k, n in enumerate(names) if w and n and abs(len(w) - len(n)) <= 2 and f(w, n) >= 0.7]
            if near:
                want[w] = names[-max(near)[1]].upper()
        found = fuzzy.best_match(df, terms, ratio=0.7, metric=metric, slack=2)
        assert {r["word"]: r["term"] for r in found.collect()} == want
