"""Folds of lines that probe a dictionary through joins, against the same folds over a dictionary in memory."""

import random

from pyspark.sql import functions as F

from textloom.functions import normalize
from textloom.functions.similarity import indel
from textloom.operators import correct


class Local:
    """A dictionary in memory: exact, else the most similar of about the same length, the first of equals."""

    def __init__(self, terms, slack=3):
        self.terms, self.slack, self.by_length = dict(terms), slack, {}
        for k, variant in enumerate(self.terms):
            self.by_length.setdefault(len(variant), []).append((k, variant))

    def find(self, word, ratio):
        if len(word) < 2:
            return None
        if word in self.terms:
            return self.terms[word]
        near = [(indel(word, v) / 100, -k, v) for n in range(max(1, len(word) - self.slack), len(word) + self.slack + 1) for k, v in self.by_length.get(n, ())]
        best = max((x for x in near if x[0] >= ratio), default=None)
        return self.terms[best[2]] if best else None


def dictionary(spark, terms):
    return spark.createDataFrame([(v, t, k) for k, (v, t) in enumerate(terms.items())], "variant string, term string, ordinal int")


LETTERS = "ابتكلمر"


def arabic_lines(n, seed):
    random.seed(seed)
    word = lambda: "".join(random.choice(LETTERS) for _ in range(random.randrange(1, 6)))
    lines = [" ".join(random.choice([word(), word(), word(), "12", "mg"]) for _ in range(random.randrange(1, 9))) for _ in range(n)]
    return lines, {"".join(random.choice(LETTERS) for _ in range(random.randrange(2, 8))): f"t{k}" for k in range(60)}


def test_correct_text_is_the_fold_over_a_local_dictionary(spark):
    lines, terms = arabic_lines(150, 3)
    # terms that stand for themselves, so that what was found is probed again with the next word
    terms |= {"كلم": "كلم", "كلمة": "كلمه", "مرت": "مرت", "مرتب": "مرتب"}
    lines += ["ك لم ة", "كل م", "مر ت ب", "كلم", "", "  ", None, lines[0], lines[0]]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, text string")
    got = {r["id"]: (r["corrected"], r["changed"]) for r in correct.correct_text(df, dictionary(spark, terms)).collect()}
    ready = {r["id"]: r["x"] for r in df.select("id", correct.context_rules(normalize.normalize_arabic("text")).alias("x")).collect()}
    own = Local(terms)
    want = {k: None if x is None else correct.correct_line(x, own) for k, x in ready.items()}
    assert {k: v[0] for k, v in got.items()} == want
    assert {k for k, v in got.items() if v[1]} == {k for k, x in want.items() if x is not None and x != lines[k]}
    assert len(got) == len(lines)


def test_phrases_of_a_large_dictionary(spark):
    """100,000 terms, which no task and no driver holds."""
    random.seed(6)
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    word = lambda: "".join(random.choice(syllables) for _ in range(random.randrange(2, 4)))
    terms = {}
    while len(terms) < 100_000:
        t = " ".join(word() for _ in range(random.randrange(2, 4)))
        terms[t] = t
    names = list(terms)
    lines = [f"with {t[:4] + t[5:]} and {names[k + 5]} or {word()}" for k, t in enumerate(names[:40])] + ["nothing", "", "one two three four five"]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, text string")
    out = correct.match_phrases(df, dictionary(spark, terms), ratio=0.8)
    own = Local(terms)
    want = {k: correct.phrases(x.split(), own, ratio=0.8) for k, x in enumerate(lines)}
    assert {r["id"]: [tuple(p) for p in r["phrases"]] for r in out.collect()} == want
    assert sum(n > 1 for p in want.values() for _, n in p) > 60


def test_a_text_is_folded_once(spark):
    df = spark.createDataFrame([(k, "ab cd") for k in range(50)], "id int, text string")
    out = correct.match_phrases(df, dictionary(spark, {"ab cd": "x"}))
    assert out.count() == 50 and out.select(F.to_json("phrases")).distinct().collect()[0][0] == '[{"term":"x","n":2}]'
