"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: insult, threat, target, negation, speech verb, quote, or any other. Three transducers are composed into
one machine: negation marks what it scopes over, reported speech marks what others are said to have said, and the scorer weighs
what is left, more if the clause aims at someone; a threat counts only if it does, whether the one that it aims at is named before or
behind it. The machine runs over clauses, so what counts is a matched clause and not a word alone; the weights of insults, and of an aimed
threat, are their log-odds in the labelled texts. A logistic curve over the sum, and over the length of a text
with a match (long ones match more by chance), makes the score.

The lexicon is learned: whole words and word beginnings that stand in many toxic and hardly any clean texts of a sample of at most
``sample`` labelled rows of each label, chosen by a hash of doc_id, equal texts counted once. A short list of known words counts as
if it stood in ``PRIOR`` further texts, so that few or no labels give a lexicon too. Labels, language, source and doc_id are no inputs
of a score. A null doc_id counts as an empty one where held_out is told, and has no label. Null and empty texts score like texts
without a match. Repeated label rows count once each; labels that are neither 0 nor 1 don't count.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels, packed

#: Labelled rows of each label that are learned from, at most.
SAMPLE = 3000
#: The share of toxic texts that a term stands in, and its odds, at least.
SUPPORT, ODDS = 0.015, 20.0
#: Toxic texts with every known word, and clean ones without, that count besides the sample.
PRIOR = 5, 50
BEGINNINGS = (4, 5, 6, 7)
#: What stands for an aimed threat among the counted terms.
AIMED = " threat"

# Fixed word lists of the grammar.
SEEDS = "idiot moron stupid loser scum trash pathetic worthless disgusting idiota imbécil estúpido basura imbécile stupide ordure connard dumm trottel abschaum dreckig".split()
THREATS = "kill hurt destroy shoot stab beat matar golpear tuer frapper töten umbringen schlagen".split()
#: Endings that make an infinitive's stem a form of it, and those that stems of other forms take.
INFINITIVES, ENDINGS = re.compile("(?:ar|er|en)$"), "s ed bed ing bing er en e es t st te ten a an as o é ó aré ará ée és erai era ez".split()
TARGETS = "you your he she they him her them his their tú tu usted ustedes ellos ella él vous toi ils elles il du ihr sie dich euch".split()
NEGATIONS = "not never no isn't aren't don't nunca jamás ne pas jamais nicht kein keine nie".split()
SPEECH = "said says say told claimed wrote called dijo dice llamó dit disait appelé sagte sagt nannte".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, SAID, QUOTE = "o", "I", "H", "T", "N", "S", "Q"
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, NEGATION, SAID, QUOTE)
TOKEN = re.compile(r"[\w'’]+|[\"«»“”„]|[.!?;:\n]+")


class Transducer(NamedTuple):
    """(state, symbol) -> (state, output); state 0 starts."""

    steps: dict[tuple[int, str], tuple[int, object]]

    def __rshift__(self, other: Transducer) -> Transducer:
        """The machine that feeds what this one puts out to the other."""
        names: dict[tuple[int, int], int] = {(0, 0): 0}
        steps, todo = {}, [(0, 0)]
        while todo:
            a, b = pair = todo.pop()
            for (state, symbol), (to, out) in self.steps.items():
                if state == a and (b, out) in other.steps:
                    to_b, weight = other.steps[b, out]
                    if (to, to_b) not in names:
                        names[to, to_b] = len(names)
                        todo.append((to, to_b))
                    steps[names[pair], symbol] = names[to, to_b], weight
        return Transducer(steps)


def grammar(scope: int = 3, denied: float = 0.5, reported: float = 0.5, aimed: float = 1.5, threat: float = 1.0) -> Transducer:
    """The composed machine; its outputs are factors of a word's weight."""
    negation = {}
    for state in range(scope + 1):
        for x in SYMBOLS:
            negation[state, x] = (scope, x) if x == NEGATION else (max(0, state - 1), f"{x}-" if state and x in (INSULT, THREAT) else x)
    speech = {}
    for state in (0, 1, 2):  # one's own words, told of others, quoted
        for x in (*SYMBOLS, f"{INSULT}-", f"{THREAT}-"):
            to = max(1, state) if x == SAID else (0 if state == 2 else 2) if x == QUOTE else state
            speech[state, x] = to, f"{x}r" if state and x[0] in (INSULT, THREAT) else x
    score = {}
    for state in (0, 1, 2):  # nothing yet, a target was named, a threat was
        for x in {out for _, out in speech.values()}:
            kind = x[0]
            factor = (denied if "-" in x else 1.0) * (reported if "r" in x[1:] else 1.0)
            if kind == INSULT:
                score[state, x] = state, factor * (aimed if state == 1 else 1.0)
            elif kind == THREAT:  # at someone named before, or at whom is named next
                score[state, x] = (2 if factor == 1.0 else state), threat if state == 1 and factor == 1.0 else 0.0
            elif kind == TARGET:
                score[state, x] = 1, threat if state == 2 else 0.0
            else:
                score[state, x] = state, 0.0
    return Transducer(negation) >> Transducer(speech) >> Transducer(score)


def forms(verb: str) -> set[str]:
    """A verb and the forms that its stem may take."""
    stem = INFINITIVES.sub("", verb) if len(verb) > 4 else verb
    return {verb, *(stem + x for x in ENDINGS)}


class Model(NamedTuple):
    words: dict[str, float]
    beginnings: dict[str, float]
    #: weights of 1, the logarithm of the clauses' sum, and that of the words of a text with a match
    curve: tuple[float, float, float]
    #: the weight of a threat that is aimed at someone
    threat: float = 1.0


class Scorer:
    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.steps = grammar(threat=model.threat).steps
        threats = sorted({form for verb in THREATS for form in forms(verb)})
        self.fixed = {w: s for s, words in ((THREAT, threats), (TARGET, TARGETS), (NEGATION, NEGATIONS), (SAID, SPEECH)) for w in words}
        self.lengths = sorted({len(x) for x in model.beginnings}, reverse=True)
        self.any = ahocorasick.Automaton()
        for word in (*model.words, *model.beginnings, *threats):
            self.any.add_word(word, word)
        self.any.make_automaton()
        self.memo: dict[str, tuple[str, float]] = {}

    def symbol(self, token: str) -> tuple[str, float]:
        got = self.memo.get(token)
        if got is None:
            weight = self.model.words.get(token, 0.0)
            for n in self.lengths:
                weight = max(weight, self.model.beginnings.get(token[:n], 0.0) if len(token) >= n else 0.0)
            got = (INSULT, weight) if weight else (self.fixed.get(token, QUOTE if token in "\"«»“”„" else OTHER), 1.0)
            if len(self.memo) < 1 << 16:
                self.memo[token] = got
        return got

    def clauses(self, text: str | None) -> tuple[list[float], int]:
        """The weights of the clauses that match, and the words of a text in which any might."""
        text = (text or "").lower()
        if next(iter(self.any.iter(text)), None) is None:
            return [], 0
        out, total, state, words = [], 0.0, 0, 0
        for token in TOKEN.findall(text):
            if token[0] in ".!?;:\n":
                if total:
                    out.append(total)
                total, state = 0.0, 0
                continue
            words += 1
            symbol, weight = self.symbol(token)
            state, factor = self.steps[state, symbol]
            total += factor * weight
        return [*out, total] if total else out, words

    def evidence(self, text: str | None) -> tuple[tuple[float, float], int]:
        """What the curve looks at, and the number of clauses that match."""
        found, words = self.clauses(text)
        return ((math.log1p(sum(found)), math.log1p(words)) if found else (0.0, 0.0)), len(found)

    def score(self, text: str | None) -> tuple[float, int]:
        (total, words), n = self.evidence(text)
        bias, slope, length = self.model.curve
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, bias + slope * total + length * words)))), n


def remainder(key: str, by: int) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def features(text: str) -> set[str]:
    """Words, and their beginnings with a * behind."""
    words = {w for w in TOKEN.findall(text.lower()) if w[0] not in ".!?;:\n\"«»“”„"}
    return words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) >= n}


def labelled(docs: DataFrame, labels: DataFrame, *, text: str, key: str, label: str, held_out: int | None, sample: int) -> DataFrame:
    """(text, y) of the sample: at most so many rows of each label, by the hash of their key. At most 2 * sample keys are broadcast."""
    rows = labels.select(key, F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    if held_out is not None:
        rows = rows.filter(remainder(key, 3) != held_out)
    picked = [rows.filter(f"y = {y}").orderBy(F.xxhash64(key), key).limit(sample) for y in (0, 1)]
    return docs.select(key, text).join(F.broadcast(picked[0].union(picked[1])), key).select(F.coalesce(text, F.lit("")).alias("text"), "y")


def learn(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", held_out: int | None = 1, sample: int = SAMPLE) -> Model:
    """The lexicon and the curve, from the labelled rows whose crc32(key) mod 3 is not held_out (None: from all)."""
    spark = docs.sparkSession
    rows = labelled(docs, labels, text=text, key=key, label=label, held_out=held_out, sample=sample).groupBy("text", "y").agg(F.lit(1)).select("text", "y")
    rows = packed.table(rows, packed.shared_folder(spark), "sample")  # of at most 2 * sample rows, which are read three times

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, threats = (Counter(), Counter()), Scorer(plain)
        n = [0, 0]
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n[y] += 1
                held[y].update(features(x.as_py()))
                held[y][AIMED] += bool(threats.clauses(x.as_py())[0])  # without a lexicon only aimed threats match
        held[0][""], held[1][""] = n
        for part in (held[1], {t: 0 for t in held[0] if t not in held[1]}):
            terms = list(part)
            for a in range(0, len(terms), 50_000):
                some = terms[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([held[1][t] for t in some], pa.int64()), pa.array([held[0][t] for t in some], pa.int64())], names=["term", "toxic", "clean"])

    plain = Model({}, {}, (0.0, 1.0, 0.0))

    counts = rows.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    held = counts.filter("term = ''").first()
    toxic, clean = (held["toxic"] if held else 0) + PRIOR[0], (held["clean"] if held else 0) + PRIOR[1]
    known = spark.createDataFrame([(w, PRIOR[0], 0) for w in SEEDS], "term string, toxic long, clean long")
    aimed = counts.filter(F.col("term") == AIMED).first()
    weight_of = lambda t, c: math.log((t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1)))
    threat = max(0.0, weight_of(PRIOR[0] + (aimed["toxic"] if aimed else 0), aimed["clean"] if aimed else 0))
    counts = counts.filter(~F.col("term").isin("", AIMED)).union(known).groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = (F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1))
    # what reaches the driver: of each text of the sample at most 1 / SUPPORT terms, on average
    scored = [tuple(r) for r in counts.filter((F.col("t") >= max(PRIOR[0], SUPPORT * toxic)) & (odds >= ODDS)).select(F.log(odds), "t", "term").collect()]
    # a beginning goes if one longer term stands in nearly all its texts, and a term if a beginning of it is left
    longer: Counter = Counter()
    for _, t, term in scored:
        stem = term.rstrip("*")
        for n in BEGINNINGS:
            if n < len(stem) or n == len(stem) and term == stem:
                longer[f"{stem[:n]}*"] = max(longer[f"{stem[:n]}*"], t)
    chosen: dict[str, float] = {}
    for weight, t, term in sorted(scored, key=lambda x: (len(x[2].rstrip("*")), x[2])):
        stem = term.rstrip("*")
        if longer[term] < 0.9 * t and not any(f"{stem[:n]}*" in chosen for n in BEGINNINGS if n <= len(stem)):
            chosen[term] = weight
    best = sorted(chosen, key=lambda t: (-chosen[t], t))
    words, beginnings = {t: chosen[t] for t in best if t[-1] != "*"}, {t[:-1]: chosen[t] for t in best if t[-1] == "*"}
    raw = Model(words, beginnings, (0.0, 1.0, 0.0), threat)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(raw)
        for batch in batches:
            found = [scorer.evidence(x.as_py())[0] for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)), batch.column(1)], names=["x", "n", "y"])

    pairs = rows.mapInArrow(weigh, "x double, n double, y int").collect()  # at most 2 * sample triples of numbers
    # the prior's texts: such with one known word, and such without any
    pairs = [(r["x"], r["n"], r["y"], 0.0) for r in pairs] + [(math.log1p(max(chosen.get(w, 0.0) for w in SEEDS)), math.log(50), 1, 1.0)] * PRIOR[0] + [(0.0, 0.0, 0, 1.0)] * PRIOR[1]
    x, n, y, own = np.array(sorted(pairs)).T
    # each row of the sample stands for as many as its label has
    held = labels.select(key, F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    held = held if held_out is None else held.filter(remainder(key, 3) != held_out)
    totals = {r["y"]: r["n"] for r in held.groupBy("y").agg(F.count("*").alias("n")).collect()}
    weight = np.ones(len(y))
    for kind in (0, 1):
        drawn = (y == kind) & (own == 0)
        weight[drawn] = totals.get(kind, 0) / max(drawn.sum(), 1)
    return Model(words, beginnings, logistic(np.stack([np.ones_like(x), x, n], 1), y, weight), threat)


def logistic(design: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Weights of the columns of design in a weighted logistic curve, by Newton's method."""
    beta = np.zeros(design.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge * beta
        beta = beta + np.clip(np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(beta)), gradient), -3, 3)
    return tuple(float(b) for b in beta)


def scores(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score double, clauses int (that matched) and predicted int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            got = [scorer.score(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int32()), pa.array([int(s >= threshold) for s, _ in got], pa.int32())], names=[*batch.schema.names, "score", "clauses", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double, clauses int, predicted int"])
    return docs.mapInArrow(run, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    model = learn(docs, labels)
    return scores(docs.select("doc_id", "text"), model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "clauses")
