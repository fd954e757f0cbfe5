"""Correction of recognised text: context rules, dictionary cascades, phrases and fragments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import normalize
from textloom.functions.patterns import native
from textloom.operators import fuzzy
from textloom.sources.shared import shared_folder

# Units of doses, their usual spelling, and words of frequency.
UNITS = "مل|mg|مجم"
DOSE = r"(?i)^\d+(\.\d+)?\s*(mg|ml|mcg|g|مجم|مل|ملغ|جم)?$"
SPELLINGS = (("مجم", "mg"), ("ملغ", "mg"), ("مل", "ml"), ("جم", "g"))
FREQUENCY = "مرة|مرات|times"


def context_rules(x: Column) -> Column:
    """A space between a number and its unit, and before words of frequency."""
    out = F.regexp_replace(x, native(rf"(\d+)\s*({UNITS})\b"), "$1 $2")
    return F.regexp_replace(out, native(rf"(\d+)\s*({FREQUENCY})\b"), "$1 $2")


def is_dose(x: Column) -> Column:
    return x.rlike(native(DOSE))


def spell_units(x: Column) -> Column:
    out = x
    for other, usual in SPELLINGS:
        out = F.regexp_replace(out, native(rf"(?<=\d)\s*{other}$"), f" {usual}")
    return out


def word_cascade(words: DataFrame, terms: DataFrame, drugs: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """(word, corrected, type, confidence), the first stage that finds something: term, similar term, dose, drug, diagnosis, else the word itself."""
    own = words.select("word").distinct().withColumn("key", normalize.medical_key("word"))
    keys = own.select(F.col("key").alias("word")).distinct()
    hit = fuzzy.exact(keys, terms).filter("term is not null").select(F.col("word").alias("key"), F.col("term").alias("t1"))
    left = keys.join(hit, keys.word == hit.key, "left_anti")
    near = fuzzy.first_similar(left, terms, ratio=0.70).select(F.col("word").alias("key"), F.col("term").alias("t2"))
    drug = fuzzy.first_similar(left, drugs, ratio=0.75, either_way=False).select(F.col("word").alias("key"), F.col("term").alias("t4"))
    diagnosis = fuzzy.first_similar(left, diagnoses, ratio=0.75, either_way=False).select(F.col("word").alias("key"), F.col("term").alias("t5"))
    joined = own.join(hit, "key", "left").join(near, "key", "left").join(drug, "key", "left").join(diagnosis, "key", "left")
    found = lambda text, kind, score: F.struct(text.alias("corrected"), F.lit(kind).alias("type"), F.lit(score).alias("confidence"))
    stage = lambda c, kind, score: F.when(F.col(c).isNotNull(), found(F.col(c), kind, score))
    best = F.coalesce(stage("t1", "term", 0.95), stage("t2", "term", 0.85), F.when(is_dose(F.col("word")), found(spell_units(F.col("word")), "dosage", 0.9)), stage("t4", "drug", 0.85), stage("t5", "diagnosis", 0.85), found(F.col("word"), "general", 0.5))
    return joined.select("word", best.alias("b")).select("word", "b.*")


def three_stages(words: DataFrame, learned: DataFrame, medical: DataFrame, spelled: DataFrame) -> DataFrame:
    """(word, corrected, source): the learned dictionary, then a medical correction, then (below 0.85 confidence) the spell check."""
    joined = words.select("word").distinct().join(learned.select("word", F.col("term").alias("u")), "word", "left").join(medical.select("word", F.col("corrected").alias("m"), "type", "confidence"), "word", "left").join(spelled.select("word", F.col("term").alias("s")), "word", "left")
    source = F.when(F.col("u").isNotNull(), "user_dictionary").when((F.col("type") != "general") & (F.col("confidence") >= 0.85), F.concat(F.lit("medical_"), F.col("type"))).when(F.col("s").isNotNull() & (F.col("s") != F.col("word")), "nlp_sym_spell").otherwise("none")
    text = F.when(source == "user_dictionary", F.col("u")).when(F.startswith(source, F.lit("medical_")), F.col("m")).when(source == "nlp_sym_spell", F.col("s")).otherwise(F.col("word"))
    return joined.select("word", text.alias("corrected"), source.alias("source"))


def staged(words: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(word, corrected, source) by any number of stages (name, (word, corrected)) in their order: the first that knows a word corrects it."""
    joined = words.select("word").distinct()
    for k, (_, known) in enumerate(stages):
        joined = joined.join(known.select("word", F.col("corrected").alias(f"c{k}")).dropDuplicates(["word"]), "word", "left")
    source = F.coalesce(*(F.when(F.col(f"c{k}").isNotNull(), F.lit(name)) for k, (name, _) in enumerate(stages)), F.lit("none"))
    return joined.select("word", F.coalesce(*(F.col(f"c{k}") for k in range(len(stages))), "word").alias("corrected"), source.alias("source"))


class Answers:
    """What the dictionary has said so far about strings that a fold probes; what it hasn't is asked, and taken as unknown meanwhile."""

    def __init__(self, known: dict[str, str | None]):
        self.known, self.asked = known, set()

    def find(self, word: str, ratio: float) -> str | None:
        if len(word) < 2:
            return None
        key = f"{ratio} {word}"
        if key not in self.known:
            self.asked.add(key)
        return self.known.get(key)


def merge_fragments(words: list[str], terms: Answers) -> list[str]:
    """Left to right: a short Arabic word is joined with the next one or two, else with the one before, else looked up alone."""
    out: list[str] = []
    i = 0
    while i < len(words):
        word = words[i]
        if word.isdigit() or not any("؀" <= c <= "ۿ" for c in word) or len(word) > 3:
            out.append(word)
            i += 1
            continue
        for take, ratio in ((2, 0.65), (3, 0.60)):
            found = terms.find("".join(words[i : i + take]), ratio) if i + take <= len(words) else None
            if found:
                out.append(found)
                i += take
                break
        else:
            found = terms.find(out[-1] + word, 0.65) if out else None
            if found:
                out[-1] = found
            else:
                out.append(terms.find(word, 0.75) or word)
            i += 1
    return out


def merge_line(line: str, terms: Answers) -> str:
    """A line of short words as one term where that is similar enough, else by its fragments."""
    words = line.split()
    if words and len(words) <= 6 and all(len(w) <= 4 for w in words):
        found = terms.find("".join(words), 0.55)
        if found:
            return found
    if 1 < len(words) <= 5:
        found = terms.find(" ".join(words), 0.55)
        if found:
            return found
    return " ".join(merge_fragments(words, terms))


def correct_line(line: str, terms: Answers) -> str:
    """The whole line at 0.80, else its merged words, each Arabic one of three letters at least at 0.80."""
    whole = terms.find(line, 0.80)
    if whole:
        return whole
    merged = merge_line(line, terms)
    if merged != line and terms.find(merged, 0.75):
        return terms.find(merged, 0.75)
    return " ".join((terms.find(w, 0.80) or w) if len(w) >= 3 and any("؀" <= c <= "ۿ" for c in w) else w for w in merged.split())


def phrases(words: list[str], terms: Answers, longest: int = 4, ratio: float = 0.65) -> list[tuple[str, int]]:
    """Greedy cover from the left, longest window first: (term, words covered); a word that starts none covers itself."""
    out, i = [], 0
    while i < len(words):
        for n in range(min(longest, len(words) - i), 1, -1):
            found = terms.find(" ".join(words[i : i + n]), ratio)
            if found:
                out.append((found, n))
                i += n
                break
        else:
            out.append((words[i], 1))
            i += 1
    return out


def fold_lines(df: DataFrame, terms: DataFrame, f: Callable[[str, Answers], object], kind: str, ratios: Sequence[float], *, text: str, name: str, slack: int = 3) -> DataFrame:
    """df with f(text, answers) as name, for folds that probe a dictionary of any size as they go.

    In each round every distinct text that isn't done is folded with the answers that it has, and asks for those that it lacks; the
    distinct questions of all texts are joined with the dictionary: exactly, then by the index of segments. A fold whose probes don't
    depend on answers is done after one round, others after as many as answers lead to new questions. Rounds are tables in the shared folder.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    named = terms.select("variant", "term", "ordinal")

    @F.pandas_udf(f"struct<value:{kind},asks:array<string>>")
    def step(texts: pd.Series, known: pd.Series) -> pd.DataFrame:
        values, asks = [], []
        for x, pairs in zip(texts, known, strict=True):
            answers = Answers({p["ask"]: p["term"] for p in pairs})
            values.append(f(x, answers))
            asks.append(sorted(answers.asked))
        return pd.DataFrame({"value": values, "asks": asks})

    def lookup(asked: DataFrame) -> DataFrame:
        """(ask, term) for every question that has an answer."""
        own = asked.select("ask", F.substring_index("ask", " ", 1).cast("double").alias("ratio"), F.expr("substring(ask, instr(ask, ' ') + 1)").alias("word"))
        hits = own.join(fuzzy.exact(own.select("word").distinct(), named).filter("term is not null"), "word").select("ask", "term")
        misses = own.join(hits.select("ask"), "ask", "left_anti")
        near = fuzzy.best_matches(misses.select("word", "ratio"), named, ratios=ratios, slack=slack).select("word", "ratio", F.col("term"))
        return hits.union(misses.join(near, ["word", "ratio"]).select("ask", "term"))

    def written(part: DataFrame, label: str) -> DataFrame:
        part.write.parquet(f"{folder}/{label}")
        return spark.read.schema(part.schema).parquet(f"{folder}/{label}")

    none = F.array().cast("array<struct<ask:string,term:string>>")
    open_ = df.select(F.sha2(F.col(text), 256).alias("_key"), F.col(text).alias("_text")).filter("_text is not null").groupBy("_key").agg(F.any_value("_text").alias("_text")).withColumn("_known", none)
    done, k = None, 0
    while True:
        folded = written(open_.withColumn("_out", step("_text", "_known")), f"round{k}")
        finished = folded.filter(F.size("_out.asks") == 0).select("_key", F.col("_out.value").alias(name))
        done = finished if done is None else done.union(finished)
        waiting = folded.filter(F.size("_out.asks") > 0)
        if waiting.isEmpty():
            break
        asks = waiting.select("_key", F.explode("_out.asks").alias("ask"))
        answers = written(lookup(asks.select("ask").distinct()), f"answers{k}")
        heard = asks.join(answers, "ask", "left").groupBy("_key").agg(F.collect_list(F.struct("ask", "term")).alias("_heard"))
        open_ = waiting.join(heard, "_key").select("_key", "_text", F.concat("_known", "_heard").alias("_known"))
        k += 1
    return df.withColumn("_key", F.sha2(F.col(text), 256)).join(done, "_key", "left").drop("_key")


def correct_text(df: DataFrame, terms: DataFrame, *, text: str = "text", name: str = "corrected") -> DataFrame:
    """df with the corrected text and whether it changed: normalised, context rules, then correct_line on every row."""
    ready = df.withColumn("_ready", context_rules(normalize.normalize_arabic(text)))
    out = fold_lines(ready, terms, correct_line, "string", (0.55, 0.60, 0.65, 0.75, 0.80), text="_ready", name=name)
    return out.withColumn("changed", F.coalesce(F.col(name) != F.col(text), F.lit(False))).drop("_ready")


def match_phrases(df: DataFrame, terms: DataFrame, *, text: str = "text", name: str = "phrases", ratio: float = 0.65) -> DataFrame:
    """df with an array of (term, n): the greedy cover of each text by terms of two to four words, and single words between them."""
    return fold_lines(df, terms, lambda x, own: [{"term": t, "n": n} for t, n in phrases(x.split(), own, ratio=ratio)], "array<struct<term:string,n:int>>", (ratio,), text=text, name=name)
