"""Exact, phonetic and fuzzy lookups of words in dictionaries, as joins.

Every lookup goes over distinct words, probes exactly first, and only for the misses compares fuzzily: candidates by an equi-join on
pieces of the strings (see ``signatures``), a native bound on the edit distance, and the exact ratio on what is left. That holds for
dictionaries of any size; a small one is broadcast where terms are joined by equality alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import similarity
from textloom.operators import signatures

BROADCAST_ROWS = 200_000


def small(terms: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """terms, to be broadcast if it has at most so many rows."""
    return F.broadcast(terms) if terms.limit(most + 1).count() <= most else terms


def dictionary(raw: DataFrame, *, variants: str = "variants") -> DataFrame:
    """(variant, term, ordinal) from rows (term, variants map or array, ordinal): the last writer of a variant wins."""
    rows = raw.select("term", "ordinal", F.explode(variants).alias("variant"))
    return rows.groupBy("variant").agg(F.max_by("term", "ordinal").alias("term"), F.max("ordinal").alias("ordinal"))


def exact(words: DataFrame, terms: DataFrame) -> DataFrame:
    """words (word) with the term of an equal variant, null where none is."""
    return words.join(small(terms.select(F.col("variant").alias("word"), "term", "ordinal")), "word", "left")


def best_match(words: DataFrame, terms: DataFrame, *, ratio: float, metric: str = "indel", slack: int = 3, longest: int | None = None, strictly: bool = False) -> DataFrame:
    """(word, term, variant, score): the most similar variant at ratio or over, of lengths at most slack apart; the least ordinal of equals.

    metric 'indel' or 'matcher', both from 0 to 1. Words over longest characters match nothing. Null words match nothing.
    """
    distinct = words.select("word").filter("word is not null").distinct()
    if longest is not None:
        distinct = distinct.filter(F.length("word") <= longest)
    return best_matches(distinct.withColumn("ratio", F.lit(float(ratio))), terms, ratios=[ratio], metric=metric, slack=slack, strictly=strictly).drop("ratio")


def best_matches(asked: DataFrame, terms: DataFrame, *, ratios: Sequence[float], metric: str = "indel", slack: int | None = 3, strictly: bool = False) -> DataFrame:
    """(word, ratio, term, variant, score): as best_match, for distinct words that each ask for a ratio of their own, one of ratios."""
    named = terms.filter("variant <> ''").groupBy("variant").agg(F.min_by("term", "ordinal").alias("term"), F.min("ordinal").alias("ordinal"))
    pairs = signatures.near_pairs(asked, named.select("variant"), ratios=ratios, slack=slack).filter(similarity.may_reach(F.col("word"), F.col("variant"), F.col("ratio")))
    score = similarity.indel_ratio("word", "variant") / 100 if metric == "indel" else similarity.matcher_ratio("word", "variant")
    pairs = pairs.withColumn("score", score).filter(F.col("score") > F.col("ratio") if strictly else F.col("score") >= F.col("ratio")).join(named, "variant")
    best = pairs.groupBy("word", "ratio").agg(F.max_by(F.struct("term", "variant", "score"), F.struct("score", -F.col("ordinal"))).alias("best"))
    return best.select("word", "ratio", "best.*")


def exact_then_fuzzy(words: DataFrame, terms: DataFrame, **how) -> DataFrame:
    """(word, term, score): exact hits score 1, only the misses are compared fuzzily."""
    distinct = words.select("word").filter("word is not null").distinct()
    probed = exact(distinct, terms)
    hits = probed.filter("term is not null").select("word", "term", F.lit(1.0).alias("score"))
    misses = probed.filter("term is null").select("word")
    return hits.union(best_match(misses, terms, **how).select("word", "term", "score"))


def first_similar(words: DataFrame, terms: DataFrame, *, ratio: float, either_way: bool = True) -> DataFrame:
    """(word, term): the first term (by ordinal) that holds the word, is held by it, or is similar over ratio."""
    own = words.select("word").filter("word <> ''").distinct()
    named = terms.filter("variant <> ''").groupBy("variant").agg(F.min(F.struct("ordinal", "term")).alias("value"))
    # terms that stand in the word
    found = signatures.containing_pairs(named.select(F.col("variant").alias("inner")), own.select(F.col("word").alias("outer")))
    found = found.select(F.col("inner").alias("variant"), F.col("outer").alias("word")).join(named, "variant").select("word", "value")
    if either_way:
        found = found.union(signatures.first_containing(own.select(F.col("word").alias("inner")), named.select(F.col("variant").alias("outer"), "value")))
    near = signatures.near_pairs(own.withColumn("ratio", F.lit(float(ratio))), named.select("variant"), ratios=[ratio]).filter(similarity.may_reach(F.col("word"), F.col("variant"), ratio))
    near = near.filter(similarity.matcher_ratio("word", "variant") > ratio).join(named, "variant").select("word", "value")
    return found.union(near).groupBy("word").agg(F.min("value").alias("value")).select("word", "value.term")


def by_edits(words: DataFrame, terms: DataFrame, *, most: int = 1) -> DataFrame:
    """(word, term, distance): the nearest term within so many edits, by a join on strings with characters deleted; no pair of all words and terms is made."""

    def deletes(x: Column) -> Column:
        out = F.array(x)
        for _ in range(most):
            out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))))))
        return out

    left = words.select("word").filter("word is not null").distinct().withColumn("key", F.explode(deletes(F.col("word"))))
    right = terms.select("variant", "term", "ordinal").withColumn("key", F.explode(deletes(F.col("variant"))))
    pairs = left.join(right, "key").withColumn("distance", F.levenshtein("word", "variant")).filter(F.col("distance") <= most)
    return pairs.groupBy("word").agg(F.min_by(F.struct("term", "distance"), F.struct("distance", "ordinal")).alias("best")).select("word", "best.*")


def search(terms: DataFrame, query: str, names: list[str] | None = None) -> DataFrame:
    """The terms of (all or the named) dictionaries that contain the query."""
    found = terms.filter(F.contains(F.lower("term"), F.lit(query.lower())))
    return found.filter(F.col("dictionary").isin(names)) if names else found


def validate(words: DataFrame, terms: DataFrame) -> DataFrame:
    """words with the dictionaries that hold them, and whether any does."""
    held = terms.groupBy(F.lower("term").alias("key")).agg(F.sort_array(F.collect_set("dictionary")).alias("dictionaries"))
    return words.join(held, F.lower("word") == held.key, "left").select("word", F.coalesce("dictionaries", F.array()).alias("dictionaries"), F.col("key").isNotNull().alias("valid"))


def status(terms: DataFrame) -> DataFrame:
    return terms.agg(F.count("*").alias("terms"), F.count_distinct("dictionary").alias("dictionaries"), F.max("synced_at").alias("last_sync"))


def suggestions(words: DataFrame, terms: DataFrame, history: DataFrame, abbreviations: DataFrame, most: int = 5) -> DataFrame:
    """Ranked (word, rank, text, strategy, score) from equal terms, near terms, terms of equal sound, earlier corrections, terms that begin so, and abbreviations."""
    from textloom.functions.normalize import arabic_soundex

    own = words.select("word").distinct()
    sound = lambda x: F.when(x.rlike("[A-Za-z]"), F.soundex(x)).otherwise(arabic_soundex(x))
    parts = [
        exact(own, terms).filter("term is not null").select("word", F.col("term").alias("text"), F.lit("dictionary").alias("strategy"), F.lit(1.0).alias("score")),
        best_match(own, terms, ratio=0.6).select("word", F.col("term").alias("text"), F.lit("edit_distance").alias("strategy"), "score"),
        own.join(small(terms.select("term", sound(F.col("variant")).alias("s"))), sound(F.col("word")) == F.col("s")).filter("s <> ''").select("word", F.col("term").alias("text"), F.lit("soundex").alias("strategy"), F.lit(0.6).alias("score")),
        own.join(history, own.word == history.pattern).select("word", F.col("correction").alias("text"), F.lit("previous").alias("strategy"), (F.lit(1.0) - F.lit(1.0) / (F.col("frequency") + 1)).alias("score")),
        own.join(small(terms.select("term", F.substr("variant", F.lit(1), F.lit(4)).alias("p"))), F.substr("word", F.lit(1), F.lit(4)) == F.col("p")).select("word", F.col("term").alias("text"), F.lit("context").alias("strategy"), F.lit(0.5).alias("score")),
        own.join(small(abbreviations), F.upper("word") == F.col("short")).select("word", F.col("long").alias("text"), F.lit("abbreviation").alias("strategy"), F.lit(0.95).alias("score")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    best = every.groupBy("word", "text").agg(F.max_by(F.struct("strategy", "score"), F.struct("score", "strategy")).alias("b")).select("word", "text", "b.*")
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "text"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= most)
