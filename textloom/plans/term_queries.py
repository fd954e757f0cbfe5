"""Queries of dictionary lookups and corrections over terms and misspelt words of the parts, with SQL that computes the ratios itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import normalize, similarity
from textloom.operators import correct, fuzzy
from textloom.plans.queries import query, table
from textloom.plans.source_queries import said

_MASK = "((1::HUGEINT << length({a})) - 1)"
#: Characters in common, in order, by bit vectors; strings of up to 100 characters.
_LCS = (
    f"(length({{a}}) - bit_count(list_reduce(list_prepend({_MASK}, list_transform(string_split({{b}}, ''), lambda c: coalesce(list_sum(list_transform(generate_series(1, length({{a}})), "
    f"lambda i: CASE WHEN substr({{a}}, i, 1) = c THEN 1::HUGEINT << (i - 1) ELSE 0 END)), 0)::HUGEINT)), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {_MASK})))"
)


def _ratio(a: str, b: str) -> str:
    return f"(2.0::DOUBLE * {_LCS.format(a=a, b=b)} / (length({a}) + length({b})))"


# terms are the distinct names in the order of their first part; words are names without a character that the part's key tells
_TERMS = "terms AS (SELECT p_name AS variant, upper(p_name) AS term, min(p_partkey) AS ordinal FROM part GROUP BY p_name)"
_WORDS = "words AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE substr(p_name, 1, p_partkey % length(p_name)) || substr(p_name, p_partkey % length(p_name) + 2) END AS word FROM part)"


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("variant")).agg(F.upper(F.first("p_name")).alias("term"), F.min("p_partkey").alias("ordinal"))


def _without_one(name, key):
    at = (key % F.length(name)).cast("int")
    return F.concat(F.substr(name, F.lit(1), at), F.substr(name, at + 2))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as they are, or without one character."""
    name, key = F.col("p_name"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.when(key % 3 == 0, name).otherwise(_without_one(name, key)).alias("word")).distinct()


def _best(words: str, ratio: float, longest: str = "") -> str:
    return f"(SELECT word, term, variant, r AS score FROM (SELECT word, term, variant, ordinal, {_ratio('word', 'variant')} AS r FROM {words} w JOIN terms ON abs(length(word) - length(variant)) <= 3 {longest}) WHERE r >= {ratio} QUALIFY row_number() OVER (PARTITION BY word ORDER BY r DESC, ordinal) = 1)"


@said(f"WITH {_TERMS}, {_WORDS} SELECT word, term FROM words LEFT JOIN terms ON word = variant")
def l1_exact_terms(spark, sf_dir):
    return fuzzy.exact(words(spark, sf_dir), terms(spark, sf_dir)).select("word", "term")


@said(f"WITH {_TERMS}, {_WORDS} SELECT word, term, round(score, 6) AS score FROM {_best('words', 0.75)}")
def l5_fuzzy_terms(spark, sf_dir):
    return fuzzy.best_match(words(spark, sf_dir), terms(spark, sf_dir), ratio=0.75).select("word", "term", F.round("score", 6).alias("score"))


@said(f"WITH {_TERMS}, {_WORDS}, hits AS (SELECT word, term, 1.0::DOUBLE AS score FROM words JOIN terms ON word = variant), misses AS (SELECT word FROM words WHERE word NOT IN (SELECT word FROM hits)) SELECT * FROM hits UNION ALL SELECT word, term, round(score, 6) FROM {_best('misses', 0.82)}")
def l4_exact_then_fuzzy(spark, sf_dir):
    return fuzzy.exact_then_fuzzy(words(spark, sf_dir), terms(spark, sf_dir), ratio=0.82).select("word", "term", F.round("score", 6).alias("score"))


@query
def l4_learned_lookup(spark, sf_dir):
    """The same by matching blocks, over the threshold alone, of words of up to 20 characters."""
    return fuzzy.exact_then_fuzzy(words(spark, sf_dir), terms(spark, sf_dir), ratio=0.82, metric="matcher", longest=20, strictly=True).select("word", "term", F.round("score", 6).alias("score"))


@query
def l6_first_similar(spark, sf_dir):
    return fuzzy.first_similar(words(spark, sf_dir), terms(spark, sf_dir), ratio=0.70)


@query
def l7_drug_similar(spark, sf_dir):
    """Terms that stand in a word or are similar; the words are names between others."""
    longer = words(spark, sf_dir).select(F.concat(F.lit("a "), "word", F.lit(" x")).alias("word"))
    return fuzzy.first_similar(longer, terms(spark, sf_dir), ratio=0.75, either_way=False)


@said(f"WITH {_TERMS}, w AS (SELECT DISTINCT substr(p_name, 1 + p_partkey % 4, 2 + p_partkey % 5) AS word FROM part) SELECT word, min_by(term, ordinal) AS term FROM w JOIN terms ON contains(variant, word) WHERE word <> '' GROUP BY word")
def l6_first_containing(spark, sf_dir):
    """The first term that holds a piece of a name, by the index of grams."""
    from textloom.operators import signatures

    key = F.col("p_partkey")
    pieces = table(spark, sf_dir, "part").select(F.substr("p_name", (1 + key % 4).cast("int"), (2 + key % 5).cast("int")).alias("inner")).distinct()
    outer = terms(spark, sf_dir).select(F.col("variant").alias("outer"), F.struct("ordinal", "term").alias("value"))
    return signatures.first_containing(pieces, outer).select(F.col("inner").alias("word"), "best.term")


@said(f"WITH {_TERMS}, {_WORDS} SELECT word, term, distance FROM (SELECT word, term, ordinal, levenshtein(word, variant) AS distance FROM words JOIN terms ON levenshtein(word, variant) <= 1) QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, ordinal) = 1")
def m8_by_edits(spark, sf_dir):
    return fuzzy.by_edits(words(spark, sf_dir), terms(spark, sf_dir), most=1)


_LINES = "lines AS (SELECT p_partkey AS id, 'need ' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE substr(p_name, 1, p_partkey % length(p_name)) || substr(p_name, p_partkey % length(p_name) + 2) END || ' today' AS text FROM part)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, key = F.col("p_name"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("id"), F.concat(F.lit("need "), F.when(key % 2 == 0, name).otherwise(_without_one(name, key)), F.lit(" today")).alias("text"))


# greedy cover by recursion over places: the longest window that has a term, else one word
_COVER = f"""w AS (SELECT id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM lines),
windows AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS word FROM w, range(1, 12) a(i), range(2, 5) b(n) WHERE i + n - 1 <= len(w)),
exact AS (SELECT word, term FROM windows JOIN terms ON word = variant),
found AS (SELECT word, term FROM exact UNION ALL SELECT word, term FROM {_best("(SELECT word FROM windows WHERE word NOT IN (SELECT word FROM exact))", 0.65)}),
hits AS (SELECT id, i, max(n) AS n, max_by(term, n) AS term FROM w, range(1, 12) a(i), range(2, 5) b(n), found WHERE i + n - 1 <= len(w) AND array_to_string(w[i:i + n - 1], ' ') = word GROUP BY id, i),
RECURSIVE_PLACE"""


@said(
    f"""WITH RECURSIVE {_TERMS}, {_LINES}, {_COVER.replace("RECURSIVE_PLACE", "cover AS (SELECT id, 1::BIGINT AS i FROM w UNION ALL SELECT c.id, c.i + coalesce(h.n, 1) FROM cover c JOIN w USING (id) LEFT JOIN hits h ON h.id = c.id AND h.i = c.i WHERE c.i + coalesce(h.n, 1) <= len(w.w))")}
SELECT c.id, string_agg(coalesce(h.term, w.w[c.i]) || ':' || coalesce(h.n, 1), '|' ORDER BY c.i) AS phrases FROM cover c JOIN w USING (id) LEFT JOIN hits h ON h.id = c.id AND h.i = c.i GROUP BY c.id"""
)
def l9_phrases(spark, sf_dir):
    out = correct.match_phrases(lines(spark, sf_dir), terms(spark, sf_dir))
    return out.select("id", F.array_join(F.transform("phrases", lambda p: F.concat(p["term"], F.lit(":"), p["n"].cast("string"))), "|").alias("phrases"))


@said(f"WITH {_TERMS}, {_WORDS}, x AS (SELECT word, term, score FROM {_best('words', 0.80)}), e AS (SELECT word, term FROM words JOIN terms ON word = variant) SELECT word AS text, coalesce(e.term, x.term) AS corrected FROM words LEFT JOIN e USING (word) LEFT JOIN x USING (word) WHERE coalesce(e.term, x.term) IS NOT NULL")
def m4_whole_lines(spark, sf_dir):
    """Lines that a term corrects as a whole, at 0.80."""
    out = correct.correct_text(words(spark, sf_dir).withColumnRenamed("word", "text"), terms(spark, sf_dir))
    held = terms(spark, sf_dir).select(F.col("term").alias("corrected"))
    near = fuzzy.exact_then_fuzzy(words(spark, sf_dir), terms(spark, sf_dir), ratio=0.80).select(F.col("word").alias("text"))
    return out.join(held, "corrected", "left_semi").join(near, "text", "left_semi").select("text", "corrected")


@query
def m4_correct_text(spark, sf_dir):
    """Names of parts in Arabic letters, cut into fragments, corrected by a dictionary of those names."""
    latin, arabic = "abcdefghijklmnopqrstuvwxyz", "ابتدهفجحيزكلمنسعصقرشثخذضظغ"
    parts = table(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", latin, arabic).alias("name"))
    own = parts.groupBy(F.col("name").alias("variant")).agg(F.min("p_partkey").alias("ordinal")).withColumn("term", F.col("variant")).withColumn("variant", normalize.normalize_arabic("variant"))
    at = (F.col("p_partkey") % 5 + 2).cast("int")
    cut = parts.select(F.col("p_partkey").alias("id"), F.concat(F.substr("name", F.lit(1), at), F.lit(" "), F.substr("name", at + 1)).alias("text"))
    return correct.correct_text(cut, own).select("id", "corrected", "changed")


@said(f"WITH {_TERMS}, {_WORDS} SELECT word, variant, round({_ratio('word', 'variant')}, 9) AS indel FROM words JOIN terms ON substr(word, 1, 3) = substr(variant, 1, 3)")
def f4_indel_ratios(spark, sf_dir):
    """Ratios of words and terms that begin alike."""
    pairs = words(spark, sf_dir).withColumn("p", F.substr("word", F.lit(1), F.lit(3))).join(terms(spark, sf_dir).withColumn("p", F.substr("variant", F.lit(1), F.lit(3))), "p")
    return pairs.select("word", "variant", F.round(similarity.indel_ratio("word", "variant") / 100, 9).alias("indel"))


@query
def f3_ratios(spark, sf_dir):
    """Both kinds of ratios of the same pairs."""
    pairs = words(spark, sf_dir).withColumn("p", F.substr("word", F.lit(1), F.lit(3))).join(terms(spark, sf_dir).withColumn("p", F.substr("variant", F.lit(1), F.lit(3))), "p")
    return pairs.select(F.col("word").alias("a"), F.col("variant").alias("b"), F.round(similarity.matcher_ratio("word", "variant"), 6).alias("matcher"), F.round(similarity.indel_ratio("word", "variant"), 6).alias("indel"))


@query
def m6_word_cascade(spark, sf_dir):
    """Names, misspelt names and doses; drugs and diagnoses are the words of the names."""
    heads = table(spark, sf_dir, "part").groupBy(F.split("p_name", " ")[0].alias("variant")).agg(F.min("p_partkey").alias("ordinal")).withColumn("term", F.upper("variant"))
    tails = table(spark, sf_dir, "part").groupBy(F.split("p_name", " ")[1].alias("variant")).agg(F.min("p_partkey").alias("ordinal")).withColumn("term", F.upper("variant"))
    doses = table(spark, sf_dir, "part").select(F.concat(F.col("p_size").cast("string"), F.lit("mg")).alias("word")).distinct()
    return correct.word_cascade(words(spark, sf_dir).union(doses), terms(spark, sf_dir), heads, tails)


@query
def m7_three_stages(spark, sf_dir):
    """Names that a customer's list has learned, then the cascade, then the spell check."""
    own = words(spark, sf_dir)
    learned = table(spark, sf_dir, "part").filter("p_partkey % 7 = 1").groupBy(F.col("p_name").alias("word")).agg(F.concat(F.lit("own "), F.min("p_brand")).alias("term"))
    return correct.three_stages(own, learned, m6_word_cascade(spark, sf_dir), fuzzy.by_edits(own, terms(spark, sf_dir)))
