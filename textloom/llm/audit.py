"""How document filters interact: what every filter removes at every place of every order, from one pass over the words.

The words of each text are exploded and aggregated by (document, word), then by document, for totals and distincts. Joined with the
flags of the other filters each document has a mask of the filters that it fails, and a part of the table comes down to 32 conditional
counts (three times: documents, good ones, toxic ones). All orders are read off those counts.

* Text is exchanged once, by document and a salt of the task that read it; both aggregations of words stand behind that exchange. Empty
  words mark each row, so that rows which repeat a document (doc_id and a hash of its text) share one total, and texts without words stay.
* Copies are settled by the digest of the text. Only digests that stand more than once are joined back, each under the salts that its
  rows have, so that no group of copies is one task's.
* Documents are counted by (doc_id, part, mask) before labels are joined to them, so that a doc_id of many rows, or none, is one row.

Null texts count as empty, null languages as the part ``""``. Rows that repeat a doc_id are documents of their own, and none is the
other's copy: a copy needs a smaller doc_id with the same text. Null doc_ids are no copies, have none and no label. Of repeated labels
the larger counts. An empty table has no parts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
#: Words that a text must have at least, and the least share of distinct ones and the largest of capitals in percent.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS, NO_CAPITALS, WHITE = "[#$%&*|]", "[^A-Z]+", r"[\x20\x09-\x0D]+"
#: Tasks that the rows of one document or one text are dealt to.
SALTS = 32


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, version, n_words, n_distinct) for every distinct pair of doc_id and version, from rows (doc_id, version, text)."""
    salted = docs.select("doc_id", "version", (F.spark_partition_id() % SALTS).alias("salt"), "text").repartition("doc_id", "version", "salt")
    # with white space on both sides every row has two empty words, whatever its text begins and ends with
    words = salted.select("doc_id", "version", "salt", F.explode(F.split(F.concat(F.lit(" "), "text", F.lit(" ")), WHITE)).alias("word"))
    counts = words.groupBy("doc_id", "version", "salt", "word").agg(F.count("*").alias("n"))
    empty, word = F.sum(F.when(F.col("word") == "", F.col("n"))), F.col("word") != ""
    sums = counts.groupBy("doc_id", "version", "salt").agg((2 * F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0)) / empty).cast("long").alias("n_words"), F.count_if(word).alias("n_distinct"))
    return sums.groupBy("doc_id", "version").agg(F.max("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def first_copies(docs: DataFrame) -> DataFrame:
    """(digest, salt, first) of the texts that several doc_ids hold, for every salt under which their rows stand, from rows (doc_id, digest, salt)."""
    dealt = docs.groupBy("digest", "salt").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    whole = dealt.groupBy("digest").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.collect_list("salt").alias("salts"))
    return whole.filter("first < last").select("digest", F.explode("salts").alias("salt"), "first")


def masks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): how many documents of that doc_id and part fail the filters whose bits (A: 1 ... E: 16) the mask has."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("part"), whole.alias("text"), F.xxhash64(whole).alias("version"))
    c = 100 * F.length(F.regexp_replace("text", NO_CAPITALS, "")) > MOST_CAPITALS * F.length("text")
    flags = rows.select("doc_id", "version", F.unhex(F.sha2("text", 256)).alias("digest"), "part", (F.xxhash64("doc_id") % SALTS).alias("salt"), (4 * c.cast("int") + 8 * F.col("text").rlike(SYMBOLS).cast("int")).alias("flags"))
    flags = flags.groupBy("doc_id", "version", "digest", "part", "salt", "flags").agg(F.count("*").alias("n"))
    flags = flags.join(first_copies(flags.select("doc_id", "digest", "salt")), ["digest", "salt"], "left")
    words = word_counts(rows).withColumnsRenamed({"doc_id": "word_id", "version": "word_version"})
    both = flags.join(words, F.col("doc_id").eqNullSafe(F.col("word_id")) & (F.col("version") == F.col("word_version")), "outer")
    a, b = F.col("n_words") < LEAST_WORDS, 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words")
    e = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return both.groupBy("doc_id", "part", (a.cast("int") + 2 * b.cast("int") + F.col("flags") + 16 * e.cast("int")).alias("mask")).agg(F.sum("n").alias("n"))


def counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part 32 conditional counts of documents (n0 ... n31), good ones (good0 ...) and toxic ones (toxic0 ...)."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    own = masked.join(known, "doc_id", "left")
    kinds = {"n": F.col("n"), "good": F.when(F.col("is_good"), F.col("n")), "toxic": F.when(F.col("is_toxic"), F.col("n"))}
    by_mask = own.groupBy("part", "mask").agg(*(F.sum(x).alias(k) for k, x in kinds.items()))
    return by_mask.groupBy("part").agg(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(k))), F.lit(0)).alias(f"{k}{m}") for k in kinds for m in range(32)))


def _total(kind: str, counted) -> Column:
    """The sum of a kind's counts over the masks that counted(mask) holds for."""
    return F.aggregate(F.transform(F.col(kind), lambda n, m: F.when(counted(m), n).otherwise(0)), F.lit(0).cast("long"), lambda x, y: x + y)


def orders(counted: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step: see ``audit``."""
    bit = {x: 1 << k for k, x in enumerate(LETTERS)}
    steps = [f"{''.join(order)} {k + 1} {order[k]} {bit[order[k]]} {sum(bit[x] for x in order[:k])}" for order in permutations(LETTERS) for k in range(5)]
    arrays = [F.array(*(f"{kind}{m}" for m in range(32))).alias(kind) for kind in ("n", "good", "toxic")]
    at = counted.select("part", *arrays, F.explode(F.split(F.lit(",".join(steps)), ",")).alias("at")).withColumn("at", F.split("at", " "))
    rows = at.select("part", "n", "good", "toxic", F.col("at")[0].alias("filter_order"), F.col("at")[1].cast("int").alias("step"), F.col("at")[2].alias("letter"), F.col("at")[3].cast("int").alias("own"), F.col("at")[4].cast("int").alias("before"))
    fails, earlier = lambda m: m.bitwiseAND(F.col("own")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~earlier(m)
    sums = {
        "kept": _total("n", lambda m: ~fails(m) & ~earlier(m)),
        "removed": _total("n", here),
        "redundant": _total("n", lambda m: fails(m) & earlier(m)),
        "unique_fails": _total("n", lambda m: m == F.col("own")),
        "good_lost": _total("good", here),
        "toxic_lost": _total("toxic", here),
    }
    out = rows.select("part", "filter_order", "step", "letter", *(x.alias(c) for c, x in sums.items()))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step) with the documents kept after the step, removed in it, redundant (failing its filter, removed
    earlier), failing its filter only, good and toxic ones removed in it, and what its filter removes in all 120 orders together."""
    return orders(counts(masks(docs), labels))


#: The same in DuckDB's SQL.
SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first from d),
f as (select doc_id, part, (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
        + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::int
        + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as mask from w),
l as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by doc_id),
m as (select part, mask, count(*) as n, count(*) filter (l.good) as good, count(*) filter (l.toxic) as toxic from f left join l using (doc_id) group by part, mask),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as c, unnest([1, 2, 4, 8, 16]) as bit),
o as (select a.c || b.c || c.c || d.c || e.c as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from x a, x b, x c, x d, x e
      where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s as (select filter_order, step::int as step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, range(1, 6) r(step)),
t as (select p.part, filter_order, step, own,
        coalesce(sum(n) filter (mask & own = 0 and mask & before = 0), 0)::bigint as kept,
        coalesce(sum(n) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as removed,
        coalesce(sum(n) filter (mask & own <> 0 and mask & before <> 0), 0)::bigint as redundant,
        coalesce(sum(n) filter (mask = own), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as good_lost,
        coalesce(sum(toxic) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as toxic_lost
      from (select distinct part from d) p join m on m.part = p.part, s group by p.part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, own))::bigint as shapley from t
"""
