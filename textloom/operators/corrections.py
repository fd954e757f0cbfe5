"""The store of human corrections: quality cascade, keep-first, pattern counts, profiles, splits of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.normalize import length_bin, pattern_key
from textloom.functions.patterns import native
from textloom.functions.similarity import indel_ratio, may_reach

# Fixed values of the quality rules.
MIN_LENGTH, MIN_PIXELS, HASH_LENGTH = 2, 10, 16


def truthy(*columns: str) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def quality_reasons(rows: DataFrame, *, raw: str = "raw_text", corrected: str = "corrected_text", crop: str = "crop_base64", width: str | None = None, height: str | None = None, key: str = "id") -> DataFrame:
    """rows with reason: the first rule that fails (empty, too_short, no_change, no_image, bad_image, duplicate), else valid.

    A duplicate has the hash of an earlier row, by key, among those that pass all other rules.
    """
    text = F.trim(F.coalesce(corrected, F.lit("")))
    image = F.coalesce(F.col(crop), F.lit(""))
    bad = F.lit(False) if width is None else F.coalesce((F.col(width) < MIN_PIXELS) | (F.col(height) < MIN_PIXELS), F.lit(True))
    first = F.when(text == "", "empty").when(F.length(text) < MIN_LENGTH, "too_short").when(text == F.trim(F.coalesce(raw, F.lit(""))), "no_change").when(image == "", "no_image").when(bad, "bad_image")
    hashed = F.substr(F.md5(F.concat(text, F.substr(image, F.lit(1), F.lit(200)))), F.lit(1), F.lit(HASH_LENGTH))
    out = rows.withColumn("reason", first).withColumn("hash", hashed)
    # the least key of each hash is found by a grouped minimum, and joined back, so that no task sorts all copies of one text
    least = out.filter("reason is null").groupBy(F.col("hash").alias("_h")).agg(F.min(key).alias("_first"))
    own = F.when(F.col("reason").isNull(), F.col("hash"))
    again = F.when(F.col(key) != F.col("_first"), "duplicate")
    return out.join(least, own == F.col("_h"), "left").withColumn("reason", F.coalesce("reason", again, F.lit("valid"))).drop("_h", "_first")


def keep_first(rows: DataFrame, keys: list[str | Column], order: str) -> DataFrame:
    """The first row of each value of keys, by a grouped minimum: copies are reduced before they are shuffled."""
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    best = rows.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(named))).agg(F.min_by(F.struct(*rows.columns), order).alias("_r"))
    return best.select("_r.*")


def pattern_counts(rows: DataFrame, *, raw: str = "raw_text", corrected: str = "corrected_text", at: str = "created_at") -> DataFrame:
    return rows.groupBy(pattern_key(raw).alias("pattern"), pattern_key(corrected).alias("correction")).agg(F.count("*").alias("frequency"), F.max(at).alias("last_used"))


def most_frequent(patterns: DataFrame) -> DataFrame:
    """The most frequent correction of each pattern; the least of equals."""
    best = F.min_by(F.struct("correction", "frequency"), F.struct(-F.col("frequency"), F.col("correction")))
    return patterns.groupBy("pattern").agg(best.alias("b")).select("pattern", "b.*")


def lookup(texts: DataFrame, rows: DataFrame, *, latest: int = 200, ratio: float = 70.0) -> DataFrame:
    """(text, correction, source): the most frequent correction of an equal pattern, else that of the most similar of the latest rows (id, raw_text, corrected_text), the newest of equals."""
    own = texts.select("text").distinct()
    hits = own.join(most_frequent(pattern_counts(rows.withColumn("created_at", F.lit(None).cast("timestamp")))), own.text == F.col("pattern")).select("text", "correction", F.lit("exact").alias("source"))
    misses = own.join(hits, "text", "left_anti")
    recent = F.broadcast(rows.orderBy(F.desc("id")).limit(latest).select("id", "raw_text", "corrected_text"))  # latest rows
    pairs = misses.join(recent, may_reach(F.col("text"), F.col("raw_text"), ratio / 100)).withColumn("score", indel_ratio("text", "raw_text")).filter(F.col("score") > ratio)
    near = pairs.groupBy("text").agg(F.max_by("corrected_text", F.struct("score", "id")).alias("correction")).select("text", "correction", F.lit("similar").alias("source"))
    return hits.union(near)


def save_batch(regions: DataFrame, edits: DataFrame) -> DataFrame:
    """(idx, disposition) of edits (idx, corrected) on regions (idx, text): saved, or why an edit was skipped."""
    joined = edits.join(regions.select("idx", "text"), "idx", "left")
    text = F.trim(F.coalesce("corrected", F.lit("")))
    return joined.select("idx", F.when(text == "", "empty").when(F.col("text").isNull(), "out_of_range").when(text == F.trim("text"), "unchanged").otherwise("saved").alias("disposition"))


def changed_lines(predicted: Column, edited: Column) -> Column:
    """Array of (line, predicted, corrected): edited lines by position, a missing one is the prediction."""
    a, b = F.split(predicted, "\n"), F.split(edited, "\n")
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.struct(i.alias("line"), F.element_at(a, i).alias("predicted"), F.coalesce(F.get(b, i - 1), F.element_at(a, i)).alias("corrected")))


def store_stats(rows: DataFrame, most: int = 10) -> DataFrame:
    """total, patterns, and the most frequent (pattern, correction, frequency) as an array."""
    patterns = pattern_counts(rows.withColumn("created_at", F.lit(None).cast("timestamp")))
    top = patterns.orderBy(F.desc("frequency"), "pattern", "correction").limit(most).agg(F.sort_array(F.collect_list(F.struct((-F.col("frequency")).alias("n"), "pattern", "correction"))).alias("top"))
    return rows.agg(F.count("*").alias("total")).join(patterns.agg(F.count_distinct("pattern").alias("patterns"))).join(top)


def length_profile(rows: DataFrame, text: str) -> DataFrame:
    """One row for each length bin, with the extremes, mean and median of all lengths."""
    n = F.length(F.col(text))
    binned = rows.groupBy(length_bin(n).alias("bin")).agg(F.count("*").alias("texts"))
    whole = rows.agg(F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 1).alias("mean"), F.median(n).alias("median"))
    return binned.join(F.broadcast(whole))  # one row


def confidence_profile(rows: DataFrame, confidence: str) -> DataFrame:
    c = F.col(confidence)
    return rows.filter(c > 0).agg(F.count("*").alias("n"), F.round(F.avg(c), 3).alias("mean"), F.round(F.min(c), 3).alias("least"), F.round(F.max(c), 3).alias("most"))


def engine_counts(rows: DataFrame, json: str) -> DataFrame:
    keys = F.json_object_keys(F.col(json))
    return rows.select(F.explode(keys).alias("engine")).groupBy("engine").agg(F.count("*").alias("texts"))


def learn(events: DataFrame) -> DataFrame:
    """The learned dictionary from (wrong, correct, context, at): the first correction stays, counts and distinct contexts add up."""
    return events.filter("wrong <> correct").groupBy("wrong").agg(F.min_by("correct", "at").alias("correct"), F.count("*").alias("count"), F.sort_array(F.collect_set("context")).alias("contexts"), F.max("at").alias("last_seen"))


def learned_stats(learned: DataFrame) -> DataFrame:
    return learned.agg(F.count("*").alias("entries"), F.sum("count").alias("corrections"))


def languages(rows: DataFrame, lang: str, changed: Column) -> DataFrame:
    return rows.groupBy(F.coalesce(lang, F.lit("unknown")).alias("lang")).agg(F.count("*").alias("texts"), F.count_if(changed).alias("changed"))


def hints(text: Column, script: Column) -> Column:
    """What looks odd in a correction: digits in Arabic, more than 50 words, a first character that is no letter or digit."""
    return F.array_compact(F.array(F.when(script.isin("arabic", "mixed") & text.rlike(native(r"\d")), "digits"), F.when(F.size(F.split(F.trim(text), r"\s+")) > 50, "long"), F.when(text.rlike(r"^[^\p{L}\p{N}]"), "first_character")))


def merge_feedback(feedback: DataFrame, existing: DataFrame, key: str, share: float = 0.7, least: int = 10, seed: int = 42) -> DataFrame:
    """All of feedback, and as many existing rows (by a hash of their key) as keep feedback at that share, at least so many."""
    existing = existing.select(*feedback.columns)
    n = feedback.count()
    target = max(int(n * (1 - share) / share), least)
    return feedback.union(existing.orderBy(F.xxhash64(F.lit(seed), key), key).limit(target))


def new_characters(texts: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """(token) of every character of the texts that the vocabulary (token) lacks."""
    return texts.select(F.explode(F.filter(F.split(F.col(text), ""), lambda c: c != "")).alias("token")).distinct().join(vocabulary.select("token"), "token", "left_anti")


def latest_states(events: DataFrame) -> DataFrame:
    """The review state of each region from (region_id, at, action, text): corrections make it gold and count, approval without a text makes it approved."""
    newest = F.max_by("text", F.when(F.col("action") == "correct", F.col("at")))
    edits = F.count_if(F.col("action") == "correct")
    state = F.when(edits > 0, "gold_standard").when(F.count_if(F.col("action") == "approve") > 0, "approved").otherwise("pending")
    return events.groupBy("region_id").agg(newest.alias("corrected_text"), edits.alias("correction_count"), state.alias("status"), F.max("at").alias("updated_at"))


def gold_standard(regions: DataFrame, pages: DataFrame, least: int = 1) -> DataFrame:
    """Regions fit for training with their page, newest correction first (null before all)."""
    fit = regions.filter((F.col("status") == "gold_standard") | ((F.col("status") == "pending") & F.col("corrected_text").isNotNull() & (F.col("correction_count") >= least)))
    return fit.join(pages, "page_id").orderBy(F.desc_nulls_first("corrected_at"), "region_id")


def orphans(rows: DataFrame, documents: DataFrame) -> DataFrame:
    return rows.filter("not resolved").join(documents.select("document_id"), "document_id", "left_anti")


def export_counters(rows: DataFrame, script: Column, medical: Column) -> DataFrame:
    """Exported samples by script class, with the medical terms among them."""
    return rows.groupBy(script.alias("script")).agg(F.count("*").alias("samples"), F.count_if(medical).alias("medical"))


def report(regions: DataFrame, now: Column, days: int) -> DataFrame:
    """Totals of the last so many days of (status, corrected_text, confidence, at)."""
    corrected = F.count_if(F.col("corrected_text").isNotNull())
    return regions.filter(F.col("at") > now - F.expr(f"interval {days} days")).agg(F.count("*").alias("total"), corrected.alias("corrected"), F.count_if(F.col("status") == "gold_standard").alias("gold"), F.round(F.avg("confidence"), 9).alias("confidence"), F.round(100 * corrected / F.nullif(F.count("*"), F.lit(0)), 6).alias("correction_percent"))


def page_confidence(lines: DataFrame, page: str, confidence: Column) -> DataFrame:
    return lines.groupBy(page).agg(F.round(F.avg(confidence), 9).alias("confidence"), F.count("*").alias("lines"))


def status_tallies(regions: DataFrame) -> DataFrame:
    return regions.agg(F.count_if(F.col("status") == "gold_standard").alias("gold"), F.count_if(F.col("status") == "pending").alias("pending"), F.count("*").alias("regions"))


def job_progress(items: DataFrame) -> DataFrame:
    """(job, total, done, failed, percent) of items (job, status)."""
    done = F.count_if(F.col("status") == "done")
    return items.groupBy("job").agg(F.count("*").alias("total"), done.alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(100 * done / F.count("*"), 6).alias("percent"))


def valid_keys(presented: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """(key_hash, valid) of presented keys: known by their hash, active and not expired. Only hashes are kept."""
    hashed = presented.select(F.sha2("api_key", 256).alias("key_hash"))
    joined = hashed.join(keys.select("key_hash", "active", "expires"), "key_hash", "left")
    return joined.select("key_hash", F.coalesce(F.col("active") & (F.col("expires").isNull() | (F.col("expires") > now)), F.lit(False)).alias("valid"))


def review_state(confidence: Column) -> Column:
    """Regions read with confidence are approved, others wait."""
    return F.when(confidence >= 0.75, "approved").otherwise("pending")


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence > 0.9, "high").when(confidence > 0.7, "medium").otherwise("low")
