"""Readers of the engine's inputs. Every one returns a DataFrame and opens nothing but by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The keys under which foreign dictionaries keep a term, in lists and in nested objects.
LIST_KEYS = ("term", "word", "name", "arabic", "ar", "headword")
OBJECT_KEYS = ("term", "word", "name", "definition", "meaning")

CORRECTIONS = "id long, crop_base64 string, raw_text string, corrected_text string, all_engine_texts string, best_engine string, confidence double, created_at timestamp, image_hash string"
LOGS = "id string, session_id string, device_id string, user_id string, timestamp timestamp, level string, category string, message string, details string, stack_trace string, screen string, memory_usage double, network_status string, app_version string, device_info string"
VERSIONS = "version_id string, version_name string, base_model string, trained_on_count int, cer_score double, wer_score double, medical_term_accuracy double, training_duration int, deployed_at string, is_active boolean, notes string, created_at string"


SAMPLES = "id string, text_en string, text_ar string, specialty string, difficulty string"
TEST_SET = "image_path string, text string, raw_text string, confidence double, engines array<string>"

# The lists that serve without a configuration, the demo cases, and kinds of files that are never taken.
CONTEXT_DRUGS = ("باراسيتامول", "أموكسيسيلين", "إيبوبروفين", "ميتفورمين", "أتورفاستاتين", "أومبرازول", "سيفالكسين", "ديكلوفيناك", "سيليبريكس", "لوسارتان", "أملوديبين", "ميترونيدازول", "أزيثرومايسين", "دكساميثازون", "هيدروكورتيزون", "سالبيوتامول")
CONTEXT_DIAGNOSES = ("كسور", "التهاب", "مزمن", "حاد", "سكري", "ضغط", "ربو", "حساسية", "فقر دم", "هشاشة عظام", "التهاب المفاصل", "ضغط دم مرتفع", "التهاب رئوي", "التهاب الجيوب الأنفية")
DEMO = [("demo_001", "Amoxicillin 500mg twice daily for 7 days", None, "prescription", "easy"), ("demo_002", "Systolic 120, Diastolic 80 mmHg", None, "vitals", "easy")]
BLOCKED = ("exe", "bat", "cmd", "sh", "js", "php", "py")


def corrections(rows: DataFrame) -> DataFrame:
    """The correction store with empty instead of missing crops and engine maps, in the order of ids."""
    engines = F.from_json(F.col("all_engine_texts"), "map<string,string>")
    return rows.withColumn("crop_base64", F.coalesce("crop_base64", F.lit(""))).withColumn("engines", F.coalesce(engines, F.create_map().cast("map<string,string>"))).orderBy("id")


def jdbc_corrections(spark: SparkSession, url: str, table: str = "corrections", parts: int = 32) -> DataFrame:
    """The store out of a database, read in ranges of ids."""
    bounds = spark.read.jdbc(url, f"(select min(id) a, max(id) b from {table}) t").first()
    return spark.read.jdbc(url, table, column="id", lowerBound=bounds[0] or 0, upperBound=(bounds[1] or 0) + 1, numPartitions=parts)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; bad and blank ones are dropped."""
    raw = spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return raw.withColumn("_bad", F.col("_corrupt_record").isNotNull()).filter("not _bad").drop("_bad", "_corrupt_record")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(wrong, correct) from files of {ground_truth, engine_predictions}: each differing prediction and the truth itself; later files win."""
    rows = json_lines(spark, path, "ground_truth string, engine_predictions map<string,string>").withColumn("file", F.input_file_name())
    pairs = rows.select("file", "ground_truth", F.explode(F.concat(F.array("ground_truth"), F.coalesce(F.map_values("engine_predictions"), F.array().cast("array<string>")))).alias("wrong")).filter("ground_truth is not null and wrong is not null")
    return pairs.groupBy("wrong").agg(F.max_by("ground_truth", F.struct("file", "ground_truth")).alias("correct"))


def newest_corrections(spark: SparkSession, path: str, schema: str, limit: int = 5000) -> DataFrame:
    """Rows of the newest files first (by name), each file's in the order of its lines; so many at most."""
    rows = json_lines(spark, path, schema).withColumns({"file": F.input_file_name(), "_block": F.input_file_block_start(), "_line": F.monotonically_increasing_id()})
    return rows.orderBy(F.desc("file"), "_block", "_line").limit(limit).drop("_block", "_line")


def learned_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(wrong, correct, count) of a learned dictionary in either of its layouts: bare, or below 'corrections'."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json(F.coalesce(F.get_json_object("value", "$.corrections"), F.col("value")), "map<string, struct<correct:string, count:long, contexts:array<string>, last_seen:string>>").alias("m"))
    return whole.select(F.explode("m").alias("wrong", "e")).select("wrong", "e.correct", "e.count", "e.contexts", "e.last_seen").filter("correct is not null")


def term_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(variant, term, ordinal) of a {term: [variants]} file; the last writer of a variant wins."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    rows = whole.select(F.posexplode(F.map_entries("m")).alias("ordinal", "e")).select("ordinal", F.col("e.key").alias("term"), F.explode(F.concat(F.array("e.key"), F.coalesce("e.value", F.array().cast("array<string>")))).alias("variant"))
    return rows.groupBy("variant").agg(F.max_by("term", "ordinal").alias("term"), F.max("ordinal").alias("ordinal"))


def term_set(spark: SparkSession, path: str) -> DataFrame:
    """(term) of every dictionary file below path, whatever its shape: lists give the entries or their naming fields, objects their keys and string values, nested objects their naming fields."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).filter("v is not null")
    top = files.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("key", "value")
    kind = F.schema_of_variant("value")
    text = F.try_variant_get("value", "$", "string")
    named = lambda keys: F.explode(F.array_compact(F.array(*(F.try_variant_get("value", f"$.{k}", "string") for k in keys))))
    parts = [
        top.filter((kind == "STRING")).select(text.alias("term")),
        top.filter("key is not null").filter(kind == "STRING").select(F.col("key").alias("term")),
        top.filter("key is null").filter(F.startswith(kind, F.lit("OBJECT"))).select(named(LIST_KEYS).alias("term")),
        top.filter("key is not null").filter(F.startswith(kind, F.lit("OBJECT"))).select(named(OBJECT_KEYS).alias("term")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select(F.trim("term").alias("term")).filter("term <> ''").distinct()


def export(rows: DataFrame) -> DataFrame:
    """What an export takes of the correction store: rows with a correction, their engine maps parsed."""
    return corrections(rows).filter(F.trim(F.coalesce("corrected_text", F.lit(""))) != "").select("id", "raw_text", "corrected_text", "engines", "best_engine", "confidence")


def export_with_crops(rows: DataFrame) -> DataFrame:
    """The export with the crops that it was read from."""
    return corrections(rows).filter(F.trim(F.coalesce("corrected_text", F.lit(""))) != "").select("id", "crop_base64", "raw_text", "corrected_text", "engines", "confidence")


def cached_terms(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """The term set below path, kept in cache; where path is not there, what cache has kept (nothing, if it has none)."""
    if exists(spark, path):
        term_set(spark, path).write.mode("overwrite").parquet(cache)
    return spark.read.schema("term string").parquet(cache) if exists(spark, cache) else spark.createDataFrame([], "term string")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def context_terms(spark: SparkSession, path: str) -> DataFrame:
    """(kind, term) of a context configuration {drugs: [...], diagnoses: [...]}; the built-in lists where there is no such file or it can't be read."""
    built_in = spark.createDataFrame([("drug", t) for t in CONTEXT_DRUGS] + [("diagnosis", t) for t in CONTEXT_DIAGNOSES], "kind string, term string")
    if not exists(spark, path):
        return built_in
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "drugs array<string>, diagnoses array<string>").alias("c"))
    lists = F.array(F.struct(F.lit("drug").alias("kind"), F.col("c.drugs").alias("terms")), F.struct(F.lit("diagnosis").alias("kind"), F.col("c.diagnoses").alias("terms")))
    found = whole.filter("c.drugs is not null or c.diagnoses is not null").select(F.explode(lists).alias("l")).select("l.kind", F.explode("l.terms").alias("term")).distinct()
    return found if found.limit(1).count() else built_in


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Demo cases of a JSON array; the built-in ones where there is no such file."""
    return spark.read.schema(SAMPLES).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame(DEMO, SAMPLES)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The version registry: a JSON array of versions, or a folder of files with one each; none where there is no such file."""
    return spark.read.schema(VERSIONS).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], VERSIONS)


def test_set(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a test set's metadata, those with an image and a text."""
    return json_lines(spark, path, TEST_SET).filter("image_path is not null and text is not null")


test_set.__test__ = False  # no test, whatever its name


def logs(spark: SparkSession, path: str, now, days: int = 7) -> DataFrame:
    return json_lines(spark, path, LOGS).filter(F.col("timestamp") > F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def allowed_uploads(found: DataFrame, *, most: int = 10 << 20, allowed: tuple[str, ...] = ("png", "jpg", "jpeg", "pdf", "tiff"), blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """found with accepted: small enough, of an allowed kind, and no part of the name of a blocked one."""
    parts = F.split(F.lower(F.element_at(F.split("path", "/"), -1)), r"\.")
    hidden = F.arrays_overlap(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, blocked)))
    return found.withColumn("accepted", (F.col("length") <= most) & F.element_at(parts, -1).isin(*allowed) & ~hidden)


def non_blank_lines(spark: SparkSession, path: str) -> DataFrame:
    """(folder, files, lines) below path, blank lines not counted."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("file"), "value").withColumn("folder", F.element_at(F.split("file", "/"), -2))
    return rows.groupBy("folder").agg(F.count_distinct("file").alias("files"), F.count_if(F.trim("value") != "").alias("lines"))


def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).filter("_r = 1").drop("_r")


def since(rows: DataFrame, mark, at: str = "updated_at") -> DataFrame:
    """What changed after a high-water mark."""
    return rows.filter(F.col(at) > F.lit(mark))
