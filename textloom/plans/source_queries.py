"""Registered queries for readers, writers and what else has no query of its own, with the SQL beside them.

A reader's query first writes a table in the reader's format below the shared folder, with the flaws that the reader must cope with.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import sources, streaming
from textloom.functions import extract, redact
from textloom.operators import clinical, correct, corrections, documents, ensemble, registry, sampling, vectors
from textloom.plans.fixtures import derived, values
from textloom.plans.queries import event_logs, query, table
from textloom.plans.stream_queries import appended, stream, unzoned
from textloom.sources import sinks, stores
from textloom.sources.shared import shared_folder

_sql: dict[str, str] = {}


def said(sql: str):
    """Registers a query together with its SQL."""

    def put(f):
        _sql[f.__name__] = sql
        return query(f)

    return put


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as rows of the correction store, some without a crop, an engine map or a correction."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 3 > 0, F.col("event_type")).alias("crop_base64"), F.col("event_type").alias("raw_text"), F.when(F.col("event_type") != "view", F.upper("event_type")).alias("corrected_text"), F.when(F.col("value") > 10, F.col("props")).alias("all_engine_texts"), F.col("event_type").alias("best_engine"), (F.col("value") / 1000).alias("confidence"), F.col("ts").cast("timestamp").alias("created_at"), F.lit(None).cast("string").alias("image_hash"))


# readers


@said("SELECT event_id AS id, CASE WHEN user_id % 3 > 0 THEN event_type ELSE '' END AS crop_base64, CASE WHEN value > 10 THEN len(json_keys(props)) ELSE 0 END::INT AS engines FROM events")
def sc1_corrections(spark, sf_dir):
    return sources.corrections(stored(spark, sf_dir)).select("id", "crop_base64", F.size("engines").alias("engines"))


@said("SELECT event_id AS id, event_type AS raw_text, upper(event_type) AS corrected_text, CASE WHEN value > 10 THEN array_to_string(json_keys(props), ',') ELSE '' END AS engines FROM events WHERE event_type <> 'view'")
def sc2_export(spark, sf_dir):
    return sources.export(stored(spark, sf_dir)).select("id", "raw_text", "corrected_text", F.array_join(F.map_keys("engines"), ",").alias("engines"))


@said("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def sc4_json_lines(spark, sf_dir):
    """Every turn, although each first turn is followed by a broken and a blank line."""
    c, folder = table(spark, sf_dir, "conversations"), shared_folder(spark)
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    c.select(F.explode(F.when(F.col("turn") == 0, F.array(line, F.lit('{"conv_id": 1, "tur'), F.lit(""))).otherwise(F.array(line))).alias("value")).write.text(f"{folder}/lines")
    return sources.json_lines(spark, f"{folder}/lines", "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@said("""WITH w AS (SELECT 1 AS file, p_brand AS truth, unnest([p_brand, p_type, p_name]) AS wrong FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT 2, p_name, unnest([p_name, p_type, p_name]) FROM part WHERE p_partkey % 2 = 1)
    SELECT wrong, truth AS correct FROM (SELECT *, row_number() OVER (PARTITION BY wrong ORDER BY file DESC, truth DESC) AS r FROM w) WHERE r = 1""")
def l10_ground_truth(spark, sf_dir):
    """Types and containers as what two engines read; the second folder's files come later in name and win."""
    p, folder = table(spark, sf_dir, "part"), shared_folder(spark)
    read = F.create_map(F.lit("alpha"), "p_type", F.lit("beta"), "p_name").alias("engine_predictions")
    for k, truth in ((0, "p_brand"), (1, "p_name")):
        p.filter(F.col("p_partkey") % 2 == k).select(F.col(truth).alias("ground_truth"), read).coalesce(1).write.json(f"{folder}/truth/{k + 1}")
    rows = sources.ground_truth(spark, f"{folder}/truth/*")
    return rows.select("wrong", "correct")


@said("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM events GROUP BY 1")
def sk5_daily_append(spark, sf_dir):
    """Two appends below the same days."""
    e, folder = table(spark, sf_dir, "events"), shared_folder(spark)
    for k in (0, 1):
        sinks.daily_json(e.filter(F.col("event_id") % 2 == k), f"{folder}/corrections", "ts")
    return spark.read.json(f"{folder}/corrections").groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"))


@said("SELECT event_id FROM events ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id LIMIT 200")
def sc6_newest_corrections(spark, sf_dir):
    """The first 200 of the newest days' files, in the order of their lines."""
    e, folder = table(spark, sf_dir, "events").select("event_id", "ts"), shared_folder(spark)
    sinks.daily_json(e.repartition(F.to_date("ts")).sortWithinPartitions("event_id"), f"{folder}/corrections", "ts")
    return sources.newest_corrections(spark, f"{folder}/corrections/*", "event_id long", 200).select("event_id")


@said("SELECT n_name AS wrong, upper(n_name) AS correct, n_nationkey + 1 AS count FROM nation UNION ALL SELECT r_name, lower(r_name), r_regionkey + 1 FROM region")
def sc7_learned_dictionary(spark, sf_dir):
    """The bare layout (nations) and the one below 'corrections' (regions)."""
    folder = shared_folder(spark)
    for name, key, change, layout in (("nation", "n", F.upper, "{}"), ("region", "r", F.lower, '{{"version":1,"corrections":{}}}')):
        rows = table(spark, sf_dir, name)
        entry = F.struct(change(f"{key}_name").alias("correct"), (F.col(f"{key}_{name}key") + 1).alias("count"), F.array(F.lit("c")).alias("contexts"))
        whole = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(f"{key}_name"), entry)))).alias("value"))  # a few names
        whole.select(F.concat(F.lit(layout.format("\0").split("\0")[0]), "value", F.lit(layout.format("\0").split("\0")[1]))).write.text(f"{folder}/learned/{name}")
    return sources.learned_dictionary(spark, f"{folder}/learned/*").select("wrong", "correct", "count")


@said("""WITH v AS (SELECT r_name AS term, r_regionkey AS o, unnest([r_name, lower(r_name), 'shared']) AS variant FROM region)
    SELECT variant, term, o::INT AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY o DESC) AS r FROM v) WHERE r = 1""")
def sc8_term_dictionary(spark, sf_dir):
    """Regions in small letters, and one variant that all share: the last of the file wins."""
    r, folder = table(spark, sf_dir, "region"), shared_folder(spark)
    entries = F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: F.struct(x["r_name"], F.array(F.lower(x["r_name"]), F.lit("shared"))))
    r.agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.text(f"{folder}/terms")
    return sources.term_dictionary(spark, f"{folder}/terms")


def _foreign(spark: SparkSession, sf_dir: str) -> str:
    """Dictionaries in four shapes, in folders of their own."""
    folder = f"{shared_folder(spark)}/foreign"
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n.agg(F.to_json(F.collect_list("n_name")).alias("value")).write.text(f"{folder}/a/list")
    n.agg(F.to_json(F.collect_list(F.struct(F.lower("n_name").alias("word")))).alias("value")).write.text(f"{folder}/a/objects")
    r.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("r_name"), F.lower("r_name"))))).alias("value")).write.text(f"{folder}/b/map")
    r.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("r_regionkey").cast("string"), F.struct(F.concat(F.lit("the "), "r_name").alias("meaning")))))).alias("value")).write.text(f"{folder}/b/c/nested")
    return folder


TERMS = "SELECT n_name AS term FROM nation UNION SELECT lower(n_name) FROM nation UNION SELECT r_name FROM region UNION SELECT lower(r_name) FROM region UNION SELECT 'the ' || r_name FROM region"


@said(TERMS)
def sc10_term_set(spark, sf_dir):
    return sources.term_set(spark, _foreign(spark, sf_dir))


@said(f"SELECT count(*) AS terms, count(DISTINCT lower(term)) AS words, max(length(term)) AS longest FROM ({TERMS} UNION SELECT p_type FROM part) t")
def u2_term_union(spark, sf_dir):
    terms = sources.term_set(spark, _foreign(spark, sf_dir)).union(table(spark, sf_dir, "part").select(F.col("p_type").alias("term"))).distinct()
    return terms.agg(F.count("*").alias("terms"), F.count_distinct(F.lower("term")).alias("words"), F.max(F.length("term")).cast("long").alias("longest"))


@said(f"SELECT 'built in' AS source, kind, term FROM {values('', [('drug', t) for t in sources.CONTEXT_DRUGS] + [('diagnosis', t) for t in sources.CONTEXT_DIAGNOSES], 'kind, term')} UNION ALL SELECT DISTINCT 'file', 'drug', p_brand FROM part UNION ALL SELECT DISTINCT 'file', 'diagnosis', p_name FROM part")
def sc9_context_terms(spark, sf_dir):
    p, folder = table(spark, sf_dir, "part"), shared_folder(spark)
    p.agg(F.to_json(F.struct(F.collect_set("p_brand").alias("drugs"), F.collect_set("p_name").alias("diagnoses"))).alias("value")).write.text(f"{folder}/config")
    name = lambda path, source: sources.context_terms(spark, path).select(F.lit(source).alias("source"), "kind", "term")
    return name(f"{folder}/none", "built in").union(name(f"{folder}/config", "file"))


@said(f"SELECT 'built in' AS source, id, text_en FROM {values('', [d[:2] for d in sources.DEMO], 'id, text_en')} UNION ALL SELECT 'file', n_nationkey::VARCHAR, n_name FROM nation")
def sc17_demo_cases(spark, sf_dir):
    folder = shared_folder(spark)
    table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("text_en")))).alias("value")).write.text(f"{folder}/cases")
    name = lambda path, source: sources.samples(spark, path).select(F.lit(source).alias("source"), "id", "text_en")
    return name(f"{folder}/none", "built in").union(name(f"{folder}/cases", "file"))


@said(f"SELECT version AS version_id, cer AS cer_score, is_active FROM {values('VERSIONS')}")
def sc18_versions(spark, sf_dir):
    folder = shared_folder(spark)
    v = derived(spark, "VERSIONS", sf_dir).select(F.col("version").alias("version_id"), F.col("cer").alias("cer_score"), "is_active")
    # arrays of about 20,000 versions, each in a file of its own: one array of all is one task's, written and read
    parts = max(1, -(-v.count() // 20_000))
    arrays = v.groupBy(F.pmod(F.xxhash64("version_id"), F.lit(parts)).alias("part")).agg(F.to_json(F.collect_list(F.struct("version_id", "cer_score", "is_active"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{folder}/versions")
    return sources.versions(spark, f"{folder}/versions").union(sources.versions(spark, f"{folder}/none")).select("version_id", "cer_score", "is_active")


@said("SELECT level, count(*) AS logs FROM (SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'warn' WHEN value > 90 THEN 'fatal' ELSE 'info' END AS level FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY) GROUP BY 1")
def sc19_log_files(spark, sf_dir):
    logs, folder = event_logs(spark, sf_dir), shared_folder(spark)
    logs.select("id", F.col("ts").cast("timestamp").alias("timestamp"), "level", "message").write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{folder}/logs")
    now = logs.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return sources.logs(spark, f"{folder}/logs", now).groupBy("level").agg(F.count("*").alias("logs"))


@said("SELECT event_id::VARCHAR || '.png' AS image, upper(event_type) AS text FROM events WHERE event_type <> 'view' AND user_id % 3 > 0")
def sc20_test_sets(spark, sf_dir):
    """The lines that the feedback writer wrote, read as a test set."""
    folder = shared_folder(spark)
    sinks.feedback(sources.export_with_crops(stored(spark, sf_dir)).withColumn("split", F.lit("test")), f"{folder}/feedback")
    return sources.test_set(spark, f"{folder}/feedback/lines").select(F.element_at(F.split("image_path", "/"), -1).alias("image"), "text")


@said("SELECT source AS folder, 1::BIGINT AS files, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))::BIGINT AS lines FROM documents WHERE text IS NOT NULL GROUP BY 1")
def a28_line_counts(spark, sf_dir):
    """The texts of each source in one file below its name."""
    folder = shared_folder(spark)
    table(spark, sf_dir, "documents").filter("text is not null").select("source", "text").repartition("source").write.partitionBy("source").text(f"{folder}/texts")
    out = sources.non_blank_lines(spark, f"{folder}/texts")
    return out.select(F.regexp_replace("folder", "^source=", "").alias("folder"), "files", "lines")


@said("SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) - INTERVAL 30 DAY FROM orders)")
def st11_since(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    mark = o.agg(F.max("o_orderdate") - F.expr("interval 30 days")).first()[0]
    return sources.since(o, mark, "o_orderdate").select("o_orderkey")


@said("SELECT CASE WHEN o_orderdate < DATE '1996-01-01' AND o_orderkey % 3 > 0 THEN 0 WHEN o_orderdate < DATE '1996-01-01' OR o_orderdate <= DATE '1999-01-01' THEN 1 ELSE 2 END AS sync, count(*) AS orders, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE NOT (o_orderdate < DATE '1996-01-01' AND o_orderkey % 3 = 0 AND o_orderdate < (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < DATE '1996-01-01' AND o_orderkey % 3 > 0)) GROUP BY 1")
def st11_syncs(spark, sf_dir):
    """Three syncs from the stored mark; the second finds late orders of the mark's own time, older ones are not looked at."""
    folder, o = shared_folder(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    parts = [o.filter(early & (F.col("o_orderkey") % 3 > 0)), o.filter(early | (F.col("o_orderdate") <= F.lit("1999-01-01").cast("timestamp_ntz"))), o]
    out = [stores.sync(part, f"{folder}/orders", at="o_orderdate", key="o_orderkey").withColumn("sync", F.lit(k)) for k, part in enumerate(parts)]
    return out[0].union(out[1]).union(out[2]).groupBy("sync").agg(F.count("*").alias("orders"), F.sum("o_orderkey").alias("keys"))


@said("SELECT doc_id, n_chars * 4000 <= 10485760 AND lang IN ('en', 'de') AND NOT source = 'src1' AS accepted FROM documents")
def p16_uploads(spark, sf_dir):
    """Documents as files: English are png, German pdf, others txt; those of one source hide a blocked kind in their names."""
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "png").when(F.col("lang") == "de", "PDF").otherwise("txt")
    files = d.select("doc_id", (F.col("n_chars") * 4000).alias("length"), F.concat(F.lit("/up.exe/"), "doc_id", F.when(F.col("source") == "src1", ".exe.").otherwise("."), kind).alias("path"))
    return sources.allowed_uploads(files).select("doc_id", "accepted")


# writers


@said("WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT n, floor(n * 0.15)::BIGINT AS k FROM n) SELECT 'test' AS split, k AS rows FROM s UNION ALL SELECT 'validation', k FROM s UNION ALL SELECT 'train', n - 2 * k FROM s")
def sk3_split_files(spark, sf_dir):
    folder = shared_folder(spark)
    sinks.split_json(sampling.exact_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", {"test": 0.15, "validation": 0.15}, "train"), f"{folder}/splits")
    return spark.read.json(f"{folder}/splits").groupBy("split").agg(F.count("*").alias("rows"))


@said("SELECT CASE WHEN event_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) FILTER (user_id % 3 > 0) AS saved, count(*) FILTER (user_id % 3 = 0) AS failed FROM events WHERE event_type <> 'view' GROUP BY 1")
def sk4_feedback(spark, sf_dir):
    rows = sources.export_with_crops(stored(spark, sf_dir)).withColumn("split", F.when(F.col("id") % 10 == 0, "test").otherwise("train"))
    return sinks.feedback(rows, f"{shared_folder(spark)}/feedback")


@said("SELECT event_type AS pattern, props AS correction, count(*) AS frequency, max(ts) AS last_used FROM events GROUP BY 1, 2")
def sk1_upserts(spark, sf_dir):
    """Pattern counts of two batches, the second sent twice, merged into the buckets of a store."""
    folder = shared_folder(spark)
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("raw_text"), F.col("props").alias("corrected_text"), F.col("ts").alias("created_at"))
    for batch in (0, 1, 1):
        counts = corrections.pattern_counts(e.filter(F.col("event_id") % 2 == batch)).withColumn("frequency", F.col("frequency").cast("long"))
        stores.upsert(counts, batch, f"{folder}/patterns", ["pattern", "correction"], {"frequency": F.sum, "last_used": F.max}, buckets=8)
    return stores.stored(spark, f"{folder}/patterns", counts.schema)


@said("SELECT 'tablet' AS device, count(*) OVER () AS entries, sum(n) OVER ()::BIGINT AS total, wrong, n AS count FROM (SELECT event_type AS wrong, count(*) AS n FROM events GROUP BY 1)")
def sk7_upload(spark, sf_dir):
    learned = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("wrong")).agg(F.count("*").alias("count")).withColumn("correct", F.upper("wrong"))
    return sinks.dictionary_envelope(learned, "tablet", F.lit("2024-02-01")).select("device", "entries", "total", "wrong", "count")


@said("SELECT user_id, epoch(ts)::BIGINT - epoch(lag(ts) OVER w)::BIGINT >= 300 OR lag(ts) OVER w IS NULL AS due, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def sk7_due(spark, sf_dir):
    """Which events of a user would trigger an upload, if each did one."""
    from pyspark.sql import Window

    last = F.lag("ts").over(Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id")))
    return table(spark, sf_dir, "events").select("user_id", sinks.due(last, F.col("ts")).alias("due"), "event_id")


@said("SELECT least(5000, count(*)) AS kept, count(DISTINCT lang) AS languages FROM documents")
def sk9_restored(spark, sf_dir):
    """The replay buffer, written and read again: full or all, and no class lost."""
    folder, d = shared_folder(spark), table(spark, sf_dir, "documents").select("doc_id", "lang")
    sinks.table(sampling.class_floor_reservoir(d, "lang", "doc_id", 5000, 20), f"{folder}/buffer")
    return spark.read.parquet(f"{folder}/buffer").agg(F.count("*").alias("kept"), F.count_distinct("lang").alias("languages"))


@said("SELECT event_type AS wrong, upper(event_type) AS correct, count(*) AS count FROM events GROUP BY 1")
def sk10_learned_saved(spark, sf_dir):
    """A learned dictionary, saved and read in its own format; a later download replaces it (the first is gone)."""
    folder = shared_folder(spark)
    learned = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("wrong")).agg(F.count("*").alias("count")).withColumn("correct", F.upper("wrong"))
    for rows in (learned.limit(0).union(learned.limit(1).select(F.lit("old"), "count", "correct")), learned):
        sinks.save_learned(rows, f"{folder}/learned")
    return sources.learned_dictionary(spark, f"{folder}/learned").select("wrong", "correct", "count")


@said("SELECT 'ok' AS state, count(DISTINCT n_regionkey) - 1 AS files FROM nation UNION ALL SELECT 'changed', 1 UNION ALL SELECT 'missing', 1")
def sk11_backup(spark, sf_dir):
    """The files of a backup against a manifest in which one has another sum, and one is gone."""
    folder = shared_folder(spark)
    table(spark, sf_dir, "nation").repartition("n_regionkey").write.partitionBy("n_regionkey").json(f"{folder}/backup")
    files = sources.files(spark, f"{folder}/backup/*", "*.json")
    expected = sinks.manifest(files).withColumn("md5", F.when(F.contains("path", F.lit("n_regionkey=0")), "0").otherwise(F.col("md5"))).select("path", "md5")
    expected = expected.union(spark.createDataFrame([("gone", "1")], "path string, md5 string"))
    return sinks.verify(files, expected).groupBy("state").agg(F.count("*").alias("files"))


# samples, orders, buffers


@said("SELECT least(30, count(*) FILTER (lang = 'de')) AS rows, least(30, count(*) FILTER (lang = 'de')) AS docs, 'de' AS lang FROM documents")
def p14_class_sample(spark, sf_dir):
    return sampling.class_sample(table(spark, sf_dir, "documents"), "lang", "doc_id", 30, "de").agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("docs"), F.max("lang").alias("lang"))


@said("SELECT least(100, count(*)) AS rows, least(100, count(*)) AS docs FROM documents")
def s12_simple_sample(spark, sf_dir):
    return sampling.simple_sample(table(spark, sf_dir, "documents"), "doc_id", 100).agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("docs"))


@said("WITH f AS (SELECT p_type AS e, count(*) AS n FROM part GROUP BY 1) SELECT (SELECT sum(n) FROM f)::BIGINT AS total_hard, (SELECT count(*) FROM f) AS unique_errors, (SELECT string_agg(e || '=' || n, ',' ORDER BY n DESC, e) FROM (SELECT * FROM f ORDER BY n DESC, e LIMIT 10)) AS top, 100000 AS capacity, 0.3::DOUBLE AS threshold")
def s3_error_statistics(spark, sf_dir):
    out = sampling.miner_statistics(table(spark, sf_dir, "part"), "p_type", 100_000, 0.3)
    return out.select("total_hard", "unique_errors", F.array_join(F.transform("top_errors", lambda t: F.concat(t["error"], F.lit("="), t["frequency"])), ",").alias("top"), "capacity", "threshold")


@said("SELECT n_regionkey AS class, 1::BIGINT AS victims FROM nation WHERE n_regionkey <> 3 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def w4_victim_class(spark, sf_dir):
    out = sampling.victims(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", 3)
    return out.groupBy(F.col("n_regionkey").alias("class")).agg(F.count("*").alias("victims"))


@said("SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS region_index, length(unnest(string_split(text, chr(10)))) AS chars FROM documents WHERE text IS NOT NULL")
def w10_reading_order(spark, sf_dir):
    """Lines as the regions of a page."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return ensemble.reading_order(rows, "doc_id", "lines").select("doc_id", F.col("region_index").cast("long").alias("region_index"), F.length("region").cast("long").alias("chars"))


@said("SELECT n_name, row_number() OVER (ORDER BY n_regionkey DESC, n_name) - 1 AS place FROM nation")
def t7_sorted_by(spark, sf_dir):
    rows = registry.sorted_by(table(spark, sf_dir, "nation"), "n_regionkey", descending=True, key="n_name")
    ordered = rows.agg(F.collect_list("n_name").alias("names"))  # the few versions of a list, in their order
    return ordered.select(F.posexplode("names").alias("place", "n_name")).select("n_name", F.col("place").cast("long").alias("place"))


@said("SELECT event_type, printf('%.1f%%', round(count(*) FILTER (value > 90) * 1000.0 / count(*)) / 10) AS high FROM events GROUP BY 1")
def f7_percent(spark, sf_dir):
    share = F.round(F.count_if(F.col("value") > 90) * 1000.0 / F.count("*")) / 1000
    return table(spark, sf_dir, "events").groupBy("event_type").agg(registry.percent(share).alias("high"))


@said("SELECT base64(encode(n_name)) AS encoded, n_name AS decoded, md5(n_name) AS md5, sha256(n_name) AS sha256 FROM nation")
def f12_encodings(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("encoded", F.base64(F.col("n_name").cast("binary")))
    return n.select("encoded", F.unbase64("encoded").cast("string").alias("decoded"), F.md5("n_name").alias("md5"), F.sha2("n_name", 256).alias("sha256"))


@said("SELECT event_id, array_to_string(['b'], ',') AS bbox, event_type AS text, value AS confidence, 'e' AS engine FROM events")
def p13_legacy_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat_ws(",", F.array(F.lit("b"))).alias("bbox"), F.col("event_type").alias("text"), F.col("value").alias("confidence"), F.lit("e").alias("engine"), "event_id", "ts")
    out = ensemble.legacy_columns(rows.withColumn("engine", F.concat("engine", F.lit("|"), "event_id")))
    return out.select(F.split("engine", r"\|")[1].cast("long").alias("event_id"), "bbox", "text", "confidence", F.split("engine", r"\|")[0].alias("engine"))


# text


@said(r"SELECT doc_id, len(regexp_extract_all(text, '(?i)(?:رقم المريض|رقم الملف|MRN|File\s*[Nn]o|Patient\s*[Ii]D)[:\s\-]*(\d{3,})')) AS n_patient_id, len(regexp_extract_all(text, '(?i)(?:عيادة|مريض|حجز|موعد|رقم|كشف|تذكرة)[\s:]*(\d{3,8})')) AS n_medical_number, len(regexp_extract_all(text, '(?:(?:\+?966|\+?971|\+?965|\+?974|\+?968|\+?20|\+?1)?[\s\-]?(?:05|5)?\d[\d\-\(\)\s]{7,14})')) AS n_phone FROM documents")
def a21_other_private_counts(spark, sf_dir):
    """The other three of the six patterns."""
    n = dict(zip((name for name, _ in redact.PATTERNS), redact.counts("text", plain=True), strict=True))
    return table(spark, sf_dir, "documents").select("doc_id", *(n[name].cast("long").alias(f"n_{name}") for name in ("patient_id", "medical_number", "phone")))


@said("SELECT CASE WHEN regexp_matches(w, '^(\\d+)$') THEN 'page_number' WHEN regexp_matches(w, '^(\\d+)[-\\.]') THEN 'section_number' WHEN regexp_matches(w, '(\\d+\\.?\\d*)\\s*(مجم|mg|مل|ml|قرص|مرة)') THEN 'dosage' ELSE '' END AS names, count(*) AS words FROM (SELECT unnest([p_size::VARCHAR, p_size || '. ' || p_name, p_size || ' mg', p_name]) AS w FROM part) GROUP BY 1")
def e8_named_patterns(spark, sf_dir):
    size = F.col("p_size").cast("string")
    lines = table(spark, sf_dir, "part").select(F.explode(F.array(size, F.concat(size, F.lit(". "), "p_name"), F.concat(size, F.lit(" mg")), F.col("p_name"))).alias("w"))
    return lines.groupBy(F.array_join(extract.named(F.col("w")), ",").alias("names")).agg(F.count("*").alias("words"))


@said("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '+' || o_orderkey::VARCHAR || ' 555 00' END AS phone FROM orders")
def e6_phones(spark, sf_dir):
    number = F.concat(F.lit("Name: X\ntel: +"), F.col("o_orderkey").cast("string"), F.lit(" 555 00\nend"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, number).otherwise("no number").alias("text"))
    return rows.select("id", extract.patient(F.col("text"))["phone"].alias("phone"))


@said("SELECT doc_id, len(s) AS sections, list_sum(list_transform(s, lambda x: length(x)))::BIGINT AS chars, s[2] AS second FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) WHERE len(s) > 0")
def do5_sections(spark, sf_dir):
    return documents.section_chunks(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum(F.length("chunk_text")).alias("chars"), F.max(F.when(F.col("chunk") == 1, F.col("chunk_text"))).alias("second"))


# clinical rules with their texts


@said(f"SELECT id, a, b, severity, mechanism, effect, management, source FROM (SELECT DISTINCT x.id, d.* FROM (SELECT id, lower(unnest(drugs)) AS a FROM {values('DRUG_LISTS')}) x JOIN (SELECT id, lower(unnest(drugs)) AS b FROM {values('DRUG_LISTS')}) y ON x.id = y.id AND x.a < y.b JOIN (SELECT least(i.a, i.b) AS a, greatest(i.a, i.b) AS b, severity, mechanism, effect, management, source FROM {values('', clinical.INTERACTIONS, 'a, b, severity, evidence')} i JOIN {values('', clinical.INTERACTION_TEXTS, 'a, b, mechanism, effect, management, source')} t ON i.a = t.a AND i.b = t.b) d ON d.a = x.a AND d.b = y.b)")
def j2_interaction_texts(spark, sf_dir):
    found = clinical.drug_interactions(derived(spark, "DRUG_LISTS", sf_dir), clinical.interactions(spark))
    return clinical.with_texts(found, clinical.interaction_texts(spark), ["a", "b"]).select("id", "a", "b", "severity", "mechanism", "effect", "management", "source")


@said(f"SELECT id, p.drug, p.condition, details, alternative FROM (SELECT id, replace(lower(drug), '_', ' ') AS drug, replace(lower(unnest(conditions)), '_', ' ') AS condition FROM {values('PATIENTS')}) p JOIN {values('', [(a.replace('_', ' '), b.replace('_', ' '), *r) for a, b, *r in clinical.CONTRAINDICATION_TEXTS], 'drug, condition, details, details_ar, alternative')} t ON p.drug = t.drug AND p.condition = t.condition")
def j3_contraindication_texts(spark, sf_dir):
    found = clinical.contraindicated(derived(spark, "PATIENTS", sf_dir), clinical.contraindications(spark))
    return clinical.with_texts(found, clinical.contraindication_texts(spark), ["drug", "condition"]).select("id", "drug", "condition", "details", "alternative")


# corrections in five stages


_STAGES = ("ortho", "user", "context", "advanced", "large")


@said("SELECT word, CASE length(word) WHEN 3 THEN 'ortho' WHEN 4 THEN 'user' WHEN 5 THEN 'context' WHEN 6 THEN 'advanced' WHEN 7 THEN 'large' ELSE 'none' END AS source, CASE WHEN length(word) BETWEEN 3 AND 7 THEN CASE length(word) WHEN 3 THEN 'ortho' WHEN 4 THEN 'user' WHEN 5 THEN 'context' WHEN 6 THEN 'advanced' ELSE 'large' END || ' ' || upper(word) ELSE word END AS corrected FROM (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) AS word FROM part)")
def do12_five_stages(spark, sf_dir):
    """All words of the parts; each stage's dictionary has the words of its own length and those of the stages before it."""
    known = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), " ")).alias("word")).distinct()
    stages = [(name, known.filter(F.length("word").between(3, 3 + k)).select("word", F.concat(F.lit(f"{name} "), F.upper("word")).alias("corrected"))) for k, name in enumerate(_STAGES)]
    return correct.staged(known, stages)


# office files


def _office(rows: DataFrame) -> DataFrame:
    """(path, content) of rows (path, kind, text): the smallest office file of a kind that holds the text, a paragraph for each line, in slides of three. They are made a few at a time, as a batch of them is many times its texts."""
    spaces = {"docx": "wordprocessingml", "pptx": "drawingml", "ppt": "drawingml"}

    def one(kind: str, text: str) -> bytes:
        space = f"http://schemas.openxmlformats.org/{spaces[kind]}/2006/main"
        lines = [f"<p><t>{escape(line)}</t></p>" for line in text.split("\n")]
        groups = [lines] if kind == "docx" else [lines[k : k + 3] for k in range(0, len(lines), 3)]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for k, group in enumerate(groups):
                archive.writestr("word/document.xml" if kind == "docx" else f"ppt/slides/slide{k + 1}.xml", f'<d xmlns="{space}">{"".join(group)}</d>')
        return out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, documents.FILES):
                part = batch.slice(a, documents.FILES)
                contents = [one(kind, text) for kind, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(contents, pa.binary())], names=["path", "content"])

    return rows.select("path", "kind", "text").mapInArrow(run, "path string, content binary")


def office_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The conversations' turns as files."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    return _office(c.select(F.concat_ws("/", "conv_id", F.concat("turn", F.lit(f".{kind}"))).alias("path"), F.lit(kind).alias("kind"), "text"))


_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"


@said(f"SELECT conv_id || '/' || turn || '.docx' AS path, 1::INT AS page, md5(array_to_string({_LINES}, chr(10))) AS digest FROM conversations WHERE text IS NOT NULL")
def sc14_docx(spark, sf_dir):
    return documents.parse_files(office_files(spark, sf_dir, "docx")).select("path", "page", F.md5("text").alias("digest"))


@said("SELECT conv_id || '/' || turn || '.pptx' AS path, k::INT AS page, md5(array_to_string(list_filter(l[3 * k - 2:3 * k], lambda x: trim(x) <> ''), chr(10))) AS digest FROM (SELECT *, string_split(text, chr(10)) AS l FROM conversations WHERE text IS NOT NULL), range(1, 10000) r(k) WHERE 3 * k - 2 <= len(l)")
def sc15_pptx(spark, sf_dir):
    return documents.parse_files(office_files(spark, sf_dir, "pptx")).select("path", "page", F.md5("text").alias("digest"))


@said("SELECT conv_id || '/' || turn || CASE conv_id % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.ppt' WHEN 2 THEN '.pdf' ELSE '.xyz' END AS path, CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unreadable: BadZipFile' WHEN 2 THEN 'no PDF reader is installed' ELSE 'unknown type xyz' END AS warning FROM conversations WHERE text IS NOT NULL")
def sc12_dispatch(spark, sf_dir):
    """Files by their names: a document, a presentation of the old format (which is no archive), a PDF and an unknown kind."""
    kind = F.when(F.col("conv_id") % 4 == 0, "docx").when(F.col("conv_id") % 4 == 1, "ppt").when(F.col("conv_id") % 4 == 2, "pdf").otherwise("xyz")
    c = table(spark, sf_dir, "conversations").filter("text is not null").select(F.concat_ws("/", "conv_id", F.concat("turn", F.lit("."), kind)).alias("path"), kind.alias("kind"), "text")
    files = _office(c.filter("kind = 'docx'")).union(c.filter("kind <> 'docx'").select("path", F.col("text").cast("binary")))
    return documents.parse_files(files).select("path", "warning")


# vectors


@said("WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q, CASE WHEN vec_id % 200 = 0 THEN ['the', 'and'] ELSE ['de', 'la', 'is'] END AS terms FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, e.vec_id, round(0.7 * list_cosine_similarity(e.embedding::DOUBLE[], q.q) + 0.3 * len(list_filter(q.terms, lambda t: contains(lower(d.text), t)))::DOUBLE / len(q.terms), 6) AS score FROM embeddings e, q, documents d WHERE d.doc_id = e.vec_id AND d.lang <> 'fr') SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 4) AS score FROM s QUALIFY rank <= 10")
def do6_hybrid(spark, sf_dir):
    """The ten best by nearness and words of every vector whose id is divisible by 100, without French texts."""
    v = table(spark, sf_dir, "embeddings")
    terms = F.when(F.col("vec_id") % 200 == 0, F.array(F.lit("the"), F.lit("AND"))).otherwise(F.array(F.lit("de"), F.lit("la"), F.lit("is")))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
    return vectors.hybrid(v, v.filter("vec_id % 100 = 0").withColumn("terms", terms), texts, where=F.col("lang") != "fr").select("query", "rank", "vec_id", F.round("score", 4).alias("score"))


# streams


@said("SELECT p.event_id, d.ts AS document_ts FROM events p LEFT JOIN (SELECT user_id, ts FROM events WHERE event_id % 50 = 7) d ON d.user_id = p.user_id AND d.ts >= p.ts AND d.ts <= p.ts + INTERVAL 3 HOUR WHERE p.event_type = 'error' AND d.ts IS NOT NULL")
def st10_late_documents(spark, sf_dir):
    """Errors as corrections, some events as the documents that come within three hours."""
    e = stream(spark, sf_dir, "events")
    orphans = e.filter("event_type = 'error'").select("event_id", F.col("user_id").alias("document_id"), "ts")
    found = e.filter("event_id % 50 = 7").select(F.col("user_id").alias("document_id"), F.col("ts").alias("document_ts"))
    return appended(streaming.resolved(orphans, found, wait="3 hours")).filter("document_ts is not null").select("event_id", "document_ts")


@said("SELECT event_type, count(*) AS events FROM events GROUP BY 1")
def st8_flushes(spark, sf_dir):
    """Flushed at intervals until nothing is left; each flush is a batch that may be repeated."""
    folder = shared_folder(spark)
    streaming.every(stream(spark, sf_dir, "events"), streaming.append_batches(f"{folder}/out"), f"{folder}/checkpoint", seconds=1, until_idle=True)
    return unzoned(spark.read.parquet(f"{folder}/out")).groupBy("event_type").agg(F.count("*").alias("events"))


@said("SELECT name, strftime(to_timestamp((floor((1704105000 - o) / p) + 1) * p + o) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS due FROM (SELECT c_name AS name, 3600.0 * (1 + c_custkey % 200) AS p, (c_custkey * 61 % 3600)::DOUBLE AS o FROM customer)")
def st13_schedule(spark, sf_dir):
    """When a job of each customer runs next after 10:30 on the first day, every so many hours and at a minute of its own."""
    from datetime import datetime

    key = F.col("c_custkey")
    jobs = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), (3600 * (1 + key % 200)).alias("period"), (key * 61 % 3600).alias("offset"))
    return streaming.next_runs(jobs, F.lit(datetime(2024, 1, 1, 10, 30))).select("name", F.date_format("due", "yyyy-MM-dd HH:mm:ss").alias("due"))


@said("SELECT count(*) AS terms, count(DISTINCT lower(n_name)) AS words FROM nation")
def sc11_terms_cached(spark, sf_dir):
    """A foreign list, read once and kept below the shared folder; the copy serves when the source is gone."""
    folder = shared_folder(spark)
    table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list("n_name")).alias("value")).write.text(f"{folder}/remote")
    for path in (f"{folder}/remote", f"{folder}/none"):
        terms = sources.cached_terms(spark, path, f"{folder}/cache")
    return terms.agg(F.count("*").alias("terms"), F.count_distinct(F.lower("term")).alias("words"))
