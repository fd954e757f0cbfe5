"""Queries over clinical notes that are composed of the orders: every other note is Arabic and has its numbers in Arabic-Indic digits.

The SQL beside them computes the fields from the orders' columns, not from the notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import extract, normalize, redact
from textloom.operators import clinical, correct
from textloom.plans.fixtures import derived, values
from textloom.plans.queries import table
from textloom.plans.source_queries import said

ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
WAYS = ("BID", "TID", "daily", "PRN")
_INDIC = "translate({}, '0123456789', '" + ARABIC_DIGITS + "')"
_DRUGS = "[" + ", ".join(f"'{d}'" for d in clinical.DRUGS) + "]"
_WAYS = "[" + ", ".join(f"'{w}'" for w in WAYS) + "]"
# what the notes are composed of, by column of the orders; also the SQL's view of them
FIELDS = {
    "age": "20 + c % 70", "mrn": "100000 + c", "systolic": "90 + c % 90", "diastolic": "50 + k % 50", "heart_rate": "50 + k % 120", "respiration": "10 + k % 20",
    "oxygen": "85 + k % 15", "dose": "50 * (1 + k % 9)", "days": "1 + k % 30", "glucose": "60 + k % 200", "code": "10 + c % 80", "drug": "k % 14", "way": "k % 4",
}
_NOTES = "n AS (SELECT o_orderkey AS id, o_orderkey % 2 = 1 AS arabic, " + ", ".join(f"({x.replace('c ', 'o_custkey ').replace('k ', 'o_orderkey ').replace('+ c', '+ o_custkey')}) AS {name}" for name, x in FIELDS.items()) + " FROM orders)"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): a note for every order. Of every third the vital signs are missing, of every fifth the medication, of every seventh the patient."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    # a file of orders has few row groups, but what is read from the notes takes all cores: so the two keys are dealt to tasks of some 50,000
    o = o.repartition(max(spark.sparkContext.defaultParallelism, -(-o.count() // 50_000)), "k")
    o = o.select("k", "c", *(F.expr(x).alias(name) for name, x in FIELDS.items()))
    text = lambda *xs: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in xs))
    s = {name: F.col(name).cast("string") for name in FIELDS}
    drug, way = F.array(*map(F.lit, clinical.DRUGS))[F.col("drug").cast("int")], F.array(*map(F.lit, WAYS))[F.col("way").cast("int")]
    temperature, blood = text((36 + F.col("k") % 5).cast("string"), ".", (F.col("k") % 10).cast("string")), text((7 + F.col("k") % 10).cast("string"), ".", (F.col("c") % 10).cast("string"))
    sex = lambda male, female: F.when(F.col("c") % 2 == 0, male).otherwise(female)
    skip = lambda n, line: F.when(F.col("k") % n > 0, line).otherwise("")
    english = F.concat(
        skip(7, text("Patient: Customer\nAge: ", s["age"], " years\nSex: ", sex("M", "F"), "\nMRN: ", s["mrn"], "\n")),
        skip(3, text("BP: ", s["systolic"], "/", s["diastolic"], " mmHg HR: ", s["heart_rate"], " Temp: ", temperature, " oxygen sat: ", s["oxygen"], " RR: ", s["respiration"], "\n")),
        text("Dx: chronic condition E", s["code"], "\n"), F.when(F.col("k") % 5 > 0, text(drug, " ", s["dose"], " mg ", way, " oral for ", s["days"], " days\n")).otherwise("medication: see chart\n"),
        text("Hemoglobin: ", blood, " g/dL (12-16)\nGlucose: ", s["glucose"], " mg/dL (70-110)"),
    )
    arabic = F.concat(
        skip(7, text("المريض: عميل\nالعمر: ", s["age"], " سنة\nالجنس: ", sex("ذكر", "أنثى"), "\nرقم الملف: ", s["mrn"], "\n")),
        skip(3, text("ضغط الدم: ", s["systolic"], "/", s["diastolic"], " النبض: ", s["heart_rate"], " الحرارة: ", temperature, " تشبع الأكسجين: ", s["oxygen"], " التنفس: ", s["respiration"], "\n")),
        text("تشخيص: مزمن E", s["code"], "\n"), F.when(F.col("k") % 5 > 0, text(drug, " ", s["dose"], " mg ", way, " oral لمدة ", s["days"], " يوم\n")).otherwise("دواء: لا يوجد في السجل\n"),
        text("Hemoglobin: ", blood, " g/dL (12-16)\nGlucose: ", s["glucose"], " mg/dL (70-110)"),
    )
    return o.select(F.col("k").alias("id"), F.when(F.col("k") % 2 == 1, F.translate(arabic, "0123456789", ARABIC_DIGITS)).otherwise(english).alias("text"))


@said(f"WITH {_NOTES} SELECT id, " + ", ".join(f"CASE WHEN id % 3 > 0 THEN {x} END AS {name}" for name, x in (("systolic", "systolic::INT"), ("diastolic", "diastolic::INT"), ("heart_rate", "heart_rate::DOUBLE"), ("temperature", "(36 + id % 5 || '.' || id % 10)::DOUBLE"), ("oxygen", "oxygen::DOUBLE"), ("respiration", "respiration::DOUBLE"))) + " FROM n")
def e1_vitals(spark, sf_dir):
    return notes(spark, sf_dir).select("id", extract.vitals(F.col("text")).alias("v")).select("id", "v.*")


@said(f"WITH {_NOTES} SELECT id, ({_DRUGS})[drug + 1] AS name, CASE WHEN arabic THEN {_INDIC.format('dose::VARCHAR')} ELSE dose::VARCHAR END || ' mg' AS dose, ({_WAYS})[way + 1] AS frequency, 'oral' AS route, CASE WHEN arabic THEN 'لمدة ' || {_INDIC.format('days::VARCHAR')} || ' يوم' ELSE 'for ' || days || ' days' END AS duration FROM n WHERE id % 5 > 0")
def e2_medications(spark, sf_dir):
    """The medications with a dose; words of the note that only look like a name and a route are left out."""
    return notes(spark, sf_dir).select("id", F.explode(extract.medications(F.col("text"))).alias("m")).select("id", "m.*").filter("dose is not null and name not in ('Hemoglobin', 'Glucose')")


@said(f"WITH {_NOTES} SELECT id, CASE WHEN arabic THEN 'مزمن E' || {_INDIC.format('code::VARCHAR')} ELSE 'chronic condition E' || code END AS text, 'E' || CASE WHEN arabic THEN {_INDIC.format('code::VARCHAR')} ELSE code::VARCHAR END AS icd, true AS chronic FROM n")
def e3_diagnoses(spark, sf_dir):
    return notes(spark, sf_dir).select("id", F.explode(extract.diagnoses(F.col("text"))).alias("m")).select("id", "m.*")


@said(f"""WITH {_NOTES}, b AS (SELECT id, arabic, (7 + id % 10 || '.' || o_custkey % 10)::DOUBLE AS blood, glucose::DOUBLE AS glucose FROM n JOIN orders ON o_orderkey = id)
SELECT id, 'Hemoglobin' AS name, blood AS value, 'g/dL' AS unit, CASE WHEN arabic THEN {_INDIC.format("'12-16'")} ELSE '12-16' END AS range, NOT blood BETWEEN 12 AND 16 AS abnormal FROM b
UNION ALL SELECT id, 'Glucose', glucose, 'mg/dL', CASE WHEN arabic THEN {_INDIC.format("'70-110'")} ELSE '70-110' END, NOT glucose BETWEEN 70 AND 110 FROM b""")
def e4_labs(spark, sf_dir):
    return notes(spark, sf_dir).select("id", F.explode(extract.labs(F.col("text"))).alias("m")).select("id", "m.*")


@said(f"WITH {_NOTES} SELECT id, CASE WHEN id % 7 > 0 THEN CASE WHEN arabic THEN 'عميل' ELSE 'Customer' END END AS name, CASE WHEN id % 7 > 0 THEN age::VARCHAR END AS age, CASE WHEN id % 7 > 0 THEN CASE WHEN (mrn - 100000) % 2 = 0 THEN 'male' ELSE 'female' END END AS gender, CASE WHEN id % 7 > 0 THEN CASE WHEN arabic THEN {_INDIC.format('mrn::VARCHAR')} ELSE mrn::VARCHAR END END AS patient_id FROM n")
def e6_patients(spark, sf_dir):
    p = extract.patient_fields(F.col("text"))
    return notes(spark, sf_dir).select("id", p["name"].alias("name"), p["age"].alias("age"), p["gender"].alias("gender"), p["id"].alias("patient_id"))


@said(f"WITH {_NOTES} SELECT id, CASE WHEN id % 3 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS vitals, CASE WHEN id % 7 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS patient, 1.0::DOUBLE AS labs, 0.7::DOUBLE AS diagnoses, CASE WHEN id % 5 = 0 THEN 'no medications read' ELSE '' END AS warnings FROM n")
def e7_records(spark, sf_dir):
    """Confidence and warnings of whole records."""
    rows = notes(spark, sf_dir).select("id", "text", extract.extract_all(F.col("text")).alias("record"))
    c = extract.confidence(F.col("record"))
    return rows.select("id", *(c[n].cast("double").alias(n) for n in ("vitals", "patient", "labs", "diagnoses")), F.array_join(extract.warnings(F.col("text"), F.col("record")), ",").alias("warnings"))


@said("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size || ' mg ' || p_name ELSE 'خذ ' || " + _INDIC.format("p_size::VARCHAR") + " || ' مجم ' || " + _INDIC.format("p_size::VARCHAR") + " || ' مرات' END AS text FROM part")
def m1_context_rules(spark, sf_dir):
    size = F.col("p_size").cast("string")
    indic = F.translate(size, "0123456789", ARABIC_DIGITS)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(size, F.lit("mg "), "p_name")).otherwise(F.concat(F.lit("خذ "), indic, F.lit("مجم "), indic, F.lit("مرات"))).alias("text"))
    return rows.select("id", correct.context_rules(F.col("text")).alias("text"))


@said("SELECT word, regexp_matches(word, '^\\p{Nd}+ ?(mg|مجم)$') AS dose, regexp_replace(word, ' ?مجم$', ' mg') AS spelled FROM (SELECT DISTINCT unnest([p_size || 'mg', " + _INDIC.format("p_size || ' مجم'") + ", p_size || ' ' || p_name]) AS word FROM part)")
def m5_doses(spark, sf_dir):
    size = F.col("p_size").cast("string")
    words = table(spark, sf_dir, "part").select(F.explode(F.array(F.concat(size, F.lit("mg")), F.translate(F.concat(size, F.lit(" مجم")), "0123456789", ARABIC_DIGITS), F.concat(size, F.lit(" "), "p_name"))).alias("word")).distinct()
    return words.select("word", correct.is_dose(F.col("word")).alias("dose"), correct.spell_units(F.col("word")).alias("spelled"))


def indic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with their numbers in Arabic-Indic digits."""
    return table(spark, sf_dir, "documents").withColumn("text", F.translate("text", "0123456789", ARABIC_DIGITS))


# the prefixes of telephone numbers are in ASCII digits, so none stands in these texts
_INDIC_PATTERNS = [(name, r"[\s\-]?\d[\d\-\(\)\s]{7,14}" if name == "phone" else pattern) for name, pattern in redact.PATTERNS]
_COUNTS = ", ".join(f"len(regexp_extract_all(text, '{pattern}')) AS n_{name}" for name, pattern in _INDIC_PATTERNS)


@said(f"SELECT doc_id, {_COUNTS} FROM documents")
def a21_indic_digits(spark, sf_dir):
    """All six counts over digits of another script; the SQL counts in the documents as they are."""
    return indic_documents(spark, sf_dir).select("doc_id", *(c.cast("long").alias(f"n_{name}") for c, (name, _) in zip(redact.counts("text"), redact.PATTERNS, strict=True)))


def _masked() -> str:
    out = "text"
    for _, pattern in _INDIC_PATTERNS:
        out = f"regexp_replace({out}, '{pattern}', '{redact.MASK}', 'g')"
    return out


@said(f"SELECT doc_id, md5({_INDIC.format(_masked())}) AS digest FROM documents")
def r2_redacted_indic_digits(spark, sf_dir):
    return indic_documents(spark, sf_dir).select("doc_id", F.md5(redact.redact("text", lines=False)).alias("digest"))


_MARKS = "[\\x{0610}-\\x{061A}\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06DC}\\x{06DF}-\\x{06E8}\\x{06EA}-\\x{06ED}]"
_WIDE = "[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]"
_TEXTS = values("TEXTS")


@said(f"SELECT id, translate(regexp_replace(trim(text), '{_MARKS}', '', 'g'), 'إأآٱةىؤئ', 'ااااهيوي') AS medical FROM {_TEXTS}")
def n8_medical_keys(spark, sf_dir):
    """The keys under which a term dictionary is looked up."""
    return derived(spark, "TEXTS", sf_dir).select("id", normalize.medical_key("text").alias("medical"))


@said(f"SELECT id, regexp_matches(text, '{_WIDE}') AS wide, regexp_matches(text, '[\\x{{0600}}-\\x{{06FF}}]') AS basic, CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[\\x{{0600}}-\\x{{06FF}}]')) / length(text) > 0.3 ELSE false END AS mostly FROM {_TEXTS}")
def n11_is_arabic(spark, sf_dir):
    """The three ways to tell whether a text is Arabic: any letter of the wide blocks, of the basic one, or over three tenths of all."""
    return derived(spark, "TEXTS", sf_dir).select("id", normalize.has_arabic("text").alias("wide"), normalize.has_basic_arabic("text").alias("basic"), normalize.mostly_arabic("text").alias("mostly"))

