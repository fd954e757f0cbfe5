"""Numbers in the digits of other scripts: redaction, counts and fields give what Python's engine gives."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import extract, patterns, redact
from textloom.operators import correct

MAPS = [str.maketrans("0123456789", d) for d in ("0123456789", "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "०१२३४५६७८९")]
TEXTS = ["call 0551234567 now", "اتصل 0551234567 الآن", "MRN: 12345", "MRN 12", "ولد 12/03/2024 في", "born 2024-1-5 x", "id 1234567890 date 12/03/2024", "رقم الملف: 5512", "كشف 123", "mail josé.é1@exämple.com2 x", "tel +966 55 123 4567\nend", "7        x", "a1234567890b", "12/3/24/5", "x 5 6 7 8 9 0 1 2 3 y", "no digits here", "", "+20-100-200-300", "٣ 12345678 ٣"]


def masked(text):
    for name, pattern in redact.PATTERNS:
        for m in reversed(list(re.finditer(pattern, text))):
            if len(m[0].strip()) > 3:
                text = text[: m.start()] + redact.MASK + text[m.end() :]
    return text


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(3)
    made = ["".join(random.choice("0123456789 -/+().@aبé\n ") for _ in range(random.randrange(40))) for _ in range(300)]
    texts = [t.translate(m) for t in [*TEXTS, *made] for m in MAPS]
    return texts, spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_redaction_counts_and_items_agree_with_python(rows):
    texts, df = rows
    got = df.select("id", redact.redact("text", lines=False).alias("r"), F.array(*redact.counts("text")).alias("n"), redact.items("text").alias("items")).collect()
    for r in got:
        text = texts[r["id"]]
        assert r["r"] == masked(text), text
        assert list(r["n"]) == [len(re.findall(p, text)) for _, p in redact.PATTERNS], text
        assert bool(r["items"]) == (r["r"] != text), text


def test_every_pattern_has_one_meaning(rows):
    texts, df = rows
    told = [extract.PRESSURE, extract.PRESSURE_ALONE, *extract.VITALS.values(), extract.ICD, extract.LAB, extract.PHONE, *extract.PATIENT.values(), *extract.CATALOGUE.values()]
    extra = ["BP: 140/90 mmHg HR: 88 Temp: 37.5", "النبض 77 الحرارة 38.2", "I10.5 xI10 I10", "Hemoglobin: 9.1 g/dL (12-16) low", "WBC 11", "tel: 055 123 4567", "العمر: 54 age 7", "5 مجم", "12. x", "12"]
    df = df.sparkSession.createDataFrame([(t.translate(m),) for t in [*TEXTS, *extra] for m in MAPS], "text string")
    for pattern in told:
        got = df.select("text", F.regexp_extract("text", patterns.native(pattern), 0).alias("m")).collect()
        assert [(r["text"], r["m"]) for r in got] == [(r["text"], m[0] if (m := re.search(pattern, r["text"])) else "") for r in got], pattern


def test_fields_are_read_from_any_digits(spark):
    note = "BP: 140/90 mmHg HR: 88 Temp: 37.5 oxygen sat: 97% RR: 18\nAge: 54\nMetformin 500 mg BID\nHemoglobin: 9.1 g/dL (12-16)\nGlucose: 180\nFerritin: 15 ng/mL\nLead: 3 µg/dL\nPlatelets 250 10^9/L"
    df = spark.createDataFrame([(note.translate(m),) for m in MAPS], "text string")
    for r, m in zip(df.select(extract.extract_all(F.col("text")).alias("r")).collect(), MAPS, strict=True):
        r = r["r"]
        assert tuple(r["vitals"]) == (140, 90, 88.0, 37.5, 97.0, 18.0)
        assert r["patient"]["age"] == "54"
        assert (r["medications"][0]["name"], r["medications"][0]["dose"]) == ("Metformin", "500 mg".translate(m))
        assert [(x["name"], x["value"], x["unit"], x["abnormal"]) for x in r["labs"] if not x["name"].endswith("oxygen sat")][:4] == [("Hemoglobin", 9.1, "g/dL", True), ("Glucose", 180.0, None, False), ("Ferritin", 15.0, "ng/mL", False), ("Lead", 3.0, "µg/dL", False)]


def test_doses_in_any_digits(spark):
    rows = [("5مجم", True), ("٥مجم", True), ("٣.٥", True), ("۷ ml", True), ("x", False), ("٥ mgx", False)]
    df = spark.createDataFrame([r[:1] for r in rows], "w string")
    assert [r[0] for r in df.select(correct.is_dose(F.col("w"))).collect()] == [r[1] for r in rows]
    assert df.select(correct.context_rules(F.lit("خذ ٥٠٠مجم ثم ٣مرات و10mg"))).first()[0] == "خذ ٥٠٠ مجم ثم ٣ مرات و10 mg"
    assert df.select(correct.spell_units(F.lit("٥مجم"))).first()[0] == "٥ mg"
    assert df.select(extract.named(F.lit("٥مجم")), extract.named(F.lit("١٢"))).first()[:] == (["dosage"], ["page_number"])


def test_medications_with_a_part_are_those_of_all_words(spark):
    """The strict pattern finds what is left of the plain one when words without a part go."""
    random.seed(8)
    parts = ["Metformin", "500 mg", "BID", "daily", "oral", "PO", "for 3 days", "5mg", "abdaily", "take", "x", "IV", "كل 8 ساعات", "وحدة", "12", "once-a", "insulin"]
    texts = [" ".join(random.choice(parts) for _ in range(random.randrange(1, 9))).replace(" x ", "\n") for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    both = df.select(extract.medications(F.col("text")).alias("a"), F.filter(extract.medications(F.col("text"), strict=False), lambda r: F.coalesce(r["dose"], r["frequency"], r["route"], r["duration"]).isNotNull()).alias("b"), "text").collect()
    for r in both:
        # of equal names the first with a part counts for the one, the first of all for the other
        assert {tuple(x) for x in r["b"]} <= {tuple(x) for x in r["a"]}, r["text"]
        assert [x["name"].lower() for x in r["a"]] == list(dict.fromkeys(x["name"].lower() for x in r["a"]))


def test_a_texts_matches_are_found_once(spark):
    """The pattern of medications stands once in the plan: it was evaluated again for the names, and once for each group of a match."""
    rows = spark.createDataFrame([("aspirin 50 mg BID oral for 3 days, Aspirin 5 mg PO",)], "text string").select(extract.medications(F.col("text")).alias("m"), extract.labs(F.col("text")).alias("l"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("1-0-1|1-1-1") <= 2 and plan.count("hemoglobin|haemoglobin") <= 1  # the strict pattern names frequencies twice
    names = [tuple(m) for m in rows.first()["m"]]
    assert names == [("aspirin", "50 mg", "BID", "oral", "for 3 days")]


def test_a_name_begins_within_words_that_are_longer_than_a_name(spark):
    texts = ["z" * 45 + " 5 mg", "z" * 41 + " 5 mg", "5mgx 7 mg", "aspirin\x02 5 mg", "aspirin 5 mg\x01\x03warfarin 6 mg"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", F.transform(extract.medications(F.col("text")), lambda m: m["name"]).alias("n"))
    assert dict(got.collect()) == {0: ["z" * 41], 1: ["z" * 41], 2: ["mgx"], 3: [], 4: ["aspirin", "warfarin"]}


def test_counts_begin_where_a_match_can(spark):
    """A word without @ is gone through once, not once from each of its characters; results are those of the bare patterns."""
    import time

    texts = ["a" * 400_000, "a.b@c.com-x@y.org, MRN: 12345", "tel +966 51234567 or -5 1234567", "1234567890 ٠١٢٣٤٥٦٧٨٩ 12/03/2024 x1/2/2024", "رقم 123 موعد: 4567", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    began = time.time()
    got = {r[0]: list(r)[1:] for r in rows.select("k", *redact.counts("text")).collect()}
    assert time.time() - began < 30
    for k, text in enumerate(texts[1:-1], 1):
        assert got[k] == [len(re.findall(p, text)) for _, p in redact.PATTERNS]
    assert got[0] == [0] * 6 and got[5] == [None] * 6
