"""Small inline tables for what the data has none of: Arabic text, engine readings, corrections, notes, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXTS = [(1, "مرحبا"), (2, "Hello"), (3, "مرحبا Hello"), (4, "12345"), (5, "الحالة L4-L5"), (6, "Anterior"), (7, "الفقرة"), (8, ""), (9, "3.5mg"), (10, "  مُحَمَّد  ـــ أحمد  "), (11, "٠١٢٣٤ جرعة"), (12, "إدارة الألم\nline two")]
READINGS = [(1, 1, "alpha", "GENTAMICIN", 0.61), (1, 2, "beta", "GENTAMICIN", 0.82), (1, 3, "gamma", "FOGMACIN", 0.95), (2, 1, "alpha", "Ostecblastoma", 0.7), (2, 2, "beta", "Osteoblastoma", 0.9), (3, 1, "alpha", " ", 0.9), (3, 2, "beta", "MRI", 0.5), (4, 1, "alpha", "", 0.1), (5, 1, "alpha", "left", 0.4), (5, 2, "beta", "right", 0.4)]
CORRECTIONS = [(1, "Ostecb", "Osteoblastoma", "AAAA", '{"alpha":"x","beta":"y"}', 0.6), (2, "FOGMACIN", "GENTAMICIN", "BBBB", '{"alpha":"x"}', 0.4), (3, "abc", "", "CCCC", None, 0.0), (4, "abc", "a", "CCCC", None, 0.2), (5, "same", "same", "DDDD", None, 0.9), (6, "abc", "abd", None, None, 0.5), (7, "FOGMACIN", "GENTAMICIN", "BBBB", '{"gamma":"z"}', 0.5), (8, "Ostecb", "Osteoblastoma", "EEEE", '{"alpha":"q"}', 0.7), (9, "ORIF", "Open Reduction", "FFFF", None, 0.8), (10, "Ostecb", "Osteoma", "GGGG", None, 0.3)]
TERMS = [("osteoblastoma", "osteoblastoma", 1), ("gentamicin", "gentamicin", 2), ("chondrosarcoma", "chondrosarcoma", 3), ("osteomyelitis", "osteomyelitis", 4), ("warfarin", "warfarin", 5), ("fracture", "fracture", 6), ("fractured", "fracture", 7)]
WORDS = ["osteoblastoma", "ostecblastoma", "gentamycin", "fracure", "chondrosarcma", "zzz", "warfarinn", "osteomielitis"]
NOTES = [(1, "Patient: Ali Hassan\nAge: 54 years\nSex: M\nMRN: 77812\nBP: 140/90 mmHg HR: 88 bpm Temp: 37.5 C SpO2: 97% RR: 18\nDx: chronic hypertension I10\nMetformin 500 mg BID oral for 30 days\nHemoglobin: 9.1 g/dL"), (2, "120/80, aspirin 81 mg daily PO\nAllergies: penicillin, none\nGlucose: 180 mg/dL (70-110) high"), (3, "no findings")]
PRIVATE = [(1, "call 0551234567 now"), (2, "id 1234567890 date 12/03/2024"), (3, "mail a.b@example.com, MRN: 12345"), (4, "born 2024-01-05 in town"), (5, "plain text"), (6, "tel +1 555 123 4567 end"), (7, "ref 3        x")]
DRUG_LISTS = [(1, ["Warfarin", "Aspirin", "Insulin"]), (2, ["Simvastatin", "Amlodipine"]), (3, ["Insulin"]), (4, ["tramadol", "ssri", "aspirin", "warfarin"])]
PATIENTS = [(1, "metformin", ["renal failure"]), (2, "NSAID", ["peptic ulcer", "asthma"]), (3, "beta blocker", ["asthma"]), (4, "insulin", ["asthma"])]
CASES = [(1, ["headache", "fever"]), (2, ["neck_stiffness", "headache", "fever"]), (3, ["unknown"]), (4, ["dyspnea"])]
DOSES = [(1, "Amoxicillin", 20.0, 5), (2, "paracetamol", 500.0, 70), (3, "unknown", 10.0, 30), (4, "ibuprofen", 8.5, 1)]
QUESTIONS = [(1, "What is the interaction between warfarin and aspirin?"), (2, "What dose of paracetamol?"), (3, "How to manage hypertension"), (4, "Is metformin contraindicated in renal failure"), (5, "What is asthma"), (6, "hello")]
RUNS = [("m", 1, 0.30, 100), ("m", 2, 0.20, 50), ("m", 3, 0.199, 70), ("m", 4, 0.25, 10), ("n", 1, 0.5, 5)]
VERSIONS = [("m", 1, "v1", 0.20, 0.30, 0.90, False), ("m", 2, "v2", 0.10, 0.25, 0.92, True), ("m", 3, "v3", 0.15, 0.20, 0.95, False), ("n", 4, "v4", 0.30, 0.40, 0.80, True)]
EVENTS = [("m", 1, "v1", "register", 0.20), ("m", 2, "v1", "promote", None), ("m", 3, "v2", "register", 0.30), ("m", 4, "v2", "promote", None), ("m", 5, "v3", "register", 0.21), ("m", 6, "v3", "promote", None), ("m", 7, "v3", "delete", None), ("m", 8, "v1", "rollback", None), ("m", 9, "v3", "delete", None)]
PAIRS = [(1, "the cat sat", "the cat sat", True), (2, "abc def", "abd def", True), (3, "one two three", "one three", False), (4, "", "x", False), (5, "fracture", "fractur", True)]

SCHEMAS = {
    "TEXTS": "id int, text string", "READINGS": "region_id int, ordinal int, engine string, text string, confidence double",
    "CORRECTIONS": "id int, raw_text string, corrected_text string, crop_base64 string, engines string, confidence double",
    "TERMS": "variant string, term string, ordinal int", "WORDS": "word string", "NOTES": "id int, text string", "PRIVATE": "id int, text string",
    "DRUG_LISTS": "id int, drugs array<string>", "PATIENTS": "id int, drug string, conditions array<string>", "CASES": "id int, symptoms array<string>",
    "DOSES": "id int, drug string, weight_kg double, age int", "QUESTIONS": "id int, text string", "RUNS": "model string, at int, cer double, samples int",
    "VERSIONS": "model string, at int, version string, cer double, wer double, accuracy double, is_active boolean",
    "EVENTS": "model string, at int, version string, action string, cer double", "PAIRS": "id int, reference string, predicted string, medical boolean",
}


def _pick(key: str, *options: str) -> str:
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(options)) + " END"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_K, _O, _E, _C = "p_partkey", "o_orderkey", "event_id", "c_custkey"
_DRUG = ("Warfarin", "Aspirin", "Insulin", "Simvastatin", "Amlodipine", "tramadol", "ssri", "metformin", "contrast_dye", "NSAID", "beta blocker")
_CONDITION = ("renal failure", "peptic ulcer", "asthma", "gout")
_SYMPTOM = ("headache", "fever", "neck_stiffness", "unknown", "dyspnea", "الصداع", "chest_pain")
_drug, _condition, _symptom = (lambda key, own=own: _pick(key, *map(_quoted, own)) for own in (_DRUG, _CONDITION, _SYMPTOM))
#: The same tables made of given ones: the table, and its columns in expressions that Spark and DuckDB share but for arrays.
DERIVED = {
    "TEXTS": ("part", {"id": _K, "text": _pick(_K, "'مرحبا ' || p_name", "p_name", "CAST(p_size AS STRING)", "'الحالة L' || CAST(p_size AS STRING) || '-L5'", "'الفقرة'", "''", "CAST(p_size AS STRING) || '.5mg'", "'  مُحَمَّد  ـــ أحمد  ' || p_name", "'٠١٢٣٤ جرعة ' || CAST(p_size AS STRING)", "'إدارة الألم' || chr(10) || p_name", "upper(p_name)")}),
    "READINGS": ("lineitem", {"region_id": "l_orderkey", "ordinal": "l_linenumber", "engine": _pick("l_linenumber", "'alpha'", "'beta'", "'gamma'"), "text": _pick("(l_partkey + l_linenumber)", "'GENTAMICIN'", "'GENTAMICIN'", "'FOGMACIN'", "' '", "'Osteoblastoma'", "'Ostecblastoma'", "'left'"), "confidence": "CAST(l_quantity AS DOUBLE) / 50"}),
    "CORRECTIONS": ("events", {"id": _E, "raw_text": "event_type || " + _pick("user_id", "''", "' mg'", "'  x'"), "corrected_text": _pick("(event_id + user_id)", "upper(event_type)", "''", "'a'", "event_type || " + _pick("user_id", "''", "' mg'", "'  x'"), "'Osteoblastoma'", "NULL", "event_type || ' fixed'"), "crop_base64": _pick("user_id", "NULL", "'AAAA' || CAST(event_id % 50 AS STRING)", "'BBBB'", "'CCCC' || CAST(event_id AS STRING)"), "engines": _pick(_E, "NULL", "props", "'{\"alpha\":\"x\",\"beta\":\"y\"}'"), "confidence": "CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE value / 1000 END"}),
    "PRIVATE": ("customer", {"id": _C, "text": _pick(_C, "'call 055' || lpad(CAST(c_custkey AS STRING), 7, '1') || ' now'", "'id ' || lpad(CAST(c_custkey AS STRING), 10, '3') || ' date 12/03/2024'", "'mail ' || lower(c_mktsegment) || '.b@example.com, MRN: ' || lpad(CAST(c_custkey AS STRING), 5, '7')", "'born 2024-01-05 in town'", "'plain ' || c_name", "'tel +1 555 123 4567 end'", "'اسم المريض: علي' || chr(10) || 'ok'")}),
    "DRUG_LISTS": ("orders", {"id": _O, "drugs": f"array({_drug(_O)}, {_drug('(o_orderkey + o_custkey)')}, {_drug('(o_custkey + 3)')})"}),
    "PATIENTS": ("orders", {"id": _O, "drug": _drug(_O), "conditions": f"array({_condition('o_custkey')}, {_condition('(o_custkey + o_orderkey + 1)')})"}),
    "CASES": ("orders", {"id": _O, "symptoms": f"array({_symptom(_O)}, {_symptom('(o_orderkey + 1 + o_custkey % 3)')})"}),
    "DOSES": ("orders", {"id": _O, "drug": _pick(_O, "'Amoxicillin'", "'paracetamol'", "'unknown'", "'ibuprofen'"), "weight_kg": "CAST(o_custkey % 1200 AS DOUBLE) / 4 + 2", "age": "CAST(o_orderkey % 90 AS INT)"}),
    "QUESTIONS": ("part", {"id": _K, "text": _pick(_K, "'What is the interaction between warfarin and aspirin in ' || p_name", "'What dose of paracetamol?'", "'How to manage hypertension'", "'Is metformin contraindicated in renal failure'", "'What is asthma'", "'hello ' || p_name", "'interaction of ibuprofen and copd'")}),
    "RUNS": ("orders", {"model": "'m' || CAST(o_custkey AS STRING)", "at": _O, "cer": "CAST(o_orderkey * 37 % 211 AS DOUBLE) / 1000", "samples": "CAST(10 + o_orderkey % 90 AS INT)"}),
    "VERSIONS": ("orders", {"model": "'m' || CAST(o_custkey AS STRING)", "at": _O, "version": "'v' || CAST(o_orderkey AS STRING)", "cer": "CAST(o_orderkey * 37 % 211 AS DOUBLE) / 1000", "wer": "CAST(o_orderkey * 53 % 307 AS DOUBLE) / 1000", "accuracy": "CAST(o_orderkey * 71 % 97 AS DOUBLE) / 100", "is_active": "o_orderkey % 5 = 0"}),
    "EVENTS": ("orders", {"model": "'m' || CAST(o_custkey AS STRING)", "at": _O, "version": "'v' || CAST(o_orderkey % 3 AS STRING)", "action": _pick("(o_orderkey + o_custkey)", "'register'", "'register'", "'promote'", "'rollback'", "'delete'"), "cer": "CAST(o_orderkey * 37 % 211 AS DOUBLE) / 1000"}),
    "TERMS": ("part", {"variant": "p_name", "term": "p_name", "ordinal": _K}),
    "WORDS": ("part", {"word": _pick(_K, "p_name", "upper(p_name)", "p_brand", "substr(p_name, 2)")}),
    "PAIRS": ("part", {"id": _K, "reference": "p_name || ' of ' || p_brand", "predicted": _pick(_K, "p_name || ' of ' || p_brand", "substr(p_name, 2) || ' of ' || p_brand", "p_name || ' ' || p_brand", "'x ' || p_name || ' off ' || p_brand"), "medical": "p_size % 2 = 0"}),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    rows = globals()[name]
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], SCHEMAS[name])


def derived(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """A row for each row of the given table that this one is made of."""
    source, columns = DERIVED[name]
    kinds = dict(c.split(" ") for c in SCHEMAS[name].split(", "))
    wide = {"int": "bigint"}
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*(f"CAST({x} AS {wide.get(kinds[c], kinds[c])}) AS `{c}`" for c, x in columns.items()))


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    if isinstance(x, int):
        return repr(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "'" + x.replace("'", "''") + "'"


def values(name: str, rows: list | None = None, columns: str | None = None) -> str:
    """A table of these as a subquery for DuckDB: what it is made of, or the rows given."""
    if rows is None:
        source, own = DERIVED[name]
        kinds = dict(c.split(" ") for c in SCHEMAS[name].split(", "))
        # numbers keep the width that Spark gives them, decimals are doubles
        cast = lambda c, x: f"CAST({x} AS DOUBLE)" if kinds[c] == "double" else f"CAST({x} AS BIGINT)" if kinds[c] == "int" else x
        return "(SELECT " + ", ".join(f'{cast(c, x.replace("array(", "list_value("))} AS "{c}"' for c, x in own.items()) + f" FROM {source})"
    body = ", ".join("(" + ", ".join(map(_literal, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({columns}))"
