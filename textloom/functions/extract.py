"""Structured fields out of clinical free text, as one select of column expressions.

Numbers may be in the digits of any script: what is returned as a number is read from them, what is returned as text keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.patterns import native, plain_digits

# What the fields look like in English and Arabic notes.
PRESSURE = r"(?i)(?:BP|blood pressure|ضغط الدم|الضغط)[:\s]*(\d{2,3})\s*/\s*(\d{2,3})"
PRESSURE_ALONE = r"(\d{2,3})\s*/\s*(\d{2,3})"
VITALS = {
    "heart_rate": r"(?i)(?:HR|heart rate|pulse|النبض|معدل القلب|السرعة)[:\s]*(\d{2,3})",
    "temperature": r"(?i)(?:temp(?:erature)?|الحرارة|درجة الحرارة)[:\s]*([\d.]+)",
    "oxygen": r"(?i)(?:SpO2|oxygen sat|الاشباع|تشبع الأكسجين)[:\s]*([\d.]+)",
    "respiration": r"(?i)(?:RR|respiratory rate|التنفس|معدل التنفس)[:\s]*(\d{1,2})",
}
NAME = r"([A-Za-z؀-ۿ][\w؀-ۿ\-]{1,40})"
DOSE = r"(\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|IU|units?|وحدة|مل|ملغ)\b)"
FREQUENCY = r"(BID|TID|QID|QD|OD|PRN|SOS|once|twice|daily|weekly|كل\s*\d+\s*(?:ساعة|ساعات|يوم|أيام)|صباحا|مساء|bedtime|at night|\d+x?/?day|1-0-1|1-1-1|1-0-0|0-1-0)"
ROUTE = r"(PO|IV|IM|SC|SubQ|topical|inhaled|rectal|oral|فم|وريد|عضل|تحت الجلد|موضعي)"
DURATION = r"(for\s+\d+\s*(?:days?|weeks?|months?)|لمدة\s*\d+\s*(?:يوم|أيام|أسبوع|أسابيع|شهر|أشهر))"
MEDICATION = rf"(?i){NAME}\s*{DOSE}?\s*{FREQUENCY}?\s*{ROUTE}?\s*{DURATION}?"
# the same, where one of the parts follows; the lookahead has groups of its own
# within a word the name begins once: further on it would end at the same place, unless the word is longer than a name
STRICT = rf"(?i)(?:\G|(?<![A-Za-z؀-ۿ])|(?=[\w؀-ۿ\-]{{41}})){NAME[:-1]}+)(?![\w؀-ۿ\-])(?=\s*(?:{DOSE}|{FREQUENCY}|{ROUTE}|{DURATION}))\s*{DOSE}?\s*{FREQUENCY}?\s*{ROUTE}?\s*{DURATION}?"
ICD = r"\b([A-Z]\d{2}(?:\.\d{1,4})?)\b"
DIAGNOSIS = r"(?i)(?:dx|diagnosis|diagnoses|تشخيص|المرض|الحالة)[:\s–-]+(.+?)(?:\n|$)"
CHRONIC = r"(?i)(?:chronic|مزمن|long[- ]standing|دائم)"
UNIT = r"mg/dL|mmol/L|g/L|U/L|ng/mL|pg/mL|mg/L|µmol/L|%|ملغ/ديسيلتر|ملمول/لتر"
# any other unit of an amount in a volume, and names of labs that need none
UNIT = rf"(?:{UNIT}|[\w^]{{1,9}}/(?:dL|L|mL|[µu]L|mm3|hpf|ديسيلتر|لتر)(?!\w))"
KNOWN_LABS = r"hemoglobin|haemoglobin|glucose|creatinine|urea|sodium|potassium|calcium|cholesterol|triglycerides|bilirubin|albumin|platelets|hematocrit|HbA1c|INR|WBC|RBC|TSH|ESR|CRP|الهيموجلوبين|السكر|الكرياتينين|اليوريا|الصوديوم|البوتاسيوم|الكالسيوم|الكوليسترول"
NUMBER = r"\d+(?:\.\d+)?"
# a name begins where a word does
LAB = rf"(?i)(?<!\w)((?:{KNOWN_LABS})(?!\w)|[A-Za-z؀-ۿ][\w؀-ۿ \-]{{1,50}}?(?=\s*[:\s]\s*{NUMBER}\s*{UNIT}))\s*[:\s]\s*({NUMBER})(?![\d/])\s*({UNIT})?(?:\s*\(?([<>]?\s*[\d.]+(?:\s*[-~]\s*[\d.]+)?)\s*{UNIT}?\)?)?(?:\s*(high|low|↑|↓|مرتفع|منخفض|crit|حرج))?"
PATIENT = {
    "name": r"(?i)(?:patient[:\s]|المريض[:\s]|الاسم[:\s]|name[:\s]+)\s*([A-Za-z؀-ۿ][\w؀-ۿ \-']{1,80})",
    "age": r"(?i)(?:age|العمر)[:\s]*([\d٠-٩]+)",
    "gender": r"(?i)(?:gender|sex|الجنس|النوع)[:\s]*(male|female|ذكر|أنثى|M|F)",
    "id": r"(?i)(?:patient\s*id|MRN|file\s*no|رقم\s*الملف|رقم\s*المريض|ملف)[:\s#]*([\w؀-ۿ\-]{1,30})",
}
ALLERGY = r"(?i)(?:allergy|allergies|الحساسية|حساسية)[:\s]*([^\n]+)"
NO_ALLERGY = ("none", "nka", "nkda", "no", "nil", "لا يوجد", "لا")


def _first(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, native(pattern), group), F.lit(""))


def _all(x: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(x, F.lit(native(pattern)), F.lit(group))


def _matches(x: Column, pattern: str, parts: tuple[str, ...], numbers: tuple[int, ...] | None = None) -> Column:
    """Array of (parts), the groups of every match: the text is gone through once, each match is replaced by its groups between marks, and what stands between matches is left out.

    The groups must not be able to hold the marks, characters 1 to 3; where a text has them they become another that no group can hold.
    """
    clean = F.when(x.rlike("[\x01-\x03]"), F.translate(x, "\x01\x02\x03", "\x04\x04\x04")).otherwise(x)
    marked = F.regexp_replace(clean, native(pattern), "\x02" + "\x01".join(f"${g}" for g in numbers or range(1, len(parts) + 1)) + "\x03")
    found = F.split(marked, "\x02")
    groups = F.transform(F.slice(found, 2, 1 << 30), lambda m: F.split(F.substring_index(m, "\x03", 1), "\x01"))
    return F.transform(groups, lambda g: F.struct(*(g[k].alias(n) for k, n in enumerate(parts))))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is computed once however often f names it, also for each element of an array."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _some(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def vitals(x: Column) -> Column:
    """First match of each sign; a pressure without its name counts where none has one."""
    pressure = [plain_digits(F.coalesce(_first(x, PRESSURE, g), _first(x, PRESSURE_ALONE, g))).try_cast("int") for g in (1, 2)]
    return F.struct(pressure[0].alias("systolic"), pressure[1].alias("diastolic"), *(plain_digits(_first(x, p)).try_cast("double").alias(n) for n, p in VITALS.items()))


def medications(x: Column, *, strict: bool = True) -> Column:
    """Array of (name, dose, frequency, route, duration), the first of each lower-case name.

    The pattern's parts are all optional but the name; strict keeps only matches with one of them, else every word is a match.
    """
    parts = ("name", "dose", "frequency", "route", "duration")
    # in the strict pattern the lookahead's four groups stand between the name's and the others'
    pattern, numbers = (STRICT, (1, 6, 7, 8, 9)) if strict else (MEDICATION, None)
    rows = F.transform(_matches(x, pattern, parts, numbers), lambda r: F.struct(*(_some(r[n]).alias(n) for n in parts)))
    if strict:
        rows = F.filter(rows, lambda r: F.coalesce(*(r[n] for n in parts[1:])).isNotNull())
    first = lambda found, names: F.filter(found, lambda r, i: F.array_position(names, F.lower(r["name"])) == i + 1)
    return _let(rows, lambda found: _let(F.transform(found, lambda r: F.lower(r["name"])), lambda names: first(found, names)))


def diagnoses(x: Column) -> Column:
    """Array of (text, icd, chronic): keyword lines first, then codes that none of them holds, with the text around them."""
    named = F.transform(_all(x, DIAGNOSIS, 1), lambda d: F.struct(F.trim(d).alias("text"), _first(d, ICD).alias("icd"), d.rlike(CHRONIC).alias("chronic")))
    # a code has an ASCII letter before a digit, so only such places are looked at
    every = F.array_distinct(_all(x, rf"(?=[A-Z]\d){ICD}", 1))
    coded = lambda codes: F.transform(codes, lambda c: _let(_window(x, c), lambda w: F.struct(F.trim(w).alias("text"), c.alias("icd"), w.rlike(CHRONIC).alias("chronic"))))
    return _let(named, lambda n: F.concat(n, coded(F.array_except(every, F.transform(n, lambda d: d["icd"])))))


def _window(x: Column, code: Column, before: int = 60, behind: int = 100) -> Column:
    at = F.call_function("instr", x, code)
    begin = F.greatest(at - before, F.lit(1))
    return F.substr(x, begin, at - begin + behind)


def in_range(value: Column, text: Column) -> Column:
    """Whether a value lies in a reference range lo-hi, <x or >x; null where the range can't be read."""
    clean = F.regexp_replace(plain_digits(text), native(r"\s"), "")
    low, high = (F.regexp_extract(clean, r"^([\d.]+)[-~]([\d.]+)", g).try_cast("double") for g in (1, 2))
    below, above = F.regexp_extract(clean, r"^<([\d.]+)", 1).try_cast("double"), F.regexp_extract(clean, r"^>([\d.]+)", 1).try_cast("double")
    return F.when(low.isNotNull() & high.isNotNull(), value.between(low, high)).when(below.isNotNull(), value < below).when(above.isNotNull(), value > above)


def labs(x: Column) -> Column:
    """Array of (name, value, unit, range, abnormal): abnormal by a written flag, else by the range, else false."""
    parts = ("name", "value", "unit", "range", "flag")
    return F.transform(_matches(x, LAB, parts), lambda r: F.struct(F.trim(r["name"]).alias("name"), plain_digits(r["value"]).try_cast("double").alias("value"), _some(r["unit"]).alias("unit"), _some(r["range"]).alias("range"), (_some(r["flag"]).isNotNull() | ~F.coalesce(in_range(plain_digits(r["value"]).try_cast("double"), r["range"]), F.lit(True))).alias("abnormal")))


# A telephone number behind its name, and the named patterns of lines.
PHONE = r"(?i)(?:phone|tel|هاتف|جوال|موبايل)[:\s]*([\d+\-\s]{7,20})"
CATALOGUE = {
    "page_number": r"^(\d+)$",
    "section_number": r"^(\d+)[-\.]",
    "medical_term_arabic": r"^(ال)?[أ-ي]+(ية|يّة)?$",
    "dosage": r"(\d+\.?\d*)\s*(مجم|mg|مل|ml|قرص|مرة)",
}


def named(x: Column) -> Column:
    """The names of the catalogue's patterns that a line matches, in their order."""
    return F.array_compact(F.array(*(F.when(x.rlike(native(pattern)), F.lit(name)) for name, pattern in CATALOGUE.items())))


def patient_fields(x: Column) -> dict[str, Column]:
    """The fields of a patient one by one, for a query that takes some of them."""
    genders = F.create_map(*(F.lit(y) for names, gender in ((("male", "m", "ذكر"), "male"), (("female", "f", "أنثى"), "female")) for name in names for y in (name, gender)))
    allergies = F.flatten(F.transform(_all(x, ALLERGY, 1), lambda a: F.split(a, r"[,،;]")))
    allergies = F.filter(F.transform(allergies, lambda s: F.trim(s)), lambda a: (a != "") & ~F.lower(a).isin(*NO_ALLERGY))
    return {
        "name": F.trim(_first(x, PATIENT["name"])), "age": plain_digits(_first(x, PATIENT["age"])), "gender": F.try_element_at(genders, F.lower(_first(x, PATIENT["gender"]))), "id": _first(x, PATIENT["id"]),
        "phone": F.regexp_replace(_first(x, PHONE), native(r"^\s+|\s+$"), ""), "allergies": allergies,
    }


def patient(x: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in patient_fields(x).items()))


def confidence(record: Column) -> Column:
    """Share of the vitals and patient fields that are there; for lists 0.8 an entry (diagnoses 0.7), 1 at most."""
    share = lambda group, names: sum((record[group][n].isNotNull().cast("int") for n in names), F.lit(0)) / len(names)
    listed = lambda group, each: F.least(F.lit(1.0), F.size(record[group]) * F.lit(each))
    return F.struct(share("vitals", ("systolic", "diastolic", *VITALS)).alias("vitals"), listed("medications", 0.8).alias("medications"), listed("diagnoses", 0.7).alias("diagnoses"), listed("labs", 0.8).alias("labs"), share("patient", ("name", "age", "gender", "id")).alias("patient"))


def warnings(x: Column, record: Column) -> Column:
    """What the text names but no entry was read for."""
    told = (("medications", r"(?i)medication|drug|دواء|أدوية"), ("diagnoses", r"(?i)diagnos|تشخيص"), ("labs", r"(?i)\blab|مختبر|تحليل"))
    return F.array_compact(F.array(*(F.when(x.rlike(native(p)) & (F.size(record[g]) == 0), F.lit(f"no {g} read")) for g, p in told)))


def extract_all(x: Column, *, strict: bool = True) -> Column:
    return F.struct(vitals(x).alias("vitals"), medications(x, strict=strict).alias("medications"), diagnoses(x).alias("diagnoses"), labs(x).alias("labs"), patient(x).alias("patient"))
