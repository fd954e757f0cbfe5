"""Redaction of personal health information: six patterns in a fixed order, then whole lines with a telling keyword."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.patterns import native

MASK = "[REDACTED]"
# The patterns in their order of application, and the keywords of sensitive lines.
PATTERNS = (
    ("phone", r"(?:(?:\+?966|\+?971|\+?965|\+?974|\+?968|\+?20|\+?1)?[\s\-]?(?:05|5)?\d[\d\-\(\)\s]{7,14})"),
    ("national_id", r"\b\d{10}\b"),
    ("date", r"\b(?:\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}|\d{4}[\/\-]\d{1,2}[\/\-]\d{1,2})\b"),
    ("patient_id", r"(?i)(?:رقم المريض|رقم الملف|MRN|File\s*[Nn]o|Patient\s*[Ii]D)[:\s\-]*(\d{3,})"),
    ("email", r"[\w.\-]+@[\w.\-]+\.\w{2,}"),
    ("medical_number", r"(?i)(?:عيادة|مريض|حجز|موعد|رقم|كشف|تذكرة)[\s:]*(\d{3,8})"),
)
KEYWORDS = ("اسم المريض", "رقم المريض", "رقم الملف", "الاسم", "تاريخ الميلاد", "العمر", "الهاتف", "الجوال", "العنوان", "رقم الهوية")
#: What a phone number may begin with is looked at first, or its optional parts would be tried at every character; and it is over 3 characters.
GUARD = r"(?=[+\d]|[\s\-]\d)(?!\s*\d\s{7,14}(?![\d\-\(\)]))"
#: What a match must begin with, looked at before its pattern is tried; a word's part before the @ is tried from its first character only.
BEGINS = {"phone": r"(?=[+\d]|[\s\-]\d)", "national_id": r"(?=\d)", "date": r"(?=\d)", "patient_id": "(?=[رMmFfPp])", "email": r"(?:\G|(?<![\w.\-]))", "medical_number": "(?=[عمحركت])"}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def counts(x: Column | str, *, plain: bool = False) -> list[Column]:
    """Matches of each pattern on the text as it is; they overlap. With plain, digits, letters and blanks are ASCII's, as in SQL, not those of every script."""
    return [F.regexp_count(col(x), F.lit(native(BEGINS[name] + pattern, plain=plain))).alias(f"n_{name}") for name, pattern in PATTERNS]


def redact(x: Column | str, *, lines: bool = True) -> Column:
    """The text with all patterns masked; with lines, every line that names a sensitive field and holds no mask yet is masked whole.

    Matches whose trimmed text has at most 3 characters stay. Only a phone number can be so short: one digit before blanks.
    """
    out = col(x)
    for name, pattern in PATTERNS:
        out = F.regexp_replace(out, native(f"{GUARD if name == 'phone' else BEGINS[name]}{pattern}"), MASK)
    out = F.when(col(x).rlike(native(r"[\d@]")), out).otherwise(col(x))  # no pattern matches without a digit of any script or an @
    if not lines:
        return out
    told = "|".join(KEYWORDS)
    return F.array_join(F.transform(F.split(out, "\n"), lambda line: F.when(line.rlike(told) & ~F.contains(line, F.lit(MASK)) & (F.length(F.trim(line)) > 5), F.lit(MASK)).otherwise(line)), "\n")


def _items(text: str | None) -> list[dict] | None:
    if text is None:
        return None
    out = []
    for name, pattern in PATTERNS:
        done = []
        for m in re.finditer(pattern, text):
            if len(m[0].strip()) > 3:
                out.append({"type": name, "start": m.start(), "end": m.end()})
                done.append(m.span())
        for a, b in reversed(done):
            text = text[:a] + MASK + text[b:]
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def items(x: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Type and span of every masked match, on the text as it stood when its pattern was applied. Values are never returned or logged."""
    for batch in x:
        yield batch.map(_items)
