"""Text normalisation as column expressions: every function maps a Column to a Column and stays in generated code.

Arabic letters are named by code point where marks would be hard to read. Nulls stay null throughout.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The character classes and folds of Arabic text that other systems' data is normalised with.
TASHKEEL = "[ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۨ-ۭ]"
ARABIC = "[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]"
ARABIC_BASIC = "[؀-ۿ]"
LIGATURES = {"ﻻ": "لا", "ﻷ": "لأ", "ﻹ": "لإ", "ﻵ": "لآ", "ﷲ": "الله"}
LETTERS = ("إأآٱةىؤئ", "ااااهيوي")
FORMS = (
    "ﭐﭑﺀﺁﺃﺅﺇﺍﺏﺓﺗﺛﺟﺣﺥﺧﺩﺫﺭﺯﺱﺵﺹﺽﻁﻅﻉﻍﻑﻕﻙﻝﻡﻥ",
    "ااااااوبتثجحخدذرزسشصضطظعغفقكلمنهوي",
)
TATWEEL = "ـ"
DIGITS = ("٠١٢٣٤٥٦٧٨٩", "0123456789")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_tashkeel(x: Column | str) -> Column:
    return F.regexp_replace(col(x), TASHKEEL, "")


def expand_ligatures(x: Column | str) -> Column:
    out = col(x)
    for form, letters in LIGATURES.items():
        out = F.replace(out, F.lit(form), F.lit(letters))
    return out


def map_forms(x: Column | str) -> Column:
    """The table of presentation forms as other systems have it; it disagrees with Unicode, see nfkc."""
    return F.translate(col(x), *FORMS)


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no function for it."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def unify_letters(x: Column | str) -> Column:
    return F.translate(col(x), *LETTERS)


def collapse_space(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def normalize_arabic(x: Column | str, forms: str = "none") -> Column:
    """Marks off, ligatures apart, presentation forms by ``forms`` ('none', 'table' or 'nfkc'), letters unified, space collapsed."""
    out = expand_ligatures(strip_tashkeel(x))
    out = map_forms(out) if forms == "table" else nfkc(out) if forms == "nfkc" else out
    return collapse_space(unify_letters(out))


def learner_key(x: Column | str) -> Column:
    """The key of the learned dictionary: marks and tatweel off, letters unified, ends trimmed."""
    return F.trim(unify_letters(F.replace(strip_tashkeel(x), F.lit(TATWEEL), F.lit(""))))


def medical_key(x: Column | str) -> Column:
    """The key of the term dictionary; the marks' class is strip_tashkeel's, as a wider one would erase the letters themselves."""
    return unify_letters(strip_tashkeel(F.trim(col(x))))


def clinical_key(x: Column | str) -> Column:
    return F.translate(strip_tashkeel(F.trim(col(x))), "أإآة", "اااه")


def pattern_key(x: Column | str) -> Column:
    return F.trim(col(x))


def has_arabic(x: Column | str) -> Column:
    return col(x).rlike(ARABIC)


def has_basic_arabic(x: Column | str) -> Column:
    return col(x).rlike(ARABIC_BASIC)


def mostly_arabic(x: Column | str, share: float = 0.3) -> Column:
    n = F.length(col(x))
    return F.when(n > 0, F.regexp_count(col(x), F.lit(ARABIC_BASIC)) / n > share).otherwise(False)


def has_latin(x: Column | str) -> Column:
    return col(x).rlike("[A-Za-z]")


def script_class(x: Column | str) -> Column:
    arabic, latin = has_basic_arabic(x), has_latin(x)
    return F.when(arabic & latin, "mixed").when(arabic, "arabic").when(latin, "latin").otherwise("numeric")


def ascii_digits(x: Column | str) -> Column:
    return F.translate(col(x), *DIGITS)


def reverse_arabic_runs(x: Column | str) -> Column:
    """Each run of Arabic letters backwards, everything else as it stands."""
    pieces = F.regexp_extract_all(col(x), F.lit(f"{ARABIC}+|[^{ARABIC[1:-1]}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(ARABIC), F.reverse(p)).otherwise(p)), "")


def rtl_lines(x: Column | str) -> Column:
    """Right-to-left embedding marks around each line that has Arabic letters."""
    return F.array_join(F.transform(F.split(col(x), "\n"), lambda line: F.when(line.rlike(ARABIC_BASIC), F.concat(F.lit("‫"), line, F.lit("‬"))).otherwise(line)), "\n")


def words(x: Column | str) -> Column:
    """The words of a text as an array; none for blank texts."""
    return F.filter(F.split(col(x), r"\s+"), lambda w: w != "")


def word_count(x: Column | str) -> Column:
    return F.size(words(x))


def line_count(x: Column | str) -> Column:
    return F.when(col(x) == "", 0).otherwise(F.size(F.split(col(x), "\n")))


def length_bin(n: Column) -> Column:
    return F.when(n <= 5, "1-5").when(n <= 15, "6-15").when(n <= 30, "16-30").when(n <= 50, "31-50").otherwise("50+")


def arabic_soundex(x: Column | str) -> Column:
    """A code that words of one root share: weak letters and marks dropped, the rest grouped by place of articulation, repeats merged.

    Emphatic and plain letters keep apart groups (heart and dog differ).
    """
    bare = F.regexp_replace(unify_letters(strip_tashkeel(x)), "[اويءه]", "")
    return F.regexp_replace(F.translate(bare, "بفمتدطذثظزسصضشجرلنكقغخعح", "123444555666677890abcdde"), r"(.)\1+", "$1")
