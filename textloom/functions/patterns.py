"""Patterns with one meaning in Python's engine and in the JVM's: digits, letters and blanks of every script.

Python's ``\\d``, ``\\w``, ``\\s`` and ``\\b`` are Unicode's, Java's are ASCII's or depend on its release. Patterns are written for
Python; ``native`` spells those classes out, so that a number in Arabic-Indic digits is one for either.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the classes stand for, as the inside of a Java class.
DIGIT, LETTER = r"\p{Nd}", r"\p{L}\p{N}_"
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CLASSES = {"d": DIGIT, "w": LETTER, "s": BLANK}
#: The same with ASCII first, as one look-up: a union is tried part by part, and most characters are ASCII. (Not within a negated class, where Java's unions are another matter.)
FAST = {"d": r"0-9[\x80-\x{10FFFF}&&[\p{Nd}]]", "w": r"\w[\x80-\x{10FFFF}&&[\p{L}\p{N}]]", "s": r"\s[\x1c-\u3000&&[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"}
#: ASCII's alone, as the SQL engine beside the queries (RE2) has them; its blanks are one fewer than Java's.
PLAIN = {"d": r"\d", "w": r"\w", "s": r"\t\n\f\r "}


def _edge(word: str) -> str:
    return f"(?:(?<![{word}])(?=[{word}])|(?<=[{word}])(?![{word}]))"


EDGE = _edge(FAST["w"])


@cache
def native(pattern: str, *, plain: bool = False) -> str:
    """The pattern for Spark's functions; plain: with classes of ASCII alone."""
    classes, fast, edge = (PLAIN, PLAIN, _edge(PLAIN["w"])) if plain else (CLASSES, FAST, EDGE)
    out, inside, negated, k = [], False, False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            name = pattern[k + 1]
            if name in classes:
                out.append((classes if negated else fast)[name] if inside else f"[{fast[name]}]")
            elif name.lower() in classes:
                if inside:
                    raise ValueError("a negated class within a class has no spelling here")
                out.append(f"[^{classes[name.lower()]}]")
            else:
                out.append(edge if name == "b" and not inside else c + name)
            k += 2
            continue
        negated = (c == "[" and not inside and pattern[k + 1] == "^") or (negated and c != "]")
        inside = (c == "[" and not inside) or (inside and c != "]")
        out.append(c)
        k += 1
    return "".join(out)


@cache
def _digits() -> tuple[str, str]:
    every = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd" and c > 127]
    return "".join(every), "".join(str(unicodedata.digit(c)) for c in every)


def plain_digits(x: Column) -> Column:
    """x with the digits of every script as ASCII's, for numbers that are read."""
    return F.translate(x, *_digits())
