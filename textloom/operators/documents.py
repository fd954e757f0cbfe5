"""Documents: text of HTML pages and office files, page roll-ups, chunks of text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.normalize import has_basic_arabic, word_count

# The named character references of text; the ampersand's comes last.
REFERENCES = (("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&bull;", "•"), ("&reg;", "®"), ("&trade;", "™"), ("&deg;", "°"), ("&euro;", "€"), ("&pound;", "£"), ("&sect;", "§"), ("&times;", "×"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))

#: Files that a task unpacks at once.
FILES = 64


def character_references(text: Column) -> Column:
    """Named, decimal and hexadecimal character references as their characters, each once; what names no character stays as it is.

    The text is parted at its ampersands, so that it is gone through once, however many names there are.
    """
    named = F.create_map(*(F.lit(x) for reference, character in REFERENCES if reference[1] != "#" for x in (reference[1:-1], character)))
    character = lambda code: F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{1,8});", 1)
        decimal, hexadecimal = F.regexp_extract(name, "^#([0-9]+)$", 1), F.regexp_extract(name, "^#[xX](.+)$", 1)
        code = F.when(decimal != "", decimal).when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).cast("long")
        found = F.coalesce(named[name], F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), character(code)))
        return F.when((name != "") & found.isNotNull(), F.concat(found, F.substr(p, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), p))

    return F.array_join(F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(piece(p))), "")


def html_text(html: Column) -> Column:
    """The text of a page's body (or of the whole page): scripts and styles go, tags part lines, blank lines go."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", "")
    body = F.regexp_extract(bare, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)", 1)
    out = F.regexp_replace(F.when(body != "", body).otherwise(bare), r"(?s)<!--.*?-->|<[^>]*>", "\n")
    out = character_references(out)
    lines = F.transform(F.split(out, "\n"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def _paragraphs(xml: bytes, space: str) -> list[str]:
    found = []
    for paragraph in ElementTree.fromstring(xml).iter(f"{space}p"):
        text = "".join(t.text or "" for t in paragraph.iter(f"{space}t"))
        if text.strip():
            found.append(text)
    return found


def _office(kind: str, content: bytes) -> list[tuple[int, str]]:
    archive = zipfile.ZipFile(io.BytesIO(content))
    if kind == "docx":
        return [(1, "\n".join(_paragraphs(archive.read("word/document.xml"), "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}")))]
    slides = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    return [(k, "\n".join(_paragraphs(archive.read(n), "{http://schemas.openxmlformats.org/drawingml/2006/main}"))) for k, n in slides]


def parse_files(files: DataFrame) -> DataFrame:
    """(path, page, text, warning) of binaryFile rows (path, content), by extension; what can't be read is a row with a warning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few files at a time: what is unpacked of them is many times a batch's contents
        for batch in batches:
            for a in range(0, batch.num_rows, FILES):
                rows = []
                for path, content in zip(*(c.to_pylist() for c in batch.slice(a, FILES).columns), strict=True):
                    kind = path.rsplit(".", 1)[-1].lower()
                    try:
                        if kind in ("docx", "pptx", "ppt"):  # a .ppt is read if it is an archive under an old name
                            rows += [(path, k, text, None) for k, text in _office(kind, content)]
                        elif kind in ("html", "htm"):
                            rows.append((path, 1, content.decode(errors="replace"), None))
                        elif kind == "pdf":
                            rows.append((path, None, None, "no PDF reader is installed"))
                        else:
                            rows.append((path, None, None, f"unknown type {kind}"))
                    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
                        rows.append((path, None, None, f"unreadable: {type(error).__name__}"))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "page", "text", "warning"])

    parsed = files.select("path", "content").mapInArrow(run, "path string, page int, text string, warning string")
    page = F.lower("path").rlike(r"\.html?$")
    return parsed.withColumn("text", F.when(page, html_text(F.col("text"))).otherwise(F.col("text")))


def roll_up(pages: DataFrame, key: str, *, page: str = "page", text: str = "text") -> DataFrame:
    """Pages, words, the full text in page order, and whether any page has Arabic letters, for each document."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(page, text))), lambda p: p[text]), "\n\n")
    return pages.groupBy(key).agg(F.count("*").alias("pages"), F.sum(word_count(text)).alias("words"), joined.alias("full_text"), F.bool_or(has_basic_arabic(text)).alias("arabic"))


def fixed_chunks(docs: DataFrame, *, text: str = "text", size: int = 1000, overlap: int = 100) -> DataFrame:
    """docs with (chunk, chunk_text): so many characters each, the last ones of one being the first of the next."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(step))
    return docs.select("*", F.posexplode(starts).alias("chunk", "_s")).withColumn("chunk_text", F.substr(text, F.col("_s") + 1, F.lit(size))).drop("_s")


def sentence_chunks(docs: DataFrame, *, text: str = "text") -> DataFrame:
    found = F.filter(F.transform(F.split(F.col(text), r"(?<=[.!?؟])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return docs.select("*", F.posexplode(found).alias("chunk", "chunk_text"))


def section_chunks(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Blank lines part sections."""
    found = F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), lambda s: F.trim(s)), lambda s: s != "")
    return docs.select("*", F.posexplode(found).alias("chunk", "chunk_text"))


def timeline(records: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """The records of each patient in order."""
    return records.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(at, *columns))).alias("timeline"))


def fhir_observation(value: Column, name: Column, subject: Column, at: Column) -> Column:
    return F.to_json(F.struct(F.lit("Observation").alias("resourceType"), F.struct(name.alias("text")).alias("code"), F.struct(F.concat(F.lit("Patient/"), subject).alias("reference")).alias("subject"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("effectiveDateTime"), F.struct(value.alias("value")).alias("valueQuantity")))
