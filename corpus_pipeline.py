"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

1. toxicity: documents that the grammar scores at 0.7 or more go.
2. shingle join: of each group of near copies (0.8 or more of their shingles of five words in common) the document with the least doc_id stays (of rows that repeat it, the first in place).
3. suffix dedup: strings of 100 bytes that stand earlier are cut out; a document of which nothing is left goes. A character that a
   cut splits goes whole, and n_chars is counted anew.
4. decontamination: documents that hold a benchmark item go.
5. byte-level BPE: token ids for what is left, with their number.

Null and empty texts stay through stages 1, 2 and 4 and have no ids; stage 3 drops no row that has lost nothing. Null doc_ids come last
where an id decides, and rows that repeat an id are documents of their own. An empty table gives an empty result. Columns beside those
of documents are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, jaccard, packed, pigeonhole, suffix, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words in a shingle of stage 2, and the least Jaccard similarity of near copies in percent; op7 has values of its own.
SHINGLE, SIMILAR = 5, 80


_folders: dict[str, str] = {}


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A shared folder for a stage. The one before over the same tables has been written when a stage begins, so what it left there goes."""
    if sf_dir in _folders:
        packed.delete(spark, _folders.pop(sf_dir))
    _folders[sf_dir] = packed.shared_folder(spark)
    return _folders[sf_dir]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scores(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.first_of_groups(docs.select(*COLUMNS), _folder(spark, sf_dir), k=SHINGLE, percent=SIMILAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(docs, _folder(spark, sf_dir), keep=("doc_id", "lang", "source"), characters=True)
    cut = cut.filter("n_removed = 0 or n_removed < n_bytes").withColumnRenamed("kept", "text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pigeonhole.without_matches(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _folder(spark, sf_dir))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, _folder(spark, sf_dir), keep=COLUMNS).select(*COLUMNS, "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("shingle join", drop_near_copies),
    ("suffix dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]

#: SQL can say none of the stages at this size; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = packed.shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = packed.table(docs, folder, f"stage{k}")
    return docs
