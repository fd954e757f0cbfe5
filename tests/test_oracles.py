"""Every registered query with SQL beside it gives the same rows as DuckDB; the others run."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from textloom.plans import note_queries, oracles, queries, source_queries, stream_queries, term_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = (oracles.oracle_sql() | source_queries.oracle_sql()).get(name)
    if not sql:
        assert len(set(columns)) == len(columns)
        return
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()), key=repr) == rows


@pytest.mark.parametrize("name", ["a21_private_counts", "a21_other_private_counts"])
def test_counts_of_odd_texts(spark, tmp_path, name):
    """Letters, digits and blanks of other scripts beside a match, an empty text and none."""
    texts = [None, "", "\n", "é1234567890", "1234567890é", "٠١٢٣٤٥٦٧٨٩", "_1234567890 1234567890", "é12/03/2024 ١٢/٠٣/٢٠٢٤ 2024-1-5", "é@x.com a@éx.com a@x.éé", "a.b@c.com-x@y.org josé@x.com", "MRN: ١٢٣ MRN\xa0123 File\vNo 123 File\tno 123", "رقم: 4567 رقم\u3000٤٥٦", "٠٥٥١٢٣٤٥٦٧ 055\v1234567 055 1234567"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = duckdb.sql(f"WITH documents AS (FROM '{tmp_path}/documents.parquet/*.parquet') {(oracles.oracle_sql() | source_queries.oracle_sql())[name]}")
    df = queries.queries()[name](spark, str(tmp_path))
    assert sorted(got.fetchall()) == sorted(tuple(r[c] for c in got.columns) for r in df.collect())
