"""Each query with an oracle gives what DuckDB gives for it."""

from __future__ import annotations

import glob
import os

import pytest

import __spark_entry__ as entry

own = sorted(k for k in entry.own.QUERIES)


def shown(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def table(cursor_rows):
    return sorted(tuple(map(shown, r)) for r in cursor_rows)


@pytest.fixture(scope="module")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", own)
def test_query(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    names = sorted(df.columns)
    got = table(df.select(*[f"`{c}`" for c in names]).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == names
    assert got == table(rel.project(",".join(f'"{c}"' for c in names)).fetchall())


@pytest.mark.parametrize("name", ["folded_code", "block_types", "block_sections", "html_markdown", "tag_protect", "report_words", "conservative_texts", "compress_documents"])
def test_kernels_use_all_cores(spark, small, name):
    """The tables are one row group each, which one task reads; the kernel's rows lie in many partitions."""
    from pyspark.sql import functions as F

    cores = spark.sparkContext.defaultParallelism
    parts = entry.queries()[name](spark, small).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 2 * cores


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
