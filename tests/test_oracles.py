"""Every query that has SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from trawlkit import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return f"{value:.9g}" if isinstance(value, float) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, duck, sf_dir, run, sql):
    df = run(spark, sf_dir)
    other = duck.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    assert rows(df.columns, df.collect()) == rows(other.columns, other.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    compare(spark, duck, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name])


def test_phone_extract_whatever_stands_around(spark, duck, tmp_path):
    """Numbers behind register labels, in long tokens and dates, split by a carriage return, with digits of other scripts, in repeated ids."""
    texts = ["VAT no 47.137.250.251", "tax id +1 (632) 555-4827", "x" * 330 + "4155552671", "on 01.02.2024 5551234", "(030) 12\r3456", "(12) 34٣56, (12) 34٣567", "2024-01-02 and 2024-01-02", "call 415-555-2671", "+49 30 901820, 0049 30 901820", None, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(7, "again 415-555-2671 ")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        for name in ("phone_extract", "phone_junk_filter"):
            compare(spark, c, str(tmp_path), catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name, part", [("email_cf_decode", "ascii("), ("link_scores", "get-in-touch")])
def test_costly_expressions_are_computed_once(spark, sf_dir, name, part):
    """The coded address and the words of a link are read many times; a plan that copied them would compute them as often."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(part) == 1


@pytest.mark.parametrize("name", ["email_cf_decode", "social_facebooks", "link_scores"])
def test_single_row_group_is_dealt_out(spark, tmp_path, name):
    """A file of one row group is read by one task, however many its splits; rows are dealt to all cores before the work."""
    rows = spark.range(4000).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "id AS s_suppkey")
    for t in ("customer", "supplier"):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert spark.read.parquet(f"{tmp_path}/customer.parquet").rdd.getNumPartitions() >= 4
        dealt = catalog._t(spark, str(tmp_path), "customer").groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) == 4 and all(r["count"] == 1000 for r in dealt)
        assert "Repartition" in catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_made_pages_of_a_single_row_group_are_dealt_out(spark, tmp_path):
    rows = spark.range(400).selectExpr("id AS s_suppkey")
    rows.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert spark.read.parquet(f"{tmp_path}/supplier.parquet").rdd.getNumPartitions() >= 4
        assert [r["count"] for r in catalog._made_pages(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()] == [400] * 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
