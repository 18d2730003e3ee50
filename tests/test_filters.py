"""Filters on a partition column reach the scan through the steps that compute texts once."""

import pytest
from pyspark.sql import functions as F

from lintlake.functions.sqltext import with_computed
from lintlake.operators import dedupe, extract, rules, schema
from lintlake.operators.preprocess import preprocess


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parts"))
    rows = [(f"s{i}", f"SELECT * FROM t{i} WHERE UPPER(a) = {i}", "SQL_FILE", f"f{i}.sql", i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "stmt_id string, original_sql string, source_type string, first_file string, day int")
    df.write.partitionBy("day").parquet(f"{path}/stmts")
    files = spark.createDataFrame([(f"db/{i}.sql", f"SELECT a FROM t{i};\nSELECT b FROM t{i};", f"db/{i}.sql") for i in range(6)],
                                  "path string, content string, part string")
    files.write.partitionBy("part").parquet(f"{path}/files")
    return path


def scan_filters(df) -> str:
    """PartitionFilters of the scans in the plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(line[line.index("PartitionFilters"):] for line in text.splitlines() if "PartitionFilters" in line)


def test_preprocess(spark, folder):
    df = preprocess(spark.read.parquet(f"{folder}/stmts"), explain_enabled=True).where("day = 1")
    assert "day" in scan_filters(df).split("]")[0] and df.count() == 10


def test_lint(spark, folder):
    df = rules.lint(preprocess(spark.read.parquet(f"{folder}/stmts"))).where("day = 1")
    assert "day" in scan_filters(df).split("]")[0]
    assert all({i.rule_id for i in r.issues} >= {"select-star", "function-on-indexed-column"} for r in df.collect())


def test_extract(spark, folder):
    files = spark.read.parquet(f"{folder}/files").select(F.col("part").alias("path"), "content")
    df = extract.extract_all(files).where("path = 'db/2.sql'")
    assert "part" in scan_filters(df).split("]")[0]
    assert sorted(r.sql for r in df.collect()) == ["SELECT a FROM t2", "SELECT b FROM t2"]


def test_a_filter_on_the_computed_column_stays_above(spark, folder):
    """The expression stands once in the plan, however the column is used."""
    df = with_computed(spark.read.parquet(f"{folder}/stmts"), n=F.regexp_replace("original_sql", "S(E)LECT", "$1"))
    used = df.where("n like 'E%' and length(n) > 3").select(F.concat("n", "n").alias("m"))
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("S(E)LECT") == 1 and used.count() == 30
