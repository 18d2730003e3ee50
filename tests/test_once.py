"""Texts that several parts of a result use are computed once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lintlake.operators import mapper as mp
from lintlake.operators import schema as sch


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def counted(spark):
    """A frame whose column passes a function that counts its calls, and the count."""

    def make(df, column):
        calls = spark.sparkContext.accumulator(0)

        def seen(text):
            calls.add(1)
            return text

        return df.withColumn(column, F.udf(seen, "string").asNondeterministic()(column)), calls

    return make


STATEMENTS = [(1, "SELECT", "SELECT a FROM t WHERE a = 1"), (2, "SELECT", "SELECT b FROM u WHERE b = 1"), (3, "DELETE", "DELETE FROM t WHERE id = 1")]
DDL = [("a.sql", "CREATE TABLE t (id INT, a INT, PRIMARY KEY (id));")]


def frames(spark):
    return (spark.createDataFrame(STATEMENTS, "stmt_id long, sql_type string, norm string"),
            spark.createDataFrame(DDL, "path string, content string"))


def test_flatten_tags_computes_its_body_once(spark):
    """the body of a mapper statement is a chain of rewrites."""
    body = F.regexp_replace("t", "zz_body", "")
    df = spark.createDataFrame([("zz_bodyA <if test='x'>b</if>",), ("plain",), (None,)], "t string").select("t", mp.flatten_tags(body).alias("o"))
    assert plan_of(df).count("zz_body") == 1
    assert {r.t: r.o for r in df.collect()} == {"zz_bodyA <if test='x'>b</if>": "A b", "plain": "plain", None: None}


def test_include_reads_its_reference_once(spark):
    """once for an include, not once for every fragment it is compared with."""
    fragments = F.array(*[F.struct(F.lit(f"n.f{i}").alias("id"), F.lit(f"b{i}").alias("body")) for i in (1, 2, 1)])
    df = spark.createDataFrame([("<include refid='n.f1'/>",), ("<include refid='m.f2'/>",), ("<include refid=''/>",)], "t string")
    out = df.select(F.trim(mp.resolve_includes(F.col("t"), fragments)).alias("o"))
    assert plan_of(out).count("refid") <= 2
    assert [r.o for r in out.collect()] == ["b1", "/* INCLUDE:m.f2 */", ""]


def test_summary_reads_each_statement_once(spark, counted):
    """references are shared by coverage, missing indexes and counts."""
    stmts, ddl = frames(spark)
    read, calls = counted(stmts, "norm")
    row = sch.schema_summary(read, sch.extract_ddl(ddl)).collect()[0]
    assert (row.referenced_count, row.covered_count, row.missing_count, row.unindexed_count) == (2, 1, 1, 1)
    assert calls.value == len(STATEMENTS)


def test_risks_read_each_statement_once(spark, counted):
    """F7."""
    stmts, ddl = frames(spark)
    read, calls = counted(stmts, "norm")
    rows = sch.schema_risks(read, sch.extract_ddl(ddl)).collect()
    assert sorted((r.stmt_id, r.risk_type) for r in rows) == [(1, "UNINDEXED_PREDICATE"), (2, "SCHEMA_GAP")]
    assert calls.value == len(STATEMENTS)


@pytest.mark.parametrize("name", ["rem_13_executive_summary", "out_01_report_sections", "sch_20_resolve_schema"])
def test_shared_frames_are_not_read_again(spark, name):
    """what several parts use comes from checkpoints; no table is scanned again for a part."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert "Relation [" not in plan_of(plan)
