"""Corpora which Spark derives from the given tables.

None of the given text tables holds SQL, so statements are made from ``events``:
one row of ``events`` is one occurrence of a statement (or one source file).
Every derivation is a narrow projection of a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.sqltext import once
from lintlake.functions.text import looks_like_sql

# One statement per event: template number = event_id % 32; {e} = event_id, {u} = user_id.
TEMPLATES = [
    "SELECT * FROM orders_{u} WHERE o_orderkey = {e}",
    "SELECT o_orderkey, o_custkey FROM orders",
    "SELECT c_name FROM customer_{u} WHERE c_name LIKE '%{u}'",
    "SELECT o_orderkey FROM orders_{u} WHERE o_custkey = {u} ORDER BY o_orderdate",
    "SELECT c_name FROM customer WHERE UPPER(c_name) = 'A{u}' AND LOWER(c_mktsegment) = 'b'",
    "SELECT o_custkey, COUNT(*) FROM orders_{u} GROUP BY o_custkey HAVING COUNT(*) > {u}",
    "SELECT o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey",
    "SELECT s_name FROM supplier_{u} WHERE s_suppkey = {u} OR s_name = 'x{e}'",
    "SELECT l_orderkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN "
    "(SELECT o_orderkey, 1 FROM orders WHERE o_custkey = {u})",
    "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey = {e})",
    "SELECT c_name FROM customer WHERE c_custkey NOT IN (1, 2, {u})",
    "SELECT c_name FROM customer WHERE c_mktsegment = NULL",
    "SELECT c_name FROM customer WHERE c_mktsegment != NULL LIMIT 10",
    "SELECT DISTINCT c.c_name FROM customer_{u} c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey = {e}",
    "SELECT p_name FROM part WHERE p_size > ((({u} + 1) * 2) + (3 * (4 + (5))))",
    "INSERT INTO region VALUES ({e}, 'r{u}')",
    "INSERT INTO region (r_regionkey, r_name) VALUES ({e}, 'r')",
    "UPDATE customer_{u} SET c_acctbal = 0",
    "DELETE FROM orders",
    "DELETE FROM orders WHERE o_orderkey = {e}",
    "DROP TABLE tmp_{u}",
    "TRUNCATE TABLE events_stage",
    "SELECT " + "l_orderkey, " * 50 + "l_partkey FROM lineitem WHERE l_orderkey = {e}",
    "SELECT p_name FROM part WHERE p_size > 18 AND p_retailprice > 50000 AND p_partkey = 1{u}",
    "SELECT o_orderkey FROM orders_{u} WHERE o_custkey = #{custId} ORDER BY ${orderBy}",
    "INSERT INTO nation (n_nationkey,, n_name) VALUES (1, 'x')",
    "SELECT n_name FROM nation_{u} AND n_regionkey = {u}",
    "SELECT id FROM payment_order WHERE pay_id = {u}",
    "SELECT t.o_orderkey FROM (SELECT * FROM orders_{u} WHERE o_custkey = {u}) t WHERE t.o_orderkey = {e}",
    "SELECT c_custkey FROM customer WHERE c_custkey = {u} UNION SELECT o_custkey FROM orders",
    "WITH x AS (SELECT o_orderkey FROM orders WHERE o_custkey = {u}) SELECT o_orderkey FROM x WHERE o_orderkey = {e}",
    "update:sku:{u}",
]

SOURCE_OF_EVENT = {
    "click": "STRING_LITERAL",
    "view": "MYBATIS",
    "purchase": "MYBATIS_ANNOTATION",
    "signup": "JPA_ANNOTATION",
    "error": "SQL_FILE",
}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table, reduced to some columns.

    The text made from a row costs far more than the few columns read, so rows are dealt out by the first
    of them before any text is made: a file with few row groups would keep few tasks busy.  Their number is the
    session's: left open, partitions would be merged by the size of these narrow columns and not by the work.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*columns).repartition(partitions, columns[0]) if columns else df


def fill(template: Column, e: Column, u: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{e}"), e.cast("string")), F.lit("{u}"), u.cast("string"))


def pick(selector: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (selector + 1).cast("int"))


def raw_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a candidate, cache keys included."""
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    e, u = F.col("event_id"), F.col("user_id")
    source = F.create_map(*[F.lit(x) for kv in SOURCE_OF_EVENT.items() for x in kv])[F.col("event_type")]
    svc = F.concat(F.lit("svc"), (u % 5).cast("string"))
    uid = u.cast("string")
    ev = ev.select(
        e.alias("occ_id"),
        source.alias("source_type"),
        F.when(source == "MYBATIS", F.concat(F.lit("M"), uid, F.lit(".xml")))
        .when(source == "SQL_FILE", F.concat(F.lit("S"), uid, F.lit(".sql")))
        .otherwise(F.concat(F.lit("F"), uid, F.lit(".java")))
        .alias("file_name"),
        F.when(source == "MYBATIS", F.concat(svc, F.lit("/src/main/resources/")))
        .when(source == "SQL_FILE", F.concat(svc, F.lit("/db/")))
        .otherwise(F.concat(svc, F.lit("/src/main/java/")))
        .alias("dir"),
        (1 + e % 200).cast("int").alias("line"),
        once(fill(pick(e % len(TEMPLATES), TEMPLATES), e, u)).alias("sql"),
    )
    return ev.select("occ_id", F.concat("dir", "file_name").alias("path"), "file_name", "line", "source_type", "sql")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_occurrences(spark, sf_dir).where(looks_like_sql(F.col("sql")))
