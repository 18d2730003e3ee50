"""Queries on captured plans; plan rows are made from ``lineitem``, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.plans import nodes as pn
from lintlake.suite import corpus
from lintlake.suite.registry import query
from lintlake.suite.twin_core import part, with_


def plan_nodes(spark, sf) -> DataFrame:
    li = corpus.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey", "l_partkey", "l_quantity")
    n = F.col("l_linenumber")
    none = F.lit(None).cast("string")
    return li.select(
        F.col("l_orderkey").alias("stmt_id"), n.alias("node_no"), F.lit("SIMPLE").alias("select_type"),
        F.when(F.col("l_returnflag") == "A", "ALL").when(F.col("l_returnflag") == "N", "ref").otherwise("range")
        .alias("access_type"),
        F.when(n != 3, F.concat(F.lit("t"), F.col("l_suppkey").cast("string"))).alias("table_name"),
        F.when(F.col("l_partkey") % 2 == 0, F.lit("idx_a,idx_b")).otherwise(none).alias("possible_keys"),
        F.when(F.col("l_linestatus") == "O", "idx_a").when(n == 5, "null").alias("key_name"),
        none.alias("key_len"), none.alias("ref"),
        F.when(n != 7, (F.col("l_quantity") * 1000).cast("bigint")).alias("est_rows"),
        corpus.pick(n % 4, ["Using where", "Using temporary", "Using filesort", "Using temporary; Using filesort"])
        .alias("extra"),
    )


part("node", """
SELECT l_orderkey AS stmt_id, l_linenumber AS node_no,
  CASE l_returnflag WHEN 'A' THEN 'ALL' WHEN 'N' THEN 'ref' ELSE 'range' END AS access_type,
  CASE WHEN l_linenumber <> 3 THEN 't' || l_suppkey END AS table_name,
  CASE WHEN l_partkey % 2 = 0 THEN 'idx_a,idx_b' END AS possible_keys,
  CASE WHEN l_linestatus = 'O' THEN 'idx_a' WHEN l_linenumber = 5 THEN 'null' END AS key_name,
  CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity * 1000 AS BIGINT) END AS est_rows,
  ['Using where', 'Using temporary', 'Using filesort', 'Using temporary; Using filesort'][l_linenumber % 4 + 1] AS extra
FROM lineitem""")
part("flag", """
SELECT *, access_type = 'ALL' AS full_scan, coalesce(key_name, '') NOT IN ('', 'null') AS uses_index,
  contains(extra, 'temporary') AS temporary, contains(extra, 'filesort') AS filesort,
  coalesce(est_rows > 10000, false) AS high,
  coalesce('，预计扫描行数: ' || est_rows, '') AS note, coalesce(table_name, '<unknown>') AS t FROM node""", "node")
_SOFT = "CASE WHEN high THEN 'WARNING' ELSE 'INFO' END"
part("node_issue", f"""
SELECT stmt_id, node_no, 0 AS k, 'FULL_TABLE_SCAN' AS type, CASE WHEN high THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  '检测到全表扫描' || note AS message, '建议在 ' || t || ' 表上添加适当的索引以避免全表扫描' AS suggestion,
  table_name AS evidence FROM flag WHERE full_scan
UNION ALL SELECT stmt_id, node_no, 1, 'NO_INDEX_USED', {_SOFT}, '查询未使用索引' || note,
  '建议在 ' || t || ' 表上为 WHERE 条件字段添加索引', table_name FROM flag WHERE NOT uses_index
UNION ALL SELECT stmt_id, node_no, 2, 'HIGH_ROWS', 'WARNING', '预计扫描行数过多: ' || est_rows || ' 行',
  '建议优化查询条件或添加复合索引以减少扫描行数', table_name FROM flag WHERE high
UNION ALL SELECT stmt_id, node_no, 3, 'USING_TEMPORARY', {_SOFT}, '查询使用了临时表',
  '临时表创建会影响性能，建议优化 GROUP BY 或 ORDER BY，或考虑添加索引', table_name FROM flag WHERE temporary
UNION ALL SELECT stmt_id, node_no, 4, 'USING_FILESORT', {_SOFT}, '查询使用了文件排序',
  '建议为 ORDER BY 字段添加索引以避免文件排序', table_name FROM flag WHERE filesort""", "flag")


@query("exp_02_node_flags", with_(
    "SELECT stmt_id, node_no, full_scan, uses_index, temporary, filesort FROM flag", "flag"))
def _(spark, sf):
    return pn.with_node_flags(plan_nodes(spark, sf)).select(
        "stmt_id", "node_no", "full_scan", "uses_index", "temporary", "filesort")


@query("exp_03_plan_issues", with_(
    "SELECT stmt_id, node_no AS node_no, type, severity, message, suggestion, evidence FROM node_issue", "node_issue"))
def _(spark, sf):
    rows = pn.plan_issues(plan_nodes(spark, sf)).withColumn("node_no", F.floor(F.col("issue_no") / 5).cast("int"))
    return rows.select("stmt_id", "node_no", "type", "severity", "message", "suggestion", "evidence")


@query("exp_04_plan_rollup", with_(
    "SELECT stmt_id, count(*) AS node_count, CAST(coalesce(sum(est_rows), 0) AS BIGINT) AS total_rows, "
    "bool_or(full_scan) AS has_full_scan, bool_or(temporary) AS has_temporary, bool_or(filesort) AS has_filesort "
    "FROM flag GROUP BY 1", "flag"))
def _(spark, sf):
    return pn.plan_rollup(plan_nodes(spark, sf)).select(
        "stmt_id", "node_count", "total_rows", "has_full_scan", "has_temporary", "has_filesort")


@query("exp_05_plan_severity", with_(
    """SELECT o_orderkey AS stmt_id, CASE max(CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END)
       WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' ELSE 'INFO' END AS plan_severity
       FROM orders LEFT JOIN node_issue ON o_orderkey = stmt_id GROUP BY 1""", "node_issue"))
def _(spark, sf):
    stmts = corpus.table(spark, sf, "orders").select(F.col("o_orderkey").alias("stmt_id"))
    return pn.statement_plans(stmts, plan_nodes(spark, sf)).select("stmt_id", "plan_severity")


_NODE_TEXT = """'访问类型: ' || access_type || CASE access_type WHEN 'ALL' THEN ' (全表扫描)' WHEN 'range' THEN ' (范围扫描)'
  ELSE ' (索引查找)' END || CASE WHEN coalesce(key_name, '') <> '' THEN ', 使用索引: ' || key_name
  WHEN possible_keys IS NOT NULL THEN ', 可用索引但未使用: ' || possible_keys ELSE ', 无索引可用' END
  || CASE WHEN est_rows > 0 THEN ', 预计扫描行数: ' || est_rows ELSE '' END || ', ' || extra"""


@query("exp_06_node_text", with_(f"SELECT stmt_id, node_no, {_NODE_TEXT} AS node_text FROM node", "node"))
def _(spark, sf):
    return pn.plan_text(plan_nodes(spark, sf))


# text plans: one line per lineitem row, number = l_linenumber % 7
TEXT = [
    "Seq Scan on t{s}  (cost=0.00..1.0 rows={n} width=4)",
    "  ->  Index Scan using idx_{p} on t{s}  (cost=0.1..2.0 rows={n} width=8)",
    "Index Only Scan using idx_{p} on t{s}  (cost=0.1..2.0 rows={n} width=8)",
    "Nested Loop  (cost=0.0..9.9 rows={n} width=12)",
    "Hash Join  (cost=0.0..9.9 rows=many width=12)",
    "Merge Join  (cost=0.0..9.9)",
    "Sort  (cost=1.0..2.0 rows={n} width=4)",
]
_SQL_TEXT = "[" + ", ".join("'" + t + "'" for t in TEXT) + "][l_linenumber % 7 + 1]"


@query("exp_07_nodes_from_text",
       f"""SELECT stmt_id, node_no, ['ALL', 'index', 'index', 'Nested Loop', 'Hash Join', 'Merge Join', 'unknown'][k + 1] AS access_type,
  CASE WHEN k <= 2 THEN 't' || s END AS table_name, CASE WHEN k IN (1, 2) THEN 'idx_' || p END AS key_name,
  CASE WHEN k NOT IN (4, 5) THEN n END AS est_rows,
  replace(replace(replace(t, '{{s}}', s::VARCHAR), '{{p}}', p::VARCHAR), '{{n}}', n::VARCHAR) AS node_text
FROM (SELECT l_orderkey AS stmt_id, l_linenumber AS node_no, l_linenumber % 7 AS k, l_suppkey AS s, l_partkey AS p,
        CAST(l_quantity AS BIGINT) AS n, {_SQL_TEXT} AS t FROM lineitem)""")
def _(spark, sf):
    li = corpus.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    text = corpus.pick(F.col("l_linenumber") % 7, TEXT)
    for key, col in (("{s}", F.col("l_suppkey")), ("{p}", F.col("l_partkey")), ("{n}", F.col("l_quantity").cast("bigint"))):
        text = F.replace(text, F.lit(key), col.cast("string"))
    lines = li.select(F.col("l_orderkey").alias("stmt_id"), F.col("l_linenumber").alias("node_no"), text.alias("plan_text"))
    return pn.nodes_from_text(lines).select(
        "stmt_id", "node_no", "access_type", "table_name", "key_name", "est_rows", "node_text")


@query("exp_08_nodes_from_tabular", with_(
    f"""SELECT stmt_id, node_no, CASE WHEN node_no <> 2 THEN CAST(node_no AS INTEGER) END AS plan_id, access_type, table_name,
  key_name, CASE WHEN node_no = 4 THEN 0 ELSE est_rows END AS est_rows, extra,
  {_NODE_TEXT.replace('est_rows', '(CASE WHEN node_no = 4 THEN 0 ELSE est_rows END)')} AS node_text FROM node""", "node"))
def _(spark, sf):
    n = plan_nodes(spark, sf)
    no = F.col("node_no")
    raw = n.select(
        "stmt_id", "node_no", F.when(no == 2, "n/a").otherwise(no.cast("string")).alias("ID"),
        F.col("select_type").alias("SELECT_TYPE"), F.col("access_type").alias("Type"), F.col("table_name").alias("TABLE"),
        "possible_keys", F.col("key_name").alias("Key"), F.when(no == 4, "many").otherwise(F.col("est_rows").cast("string"))
        .alias("ROWS"), F.col("extra").alias("Extra"))
    return pn.nodes_from_tabular(raw).select(
        "stmt_id", "node_no", "plan_id", "access_type", "table_name", "key_name", "est_rows", "extra", "node_text")


@query("exp_09_nodes_minimal", with_(
    """SELECT stmt_id, node_no, CAST(node_no AS INTEGER) AS plan_id, access_type, access_type AS select_type, table_name,
  '操作类型: ' || access_type || coalesce(', 表: ' || table_name, '') AS node_text FROM node""", "node"))
def _(spark, sf):
    raw = plan_nodes(spark, sf).select(
        "stmt_id", "node_no", F.col("node_no").cast("string").alias("ID"), F.col("access_type").alias("TYPE"),
        F.col("table_name").alias("tableName"))
    return pn.nodes_minimal(raw).select(
        "stmt_id", "node_no", "plan_id", "access_type", "select_type", "table_name", "node_text")


@query("exp_10_plan_summary", with_(
    "SELECT stmt_id, node_no, t || ' / ' || access_type || ' / rows=' || coalesce(est_rows::VARCHAR, '?') AS summary FROM flag",
    "flag"))
def _(spark, sf):
    return pn.plan_summary(plan_nodes(spark, sf))


def plan_errors(spark, sf) -> DataFrame:
    """EXPLAIN messages, made from orders: every fifth statement has one, some are blank."""
    o = corpus.table(spark, sf, "orders", "o_orderkey").where(F.col("o_orderkey") % 5 == 0)
    key = F.col("o_orderkey")
    return o.select(key.alias("stmt_id"), F.when(key % 10 == 0, " ").otherwise(
        F.concat(F.lit("timeout after "), (key % 30).cast("string"))).alias("error_message"))


@query("exp_11_evidence", with_(
    """SELECT o_orderkey AS stmt_id, o_orderkey IN (SELECT stmt_id FROM node) AND o_orderkey % 10 <> 5 AS explain_executed,
  o_orderkey % 10 = 5 AS explain_failed, CASE WHEN o_orderkey % 10 = 5 THEN 'timeout after ' || (o_orderkey % 30) END
  AS error_message FROM orders""", "node"))
def _(spark, sf):
    stmts = corpus.table(spark, sf, "orders").select(F.col("o_orderkey").alias("stmt_id"))
    return pn.evidence(stmts, plan_nodes(spark, sf), plan_errors(spark, sf))
