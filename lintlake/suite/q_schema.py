"""Queries on DDL, table usage, schema risks and inference.

DDL files are made from ``customer`` (one file per customer), statements from ``orders``
(one per order).  The twins start from what each kind of text must give, written by hand,
and compute the joins and groupings on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.operators import schema as sch
from lintlake.session import materialized
from lintlake.suite import corpus
from lintlake.suite.registry import query
from lintlake.suite.twin_core import part, q, with_

# kind = c_custkey % 6; {c} the customer, {p} the customer before
DDL = [
    """-- table of {c}; generated
CREATE TABLE `shop`.`t_cust_{c}` (
  id BIGINT NOT NULL, -- key, of row
  user_id BIGINT NOT NULL,
  status VARCHAR(16) DEFAULT 'a', # state
  amount DECIMAL(10, 2), /* in
  cents, * */
  created_at TIMESTAMP,
  PRIMARY KEY (`id`),
  KEY idx_user_{c} (user_id, status(8)),
  CONSTRAINT fk_{c} FOREIGN KEY (user_id) REFERENCES users (id)
) ENGINE=InnoDB;
""",
    """CREATE TABLE IF NOT EXISTS t_cust_{c} (id BIGINT PRIMARY KEY, user_id BIGINT, status VARCHAR(16), amount DECIMAL(10,2));
CREATE UNIQUE INDEX ux_{c} ON shop.t_cust_{c} (status, amount DESC);
""",
    "CREATE TABLE T_CUST_{p} (other INT, PRIMARY KEY (other));",
    "<ddl>CREATE TABLE t_cust_{c} (id BIGINT, user_id BIGINT, status INT, PRIMARY KEY (id, `user_id`));</ddl>",
    "-- CREATE TABLE t_cust_{c} (id INT);\n",
    """CREATE TABLE t_cust_{c} (id INT, status INT, UNIQUE KEY uk (`status` DESC));
CREATE TABLE audit_{c} (id INT, PRIMARY KEY(id));
""",
]
DDL_PATH = ["db/v1/c{c}.sql", "db/v1/c{c}.sql", "db/v2/c{c}.sql", "db/v1/c{c}.xml", "db/v1/c{c}.sql", "db/v1/c{c}.sql"]

# kind, pos, name, columns, primary key, indexed (inline)
DDL_TABLES = [
    (0, 0, "t_cust_{c}", "id,user_id,status,amount,created_at", "id", "id,user_id,status"),
    (1, 0, "t_cust_{c}", "id,user_id,status,amount", "", ""),
    (2, 0, "T_CUST_{p}", "other", "other", "other"),
    (3, 0, "t_cust_{c}", "id,user_id,status", "id,user_id", "id,user_id"),
    (5, 0, "t_cust_{c}", "id,status", "", "status"),
    (5, 1, "audit_{c}", "id", "id", "id"),
]

# kind = o_orderkey % 8: text, type, tables, predicate columns
SQL = [
    ("SELECT id FROM t_cust_{c} WHERE user_id = ? AND status = ? ORDER BY created_at", "SELECT",
     "t_cust_{c}", "user_id,status,created_at"),
    ("SELECT a.id FROM shop.t_cust_{c} a JOIN audit_{c} b ON a.id = b.id WHERE a.status IN (1, 2) AND b.kind LIKE 'x%'",
     "SELECT", "t_cust_{c},audit_{c}", "id,status,kind"),
    ("UPDATE t_cust_{c} SET status = 1 WHERE id = {o}", "UPDATE", "t_cust_{c}", "status,id"),
    ("DELETE FROM `t_cust_{c}` WHERE created_at < 5", "DELETE", "t_cust_{c}", "created_at"),
    ("INSERT INTO t_cust_{c} (id, user_id) VALUES ({o}, 1)", "INSERT", "t_cust_{c}", ""),
    ("CREATE TABLE t_new_{c} (id INT)", "CREATE", "", ""),
    ("SELECT id FROM t_cust_{c} t WHERE amount BETWEEN 1 AND 2 ORDER BY status DESC, t.id LIMIT 5", "SELECT",
     "t_cust_{c}", "amount,status,id"),
    ("SELECT 1", "SELECT", "", ""),
]


def ddl_files(spark, sf) -> DataFrame:
    cust = corpus.table(spark, sf, "customer", "c_custkey")
    c = F.col("c_custkey")
    put = lambda t: F.replace(
        F.replace(t, F.lit("{c}"), c.cast("string")), F.lit("{p}"), (c - 1).cast("string"))
    return cust.select(put(corpus.pick(c % 6, DDL_PATH)).alias("path"), put(corpus.pick(c % 6, DDL)).alias("content"))


def sql_statements(spark, sf) -> DataFrame:
    orders = corpus.table(spark, sf, "orders", "o_orderkey", "o_custkey")
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.replace(
        F.replace(corpus.pick(o % 8, [s[0] for s in SQL]), F.lit("{c}"), c.cast("string")), F.lit("{o}"), o.cast("string"))
    return orders.select(o.alias("stmt_id"), corpus.pick(o % 8, [s[1] for s in SQL]).alias("sql_type"), text.alias("norm"))


def _put(c: str) -> str:
    return f"replace(replace({c}, '{{c}}', c_custkey::VARCHAR), '{{p}}', (c_custkey - 1)::VARCHAR)"


_PATHS = "CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN {q(p)}" for i, p in enumerate(DDL_PATH)) + " END"
_DEFS = ", ".join(f"({k}, {p}, {q(n)}, {q(c)}, {q(pk)}, {q(ix)})" for k, p, n, c, pk, ix in DDL_TABLES)
part("ddl_def", f"""
SELECT {_put(_PATHS)} AS path, CAST(d.pos AS INTEGER) AS pos, {_put('d.name')} AS table_name,
  lower({_put('d.name')}) AS table_key, d.cols, d.pk, d.ix
FROM customer JOIN (VALUES {_DEFS}) d(kind, pos, name, cols, pk, ix) ON c_custkey % 6 = d.kind""")
part("ddl_first", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_key ORDER BY path, pos) AS rn FROM ddl_def)
WHERE rn = 1""", "ddl_def")
part("ddl_index", """SELECT 't_cust_' || c_custkey AS table_key, unnest(['status', 'amount']) AS col FROM customer
WHERE c_custkey % 6 = 1""")
part("ddl_table", """
SELECT table_key, table_name, path AS source_file, cols, pk,
  list_distinct(list_concat(list_filter(string_split(ix, ','), lambda x: x <> ''),
     coalesce((SELECT list(col) FROM ddl_index i WHERE i.table_key = f.table_key), []))) AS idx
FROM ddl_first f""", "ddl_first", "ddl_index")
_ROWS = ", ".join(f"({i}, {q(t)}, {q(ty)}, {q(tabs)}, {q(preds)})" for i, (t, ty, tabs, preds) in enumerate(SQL))
part("sch_stmt", f"""
SELECT o_orderkey AS stmt_id, s.ty AS sql_type, replace(s.tabs, '{{c}}', o_custkey::VARCHAR) AS tabs, s.preds,
  list_filter(string_split(s.preds, ','), lambda x: x <> '') AS cols
FROM orders JOIN (VALUES {_ROWS}) s(kind, t, ty, tabs, preds) ON o_orderkey % 8 = s.kind""")
part("sch_ref", """SELECT stmt_id, table_key, cols FROM (SELECT stmt_id, cols, unnest(string_split(tabs, ',')) AS table_key
FROM sch_stmt) WHERE table_key <> ''""", "sch_stmt")
part("sch_usage", """SELECT table_key, count(*) AS sql_count, coalesce(list_sort(list_distinct(flatten(list(cols)))), [])
AS predicate_columns FROM sch_ref GROUP BY 1""", "sch_ref")
part("sch_risk", f"""
SELECT r.stmt_id, 'SCHEMA_GAP' AS risk_type, 'INFO' AS severity, r.table_key AS table_name, u.predicate_columns AS preds,
  [] AS indexed, [] AS missing, {q(fv.GAP_EVIDENCE)} AS evidence, {q(fv.GAP_RECOMMENDATION)} AS recommendation
FROM sch_ref r JOIN sch_usage u USING (table_key) WHERE table_key NOT IN (SELECT table_key FROM ddl_table)
UNION ALL
SELECT stmt_id, 'UNINDEXED_PREDICATE', 'WARNING', table_name, cols, ind, mis,
  {q(fv.UNINDEXED_EVIDENCE)} || array_to_string(mis, ', '), {q(fv.UNINDEXED_RECOMMENDATION)}
FROM (SELECT r.stmt_id, d.table_name, r.cols, list_filter(r.cols, lambda x: list_contains(idx, x)) AS ind,
        list_filter(r.cols, lambda x: NOT list_contains(idx, x)) AS mis
      FROM sch_ref r JOIN ddl_table d USING (table_key)) WHERE len(mis) > 0""", "sch_ref", "sch_usage", "ddl_table")

J = lambda c: F.array_join(F.array_sort(c), ",")


def _js(c: str) -> str:
    return f"array_to_string(list_sort({c}), ',')"


def _split(c: str) -> str:
    return _js(f"list_filter(string_split({c}, ','), lambda x: x <> '')")


@query("sch_01_create_tables", with_(f"SELECT path, pos, table_name FROM ddl_def", "ddl_def"))
def _(spark, sf):
    return sch.create_tables(ddl_files(spark, sf)).select("path", "pos", "table_name")


@query("sch_02_table_name", with_("SELECT path, table_key, count(*) AS cnt FROM ddl_def GROUP BY ALL", "ddl_def"))
def _(spark, sf):
    return sch.create_tables(ddl_files(spark, sf)).groupBy("path", "table_key").agg(F.count(F.lit(1)).alias("cnt"))


@query("sch_03_columns", with_("SELECT path, table_name, cols AS columns FROM ddl_def", "ddl_def"))
def _(spark, sf):
    return sch.create_tables(ddl_files(spark, sf)).select(
        "path", "table_name", F.array_join("columns", ",").alias("columns"))


@query("sch_04_primary_key", with_("SELECT path, table_name, pk AS pk_columns FROM ddl_def", "ddl_def"))
def _(spark, sf):
    return sch.create_tables(ddl_files(spark, sf)).select(
        "path", "table_name", F.array_join("pk_columns", ",").alias("pk_columns"))


@query("sch_05_indexed_columns", with_("SELECT path, table_name, ix AS indexed_columns FROM ddl_def", "ddl_def"))
def _(spark, sf):
    return sch.create_tables(ddl_files(spark, sf)).select(
        "path", "table_name", F.array_join("indexed_columns", ",").alias("indexed_columns"))


@query("sch_06_create_index", with_("SELECT table_key, col AS index_column FROM ddl_index", "ddl_index"))
def _(spark, sf):
    return sch.create_indexes(ddl_files(spark, sf)).withColumnRenamed("column", "index_column")


@query("sch_07_first_definition", with_(
    f"SELECT table_key, table_name, source_file, {_split('cols')} AS columns, {_split('pk')} AS pk_columns, "
    f"{_js('idx')} AS indexed_columns FROM ddl_table", "ddl_table"))
def _(spark, sf):
    t = sch.extract_ddl(ddl_files(spark, sf))
    return t.select("table_key", "table_name", "source_file", J("columns").alias("columns"),
                    J("pk_columns").alias("pk_columns"), J("indexed_columns").alias("indexed_columns"))


@query("sch_09_table_refs", with_("SELECT stmt_id, table_key FROM sch_ref", "sch_ref"))
def _(spark, sf):
    return sch.table_refs(sql_statements(spark, sf)).select("stmt_id", "table_key")


@query("sch_10_predicate_columns", with_(
    "SELECT stmt_id, preds AS predicate_names FROM sch_stmt WHERE sql_type <> 'CREATE'", "sch_stmt"))
def _(spark, sf):
    return sch.predicate_columns(sql_statements(spark, sf)).select(
        "stmt_id", F.array_join("cols", ",").alias("predicate_names"))


@query("sch_11_table_usage", with_(
    f"SELECT table_key, sql_count, {_js('predicate_columns')} AS predicate_columns FROM sch_usage", "sch_usage"))
def _(spark, sf):
    return sch.table_usage(sql_statements(spark, sf)).select(
        "table_key", "sql_count", J("predicate_columns").alias("predicate_columns"))


def _risks(spark, sf) -> DataFrame:
    return sch.schema_risks(sql_statements(spark, sf), sch.extract_ddl(ddl_files(spark, sf)))


_RISK_SQL = (
    f"SELECT stmt_id, risk_type, severity, table_name, {_js('preds')} AS predicate_columns, {_js('indexed')} AS "
    f"indexed_columns, {_js('missing')} AS missing_columns, evidence, recommendation FROM sch_risk"
)


def _risk_cols(risks: DataFrame) -> DataFrame:
    return risks.select(
        "stmt_id", "risk_type", "severity", "table_name", J("predicate_columns").alias("predicate_columns"),
        J("indexed_predicate_columns").alias("indexed_columns"), J("missing_index_columns").alias("missing_columns"),
        "evidence", "recommendation")


@query("sch_12_schema_gap", with_(_RISK_SQL + " WHERE risk_type = 'SCHEMA_GAP'", "sch_risk"))
def _(spark, sf):
    return _risk_cols(_risks(spark, sf).where(F.col("risk_type") == "SCHEMA_GAP"))


@query("sch_13_unindexed_predicate", with_(_RISK_SQL + " WHERE risk_type = 'UNINDEXED_PREDICATE'", "sch_risk"))
def _(spark, sf):
    return _risk_cols(_risks(spark, sf).where(F.col("risk_type") == "UNINDEXED_PREDICATE"))


@query("sch_14_risk_order", with_(
    "SELECT stmt_id, table_name, severity FROM sch_risk ORDER BY severity DESC, table_name, stmt_id", "sch_risk"))
def _(spark, sf):
    return sch.order_risks(_risks(spark, sf)).select("stmt_id", "table_name", "severity")


@query("sch_15_table_coverage", with_(
    "SELECT coalesce(d.table_key, u.table_key) AS table_key, coalesce(d.table_name, u.table_key) AS table_name, "
    f"coalesce(source_file, '{fv.REFERENCE_ONLY_SOURCE}') AS source_file, coalesce(sql_count, 0) AS sql_count, "
    "CASE WHEN u.table_key IS NULL THEN 'DDL_ONLY' WHEN d.table_key IS NULL THEN 'MISSING_DDL' ELSE 'REFERENCED' END "
    "AS coverage FROM ddl_table d FULL JOIN sch_usage u ON d.table_key = u.table_key", "ddl_table", "sch_usage"))
def _(spark, sf):
    cov = sch.table_coverage(sql_statements(spark, sf), sch.extract_ddl(ddl_files(spark, sf)))
    return cov.select("table_key", "table_name", "source_file", "sql_count", "coverage")


@query("sch_16_schema_summary", with_(
    f"""SELECT (SELECT count(*) FROM ddl_table) AS table_count, (SELECT count(*) FROM sch_usage) AS referenced_count,
  (SELECT count(*) FROM sch_usage WHERE table_key IN (SELECT table_key FROM ddl_table)) AS covered_count,
  (SELECT count(*) FROM sch_usage WHERE table_key NOT IN (SELECT table_key FROM ddl_table)) AS missing_count,
  (SELECT count(DISTINCT source_file) FROM ddl_table) AS ddl_file_count,
  (SELECT count(*) FROM sch_risk WHERE risk_type = 'UNINDEXED_PREDICATE') AS unindexed_count,
  true AS ddl_detected, {q(fv.WARN_PARTIAL_DDL)} AS warning""", "sch_risk"))
def _(spark, sf):
    return sch.schema_summary(sql_statements(spark, sf), sch.extract_ddl(ddl_files(spark, sf)))


# --- inference ----------------------------------------------------------------------------------------------

# number = event_id % 6: text, repaired text, cells (table.column)
DML = [
    ("SELECT a.id, b.name AS n, count(*) FROM ta{u} a JOIN tb{u} AS b ON a.bid = b.id WHERE a.status = #{s} AND kind IN ()",
     "SELECT a.id, b.name AS n, count(*) FROM ta{u} a JOIN tb{u} AS b ON a.bid = b.id WHERE a.status = 'placeholder' "
     "AND kind IN (NULL)",
     ["ta{u}.id", "tb{u}.name", "ta{u}.bid", "tb{u}.id", "ta{u}.status", "ta{u}.kind"]),
    ("INSERT INTO `tc{u}` (id, , name,)", "INSERT INTO `tc{u}` (id, name) VALUES (1, 1)", ["tc{u}.id", "tc{u}.name"]),
    ("UPDATE shop.td{u} SET , a = #{a}, b = WHERE c IS NULL AND",
     "UPDATE shop.td{u} SET a = 'placeholder', b = 1 WHERE c IS NULL AND", ["td{u}.a", "td{u}.b", "td{u}.c"]),
    ("DELETE FROM te{u} AND x LIKE 'q' -- note", "DELETE FROM te{u} WHERE x LIKE 'q'", ["te{u}.x"]),
    ("SELECT * FROM ${tbl} WHERE id = 5", "SELECT * FROM placeholder WHERE id = 5", ["placeholder.id"]),
    ("SELECT x FROM TF{u} WHERE (y = 1 OR (z > 2", "SELECT x FROM TF{u} WHERE (y = 1 OR (z > 2))",
     ["TF{u}.x", "TF{u}.y", "TF{u}.z"]),
]


def dml(spark, sf) -> DataFrame:
    ev = corpus.table(spark, sf, "events", "event_id", "user_id")
    e, u = F.col("event_id"), F.col("user_id")
    return ev.select(e.alias("stmt_id"), corpus.fill(corpus.pick(e % 6, [d[0] for d in DML]), e, u).alias("norm"))


_FIXED = ", ".join(f"({i}, {q(d[1])})" for i, d in enumerate(DML))
_CELLS = ", ".join(f"({i}, {q(c.split('.')[0])}, {q(c.split('.')[1])})" for i, d in enumerate(DML) for c in d[2])
part("dml_table", f"""SELECT lower(t) AS table_key, min(t) AS table_name, string_agg(DISTINCT col, ',' ORDER BY col) AS columns
FROM (SELECT replace(c.t, '{{u}}', user_id::VARCHAR) AS t, c.col FROM events JOIN (VALUES {_CELLS}) c(kind, t, col)
ON event_id % 6 = c.kind) GROUP BY 1""")


@query("sch_17_repair_dml",
       f"SELECT event_id AS stmt_id, replace(f.t, '{{u}}', user_id::VARCHAR) AS sql FROM events JOIN (VALUES {_FIXED}) "
       "f(kind, t) ON event_id % 6 = f.kind")
def _(spark, sf):
    return sch.repaired_dml(dml(spark, sf))


def _table_cols(t: DataFrame) -> DataFrame:
    return t.select("table_key", "table_name", J("columns").alias("columns"))


@query("sch_18_infer_tables", with_("SELECT * FROM dml_table", "dml_table"))
def _(spark, sf):
    return _table_cols(sch.infer_tables(dml(spark, sf)))


# number = event_id % 5: text with aliases that return in inner SELECTs, cells (table.column) by hand
SCOPED = [
    ("SELECT a.x FROM tg{u} a WHERE EXISTS (SELECT 1 FROM th{u} a WHERE a.y = 1)", ["tg{u}.x", "th{u}.y"]),
    ("SELECT a.x, k FROM tg{u} a WHERE a.z IN (SELECT a.id FROM ti{u} a JOIN tj{u} b ON a.p = b.q WHERE b.r = a.w AND m = ') FROM z') AND a.s = 2",
     ["tg{u}.x", "tg{u}.k", "tg{u}.z", "tg{u}.s", "ti{u}.id", "ti{u}.p", "ti{u}.w", "ti{u}.m", "tj{u}.q", "tj{u}.r"]),
    ("SELECT a.x FROM tg{u} a UNION ALL SELECT a.y FROM tk{u} a WHERE (a.z = 1 OR a.v > 2)", ["tg{u}.x", "tk{u}.y", "tk{u}.z", "tk{u}.v"]),
    ("UPDATE tl{u} SET a = 1 WHERE id IN (SELECT tid FROM th{u} WHERE b = 2)", ["tl{u}.a", "tl{u}.id", "th{u}.tid", "th{u}.b"]),
    ("SELECT a.x FROM tg{u} a WHERE EXISTS (SELECT 1 FROM ti{u} b WHERE b.y = a.l AND EXISTS (SELECT 1 FROM tm{u} b WHERE b.j = a.n))",
     ["tg{u}.x", "tg{u}.l", "tg{u}.n", "ti{u}.y", "tm{u}.j"]),
]


def scoped_dml(spark, sf) -> DataFrame:
    ev = corpus.table(spark, sf, "events", "event_id", "user_id")
    e, u = F.col("event_id"), F.col("user_id")
    return ev.select(e.alias("stmt_id"), corpus.fill(corpus.pick(e % 5, [d[0] for d in SCOPED]), e, u).alias("norm"))


_SCOPED_CELLS = ", ".join(f"({i}, {q(c.split('.')[0])}, {q(c.split('.')[1])})" for i, d in enumerate(SCOPED) for c in d[1])


@query("sch_18_scoped_aliases",
       f"SELECT t AS table_key, min(t) AS table_name, string_agg(DISTINCT col, ',' ORDER BY col) AS columns FROM (SELECT "
       f"replace(c.t, '{{u}}', user_id::VARCHAR) AS t, c.col FROM events JOIN (VALUES {_SCOPED_CELLS}) c(kind, t, col) "
       "ON event_id % 5 = c.kind) GROUP BY 1")
def _(spark, sf):
    return _table_cols(sch.infer_tables(scoped_dml(spark, sf)))


@query("sch_20_resolve_schema", with_(
    f"SELECT table_key, table_name, {_split('cols')} AS columns, 'with ddl' AS case_name FROM ddl_table UNION ALL "
    "SELECT table_key, table_name, columns, 'no ddl' FROM dml_table", "ddl_table", "dml_table"))
def _(spark, sf):
    ddl = sch.extract_ddl(ddl_files(spark, sf))
    without = sch.extract_ddl(ddl_files(spark, sf).withColumn("content", F.lit("-- nothing here")))
    inferred = materialized(sch.infer_tables(dml(spark, sf)))  # read by both cases
    a = _table_cols(sch.resolve_schema(ddl, inferred)).withColumn("case_name", F.lit("with ddl"))
    b = _table_cols(sch.resolve_schema(without, inferred)).withColumn("case_name", F.lit("no ddl"))
    return a.unionByName(b)
