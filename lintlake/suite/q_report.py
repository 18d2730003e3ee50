"""Queries on findings, report frames, remediation, sinks and user extensions."""

from __future__ import annotations

import uuid

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.operators import analysis as an
from lintlake.operators import dedupe as dd
from lintlake.operators import extract as ex
from lintlake.operators import remediation as rem
from lintlake.operators import report as rp
from lintlake.operators import rules as ru
from lintlake.operators import schema as sch
from lintlake.operators import scoring as sc
from lintlake.plans import nodes as pn
from lintlake.session import ensure_checkpoint_dir, materialized
from lintlake.sizing import hot_key_join
from lintlake.sources.store import ResultStore
from lintlake.suite import corpus
from lintlake.suite import files as fl
from lintlake.suite import twin_core as tw
from lintlake.suite.q_core import prepared, scored, statements
from lintlake.suite.q_plans import plan_nodes
from lintlake.suite.q_schema import ddl_files, sql_statements
from lintlake.suite.registry import query
from lintlake.suite.twin_core import part, q, with_


def statement_nodes(spark, sf, stmts: DataFrame | None = None) -> DataFrame:
    """Plan rows of the statements that may be explained: the plan captured at the first occurrence."""
    stmts = prepared(spark, sf) if stmts is None else stmts
    first = stmts.where(F.col("eligibility") == "SUPPORTED").select(
        F.col("first_occ_id").alias("occ"), F.col("stmt_id").alias("sid"))
    nodes = plan_nodes(spark, sf).withColumnRenamed("stmt_id", "occ")
    hit = hot_key_join(nodes, first, "occ")
    return hit.withColumnRenamed("sid", "stmt_id").select(*pn.NODE_COLUMNS)


def explain_errors(stmts: DataFrame) -> DataFrame:
    s = stmts.where(F.col("first_occ_id") % 7 == 0)
    return s.select("stmt_id", F.concat(F.lit("timeout "), F.col("first_occ_id").cast("string")).alias("error_message"))


def all_findings(spark, sf, keep: bool = False) -> DataFrame:
    """Findings; the statements are computed once, and with ``keep`` the findings as well."""
    stmts = materialized(prepared(spark, sf))
    rated = sc.score_linted(ru.lint(stmts))
    found = rp.findings(rated, statement_nodes(spark, sf, stmts), explain_errors(stmts))
    return materialized(found) if keep else found


def all_locations(spark, sf) -> DataFrame:
    return dd.locations(corpus.occurrences(spark, sf))


# --- twins -----------------------------------------------------------------------------------------------

part("sissue", """SELECT p.stmt_id, n.node_no * 5 + n.k AS issue_no, n.type, n.severity, n.message, n.suggestion, n.evidence
FROM node_issue n JOIN pre p ON n.stmt_id = p.first_occ_id AND p.eligibility = 'SUPPORTED'""", "node_issue", "pre")
part("snode", """SELECT p.stmt_id, count(*) AS node_count FROM node n JOIN pre p ON n.stmt_id = p.first_occ_id
AND p.eligibility = 'SUPPORTED' GROUP BY 1""", "node", "pre")
part("all_issue", """
SELECT stmt_id, 0 AS src, issue_no AS no, type, severity, message, suggestion, evidence FROM issue UNION ALL
SELECT stmt_id, 1, issue_no, type, severity, message, suggestion, evidence FROM sissue""", "issue", "sissue")
part("all_count", """SELECT stmt_id, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS c,
  count(*) FILTER (severity = 'WARNING') AS w, count(*) FILTER (severity = 'INFO') AS i,
  count(*) FILTER (src = 1) AS n_plan FROM all_issue GROUP BY 1""", "all_issue")
part("type_list", """SELECT stmt_id, list(type ORDER BY src, no) AS rule_types FROM (
  SELECT stmt_id, type, min(src) AS src, arg_min(no, src * 1000000 + no) AS no FROM all_issue GROUP BY 1, 2) GROUP BY 1""",
     "all_issue")
part("finding", """
SELECT s.* EXCLUDE (issue_count, c0), s.c0 AS static_count, coalesce(n, 0) AS issue_count, coalesce(n_plan, 0) AS explain_count,
  coalesce(c, 0) AS c, coalesce(w, 0) AS w, coalesce(i, 0) AS i, coalesce(rule_types, []) AS rule_types,
  CASE WHEN first_occ_id % 7 = 0 THEN 'timeout ' || first_occ_id END AS explain_error,
  node_count IS NOT NULL AND first_occ_id % 7 <> 0 AS explain_executed, node_count
FROM (SELECT *, issue_count AS c0 FROM scored) s LEFT JOIN all_count USING (stmt_id) LEFT JOIN type_list USING (stmt_id)
LEFT JOIN snode USING (stmt_id)""", "scored", "all_count", "type_list", "snode")

_SEVR = "CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END"
_ORDER = f"{_SEVR} DESC, issue_count DESC, score ASC, stmt_id ASC"


def has(*types: str) -> str:
    return "list_has_any(rule_types, [" + tw.words(types) + "])"


def pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE floor({a} * 100.0::DOUBLE / {b} * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE END"


J = lambda c: F.array_join(c, "|")

# --- findings --------------------------------------------------------------------------------------------------


@query("agg_05_findings", with_(
    """SELECT stmt_id, severity, category, sql_type, CAST(score AS BIGINT) AS score, static_count, explain_count, issue_count,
  location_count, array_to_string(rule_types, '|') AS rule_types, explain_executed, explain_error FROM finding""", "finding"))
def _(spark, sf):
    return all_findings(spark, sf).select(
        "stmt_id", "severity", "category", "sql_type", "score", "static_count", "explain_count", "issue_count",
        "location_count", J("rule_types").alias("rule_types"), "explain_executed", "explain_error")


_DEFAULT = tw.case_of("type", fv.RECOMMENDATION_OF_TYPE, q(fv.RECOMMENDATION_OF_TYPE["UNKNOWN"]))
part("advised", f"SELECT * REPLACE (coalesce(suggestion, {_DEFAULT}) AS suggestion) FROM all_issue", "all_issue")


@query("agg_05_recommendations", with_(
    """SELECT stmt_id, suggestion, min(src) AS source_no, arg_min(no, src * 1000000 + no) AS issue_no FROM advised GROUP BY 1, 2""",
    "advised"))
def _(spark, sf):
    st = materialized(prepared(spark, sf))
    static = ru.evaluate(st, profile="scan")
    return rp.recommendations(rp.report_issues(static, pn.plan_issues(statement_nodes(spark, sf, st))))


@query("agg_06_finding_rank", with_(
    f"SELECT stmt_id, row_number() OVER (ORDER BY {_ORDER}) AS finding_rank FROM finding", "finding"))
def _(spark, sf):
    return rp.rank_findings(all_findings(spark, sf, keep=True)).select("stmt_id", "finding_rank")


_SUMMARY = f"""
SELECT (SELECT count(*) FROM events) AS total_files, CAST(sum(location_count) AS BIGINT) AS total_sql, count(*) AS unique_sql,
  count(*) FILTER (issue_count > 0) AS issue_sql, count(*) FILTER (issue_count = 0) AS clean_sql,
  CAST(sum(issue_count) AS BIGINT) AS total_issues, CAST(sum(c) AS BIGINT) AS critical_issues,
  CAST(sum(w) AS BIGINT) AS warning_issues, CAST(sum(i) AS BIGINT) AS info_issues,
  {pct("count(validity)", "count(*)")} AS parse_rate, {pct("count(*) FILTER (validity = 'VALID')", "count(*)")} AS valid_rate,
  {pct("count(*) FILTER (eligibility = 'SUPPORTED' AND explain_executed)", "count(*) FILTER (eligibility = 'SUPPORTED')")}
    AS explain_coverage,
  CAST(CASE WHEN sum(c) >= 20 THEN least(floor(avg(score) + 0.5), 59) WHEN sum(c) >= 5 THEN least(floor(avg(score) + 0.5), 69)
    WHEN sum(c) > 0 THEN least(floor(avg(score) + 0.5), 79) WHEN sum(w) >= 10 THEN least(floor(avg(score) + 0.5), 84)
    WHEN sum(w) > 0 THEN least(floor(avg(score) + 0.5), 89) ELSE floor(avg(score) + 0.5) END AS BIGINT) AS score,
  CASE WHEN sum(c) > 0 THEN 'CRITICAL' WHEN sum(w) > 0 THEN 'WARNING' WHEN sum(issue_count) > 0 THEN 'INFO' ELSE 'HEALTHY' END
    AS risk_level FROM finding"""
part("summary", _SUMMARY, "finding")


def summary(spark, sf, found: DataFrame | None = None) -> DataFrame:
    files = corpus.table(spark, sf, "events").agg(F.count(F.lit(1)).alias("total_files"))
    return rp.report_summary(found if found is not None else all_findings(spark, sf), files)


@query("agg_07_report_counts", with_(
    "SELECT total_files, total_sql, unique_sql, issue_sql, clean_sql, total_issues, critical_issues, warning_issues, "
    "info_issues FROM summary", "summary"))
def _(spark, sf):
    return summary(spark, sf).select(
        "total_files", "total_sql", "unique_sql", "issue_sql", "clean_sql", "total_issues", "critical_issues",
        "warning_issues", "info_issues")


@query("agg_08_coverage", with_("SELECT parse_rate, valid_rate, explain_coverage FROM summary", "summary"))
def _(spark, sf):
    return summary(spark, sf).select("parse_rate", "valid_rate", "explain_coverage")


# score and level of every user's files as a project of its own
@query("agg_09_risk_score", with_(
    """SELECT user_no, CAST(CASE WHEN c >= 20 THEN least(m, 59) WHEN c >= 5 THEN least(m, 69) WHEN c > 0 THEN least(m, 79)
     WHEN w >= 10 THEN least(m, 84) WHEN w > 0 THEN least(m, 89) ELSE m END AS BIGINT) AS score FROM (
   SELECT first_file AS user_no, floor(avg(score) + 0.5) AS m, sum(critical_count) AS c, sum(warning_count) AS w
   FROM scored GROUP BY 1)""", "scored"))
def _(spark, sf):
    per = scored(spark, sf).groupBy(F.col("first_file").alias("user_no")).agg(
        F.avg("score").alias("m"), F.sum("critical_count").alias("c"), F.sum("warning_count").alias("w"))
    return per.select("user_no", rp.risk_score(F.col("m"), F.col("c"), F.col("w")).alias("score"))


@query("agg_10_risk_level", with_(
    """SELECT first_file AS file_name, CASE WHEN sum(critical_count) > 0 THEN 'CRITICAL' WHEN sum(warning_count) > 0 THEN 'WARNING'
   WHEN sum(issue_count) > 0 THEN 'INFO' ELSE 'HEALTHY' END AS risk_level FROM scored GROUP BY 1""", "scored"))
def _(spark, sf):
    per = scored(spark, sf).groupBy(F.col("first_file").alias("file_name")).agg(
        F.sum("critical_count").alias("c"), F.sum("warning_count").alias("w"), F.sum("issue_count").alias("n"))
    return per.select("file_name", rp.risk_level(F.col("c"), F.col("w"), F.col("n")).alias("risk_level"))


def _top(counts: str, total: str, n: int = 8) -> str:
    return (f"SELECT label, cnt, floor(cnt * 100.0::DOUBLE / greatest({total}, 1) * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS ratio "
            f"FROM (SELECT *, {'max(cnt) OVER ()' if total == 'top_cnt' else 'sum(cnt) OVER ()'} AS {total} FROM ({counts})) "
            f"ORDER BY cnt DESC, label LIMIT {n}")


@query("agg_11_hotspots_by_file", with_(
    _top("SELECT f.path AS label, CAST(sum(issue_count) AS BIGINT) AS cnt FROM fp f JOIN scored USING (stmt_key) "
         "WHERE issue_count > 0 GROUP BY 1", "top_cnt"), "scored", "fp"))
def _(spark, sf):
    return rp.hotspots_by_file(scored(spark, sf), all_locations(spark, sf))


@query("agg_12_hotspots_by_rule", with_(
    _top("SELECT type AS label, count(*) AS cnt FROM all_issue GROUP BY 1", "total"), "all_issue"))
def _(spark, sf):
    return rp.hotspots_by_rule(all_findings(spark, sf))


@query("agg_13_hotspots_by_severity", with_(
    "SELECT s.label, count(a.severity) AS cnt, floor(count(a.severity) * 100.0::DOUBLE / "
    "greatest((SELECT count(*) FROM all_issue), 1) * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS ratio FROM (VALUES ('CRITICAL'), "
    "('WARNING'), ('INFO')) s(label) LEFT JOIN all_issue a ON a.severity = s.label GROUP BY 1", "all_issue"))
def _(spark, sf):
    return rp.hotspots_by_severity(all_findings(spark, sf))


# --- insights ---------------------------------------------------------------------------------------------------

_HOLES = " OR ".join(
    rf"contains(upper(regexp_replace({c}, '\s+', ' ', 'g')), {q(g)})" for c in ("original_sql", "norm") for g in fv.TEMPLATE_GAPS)
_T = [q(t) for t in fv.PARSE_FAILURE_TITLES]
_TITLE = (f"CASE WHEN contains(original_sql, '${{') OR contains(norm, '${{') OR contains(coalesce(reason, ''), '${{}}') THEN {_T[0]} "
          f"WHEN {_HOLES} THEN {_T[1]} WHEN starts_with(category, 'MYBATIS') THEN {_T[2]} ELSE {_T[3]} END")
_RANK = f"CASE {_TITLE} WHEN {_T[0]} THEN 0 WHEN {_T[1]} THEN 1 WHEN {_T[2]} THEN 2 ELSE 3 END"
_SKIP = (f"coalesce(nullif(trim(reason), ''), CASE eligibility WHEN 'SKIPPED' THEN {q(fv.SKIP_REASON_SKIPPED)} "
         f"WHEN 'NOT_SUPPORTED' THEN {q(fv.SKIP_REASON_NOT_SUPPORTED)} ELSE eligibility END)")
_WHY = f"coalesce(nullif(trim(reason), ''), {q(fv.REASON_UNPARSED)})"
_KINDS = {
    "duplicate_sql": ("location_count > 1", "'重复 SQL 出现在 ' || location_count || ' 处'", "location_count", "abstract_sql", "0"),
    "parse_failure": ("validity = 'INVALID'", _TITLE, "1", _WHY, _RANK),
    "skipped_explain": ("issue_count > 0 AND eligibility <> 'SUPPORTED'", "'EXPLAIN 未执行'", "1", _SKIP, "0"),
    "dangerous_dml": ("sql_type IN ('UPDATE', 'DELETE') AND (NOT contains(upper(norm), ' WHERE ') OR "
                      + has("SELECT_WITHOUT_WHERE") + ")", "'危险 DML'", "1", q(fv.EVIDENCE_DML), "0"),
    "potential_injection": (has("SQL_INJECTION_RISK", "DYNAMIC_SQL") + " OR contains(original_sql, '${')", "'潜在注入'", "1",
                            q(fv.EVIDENCE_INJECTION), "0"),
    "full_scan": (has("FULL_TABLE_SCAN", "NO_INDEX", "MISSING_INDEX"), "'全表扫描 / 无索引'", "1", q(fv.EVIDENCE_FULL_SCAN), "0"),
}


def _insight(key: str, kind: str):
    test, title, count, evidence, rank = _KINDS[kind]

    @query(key, with_(
        f"""SELECT stmt_id, {title} AS title, CAST({count} AS BIGINT) AS cnt, severity, {evidence} AS evidence,
  first_path || ':' || first_line AS place FROM finding WHERE {test}
  ORDER BY {'' if rank == '0' else rank + ', '}first_path, first_line, stmt_id LIMIT 6""", "finding"))
    def _(spark, sf):
        top = rp.insights(all_findings(spark, sf)).where(F.col("kind") == kind)
        return top.select("stmt_id", "title", "cnt", "severity", "evidence", "place")


_insight("agg_14_duplicate_sql", "duplicate_sql")
_insight("agg_15_parse_failures", "parse_failure")
_insight("agg_16_skipped_explain", "skipped_explain")
_insight("agg_17_dangerous_dml", "dangerous_dml")
_insight("agg_18_potential_injection", "potential_injection")
_insight("agg_19_full_scan", "full_scan")

_DYN = has("SQL_INJECTION_RISK", "DYNAMIC_SQL") + " OR contains(original_sql, '${') OR contains(norm, '${')"
_REVIEW = (f"CASE WHEN validity = 'INVALID' THEN {_TITLE} || ' - ' || {_WHY} WHEN validity = 'UNKNOWN' THEN '解析状态未知 - ' || "
           f"coalesce(nullif(trim(reason), ''), {q(fv.REVIEW_UNKNOWN)}) WHEN explain_error IS NOT NULL THEN 'EXPLAIN 失败 - ' || "
           f"explain_error WHEN {_DYN} THEN {q(fv.REVIEW_DYNAMIC)} END")
_AT = "stmt_id || '@' || first_path || ':' || first_line || ': '"
part("diagnostic", f"""
SELECT 'parse_failure' AS kind, stmt_id, {_RANK} AS rank, {_AT} || {_TITLE} || ' - ' || {_WHY} AS text FROM finding
WHERE validity = 'INVALID'
UNION ALL SELECT 'skipped_explain', stmt_id, 0, {_AT} || {_SKIP} FROM finding WHERE eligibility <> 'SUPPORTED'
UNION ALL SELECT 'manual_review', stmt_id, 0, {_AT} || ({_REVIEW}) FROM finding WHERE ({_REVIEW}) IS NOT NULL
UNION ALL SELECT 'explain_failure', stmt_id, 0, {_AT} || explain_error FROM finding WHERE explain_error IS NOT NULL""", "finding")


@query("agg_20_diagnostics", with_("SELECT kind, stmt_id, CAST(rank AS INTEGER) AS rank, text FROM diagnostic", "diagnostic"))
def _(spark, sf):
    return rp.diagnostics(all_findings(spark, sf))


_LBL = tw.LABEL("code")
_DIMS = " UNION ALL ".join(
    [f"SELECT '{d}' AS dimension, {d} AS code FROM finding" for d in ("category", "validity", "eligibility", "source_type")]
    + ["SELECT 'static_issue', type FROM issue", "SELECT 'explain_issue', type FROM sissue"])


@query("agg_21_dimension_stats", with_(
    f"""SELECT dimension, label, cnt, ratio FROM (SELECT *, cnt * 100.0::DOUBLE / sum(cnt) OVER (PARTITION BY dimension) AS ratio,
  row_number() OVER (PARTITION BY dimension ORDER BY cnt DESC, label) AS rn FROM (
  SELECT dimension, {_LBL} AS label, count(*) AS cnt FROM ({_DIMS}) GROUP BY 1, 2)) WHERE rn <= 8""", "finding"))
def _(spark, sf):
    return rp.dimension_stats(all_findings(spark, sf))


@query("agg_21_legacy_summary", with_(
    """SELECT CAST(sum(location_count) AS BIGINT) AS total_sql, count(*) AS parsed_sql,
  count(*) FILTER (severity = 'CRITICAL') AS critical_sql, count(*) FILTER (severity = 'WARNING') AS warning_sql,
  count(*) FILTER (severity = 'INFO') AS info_sql, avg(score) AS average_score,
  count(*) FILTER (eligibility = 'SUPPORTED') AS explain_eligible,
  count(*) FILTER (eligibility = 'SUPPORTED' AND node_count IS NOT NULL) AS explain_executed,
  count(*) * 100.0::DOUBLE / sum(location_count) AS parse_rate,
  count(*) FILTER (eligibility = 'SUPPORTED' AND node_count IS NOT NULL) * 100.0::DOUBLE
    / count(*) FILTER (eligibility = 'SUPPORTED') AS explain_coverage FROM finding""", "finding"))
def _(spark, sf):
    return rp.legacy_summary(all_findings(spark, sf))


@query("agg_22_default_recommendation", with_(
    f"""SELECT stmt_id, type, {_DEFAULT} AS by_type, CASE WHEN contains(message, '全表扫描') THEN {q(fv.RECOMMEND_FULL_SCAN)}
  WHEN contains(message, '索引') THEN {q(fv.RECOMMEND_INDEX)} ELSE {q(fv.RECOMMEND_OTHER)} END AS by_message FROM all_issue""",
    "all_issue"))
def _(spark, sf):
    st = materialized(prepared(spark, sf))
    static = ru.evaluate(st, profile="scan").select("stmt_id", "type", "message")
    rows = static.unionByName(pn.plan_issues(statement_nodes(spark, sf, st)).select("stmt_id", "type", "message"))
    none = F.lit(None).cast("string")
    return rows.select(
        "stmt_id", "type", rp.default_recommendation(F.col("type"), F.col("message")).alias("by_type"),
        rp.default_recommendation(none, F.col("message")).alias("by_message"))


@query("agg_23_issue_listing", with_(
    "SELECT severity, rule_name, count(*) AS cnt FROM issue GROUP BY 1, 2", "issue"))
def _(spark, sf):
    return rp.issue_listing(ru.evaluate(prepared(spark, sf), profile="scan"))


# --- light analyses ---------------------------------------------------------------------------------------------------

part("lite", "SELECT occ_id, upper(sql) AS u FROM occ", "occ")
_STAR, _OPEN = "contains(u, 'SELECT *')", "contains(u, 'SELECT') AND NOT contains(u, 'WHERE') AND NOT contains(u, 'LIMIT')"
_LIKE = f"regexp_matches(u, {tw.ANY_LIKE})"
_SORT = "contains(u, 'ORDER BY') AND NOT contains(u, 'LIMIT')"


def _log(spark, sf) -> DataFrame:
    return corpus.occurrences(spark, sf).select(F.col("occ_id").alias("stmt_id"), F.col("sql").alias("norm"))


@query("rul_25_quick_static", with_(
    f"""SELECT occ_id AS stmt_id, concat_ws('|', CASE WHEN {_STAR} THEN 'SELECT_STAR' END, CASE WHEN {_OPEN} THEN
  'SELECT_WITHOUT_WHERE' END, CASE WHEN {_LIKE} THEN 'LIKE_LEADING_WILDCARD' END) AS types,
  CAST(100 - CASE WHEN {_STAR} THEN 10 ELSE 0 END - CASE WHEN {_OPEN} THEN 20 ELSE 0 END - CASE WHEN {_LIKE} THEN 30 ELSE 0 END
  AS INTEGER) AS score, CASE WHEN {_LIKE} THEN 'CRITICAL' WHEN ({_STAR}) OR ({_OPEN}) THEN 'WARNING' ELSE 'INFO' END AS severity,
  regexp_matches(u, '^(SELECT|INSERT|UPDATE|DELETE)') AS valid_syntax FROM lite""", "lite"))
def _(spark, sf):
    return an.quick_static(_log(spark, sf)).select(
        "stmt_id", F.array_join(F.transform("issues", lambda i: i["type"]), "|").alias("types"), "score", "severity",
        "valid_syntax")


@query("rul_26_expert_advice", with_(
    f"""SELECT occ_id AS stmt_id, concat_ws('|', CASE WHEN {_STAR} THEN 'COLUMN_SPECIFICATION' END, CASE WHEN {_SORT} THEN
  'PAGINATION' END) AS types, CAST(100 - CASE WHEN {_STAR} THEN 15 ELSE 0 END - CASE WHEN {_SORT} THEN 10 ELSE 0 END AS INTEGER)
  AS score, 'INFO' AS severity FROM lite""", "lite"))
def _(spark, sf):
    return an.expert_advice(_log(spark, sf)).select(
        "stmt_id", F.array_join(F.transform("advice", lambda a: a["type"]), "|").alias("types"), "score", "severity")


@query("rul_27_expert_context", with_(
    """SELECT p.stmt_id, coalesce(a.n - a.n_plan, 0) AS static_issues, coalesce(a.n_plan, 0) AS explain_issues,
  CAST(100 - CASE WHEN coalesce(a.n - a.n_plan, 0) > 0 THEN 20 ELSE 0 END - CASE WHEN coalesce(a.n_plan, 0) > 0 THEN 30 ELSE 0 END
  AS INTEGER) AS score, CASE WHEN coalesce(a.n - a.n_plan, 0) > 0 AND coalesce(a.n_plan, 0) > 0 THEN 'CRITICAL'
  WHEN coalesce(a.n_plan, 0) > 0 THEN 'WARNING' ELSE 'INFO' END AS severity FROM pre p LEFT JOIN all_count a USING (stmt_id)""",
    "all_count"))
def _(spark, sf):
    st = materialized(prepared(spark, sf))
    return an.expert_context(st, ru.evaluate(st, profile="scan"), pn.plan_issues(statement_nodes(spark, sf, st)))


@query("agg_25_high_priority_advice", with_(
    f"SELECT occ_id AS stmt_id, 'COLUMN_SPECIFICATION' AS type, 4 AS priority FROM lite WHERE {_STAR}", "lite"))
def _(spark, sf):
    return an.high_priority(an.expert_advice(_log(spark, sf))).select("stmt_id", "type", "priority")


# --- remediation ------------------------------------------------------------------------------------------------------------

_RULE_RANK = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fv.RULE_RANK.items()) + " ELSE 100 END"
part("primary_issue", f"""SELECT stmt_id, type AS primary_rule, message AS evidence FROM (SELECT *, row_number() OVER (
  PARTITION BY stmt_id ORDER BY {_RULE_RANK}, src, no, message) AS rn FROM all_issue) WHERE rn = 1""", "all_issue")


def pin(*rules: str) -> str:
    return f"primary_rule IN ({tw.words(rules)})"


_P, _R, _D, _S = fv.PERFORMANCE_RULES, fv.REVIEW_RULES, fv.DYNAMIC_RULES, fv.SAFETY_RULES
part("task", f"""
SELECT *, CASE WHEN theme = 'SAFETY' AND {has(*_D)} THEN 'p0-dynamic-sql-safety' WHEN theme = 'PERFORMANCE' THEN
   'p1-unbounded-query-containment' WHEN theme = 'MAINTAINABILITY' AND {has(*_R)} THEN 'p2-template-review' END AS campaign_id
FROM (SELECT f.*, primary_rule, evidence,
  CASE WHEN {has(*_S)} OR severity = 'CRITICAL' THEN 'P0' WHEN {has(*_P)} THEN 'P1' ELSE 'P2' END AS priority,
  CASE WHEN {has(*_S)} THEN 'SAFETY' WHEN {has(*_P)} THEN 'PERFORMANCE' WHEN {has(*_R)} THEN 'MAINTAINABILITY'
       ELSE 'CORRECTNESS' END AS theme,
  CASE WHEN explain_executed THEN 'CONFIRMED' WHEN {pin(*_R, *_D)} THEN 'NEEDS_REVIEW' ELSE 'LIKELY' END AS confidence,
  CASE WHEN {pin('SQL_INJECTION_RISK')} THEN 'dynamic-value-binding'
    WHEN {pin('DYNAMIC_SQL')} THEN CASE WHEN contains(upper(original_sql), 'ORDER BY') AND contains(original_sql, '${{')
         THEN 'dynamic-order-by-whitelist' ELSE 'dynamic-value-binding' END
    WHEN {pin(*_P)} THEN 'unbounded-query-containment' WHEN {pin('SELECT_STAR')} THEN 'select-star-field-list'
    WHEN {pin(*fv.DML_RULES)} THEN 'dangerous-dml-guardrail' WHEN {pin(*_R)} THEN 'template-review-normalization'
    ELSE 'general-rule-remediation' END AS repair_recipe_id
  FROM finding f JOIN primary_issue USING (stmt_id) WHERE issue_count > 0)""", "finding", "primary_issue")


def all_tasks(spark, sf) -> DataFrame:
    return rem.tasks(all_findings(spark, sf))


def _task_query(key: str, *cols: str, **sql: str):
    select = ", ".join([*cols, *[f"{v} AS {k}" for k, v in sql.items()]])

    @query(key, with_(f"SELECT stmt_id, {select} FROM task", "task"))
    def _(spark, sf):
        return all_tasks(spark, sf).select("stmt_id", *cols, *sql)


_task_query("rem_01_primary_issue", "primary_rule", "evidence")
_task_query("rem_03_priority", "priority")
_task_query("rem_04_theme", "theme")
_task_query("rem_05_confidence", "confidence")
_task_query("rem_06_campaign_id", "campaign_id")
_task_query("rem_07_recipe_id", "repair_recipe_id")


@query("rem_02_rule_types", with_("SELECT stmt_id, array_to_string(rule_types, '|') AS rule_types FROM task", "task"))
def _(spark, sf):
    return all_tasks(spark, sf).select("stmt_id", J("rule_types").alias("rule_types"))


_I, _N = fv.TASK_IMPACT, fv.TASK_RECOMMENDATION


@query("rem_08_tasks", with_(
    f"""SELECT stmt_id || '-remediation-' || lower(primary_rule) AS task_id, first_file || ':' || first_line || ' · ' || primary_rule
  AS title, priority, severity, theme, confidence, campaign_id, repair_recipe_id, evidence,
  CASE WHEN priority = 'P0' AND theme = 'SAFETY' THEN {q(_I['P0_SAFETY'])} WHEN theme = 'PERFORMANCE' THEN {q(_I['PERFORMANCE'])}
    WHEN theme = 'MAINTAINABILITY' THEN {q(_I['MAINTAINABILITY'])} ELSE {q(_I['OTHER'])} END AS impact,
  CASE WHEN {pin(*_D)} THEN {q(_N['DYNAMIC'])} WHEN {pin(*_P)} THEN {q(_N['PERFORMANCE'])} WHEN {pin('SELECT_STAR')} THEN
    {q(_N['SELECT_STAR'])} WHEN {pin(*fv.DML_RULES)} THEN {q(_N['DML'])} WHEN {pin(*_R)} THEN {q(_N['REVIEW'])}
    ELSE {q(_N['OTHER'])} END AS recommendation,
  CASE priority WHEN 'P0' THEN '完成 P0 修复后重新扫描，确认 ' || primary_rule || ' 不再出现。'
    WHEN 'P1' THEN '重新扫描并补充 EXPLAIN 证据，确认 ' || primary_rule || ' 风险下降。'
    ELSE '重新扫描并确认 ' || primary_rule || ' 已修复或完成人工复核记录。' END AS acceptance_check FROM task""", "task"))
def _(spark, sf):
    return all_tasks(spark, sf).select(
        "task_id", "title", "priority", "severity", "theme", "confidence", "campaign_id", "repair_recipe_id", "evidence",
        "impact", "recommendation", "acceptance_check")


_RECIPE = ", ".join(f"({q(r[0])}, {q(r[1])}, {q(r[6])}, {q('|'.join(r[5]))})" for r in fv.RECIPES)


@query("rem_09_task_recipes", with_(
    f"SELECT stmt_id, r.id AS repair_recipe_id, r.title AS recipe_title, r.verification, r.steps FROM task JOIN "
    f"(VALUES {_RECIPE}) r(id, title, verification, steps) ON repair_recipe_id = r.id", "task"))
def _(spark, sf):
    return rem.tasks_with_recipes(all_tasks(spark, sf)).select(
        "stmt_id", "repair_recipe_id", "recipe_title", "verification", J("steps").alias("steps"))


_CAMP = ", ".join(f"({q(c[0])}, {q(c[1])}, {q(c[3])}, [{tw.words(c[6])}])" for c in fv.CAMPAIGNS)
part("member", f"""SELECT c.id AS campaign_id, c.pr AS priority, c.title, f.stmt_id, f.stmt_key, severity, issue_count, score,
  row_number() OVER (PARTITION BY c.id ORDER BY {_ORDER}) AS rn
  FROM finding f JOIN (VALUES {_CAMP}) c(id, pr, title, rules) ON list_has_any(f.rule_types, c.rules)""", "finding")
part("member_file", """SELECT campaign_id, path, row_number() OVER (PARTITION BY campaign_id ORDER BY rn, path) AS file_no FROM (
  SELECT campaign_id, path, min(rn) AS rn FROM member JOIN fp USING (stmt_key) GROUP BY 1, 2)""", "member", "fp")


@query("rem_10_campaigns", with_(
    """SELECT campaign_id, min(priority) AS priority, min(title) AS title, count(*) AS sql_count,
  string_agg(stmt_id, '|' ORDER BY rn) FILTER (rn <= 5) AS examples,
  (SELECT string_agg(path, '|' ORDER BY file_no) FROM member_file f WHERE f.campaign_id = m.campaign_id AND file_no <= 6) AS files,
  (SELECT CAST(count(*) AS INTEGER) FROM member_file f WHERE f.campaign_id = m.campaign_id AND file_no <= 6) AS file_count
  FROM member m GROUP BY 1""", "member", "member_file"))
def _(spark, sf):
    return rem.campaigns(all_findings(spark, sf, keep=True), all_locations(spark, sf)).select(
        "campaign_id", "priority", "title", "sql_count", J("examples").alias("examples"), J("files").alias("files"),
        "file_count")


@query("rem_10_campaign_findings", with_("SELECT campaign_id, stmt_id FROM member", "member"))
def _(spark, sf):
    return rem.campaign_findings(all_findings(spark, sf)).select("campaign_id", "stmt_id")


@query("rem_11_remediation_summary", with_(
    f"""SELECT (SELECT count(DISTINCT campaign_id) FROM member) AS campaign_count, count(*) AS task_count,
  count(*) FILTER (confidence = 'CONFIRMED') AS confirmed_count, count(*) FILTER (confidence = 'LIKELY') AS likely_count,
  count(*) FILTER (confidence = 'NEEDS_REVIEW') AS review_count,
  CASE WHEN count(*) = 0 THEN {q(fv.FIRST_PASS_FOCUS['NONE'])} WHEN count(*) FILTER (priority = 'P0') > 0 THEN
   {q(fv.FIRST_PASS_FOCUS['P0'])} WHEN count(*) FILTER (priority = 'P1') > 0 THEN {q(fv.FIRST_PASS_FOCUS['P1'])}
   ELSE {q(fv.FIRST_PASS_FOCUS['P2'])} END AS first_pass_focus FROM task""", "task", "member"))
def _(spark, sf):
    found = all_findings(spark, sf, keep=True)
    in_use = rem.campaign_findings(found).select("campaign_id").distinct()
    return rem.remediation_summary(rem.tasks(found), in_use)


@query("rem_12_tasks_by_priority", with_("SELECT priority, count(*) AS cnt FROM task GROUP BY 1", "task"))
def _(spark, sf):
    return rem.tasks_by_priority(all_tasks(spark, sf))


def _schema_row(spark, sf) -> DataFrame:
    return sch.schema_summary(sql_statements(spark, sf), sch.extract_ddl(ddl_files(spark, sf)))


_N_OF = lambda k: f"(SELECT count(*) FROM diagnostic WHERE kind = '{k}')"


@query("rem_13_executive_summary", with_(
    f"""SELECT 'corpus 当前 SQL 风险等级为 ' || risk_level || '，共发现 ' || total_issues || ' 个问题，建议按修复战役推进。' AS risk_conclusion,
  (SELECT string_agg(type || ' × ' || n, '|' ORDER BY n DESC, type) FROM (SELECT type, count(*) AS n FROM all_issue GROUP BY 1
     ORDER BY n DESC, type LIMIT 3)) AS top_drivers,
  concat_ws('|', CASE WHEN EXISTS (SELECT 1 FROM all_issue WHERE type = 'SQL_INJECTION_RISK') THEN {q(fv.ACTION_DYNAMIC)} END,
    CASE WHEN EXISTS (SELECT 1 FROM all_issue WHERE type IN ('SELECT_WITHOUT_WHERE', 'ORDER_BY_WITHOUT_LIMIT')) THEN
    {q(fv.ACTION_UNBOUNDED)} END, {q(fv.ACTION_SCHEMA)}) AS recommended_actions,
  '证据可信度: NEEDS_REVIEW · 人工复核 ' || {_N_OF('manual_review')} || ' · EXPLAIN 未执行 ' || {_N_OF('skipped_explain')}
    AS confidence_summary FROM summary""", "summary", "all_issue", "diagnostic"))
def _(spark, sf):
    found = all_findings(spark, sf, keep=True)
    # one row each, used by several parts of the result: computed once
    counts = materialized(rem.review_counts(found, rp.diagnostics(found)))
    one, schema = materialized(summary(spark, sf, found)), materialized(_schema_row(spark, sf))
    trust = rem.confidence(one, counts, schema)
    return rem.executive_summary(found, one, counts, trust, "corpus", schema).select(
        "risk_conclusion", J("top_drivers").alias("top_drivers"), J("recommended_actions").alias("recommended_actions"),
        "confidence_summary")


@query("rem_14_confidence", with_(
    f"""SELECT 'NEEDS_REVIEW' AS level, concat_ws('|', 'Static AST rules', CASE WHEN explain_coverage > 0 THEN 'EXPLAIN evidence' END,
  'DDL schema association') AS sources, concat_ws('|', CASE WHEN {_N_OF('skipped_explain')} > 0 THEN {q(fv.LIMIT_EXPLAIN)} END,
  CASE WHEN {_N_OF('manual_review')} > 0 THEN {q(fv.LIMIT_REVIEW)} END, CASE WHEN {_N_OF('parse_failure')} > 0 THEN
  {q(fv.LIMIT_PARSE)} END, {q(fv.LIMIT_SCHEMA)}) AS limitations FROM summary""", "summary", "diagnostic"))
def _(spark, sf):
    found = all_findings(spark, sf, keep=True)
    counts = rem.review_counts(found, rp.diagnostics(found))
    return rem.confidence(summary(spark, sf, found), counts, _schema_row(spark, sf)).select(
        "level", J("sources").alias("sources"), J("limitations").alias("limitations"))


# --- sinks and extensions ----------------------------------------------------------------------------------------------------


def report_sections(spark, sf) -> dict[str, DataFrame]:
    found = all_findings(spark, sf, keep=True)
    loc = materialized(all_locations(spark, sf).select("stmt_key", "path", "line"))  # for files and for campaigns
    task_rows = rem.tasks(found)
    one, schema = materialized(summary(spark, sf, found)), materialized(_schema_row(spark, sf))
    counts = materialized(rem.review_counts(found, rp.diagnostics(found)))
    trust = rem.confidence(one, counts, schema)
    return {
        "metadata": rp.metadata(spark, "corpus", sf),
        "summary": one,
        "hotspots.byFile": rp.hotspots_by_file(found, loc),
        "hotspots.byRule": rp.hotspots_by_rule(found),
        "hotspots.bySeverity": rp.hotspots_by_severity(found),
        "insights": rp.insights(found),
        "schemaAnalysis": schema,
        "findings": found.select("stmt_id", "severity", "score", "issue_count", "location_count", "issues", "explain"),
        "diagnostics": rp.diagnostics(found),
        "executiveSummary": rem.executive_summary(found, one, counts, trust, "corpus", schema),
        "campaigns": rem.campaigns(found, loc),
        "confidence": trust,
        "remediation.summary": rem.remediation_summary(task_rows, rem.campaign_findings(found).select("campaign_id").distinct()),
        "remediation.tasks": task_rows,
        "remediation.recipes": rem.recipes(spark),
    }


@query("out_01_report_json", with_(
    """SELECT stmt_id, '{"stmt_id":"' || stmt_id || '","severity":"' || severity || '","score":' || score || ',"issue_count":' ||
  issue_count || ',"location_count":' || location_count || '}' AS json, 'findings' AS section FROM finding""", "finding"))
def _(spark, sf):
    found = all_findings(spark, sf).select("stmt_id", "severity", "score", "issue_count", "location_count")
    rows = rp.report_json({"findings": found})
    return rows.select(F.get_json_object("json", "$.stmt_id").alias("stmt_id"), "json", "section")


_KIND_ROWS = " + ".join(f"(SELECT least(6, count(*)) FROM finding WHERE {k[0]})" for k in _KINDS.values())


@query("out_01_report_sections", with_(
    f"""SELECT * FROM (VALUES ('metadata', '', 1), ('summary', '', 1), ('schemaAnalysis', '', 1), ('executiveSummary', '', 1),
  ('confidence', '', 1), ('hotspots', 'bySeverity', 3), ('hotspots', 'byFile', 8), ('remediation', 'summary', 1),
  ('remediation', 'recipes', 7)) v(section, part, cnt)
  UNION ALL SELECT 'hotspots', 'byRule', least(8, count(DISTINCT type)) FROM all_issue
  UNION ALL SELECT 'insights', '', {_KIND_ROWS}
  UNION ALL SELECT 'findings', '', count(*) FROM finding UNION ALL SELECT 'diagnostics', '', count(*) FROM diagnostic
  UNION ALL SELECT 'campaigns', '', count(DISTINCT campaign_id) FROM member
  UNION ALL SELECT 'remediation', 'tasks', count(*) FROM task""", "all_issue", "diagnostic", "member", "task"))
def _(spark, sf):
    rows = rp.report_json(report_sections(spark, sf))
    return rows.where(F.col("json").startswith("{")).groupBy("section", "part").agg(F.count(F.lit(1)).alias("cnt"))


@query("out_02_result_store", with_(
    "SELECT stmt_id, first_path, CASE WHEN first_occ_id % 2 = 0 THEN 'scan-b' ELSE 'scan-a' END AS scan_id FROM stmt", "stmt"))
def _(spark, sf):
    # each call writes to a folder of its own below the shared checkpoint folder
    store = ResultStore(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = statements(spark, sf).select("stmt_id", "first_path", "first_occ_id")
    store.write("statements", rows, "scan-a")
    store.write("statements", rows.where(F.col("first_occ_id") % 2 == 0), "scan-b")
    store.write("statements", rows.where(F.col("first_occ_id") % 2 != 0), "scan-a")
    return store.read("statements").select("stmt_id", "first_path", F.col("scan_id").cast("string").alias("scan_id"))


def _names_stage_table(sql: pd.Series) -> pd.Series:
    low = sql.str.lower()
    return low.str.contains("tmp_", regex=False) | low.str.contains("_stage", regex=False)


@query("udf_01_user_rule", with_(
    "SELECT stmt_id, 'uses-stage-table' AS rule_id, 'WARNING' AS severity, 'uses a stage table' AS message FROM log "
    "WHERE contains(lower(norm), 'tmp_') OR contains(lower(norm), '_stage') UNION ALL "
    "SELECT stmt_id, 'select-star', 'INFO', 'star' FROM log WHERE contains(up2, 'SELECT *')".replace(
        "FROM log WHERE contains(up2", "FROM (SELECT *, upper(norm) AS up2 FROM log) WHERE contains(up2"), "log"))
def _(spark, sf):
    from lintlake.suite.q_core import query_log

    on_stage = F.pandas_udf(_names_stage_table, "boolean")
    rules = ru.RuleSet.only("select-star")
    rules.register("uses-stage-table", "WARNING", on_stage(F.col("norm")), "uses a stage table")
    rules.register("select-star", "INFO", "contains(t_upper, 'SELECT *')", "star")  # replaces the built-in rule
    return ru.evaluate(query_log(spark, sf), rules, "rules").select("stmt_id", "rule_id", "severity", "message")


@query("udf_02_user_extractor",
       "SELECT path, line, source_type, sql FROM (" + fl.expected_sql("jpa") + ") UNION ALL "
       "SELECT path, CAST(1 AS INTEGER), 'README', 'SELECT doc FROM events WHERE event_id = ' || event_id FROM "
       f"({fl.files_sql()}) WHERE event_id % 8 = 7")
def _(spark, sf):
    # .java files read by one extractor of the user, .txt files by another one over frames
    found = fl.files(spark, sf)
    txt = found.where(F.col("path").contains("/target/")).withColumn("path", F.concat("path", F.lit(".txt")))

    def from_text(frame: DataFrame) -> DataFrame:
        n = F.regexp_extract("path", r"Gen(\d+)", 1)
        return frame.select(
            F.regexp_replace("path", r"\.txt$", "").alias("path"), F.lit("x").alias("file_name"), F.lit(1).alias("line"),
            F.lit("README").alias("source_type"), F.concat(F.lit("SELECT doc FROM events WHERE event_id = "), n).alias("sql"))

    mine = ex.Extractors()
    none = lambda c: F.array().cast(ex.CANDIDATES)
    for ext, name in (("java", "literals"), ("java", "mybatis"), ("xml", "mapper"), ("sql", "script"), ("ts", "literals")):
        mine.register(ext, name, "NONE", none)
    mine.register_frame("txt", from_text)
    return mine.extract_all(found.unionByName(txt)).select("path", "line", "source_type", "sql")
