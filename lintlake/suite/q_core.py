"""Queries on text functions, de-duplication, rules, rule configuration and scores."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text as tx
from lintlake.operators import dedupe as dd
from lintlake.operators import rules as ru
from lintlake.operators import scoring as sc
from lintlake.operators.preprocess import preprocess, select_blocks, statements_from_log
from lintlake.plans.guard import explain_guard
from lintlake.session import ensure_checkpoint_dir
from lintlake.suite import corpus
from lintlake.suite import twin_core as tw
from lintlake.suite.registry import query
from lintlake.suite.twin_core import q, with_


def statements(spark, sf) -> DataFrame:
    return dd.dedupe(corpus.occurrences(spark, sf))


def prepared(spark, sf) -> DataFrame:
    return preprocess(statements(spark, sf), explain_enabled=True)


def query_log(spark, sf) -> DataFrame:
    """Every occurrence as a statement of its own, as a batch of SQL texts comes in."""
    return corpus.occurrences(spark, sf).select(
        F.col("occ_id").alias("stmt_id"), F.col("sql").alias("original_sql"), tx.normalize(F.col("sql")).alias("norm"))


def linted(spark, sf) -> DataFrame:
    return ru.lint(prepared(spark, sf))


def scored(spark, sf) -> DataFrame:
    return sc.score_linted(linted(spark, sf))


# --- candidate text ---------------------------------------------------------------------------------


@query("ext_01_looks_like_sql", with_("SELECT occ_id, is_sql FROM judged_occ", "judged_occ"))
def _(spark, sf):
    raw = corpus.raw_occurrences(spark, sf)
    return raw.select("occ_id", tx.looks_like_sql(F.col("sql")).alias("is_sql"))


@query("ext_02_cache_key", with_("SELECT occ_id, cache_key FROM judged_occ", "judged_occ"))
def _(spark, sf):
    raw = corpus.raw_occurrences(spark, sf)
    return raw.select("occ_id", tx.is_cache_key(F.col("sql")).alias("cache_key"))


@query("src_07_statements_from_log", with_("SELECT path, file_name, line, source_type, sql, occ_id FROM occ", "occ"))
def _(spark, sf):
    log = corpus.raw_occurrences(spark, sf).withColumnRenamed("sql", "query_text")
    return statements_from_log(log, "query_text")


# --- text functions ----------------------------------------------------------------------------------

# Statements with template marks, so that every repair step has work: number = event_id % 16.
MARKED = [
    "SELECT /* INCLUDE:cols */ FROM orders WHERE o_orderkey = #{key} AND o_custkey IN #{ids}",
    "SELECT o_orderkey FROM orders /* BIND:p=1 */ WHERE o_custkey IN ( #{a} ) AND o_orderkey = {e}",
    "SELECT o_orderkey FROM orders <where> <if test=x> o_custkey = #{u,jdbcType=BIGINT} </if> </where>",
    "INSERT INTO region (r_regionkey,,, r_name) VALUES ({e}, 'r,,{u}')",
    "SELECT n_name FROM nation and n_regionkey = {u}",
    "SELECT case ? end FROM nation WHERE ? ORDER BY n_name",
    "INSERT INTO region VALUES ?",
    "UPDATE nation SET ? WHERE n_nationkey = {u} AND ?",
    "SELECT n_name FROM nation WHERE n_nationkey = {u} OR ?",
    "SELECT n_name FROM nation ORDER BY ${orderBy}",
    "SELECT \" + \"n_name FROM nation WHERE n_name = 'a' + 'b{u}'",
    "SELECT n_name,\n\t n_comment   FROM  nation WHERE n_name = \\\"x{u}\\\"",
    "SELECT p_name FROM part WHERE p_name = 'it\\'s {u}' AND p_size = 12.5 AND p_brand = \"Brand#{u}\"",
    "EXPLAIN (ANALYZE) UPDATE nation SET n_name = 'x' WHERE n_nationkey = {u}",
    "WITH x AS (SELECT {u}) DELETE FROM nation WHERE n_nationkey = {u}",
    "EXPLAIN SELECT n_name FROM nation WHERE n_nationkey = #{k}",
]


def marked(spark, sf) -> DataFrame:
    ev = corpus.table(spark, sf, "events", "event_id", "user_id", "event_type")
    e, u = F.col("event_id"), F.col("user_id")
    source = F.create_map(*[F.lit(x) for kv in corpus.SOURCE_OF_EVENT.items() for x in kv])[F.col("event_type")]
    return ev.select(
        "event_id", source.alias("source_type"), corpus.fill(corpus.pick(e % 16, MARKED), e, u).alias("sql"))


_MARKED_CASE = "CASE event_id % 16 " + " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(MARKED)) + " END"
tw.part("marked", f"SELECT event_id, {tw._SOURCE} AS source_type, {tw.filled(_MARKED_CASE)} AS sql FROM events")


def _scalar(name: str, build, twin: str, column: str):
    @query(name, with_(f"SELECT event_id, {twin} AS {column} FROM marked", "marked"))
    def _(spark, sf):
        return marked(spark, sf).select("event_id", build(F.col("sql")).alias(column))


_scalar("pre_01_sql_type", tx.sql_type, tw.sql_type_case("sql"), "sql_type")
_scalar("pre_03_normalize", tx.normalize, tw.one_space("sql"), "norm")
_scalar("pre_04_abstract_sql", tx.abstract_sql, tw.abstract("sql"), "abstract_sql")
_scalar("pre_06_fix_template", tx.fix_template, tw.fix_template("sql"), "fixed")
_scalar("pre_07_fix_concat", tx.fix_concat, tw.fix_concat("sql"), "fixed")
_scalar("pre_10_masked", tx.masked, tw.masked("sql"), "masked")


def commented(c: Column) -> Column:
    """A statement with comments before it, behind its first word and at its end; they hold quotes, keywords and other signs."""
    inside = F.regexp_replace(c, r"^(\w+)\s", "$1 -- don't \"SELECT\" * FROM /* x; UPPER(z) = 1\n")
    return F.concat(F.lit("/* it's, \"a\" -- WHERE\n * x != NULL; */"), inside, F.lit(" /**/-- OR b = 'c"))


@query("pre_10_commented", with_(f"SELECT event_id, {tw.masked('sql')} AS masked FROM marked", "marked"))
def _(spark, sf):
    return marked(spark, sf).select("event_id", tx.masked(commented(F.col("sql"))).alias("masked"))


_QUOTED = f"regexp_extract_all(sql, {tw.SINGLE_QUOTED[:-1]}|{tw.DOUBLE_QUOTED[1:]})"


@query("pre_10_tokens", with_(
    rf"""SELECT event_id, CAST(CASE WHEN regexp_matches(sql, '^\w+\s') THEN 4 ELSE 3 END AS INTEGER) AS comments,
        CAST(len({_QUOTED}) AS INTEGER) AS quotes, true AS whole FROM marked""", "marked"))
def _(spark, sf):
    text = marked(spark, sf).select("event_id", commented(F.col("sql")).alias("sql"))
    found = text.select("event_id", "sql", tx.tokens(F.col("sql")).alias("t"))

    def number(*kinds: str) -> Column:
        return F.size(F.filter("t", lambda x: x["kind"].isin(*kinds)))

    return found.select(
        "event_id", number("comment").alias("comments"), number("string", "quoted").alias("quotes"),
        (F.array_join(F.transform("t", lambda x: x["text"]), "") == F.col("sql")).alias("whole"))


@query("pre_02_category",
       with_(f"SELECT event_id, {tw.category_case('sql', 'source_type')} AS category FROM marked", "marked"))
def _(spark, sf):
    return marked(spark, sf).select("event_id", tx.sql_category(F.col("sql"), F.col("source_type")).alias("category"))


@query("pre_05_sql_hash", with_(
    f"""SELECT event_id, sha256(a) AS sql_hash, left(sha256(a), 8) AS short_hash, 'sql-' || sha256(a) AS stmt_id
        FROM (SELECT event_id, {tw.abstract('sql')} AS a FROM marked)""", "marked"))
def _(spark, sf):
    a = F.col("a")
    return marked(spark, sf).select("event_id", tx.abstract_sql(F.col("sql")).alias("a")).select(
        "event_id", tx.sql_hash(a).alias("sql_hash"), tx.short_hash(a).alias("short_hash"),
        tx.sql_id(a).alias("stmt_id"))


_CAT = tw.category_case("sql", "source_type")


@query("pre_08_apply_fixers", with_(
    f"""SELECT event_id, category, CASE WHEN ok THEN plain ELSE {tw.fixed('plain', 'category')} END AS fixed
        FROM (SELECT *, {_CAT} AS category, {tw.shape(tw.masked('sql'))} AS ok, {tw.one_space('sql')} AS plain FROM marked)""",
    "marked"))
def _(spark, sf):
    step = marked(spark, sf).select(
        "event_id", tx.sql_category(F.col("sql"), F.col("source_type")).alias("category"),
        tx.normalize(F.col("sql")).alias("plain"), tx.masked(F.col("sql")).alias("mask"))
    return step.select("event_id", "category", F.when(tx.shape_of_masked(F.col("mask")), F.col("plain")).otherwise(
        tx.apply_fixers(F.col("plain"), F.col("category"))).alias("fixed"))


@query("pre_09_validity", with_(
    f"""SELECT event_id, CASE WHEN contains(sql, '${{') THEN 'UNKNOWN' WHEN {tw.shape(tw.masked('sql'))} THEN 'VALID'
        ELSE 'INVALID' END AS validity FROM marked""", "marked"))
def _(spark, sf):
    step = marked(spark, sf).select("event_id", "sql", tx.masked(F.col("sql")).alias("mask"))
    return step.select("event_id", F.when(F.col("sql").contains("${"), "UNKNOWN").when(
        tx.shape_of_masked(F.col("mask")), "VALID").otherwise("INVALID").alias("validity"))


@query("pre_11_skeleton", with_("SELECT stmt_id, skeleton FROM txt", "txt"))
def _(spark, sf):
    return prepared(spark, sf).select("stmt_id", tx.skeleton(F.col("masked")).alias("skeleton"))


@query("pre_12_select_blocks", with_(
    "SELECT stmt_id, CAST(i - 1 AS INTEGER) AS block_no, blocks[i] AS block "
    "FROM (SELECT stmt_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM txt)", "txt"))
def _(spark, sf):
    return select_blocks(prepared(spark, sf))


@query("pre_13_preprocess", with_(
    "SELECT stmt_id, category, norm, explain_sql, validity, eligibility, reason FROM pre", "pre"))
def _(spark, sf):
    return prepared(spark, sf).select(
        "stmt_id", "category", "norm", "explain_sql", "validity", "eligibility", "reason")


@query("pre_14_label", with_(
    f"SELECT event_id, {tw.LABEL('code')} AS label FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN source_type "
    f"WHEN 1 THEN {_CAT} WHEN 2 THEN 'FULL_TABLE_SCAN' ELSE 'RULE_NO_' || user_no END AS code FROM "
    "(SELECT m.*, e.user_id AS user_no FROM marked m JOIN events e USING (event_id)))", "marked"))
def _(spark, sf):
    ev = corpus.table(spark, sf, "events", "event_id", "user_id", "event_type")
    m = marked(spark, sf).withColumn("category", tx.sql_category(F.col("sql"), F.col("source_type")))
    rows = m.join(ev.select("event_id", "user_id"), "event_id")
    n = F.col("event_id") % 4
    code = F.when(n == 0, F.col("source_type")).when(n == 1, F.col("category")).when(
        n == 2, "FULL_TABLE_SCAN").otherwise(F.concat(F.lit("RULE_NO_"), F.col("user_id").cast("string")))
    return rows.select("event_id", code.alias("code")).select("event_id", tx.label(F.col("code")).alias("label"))


_GUARD = tw.guard("sql")


@query("exp_01_explain_guard", with_(
    f"SELECT event_id, {_GUARD['explain_sql']} AS explain_sql, {_GUARD['eligibility']} AS eligibility, "
    f"{_GUARD['reason']} AS reason, {_GUARD['changed']} AS changed FROM marked", "marked"))
def _(spark, sf):
    return explain_guard(marked(spark, sf), "sql").select(
        "event_id", "explain_sql", "eligibility", "reason", "changed")


# --- de-duplication -----------------------------------------------------------------------------------------


@query("ded_01_dedupe", with_(
    "SELECT stmt_id, sql_type, original_sql, abstract_sql, source_type, first_path, first_line, location_count FROM stmt",
    "stmt"))
def _(spark, sf):
    return statements(spark, sf).select(
        "stmt_id", "sql_type", "original_sql", "abstract_sql", "source_type", "first_path", "first_line",
        "location_count")


@query("ded_01_incremental", with_(
    "SELECT stmt_id, original_sql, source_type, first_path, first_line, location_count FROM stmt", "stmt"))
def _(spark, sf):
    # Java files first, then the others, then the Java files again after a scan that was repeated
    state = dd.FingerprintState(spark, f"{ensure_checkpoint_dir(spark)}/fingerprints-{uuid.uuid4().hex}")
    occ = corpus.occurrences(spark, sf)
    java = F.col("path").endswith(".java")
    state.ingest(occ.where(java), "java").ingest(occ.where(~java), "other").ingest(occ.where(java), "java")
    return state.statements().select("stmt_id", "original_sql", "source_type", "first_path", "first_line", "location_count")


@query("ded_02_dedup_stats", with_(
    "SELECT total, uniq, total - uniq AS duplicates, floor((total - uniq) * 1000.0::DOUBLE / total + 0.5) / 10.0::DOUBLE "
    "AS duplicate_rate FROM (SELECT count(*) AS total, count(DISTINCT stmt_key) AS uniq FROM fp)", "fp"))
def _(spark, sf):
    return dd.dedup_stats(corpus.occurrences(spark, sf))


@query("ded_03_merge_locations", with_(
    "SELECT stmt_key, path, line, min(file_name) AS file_name, arg_min(source_type, file_name || source_type) AS source_type "
    "FROM fp GROUP BY stmt_key, path, line", "fp"))
def _(spark, sf):
    loc = dd.locations(corpus.occurrences(spark, sf))
    java = F.col("path").endswith(".java")
    return dd.merge_locations(loc.where(java), loc.where(~java))


@query("ded_04_scan_counts", with_(
    "SELECT count(*) AS sql_found, count(DISTINCT stmt_key) AS unique_sql FROM fp", "fp"))
def _(spark, sf):
    return dd.scan_counts(corpus.occurrences(spark, sf))


# --- one query per rule --------------------------------------------------------------------------------------

_RULE_KEYS = [
    ("rul_01_select_star", "select-star"), ("rul_02_missing_where", "missing-where"),
    ("rul_03_like_leading_wildcard", "like-leading-wildcard"), ("rul_04_orderby_without_limit", "orderby-without-limit"),
    ("rul_05_function_on_column", "function-on-indexed-column"), ("rul_06_having_without_where", "having-without-where"),
    ("rul_07_implicit_join", "implicit-join"), ("rul_08_multi_column_or", "multi-column-or"),
    ("rul_09_multi_column_in", "multi-column-in"), ("rul_10_in_subquery", "in-subquery"), ("rul_11_not_in", "not-in"),
    ("rul_12_null_comparison", "null-comparison"), ("rul_13_unnecessary_distinct", "unnecessary-distinct"),
    ("rul_14_complex_subquery", "complex-subquery"), ("rul_15_insert_without_columns", "insert-without-columns"),
    ("rul_16_delete_update_no_where", "delete-update-no-where"),
    ("rul_17_dangerous_drop_truncate", "dangerous-drop-truncate"), ("rul_18_long_sql_statement", "long-sql-statement"),
    ("rul_19_magic_numbers", "magic-numbers"),
]
_COLS = ["stmt_id", "severity", "message", "suggestion"]


def _rule_query(key: str, rule_id: str):
    @query(key, with_(f"SELECT {', '.join(_COLS)} FROM ({tw.rule_rows(rule_id, src='logtxt')})", "logtxt"))
    def _(spark, sf):
        return ru.evaluate(query_log(spark, sf), ru.RuleSet.only(rule_id), "rules").select(*_COLS)


for _key, _rid in _RULE_KEYS:
    _rule_query(_key, _rid)


def _smell_query(key: str, message: str, twin):
    test, msg, tip = twin

    @query(key, with_(f"SELECT stmt_id, 'CRITICAL' AS severity, {msg} AS message, CAST({tip} AS VARCHAR) AS suggestion "
                      f"FROM log WHERE {test}", "log"))
    def _(spark, sf):
        found = ru.evaluate(query_log(spark, sf), None, "smells")
        return found.where(F.col("message") == message).select(*_COLS)


_smell_query("rul_20_sql_injection", fv.MSG_INJECTION, tw.SMELLS["SQL_INJECTION"][0])
_smell_query("rul_21_doubled_comma", fv.MSG_DOUBLED_COMMA, tw.SMELLS["SQL_SYNTAX_ERROR"][0])
_smell_query("rul_22_from_and", fv.MSG_FROM_AND, tw.SMELLS["SQL_SYNTAX_ERROR"][1])


# Every event once as a statement that has lost a part: number = event_id % 6.
BROKEN = [
    "SELECT * FROM WHERE o_orderkey = {e}",
    "SELECT c_name FROM customer WHERE AND c_name LIKE '%{u}'",
    "SELECT * FROM customer WHERE (c_name LIKE \"%{u}\"",
    "SELECT * FROM customer WHERE c_custkey = {u}",
    "SELECT c_name, , c_custkey FROM customer WHERE c_name LIKE 'a{u}%'",
    "SELECT * FROM customer WHERE c_name LIKE '%{u}' AND",
]


def _broken(spark, sf) -> DataFrame:
    ev = corpus.table(spark, sf, "events", "event_id", "user_id")
    e, u = F.col("event_id"), F.col("user_id")
    rows = ev.select(e.alias("stmt_id"), corpus.fill(corpus.pick(e % 6, BROKEN), e, u).alias("original_sql"))
    rows = rows.withColumn("norm", tx.normalize(F.col("original_sql"))).withColumn("masked", tx.masked(F.col("norm")))
    return rows.withColumn("validity", F.when(tx.shape_of_masked(F.col("masked")), "VALID").otherwise("INVALID"))


_BROKEN_CASE = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(BROKEN)) + " END"
tw.part("broken", f"SELECT event_id, {tw.filled(_BROKEN_CASE)} AS sql FROM events")


@query("rul_23_fallback_profile", with_(" UNION ALL ".join(
    f"SELECT event_id, '{rid}' AS rule_id, {rows[0][1]} AS message FROM (SELECT event_id, sql AS original_sql, "
    f"{tw.shape(tw.masked('sql'))} AS ok FROM broken) WHERE NOT ok AND {rows[0][0]}"
    for rid, rows in tw.FALLBACK.items()), "broken"))
def _(spark, sf):
    found = ru.evaluate(_broken(spark, sf), None, "fallback")
    return found.select(F.col("stmt_id").alias("event_id"), "rule_id", "message")


@query("rul_24_basic_profile", with_(" UNION ALL ".join(
    f"SELECT stmt_id, '{rid}' AS rule_id, '{sev}' AS severity, {q(msg)} AS message FROM pre WHERE {test}"
    for rid, sev, test, msg in tw.BASIC).replace("FROM pre", "FROM log"), "log"))
def _(spark, sf):
    return ru.evaluate(query_log(spark, sf), None, "basic").select("stmt_id", "rule_id", "severity", "message")


_ISSUE_COLS = ["stmt_id", "issue_no", "rule_id", "rule_name", "type", "severity", "message", "suggestion", "evidence"]


_RULES = [rule for _, rule in _RULE_KEYS if rule != "long-sql-statement"]
_RULE_COLS = ["stmt_id", "rule_id", "rule_name", "type", "severity", "message", "suggestion"]


@query("rul_28_commented", with_(f"SELECT {', '.join(_RULE_COLS)} FROM issue WHERE rule_id IN ({tw.words(_RULES)})", "issue"))
def _(spark, sf):
    """Statements with comments have the issues of those without."""
    plain = prepared(spark, sf).select("stmt_id", "original_sql", "source_type", "first_file")
    again = preprocess(plain.withColumn("original_sql", commented(F.col("original_sql"))))
    found = ru.evaluate(again, profile="scan")
    return found.where(F.col("rule_id").isin(*_RULES)).select(*_RULE_COLS)


@query("rul_28_evaluate_all", with_(f"SELECT {', '.join(_ISSUE_COLS)} FROM issue", "issue"))
def _(spark, sf):
    return ru.evaluate(prepared(spark, sf), profile="scan").select(*_ISSUE_COLS)


@query("rul_29_issue_dedup", with_(
    "SELECT stmt_id, rule_id, message, count(*) AS cnt FROM full_issue GROUP BY ALL", "full_issue"))
def _(spark, sf):
    return ru.evaluate(prepared(spark, sf)).groupBy("stmt_id", "rule_id", "message").agg(
        F.count(F.lit(1)).alias("cnt"))


# rule ids as users write them, made from event types: click-Rule, orderby-without-limit ...
@query("rul_30_normalize_rule_id",
       "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'ORDER_BY_WITHOUT_LIMIT' WHEN event_id % 4 = 1 THEN 'UNKNOWN' "
       "WHEN event_id % 4 = 2 THEN upper(event_type) || '_NO_RULE' ELSE 'ON_' || upper(event_type) || '_' || user_id END "
       "AS rule_name FROM events")
def _(spark, sf):
    ev = corpus.table(spark, sf, "events", "event_id", "user_id", "event_type")
    n = F.col("event_id") % 4
    raw = (
        F.when(n == 0, "orderby-without-limit").when(n == 1, "  ")
        .when(n == 2, F.concat(F.col("event_type"), F.lit("-noRule")))
        .otherwise(F.concat(F.lit(" on-"), F.col("event_type"), F.lit("-"), F.col("user_id").cast("string")))
    )
    return ev.select("event_id", raw.alias("raw")).select(
        "event_id", ru.normalize_rule_id(F.col("raw")).alias("rule_name"))


@query("rul_31_issue_type", with_(
    "SELECT type, count(*) AS cnt FROM full_issue GROUP BY 1", "full_issue"))
def _(spark, sf):
    found = ru.evaluate(prepared(spark, sf)).select(
        ru.issue_type(ru.normalize_rule_id(F.col("rule_id"))).alias("type"))
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("cnt"))


@query("rul_32_active_rules", with_(
    "SELECT rule_id, severity, prio AS priority, count(*) AS cnt FROM full_issue WHERE prio > 0 "
    "AND rule_id NOT IN ('not-in', 'magic-numbers') GROUP BY ALL", "full_issue"))
def _(spark, sf):
    rules = ru.RuleSet().disable("not-in").disable("magic-numbers")
    found = ru.evaluate(prepared(spark, sf), rules, "rules").groupBy("rule_id").agg(F.count(F.lit(1)).alias("cnt"))
    live = rules.frame(spark).where(F.col("enabled") & ~F.col("deprecated")).select("rule_id", "severity", "priority")
    return found.join(F.broadcast(live), "rule_id")


# --- rule configuration -----------------------------------------------------------------------------------------

CONFIG_SCHEMA = "rule_id string, enabled boolean, severity string, exceptions array<string>, params map<string,string>"


def rule_config(spark) -> DataFrame:
    """The caller's settings: one rule off, one exception, one threshold with another severity."""
    return spark.createDataFrame([
        ("magic-numbers", False, None, [], {}),
        ("select-star", True, None, ["FROM orders"], {}),
        ("long-sql-statement", True, "WARNING", [], {"max_chars": "400"}),
        ("missing-where", True, "INFO", [], {}),
    ], CONFIG_SCHEMA)


_NO_LONG = [r[0] for r in fv.RULE_CATALOGUE if r[0] not in ("long-sql-statement",)]
_LONG400 = (
    "SELECT stmt_id, 'long-sql-statement' AS rule_id, 'WARNING' AS severity, "
    f"{q(tw.DESC['long-sql-statement'] + ' (字符数超过 400: ')} || length(norm) || ' 字符, 1 行)' AS message "
    "FROM txt WHERE length(norm) > 400"
)
_CONFIGURED = (
    "SELECT i.stmt_id, rule_id, CASE WHEN rule_id = 'missing-where' THEN 'INFO' ELSE i.severity END AS severity, message "
    "FROM full_issue i JOIN txt t USING (stmt_id) WHERE rule_id NOT IN ('magic-numbers', 'long-sql-statement') "
    "AND NOT (rule_id = 'select-star' AND contains(t.norm, 'FROM orders')) UNION ALL " + _LONG400
)
_CFG_COLS = ["stmt_id", "rule_id", "severity", "message"]


@query("cfg_01_disabled_rules", with_(
    "SELECT stmt_id, rule_id, severity, message FROM full_issue WHERE rule_id <> 'magic-numbers'", "full_issue"))
def _(spark, sf):
    from lintlake.operators.config import drop_disabled

    return drop_disabled(ru.evaluate(prepared(spark, sf)), rule_config(spark)).select(*_CFG_COLS)


@query("cfg_02_exceptions", with_(
    "SELECT i.stmt_id, rule_id, i.severity, message FROM full_issue i JOIN txt t USING (stmt_id) "
    "WHERE NOT (rule_id = 'select-star' AND contains(t.norm, 'FROM orders'))", "full_issue"))
def _(spark, sf):
    from lintlake.operators.config import drop_excepted

    st = prepared(spark, sf)
    return drop_excepted(ru.evaluate(st), st, rule_config(spark)).select(*_CFG_COLS)


@query("cfg_03_parameters", with_(_CONFIGURED, "full_issue"))
def _(spark, sf):
    return ru.evaluate(prepared(spark, sf), config=rule_config(spark)).select(*_CFG_COLS)


@query("cfg_04_severity_override", with_(
    "SELECT stmt_id, rule_id, CASE rule_id WHEN 'missing-where' THEN 'INFO' WHEN 'long-sql-statement' THEN 'WARNING' "
    "ELSE severity END AS severity, message FROM full_issue", "full_issue"))
def _(spark, sf):
    from lintlake.operators.config import override_severity

    return override_severity(ru.evaluate(prepared(spark, sf)), rule_config(spark)).select(*_CFG_COLS)


# --- scores -------------------------------------------------------------------------------------------------------


@query("agg_01_issue_summary", with_(
    "SELECT rule_name, count(*) AS cnt FROM issue GROUP BY 1", "issue"))
def _(spark, sf):
    return sc.issue_summary(ru.evaluate(prepared(spark, sf), profile="scan"))


@query("agg_01_issue_totals", with_(
    "SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') "
    "AS warning, count(*) FILTER (severity = 'INFO') AS info FROM issue", "issue"))
def _(spark, sf):
    return sc.issue_totals(ru.evaluate(prepared(spark, sf), profile="scan"))


@query("agg_02_statement_severity", with_("SELECT stmt_id, severity FROM scored", "scored"))
def _(spark, sf):
    return scored(spark, sf).select("stmt_id", "severity")


@query("agg_03_statement_score", with_(
    "SELECT stmt_id, CAST(score AS BIGINT) AS score, issue_count FROM scored", "scored"))
def _(spark, sf):
    return scored(spark, sf).select("stmt_id", "score", "issue_count")


_PART = lambda w, n, d: f"CASE WHEN {n} > 0 THEN '；{w} ' || {n} || 'x{d}=-' || ({n} * {d}) ELSE '' END"


@query("agg_04_score_explanation", with_(
    f"""SELECT stmt_id, severity, CAST(score AS BIGINT) AS score, '基础分 100' || CASE WHEN issue_count = 0 THEN '；未触发规则'
     ELSE {_PART('严重', 'critical_count', 30)} || {_PART('警告', 'warning_count', 15)} || {_PART('提示', 'info_count', 5)}
     || '；规则 ' || rules || '；总扣分 ' || (30 * critical_count + 15 * warning_count + 5 * info_count) END
     || '；最终得分 ' || score AS score_explanation FROM scored""", "scored"))
def _(spark, sf):
    st = prepared(spark, sf)
    return sc.score(st, ru.evaluate(st, profile="scan"))


@query("agg_24_static_counts", with_(
    "SELECT stmt_id, n AS issue_count, c AS critical_count, w AS warning_count, i AS info_count FROM per_stmt", "per_stmt"))
def _(spark, sf):
    return sc.static_counts(ru.evaluate(prepared(spark, sf), profile="scan"))
