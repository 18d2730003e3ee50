"""Captured execution plans as rows: nodes, their issues, and roll-ups by statement.

A statement may own any number of nodes, so nodes and issues stay rows; everything by
statement is a sum, a flag or a maximum that combines in the map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions.sqltext import once, quote, sql_map, with_computed
from lintlake.operators.scoring import severity_name

NODE_COLUMNS = [
    "stmt_id", "node_no", "select_type", "access_type", "table_name", "possible_keys", "key_name", "key_len", "ref",
    "est_rows", "extra",
]

#: Types of plan issues in the order in which a node is checked for them.
ISSUE_TYPES = ["FULL_TABLE_SCAN", "NO_INDEX_USED", "HIGH_ROWS", "USING_TEMPORARY", "USING_FILESORT"]
EXPLAIN_TYPES = "array<struct<first_no:int,type:string,n:bigint,message:string>>"


def node_flags() -> dict[str, Column]:
    """EXP-2."""
    extra = F.upper(F.coalesce(F.col("extra"), F.lit("")))
    key = F.coalesce(F.col("key_name"), F.lit(""))
    return {
        "full_scan": F.coalesce(F.upper("access_type") == "ALL", F.lit(False)),
        "uses_index": (key != "") & (F.upper(key) != "NULL"),
        "temporary": extra.contains("USING TEMPORARY"),
        "filesort": extra.contains("USING FILESORT"),
    }


def with_node_flags(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns(node_flags())


def _issue(test: str, itype: str, severity: str, message: str, suggestion: str) -> str:
    return (
        f"if({test}, named_struct('type', '{itype}', 'severity', {severity}, 'message', {message}, "
        f"'suggestion', {suggestion}), null)"
    )


def _node_issues(threshold: int) -> Column:
    """EXP-3 as SQL over a node's columns: five places of (type, severity, message, suggestion), null where none."""
    high = f"coalesce(est_rows > {threshold}, false)"
    table = "coalesce(table_name, '<unknown>')"
    note = f"coalesce(concat({quote('，预计扫描行数: ')}, cast(est_rows as string)), '')"
    soft = f"if({high}, 'WARNING', 'INFO')"
    found = [
        _issue("full_scan", "FULL_TABLE_SCAN", f"if({high}, 'CRITICAL', 'WARNING')",
               f"concat({quote('检测到全表扫描')}, {note})",
               f"concat({quote('建议在 ')}, {table}, {quote(' 表上添加适当的索引以避免全表扫描')})"),
        _issue("NOT uses_index", "NO_INDEX_USED", soft, f"concat({quote('查询未使用索引')}, {note})",
               f"concat({quote('建议在 ')}, {table}, {quote(' 表上为 WHERE 条件字段添加索引')})"),
        _issue(high, "HIGH_ROWS", "'WARNING'",
               f"concat({quote('预计扫描行数过多: ')}, cast(est_rows as string), {quote(' 行')})",
               quote("建议优化查询条件或添加复合索引以减少扫描行数")),
        _issue("temporary", "USING_TEMPORARY", soft, quote("查询使用了临时表"),
               quote("临时表创建会影响性能，建议优化 GROUP BY 或 ORDER BY，或考虑添加索引")),
        _issue("filesort", "USING_FILESORT", soft, quote("查询使用了文件排序"),
               quote("建议为 ORDER BY 字段添加索引以避免文件排序")),
    ]
    return F.expr(f"array({', '.join(found)})")


def plan_issues(nodes: DataFrame, threshold: int = fv.HIGH_ROWS_THRESHOLD) -> DataFrame:
    """EXP-3: one row per issue of a node; an unknown row count is not a high one."""
    step = with_node_flags(nodes).select("stmt_id", "node_no", "table_name", once(_node_issues(threshold)).alias("found"))
    rows = step.select("stmt_id", "node_no", "table_name", F.posexplode_outer("found").alias("_k", "i"))
    return rows.where(F.col("i").isNotNull()).select(
        "stmt_id",
        F.lit("EXPLAIN").alias("source"),
        (F.col("node_no") * 5 + F.col("_k")).alias("issue_no"),
        F.col("i.type").alias("type"), "i.severity", "i.message", "i.suggestion",
        F.col("table_name").alias("evidence"),
    )


def plan_rollup(nodes: DataFrame, threshold: int = fv.HIGH_ROWS_THRESHOLD, with_types: bool = False) -> DataFrame:
    """EXP-4, EXP-5: rows, flags, issue counts and severity of each plan, in one grouping.

    ``with_types`` adds ``explain``: of each type of issue (at most five) its count and first message, in order of
    appearance; the same grouping makes them.
    """
    flags = with_node_flags(nodes)
    firsts, places = [], range(len(ISSUE_TYPES)) if with_types else []
    if with_types:
        flags = with_computed(flags, found=_node_issues(threshold))
    for k in places:
        issue = F.get("found", F.lit(k))
        number = (F.col("node_no") * len(ISSUE_TYPES) + k).cast("int").alias("first_no")
        firsts += [
            F.count(issue).alias(f"n{k}"),
            F.min(F.when(issue.isNotNull(), F.struct(number, issue["message"].alias("message")))).alias(f"first{k}"),
        ]
    high = F.coalesce(F.col("est_rows") > threshold, F.lit(False))
    per_node = flags.select(
        "stmt_id", "est_rows", "full_scan", "uses_index", "temporary", "filesort", high.alias("high"),
        *(["node_no", "found"] if with_types else []),
        # number of issues of this node by severity
        (F.col("full_scan") & high).cast("int").alias("c"),
        ((F.col("full_scan") & ~high).cast("int") + high.cast("int")
         + (high & ~F.col("uses_index")).cast("int") + (high & F.col("temporary")).cast("int")
         + (high & F.col("filesort")).cast("int")).alias("w"),
        ((~high & ~F.col("uses_index")).cast("int") + (~high & F.col("temporary")).cast("int")
         + (~high & F.col("filesort")).cast("int")).alias("i"),
    )
    grouped = per_node.groupBy("stmt_id").agg(
        F.count(F.lit(1)).alias("node_count"),
        F.coalesce(F.sum("est_rows"), F.lit(0)).alias("total_rows"),
        F.bool_or("full_scan").alias("has_full_scan"),
        F.bool_or(~F.col("uses_index")).alias("has_no_index"),
        F.bool_or("temporary").alias("has_temporary"),
        F.bool_or("filesort").alias("has_filesort"),
        F.sum("c").alias("explain_critical"), F.sum("w").alias("explain_warning"), F.sum("i").alias("explain_info"),
        *firsts,
    )
    if with_types:
        of_type = [F.struct(F.col(f"first{k}.first_no").alias("first_no"), F.lit(ISSUE_TYPES[k]).alias("type"), F.col(f"n{k}").alias("n"),
                            F.col(f"first{k}.message").alias("message")) for k in places]
        explain = F.array_sort(F.filter(F.array(*of_type), lambda t: t["n"] > 0)).cast(EXPLAIN_TYPES).alias("explain")
        grouped = grouped.select(*[c for c in grouped.columns if c not in {f"{x}{k}" for x in ("n", "first") for k in places}], explain)
    rank = F.when(F.col("explain_critical") > 0, 3).when(F.col("explain_warning") > 0, 2).otherwise(1)
    return grouped.withColumns({
        "explain_issues": F.col("explain_critical") + F.col("explain_warning") + F.col("explain_info"),
        "plan_severity": severity_name(rank),
    })


def statement_plans(stmts: DataFrame, nodes: DataFrame, threshold: int = fv.HIGH_ROWS_THRESHOLD) -> DataFrame:
    """EXP-5: severity of every statement's plan; INFO where it has no node or no issue."""
    return stmts.select("stmt_id").join(plan_rollup(nodes, threshold), "stmt_id", "left").select(
        "stmt_id", F.coalesce("plan_severity", F.lit("INFO")).alias("plan_severity"),
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
    )


def node_text() -> Column:
    """EXP-6: what a node does, in words."""
    note = F.coalesce(F.element_at(F.expr(sql_map(fv.ACCESS_TYPE_NOTE)), F.col("access_type")), F.lit(""))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.concat(
        F.lit("访问类型: "), F.coalesce("access_type", F.lit("null")), note,
        F.when(filled("key_name"), F.concat(F.lit(", 使用索引: "), F.col("key_name")))
        .when(filled("possible_keys"), F.concat(F.lit(", 可用索引但未使用: "), F.col("possible_keys")))
        .otherwise(", 无索引可用"),
        F.when(F.col("est_rows") > 0, F.concat(F.lit(", 预计扫描行数: "), F.col("est_rows").cast("string"))).otherwise(""),
        F.when(filled("extra"), F.concat(F.lit(", "), F.col("extra"))).otherwise(""),
    )


def plan_text(nodes: DataFrame) -> DataFrame:
    return nodes.select("stmt_id", "node_no", node_text().alias("node_text"))


# --- other shapes of plan rows ---------------------------------------------------------------------------


def _text(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def nodes_from_text(df: DataFrame, text_col: str = "plan_text") -> DataFrame:
    """EXP-7: lines of a text plan; index and table are read on their own."""
    t = F.col(text_col)
    low = F.lower(t)
    seq, idx = low.contains("seq scan on"), low.contains("index scan using") | low.contains("index only scan")
    on_table = F.nullif(F.regexp_extract(t, r"(?i)\bon\s+(.*?)\s*(?:\(|$)", 1), F.lit(""))
    index = F.nullif(F.regexp_extract(t, r"(?i)\busing\s+(.*?)\s*(?:\s+on\s|\(|$)", 1), F.lit(""))
    access = (
        F.when(seq, "ALL").when(idx, "index").when(low.contains("nested loop"), "Nested Loop")
        .when(low.contains("hash join"), "Hash Join").when(low.contains("merge join"), "Merge Join").otherwise("unknown")
    )
    rows = F.trim(F.regexp_extract(t, r"rows=(.*?)width=", 1)).try_cast("bigint")
    return df.where(t.isNotNull() & (t != "")).select(
        "stmt_id", "node_no", _text("select_type"), access.alias("access_type"),
        F.when(seq | idx, on_table).alias("table_name"), _text("possible_keys"),
        F.when(idx, index).alias("key_name"), _text("key_len"), _text("ref"), rows.alias("est_rows"), _text("extra"),
        t.alias("node_text"),
    )


def nodes_from_tabular(df: DataFrame) -> DataFrame:
    """EXP-8: rows of a tabular plan, all columns text and labels in any case.

    An id that is no number becomes null, a row count that is no number becomes 0.
    """
    have = {c.lower(): c for c in df.columns}
    col = lambda c: F.col(have[c]).cast("string") if c in have else F.lit(None).cast("string")
    rows = F.when(col("rows").isNotNull(), F.coalesce(F.trim(col("rows")).try_cast("bigint"), F.lit(0)))
    nodes = df.select(
        "stmt_id", "node_no",
        F.trim(col("id")).try_cast("int").alias("plan_id"),
        col("select_type").alias("select_type"), col("type").alias("access_type"), col("table").alias("table_name"),
        col("possible_keys").alias("possible_keys"), col("key").alias("key_name"), col("key_len").alias("key_len"),
        col("ref").alias("ref"), rows.cast("bigint").alias("est_rows"), col("extra").alias("extra"),
    )
    return nodes.withColumn("node_text", node_text())


def nodes_minimal(df: DataFrame) -> DataFrame:
    """EXP-9: rows that only know an id, an operation and perhaps a table."""
    have = {c.lower(): c for c in df.columns}
    col = lambda c: F.col(have[c]).cast("string") if c in have else F.lit(None).cast("string")
    return df.select(
        "stmt_id", "node_no", F.trim(col("id")).try_cast("int").alias("plan_id"),
        col("type").alias("select_type"), col("type").alias("access_type"), col("tablename").alias("table_name"),
        _text("possible_keys"), _text("key_name"), _text("key_len"), _text("ref"),
        F.lit(None).cast("bigint").alias("est_rows"), _text("extra"),
        F.concat(
            F.lit("操作类型: "), F.coalesce(col("type"), F.lit("null")),
            F.coalesce(F.concat(F.lit(", 表: "), col("tablename")), F.lit("")),
        ).alias("node_text"),
    )


# --- evidence ------------------------------------------------------------------------------------------------


def plan_summary(nodes: DataFrame) -> DataFrame:
    """EXP-10: ``table / type / rows=n`` of each node, one row each."""
    part = F.concat(
        F.coalesce("table_name", F.lit("<unknown>")), F.lit(" / "), F.coalesce("access_type", F.lit("unknown")),
        F.lit(" / rows="), F.coalesce(F.col("est_rows").cast("string"), F.lit("?")),
    )
    return nodes.select("stmt_id", "node_no", part.alias("summary"))


def evidence(stmts: DataFrame, nodes: DataFrame, errors: DataFrame) -> DataFrame:
    """EXP-11: has the statement plan evidence, or did its EXPLAIN fail.  ``errors``: (stmt_id, error_message)."""
    counts = nodes.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("node_count"))
    failed = errors.where(F.trim("error_message") != "").groupBy("stmt_id").agg(
        F.min("error_message").alias("error_message"))
    joined = stmts.select("stmt_id").join(counts, "stmt_id", "left").join(failed, "stmt_id", "left")
    failure = F.col("error_message").isNotNull()
    return joined.select(
        "stmt_id", (F.col("node_count").isNotNull() & ~failure).alias("explain_executed"),
        failure.alias("explain_failed"), "error_message",
    )
