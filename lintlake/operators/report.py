"""Findings and the report frames made from them.

A finding is one row: its static issues are an array (bounded by the rules), plan issues
are at most one entry per issue type, places and plan nodes stay frames of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text as tx
from lintlake.functions.sqltext import once, sql_array, sql_map
from lintlake.operators.scoring import severity_rank
from lintlake.plans.nodes import EXPLAIN_TYPES, plan_rollup
from lintlake.session import materialized
from lintlake.sizing import hot_key_join



def one_decimal(c: Column) -> Column:
    """Half up, one decimal."""
    return F.floor(c * 10.0 + 0.5) / 10.0


def safe(c: Column, other) -> Column:
    return F.when(tx.is_blank(c), other).otherwise(c)


# --- findings (AGG-5, AGG-6, AGG-22) -----------------------------------------------------------------


def findings(
    scored: DataFrame,
    nodes: DataFrame | None = None,
    errors: DataFrame | None = None,
    threshold: int = fv.HIGH_ROWS_THRESHOLD,
) -> DataFrame:
    """AGG-5: scored statements with their plan evidence.

    ``nodes``: plan rows by stmt_id; ``errors``: (stmt_id, error_message) of failed EXPLAINs.
    Plans are rolled up before they are joined, so both sides hold a statement once.
    """
    out = scored
    zero = F.lit(0).cast("bigint")
    if nodes is not None:
        out = out.join(plan_rollup(nodes, threshold, with_types=True), "stmt_id", "left")
    else:
        out = out.withColumns({
            c: F.lit(None).cast("bigint")
            for c in ("node_count", "explain_critical", "explain_warning", "explain_info", "explain_issues")
        }).withColumn("explain", F.lit(None).cast(EXPLAIN_TYPES))
    if errors is not None:
        failed = errors.where(F.trim("error_message") != "").groupBy("stmt_id").agg(
            F.min("error_message").alias("explain_error"))
        out = out.join(failed, "stmt_id", "left")
    else:
        out = out.withColumn("explain_error", F.lit(None).cast("string"))
    num = lambda c: F.coalesce(F.col(c), zero)
    out = out.withColumns({
        "static_count": F.col("issue_count"),
        "explain_count": num("explain_issues"),
        "critical_total": F.col("critical_count") + num("explain_critical"),
        "warning_total": F.col("warning_count") + num("explain_warning"),
        "info_total": F.col("info_count") + num("explain_info"),
        "explain": F.coalesce("explain", F.array().cast(EXPLAIN_TYPES)),
        "explain_executed": F.col("node_count").isNotNull() & F.col("explain_error").isNull(),
    }).withColumn("issue_count", F.col("static_count") + F.col("explain_count"))
    types = F.expr("array_distinct(concat(transform(issues, i -> i.type), transform(explain, e -> e.type)))")
    return out.withColumn("rule_types", once(types))


def default_recommendation(itype: Column, message: Column) -> Column:
    """AGG-22: what to advise when an issue brings no suggestion; plan issues (no type) go by message."""
    table = F.expr(sql_map(fv.RECOMMENDATION_OF_TYPE))
    by_message = (
        F.when(message.contains("全表扫描"), fv.RECOMMEND_FULL_SCAN)
        .when(message.contains("索引"), fv.RECOMMEND_INDEX)
        .otherwise(fv.RECOMMEND_OTHER)
    )
    by_type = F.coalesce(F.element_at(table, itype), F.lit(fv.RECOMMENDATION_OF_TYPE["UNKNOWN"]))
    return F.when(itype.isNull(), by_message).otherwise(by_type)


def report_issues(static: DataFrame, explain: DataFrame | None = None) -> DataFrame:
    """AGG-5: issues of both origins in one long frame, every one with a suggestion."""
    s = static.select(
        "stmt_id", "source", "issue_no", "type", "severity", "message",
        safe(F.col("suggestion"), default_recommendation(F.col("type"), F.col("message"))).alias("suggestion"), "evidence",
    )
    if explain is None:
        return s
    none = F.lit(None).cast("string")
    e = explain.select(
        "stmt_id", "source", "issue_no", "type", "severity", "message",
        safe(F.col("suggestion"), default_recommendation(none, F.col("message"))).alias("suggestion"), "evidence",
    )
    return s.unionByName(e)


def recommendations(issues: DataFrame) -> DataFrame:
    """AGG-5: distinct recommendations of a finding with the place of the first, one row each."""
    order = F.when(F.col("source") == "STATIC", 0).otherwise(1)
    return issues.groupBy("stmt_id", "suggestion").agg(F.min(F.struct(order.alias("s"), "issue_no")).alias("first")).select(
        "stmt_id", F.col("first.s").alias("source_no"), F.col("first.issue_no").alias("issue_no"), "suggestion")


def finding_order() -> list[Column]:
    """AGG-6: severity, then number of issues, then low score, then id."""
    return [F.desc(severity_rank(F.col("severity"))), F.desc("issue_count"), F.asc("score"), F.asc("stmt_id")]


def order_findings(found: DataFrame) -> DataFrame:
    return found.orderBy(*finding_order())


def rank_findings(found: DataFrame) -> DataFrame:
    """AGG-6: exact rank of every finding without sorting them all in one task.

    Findings are dealt out by ranges of the whole sort key, for ids of any form.  A rank is the
    number of findings in the ranges before plus the place within the own range; the one
    ordered window is over one row for each range.
    """
    ranges = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialized(found.repartitionByRange(ranges, *finding_order()).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select(
        "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*finding_order()))
    ranked = dealt.withColumn("_place", place).join(offsets, "_range")
    return ranked.withColumn("finding_rank", (F.col("_offset") + F.col("_place")).cast("bigint")).drop("_range", "_offset", "_place")


# --- summary (AGG-7..10) -----------------------------------------------------------------------------------


def risk_level(critical: Column, warning: Column, total: Column) -> Column:
    """AGG-10."""
    return (
        F.when(critical > 0, "CRITICAL").when(warning > 0, "WARNING").when(total > 0, "INFO").otherwise("HEALTHY")
    )


def risk_score(mean: Column, critical: Column, warning: Column) -> Column:
    """AGG-9: rounded mean score, capped by the number of critical issues and warnings."""
    score = F.floor(mean + 0.5)
    capped = F.when(F.lit(False), score)
    for least, cap in fv.CRITICAL_CAPS:
        capped = capped.when(critical >= least, F.least(score, F.lit(cap).cast("bigint")))
    for least, cap in fv.WARNING_CAPS:
        capped = capped.when(warning >= least, F.least(score, F.lit(cap).cast("bigint")))
    return capped.otherwise(score)


def report_summary(found: DataFrame, total_files: DataFrame) -> DataFrame:
    """AGG-7..10: one row.  ``total_files``: one row with a ``total_files`` column."""
    supported = F.col("eligibility") == "SUPPORTED"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    agg = found.agg(
        total("location_count").alias("total_sql"),
        F.count(F.lit(1)).alias("unique_sql"),
        F.count_if(F.col("issue_count") > 0).alias("issue_sql"),
        total("issue_count").alias("total_issues"),
        total("critical_total").alias("critical_issues"),
        total("warning_total").alias("warning_issues"),
        total("info_total").alias("info_issues"),
        F.count("validity").alias("parsed"),
        F.count_if(F.col("validity") == "VALID").alias("valid"),
        F.count_if(supported).alias("explainable"),
        F.count_if(supported & F.col("explain_executed")).alias("explained"),
        F.avg("score").alias("mean_score"),
    )
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(one_decimal(F.col(a) * 100.0 / F.col(b)))
    crit, warn = F.col("critical_issues"), F.col("warning_issues")
    return agg.withColumn("total_files", total_files.select("total_files").scalar()).select(
        "total_files", "total_sql", "unique_sql", "issue_sql",
        (F.col("unique_sql") - F.col("issue_sql")).alias("clean_sql"),
        "total_issues", "critical_issues", "warning_issues", "info_issues",
        share("parsed", "unique_sql").alias("parse_rate"),
        share("valid", "unique_sql").alias("valid_rate"),
        share("explained", "explainable").alias("explain_coverage"),
        risk_score(F.coalesce("mean_score", F.lit(100.0)), crit, warn).alias("score"),
        risk_level(crit, warn, F.col("total_issues")).alias("risk_level"),
    )


# --- hotspots (AGG-11..13) ------------------------------------------------------------------------------------


def hotspots_by_file(found: DataFrame, locations: DataFrame) -> DataFrame:
    """AGG-11: issues times places per file, the eight highest; shares are of the highest.

    Places are counted per (statement, file) in the map tasks first; the join's partition of a
    statement in very many files is split at run time (AQE skew join).  Only the eight rows
    meet in one window.
    """
    risky = found.where(F.col("issue_count") > 0).select("stmt_key", "issue_count")
    places = locations.groupBy("stmt_key", "path").agg(F.count(F.lit(1)).alias("places"))
    hit = hot_key_join(places, risky, "stmt_key")
    counts = hit.groupBy(safe(F.col("path"), "Unknown").alias("label")).agg(
        F.sum(F.col("places") * F.col("issue_count")).alias("cnt"))
    best = counts.orderBy(F.desc("cnt"), F.asc("label")).limit(fv.TOP_STATS)
    most = F.max("cnt").over(Window.partitionBy())
    return best.withColumn("ratio", one_decimal(F.col("cnt") * 100.0 / F.greatest(most, F.lit(1))))


def rule_counts(found: DataFrame) -> DataFrame:
    """Issues of both origins by report type."""
    both = F.expr(
        "concat(transform(issues, i -> named_struct('label', i.type, 'n', 1L)), "
        "transform(explain, e -> named_struct('label', e.type, 'n', e.n)))"
    )
    rows = found.select(F.explode_outer(once(both)).alias("x")).where(F.col("x").isNotNull())
    return rows.groupBy(F.col("x.label").alias("label")).agg(F.sum("x.n").alias("cnt"))


def hotspots_by_rule(found: DataFrame, n: int = fv.TOP_STATS) -> DataFrame:
    """AGG-12: the rules with the most issues; shares are of all issues (one row per rule in the window)."""
    total = F.sum("cnt").over(Window.partitionBy())
    counts = rule_counts(found).withColumn(
        "ratio", one_decimal(F.col("cnt") * 100.0 / F.greatest(total, F.lit(1))))
    return counts.orderBy(F.desc("cnt"), F.asc("label")).limit(n)


def hotspots_by_severity(found: DataFrame) -> DataFrame:
    """AGG-13: always three rows."""
    one = found.agg(
        *[F.coalesce(F.sum(f"{s.lower()}_total"), F.lit(0)).alias(s) for s in fv.SEVERITIES],
        F.coalesce(F.sum("issue_count"), F.lit(0)).alias("total"),
    )
    rows = one.select(
        "total", F.inline(F.array(*[F.struct(F.lit(s).alias("label"), F.col(s).alias("cnt")) for s in fv.SEVERITIES])))
    return rows.select(
        "label", "cnt", one_decimal(F.col("cnt") * 100.0 / F.greatest("total", F.lit(1))).alias("ratio"))


# --- insights and diagnostics (AGG-14..20) ---------------------------------------------------------------------


def parse_failure_title() -> Column:
    """AGG-15: why a statement could not be read."""
    gaps = lambda c: F.upper(tx.one_space(F.coalesce(F.col(c), F.lit(""))))
    holes = lambda c: _any(gaps(c), fv.TEMPLATE_GAPS)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    dynamic = text("original_sql").contains("${") | text("norm").contains("${") | text("reason").contains("${}")
    t = fv.PARSE_FAILURE_TITLES
    return (
        F.when(dynamic, t[0])
        .when(holes("original_sql") | holes("norm"), t[1])
        .when(F.col("category").startswith("MYBATIS"), t[2])
        .otherwise(t[3])
    )


def _any(c: Column, parts: list[str]) -> Column:
    test = F.lit(False)
    for p in parts:
        test = test | c.contains(p)
    return test


def parse_failure_rank(title: Column) -> Column:
    rank = F.when(F.lit(False), 0)
    for i, t in enumerate(fv.PARSE_FAILURE_TITLES):
        rank = rank.when(title == t, i)
    return rank.otherwise(len(fv.PARSE_FAILURE_TITLES) - 1)


def skip_reason() -> Column:
    """AGG-16."""
    return (
        F.when(~tx.is_blank(F.col("reason")), F.col("reason"))
        .when(F.col("eligibility") == "SKIPPED", fv.SKIP_REASON_SKIPPED)
        .when(F.col("eligibility") == "NOT_SUPPORTED", fv.SKIP_REASON_NOT_SUPPORTED)
        .otherwise(F.coalesce("eligibility", F.lit("EXPLAIN 状态未知")))
    )


def has_any(types: list[str]) -> Column:
    return F.expr(f"arrays_overlap(rule_types, {sql_array(types)})")


def _insight(test: Column, kind: str, title, count, evidence, rank=0) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(
        test,
        F.struct(
            F.lit(kind).alias("kind"), as_col(title).alias("title"), as_col(count).cast("bigint").alias("cnt"),
            as_col(evidence).alias("evidence"), as_col(rank).cast("int").alias("rank"),
        ),
    )


def insight_rows(found: DataFrame) -> DataFrame:
    """AGG-14..19 before the limit: one row per statement and kind, found in one pass."""
    title = parse_failure_title()
    dml = F.col("sql_type").isin("UPDATE", "DELETE")
    open_dml = ~F.upper(F.coalesce("norm", "original_sql")).contains(" WHERE ")
    items = F.array(
        _insight(F.col("location_count") > 1, "duplicate_sql",
                 F.concat(F.lit("重复 SQL 出现在 "), F.col("location_count").cast("string"), F.lit(" 处")),
                 F.col("location_count"), safe(F.col("abstract_sql"), F.col("original_sql"))),
        _insight(F.col("validity") == "INVALID", "parse_failure", title, 1,
                 safe(F.col("reason"), fv.REASON_UNPARSED), parse_failure_rank(title)),
        _insight((F.col("issue_count") > 0) & (F.col("eligibility") != "SUPPORTED"), "skipped_explain", "EXPLAIN 未执行", 1,
                 skip_reason()),
        _insight(dml & (open_dml | has_any(["SELECT_WITHOUT_WHERE"])), "dangerous_dml", "危险 DML", 1, fv.EVIDENCE_DML),
        _insight(has_any(fv.DYNAMIC_RULES) | F.col("original_sql").contains("${"), "potential_injection", "潜在注入", 1,
                 fv.EVIDENCE_INJECTION),
        _insight(has_any(["FULL_TABLE_SCAN", "NO_INDEX", "MISSING_INDEX"]), "full_scan", "全表扫描 / 无索引", 1,
                 fv.EVIDENCE_FULL_SCAN),
    )
    rows = found.select(
        "stmt_id", "severity", "first_path", "first_line", "location_count", F.explode_outer(once(items)).alias("x"))
    return rows.where(F.col("x").isNotNull()).select(
        "x.kind", "stmt_id", "x.title", "x.cnt", "severity", "x.evidence",
        F.concat("first_path", F.lit(":"), F.col("first_line").cast("string")).alias("place"), "location_count",
        "x.rank", "first_path", "first_line",
    )


def insights(found: DataFrame, n: int = fv.TOP_INSIGHTS) -> DataFrame:
    """AGG-14..19: the first ``n`` of each kind; ranks above the limit are dropped before the shuffle."""
    order = Window.partitionBy("kind").orderBy("rank", "first_path", "first_line", "stmt_id")
    return insight_rows(found).withColumn("place_no", F.row_number().over(order)).where(F.col("place_no") <= n).drop(
        "rank", "first_path", "first_line")


def diagnostics(found: DataFrame) -> DataFrame:
    """AGG-20: (kind, stmt_id, rank, text) of what needs a second look."""
    title = parse_failure_title()
    why = safe(F.col("reason"), fv.REASON_UNPARSED)
    failure = F.concat(title, F.lit(" - "), why)
    failed = F.col("explain_error").isNotNull()
    dynamic = has_any(fv.DYNAMIC_RULES) | F.col("original_sql").contains("${") | F.coalesce(
        F.col("norm").contains("${"), F.lit(False))
    review = (
        F.when(F.col("validity") == "INVALID", failure)
        .when(F.col("validity") == "UNKNOWN",
              F.concat(F.lit("解析状态未知 - "), safe(F.col("reason"), fv.REVIEW_UNKNOWN)))
        .when(failed, F.concat(F.lit("EXPLAIN 失败 - "), F.col("explain_error")))
        .when(dynamic, fv.REVIEW_DYNAMIC)
    )
    item = lambda test, kind, text, rank: F.when(
        test, F.struct(F.lit(kind).alias("kind"), text.alias("text"), rank.cast("int").alias("rank")))
    items = F.array(
        item(F.col("validity") == "INVALID", "parse_failure", failure, parse_failure_rank(title)),
        item(F.col("eligibility") != "SUPPORTED", "skipped_explain", skip_reason(), F.lit(0)),
        item(review.isNotNull(), "manual_review", review, F.lit(0)),
        item(failed, "explain_failure", F.col("explain_error"), F.lit(0)),
    )
    place = F.concat("stmt_id", F.lit("@"), F.coalesce("first_path", F.lit("unknown")), F.lit(":"),
                     F.col("first_line").cast("string"), F.lit(": "))
    rows = found.select("stmt_id", place.alias("place"), F.explode_outer(once(items)).alias("x"))
    return rows.where(F.col("x").isNotNull()).select(
        "x.kind", "stmt_id", "x.rank", F.concat("place", "x.text").alias("text"))


# --- legacy summary (AGG-21) and listing (AGG-23) ------------------------------------------------------------------


def dimension_stats(found: DataFrame, n: int = fv.TOP_STATS) -> DataFrame:
    """AGG-21: the most frequent labels of six dimensions, counted in one pass."""
    cell = lambda d, c: F.struct(
        F.lit(d).alias("dimension"), c.alias("code"), F.lit(1).cast("bigint").alias("n"))
    cells = F.concat(
        F.array(*[cell(d, F.col(d)) for d in ("category", "validity", "eligibility", "source_type")]),
        F.transform("issues", lambda i: cell("static_issue", i["type"])),
        F.transform("explain", lambda e: F.struct(
            F.lit("explain_issue").alias("dimension"), e["type"].alias("code"), e["n"].alias("n"))),
    )
    rows = found.select(F.explode_outer(once(cells)).alias("x"))
    by_code = rows.groupBy("x.dimension", "x.code").agg(F.sum("x.n").alias("n"))
    label = F.when(F.col("code").isNull(), fv.LABEL_OF_NULL).otherwise(tx.label(F.col("code")))
    counts = by_code.withColumn("label", label).groupBy("dimension", "label").agg(F.sum("n").alias("cnt"))
    whole = Window.partitionBy("dimension")
    ranked = counts.withColumns({
        "ratio": F.col("cnt") * 100.0 / F.sum("cnt").over(whole),
        "rn": F.row_number().over(whole.orderBy(F.desc("cnt"), F.asc("label"))),
    })
    return ranked.where(F.col("rn") <= n).drop("rn")


def legacy_summary(found: DataFrame) -> DataFrame:
    """AGG-21: severities counted by statement, mean score, rates in percent."""
    supported = F.col("eligibility") == "SUPPORTED"
    agg = found.agg(
        F.coalesce(F.sum("location_count"), F.lit(0)).alias("total_sql"), F.count(F.lit(1)).alias("parsed_sql"),
        *[F.count_if(F.col("severity") == s).alias(f"{s.lower()}_sql") for s in fv.SEVERITIES],
        F.coalesce(F.avg("score"), F.lit(100.0)).alias("average_score"),
        F.count_if(supported).alias("explain_eligible"),
        F.count_if(supported & F.col("node_count").isNotNull()).alias("explain_executed"),
    )
    rate = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) * 100.0 / F.col(b))
    return agg.withColumns({
        "parse_rate": rate("parsed_sql", "total_sql"),
        "explain_coverage": rate("explain_executed", "explain_eligible"),
    })


def issue_listing(issues: DataFrame) -> DataFrame:
    """AGG-23: issue types within each severity, worst severity and most frequent first."""
    sev = F.when(F.col("severity").isin("CRITICAL", "WARNING"), F.col("severity")).otherwise("INFO")
    counts = issues.groupBy(sev.alias("severity"), "rule_name").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("cnt"), "rule_name")


# --- JSON report (OUT-1) ---------------------------------------------------------------------------------------------

SECTIONS = [
    "metadata", "summary", "hotspots", "insights", "schemaAnalysis", "findings", "diagnostics", "executiveSummary",
    "campaigns", "confidence", "methodology", "remediation",
]


def report_json(sections: dict[str, DataFrame]) -> DataFrame:
    """OUT-1: (section, part, json), one JSON object per row.

    Keys are section names, or ``section.part`` for sections of several lists.  A list of any
    length stays rows; write the frame with ``partitionBy('section')``.
    """
    out = None
    for key, df in sections.items():
        section, _, part = key.partition(".")
        if section not in SECTIONS:
            raise ValueError(f"unknown report section: {section}")
        rows = df.select(
            F.lit(section).alias("section"), F.lit(part).alias("part"),
            F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def metadata(spark, project: str, scan_path: str) -> DataFrame:
    return spark.range(1).select(
        F.lit("1.0").alias("reportVersion"), F.current_timestamp().cast("string").alias("generatedAt"),
        F.lit(project).alias("projectName"), F.lit(scan_path).alias("scanPath"))
