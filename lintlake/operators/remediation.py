"""Tasks, campaigns and the texts that lead a repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions.sqltext import once, quote, sql_array, sql_map
from lintlake.operators.report import has_any, hotspots_by_rule, safe
from lintlake.operators.scoring import severity_rank
from lintlake.sizing import constant_frame, hot_key_join, only_row


def _is(c: str, rules: list[str]) -> Column:
    return F.upper(F.trim(c)).isin(*rules)


def with_primary_issue(found: DataFrame) -> DataFrame:
    """REM-1, REM-2: the issue with the lowest rule rank, the first on ties; findings without issues are left out.

    The candidates of one finding are its static issues and one entry per plan issue type,
    so the minimum is taken inside the row.
    """
    rank = f"coalesce(element_at({sql_map(fv.RULE_RANK)}, upper(trim({{}}))), {fv.RULE_RANK_DEFAULT})"
    best = F.expr(
        "array_min(concat("
        f"transform(issues, (i, n) -> named_struct('rank', {rank.format('i.type')}, 'src', 0, 'no', n, "
        "'type', i.type, 'message', i.message)), "
        f"transform(explain, e -> named_struct('rank', {rank.format('e.type')}, 'src', 1, 'no', e.first_no, "
        "'type', e.type, 'message', e.message))))"
    )
    with_issues = found.where(F.col("issue_count") > 0).withColumn("_best", once(best))
    return with_issues.withColumns({
        "primary_rule": safe(F.col("_best.type"), "UNKNOWN"),
        "primary_message": F.col("_best.message"),
    }).drop("_best")


def priority() -> Column:
    """REM-3."""
    return (
        F.when(has_any(fv.SAFETY_RULES) | (F.col("severity") == "CRITICAL"), "P0")
        .when(has_any(fv.PERFORMANCE_RULES), "P1")
        .otherwise("P2")
    )


def theme() -> Column:
    """REM-4."""
    return (
        F.when(has_any(fv.SAFETY_RULES), "SAFETY")
        .when(has_any(fv.PERFORMANCE_RULES), "PERFORMANCE")
        .when(has_any(fv.REVIEW_RULES), "MAINTAINABILITY")
        .otherwise("CORRECTNESS")
    )


def task_confidence() -> Column:
    """REM-5."""
    unsure = _is("primary_rule", fv.REVIEW_RULES + fv.DYNAMIC_RULES)
    return F.when(F.col("explain_executed"), "CONFIRMED").when(unsure, "NEEDS_REVIEW").otherwise("LIKELY")


def campaign_of_task() -> Column:
    """REM-6: null when no campaign fits."""
    t = F.col("theme")
    return (
        F.when((t == "SAFETY") & has_any(fv.DYNAMIC_RULES), "p0-dynamic-sql-safety")
        .when(t == "PERFORMANCE", "p1-unbounded-query-containment")
        .when((t == "MAINTAINABILITY") & has_any(fv.REVIEW_RULES), "p2-template-review")
    )


def recipe_of_task() -> Column:
    """REM-7."""
    text = safe(F.col("original_sql"), safe(F.col("norm"), F.coalesce("abstract_sql", F.lit(""))))
    dynamic_order = F.upper(text).contains("ORDER BY") & text.contains("${")
    return (
        F.when(_is("primary_rule", ["SQL_INJECTION_RISK"]), "dynamic-value-binding")
        .when(_is("primary_rule", ["DYNAMIC_SQL"]),
              F.when(dynamic_order, "dynamic-order-by-whitelist").otherwise("dynamic-value-binding"))
        .when(_is("primary_rule", fv.PERFORMANCE_RULES), "unbounded-query-containment")
        .when(_is("primary_rule", ["SELECT_STAR"]), "select-star-field-list")
        .when(_is("primary_rule", fv.DML_RULES), "dangerous-dml-guardrail")
        .when(_is("primary_rule", fv.REVIEW_RULES), "template-review-normalization")
        .otherwise("general-rule-remediation")
    )


def _impact() -> Column:
    t = fv.TASK_IMPACT
    return (
        F.when((F.col("priority") == "P0") & (F.col("theme") == "SAFETY"), t["P0_SAFETY"])
        .when(F.col("theme") == "PERFORMANCE", t["PERFORMANCE"])
        .when(F.col("theme") == "MAINTAINABILITY", t["MAINTAINABILITY"])
        .otherwise(t["OTHER"])
    )


def _recommendation() -> Column:
    t = fv.TASK_RECOMMENDATION
    return (
        F.when(_is("primary_rule", fv.DYNAMIC_RULES), t["DYNAMIC"])
        .when(_is("primary_rule", fv.PERFORMANCE_RULES), t["PERFORMANCE"])
        .when(_is("primary_rule", ["SELECT_STAR"]), t["SELECT_STAR"])
        .when(_is("primary_rule", fv.DML_RULES), t["DML"])
        .when(_is("primary_rule", fv.REVIEW_RULES), t["REVIEW"])
        .otherwise(t["OTHER"])
    )


def _acceptance() -> Column:
    rule = F.col("primary_rule")
    return (
        F.when(F.col("priority") == "P0", F.concat(F.lit("完成 P0 修复后重新扫描，确认 "), rule, F.lit(" 不再出现。")))
        .when(F.col("priority") == "P1", F.concat(F.lit("重新扫描并补充 EXPLAIN 证据，确认 "), rule, F.lit(" 风险下降。")))
        .otherwise(F.concat(F.lit("重新扫描并确认 "), rule, F.lit(" 已修复或完成人工复核记录。")))
    )


def tasks(found: DataFrame) -> DataFrame:
    """REM-1..8: one task per finding with issues; a projection, nothing is shuffled."""
    base = with_primary_issue(found).withColumns({
        "priority": priority(), "theme": theme(), "confidence": task_confidence(), "repair_recipe_id": recipe_of_task(),
    })
    place = F.coalesce(safe(F.col("first_file"), F.lit(None).cast("string")), safe(F.col("first_path"), "Unknown"))
    return base.select(
        F.concat("stmt_id", F.lit("-remediation-"), F.lower(F.trim("primary_rule"))).alias("task_id"),
        "stmt_id",
        F.when(
            F.col("first_path").isNotNull(),
            F.concat(place, F.lit(":"), F.col("first_line").cast("string"), F.lit(" · "), F.col("primary_rule")),
        ).otherwise(F.concat("sql_type", F.lit(" SQL · "), F.col("primary_rule"))).alias("title"),
        "priority", "severity", "theme", "confidence", "first_path", "first_line",
        campaign_of_task().alias("campaign_id"),
        "rule_types", "primary_rule",
        _impact().alias("impact"),
        "repair_recipe_id",
        _recommendation().alias("recommendation"),
        _acceptance().alias("acceptance_check"),
        F.col("primary_message").alias("evidence"),
    )


# --- recipes (REM-9) ---------------------------------------------------------------------------------------


def recipes(spark) -> DataFrame:
    names = ["recipe_id", "title", "applies_to", "unsafe_pattern", "safe_pattern", "steps", "verification", "known_limits"]
    return constant_frame(spark, fv.RECIPES, names)


def tasks_with_recipes(task_frame: DataFrame) -> DataFrame:
    """REM-9: each task with its recipe; the recipes are seven fixed rows."""
    r = recipes(task_frame.sparkSession).withColumnRenamed("title", "recipe_title")
    return task_frame.join(F.broadcast(r), task_frame["repair_recipe_id"] == r["recipe_id"], "inner").drop("recipe_id")


# --- campaigns (REM-10) ----------------------------------------------------------------------------------------


_ORDER = ["o_sev", "o_issues", "o_score", "stmt_id"]


def _membership(found: DataFrame) -> DataFrame:
    """Each finding with the campaigns it belongs to and the keys of the finding order."""
    ids = F.expr(
        "filter(array("
        + ", ".join(
            f"if(arrays_overlap(rule_types, {sql_array(c[6])}), {quote(c[0])}, null)" for c in fv.CAMPAIGNS
        )
        + "), x -> x is not null)"
    )
    rows = found.select(
        "stmt_key", (-severity_rank(F.col("severity"))).alias("o_sev"), (-F.col("issue_count")).alias("o_issues"),
        F.col("score").alias("o_score"), "stmt_id", once(ids).alias("ids"),
    )
    return rows.where(F.size("ids") > 0)


def campaign_findings(found: DataFrame) -> DataFrame:
    """All findings of each campaign, one row each, with the keys of the finding order."""
    return _membership(found).select(F.explode("ids").alias("campaign_id"), "stmt_key", *_ORDER)


def campaigns(found: DataFrame, locations: DataFrame) -> DataFrame:
    """REM-10: one row per campaign that has findings.

    Files and examples are the first few in finding order; row numbers above the limit are
    dropped before the shuffle.  All findings of a campaign: ``campaign_findings``.
    """
    spark = found.sparkSession
    rows = campaign_findings(found)
    counts = rows.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("sql_count"))
    first = Window.partitionBy("campaign_id").orderBy(*_ORDER)
    examples = (
        rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= fv.CAMPAIGN_EXAMPLES)
        .groupBy("campaign_id")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "stmt_id"))).alias("ex"))
        .select("campaign_id", F.col("ex.stmt_id").alias("examples"))
    )
    places = locations.where(F.trim("path") != "").groupBy("stmt_key", "path").agg(F.min("line").alias("line"))
    member = _membership(found)
    per_file = (
        hot_key_join(places, member, "stmt_key")
        .select("path", "line", *_ORDER, F.explode("ids").alias("campaign_id"))
        .groupBy("campaign_id", "path")
        .agg(F.min(F.struct(*_ORDER, "path", "line")).alias("first"))
    )
    by_first = Window.partitionBy("campaign_id").orderBy("first")
    files = (
        per_file.withColumn("rn", F.row_number().over(by_first)).where(F.col("rn") <= fv.CAMPAIGN_FILES)
        .groupBy("campaign_id")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "path"))).alias("fs"))
        .select("campaign_id", F.col("fs.path").alias("files"))
    )
    all_files = per_file.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("all_files"))
    names = ["campaign_id", "priority", "theme", "title", "summary", "evidence_level", "rules", "recommendations",
             "checklist"]
    dim = constant_frame(spark, fv.CAMPAIGNS, names)
    none = F.array().cast("array<string>")
    return (
        dim.join(counts, "campaign_id").join(examples, "campaign_id").join(files, "campaign_id", "left")
        .join(all_files, "campaign_id", "left")
        .withColumn("files", F.coalesce("files", none))
        .withColumn("file_count", F.size("files"))
        .withColumn("total_files", F.coalesce("all_files", F.lit(0).cast("long")))
        .drop("all_files")
    )


# --- summaries (REM-11..14) -----------------------------------------------------------------------------------------


def remediation_summary(task_frame: DataFrame, campaign_frame: DataFrame) -> DataFrame:
    """REM-11: one row."""
    t = task_frame.agg(
        F.count(F.lit(1)).alias("task_count"),
        F.count_if(F.col("confidence") == "CONFIRMED").alias("confirmed_count"),
        F.count_if(F.col("confidence") == "LIKELY").alias("likely_count"),
        F.count_if(F.col("confidence") == "NEEDS_REVIEW").alias("review_count"),
        F.count_if(F.col("priority") == "P0").alias("p0"),
        F.count_if(F.col("priority") == "P1").alias("p1"),
    )
    focus = fv.FIRST_PASS_FOCUS
    n = campaign_frame.agg(F.count(F.lit(1)).alias("campaign_count"))
    return t.withColumn("campaign_count", n.scalar()).select(
        "campaign_count", "task_count", "confirmed_count", "likely_count", "review_count",
        F.when(F.col("task_count") == 0, focus["NONE"]).when(F.col("p0") > 0, focus["P0"])
        .when(F.col("p1") > 0, focus["P1"]).otherwise(focus["P2"]).alias("first_pass_focus"),
    )


def tasks_by_priority(task_frame: DataFrame) -> DataFrame:
    """REM-12."""
    return task_frame.groupBy("priority").agg(F.count(F.lit(1)).alias("cnt"))


def review_counts(found: DataFrame, diagnostic_rows: DataFrame) -> DataFrame:
    """One row with the sizes of the diagnostic lists and what rules occur at all."""
    d = diagnostic_rows.agg(*[
        F.count_if(F.col("kind") == k).alias(k)
        for k in ("parse_failure", "skipped_explain", "manual_review", "explain_failure")
    ])
    f = found.agg(
        F.coalesce(F.bool_or(has_any(["SQL_INJECTION_RISK"])), F.lit(False)).alias("has_injection"),
        F.coalesce(F.bool_or(has_any(["SELECT_WITHOUT_WHERE", "ORDER_BY_WITHOUT_LIMIT"])), F.lit(False)).alias(
            "has_unbounded"),
    )
    return d.withColumn("_f", only_row(f)).select("*", "_f.*").drop("_f")


def _texts(*items: tuple) -> Column:
    return F.filter(F.array(*[F.when(test, text) for test, text in items]), lambda t: t.isNotNull())


def confidence(summary: DataFrame, counts: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """REM-14: one row: level, evidence sources, limitations."""
    one = counts.withColumn("explain_coverage", summary.select("explain_coverage").scalar())
    if schema is not None:
        one = one.withColumn("_s", only_row(schema, "ddl_detected", "missing_count")).select("*", "_s.*")
    else:
        one = one.withColumns({"ddl_detected": F.lit(False), "missing_count": F.lit(0).cast("bigint")})
    some = lambda c: F.col(c) > 0
    gaps = F.col("ddl_detected") & some("missing_count")
    s = fv.EVIDENCE_SOURCES
    clean = ~(some("parse_failure") | some("manual_review") | some("skipped_explain") | some("explain_failure")
              | some("missing_count"))
    return one.select(
        F.when(clean, "STRONG").otherwise("NEEDS_REVIEW").alias("level"),
        _texts((F.lit(True), s[0]), (some("explain_coverage"), s[1]), (F.col("ddl_detected"), s[2])).alias("sources"),
        _texts(
            (some("skipped_explain"), fv.LIMIT_EXPLAIN), (some("manual_review"), fv.LIMIT_REVIEW),
            (some("parse_failure"), fv.LIMIT_PARSE), (gaps, fv.LIMIT_SCHEMA),
        ).alias("limitations"),
    )


def executive_summary(
    found: DataFrame, summary: DataFrame, counts: DataFrame, confidence_row: DataFrame,
    project: str, schema: DataFrame | None = None,
) -> DataFrame:
    """REM-13: one row: conclusion, the three commonest rules, actions, confidence."""
    top = hotspots_by_rule(found, fv.TOP_DRIVERS).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("o"), "label", "cnt"))).alias("d")
    ).select(F.transform("d", lambda x: F.concat(x["label"], F.lit(" × "), x["cnt"].cast("string"))).alias("top_drivers"))
    one = counts.withColumns({
        "_r": only_row(summary, "risk_level", "total_issues"),
        "top_drivers": top.scalar(),
        "level": confidence_row.select("level").scalar(),
    }).select("*", "_r.*")
    if schema is not None:
        one = one.withColumn("_s", only_row(schema, "ddl_detected", "unindexed_count", "missing_count")).select("*", "_s.*")
        by_schema = F.col("ddl_detected") & ((F.col("unindexed_count") > 0) | (F.col("missing_count") > 0))
    else:
        by_schema = F.lit(False)
    actions = _texts(
        (F.col("has_injection"), fv.ACTION_DYNAMIC), (F.col("has_unbounded"), fv.ACTION_UNBOUNDED),
        (by_schema, fv.ACTION_SCHEMA),
        (~F.col("has_injection") & ~F.col("has_unbounded") & ~by_schema, fv.ACTION_BASELINE),
    )
    return one.select(
        F.concat(
            F.lit(project + " 当前 SQL 风险等级为 "), F.col("risk_level"), F.lit("，共发现 "),
            F.col("total_issues").cast("string"), F.lit(" 个问题，建议按修复战役推进。"),
        ).alias("risk_conclusion"),
        "top_drivers", actions.alias("recommended_actions"),
        F.concat(
            F.lit("证据可信度: "), F.col("level"), F.lit(" · 人工复核 "), F.col("manual_review").cast("string"),
            F.lit(" · EXPLAIN 未执行 "), F.col("skipped_explain").cast("string"),
        ).alias("confidence_summary"),
    )
