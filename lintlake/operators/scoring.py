"""Severity, score and score explanation of statements; issue totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text as tx


def severity_rank(c: Column) -> Column:
    return F.when(c == "CRITICAL", 3).when(c == "WARNING", 2).when(c == "INFO", 1).otherwise(0)


def severity_name(rank: Column) -> Column:
    return F.when(rank == 3, "CRITICAL").when(rank == 2, "WARNING").otherwise("INFO")


def known_severity(c: Column) -> Column:
    """Anything but CRITICAL and WARNING counts as INFO."""
    s = F.upper(tx.strip(c))
    return F.when(s.isin("CRITICAL", "WARNING"), s).otherwise("INFO")


def score_of(critical: Column, warning: Column, info: Column) -> Column:
    d = fv.DEDUCTION
    return F.greatest(
        F.lit(0), F.lit(fv.BASE_SCORE) - critical * d["CRITICAL"] - warning * d["WARNING"] - info * d["INFO"]
    )


def _explanation(critical: Column, warning: Column, info: Column, rules: Column) -> Column:
    def part(word: str, n: Column, each: int) -> Column:
        return F.when(
            n > 0,
            F.concat(F.lit(f"{word} "), n.cast("string"), F.lit(f"x{each}=-"), (n * each).cast("string")),
        )

    d = fv.DEDUCTION
    total = critical + warning + info
    deduction = critical * d["CRITICAL"] + warning * d["WARNING"] + info * d["INFO"]
    return F.concat_ws(
        "；",
        F.lit(f"基础分 {fv.BASE_SCORE}"),
        F.when(total == 0, "未触发规则"),
        part("严重", critical, d["CRITICAL"]),
        part("警告", warning, d["WARNING"]),
        part("提示", info, d["INFO"]),
        F.when(total > 0, F.concat(F.lit("规则 "), rules)),
        F.when(total > 0, F.concat(F.lit("总扣分 "), deduction.cast("string"))),
        F.concat(F.lit("最终得分 "), score_of(critical, warning, info).cast("string")),
    )


def _times(name: Column, n: Column) -> Column:
    return F.concat(tx.label(name), F.when(n > 1, F.concat(F.lit("x"), n.cast("string"))).otherwise(""))


def score_linted(linted: DataFrame) -> DataFrame:
    """AGG-2..4 on statements that carry their issues: a projection, no shuffle."""
    i = F.col("issues")
    count = lambda s: F.size(F.filter(i, lambda x: x["severity"] == s)).cast("bigint")
    step = linted.withColumns({
        "critical_count": count("CRITICAL"),
        "warning_count": count("WARNING"),
        "info_count": count("INFO"),
    })
    c, w, n = F.col("critical_count"), F.col("warning_count"), F.col("info_count")
    names = F.transform(i, lambda x: x["rule_name"])
    rules = F.array_join(
        F.transform(F.array_distinct(names), lambda x: _times(x, F.size(F.filter(names, lambda y: y == x)))), ", "
    )
    return step.withColumns({
        "issue_count": c + w + n,
        "severity": F.when(c > 0, "CRITICAL").when(w > 0, "WARNING").otherwise("INFO"),
        "score": score_of(c, w, n),
        "score_explanation": _explanation(c, w, n, rules),
    })


def score(stmts: DataFrame, issues: DataFrame) -> DataFrame:
    """AGG-2..4 for an issue frame of any origin: (stmt_id, severity, score, score_explanation).

    Issues are first counted per (statement, rule), which combines in the map tasks; the
    second grouping holds one row per rule of a statement.
    """
    sev = known_severity(F.col("severity"))
    per_rule = issues.groupBy("stmt_id", "rule_name").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(sev == s).alias(s) for s in fv.SEVERITIES],
        F.min("issue_no").alias("first_no"),
    )
    per_stmt = per_rule.groupBy("stmt_id").agg(
        *[F.sum(s).alias(s) for s in fv.SEVERITIES],
        F.array_sort(F.collect_list(F.struct("first_no", "rule_name", "n"))).alias("rules"),
    )
    joined = stmts.select("stmt_id").join(per_stmt, "stmt_id", "left")
    c, w, n = [F.coalesce(F.col(s), F.lit(0)) for s in fv.SEVERITIES]
    rules = F.array_join(F.transform("rules", lambda x: _times(x["rule_name"], x["n"])), ", ")
    return joined.select(
        "stmt_id",
        F.when(c > 0, "CRITICAL").when(w > 0, "WARNING").otherwise("INFO").alias("severity"),
        score_of(c, w, n).alias("score"),
        _explanation(c, w, n, rules).alias("score_explanation"),
    )


def issue_summary(issues: DataFrame) -> DataFrame:
    """AGG-1: issues by rule name."""
    return issues.groupBy("rule_name").agg(F.count(F.lit(1)).alias("cnt"))


def issue_totals(issues: DataFrame) -> DataFrame:
    """AGG-1: totals by severity, one row."""
    sev = known_severity(F.col("severity"))
    return issues.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(sev == s).alias(s.lower()) for s in fv.SEVERITIES]
    )


def static_counts(issues: DataFrame) -> DataFrame:
    """AGG-24: issues of each statement by severity."""
    return issues.groupBy("stmt_id").agg(
        F.count(F.lit(1)).alias("issue_count"),
        *[F.count_if(F.col("severity") == s).alias(f"{s.lower()}_count") for s in fv.SEVERITIES],
    )
