"""Light analyses beside the rules: quick static checks and expert advice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions.sqltext import once, quote


def _found(*items: tuple) -> str:
    """SQL array of (test, struct fields) pairs whose test holds."""
    cells = []
    for test, fields in items:
        body = ", ".join(f"'{k}', {v}" for k, v in fields.items())
        cells.append(f"if({test}, named_struct({body}), null)")
    return f"filter(array({', '.join(cells)}), x -> x is not null)"


def quick_static(stmts: DataFrame, sql_col: str = "norm") -> DataFrame:
    """RUL-25: three checks, a score and a syntax test on leading keywords."""
    issue = lambda t, s, m, n, d: {
        "type": quote(t), "severity": quote(s), "message": quote(m), "suggestion": quote(n), "deduction": str(d)}
    checks = _found(
        ("contains(u, 'SELECT *')",
         issue("SELECT_STAR", "WARNING", "使用了 SELECT *，可能导致不必要的列查询", "明确列出需要的列名", 10)),
        ("contains(u, 'SELECT') AND NOT contains(u, 'WHERE') AND NOT contains(u, 'LIMIT')",
         issue("SELECT_WITHOUT_WHERE", "WARNING", "缺少 WHERE 子句可能导致全表扫描", "添加 WHERE 条件或 LIMIT 限制", 20)),
        (f"u RLIKE {quote(fv.LIKE_WILDCARD_ANY_QUOTE)}",
         issue("LIKE_LEADING_WILDCARD", "CRITICAL", "LIKE 以通配符开头无法使用索引", "考虑使用全文索引或反向索引", 30)),
    )
    step = stmts.select("stmt_id", F.upper(sql_col).alias("u")).select("stmt_id", "u", once(F.expr(checks)).alias("issues"))
    total = F.expr("aggregate(issues, 0, (a, i) -> a + i.deduction)")
    return step.select(
        "stmt_id", "issues",
        F.greatest(F.lit(0), fv.BASE_SCORE - total).alias("score"),
        F.when(F.exists("issues", lambda i: i["severity"] == "CRITICAL"), "CRITICAL")
        .when(F.size("issues") > 0, "WARNING").otherwise("INFO").alias("severity"),
        F.col("u").rlike(r"^(SELECT|INSERT|UPDATE|DELETE)").alias("valid_syntax"),
    )


def expert_advice(stmts: DataFrame, sql_col: str = "norm") -> DataFrame:
    """RUL-26: recommendations with priority, score and severity of each statement."""
    tip = lambda t, title, d, s, b, p: {
        "type": quote(t), "title": quote(title), "description": quote(d), "suggestion": quote(s), "benefit": quote(b),
        "priority": str(p)}
    advice = _found(
        ("contains(u, 'SELECT *')", tip(
            "COLUMN_SPECIFICATION", "避免使用 SELECT *", "查询所有列会增加网络传输和内存消耗", "明确列出需要的列名",
            "减少 30-50% 的数据传输量", 4)),
        ("contains(u, 'ORDER BY') AND NOT contains(u, 'LIMIT')", tip(
            "PAGINATION", "添加 LIMIT 分页", "大数据量排序可能导致性能问题", "在 ORDER BY 后添加 LIMIT 限制返回行数",
            "避免大结果集排序，提升响应速度", 3)),
    )
    step = stmts.select("stmt_id", F.upper(sql_col).alias("u")).select("stmt_id", once(F.expr(advice)).alias("advice"))
    score = F.expr("100 - aggregate(advice, 0, (a, x) -> a + if(x.type = 'PAGINATION', 10, 15))")
    return step.select(
        "stmt_id", "advice", F.greatest(F.lit(0), score).alias("score"),
        F.when(score < 70, "WARNING").otherwise("INFO").alias("severity"),
    )


def explode_advice(advice: DataFrame) -> DataFrame:
    rows = advice.select("stmt_id", F.explode_outer("advice").alias("a")).where(F.col("a").isNotNull())
    return rows.select("stmt_id", "a.*")


def high_priority(advice: DataFrame) -> DataFrame:
    """AGG-25: advice of priority 4 and more."""
    return explode_advice(advice).where(F.col("priority") >= 4)


def expert_context(stmts: DataFrame, issues: DataFrame, explain: DataFrame) -> DataFrame:
    """RUL-27: advice from the numbers of static and plan issues; both are counted before the joins."""
    n_static = issues.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("static_issues"))
    n_plan = explain.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("explain_issues"))
    joined = stmts.select("stmt_id").join(n_static, "stmt_id", "left").join(n_plan, "stmt_id", "left")
    static, plan = F.coalesce("static_issues", F.lit(0)), F.coalesce("explain_issues", F.lit(0))
    score = 100 - F.when(static > 0, 20).otherwise(0) - F.when(plan > 0, 30).otherwise(0)
    return joined.select(
        "stmt_id", static.alias("static_issues"), plan.alias("explain_issues"), score.alias("score"),
        F.when(score < 60, "CRITICAL").when(score < 80, "WARNING").otherwise("INFO").alias("severity"),
    )
