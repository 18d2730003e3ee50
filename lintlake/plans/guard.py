"""EXP-1: may this statement be explained, and with which text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text as tx
from lintlake.functions.sqltext import with_computed

GUARD_COLUMNS = ["explain_sql", "eligibility", "reason", "changed"]


def with_guard(df: DataFrame, sql_col: str, prefix: str = "") -> DataFrame:
    """Add explain_sql, eligibility, reason and changed for one text column.

    The texts are made in one projection and judged in the next, so no pattern runs twice.
    """
    sql = F.col(sql_col)
    trimmed = tx.strip(sql)
    marked = F.regexp_replace(F.regexp_replace(sql, fv.INCLUDE_MARK, "*"), fv.BIND_MARK, "")
    texts = df.withColumns({
        "_t": trimmed,
        "_target": tx.strip(F.regexp_replace(trimmed, r"(?is)^\s*EXPLAIN\s+(?:\([^)]*\)\s*)?", "")),
        "_marked": marked,
    })
    verbs = "|".join(fv.MUTATING_KEYWORDS)
    bound = F.regexp_replace(F.col("_marked"), fv.IN_HASH_PAREN, "IN (1)")
    bound = F.regexp_replace(F.regexp_replace(bound, fv.IN_HASH, "IN (1)"), fv.HASH_PARAM, "1")
    tests = texts.withColumns({
        "_blank": tx.is_blank(F.col("_t")),
        "_mutating": F.col("_target").rlike(rf"(?is)^(?:{verbs})|^WITH\b.*\)\s*(?:{verbs})\b"),
        "_readable": F.col("_t").rlike("(?i)^(?:SELECT|WITH|EXPLAIN)"),
        "_has_dollar": F.col("_marked").rlike(fv.DOLLAR_PARAM),
        "_bound": bound,
    })
    reason = (
        F.when(F.col("_blank"), fv.REASON_EMPTY)
        .when(F.col("_mutating"), fv.REASON_MUTATING)
        .when(~F.col("_readable"), fv.REASON_NOT_READONLY)
        .when(F.col("_has_dollar"), fv.REASON_EXPLAIN_DOLLAR)
    )
    judged = with_computed(tests, _reason=reason)
    ok = F.col("_reason").isNull()
    return judged.withColumns({
        f"{prefix}explain_sql": F.when(ok, F.col("_bound")),
        f"{prefix}eligibility": F.when(F.col("_blank"), "SKIPPED").when(ok, "SUPPORTED").otherwise("NOT_SUPPORTED"),
        f"{prefix}reason": F.col("_reason"),
        f"{prefix}changed": F.when(F.col("_blank") | F.col("_mutating") | ~F.col("_readable"), False)
        .when(F.col("_has_dollar"), F.col("_marked") != sql)
        .otherwise(F.col("_bound") != sql),
    }).drop("_t", "_target", "_marked", "_blank", "_mutating", "_readable", "_has_dollar", "_bound", "_reason")


def explain_guard(stmts: DataFrame, sql_col: str = "norm") -> DataFrame:
    return with_guard(stmts, sql_col)
