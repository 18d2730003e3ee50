"""PRE-13: the preprocess record of each statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text as tx
from lintlake.functions.sqltext import with_computed
from lintlake.plans.guard import with_guard


def preprocess(stmts: DataFrame, explain_enabled: bool = False) -> DataFrame:
    """Add category, norm, masked, parsed, validity, eligibility, explain_sql, reason.

    ``norm`` is the text to analyse: the normalised statement without comments, repaired only when its
    shape is not valid.  Every step is a projection.
    """
    sql = F.col("original_sql")
    kept = [F.col(c) for c in stmts.columns]
    step1 = stmts.select(
        *kept,
        tx.sql_category(sql, F.col("source_type")).alias("category"),
        tx.normalize(tx.without_comments(sql)).alias("_plain"),
        F.coalesce(sql.contains("${"), F.lit(False)).alias("_dollar"),
    )
    step2 = step1.withColumn("_plain_mask", tx.masked(F.col("_plain")))
    step3 = with_computed(step2, _plain_ok=tx.shape_of_masked(F.col("_plain_mask")))
    template = F.col("category").isin(*tx.TEMPLATE_CATEGORIES) & ~F.col("_plain_ok")
    concat = F.col("category").isin(*tx.CONCAT_CATEGORIES) & ~F.col("_plain_ok")
    fixed = step3.withColumn("_fixed", F.when(template, tx.fix_template(F.col("_plain"))).otherwise(F.col("_plain")))
    step4 = fixed.withColumn("norm", F.when(concat, tx.fix_concat(F.col("_fixed"))).otherwise(F.col("_fixed")))
    step5 = step4.withColumn(
        "masked", F.when(F.col("_plain_ok"), F.col("_plain_mask")).otherwise(tx.masked(F.col("norm")))
    )
    step6 = with_computed(step5, parsed=F.col("_plain_ok") | tx.shape_of_masked(F.col("masked")))
    blank = tx.is_blank(sql)
    base_reason = F.when(
        ~F.col("parsed"), F.when(F.col("_dollar"), fv.REASON_DOLLAR).otherwise(fv.REASON_UNPARSED)
    )
    validity = (
        F.when(blank | F.col("_dollar"), "UNKNOWN").when(F.col("parsed"), "VALID").otherwise("INVALID")
    )
    if not explain_enabled:
        out = step6.select(
            *kept, "category", "norm", "masked", "parsed",
            validity.alias("validity"),
            F.lit("SKIPPED").alias("eligibility"),
            F.lit(None).cast("string").alias("explain_sql"),
            F.when(blank, fv.REASON_EMPTY).otherwise(base_reason).alias("reason"),
        )
        return out
    step7 = with_guard(step6, "norm", "_g_")
    reason = (
        F.when(blank, fv.REASON_EMPTY)
        .when(
            F.col("_dollar") & F.col("_g_reason").isNotNull(),
            F.concat(F.col("_g_reason"), F.lit(fv.REASON_DOLLAR_SUFFIX)),
        )
        .otherwise(F.coalesce(base_reason, F.col("_g_reason")))
    )
    return step7.select(
        *kept, "category", "norm", "masked", "parsed",
        validity.alias("validity"),
        F.when(blank, "SKIPPED").otherwise(F.col("_g_eligibility")).alias("eligibility"),
        F.when(~blank, F.col("_g_explain_sql")).alias("explain_sql"),
        reason.alias("reason"),
    )


def select_blocks(stmts: DataFrame, sql_col: str = "norm") -> DataFrame:
    """PRE-12 in long form: (stmt_id, block_no, block)."""
    with_mask = stmts.select("stmt_id", tx.masked(F.col(sql_col)).alias("_m"))
    return with_mask.select("stmt_id", F.posexplode(tx.select_blocks(F.col("_m"))).alias("block_no", "block"))


def statements_from_log(log: DataFrame, sql_col: str, source_type: str = "SQL_FILE") -> DataFrame:
    """SRC-7: rows of a query log as occurrences; other columns give place and line where present."""
    have = set(log.columns)

    def pick(name: str, default):
        return (F.col(name) if name in have else default).alias(name)

    rows = log.select(
        pick("path", F.lit("query-log")),
        pick("file_name", F.lit("query-log")),
        pick("line", F.lit(1)),
        pick("source_type", F.lit(source_type)),
        F.col(sql_col).alias("sql"),
        *[F.col(c) for c in ("occ_id",) if c in have],
    )
    return rows.where(tx.looks_like_sql(F.col("sql")))
