"""Rule configuration as a table: (rule_id, enabled, severity, exceptions, params).

``lint(config=...)`` applies all of it in the statement's own row.  The functions here do
the same to an issue frame of any origin; the configuration side is joined by rule id, with hot
rules split at run time (``hot_key_join``).  Where a rule has several rows, ``one_per_rule`` says what holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.sizing import hot_key_join


def one_per_rule(config: DataFrame) -> DataFrame:
    """One row for each rule: off when any row switches it off, all exceptions, the smallest severity name and value of a parameter given."""
    pairs = F.flatten(F.collect_list(F.coalesce(F.map_entries("params"), F.array().cast("array<struct<key:string,value:string>>"))))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    params = F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_min(F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]))))
    return config.where("rule_id IS NOT NULL").groupBy("rule_id").agg(
        F.min(F.coalesce("enabled", F.lit(True))).alias("enabled"), F.min("severity").alias("severity"),
        F.array_distinct(F.flatten(F.collect_list(F.coalesce("exceptions", F.array().cast("array<string>"))))).alias("exceptions"), params.alias("params"))


def drop_disabled(issues: DataFrame, config: DataFrame) -> DataFrame:
    """CFG-1: anti join with the rules that are switched off."""
    off = config.where(~F.coalesce(F.col("enabled"), F.lit(True))).select("rule_id").distinct()
    return hot_key_join(issues, off, "rule_id", "left_anti")


def drop_excepted(issues: DataFrame, stmts: DataFrame, config: DataFrame, sql_col: str = "norm") -> DataFrame:
    """CFG-2: drop an issue when its statement contains a text listed for its rule.

    The list is joined by rule id and tested in the row, so no pair of issue and text is
    ever made.  Only issues of rules with a list carry a key that meets a statement; the
    others pass the same join unmatched, spread over the tasks, so the issues are made once.
    """
    listed = config.where(F.size("exceptions") > 0).select("rule_id", "exceptions")
    has_list = F.col("exceptions").isNotNull()
    marked = hot_key_join(issues, listed, "rule_id", "left").withColumn(
        "_meets", F.struct(has_list.alias("listed"), F.col("stmt_id").alias("id")))
    texts = stmts.select(F.struct(F.lit(True).alias("listed"), F.col("stmt_id").alias("id")).alias("_meets"), F.col(sql_col).alias("_sql"))
    named = F.exists("exceptions", lambda e: (e != "") & F.coalesce(F.contains(F.col("_sql"), e), F.lit(False)))
    return marked.join(texts, "_meets", "left").where(~has_list | ~named).select(*issues.columns)


def override_severity(issues: DataFrame, config: DataFrame) -> DataFrame:
    """CFG-4."""
    given = config.where(F.col("severity").isNotNull()).select("rule_id", F.col("severity").alias("_given"))
    joined = hot_key_join(issues, given, "rule_id", "left")
    return joined.withColumn("severity", F.coalesce("_given", "severity")).select(*issues.columns)


def apply_config(issues: DataFrame, stmts: DataFrame, config: DataFrame, sql_col: str = "norm") -> DataFrame:
    """CFG-1, CFG-2 and CFG-4 in turn."""
    return override_severity(drop_excepted(drop_disabled(issues, config), stmts, config, sql_col), config)
