"""Joins that stand hot keys, and small fixed or one-row frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.sqltext import once


def hot_key_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join a frame whose keys may be hot with one that has each key once.

    Spark splits the large partition of a hot key at run time (AQE skew join) where both
    sides are shuffled for the join.  A right side that comes straight from a grouping by the
    key would be joined in the grouping's partitions instead, which cannot be split, so its
    key passes an expression that hides them.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"the left side cannot be split in this join: {how}")
    return left.join(right.withColumn(key, once(F.col(key))), key, how)


def only_row(df: DataFrame, *columns: str) -> Column:
    """The single row of an aggregated frame as a struct column (a scalar subquery, run once)."""
    return df.select(F.struct(*(columns or df.columns)).alias("row")).scalar()


def constant_frame(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A frame of fixed rows made inside the plan; its size is that of the code."""

    def lit(v):
        if isinstance(v, list):
            return F.array(*[lit(x) for x in v])
        return F.lit(v)

    structs = [F.struct(*[lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
