"""Small helpers to write column expressions as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quote(s: str) -> str:
    """A SQL string literal; ``${`` is cut in two, since Spark would substitute it."""
    body = s.replace("\\", "\\\\").replace("'", "\\'").replace("${", "$' '{")
    return f"'{body}'"


def sql_map(table: dict) -> str:
    return "map(" + ", ".join(f"{quote(k)}, {quote(v) if isinstance(v, str) else v}" for k, v in table.items()) + ")"


def sql_array(items: list[str]) -> str:
    return "array(" + ", ".join(quote(i) for i in items) + ")"


def any_of(test: str, items: list[str]) -> str:
    """``test`` with ``{}`` replaced by each quoted item, joined by OR."""
    return "(" + " OR ".join(test.replace("{}", quote(i)) for i in items) + ")"


def once(c: Column) -> Column:
    """Keep the optimizer from copying this expression.

    A filter on a computed column is pushed below the projection that computes it, which
    would run long regex chains again for every use.  Reading the partition id makes the
    projection one that filters do not cross; the value is unchanged.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, in a step which other filters cross.

    The step is a one-row generator: a filter on the new columns stays above it, where ``once`` would hold back
    every filter; one on the columns of ``df`` passes it and reaches the scan.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline_outer(F.array(made)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]
