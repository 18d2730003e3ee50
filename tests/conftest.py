import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lintlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(partitions=4)


@pytest.fixture
def rows(spark):
    """Rows of one column expression over a list of texts."""
    from pyspark.sql import functions as F

    def run(texts, build):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r.v for r in df.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]

    return run


@pytest.fixture
def stmts(spark):
    """Statements with an id, ready for the rules."""
    from pyspark.sql import functions as F

    from lintlake.functions import text as tx
    from lintlake.operators.preprocess import preprocess

    def make(texts, source="SQL_FILE"):
        df = spark.createDataFrame(
            [(f"s{i}", t, source, f"f{i}.sql") for i, t in enumerate(texts)],
            "stmt_id string, original_sql string, source_type string, first_file string")
        return preprocess(df, explain_enabled=True).withColumn("sql_type", tx.sql_type(F.col("original_sql")))

    return make
