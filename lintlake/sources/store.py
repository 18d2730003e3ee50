"""OUT-2: results as Parquet tables partitioned by scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ResultStore:
    """Tables below a root folder that all executors see.

    Writing a scan again replaces that scan only; a lookup by scan reads one partition, other
    lookups push their filter into the Parquet scan.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, table: str, df: DataFrame, scan_id: str) -> None:
        (
            df.withColumn("scan_id", F.lit(scan_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("scan_id")
            .parquet(self.path(table))
        )

    def read(self, table: str, scan_id: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path(table))
        return df if scan_id is None else df.where(F.col("scan_id") == scan_id)

    def by_id(self, table: str, stmt_id: str) -> DataFrame:
        return self.read(table).where(F.col("stmt_id") == stmt_id)

    def by_hash(self, table: str, sql_hash: str) -> DataFrame:
        return self.by_id(table, f"sql-{sql_hash}")

    def by_path(self, table: str, path: str, column: str = "first_path") -> DataFrame:
        return self.read(table).where(F.col(column) == path)

    def exists(self, table: str, stmt_id: str) -> bool:
        return not self.by_id(table, stmt_id).isEmpty()

    def known(self, table: str, ids: DataFrame) -> DataFrame:
        """Those of ``ids`` (stmt_id) which the table holds."""
        return ids.join(self.read(table).select("stmt_id"), "stmt_id", "left_semi")

    def delete_scan(self, table: str, scan_id: str) -> bool:
        """Remove one partition folder."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/scan_id={scan_id}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = fs.delete(folder, True)
        self.spark.catalog.refreshByPath(self.path(table))
        return bool(gone)
