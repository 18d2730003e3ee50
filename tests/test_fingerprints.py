"""Fingerprints kept over scans, and made once."""

from pyspark.sql import functions as F

from lintlake.operators import dedupe as dd

COLS = "path string, file_name string, line int, source_type string, sql string"
FIRST = [("b.sql", "b.sql", 3, "SQL_FILE", "SELECT a FROM t WHERE id = 5"), ("b.sql", "b.sql", 9, "SQL_FILE", "DELETE FROM t")]
LATER = [("a.sql", "a.sql", 7, "SQL_FILE", "select a from T where ID = 77"), ("c.sql", "c.sql", 1, "SQL_FILE", "DROP TABLE t")]


def test_two_ingests_equal_one(spark, tmp_path):
    one, two = spark.createDataFrame(FIRST, COLS), spark.createDataFrame(LATER, COLS)
    dd.FingerprintState(spark, f"{tmp_path}/s").ingest(one, "a")
    again = dd.FingerprintState(spark, f"{tmp_path}/s").ingest(two, "b").ingest(two, "b")
    want = {str(r) for r in dd.dedupe(one.unionByName(two)).collect()}
    assert {str(r) for r in again.statements().collect()} == want
    assert again.stats().first() == dd.dedup_stats(one.unionByName(two)).first()
    small = again.compacted(f"{tmp_path}/t")
    assert {str(r) for r in small.statements().collect()} == want and small.state().count() == 3
    more = small.ingest(one, "again")
    assert more.stats().first().total == 6 and more.stats().first().uniq == 3


def test_an_empty_batch(spark, tmp_path):
    state = dd.FingerprintState(spark, f"{tmp_path}/s").ingest(spark.createDataFrame([], COLS), "none")
    assert state.statements().count() == 0 and state.stats().first().total == 0


def test_a_stored_key_is_not_made_again(spark, tmp_path):
    occ = spark.createDataFrame(FIRST + LATER, COLS)
    dd.keyed(occ).write.parquet(f"{tmp_path}/occ")
    stored = spark.read.parquet(f"{tmp_path}/occ")
    for frame in (dd.locations(stored), dd.dedup_stats(stored), dd.first_and_count(stored)):
        assert "sha2" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert {str(r) for r in dd.dedupe(stored).collect()} == {str(r) for r in dd.dedupe(occ).collect()}
    assert {r.stmt_key for r in dd.locations(stored).collect()} == {r.stmt_key for r in dd.dedupe(occ).collect()}


def test_explain_types_come_with_the_rollup(spark):
    from lintlake.plans import nodes as pn

    cols = "stmt_id string, node_no int, access_type string, table_name string, key_name string, est_rows long, extra string"
    df = spark.createDataFrame([
        ("a", 2, "all", "t", None, 20000, "Using filesort"), ("a", 1, "all", "u", "k", 5, None), ("c", 1, "ref", "t", "k", 5, None)], cols)
    got = {r.stmt_id: r.explain for r in pn.plan_rollup(df, with_types=True).collect()}
    assert [(e.first_no, e.type, e.n) for e in got["a"]] == [
        (5, "FULL_TABLE_SCAN", 2), (11, "NO_INDEX_USED", 1), (12, "HIGH_ROWS", 1), (14, "USING_FILESORT", 1)]
    assert got["a"][0].message.endswith(": 5") and got["c"] == []
    issues = pn.plan_issues(df).where("stmt_id = 'a'").groupBy("type").agg(F.min("issue_no").alias("no"), F.count("*").alias("n"))
    assert {(r.no, r.type, r.n) for r in issues.collect()} == {(e.first_no, e.type, e.n) for e in got["a"]}
