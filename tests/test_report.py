import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lintlake.functions import text as tx
from lintlake.operators import dedupe as dd
from lintlake.operators import remediation as rem
from lintlake.operators import report as rp
from lintlake.operators import rules as ru
from lintlake.operators import scoring as sc
from lintlake.operators.preprocess import preprocess
from lintlake.plans import nodes as pn


def found_of(spark, rows):
    """Findings of (path, line, sql) occurrences, and their locations."""
    occ = spark.createDataFrame([(p, p.split("/")[-1], n, "SQL_FILE", s) for p, n, s in rows],
                                "path string, file_name string, line int, source_type string, sql string")
    st = preprocess(dd.dedupe(occ), True)
    return rp.findings(sc.score_linted(ru.lint(st))), dd.locations(occ)


def test_order_critical_warning_clean(spark):
    found, _ = found_of(spark, [("a", 1, "SELECT a FROM t WHERE b = 1"), ("a", 2, "SELECT a FROM t"), ("a", 3, "DELETE FROM t")])
    got = [r.severity for r in rp.order_findings(found).collect()]
    assert got == ["CRITICAL", "WARNING", "INFO"]


def test_rank_equals_one_global_row_number(spark):
    rnd = random.Random(7)
    rows = [(f"sql-{rnd.getrandbits(256):064x}", "INFO" if rnd.random() < 0.8 else rnd.choice(["CRITICAL", "WARNING"]),
             rnd.choice([0, 0, 0, 1, 2]), rnd.choice([100, 100, 85])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "stmt_id string, severity string, issue_count long, score long")
    want = {r.stmt_id: r.rn for r in df.withColumn("rn", F.row_number().over(Window.orderBy(*rp.finding_order()))).collect()}
    got = {r.stmt_id: r.finding_rank for r in rp.rank_findings(df).collect()}
    assert got == want


def test_rank_of_ids_of_any_form(spark):
    ids = ["12345678", "2", "19", "a-zzz", "b-aaa", "log-b", "", "sql-1", "é"]
    df = spark.createDataFrame([(i, "INFO", 0, 100) for i in ids], "stmt_id string, severity string, issue_count long, score long")
    got = [r.stmt_id for r in rp.rank_findings(df).orderBy("finding_rank").collect()]
    assert got == sorted(ids)


def test_hotspots_with_a_hot_statement(spark):
    """One statement stands in most places; both join forms count every place."""
    rows = [(f"f{i % 10}.sql", i, "DELETE FROM t") for i in range(400)] + [("f0.sql", 999, "SELECT * FROM x")]
    found, loc = found_of(spark, rows)
    want = [(r.label, r.cnt) for r in rp.hotspots_by_file(found, loc).orderBy(F.desc("cnt"), "label").collect()]
    assert want[0] == ("f0.sql", 42) and want[1] == ("f1.sql", 40) and len(want) == 8
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = [(r.label, r.cnt) for r in rp.hotspots_by_file(found, loc).orderBy(F.desc("cnt"), "label").collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert salted == want


def test_summary_and_caps(spark):
    found, loc = found_of(spark, [("a", i, f"DELETE FROM t{i}x") for i in range(25)] + [("b", 1, "SELECT a FROM t WHERE b = 1")])
    files = spark.createDataFrame([(7,)], "total_files long")
    one = rp.report_summary(found, files).first()
    assert (one.total_files, one.total_sql, one.unique_sql, one.issue_sql, one.clean_sql) == (7, 26, 26, 25, 1)
    assert one.critical_issues == 25 and one.risk_level == "CRITICAL" and one.score == 59 and one.parse_rate == 100.0
    three = rp.hotspots_by_severity(found).collect()
    assert {(r.label, r.cnt) for r in three} == {("CRITICAL", 25), ("WARNING", 0), ("INFO", 0)}


def test_insights_are_limited_and_diagnostics_are_whole(spark):
    rows = [("a", i, f"UPDATE t{i}x SET a = 1") for i in range(20)]
    found, _ = found_of(spark, rows)
    kinds = rp.insights(found).groupBy("kind").count().collect()
    assert {(r.kind, r["count"]) for r in kinds} == {("dangerous_dml", 6), ("skipped_explain", 6)}
    assert rp.diagnostics(found).where("kind = 'skipped_explain'").count() == 20
    plan = rp.insights(found)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_tasks_and_campaigns(spark):
    found, loc = found_of(spark, [
        ("a/A.sql", 4, "SELECT a FROM t ORDER BY ${x}"), ("b/B.sql", 2, "SELECT a FROM t"), ("c/C.sql", 1, "SELECT a,, b FROM t"),
        ("d/D.sql", 1, "SELECT a FROM t WHERE b = 1")])
    t = {r.first_path: r for r in rem.tasks(found).collect()}
    assert set(t) == {"a/A.sql", "b/B.sql", "c/C.sql"}
    assert (t["a/A.sql"].priority, t["a/A.sql"].theme, t["a/A.sql"].confidence) == ("P0", "SAFETY", "NEEDS_REVIEW")
    assert t["a/A.sql"].title == "A.sql:4 · SQL_INJECTION_RISK"
    assert (t["b/B.sql"].priority, t["b/B.sql"].repair_recipe_id) == ("P1", "unbounded-query-containment")
    assert t["c/C.sql"].campaign_id == "p2-template-review"
    c = {r.campaign_id: r for r in rem.campaigns(found, loc).collect()}
    assert c["p1-unbounded-query-containment"].files == ["b/B.sql"] and len(c) == 3
    one = rem.remediation_summary(rem.tasks(found), rem.campaign_findings(found).select("campaign_id").distinct()).first()
    assert (one.campaign_count, one.task_count) == (3, 3) and one.first_pass_focus.startswith("优先处理 P0")


def test_campaign_files_are_the_first_six(spark):
    found, loc = found_of(spark, [(f"p/{i:02d}.sql", i, "SELECT a FROM t") for i in range(30)])
    c = rem.campaigns(found, loc).first()
    assert c.files == [f"p/{i:02d}.sql" for i in range(6)] and c.file_count == 6 and c.sql_count == 1


def test_campaign_counts_all_files(spark):
    found, loc = found_of(spark, [(f"p/{i % 20:02d}.sql", i, "SELECT a FROM t") for i in range(30)])
    c = rem.campaigns(found, loc).first()
    assert (c.file_count, c.total_files) == (6, 20)
    c = rem.campaigns(found, loc.where("false")).first()
    assert (c.file_count, c.total_files) == (0, 0)


def test_json_sections(spark):
    found, loc = found_of(spark, [("a", 1, "DELETE FROM t")])
    out = rp.report_json({"findings": found.select("stmt_id", "issues"), "hotspots.byFile": rp.hotspots_by_file(found, loc),
                          "metadata": rp.metadata(spark, "p", "/x")}).collect()
    assert {(r.section, r.part) for r in out} == {("findings", ""), ("hotspots", "byFile"), ("metadata", "")}


def test_plan_issues_and_rollup(spark):
    cols = ("stmt_id string, node_no int, select_type string, access_type string, table_name string, possible_keys string, "
            "key_name string, key_len string, ref string, est_rows long, extra string")
    df = spark.createDataFrame([
        ("a", 1, None, "all", "t", None, None, None, None, 20000, "Using temporary; Using filesort"),
        ("b", 1, None, "ref", None, None, "NULL", None, None, None, None),
        ("c", 1, None, "ref", "t", None, "k", None, None, 5, "Using where")], cols)
    got = {}
    for r in pn.plan_issues(df).collect():
        got.setdefault(r.stmt_id, []).append((r.type, r.severity))
    assert sorted(got["a"]) == [("FULL_TABLE_SCAN", "CRITICAL"), ("HIGH_ROWS", "WARNING"), ("NO_INDEX_USED", "WARNING"),
                                ("USING_FILESORT", "WARNING"), ("USING_TEMPORARY", "WARNING")]
    assert got["b"] == [("NO_INDEX_USED", "INFO")] and "c" not in got
    roll = {r.stmt_id: (r.plan_severity, r.explain_issues, r.total_rows) for r in pn.plan_rollup(df).collect()}
    assert roll == {"a": ("CRITICAL", 5, 20000), "b": ("INFO", 1, 0), "c": ("INFO", 0, 5)}


def test_store(spark, tmp_path):
    from lintlake.sources.store import ResultStore

    store = ResultStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("sql-a", "p/1"), ("sql-b", "p/2")], "stmt_id string, first_path string")
    store.write("st", df, "one")
    store.write("st", df.limit(1), "two")
    store.write("st", df.where("stmt_id = 'sql-b'"), "one")
    assert store.read("st", "one").count() == 1 and store.read("st").count() == 2
    assert store.exists("st", "sql-b") and not store.exists("st", "sql-z")
    assert store.by_hash("st", "a").count() == 1 and store.by_path("st", "p/2").count() == 1
    assert store.known("st", df).count() == 2
    assert store.delete_scan("st", "two") and store.read("st").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    from lintlake.streaming.log_lint import lint_stream, write_issues

    rows = [(i, t) for i, t in enumerate(["SELECT * FROM users", "update:sku:1:2", "DELETE FROM t", "SELECT a FROM t WHERE b = 1"])]
    df = spark.createDataFrame(rows, "id long, q string")
    df.write.parquet(str(tmp_path / "in"))
    stream = lint_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "q", "id")
    write_issues(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.stmt_id, r.rule_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = ru.evaluate(df.select(F.col("id").alias("stmt_id"), F.col("q").alias("original_sql"), tx.normalize(F.col("q")).alias("norm")))
    assert got == {(r.stmt_id, r.rule_id) for r in batch.collect()}
    assert got == {(0, "select-star"), (0, "missing-where"), (2, "delete-update-no-where")}
