from lintlake.operators import schema as sch

DDL = """-- seats of all halls
CREATE TABLE seat (hall INT NOT NULL, row_no INT, price DECIMAL(8, 2), sold_on DATE, buyer TEXT,
  CONSTRAINT seat_pk PRIMARY KEY (hall), INDEX by_row (row_no, price));
"""


def frames(spark, ddl, sqls):
    files = spark.createDataFrame([(f"f{i}.sql", d) for i, d in enumerate(ddl)], "path string, content string")
    st = spark.createDataFrame([(f"s{i}", "SELECT", s) for i, s in enumerate(sqls)], "stmt_id string, sql_type string, norm string")
    return st, sch.extract_ddl(files)


def test_predicates_against_indexes(spark):
    st, tables = frames(spark, [DDL], ["SELECT buyer FROM seat WHERE row_no > 3 AND buyer = 'x' ORDER BY sold_on"])
    risk = sch.schema_risks(st, tables).collect()
    assert len(risk) == 1
    assert risk[0].indexed_predicate_columns == ["row_no"] and risk[0].missing_index_columns == ["buyer", "sold_on"]
    one = sch.schema_summary(st, tables).first()
    assert (one.table_count, one.covered_count, one.unindexed_count, one.warning) == (1, 1, 1, None)


def test_table_without_ddl(spark):
    st, tables = frames(spark, ["CREATE TABLE users (id BIGINT PRIMARY KEY, name VARCHAR(64));"],
                        ["SELECT fee FROM usher WHERE badge = 7"])
    risk = sch.schema_risks(st, tables).first()
    assert (risk.risk_type, risk.table_name, risk.predicate_columns) == ("SCHEMA_GAP", "usher", ["badge"])
    assert {r.coverage for r in sch.table_coverage(st, tables).collect()} == {"DDL_ONLY", "MISSING_DDL"}


def test_only_carriers_hold_ddl(spark):
    text = "CREATE TABLE a (x INT); CREATE INDEX i ON a (x);"
    files = spark.createDataFrame([("web/m.ts", text), ("M.XML", text.replace(" a ", " b ")), ("noext", text)], "path string, content string")
    assert [r.table_key for r in sch.extract_ddl(files).collect()] == ["b"]


def test_no_ddl_reports_nothing(spark):
    st, tables = frames(spark, ["-- nothing"], ["SELECT id FROM users WHERE status = ?"])
    assert sch.schema_risks(st, tables).count() == 0
    one = sch.schema_summary(st, tables).first()
    assert not one.ddl_detected and one.missing_count == 1 and one.warning.startswith("未在扫描范围内发现")


def test_first_definition_and_separate_index(spark):
    st, tables = frames(
        spark, ["CREATE TABLE A (x INT, y INT, PRIMARY KEY (x));", "CREATE TABLE a (z INT);\nCREATE INDEX i ON a (y DESC);"], [])
    t = tables.collect()
    assert len(t) == 1 and t[0].columns == ["x", "y"] and t[0].indexed_columns == ["x", "y"]


def test_risks_of_a_hot_table(spark):
    """One table holds most statements: without broadcast the risks come from sort-merge joins whose left side can be split, with the same rows."""
    sqls = ["SELECT hall FROM seat WHERE buyer = 1"] * 300 + [f"SELECT id FROM gone{i % 3} WHERE a{i} = 1" for i in range(30)]
    st, tables = frames(spark, [DDL], sqls)
    cols = ["stmt_id", "risk_type", "table_name", "predicate_columns", "missing_index_columns"]
    plain = sorted(map(str, sch.schema_risks(st, tables).select(*cols).collect()))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        frame = sch.schema_risks(st, tables).select(*cols)
        merged = sorted(map(str, frame.collect()))
        plan = frame._jdf.queryExecution().sparkPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert len(plain) == 330 and plain == merged
    joins = [line for line in plan.splitlines() if "Join" in line]
    # the kinds whose left side may be split; a right or full outer join could not be
    assert joins and all("SortMergeJoin" in j and any(kind in j for kind in ("Inner", "LeftOuter", "LeftSemi", "LeftAnti")) for j in joins)


def test_aliases_belong_to_their_select(spark):
    sqls = [
        "SELECT a.x FROM t a WHERE EXISTS (SELECT 1 FROM u a WHERE a.y = 1)",
        "SELECT a.x FROM t a UNION SELECT a.y FROM u a",
        "SELECT d.q FROM (SELECT x FROM t WHERE y = '(SELECT') d WHERE n = 3",
        "INSERT INTO t (a, b) SELECT c, d FROM u WHERE e IN (SELECT f FROM g)",
        "SELECT x FROM t WHERE k IN (SELECT k2 FROM u WHERE EXISTS (SELECT 1 FROM w a WHERE a.i = u.j AND l = 3",
    ]
    want = [
        {("t", "x"), ("t", None), ("u", "y"), ("u", None)},
        {("t", "x"), ("t", None), ("u", "y"), ("u", None)},
        {("d", "q"), ("t", "x"), ("t", "y"), ("t", None)},
        {("t", "a"), ("t", "b"), ("t", None)},
        {("t", "x"), ("t", "k"), ("t", None), ("u", "k2"), ("u", "j"), ("u", None), ("w", "i"), ("w", "l"), ("w", None)},
    ]
    for sql, cells in zip(sqls, want):
        one = spark.createDataFrame([("s", sql)], "stmt_id string, norm string")
        assert {(r.table_name, r["column"]) for r in sch.infer_columns(one).collect()} == cells, sql


def test_scopes_of_null_and_deep_statements(spark):
    deep = "SELECT a FROM t0" + "".join(f" WHERE a IN (SELECT a FROM t{i}" for i in range(1, 60)) + ")" * 59
    df = spark.createDataFrame([(1, None), (2, ""), (3, deep)], "stmt_id int, norm string")
    got = {(r.table_name, r["column"]) for r in sch.infer_columns(df).collect()}
    assert got == {(f"t{i}", c) for i in range(60) for c in ("a", None)}
