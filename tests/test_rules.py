import pytest
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.operators import config as cfg
from lintlake.operators import rules as ru
from lintlake.operators import scoring as sc


def found(stmts, texts, **kw):
    out = {i: set() for i in range(len(texts))}
    for r in ru.evaluate(stmts(texts), **kw).collect():
        out[int(r.stmt_id[1:])].add(r.rule_id)
    return [out[i] for i in range(len(texts))]


def test_exact_rule_sets(stmts):
    texts = ["SELECT * FROM users", "SELECT * FROM users WHERE name LIKE '%test'",
             "SELECT id FROM users ORDER BY created_at"]
    assert found(stmts, texts) == [
        {"select-star", "missing-where"}, {"select-star", "like-leading-wildcard"},
        {"missing-where", "orderby-without-limit"}]


CASES = [
    ("select-star", ["SELECT t.* FROM t WHERE a = 1", "SELECT a, * FROM t WHERE a = 1"], ["SELECT COUNT(*) FROM t WHERE a = 1"]),
    ("missing-where", ["SELECT a FROM t"], ["SELECT a FROM t LIMIT 3", "SELECT a FROM t WHERE b = 1"]),
    ("like-leading-wildcard", ["SELECT a FROM t WHERE b LIKE '%x'"], ["SELECT a FROM t WHERE b LIKE '%'", "SELECT a FROM t WHERE b LIKE 'x%'"]),
    ("orderby-without-limit", ["SELECT a FROM t WHERE b = 1 ORDER BY a"],
     ["SELECT a FROM t WHERE b = 1 ORDER BY 1", "SELECT a FROM t WHERE b = 1 ORDER BY a LIMIT 1"]),
    ("function-on-indexed-column", ["SELECT a FROM t WHERE UPPER(b) = 'X'"], ["SELECT UPPER(a) FROM t WHERE b = 'X'"]),
    ("having-without-where", ["SELECT a FROM t GROUP BY a HAVING COUNT(*) > 1"], ["SELECT a FROM t WHERE b = 1 GROUP BY a HAVING COUNT(*) > 1"]),
    ("implicit-join", ["SELECT a.x FROM a, b WHERE a.i = b.i"], ["SELECT a.x FROM a JOIN b ON a.i = b.i WHERE a.x IN (1, 2)"]),
    ("multi-column-or", ["SELECT a FROM t WHERE b = 1 OR c = 2"], ["SELECT a FROM t WHERE b = 1 OR b = 2"]),
    ("multi-column-in", ["SELECT a FROM t WHERE (b, c) IN (SELECT x, y FROM z)"], ["SELECT a FROM t WHERE b IN (SELECT x FROM z)"]),
    ("in-subquery", ["SELECT a FROM t WHERE b IN (SELECT x FROM z)"], ["SELECT a FROM t WHERE b IN (1, 2)"]),
    ("not-in", ["SELECT a FROM t WHERE b NOT IN (1, 2)"], ["SELECT a FROM t WHERE b = 'NOT IN'"]),
    ("null-comparison", ["SELECT a FROM t WHERE b = NULL", "SELECT a FROM t WHERE b <> NULL"], ["SELECT a FROM t WHERE b IS NULL"]),
    ("unnecessary-distinct", ["SELECT DISTINCT a FROM t JOIN u ON t.i = u.i WHERE a = 1", "SELECT DISTINCT a FROM t WHERE b = 1 GROUP BY a"],
     ["SELECT DISTINCT a FROM t WHERE b = 1"]),
    ("complex-subquery", ["SELECT a FROM t WHERE b = ((((1))))"], ["SELECT a FROM t WHERE b = (((1))) AND c = (2)"]),
    ("insert-without-columns", ["INSERT INTO t VALUES (1)", "INSERT INTO t SELECT 1"], ["INSERT INTO t (a) VALUES (1)"]),
    ("delete-update-no-where", ["DELETE FROM t", "UPDATE t SET a = 1"], ["DELETE FROM t WHERE a = 1"]),
    ("dangerous-drop-truncate", ["DROP TABLE t", "TRUNCATE TABLE t"], ["SELECT a FROM t WHERE b = 1"]),
    ("long-sql-statement", ["SELECT " + "a, " * 200 + "b FROM t WHERE c = 1"], ["SELECT a FROM t WHERE b = 1"]),
    ("magic-numbers", ["SELECT a FROM t WHERE b = 18 AND c > 50000"], ["SELECT a FROM t WHERE b = 18 LIMIT 100 OFFSET 200", "SELECT a FROM t WHERE b = 1 AND c = 2"]),
]


def test_every_rule_has_hits_and_misses(stmts):
    texts = [t for _, yes, no in CASES for t in yes + no]
    got = iter(found(stmts, texts, profile="rules"))
    for rule, yes, no in CASES:
        for t in yes:
            assert rule in next(got), (rule, t)
        for t in no:
            assert rule not in next(got), (rule, t)
    assert {c[0] for c in CASES} == {r[0] for r in fv.RULE_CATALOGUE}


def test_not_equal_null_gives_both_messages(stmts):
    got = ru.evaluate(stmts(["SELECT a FROM t WHERE b != NULL"]), ru.RuleSet.only("null-comparison"), "rules").collect()
    assert len(got) == 2 and [r.issue_no for r in got] == [1, 2]


def test_empty_and_broken_texts_raise_nothing(stmts):
    texts = ["", "   ", "((((", "not sql at all", "SELECT '"]
    for profile in ("full", "scan", "basic", "fallback"):
        ru.evaluate(stmts(texts), profile=profile).collect()


def test_config_in_the_row_equals_config_by_join(spark, stmts):
    texts = ["SELECT * FROM orders", "SELECT * FROM users", "SELECT a FROM t WHERE b = 18 AND c > 500",
             "SELECT " + "a, " * 150 + "b FROM t WHERE c = 1"]
    config = spark.createDataFrame([
        ("magic-numbers", False, None, [], {}), ("select-star", True, "INFO", ["FROM orders", ""], {}),
    ], "rule_id string, enabled boolean, severity string, exceptions array<string>, params map<string,string>")
    st = stmts(texts)
    cols = ["stmt_id", "rule_id", "severity", "message"]
    a = sorted(map(tuple, ru.evaluate(st, config=config).select(*cols).collect()))
    b = sorted(map(tuple, cfg.apply_config(ru.evaluate(st), st, config).select(*cols).collect()))
    assert a == b and ("s1", "select-star", "INFO") in {x[:3] for x in a}
    assert not [x for x in a if x[1] == "magic-numbers" or x[:2] == ("s0", "select-star")]


def test_thresholds_from_config(spark, stmts):
    config = spark.createDataFrame([("long-sql-statement", None, None, None, {"max_chars": "20"}),
                                    ("magic-numbers", True, None, None, {"min_count": "x"})],
                                   "rule_id string, enabled boolean, severity string, exceptions array<string>, params map<string,string>")
    got = found(stmts, ["SELECT abc FROM t WHERE b = 1"], config=config)
    assert got == [{"long-sql-statement"}]


def test_rule_set(spark, stmts):
    rules = ru.RuleSet()
    assert len(rules) == 19 and rules.active()[0].rule_id == "delete-update-no-where"
    rules.register("select-star", "INFO", "contains(t_upper, '*')", "own")
    assert len(rules) == 19
    rules.register("no-temp", "WARNING", F.col("norm").contains("tmp"), F.concat(F.lit("in "), F.col("stmt_id")), "rename")
    rules.unregister("missing-where").disable("not-in")
    assert "missing-where" not in rules and len(rules.active()) == 18
    got = {(r.rule_id, r.severity, r.message, r.suggestion) for r in ru.evaluate(stmts(["SELECT * FROM tmp"]), rules, "rules").collect()}
    assert got == {("select-star", "INFO", "own", None), ("no-temp", "WARNING", "in s0", "rename")}
    assert rules.frame(spark).count() == 19


def test_rule_names(rows):
    names = ["orderby-without-limit", "camelCase-id", " ", "select-star"]
    assert rows(names, ru.normalize_rule_id) == ["ORDER_BY_WITHOUT_LIMIT", "CAMEL_CASE_ID", "UNKNOWN", "SELECT_STAR"]
    assert rows(["MISSING_WHERE", "NOT_IN", "NULL_COMPARISON"], ru.issue_type) == [
        "SELECT_WITHOUT_WHERE", "MISSING_INDEX", "NULL_COMPARISON"]


def test_scan_profile_by_shape(stmts):
    got = found(stmts, ["SELECT * FROM WHERE", "SELECT * FROM t ORDER BY ${x}"], profile="scan")
    assert got == [{"SELECT_STAR"}, {"SQL_INJECTION", "SELECT_STAR"}]


def test_score_frames_agree_and_stay_in_range(stmts):
    texts = [y for _, yes, _ in CASES for y in yes] + ["SELECT a FROM t WHERE b = 1"]
    st = stmts(texts)
    inline = sc.score_linted(ru.lint(st, profile="full")).select("stmt_id", "severity", "score", "score_explanation")
    joined = sc.score(st, ru.evaluate(st))
    a, b = [sorted(map(tuple, d.collect())) for d in (inline, joined)]
    assert a == b and all(0 <= x[2] <= 100 for x in a)
    totals = sc.issue_totals(ru.evaluate(st)).first()
    assert totals.critical + totals.warning + totals.info == totals.total


@pytest.mark.parametrize("profile", ["nope"])
def test_unknown_profile(stmts, profile):
    with pytest.raises(ValueError):
        ru.lint(stmts(["SELECT 1 FROM t"]), profile=profile)


def test_bulk_insert_and_open_parentheses(stmts):
    bulk = "INSERT INTO t (a, b) VALUES " + ", ".join(f"({i}, 'x{i}')" for i in range(40_000))
    torn = "SELECT a FROM t WHERE b = " + "(" * 20_000
    got = found(stmts, [bulk, torn, "SELECT a FROM (SELECT * FROM u) x WHERE a = f(g(1))"])
    assert got[0] == {"long-sql-statement"}
    assert got[1] == {"long-sql-statement", "complex-subquery"}
    assert got[2] == {"select-star", "missing-where"}


def test_only_the_where_condition_counts(stmts):
    """OR and functions in later clauses are no hits; those behind a subquery's clauses are."""
    texts = ["SELECT x FROM t WHERE id = 1 GROUP BY x HAVING COUNT(x) = 1 OR MAX(y) = 2",
             "SELECT x FROM t WHERE id = 1 ORDER BY UPPER(x) LIMIT 5",
             "SELECT x FROM t WHERE a IN (SELECT b FROM u GROUP BY b) OR c = 2 ORDER BY x LIMIT 1",
             "SELECT x FROM t WHERE UPPER(x) = 'A' ORDER BY x LIMIT 1"]
    got = found(stmts, texts)
    assert ["multi-column-or" in g for g in got] == [False, False, True, False]
    assert ["function-on-indexed-column" in g for g in got] == [False, False, False, True]


def test_where_conditions_of_every_block(stmts):
    """Later clauses end the condition of their own block only, however deep; each block's OR is judged by itself."""
    texts = ["SELECT a FROM t WHERE b = 1 GROUP BY a UNION ALL SELECT a FROM u WHERE UPPER(c) = 'x' OR d = 2",
             "SELECT a FROM t WHERE b = 1 ORDER BY UPPER(F(G(H(A))))",
             "SELECT a FROM t WHERE b = 1 HAVING MAX((((((a)))))) = 1 OR c = 2",
             "SELECT a FROM t WHERE b IN (SELECT c FROM u WHERE d = 1 ORDER BY UPPER(F(G(H(I(c))))) LIMIT 1) AND e = 1",
             "SELECT a FROM (SELECT b FROM t WHERE F(G(H(UPPER(c)))) = 'x' GROUP BY b) x WHERE a = 1 ORDER BY a",
             "SELECT a FROM t WHERE b = 1 OR c = 2 UNION SELECT a FROM u WHERE b = 1 OR c = 2",
             "SELECT a FROM t WHERE b = 1 OR b = 2 GROUP BY a UNION SELECT a FROM u WHERE b = 3 OR b = 4",
             "(SELECT a FROM t WHERE b = 1 LIMIT 1)UNION(SELECT LOWER(a) FROM u WHERE c = 1)",
             "SELECT a FROM t WHERE (b, c) IN (" + ", ".join(f"({i}, {i})" for i in range(5000)) + ") OR TRIM(d) = 'x'"]
    got = found(stmts, texts, profile="rules")
    assert ["function-on-indexed-column" in g for g in got] == [True, False, False, False, True, False, False, False, True]
    assert ["multi-column-or" in g for g in got] == [True, False, False, False, False, True, False, False, True]
    counts = ru.evaluate(stmts(texts), ru.RuleSet.only("multi-column-or"), "rules").collect()
    assert {r.stmt_id: int("".join(filter(str.isdigit, r.message))) for r in counts} == {"s0": 1, "s5": 2, "s8": 1}
