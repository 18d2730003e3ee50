"""Comments, quotes and control characters: expected rows written by hand."""

import pytest
from pyspark.sql import functions as F

from lintlake.functions import text as tx
from lintlake.operators import config as cf
from lintlake.operators import rules as ru
from lintlake.operators.extract import extract_all
from lintlake.operators.mapper import extract_mapper

MASKED = {
    "SELECT a FROM t -- WHERE UPPER(z) = 1\n LIMIT 5": "SELECT A FROM T LIMIT 5",
    "SELECT a/* b, c */FROM t": "SELECT A FROM T",
    "SELECT '-- no', \"/* no */\" FROM t": "SELECT '', \"\" FROM T",
    "SELECT \"it's\" FROM t WHERE a = 'x' /* open": "SELECT \"\" FROM T WHERE A = ''",
    "/* it's */ DELETE FROM t -- where 'a'": "DELETE FROM T",
    "SELECT a FROM t /* x * / ** y **/ WHERE b = 1": "SELECT A FROM T WHERE B = 1",
    "SELECT `a--b` FROM t": "SELECT `A--B` FROM T",
    "SELECT 5 - -1, 6 / 2, 2 * 3 FROM t": "SELECT 5 - -1, 6 / 2, 2 * 3 FROM T",
    "SELECT a FROM t WHERE b = 'never closed -- x": "SELECT A FROM T WHERE B = 'NEVER CLOSED",
    "SELECT /* INCLUDE: cols */ FROM t": "SELECT /* INCLUDE: COLS */ FROM T",
    "": "",
}


def test_masked_without_comments(rows):
    assert rows(list(MASKED), tx.masked) == list(MASKED.values())
    assert rows([None], tx.masked) == [None]


def test_tokens(rows):
    text = "SELECT a1, `b c`,\n\"d\" -- e\nFROM t_1/**/WHERE x='y\\'z' AND n>=1.5 ' /* f"
    (found,) = rows([text], tx.tokens)
    assert "".join(t["text"] for t in found) == text
    assert [(t["kind"], t["text"]) for t in found if t["kind"] not in ("blank", "word")] == [
        ("symbol", ","), ("name", "`b c`"), ("symbol", ","), ("quoted", '"d"'), ("comment", "-- e"), ("comment", "/**/"), ("symbol", "="),
        ("string", "'y\\'z'"), ("symbol", ">"), ("symbol", "="), ("number", "1.5"), ("symbol", "'"), ("comment", "/* f")]
    assert rows(["/" * 50 + "*" * 50 + "-" * 3], lambda c: F.array_join(F.transform(tx.tokens(c), lambda t: t["text"]), "")) == ["/" * 50 + "*" * 50 + "-" * 3]


def test_long_texts_of_comments(rows):
    long = "SELECT a FROM t WHERE b = 1 " + "/* x */ -- 'y\n" * 20_000 + "AND c = 'z'"
    assert rows([long], tx.masked) == ["SELECT A FROM T WHERE B = 1 AND C = ''"]


@pytest.mark.parametrize("sql, expected", [
    ("SELECT a FROM t -- WHERE UPPER(z) = 1\nLIMIT 5", set()),
    ("SELECT a FROM t WHERE b = 1 -- OR c = 2\nLIMIT 5", set()),
    ("SELECT a FROM t WHERE b = '/*' AND UPPER(c) = 'x' AND d = '*/' LIMIT 5", {"function-on-indexed-column"}),
    ("DELETE FROM t /* WHERE a = 1 */", {"delete-update-no-where"}),
    ("SELECT a /* , * */ FROM t WHERE b = 1 LIMIT 5", set()),
])
def test_rules_do_not_read_comments(stmts, sql, expected):
    found = {r.rule_id for r in ru.evaluate(stmts([sql]), profile="rules").collect()}
    watched = {"function-on-indexed-column", "multi-column-or", "missing-where", "delete-update-no-where", "select-star"}
    assert found & watched == expected & watched


def test_two_rows_for_a_rule(spark, stmts):
    kind = "rule_id string, enabled boolean, severity string, exceptions array<string>, params map<string,string>"
    rows = [("select-star", None, "INFO", ["keep_me"], None), ("select-star", True, "CRITICAL", None, {"a": "2"}), ("select-star", None, None, ["other"], {"a": "1", "b": "3"}),
            ("delete-update-no-where", True, None, None, None), ("delete-update-no-where", False, None, None, None), (None, False, None, None, None)]
    config = spark.createDataFrame(rows, kind)
    folded = {r.rule_id: r for r in cf.one_per_rule(config).collect()}
    assert set(folded) == {"select-star", "delete-update-no-where"} and folded["delete-update-no-where"].enabled is False
    star = folded["select-star"]
    assert (star.enabled, star.severity, sorted(star.exceptions), star.params) == (True, "CRITICAL", ["keep_me", "other"], {"a": "1", "b": "3"})
    found = ru.evaluate(stmts(["SELECT * FROM keep_me WHERE a = 1 LIMIT 1", "SELECT * FROM t WHERE a = 1 LIMIT 1", "DELETE FROM t"]), profile="rules", config=config)
    assert {(r.stmt_id, r.severity) for r in found.where("rule_id = 'select-star'").collect()} == {("s1", "CRITICAL")}
    assert found.where("rule_id = 'delete-update-no-where'").count() == 0


def test_control_characters(spark):
    mapper = '<mapper namespace="a"><select id="x">\x07SELECT a\x01 FROM t\x03 WHERE b = #{c}</select>\n<update id="y">UPDATE t SET a = 1\x00 WHERE b = 2</update></mapper>'
    java = 'class A { String s = "SELECT a\x02 FROM t WHERE \x01b = 1"; }'
    files = spark.createDataFrame([("m/a.xml", mapper), ("j/A.java", java)], "path string, content string")
    got = {(r.path, r.line): r.sql for r in extract_all(files).collect()}
    clean = {(r.path, r.line): r.sql for r in extract_all(files.withColumn("content", F.regexp_replace("content", "[\\x00-\\x08]", ""))).collect()}
    assert got == clean and len(got) == 3
    assert extract_mapper(files).count() == 2
