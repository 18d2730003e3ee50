from pyspark.sql import functions as F

from lintlake.functions import text as tx


def test_looks_like_sql(rows):
    yes = ["SELECT * FROM users", "UPDATE users SET name='a'", "delete from users", "with x as (select 1) select 1",
           "TRUNCATE TABLE x", "CREATE UNIQUE INDEX i ON t (a)", "replace  into t values (1)"]
    no = ["update:sku:some:", "update sku sale state result->{}", "create file: x", "SELECT 1", "drop me a line", None]
    assert rows(yes, tx.looks_like_sql) == [True] * len(yes)
    assert rows(no, tx.looks_like_sql) == [False] * len(no)


def test_cache_key(rows):
    assert rows(["a:b", "a:b c", "a:b:c:d e", "a b"], tx.is_cache_key) == [True, False, True, False]


def test_fingerprint_masks_literals_and_numbers(rows):
    out = rows(["select * from t where id = 10 and name = 'a\\'b' and x = \"q\" and y=1.5 and t2_3 = 4"], tx.abstract_sql)
    assert out == ["select * from t where id = ? and name = ? and x = ? and y=? and t2_3 = ?"]


def test_long_literal_does_not_overflow_the_matcher(rows):
    big = "SELECT '" + "x" * 300_000 + "' FROM t WHERE a = '" + "\\'" * 50_000 + "'"
    assert rows([big], tx.abstract_sql) == ["SELECT ? FROM t WHERE a = ?"]


def test_template_fixer(rows):
    cases = {
        "SELECT id\n FROM users WHERE status = #{status,jdbcType=INTEGER} AND id IN #{ids}":
            "SELECT id FROM users WHERE status = 1 AND id IN (1)",
        "SELECT * FROM users WHERE ? ORDER BY id": "SELECT * FROM users WHERE 1 = 1 ORDER BY id",
        "INSERT INTO s (id, qty,,, price) VALUES (1, 1, 1)": "INSERT INTO s (id, qty, price) VALUES (1, 1, 1)",
        "SELECT id FROM cfg AND flag = 0 LIMIT 1": "SELECT id FROM cfg WHERE flag = 0 LIMIT 1",
        "SELECT * FROM users ORDER BY ${orderBy}": "SELECT * FROM users ORDER BY ${orderBy}",
    }
    assert rows(list(cases), tx.fix_template) == list(cases.values())
    assert rows(list(cases)[:4], lambda c: tx.shape_ok(tx.fix_template(c))) == [True] * 4


def test_shape(rows):
    bad = ["SELECT * FROM WHERE", "SELECT (1 FROM t", "SELECT 'a FROM t", "SELECT a,, b FROM t", "hello world",
           "SELECT a FROM t WHERE", "SELECT a FROM t WHERE id = #{x}"]
    good = ["SELECT a FROM t WHERE b BETWEEN ? AND ?", "select count(*) from t", "DELETE FROM t WHERE a = '(,,'"]
    assert rows(bad, tx.shape_ok) == [False] * len(bad)
    assert rows(good, tx.shape_ok) == [True] * len(good)


def test_blocks_at_any_depth(rows):
    deep = "SELECT a FROM (SELECT b FROM (SELECT c FROM t WHERE x = f(g(h(i(j(k(l(1)))))))) q) r WHERE z = 1"
    out = rows([deep, "SELECT 1 UNION ALL SELECT a FROM b", "WITH q AS (SELECT * FROM z), r AS (SELECT 2) SELECT a FROM q"],
               lambda c: tx.select_blocks(tx.masked(c)))
    assert sorted(out[0]) == ["SELECT A FROM ~ R WHERE Z = 1", "SELECT B FROM ~ Q", "SELECT C FROM T WHERE X = F~"]
    assert out[1] == ["SELECT 1", "SELECT A FROM B"]
    assert out[2] == ["SELECT A FROM Q"]


def test_label(rows):
    assert rows(["SELECT_STAR", "MY_OWN_rule", " ", None], tx.label) == ["SELECT *", "My Own Rule", "未知", "未知"]


def test_sql_type_and_category(rows, spark):
    assert rows(["  insert into x", "drop table t", "show tables", None], tx.sql_type) == ["INSERT", "DROP", "OTHER", "OTHER"]
    df = spark.createDataFrame([("<if>a</if>", "MYBATIS"), ("a", "MYBATIS"), ("#{a}", "STRING_LITERAL"), ("a", "SQL_FILE")],
                               "s string, t string")
    got = [r.c for r in df.select(tx.sql_category(F.col("s"), F.col("t")).alias("c")).collect()]
    assert got == ["MYBATIS_XML_DYNAMIC", "MYBATIS_XML_STATIC", "PLACEHOLDER_TEMPLATE", "UNKNOWN"]
