"""Column expressions against plain loops on random texts."""

import random
import re

from pyspark.sql import functions as F

from lintlake.functions import text as tx
from lintlake.operators import report
from lintlake.operators.config import drop_excepted
from lintlake.operators.extract import js_literals, sql_file
from lintlake.sizing import hot_key_join, only_row


def random_texts(parts, n, longest, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def run(spark, texts, build):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def split_script(text):
    out, cur, start, line, quote, i = [], "", None, 1, "", 0

    def close():
        sql = cur.strip(tx.BLANKS)
        if re.match(r"(?is)SELECT\s+\S", sql) and len(sql) >= 10:
            out.append((start, sql))

    while i < len(text):
        c = text[i]
        if not quote and (text.startswith("--", i) or c == "#"):
            while i < len(text) and text[i] != "\n":
                i += 1
            continue
        if not quote and text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = len(text) if end < 0 else end + 2
            line += text.count("\n", i, end)
            i = end
            continue
        if c in "'\"" and not quote:
            quote = c
        elif c == quote:
            quote = ""
        if c == ";" and not quote:
            close()
            cur, start = "", None
        else:
            if start is None and c not in tx.BLANKS:
                start = line
            cur += c
        line += c == "\n"
        i += 1
    close()
    return out


def test_scripts(spark):
    parts = ["SELECT x FROM t", "SELECT 1 FROM u ", ";", ";", "\n", " ", "'", '"', "--", "#", "/*", "*/", "*", "/", "a", "-"]
    texts = random_texts(parts, 3000, 24, 11)
    got = run(spark, texts, sql_file)
    for t, g in zip(texts, got):
        assert [(r.line, r.sql) for r in g] == split_script(t), repr(t)


def read_js(text):
    out = []
    for quotes in ("`", "\"'"):
        i = 0
        while i < len(text):
            q = text[i]
            if q not in quotes:
                i += 1
                continue
            j, lit = i + 1, ""
            while j < len(text) and text[j] != q:
                if text[j] == "\\" and j + 1 < len(text):
                    lit += text[j]
                    j += 1
                lit += text[j]
                j += 1
            if j >= len(text):
                break
            if re.match(r"(?i)(select|delete)", lit.strip(tx.BLANKS)):
                out.append(lit.strip(tx.BLANKS))
            i = j + 1
    return out


def test_js_literals(spark):
    parts = ["SELECT a", " delete b", "`", '"', "'", "\\", "\n", " x ", "${n}"]
    texts = random_texts(parts, 3000, 16, 5)
    got = run(spark, texts, js_literals)
    for t, g in zip(texts, got):
        assert [r.sql for r in g] == read_js(t), repr(t)


def test_collapse(spark):
    def plain(t):
        while True:
            u = re.sub(r"\([^()]*\)", "~", t)
            if u == t:
                return t
            t = u

    texts = random_texts(["(", "(", ")", ")", "a", ",", " "], 2000, 30, 3)
    assert run(spark, texts, tx.collapse) == [plain(t) for t in texts]


def test_fingerprint(spark):
    def plain(t):
        t = t.strip(tx.BLANKS)
        for p in (r"'([^'\\]|\\.)*'", r'"([^"\\]|\\.)*"', r"\b\d+(?:\.\d+)?\b"):
            t = re.sub(p, "?", t, flags=re.ASCII)
        return re.sub(r"[ \t\n\r\x0b\x0c]+", " ", t).strip(" ")

    texts = random_texts(["'", '"', "\\", "12", "1.5", "a", "_", " ", "\n", "b = "], 3000, 20, 9)
    assert run(spark, texts, tx.abstract_sql) == [plain(t) for t in texts]


HOT_SESSION = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_hot_statement_is_split_at_run_time(spark):
    """A statement found in a third of all files: counts stay whole and the join's large partition is split."""
    places = spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("stmt_key"),
        F.concat(F.lit("src/f"), F.col("id") % 20000).alias("path"))
    found = places.select("stmt_key").distinct().withColumn("issue_count", F.lit(2))
    for k, v in HOT_SESSION.items():
        spark.conf.set(k, v)
    try:
        hot = report.hotspots_by_file(found, places)
        got = [(r.label, r.cnt) for r in hot.orderBy(F.desc("cnt"), "label").collect()]
        for how in ("inner", "left", "left_semi", "left_anti"):
            joined = hot_key_join(places, found, "stmt_key", how)
            assert len(joined.collect()) == (0 if how == "left_anti" else 60000)
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in HOT_SESSION:
            spark.conf.unset(k)
    files = sorted(f"src/f{i}" for i in range(20000))[:8]
    assert got == [(f, 6) for f in files]


def test_exceptions_touch_listed_rules_only(spark):
    issues = spark.createDataFrame([(f"sql-{i}", r) for i in range(6) for r in ("a", "b")] + [("sql-none", "a"), ("sql-none", "b")], "stmt_id string, rule_id string")
    stmts = spark.createDataFrame([(f"sql-{i}", "SELECT x FROM legacy_t" if i % 2 else "SELECT x FROM t") for i in range(6)], "stmt_id string, norm string")
    rules = spark.createDataFrame([("a", ["legacy_", ""]), ("c", ["SELECT"])], "rule_id string, exceptions array<string>")
    got = sorted(tuple(r) for r in drop_excepted(issues, stmts, rules).select("stmt_id", "rule_id").collect())
    assert got == sorted([(f"sql-{i}", "a") for i in (0, 2, 4)] + [(f"sql-{i}", "b") for i in range(6)] + [("sql-none", "a"), ("sql-none", "b")])


def test_only_row(spark):
    one = spark.range(5).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    got = spark.range(2).withColumn("o", only_row(one)).select("id", "o.*").collect()
    assert [tuple(r) for r in got] == [(0, 5, 4), (1, 5, 4)]


def one_space(t):
    return re.sub(r"\s+", " ", t).strip()


def random_mapper(rnd, depth):
    """A random body of dynamic tags and the text it must become."""
    xml, out = [], []
    for _ in range(rnd.randint(0, 3)):
        kind = rnd.choice(["text", "text", "if", "where", "set", "trim", "foreach", "choose", "other"]) if depth else "text"
        if kind == "text":
            t = rnd.choice(["a = 1", "AND b = 2", "or c = 3", ", d = 4", "e = 5,", " ", "x &lt; 3", "ORDER", "and"])
            xml.append(t + " ")
            out.append(t)
            continue
        if kind == "choose":
            body, picked = [], None
            for _ in range(rnd.randint(0, 2)):
                x, e = random_mapper(rnd, depth - 1)
                body.append(f"<when test='q != \"1\"'>{x}</when>")
                picked = picked or e or None
            if rnd.random() < 0.6:
                x, e = random_mapper(rnd, depth - 1)
                body.append(f"<otherwise>{x}</otherwise>")
                picked = picked or e
            xml.append("<choose>\n" + "\n".join(body) + "</choose>")
            out.append(picked or "")
            continue
        x, e = random_mapper(rnd, depth - 1)
        if kind == "if":
            xml.append(f'<if test="p > 1">{x}</if>')
        elif kind == "other":
            xml.append(f"<bean:x y='2'>{x}</bean:x>")
        elif kind == "foreach":
            xml.append(f'<foreach collection="c" open="(" item="i" close=")">{x}</foreach>')
            e = f"({e or '1'})"
        elif kind == "where":
            xml.append(f"<where>{x}</where>")
            e = re.sub(r"(?i)^(AND|OR)\s+", "", e)
            e = f"WHERE {e}" if e else ""
        elif kind == "set":
            xml.append(f"<set>{x}</set>")
            e = re.sub(r"\s*,\s*$", "", re.sub(r"^\s*,\s*", "", e))
            e = f"SET {e}" if e else ""
        else:
            xml.append(f'<trim prefix="P" prefixOverrides="AND |OR" suffixOverrides=",|4">{x}</trim>')
            for token in ("AND", "OR"):
                if e.upper().startswith(token):
                    e = e[len(token):].strip()
                    break
            for token in (",", "4"):
                if e.endswith(token):
                    e = e[: -len(token)].strip()
                    break
            e = f"P {e}" if e else ""
        out.append(e)
    return "".join(xml), one_space(" ".join(out))


def test_dynamic_tags(spark):
    from lintlake.operators.mapper import flatten_tags

    rnd = random.Random(21)
    cases = [random_mapper(rnd, rnd.randint(1, 5)) for _ in range(1500)]
    got = run(spark, [x for x, _ in cases], flatten_tags)
    for (x, want), g in zip(cases, got):
        assert g == want, x
