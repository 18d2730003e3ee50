"""Source files made from ``events``: one row of events is one file.

The kind of file is event_id % 8; {e} is the event id, {u} the user id.  EXPECTED lists, by
kind, what each extractor must find: the SQL twins are built from it and not from the
patterns of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.suite import corpus

JAVA_LITERALS = '''package app;

class Dao{e} {
    // it's only "text" here
    private static final String A = "SELECT o_orderkey FROM orders WHERE o_custkey = {u}";
    private static final String KEY = "update:sku:{u}:show";
    String b = "please select one of the rows";
    String c = "DELETE FROM orders WHERE o_orderkey = {e}", d = "UPDATE orders SET o_custkey = {u}";
    String f = "SELECT * FROM t_${name} WHERE id = 1";
    void done() { log.info("insert done for {}", x); }
}
'''

JAVA_CONCAT = '''class Job{e} {
    void run() {
        text.append("DELETE FROM lineitem WHERE l_orderkey = " + key + " AND l_linenumber IN (" + lines + ")");
        String q = "SELECT o_orderkey " + "FROM orders " + "WHERE o_custkey = {u}";
        String r = head + "SELECT c_name FROM customer WHERE c_name = \\"x{u}\\" AND c_custkey = " + id;
        String t = """
            SELECT n_name
            FROM nation
            WHERE n_nationkey = {u}
            """;
    }
}
'''

JAVA_ANNOTATIONS = '''interface Mapper{e} {
    @Select("SELECT o_orderkey FROM orders WHERE o_custkey = #{id}")
    List<Long> a(long id);

    @Update({
        "UPDATE orders",
        "SET o_custkey = {u}",
        "WHERE o_orderkey = {e}"
    })
    int b();

    @Query(value = "SELECT c_name FROM customer WHERE c_custkey = {u} AND (c_name = 'a)' OR c_acctbal > 1)",
           nativeQuery = true)
    List<String> c();

    @Query("SELECT c FROM Customer c WHERE c.id = {u}")
    List<Customer> d();

    @Options(useGeneratedKeys = true)
    @Insert("INSERT INTO region (r_regionkey, r_name) " + "VALUES ({u}, 'r')")
    int f();
}
'''

SQL_SCRIPT = """-- report; of user {u}
SELECT o_orderkey, 'a;b -- no' FROM orders WHERE o_custkey = {u}; # tail; don't
/* block
   comment; */ UPDATE orders
SET o_custkey = {u} WHERE o_orderkey = {e};DELETE FROM orders WHERE o_orderkey = {e};

CREATE TABLE t_{u} (
  id BIGINT /* key; */ PRIMARY KEY,
  name VARCHAR(64)
);
COMMIT;
INSERT INTO region VALUES ({e}, 'it''s; "x"')
"""

SCRIPT_LITERALS = """export const a = `SELECT o_orderkey FROM orders WHERE o_custkey = {u}`;
const b = "DELETE FROM orders WHERE o_orderkey = {e}";
const c = 'UPDATE orders SET o_custkey = 1 WHERE o_clerk = \\'x{u}\\'';
const d = "selected {u} rows"; const k = 'update:sku:{u}';
const f = `with ${n} rows`;
"""

MAPPER_STATIC = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE mapper PUBLIC "-//mybatis.org//DTD Mapper 3.0//EN" "http://mybatis.org/dtd/mybatis-3-mapper.dtd">
<mapper namespace="m{u}">
  <!-- <select id="old">SELECT 1 FROM dual</select> -->
  <sql id="cols">o_orderkey, o_custkey</sql>
  <sql id="m.full"><include refid="cols"/>, o_totalprice</sql>
  <select id="plain{u}" resultType="map">
    SELECT <include refid="cols"/> FROM orders
    WHERE o_custkey = #{id} AND o_totalprice &lt; {e}
  </select>
  <select id="short">
    <include refid="other.full"></include> FROM orders WHERE o_orderkey = {e}
  </select>
  <insert id="ins">
    <selectKey keyProperty="id" order="BEFORE">SELECT max(r_regionkey) FROM region</selectKey>
    INSERT INTO region (r_regionkey, r_name) VALUES (#{id}, 'r{u}')
  </insert>
  <delete id="del"><![CDATA[ DELETE FROM orders WHERE o_totalprice <= {u} AND o_orderkey > 1 ]]></delete>
  <update id="u1">UPDATE orders SET o_custkey = <include refid="missing"/> WHERE o_orderkey = {e}</update>
  <select id="none"></select>
</mapper>
"""

MAPPER_DYNAMIC = """<mapper namespace="d{u}">
  <select id="find">
    SELECT o_orderkey FROM orders
    <where>
      <if test="a != null and b > 1">AND o_custkey = #{a}</if>
      <choose>
        <when test="x"> </when>
        <when test='y == "1"'>AND o_orderstatus = 'O{u}'</when>
        <otherwise>AND o_orderstatus = 'F'</otherwise>
      </choose>
      <if test="ids != null">
        AND o_orderkey IN
        <foreach collection="ids" item="i" open="(" separator="," close=")">#{i}</foreach>
      </if>
    </where>
  </select>
  <update id="upd">
    UPDATE orders <bind name="p" value="'%' + n"/>
    <set><if test="a">o_custkey = {u},</if><if test="b">o_totalprice = 2,</if></set>
    <trim prefix="WHERE" prefixOverrides="AND|OR"> and o_orderkey = {e} </trim>
  </update>
  <insert id="batch">
    INSERT INTO region (r_regionkey, r_name) VALUES
    <foreach collection="list" item="r" separator=","><trim prefix="(" suffix=")" suffixOverrides=",">#{r.k}, 'r{u}',</trim></foreach>
  </insert>
  <delete id="purge">DELETE FROM orders <where></where><if test="z">LIMIT <foreach collection="q"></foreach></if></delete>
  <select>SELECT <choose><otherwise>count(*)</otherwise></choose> FROM orders LIMIT 1</select>
</mapper>
"""

GENERATED = '''class Gen{e} { String s = "SELECT * FROM ignored WHERE id = {e}"; }
'''

CONTENT = [
    JAVA_LITERALS, JAVA_CONCAT, JAVA_ANNOTATIONS, SQL_SCRIPT, SCRIPT_LITERALS, MAPPER_STATIC, MAPPER_DYNAMIC, GENERATED,
]
PATH = [
    "svc{p}/src/main/java/app/Dao{e}.java",
    "svc{p}/src/main/java/app/Job{e}.java",
    "svc{p}/src/main/java/app/Mapper{e}.java",
    "svc{p}/db/script{e}.sql",
    "svc{p}/web/query{e}.ts",
    "svc{p}/src/main/resources/mapper/Static{e}.xml",
    "svc{p}/src/main/resources/mapper/Dynamic{e}.xml",
    "svc{p}/target/gen/Gen{e}.java",
]

# extractor -> kind -> [(line, sql)]
EXPECTED = {
    "literal": {
        0: [(5, "SELECT o_orderkey FROM orders WHERE o_custkey = {u}"),
            (8, "DELETE FROM orders WHERE o_orderkey = {e}"),
            (8, "UPDATE orders SET o_custkey = {u}")],
        1: [(3, "DELETE FROM lineitem WHERE l_orderkey = ? AND l_linenumber IN (?)"),
            (4, "SELECT o_orderkey FROM orders WHERE o_custkey = {u}"),
            (5, 'SELECT c_name FROM customer WHERE c_name = "x{u}" AND c_custkey = ?'),
            (6, "SELECT n_name\n            FROM nation\n            WHERE n_nationkey = {u}")],
        2: [(2, "SELECT o_orderkey FROM orders WHERE o_custkey = #{id}"),
            (12, "SELECT c_name FROM customer WHERE c_custkey = {u} AND (c_name = 'a)' OR c_acctbal > 1)"),
            (16, "SELECT c FROM Customer c WHERE c.id = {u}"),
            (20, "INSERT INTO region (r_regionkey, r_name) VALUES ({u}, 'r')")],
        7: [(1, "SELECT * FROM ignored WHERE id = {e}")],
    },
    "mybatis": {
        2: [(2, "SELECT o_orderkey FROM orders WHERE o_custkey = #{id}"),
            (6, "UPDATE orders SET o_custkey = {u} WHERE o_orderkey = {e}"),
            (20, "INSERT INTO region (r_regionkey, r_name) VALUES ({u}, 'r')")],
    },
    "jpa": {
        2: [(12, "SELECT c_name FROM customer WHERE c_custkey = {u} AND (c_name = 'a)' OR c_acctbal > 1)")],
    },
    "simple": {
        0: [(1, "SELECT o_orderkey FROM orders WHERE o_custkey = {u}"),
            (1, "DELETE FROM orders WHERE o_orderkey = {e}"),
            (1, "UPDATE orders SET o_custkey = {u}"),
            (1, "SELECT * FROM t_${name} WHERE id = 1")],
        1: [(1, "DELETE FROM lineitem WHERE l_orderkey ="),
            (1, "SELECT o_orderkey"),
            (1, "SELECT c_name FROM customer WHERE c_name = \\"),
            (1, "SELECT n_name\n            FROM nation\n            WHERE n_nationkey = {u}")],
        2: [(1, "SELECT o_orderkey FROM orders WHERE o_custkey = #{id}"),
            (1, "SELECT c_name FROM customer WHERE c_custkey = {u} AND (c_name = 'a)' OR c_acctbal > 1)"),
            (1, "SELECT c FROM Customer c WHERE c.id = {u}"),
            (1, "INSERT INTO region (r_regionkey, r_name)"),
            (1, "SELECT c_name FROM customer WHERE c_custkey = {u} AND (c_name = 'a)' OR c_acctbal > 1)")],
        7: [(1, "SELECT * FROM ignored WHERE id = {e}")],
    },
    "script": {
        3: [(2, "SELECT o_orderkey, 'a;b -- no' FROM orders WHERE o_custkey = {u}"),
            (4, "UPDATE orders\nSET o_custkey = {u} WHERE o_orderkey = {e}"),
            (5, "DELETE FROM orders WHERE o_orderkey = {e}"),
            (7, "CREATE TABLE t_{u} (\n  id BIGINT  PRIMARY KEY,\n  name VARCHAR(64)\n)"),
            (12, "INSERT INTO region VALUES ({e}, 'it''s; \"x\"')")],
    },
    "js": {
        4: [(1, "SELECT o_orderkey FROM orders WHERE o_custkey = {u}"),
            (1, "with ${n} rows"),
            (1, "DELETE FROM orders WHERE o_orderkey = {e}"),
            (1, "UPDATE orders SET o_custkey = 1 WHERE o_clerk = \\'x{u}\\'"),
            (1, "selected {u} rows"),
            (1, "update:sku:{u}")],
    },
    "mapper": {
        5: [(7, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = #{id} AND o_totalprice < {e}"),
            (11, "SELECT o_orderkey, o_custkey , o_totalprice FROM orders WHERE o_orderkey = {e}"),
            (14, "INSERT INTO region (r_regionkey, r_name) VALUES (#{id}, 'r{u}')"),
            (15, "SELECT max(r_regionkey) FROM region"),
            (18, "DELETE FROM orders WHERE o_totalprice <= {u} AND o_orderkey > 1"),
            (19, "UPDATE orders SET o_custkey = /* INCLUDE:missing */ WHERE o_orderkey = {e}")],
        6: [(2, "SELECT o_orderkey FROM orders WHERE o_custkey = #{a} AND o_orderstatus = 'O{u}' AND o_orderkey IN (#{i})"),
            (17, "UPDATE orders /* BIND:p='%' + n */ SET o_custkey = {u}, o_totalprice = 2 WHERE o_orderkey = {e}"),
            (22, "INSERT INTO region (r_regionkey, r_name) VALUES ( #{r.k}, 'r{u}' )"),
            (26, "DELETE FROM orders LIMIT 1"),
            (2, "SELECT count(*) FROM orders LIMIT 1")],
    },
}

SOURCE_OF = {
    "literal": "STRING_LITERAL", "mybatis": "MYBATIS_ANNOTATION", "jpa": "JPA_ANNOTATION", "simple": "JAVA",
    "script": "SQL_FILE", "js": "JAVASCRIPT", "mapper": "MYBATIS",
}


def files(spark, sf_dir: str) -> DataFrame:
    ev = corpus.table(spark, sf_dir, "events", "event_id", "user_id")
    e, u = F.col("event_id"), F.col("user_id")
    kind = e % 8
    path = F.replace(corpus.pick(kind, PATH), F.lit("{p}"), (u % 5).cast("string"))
    return ev.select(
        F.replace(path, F.lit("{e}"), e.cast("string")).alias("path"),
        corpus.fill(corpus.pick(kind, CONTENT), e, u).alias("content"),
    )


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def file_case(values: list[str]) -> str:
    return "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values)) + " END"


def path_sql() -> str:
    return f"replace(replace({file_case(PATH)}, '{{p}}', (user_id % 5)::VARCHAR), '{{e}}', event_id::VARCHAR)"


def files_sql() -> str:
    text = f"replace(replace({file_case(CONTENT)}, '{{e}}', event_id::VARCHAR), '{{u}}', user_id::VARCHAR)"
    return f"SELECT event_id, user_id, {path_sql()} AS path, {text} AS content FROM events"


def expected_sql(*extractors: str) -> str:
    """(path, file_name, line, source_type, sql) that the extractors must find."""
    rows = [
        f"({kind}, {line}, {_q(SOURCE_OF[x])}, {_q(sql)})"
        for x in extractors for kind, found in EXPECTED[x].items() for line, sql in found
    ]
    return f"""
SELECT {path_sql()} AS path, regexp_extract({path_sql()}, '([^/]*)$', 1) AS file_name,
  CAST(x.line AS INTEGER) AS line, x.source_type,
  replace(replace(x.sql, '{{e}}', event_id::VARCHAR), '{{u}}', user_id::VARCHAR) AS sql
FROM events JOIN (VALUES {', '.join(rows)}) x(kind, line, source_type, sql) ON event_id % 8 = x.kind"""
