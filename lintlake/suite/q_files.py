"""Queries on source files and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import extract as ex
from lintlake.operators import mapper as mp
from lintlake.sources import corpus as src
from lintlake.suite import files as fl
from lintlake.suite.registry import query

_FILES = fl.files_sql()


@query("src_01_supported_files", f"SELECT path FROM ({_FILES}) WHERE regexp_matches(path, '(?i)\\.(java|xml|sql|js|ts)$')")
def _(spark, sf):
    return src.supported(fl.files(spark, sf)).select("path")


@query("src_02_drop_ignored", f"SELECT path FROM ({_FILES}) WHERE NOT contains(path, '/target/')")
def _(spark, sf):
    return src.drop_ignored(fl.files(spark, sf)).select("path")


@query("src_03_filter_globs",
       f"SELECT path FROM ({_FILES}) WHERE (path LIKE '%.java' OR path LIKE '%/db/_cript%') "
       "AND NOT path LIKE '%/app/Job%'")
def _(spark, sf):
    return src.filter_globs(fl.files(spark, sf), ["*.java", "*/db/?cript*"], ["*/app/Job*"]).select("path")


@query("src_04_file_type",
       f"SELECT path, lower(regexp_extract(path, '\\.([^.]*)$', 1)) AS ext, regexp_extract(path, '([^/]*)$', 1) AS file_name, "
       f"left(path, length(path) - length(regexp_extract(path, '(/[^/]*)$', 1))) AS parent_path FROM ({_FILES})")
def _(spark, sf):
    dos = fl.files(spark, sf).withColumn("path", F.translate("path", "/", "\\"))
    return src.with_file_type(dos).select("path", "ext", "file_name", "parent_path")


@query("src_05_file_metrics",
       f"SELECT path, CAST(len(string_split(rtrim(content, chr(10)), chr(10))) AS INTEGER) AS line_count, "
       f"CAST(length(content) AS INTEGER) AS char_count FROM ({_FILES})")
def _(spark, sf):
    return src.with_file_metrics(fl.files(spark, sf)).select("path", "line_count", "char_count")


@query("src_06_file_counts",
       f"SELECT count(*) AS total_files, count(*) FILTER (path LIKE '%.java') AS java_files, "
       f"count(*) FILTER (path LIKE '%.xml') AS xml_files, count(*) FILTER (path LIKE '%.sql') AS sql_files FROM ({_FILES})")
def _(spark, sf):
    return src.file_counts(fl.files(spark, sf))


@query("src_08_drop_large",
       "SELECT doc_id FROM documents WHERE octet_length(encode(text)) <= 5242")
def _(spark, sf):
    from lintlake.suite.corpus import table

    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return src.drop_large(docs, mb=0.005).select("doc_id")


def _extractor(name: str, fn, which: str):
    @query(name, fl.expected_sql(which))
    def _(spark, sf):
        return fn(fl.files(spark, sf))


_extractor("ext_03_java_literals", ex.extract_java, "literal")
_extractor("ext_05_mybatis_annotations", ex.extract_mybatis_annotations, "mybatis")
_extractor("ext_06_jpa_native", ex.extract_jpa, "jpa")
_extractor("ext_07_sql_scripts", ex.extract_sql_file, "script")
_extractor("ext_08_js_literals", ex.extract_js, "js")
_extractor("ext_09_mapper_statements", mp.extract_mapper, "mapper")
_extractor("ext_15_java_simple", ex.extract_java_simple, "simple")


# one concatenating line per event
CONCAT = [
    ('out.add("INSERT INTO region (r_regionkey, r_name) VALUES (" + key + ", " + name() + ")");',
     "INSERT INTO region (r_regionkey, r_name) VALUES (?, ?)"),
    ('String q = "SELECT o_orderkey " + "FROM orders WHERE o_custkey = {u}";',
     "SELECT o_orderkey FROM orders WHERE o_custkey = {u}"),
    ('run(prefix + "note" + "DELETE FROM orders WHERE o_orderkey = {e}" + tail(x), "y");',
     "DELETE FROM orders WHERE o_orderkey = {e}?y"),
    ('String s = "SELECT 1 FROM region WHERE r_name = \\"r\\\\n{u}\\"";', None),
    ('String s = "no sql " + here;', None),
]
_CONCAT_IN = ", ".join(f"({i}, {fl._q(b)})" for i, (_, b) in enumerate(CONCAT) if b is not None)


@query("ext_04_rebuild_concat",
       "SELECT event_id, replace(replace(x.t, '{e}', event_id::VARCHAR), '{u}', user_id::VARCHAR) AS sql FROM events "
       f"LEFT JOIN (VALUES {_CONCAT_IN}) x(k, t) ON event_id % {len(CONCAT)} = x.k")
def _(spark, sf):
    from lintlake.suite.corpus import fill, pick, table

    ev = table(spark, sf, "events", "event_id", "user_id")
    e, u = F.col("event_id"), F.col("user_id")
    lines = ev.select("event_id", fill(pick(e % len(CONCAT), [a for a, _ in CONCAT]), e, u).alias("line"))
    return lines.select("event_id", ex.rebuild_concat(F.col("line")).alias("sql"))


# --- parts of the mapper rewrite, one text per event -----------------------------------------------------


def _rewrites(name: str, cases: list[tuple[str, str]], build):
    pairs = ", ".join(f"({i}, {fl._q(out)})" for i, (_, out) in enumerate(cases))

    @query(name, "SELECT event_id, replace(replace(x.t, '{e}', event_id::VARCHAR), '{u}', user_id::VARCHAR) AS sql "
                 f"FROM events JOIN (VALUES {pairs}) x(k, t) ON event_id % {len(cases)} = x.k")
    def _(spark, sf):
        from lintlake.suite.corpus import fill, pick, table

        ev = table(spark, sf, "events", "event_id", "user_id")
        e, u = F.col("event_id"), F.col("user_id")
        texts = ev.select("event_id", fill(pick(e % len(cases), [a for a, _ in cases]), e, u).alias("t"))
        return texts.select("event_id", build(F.col("t")).alias("sql"))


def _with_fragments(t):
    text = mp.prepared_text(t)
    state = F.transform(F.array(text), lambda x: F.struct(x.alias("t"), mp.fragments_of(x).alias("f")))
    body = lambda s: F.regexp_extract(s["t"], r"(?s)<body>(.*)</body>", 1)
    return F.transform(state, lambda s: mp.flatten_body(body(s), s["f"]))[0]


_rewrites("ext_10_includes", [
    ('<sql id="a">x{u}, y</sql><body>SELECT <include refid="a"/> FROM t{e}</body>', "SELECT x{u}, y FROM t{e}"),
    ('<sql id="n.a">x{u}</sql><body>SELECT <include refid="m.a"/> FROM t{e}</body>', "SELECT x{u} FROM t{e}"),
    ("<sql id='a'>x</sql><sql id='b'><include refid='a'/>{u}</sql><body><include refid='b'/> t{e}</body>", "x {u} t{e}"),
    ('<sql id="b"><include refid="a"/></sql><sql id="a">x</sql><body><include refid="b"/>{e}</body>',
     "/* INCLUDE:a */ {e}"),
    ('<body>SELECT <include refid="zz{u}"><property name="p" value="1"/></include> FROM t</body>',
     "SELECT /* INCLUDE:zz{u} */ FROM t"),
], _with_fragments)

_rewrites("ext_11_dynamic_tags", [
    ("A <if test=x>b{u}</if> C", "A b{u} C"),
    ("<choose><when> </when><when>w{e}</when><when>z</when><otherwise>o</otherwise></choose>", "w{e}"),
    ("<choose><when> </when><otherwise><if>o{u}</if></otherwise></choose> t", "o{u} t"),
    ('IN <foreach collection="c" open="(" close=")" separator=","> #{i} </foreach> {e}', "IN (#{i}) {e}"),
    ("LIMIT <foreach collection='c'></foreach> {u}", "LIMIT 1 {u}"),
    ("<a><b><c><d>{e} deep</d></c></b></a>", "{e} deep"),
], mp.flatten_tags)

_rewrites("ext_12_where_set", [
    ("S <where> AND a = {u} <if>AND b = {e}</if></where> T", "S WHERE a = {u} AND b = {e} T"),
    ("S <where> or a = {u}</where>", "S WHERE a = {u}"),
    ("S <where><if> </if></where> {e}", "S {e}"),
    ("U <set>, a = {u}, b = {e} , </set> W", "U SET a = {u}, b = {e} W"),
    ("U <set> </set> {u}", "U {u}"),
    ("S <where>ANDROID = {u}</where>", "S WHERE ANDROID = {u}"),
], mp.flatten_tags)

_rewrites("ext_13_trim", [
    ('<trim prefix="WHERE" prefixOverrides="AND |OR ">and a = {u}</trim>', "WHERE a = {u}"),
    ('<trim prefix="SET" suffixOverrides=",">a = {u}, b = {e},</trim> X', "SET a = {u}, b = {e} X"),
    ("<trim prefix='(' suffix=')' suffixOverrides='and|,'>a{e} AND</trim>", "( a{e} )"),
    ('<trim prefix="SET s = CASE k" suffix="END"><foreach>WHEN #{k} THEN {u}</foreach></trim>',
     "SET s = CASE k WHEN #{k} THEN {u} END"),
    ('T{e} <trim prefix="WHERE"> </trim>', "T{e}"),
], mp.flatten_tags)


@query("ext_14_mapper_lines",
       "SELECT path, line, count(*) AS cnt FROM (" + fl.expected_sql("mapper") + ") GROUP BY ALL")
def _(spark, sf):
    return mp.extract_mapper(fl.files(spark, sf)).groupBy("path", "line").agg(F.count(F.lit(1)).alias("cnt"))


ALL_EXTRACTORS = ("literal", "mybatis", "jpa", "script", "js", "mapper")
_NOT_SQL = "sql LIKE 'selected %' OR sql LIKE 'update:%'"
EXTRACTED = f"SELECT * FROM ({fl.expected_sql(*ALL_EXTRACTORS)}) WHERE NOT ({_NOT_SQL}) AND NOT contains(path, '/target/')"


@query("ext_16_extract_all", EXTRACTED)
def _(spark, sf):
    return ex.extract_all(src.drop_ignored(src.supported(fl.files(spark, sf))))
