"""Whole scans of small repositories on disk."""

from pyspark.sql import functions as F

from lintlake.operators import dedupe as dd
from lintlake.operators import rules as ru
from lintlake.operators import schema as sch
from lintlake.operators.extract import extract_all
from lintlake.operators.preprocess import preprocess
from lintlake.operators.scoring import issue_summary
from lintlake.sources import corpus as src


def put(root, name, text):
    f = root / name
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_text(text)


def scan(spark, root):
    files = src.drop_ignored(src.read_corpus(spark, str(root)))
    occ = extract_all(files).cache()
    return files, occ, preprocess(dd.dedupe(occ))


def test_repository_of_all_kinds(spark, tmp_path):
    """One statement of each extractor; the smells and the schema follow from these texts alone."""
    put(tmp_path, "booking/Hall.java", 'interface Hall {\n  @Delete("DELETE FROM hall")\n  void clear();\n  String ALL = "SELECT * FROM hall h WHERE h.city = 3";\n}\n')
    put(tmp_path, "booking/tickets.xml", """<mapper namespace="tickets">
<delete id="drop"><![CDATA[DELETE FROM ticket WHERE price < #{limit}]]></delete>
<select id="list">SELECT seat FROM ticket WHERE hall = #{hall} ORDER BY ${column} LIMIT 5</select></mapper>
""")
    put(tmp_path, "site/load.js", "fetch(`SELECT city FROM hall WHERE seats > 100`);\n")
    put(tmp_path, "db/01_tables.sql", "CREATE TABLE hall (city INT, seats INT, PRIMARY KEY (city));\nCREATE TABLE usher (badge INT);\n")
    put(tmp_path, "notes.txt", "DELETE FROM ticket")
    files, occ, st = scan(spark, tmp_path)
    assert files.count() == 4
    kinds = {r.source_type for r in occ.select("source_type").collect()}
    assert kinds == {"JAVASCRIPT", "MYBATIS", "MYBATIS_ANNOTATION", "SQL_FILE", "STRING_LITERAL"}
    counts = {r.rule_name: r.cnt for r in issue_summary(ru.evaluate(st, profile="scan")).collect()}
    assert counts["SELECT_STAR"] == 1 and counts["SQL_INJECTION"] == 1
    one = sch.schema_summary(st, sch.extract_ddl(files)).first()
    assert one.table_count == 2 and one.ddl_detected


def test_ignored_folders_duplicates_and_broken_sql(spark, tmp_path):
    twice = "SELECT badge FROM usher WHERE shift = 'late'"
    put(tmp_path, "staff/Rota.java", f'class Rota {{ /* rota */\n\n\n\n  Query q = of("{twice}");\n}}\n')
    put(tmp_path, "staff/rota.ts", f"run(`{twice}`);\n")
    put(tmp_path, "db/half.sql", "SELECT FROM FROM ,;")
    for folder in ("target", "build/tmp", "node_modules/lib/a", "out", "dist"):
        put(tmp_path, f"{folder}/copy.sql", "DELETE FROM usher;")
    files, occ, st = scan(spark, tmp_path)
    assert files.count() == 3 and occ.where("sql LIKE 'DELETE%'").count() == 0
    dup = st.where(F.col("original_sql") == twice).first()
    assert dup.location_count == 2
    places = dd.locations(occ).where(F.col("stmt_key") == dup.stmt_key).collect()
    assert {(p.file_name, p.source_type, p.line) for p in places} == {("Rota.java", "STRING_LITERAL", 5), ("rota.ts", "JAVASCRIPT", 1)}


def test_paths_types_and_globs(spark):
    df = spark.createDataFrame([("a\\b\\C.JAVA", "x\ny\n\n"), ("t.tar.gz", ""), ("noext", "\n\n")], "path string, content string")
    got = src.with_file_metrics(src.with_file_type(df)).orderBy("path").collect()
    assert [(r.path, r.ext, r.file_name, r.parent_path, r.line_count) for r in got] == [
        ("a/b/C.JAVA", "java", "C.JAVA", "a/b", 2), ("noext", "", "noext", "", 0), ("t.tar.gz", "gz", "t.tar.gz", "", 1)]
    assert src.glob_regex("a.b/*?") == r"^(?:a\.b/.*.)$"
    assert src.filter_globs(df, [], ["*.gz"]).count() == 2


def test_script_line_is_the_line_of_the_first_character(spark):
    from lintlake.operators.extract import extract_sql_file

    text = "SELECT id FROM a; SELECT id FROM b;\n\n/* x\n y */  DELETE FROM c\nWHERE id = 1;\nUPDATE d SET e = 'x;\n--y' WHERE f = 1"
    df = spark.createDataFrame([("q.sql", text)], "path string, content string")
    got = [(r.line, r.sql) for r in extract_sql_file(df).collect()]
    assert got == [(1, "SELECT id FROM a"), (1, "SELECT id FROM b"), (4, "DELETE FROM c\nWHERE id = 1"),
                   (6, "UPDATE d SET e = 'x;\n--y' WHERE f = 1")]


def test_large_script_in_one_file(spark):
    from lintlake.operators.extract import extract_sql_file

    n = 20_000
    text = "\n".join(f"INSERT INTO t (a, b) VALUES ({i}, 'v;{i}');" for i in range(n))
    df = spark.createDataFrame([("dump.sql", text)], "path string, content string")
    out = extract_sql_file(df)
    assert out.count() == n
    assert out.where("line = 777").first().sql == "INSERT INTO t (a, b) VALUES (776, 'v;776')"


def test_concatenated_statement(rows):
    from lintlake.operators.extract import rebuild_concat

    line = 'return jdbc.query("SELECT seat, row_no FROM hall WHERE show_no = " + show() + " AND sold < " + limit);'
    assert rows([line], rebuild_concat) == ["SELECT seat, row_no FROM hall WHERE show_no = ? AND sold < ?"]


def test_mapper_details(spark):
    from lintlake.operators.mapper import extract_mapper

    xml = """<mapper>
  <delete id="expired">
    DELETE FROM ticket
    <trim prefix="WHERE" prefixOverrides="AND |OR ">
      <if test="hall != null">AND hall = #{hall}</if>
      <choose><when test="day != null">AND day &lt; #{day}</when><otherwise>AND day IS NULL</otherwise></choose>
      <trim prefix="AND seat IN (" suffix=")"><foreach collection="seats" item="s" separator=",">#{s}</foreach></trim>
    </trim>
  </delete>
  <select id="cols">id, name FROM users</select>
  <insert id="add"><selectKey keyProperty="id">SELECT NEXTVAL('s')</selectKey>INSERT INTO u (id) VALUES (#{id})</insert>
</mapper>"""
    bad = "<invalid><unclosed>"
    df = spark.createDataFrame([("a.xml", xml), ("b.xml", bad), ("c.xml", ""), ("d.xml", None)], "path string, content string")
    got = {(r.line, r.sql) for r in extract_mapper(df).collect()}
    assert got == {
        (2, "DELETE FROM ticket WHERE hall = #{hall} AND day < #{day} AND seat IN ( #{s} )"),
        (10, "SELECT id, name FROM users"),
        (11, "INSERT INTO u (id) VALUES (#{id})"),
        (11, "SELECT NEXTVAL('s')"),
    }


def test_tags_nested_to_any_depth(spark):
    from lintlake.operators.mapper import extract_mapper

    def mapper(n):
        return f'<mapper>\n<select id="a">SELECT id FROM seat <where>{"<if test=""x"">".replace(chr(34) * 2, chr(34)) * n}AND row_no = 1{"</if>" * n}</where></select>\n</mapper>'

    df = spark.createDataFrame([(f"{n}.xml", mapper(n)) for n in (1, 12, 13, 40)], "path string, content string")
    assert {r.sql for r in extract_mapper(df).collect()} == {"SELECT id FROM seat WHERE row_no = 1"}


def test_annotation_with_deep_parentheses_and_quotes_in_blocks(spark):
    from lintlake.operators import extract as ex

    deep = "(" * 12 + "1" + ")" * 12
    java = (f'interface A {{\n @Select({deep} + "SELECT id FROM seat WHERE n = (2)")\n int a();\n'
            ' @Delete("DELETE FROM seat WHERE s = \'x\'")\n int b();\n'
            ' String q = """\n  SELECT "row no", price FROM seat WHERE hall = \'${h}\' AND a = ""\n """;\n}')
    df = spark.createDataFrame([("A.java", java)], "content_path string, content string")
    got = df.select(ex.mybatis_annotations(F.col("content")).alias("m"), ex.java_literals(F.col("content")).alias("j")).first()
    assert [(x.line, x.sql) for x in got.m] == [(2, "SELECT id FROM seat WHERE n = (2)"), (4, "DELETE FROM seat WHERE s = 'x'")]
    assert "SELECT \"row no\", price FROM seat WHERE hall = '${h}' AND a = \"\"" in [x.sql for x in got.j]


def test_every_file_is_read(spark, tmp_path):
    from lintlake.sources.corpus import read_every_file

    texts = {
        "db/a.sql": "SELECT 1", "_migrations/b.sql": "SELECT 2", "web/__tests__/deep/c.ts": "const a = 1;",
        ".hidden/d.SQL": "SELECT 'é'", "db/_e.sql": "", "db/.f.xml": "<a/>", "sp ace/g+%20.java": "class G {}",
    }
    for name, text in {**texts, "db/readme.md": "no", "_x/y.txt": "no"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    (tmp_path / "db/bytes.sql").write_bytes(b"SELECT '\xff'")
    (tmp_path / "empty").mkdir()
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        rows = read_every_file(spark, root).collect()
        assert {r.path: r.content for r in rows} == texts | {"db/bytes.sql": "SELECT '\ufffd'"}
        assert len(rows) == len(texts) + 1 and all(r.error is None for r in rows)


def test_missing_root_is_a_row(spark, tmp_path):
    from lintlake.sources.corpus import read_every_file

    (row,) = read_every_file(spark, str(tmp_path / "nowhere")).collect()
    assert row.content is None and row.error


def test_walk_does_not_follow_links_to_folders(spark, tmp_path):
    """A link to the folder above and one to a folder beside: every file once; a link to a file is read."""
    from lintlake.sources.corpus import read_every_file

    root, other = tmp_path / "root", tmp_path / "other"
    (root / "a" / ".hidden").mkdir(parents=True)
    other.mkdir()
    (root / "a" / "x.sql").write_text("SELECT 1 FROM t")
    (root / "a" / ".hidden" / "_y.sql").write_text("SELECT 2 FROM t")
    (other / "z.sql").write_text("SELECT 3 FROM t")
    (root / "a" / "up").symlink_to(root, target_is_directory=True)
    (root / "beside").symlink_to(other, target_is_directory=True)
    (root / "linked.sql").symlink_to(other / "z.sql")
    (root / "gone.sql").symlink_to(tmp_path / "nowhere.sql")
    got = {r.path: (r.content, r.error is None) for r in read_every_file(spark, str(root)).collect()}
    found = {p: c for p, (c, fine) in got.items() if fine}
    assert found == {"a/x.sql": "SELECT 1 FROM t", "a/.hidden/_y.sql": "SELECT 2 FROM t", "linked.sql": "SELECT 3 FROM t"}
