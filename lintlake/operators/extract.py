"""SQL candidates of source files.

Each extractor is a column expression from the text of one file to an array of
(line, sql); a file is read once whatever its type, and exploding the array needs no
shuffle.  Places are kept by writing the line number into the text, between two control
characters, before a pattern is applied and taking it out of the result: the text is
walked once, however many statements it holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text as tx
from lintlake.functions.sqltext import let
from lintlake.sources.corpus import extension, file_name

CANDIDATES = "array<struct<line:int,sql:string>>"
OPEN, CLOSE = "\x01", "\x02"
MARK = OPEN + r"(\d++)" + CLOSE

STRING_SQL = r'(?i)"([^"$]*?\b(?:' + "|".join(fv.LITERAL_KEYWORDS) + r')\b[^"$]{4,}?)"'
LITERAL = r'(?s)"((?:[^"\\]++|\\.)*+)"'


def none() -> Column:
    return F.array().cast(CANDIDATES)


def candidate(line: Column, sql: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), sql.alias("sql"))


def unmark(c: Column) -> Column:
    return F.regexp_replace(c, OPEN + r"\d+" + CLOSE, "")


def line_mark(i: Column) -> Column:
    """The mark of the line with 0-based number ``i``."""
    return F.concat(F.lit(OPEN), (i + 1).cast("string"), F.lit(CLOSE))


def per_line(content: Column, edit: Callable[[Column, Column], Column]) -> Column:
    """Rewrite every line by ``edit(line, number)``."""
    return F.array_join(F.transform(F.split(content, "\n"), edit), "\n")


def unescape(c: Column) -> Column:
    """Java escapes, decoded from left to right."""
    t = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for code, char in (("n", "\n"), ("t", "\t"), ("r", "\r")):
        t = F.replace(t, F.lit("\\" + code), F.lit(char))
    decoded = F.replace(F.regexp_replace(t, r"(?s)\\(.)", "$1"), F.lit("\x00"), F.lit("\\"))
    return F.when(c.contains("\\"), decoded).otherwise(F.replace(c, F.lit("\x00"), F.lit("\\")))


# --- Java -----------------------------------------------------------------------------------------


def _is_expression(between: Column) -> Column:
    """Something other than ``+`` and closing signs stands between two literals."""
    return between.contains("+") & (tx.strip(F.translate(between, "+);,", "")) != "")


def rebuild_concat(line: Column) -> Column:
    """EXT-4: the statement a line concatenates, ``?`` for every expression; null when there is none."""
    def joined(parts: Column, gaps: Column, first: Column) -> Column:
        rest = F.zip_with(
            F.slice(parts, first, F.size(parts)),
            F.slice(gaps, first + 1, F.size(gaps)),
            lambda p, g: F.concat(p, F.when(_is_expression(g), "?").otherwise("")),
        )
        return F.array_join(rest, "")

    def rebuilt(parts: Column) -> Column:
        first = F.array_position(F.transform(parts, tx.looks_like_fragment), True).cast("int")
        return let(first, lambda at: F.when(at > 0, let(tx.split_by(line, LITERAL), lambda gaps: joined(parts, gaps, at))))

    parts = F.transform(F.regexp_extract_all(line, F.lit(LITERAL), F.lit(1)), unescape)
    return F.when(line.contains("+"), tx.normalize(let(parts, rebuilt)))


def java_literals(content: Column) -> Column:
    """EXT-3 and EXT-4: string literals that are SQL, and Java text blocks.

    On a line with a rebuilt statement, literals before it count, later ones belong to it.
    """
    lines = F.filter(
        F.transform(F.split(content, "\n"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"))),
        lambda x: x["text"].contains('"') & x["text"].rlike(STRING_SQL),
    )
    found = F.transform(
        lines,
        lambda x: F.struct(
            x["line"].alias("line"),
            F.transform(F.regexp_extract_all(x["text"], F.lit(STRING_SQL), F.lit(1)), tx.strip).alias("literals"),
            rebuild_concat(x["text"]).alias("rebuilt"),
        ),
    )
    judged = F.transform(
        found,
        lambda x: F.struct(
            x["line"].alias("line"),
            x["literals"].alias("literals"),
            x["rebuilt"].alias("rebuilt"),
            F.when(
                tx.looks_like_sql(x["rebuilt"]),
                F.array_position(F.transform(x["literals"], tx.looks_like_fragment), True).cast("int"),
            ).otherwise(0).alias("start"),
        ),
    )
    singles = F.flatten(
        F.transform(
            judged,
            lambda x: F.concat(
                F.transform(
                    F.filter(
                        F.when(x["start"] > 0, F.slice(x["literals"], F.lit(1), x["start"] - 1)).otherwise(
                            x["literals"]
                        ),
                        tx.looks_like_sql,
                    ),
                    lambda s: candidate(x["line"], s),
                ),
                F.when(x["start"] > 0, F.array(candidate(x["line"], x["rebuilt"]))).otherwise(none()),
            ),
        )
    )
    return F.concat(singles, F.when(content.contains('"""'), _text_blocks(content)).otherwise(none()))


def _text_blocks(content: Column) -> Column:
    marked = per_line(content, lambda t, i: F.replace(t, F.lit('"""'), F.concat(F.lit('"""'), line_mark(i))))
    block = r'"""' + MARK + r'[ \t\r]*\n((?:[^"]++|"(?!""))*+)"""'
    found = F.zip_with(
        F.regexp_extract_all(marked, F.lit(block), F.lit(1)),
        F.regexp_extract_all(marked, F.lit(block), F.lit(2)),
        lambda n, s: candidate(n, tx.strip(s)),
    )
    return F.filter(found, lambda x: tx.looks_like_sql(x["sql"]))


def _first_call(text: Column) -> Column:
    """The part of ``text`` up to the parenthesis that closes its first one, at any depth; quotes respected."""
    token = r"""(?s)"(?:[^"\\]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|[()]|[^()"']++|["']"""

    def walk(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        ends = F.when((s["ends"] == 0) & (t == ")") & (depth == 0), s["at"] + 1).otherwise(s["ends"])
        return F.struct((s["at"] + 1).alias("at"), depth.alias("depth"), ends.alias("ends"))

    def whole(tokens: Column) -> Column:
        zero = F.lit(0)
        ends = F.aggregate(tokens, F.struct(zero.alias("at"), zero.alias("depth"), zero.alias("ends")), walk)["ends"]
        return F.when(ends > 0, F.array_join(F.slice(tokens, F.lit(1), ends), ""))

    return let(F.regexp_extract_all(text, F.lit(token), F.lit(0)), whole)


def _annotation_calls(content: Column, names: str) -> Column:
    """The arguments of each ``@Name(...)``; their literals carry the number of their line."""
    marked = per_line(content, lambda t, i: F.replace(t, F.lit('"'), F.concat(F.lit('"'), line_mark(i))))
    calls = let(
        F.split(marked, rf"(?i)@(?:{names})\s*(?=\()"),
        lambda parts: F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), _first_call))
    found = F.filter(calls, lambda c: c.isNotNull())
    named = content.contains("@") & content.rlike(rf"(?i)@(?:{names})\s*\(")
    return F.when(named, found).otherwise(F.array().cast("array<string>"))


def _call_sql(call: Column) -> Column:
    literals = F.regexp_extract_all(call, F.lit(r'(?s)"' + MARK + r'((?:[^"\\]++|\\.)*+)"'), F.lit(2))
    texts = F.transform(literals, lambda t: tx.strip(unescape(unmark(t))))
    sql = F.array_join(F.filter(texts, lambda t: t != ""), " ")
    return candidate(F.regexp_extract(call, '"' + MARK, 1), sql)


def mybatis_annotations(content: Column) -> Column:
    """EXT-5: the literals of @Select, @Insert, @Update, @Delete and @SelectKey."""
    calls = _annotation_calls(content, "Select|Insert|Update|Delete|SelectKey")
    return F.filter(F.transform(calls, _call_sql), lambda x: tx.looks_like_sql(x["sql"]))


def jpa_queries(content: Column) -> Column:
    """EXT-6: @Query, native ones only."""
    native = F.filter(_annotation_calls(content, "Query"), lambda c: c.rlike(r"(?i)nativeQuery\s*=\s*true"))
    return F.filter(F.transform(native, _call_sql), lambda x: tx.looks_like_sql(x["sql"]))


def java_simple(content: Column) -> Column:
    """EXT-15: the plain extractor: any literal with a keyword, and @Query(value=...) of native files."""
    literal = r'(?i)"([^"]*?(?:' + "|".join(fv.LITERAL_KEYWORDS) + r')[^"]*?)"'
    annotated = r'(?is)@Query\s*\(\s*value\s*=\s*"([^"]*?)"'
    found = F.concat(
        F.regexp_extract_all(content, F.lit(literal), F.lit(1)),
        F.when(
            content.rlike(r"(?i)nativeQuery\s*=\s*true"), F.regexp_extract_all(content, F.lit(annotated), F.lit(1))
        ).otherwise(F.array().cast("array<string>")),
    )
    sqls = F.filter(F.transform(found, tx.strip), tx.looks_like_sql)
    return F.transform(sqls, lambda s: candidate(F.lit(1), s))


# --- .sql files --------------------------------------------------------------------------------------

_TEXT_1 = r"'[^']*+(?:'|\z)"
_TEXT_2 = r'"[^"]*+(?:"|\z)'
_COMMENT = (
    rf"({_TEXT_1}|{_TEXT_2})|--[^\n]*+|#[^\n]*+"
    rf"|/\*(?:[^*{OPEN}]++|\*(?!/)|({OPEN}\d++{CLOSE}))*+(?:\*/|\z)"
)


def sql_file(content: Column) -> Column:
    """EXT-7: statements of a script, split at ``;`` outside quotes, comments left out.

    The line is that of the first character of the statement.
    """
    marked = per_line(
        content,
        lambda t, i: F.concat(line_mark(i), F.replace(t, F.lit(";"), F.concat(F.lit(";"), line_mark(i)))),
    )
    clean = F.regexp_replace(marked, _COMMENT, "$1$2")
    pieces = F.regexp_extract_all(clean, F.lit(rf"""(?:{_TEXT_1}|{_TEXT_2}|[^;'"]++)++"""), F.lit(0))
    found = F.transform(
        pieces,
        lambda p: candidate(F.regexp_extract(p, rf"^(?:\s*+{MARK})*+", 1), tx.strip(unmark(p))),
    )
    return F.filter(found, lambda x: tx.looks_like_sql(x["sql"]))


# --- JavaScript and TypeScript ----------------------------------------------------------------------------


def js_literals(content: Column) -> Column:
    """EXT-8: back-quoted literals, then other literals, that begin with a statement keyword; line 1."""
    body = lambda quote: rf"(?:[^{quote}\\]++|\\(?s:.)|\\\z)*+"

    def texts(quotes: str) -> Column:
        every = "|".join(rf"{c}{body(c)}(?:{c}|\z)" for c in quotes)
        closed = "|".join(rf"^{c}{body(c)}{c}\z" for c in quotes)
        whole = F.filter(F.regexp_extract_all(content, F.lit(every), F.lit(0)), lambda t: t.rlike(closed))
        return F.transform(whole, lambda t: tx.strip(F.substr(t, F.lit(2), F.length(t) - 2)))

    starts = r"(?i)^(" + "|".join(fv.FRAGMENT_KEYWORDS) + ")"
    found = F.filter(F.concat(texts("`"), texts("\"'")), lambda t: t.rlike(starts))
    return F.transform(found, lambda s: candidate(F.lit(1), s))


# --- files to occurrences -------------------------------------------------------------------------------------


def explode_candidates(files: DataFrame, found: Column) -> DataFrame:
    """``found`` is an array of (line, sql, source_type)."""
    rows = files.select(
        "path", file_name(F.col("path")).alias("file_name"), F.explode_outer(found).alias("x")
    )
    return rows.where(F.col("x").isNotNull()).select("path", "file_name", "x.line", "x.source_type", "x.sql")


def tagged(found: Column, source_type: str) -> Column:
    return F.transform(
        found,
        lambda x: F.struct(
            x["line"].alias("line"), x["sql"].alias("sql"), F.lit(source_type).alias("source_type")
        ),
    )


def _extract(files: DataFrame, exts: tuple[str, ...], find: Callable[[Column], Column], source: str) -> DataFrame:
    wanted = files.where(extension(F.col("path")).isin(*exts))
    return explode_candidates(wanted, tagged(find(tx.printable(F.col("content"))), source))


def extract_java(files: DataFrame) -> DataFrame:
    return _extract(files, ("java",), java_literals, "STRING_LITERAL")


def extract_mybatis_annotations(files: DataFrame) -> DataFrame:
    return _extract(files, ("java",), mybatis_annotations, "MYBATIS_ANNOTATION")


def extract_jpa(files: DataFrame) -> DataFrame:
    return _extract(files, ("java",), jpa_queries, "JPA_ANNOTATION")


def extract_java_simple(files: DataFrame) -> DataFrame:
    return _extract(files, ("java",), java_simple, "JAVA")


def extract_sql_file(files: DataFrame) -> DataFrame:
    return _extract(files, ("sql",), sql_file, "SQL_FILE")


def extract_js(files: DataFrame) -> DataFrame:
    return _extract(files, ("js", "ts"), js_literals, "JAVASCRIPT")


class Extractors:
    """Which column function reads which file type (EXT-16, UDF-2)."""

    def __init__(self):
        from lintlake.operators.mapper import mapper_statements

        self._by_ext: dict[str, list[tuple[int, str, str, Callable[[Column], Column]]]] = {}
        self._frames: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []
        self.register("java", "literals", "STRING_LITERAL", java_literals, 1)
        self.register("java", "mybatis", "MYBATIS_ANNOTATION", mybatis_annotations, 2)
        self.register("java", "jpa", "JPA_ANNOTATION", jpa_queries, 3)
        self.register("xml", "mapper", "MYBATIS", mapper_statements)
        self.register("sql", "script", "SQL_FILE", sql_file)
        self.register("js", "literals", "JAVASCRIPT", js_literals)
        self.register("ts", "literals", "JAVASCRIPT", js_literals)

    def register(
        self, ext: str, name: str, source_type: str, find: Callable[[Column], Column], priority: int = 100
    ) -> Extractors:
        """Add a column function text -> array of (line, sql); the same name replaces."""
        kept = [x for x in self._by_ext.get(ext, []) if x[1] != name]
        self._by_ext[ext] = sorted([*kept, (priority, name, source_type, find)], key=lambda x: (x[0], x[1]))
        return self

    def register_frame(self, ext: str, fn: Callable[[DataFrame], DataFrame]) -> Extractors:
        """Add an extractor over frames, (path, content) -> occurrences, for what a column cannot express."""
        self._frames.append((ext, fn))
        return self

    def extract_all(self, files: DataFrame) -> DataFrame:
        """EXT-16: occurrences of all files.  One pass; each file takes the branch of its type."""
        content = F.col("content")
        empty = F.array().cast("array<struct<line:int,sql:string,source_type:string>>")
        typed = files.select("path", tx.printable(F.col("content")).alias("content"), extension(F.col("path")).alias("ext"))
        found = None
        for ext, entries in self._by_ext.items():
            arrays = F.concat(*[tagged(find(content), source) for _, _, source, find in entries])
            test = F.col("ext") == ext
            found = F.when(test, arrays) if found is None else found.when(test, arrays)
        wanted = typed.where(F.col("ext").isin(*self._by_ext))
        out = explode_candidates(wanted, found.otherwise(empty))
        for ext, fn in self._frames:
            mine = fn(files.where(extension(F.col("path")) == ext))
            out = out.unionByName(mine.select("path", "file_name", "line", "source_type", "sql"))
        return out.where(tx.looks_like_sql(F.col("sql")))


def extract_all(files: DataFrame, extractors: Extractors | None = None) -> DataFrame:
    return (extractors or Extractors()).extract_all(files)
