"""Text columns: normalise, classify, fingerprint, repair, mask, split into SELECT blocks.

Loops inside a pattern are possessive (``++``, ``*+``): the Java matcher then walks
long literals and long statements in a loop and not by recursion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions.sqltext import let, sql_map

BLANKS = " \t\n\r\x0b\x0c"
QUOTED_SINGLE = r"'(?:[^'\\]++|\\.)*+'"
QUOTED_DOUBLE = r'"(?:[^"\\]++|\\.)*+"'


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def one_space(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def normalize(c: Column) -> Column:
    """PRE-3: one space between words, none at the ends."""
    return F.trim(one_space(c))


def split_by(c: Column, pattern: str) -> Column:
    """Split by a long pattern: ``split`` would compile it anew for every value, ``regexp_replace`` does not."""
    return F.split(F.regexp_replace(c, pattern, CUT), CUT, -1)


def printable(c: Column) -> Column:
    """Without the control characters that text functions use as marks of their own."""
    return F.when(c.rlike(r"[\x00-\x08]"), F.regexp_replace(c, r"[\x00-\x08]++", "")).otherwise(c)


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def any_prefix(c: Column, prefixes: list[str]) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | c.startswith(p)
    return hit


# --- candidate filter ------------------------------------------------------------------


def is_cache_key(c: Column) -> Column:
    """EXT-2: ``update:sku:3`` and the like are keys of a cache, not SQL."""

    def is_key(text: Column) -> Column:
        count = lambda sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
        return ~text.contains(" ") | ((count(":") > 2) & (count(":") > count(" ")))

    return c.contains(":") & let(strip(c), is_key)


# Leading keyword and the word which that keyword needs, as one pattern: one pass over the text.
_STATEMENT = (
    r"(?is)^\s*(?:SELECT\s+\S"
    r"|(?:INSERT|REPLACE)\s(?:.*?\s)?INTO\s+\S"
    r"|UPDATE\s(?:.*?\s)?SET\s+\S"
    r"|DELETE\s(?:.*?\s)?FROM\s+\S"
    r"|CREATE\s+(?:TEMPORARY\s+)?(?:" + "|".join(fv.CREATE_OBJECTS) + r")\b"
    r"|ALTER\s+(?:" + "|".join(fv.ALTER_OBJECTS) + r")\b"
    r"|DROP\s+(?:" + "|".join(fv.DROP_OBJECTS) + r")\b"
    r"|TRUNCATE\s+\S"
    r"|(?:" + "|".join(fv.ALWAYS_SQL_KEYWORDS) + r")\s+\S)"
)


def looks_like_sql(c: Column) -> Column:
    """EXT-1: long enough, not a cache key, and shaped like a statement."""
    return F.coalesce(
        (F.length(c) >= fv.MIN_SQL_LENGTH) & c.rlike(_STATEMENT) & ~is_cache_key(c), F.lit(False)
    )


def looks_like_fragment(c: Column) -> Column:
    """Starts with a statement keyword; used to find where a concatenated statement begins."""
    return F.coalesce(c.rlike(r"(?is)^\s*(?:" + "|".join(fv.FRAGMENT_KEYWORDS) + r")\s+\S"), F.lit(False))


# --- classify and fingerprint --------------------------------------------------------------


def sql_type(c: Column) -> Column:
    """PRE-1."""
    u = F.upper(strip(c))
    out = F.when(is_blank(c), "OTHER")
    for t in fv.SQL_TYPES:
        out = out.when(u.startswith(t), t)
    return out.otherwise("OTHER")


def sql_category(sql: Column, source_type: Column) -> Column:
    """PRE-2."""
    text = F.coalesce(sql, F.lit(""))
    dynamic = text.rlike(r"(?i)<(" + "|".join(fv.DYNAMIC_TAGS) + r")\b")
    template = text.contains("#{") | text.contains("${")
    return (
        F.when(source_type == "MYBATIS", F.when(dynamic, "MYBATIS_XML_DYNAMIC").otherwise("MYBATIS_XML_STATIC"))
        .when(source_type == "MYBATIS_ANNOTATION", "MYBATIS_ANNOTATION")
        .when(source_type == "JPA_ANNOTATION", "JPA_NATIVE_QUERY")
        .when(template, "PLACEHOLDER_TEMPLATE")
        .when(source_type == "STRING_LITERAL", "STRING_CONCAT")
        .otherwise("UNKNOWN")
    )


def abstract_sql(c: Column) -> Column:
    """PRE-4: literals and numbers become ``?``."""
    t = F.regexp_replace(strip(c), QUOTED_SINGLE, "?")
    t = F.regexp_replace(t, QUOTED_DOUBLE, "?")
    t = F.regexp_replace(t, r"\b\d+(?:\.\d+)?\b", "?")
    return normalize(t)


def sql_hash(abstract: Column) -> Column:
    """PRE-5: SHA-256 of the fingerprint text."""
    return F.sha2(abstract, 256)


def short_hash(abstract: Column) -> Column:
    return F.left(sql_hash(abstract), F.lit(8))


def sql_id(abstract: Column) -> Column:
    return F.concat(F.lit("sql-"), sql_hash(abstract))


# --- repair ------------------------------------------------------------------------------------


def _rewrite(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def fix_template(c: Column) -> Column:
    """PRE-6: make a mapper template parseable; ``${}`` stays, it is a finding."""
    steps = [
        (fv.INCLUDE_MARK, "*"),
        (fv.BIND_MARK, ""),
        (fv.TEMPLATE_TAG, " "),
        (fv.IN_HASH_PAREN, "IN (1)"),
        (fv.IN_HASH, "IN (1)"),
        (fv.HASH_PARAM, "1"),
        *fv.TEMPLATE_REPAIRS,
    ]
    return normalize(_rewrite(c, steps))


def fix_concat(c: Column) -> Column:
    """PRE-7: glue ``"a" + "b"`` and drop escapes of quotes."""
    t = _rewrite(c, [(r'"\s*\+\s*"', ""), (r"'\s*\+\s*'", "")])
    return normalize(F.replace(t, F.lit('\\"'), F.lit('"')))


TEMPLATE_CATEGORIES = ["MYBATIS_XML_DYNAMIC", "MYBATIS_XML_STATIC", "MYBATIS_ANNOTATION", "PLACEHOLDER_TEMPLATE"]
CONCAT_CATEGORIES = ["STRING_CONCAT", "PLACEHOLDER_TEMPLATE"]


def apply_fixers(c: Column, category: Column) -> Column:
    """PRE-8: the fixers a category asks for, template fixer first."""
    template, concat = category.isin(*TEMPLATE_CATEGORIES), category.isin(*CONCAT_CATEGORIES)
    return (
        F.when(template & concat, fix_concat(fix_template(c)))
        .when(template, fix_template(c))
        .when(concat, fix_concat(c))
        .otherwise(c)
    )


# --- shape check ---------------------------------------------------------------------------------

_LEADING = (
    r"^\(?\s*(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|TRUNCATE|REPLACE|WITH|CALL|SHOW|DESC|DESCRIBE|"
    r"EXPLAIN|MERGE|SET|USE)\b"
)
_BROKEN = [
    r"#\{|\$\{",
    r",\s*,",
    r"\(\s*,|,\s*\)",
    r"\bFROM\s*(WHERE\b|AND\b|OR\b|GROUP\b|ORDER\b|LIMIT\b|$)",
    r"\bWHERE\s*(AND\b|OR\b|GROUP\b|ORDER\b|LIMIT\b|$)",
    r"\b(AND|OR|SET|BY|VALUES|ON)\s*$",
    r"\b(WHERE|VALUES|SET|CASE)\s*\?(\s|$)",
    fv.FROM_AND,
]


def shape_of_masked(m: Column) -> Column:
    """PRE-9: a light check of a masked text's shape in place of a parser."""
    ok = m.rlike(_LEADING)
    ok = ok & (F.regexp_count(m, F.lit(r"\(")) == F.regexp_count(m, F.lit(r"\)")))
    ok = ok & ~F.replace(m, F.lit("''"), F.lit("")).contains("'")
    ok = ok & ~m.rlike("|".join(_BROKEN))
    return F.coalesce(ok, F.lit(False))


def shape_ok(c: Column) -> Column:
    return shape_of_masked(masked(c))


# --- masked text and SELECT blocks ------------------------------------------------------------------


#: One lexer pass: comments, quoted texts and names, numbers, words, blanks, then single signs.  Comments that
#: stand for an include or a bind are marks of the mapper reader and no comments.
_COMMENT = r"--[^\n]*+|/\*(?!\s*(?:INCLUDE|BIND):)(?:[^*]++|\*(?!/))*+(?:\*/|\*?$)"
_TOKEN = "|".join([QUOTED_SINGLE, QUOTED_DOUBLE, r"`[^`]*+`", _COMMENT, r"\d++(?:\.\d++)?", r"[\p{L}_$][\p{L}\p{N}_$]*+", r"\s++", r"[^\s]"])
_KINDS = [("--", "comment"), ("/*", "comment"), ("'", "string"), ('"', "quoted"), ("`", "name")]


def tokens(c: Column) -> Column:
    """The text as an array of (kind, text): comment, string, quoted, name, number, word, blank or symbol.

    Joined again the texts give the whole input.  A quote that is never closed is a symbol, an open block
    comment ends with the text.
    """

    def typed(t: Column) -> Column:
        kind = F.when(t.rlike(r"^\s"), "blank").when(t.rlike(r"^[\p{L}_$]"), "word").when(t.rlike(r"^\d"), "number")
        for start, name in _KINDS:
            kind = kind.when(t.startswith(start) & (F.length(t) > 1), name)
        return F.struct(kind.otherwise("symbol").alias("kind"), t.alias("text"))

    return F.transform(F.regexp_extract_all(c, F.lit(f"(?s){_TOKEN}"), F.lit(0)), typed)


def without_comments(c: Column) -> Column:
    """A blank for each comment; signs of comments within quotes stay."""
    cut = F.array_join(F.transform(tokens(c), lambda t: F.when(t["kind"] == "comment", " ").otherwise(t["text"])), "")
    return F.when(c.rlike(r"--|/\*"), cut).otherwise(c)


LITERAL = r"(')(?:[^'\\]++|\\.)*+'" + "|" + r'(")(?:[^"\\]++|\\.)*+"'


def masked(c: Column) -> Column:
    """PRE-10: no comments, upper case, one space, literals emptied; both kinds of quotes in one pass from the left."""
    return F.regexp_replace(F.upper(normalize(without_comments(c))), LITERAL, "$1$1$2$2")


_INNER = r"\([^()]*\)"
_INNER_SELECT = r"(?:\bFROM|\bJOIN|^|\bUNION|\bUNION ALL|\bINTERSECT|\bEXCEPT|\bMINUS) ?\( ?(SELECT [^()]*)\)"
_WITH_HEAD = r"^WITH (?:RECURSIVE )?(?:[\w`\"]+ ?(?:~ ?)?AS ?~ ?,? ?)+"
CUT = "\x07"
_SET_OPS = r" (?:UNION ALL|UNION DISTINCT|UNION|INTERSECT|EXCEPT|MINUS) "


def _collapsed(m: Column) -> Column:
    """Replace the innermost parentheses by ``~`` until none is left: struct(text, found, open).

    ``found`` collects the SELECTs met on the way.  One pass removes one level, so as many
    rounds as there are ``(`` always suffice; once a pass changes nothing or leaves no ``(``
    the remaining rounds only read a flag, which keeps a statement with very many
    parentheses (a bulk insert, say) cheap.
    """
    rounds = F.array_repeat(F.lit(0), F.regexp_count(m, F.lit(r"\(")).cast("int"))
    none = F.array().cast("array<string>")

    def state(text: Column, found: Column, is_open: Column) -> Column:
        return F.struct(text.alias("text"), found.alias("found"), is_open.alias("open"))

    def one_pass(s: Column) -> Column:
        more = F.concat(s["found"], F.regexp_extract_all(s["text"], F.lit(_INNER_SELECT), F.lit(1)))
        return let(
            F.regexp_replace(s["text"], _INNER, "~"),
            lambda t: state(t, more, t.contains("(") & (t != s["text"])),
        )

    return F.aggregate(rounds, state(m, none, F.lit(True)), lambda s, _: F.when(s["open"], one_pass(s)).otherwise(s))


def collapse(m: Column) -> Column:
    return _collapsed(m)["text"]


def skeleton(m: Column) -> Column:
    """PRE-11: top-level clauses of a masked text, every parenthesis reduced to ``~``."""
    return F.regexp_replace(collapse(m), _WITH_HEAD, "")


def select_blocks(m: Column) -> Column:
    """PRE-12: the top-level SELECT, the branches of set operations, the derived tables."""
    texts = let(
        _collapsed(m),
        lambda s: F.concat(F.array(F.regexp_replace(s["text"], _WITH_HEAD, "")), s["found"]),
    )
    parts = F.flatten(F.transform(texts, lambda t: split_by(t, _SET_OPS)))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.startswith("SELECT "))


_CLAUSE = r"(?:WHERE|GROUP BY|HAVING|ORDER BY|LIMIT|UNION|INTERSECT|EXCEPT|MINUS)(?=[ (\x01]|$)"
_PLAIN = rf"\(((?:[^() ]++| (?!{_CLAUSE}))*+)\)"
_PIECES = rf"(?=[()])|(?<=[()])|(?= {_CLAUSE})|(?<=\x02)(?={_CLAUSE})"


def where_conditions(m: Column) -> Column:
    """The WHERE condition of each block of a masked text, without later clauses, at any depth.

    A subquery stays in the condition around it, without its own later clauses.  Parentheses with
    no clause in them are set aside first, as in ``_collapsed``; the pieces between the others are
    read with a stack of two flags a level: in a condition outside of it, and now.
    """
    rounds = F.array_repeat(F.lit(0), F.regexp_count(m, F.lit(r"\(")).cast("int"))

    def one_pass(s: Column) -> Column:
        return let(
            F.regexp_replace(s["text"], _PLAIN, "\x01$1\x02"),
            lambda t: F.struct(t.alias("text"), (t.contains("(") & (t != s["text"])).alias("open")),
        )

    def state(stack: Column, kept: Column) -> Column:
        return F.struct(stack.alias("stack"), kept.alias("kept"))

    def read(s: Column, piece: Column) -> Column:
        stack, kept = s["stack"], s["kept"]
        now, base = F.right(stack, F.lit(1)), F.substring(stack, -2, 1)
        below = F.when(F.length(stack) > 2, F.left(stack, F.length(stack) - 2)).otherwise(stack)

        def turn(flag: Column) -> Column:
            return F.concat(F.left(stack, F.length(stack) - 1), flag)

        def more(on: Column) -> Column:
            return F.when(on == "1", F.concat(kept, F.array(piece))).otherwise(kept)

        later = piece.rlike("^ ?(?:GROUP BY|HAVING|ORDER BY|LIMIT)(?:[ \x01]|$)")
        set_op = piece.rlike("^ ?(?:UNION|INTERSECT|EXCEPT|MINUS)(?:[ \x01]|$)")
        begins = piece.startswith(" WHERE ") | (piece == " WHERE")
        return (
            F.when(piece == "(", state(F.concat(stack, now, now), more(now)))
            .when(piece == ")", state(below, more(F.right(below, F.lit(1)))))
            .when(begins & (F.concat(base, now) == "00"), state(turn(F.lit("1")), F.concat(kept, F.array(F.lit(CUT), F.substr(piece, F.lit(8))))))
            .when(begins, state(turn(F.lit("1")), F.concat(kept, F.array(piece))))
            .when(later, state(turn(F.lit("0")), kept))
            .when(set_op, state(turn(base), more(base)))
            .otherwise(state(stack, more(now)))
        )

    start = F.struct(F.translate(m, f"{CUT}\x01\x02", "   ").alias("text"), F.lit(True).alias("open"))
    aside = F.aggregate(rounds, start, lambda s, _: F.when(s["open"], one_pass(s)).otherwise(s))["text"]
    none = F.array().cast("array<string>")
    kept = F.array_join(F.aggregate(F.split(aside, _PIECES), state(F.lit("00"), none), read)["kept"], "")
    found = F.filter(F.split(F.translate(kept, "\x01\x02", "()"), CUT), lambda c: c != "")
    first = F.regexp_extract(m, "^[^()]*? WHERE (.*)$", 1)  # all there is where no other clause and no parenthesis comes before
    single = (first != "") & (F.regexp_count(m, F.lit(rf"(?:^|[ )]){_CLAUSE}")) == 1)
    return F.when(single, F.array(first)).when(m.contains(" WHERE "), found).otherwise(F.array().cast("array<string>"))


# --- labels -------------------------------------------------------------------------------------------


def label(c: Column) -> Column:
    """PRE-14: display label; unknown codes become Title Case."""
    table = F.expr(sql_map(fv.LABELS))
    code = strip(c)
    words = F.filter(F.split(F.lower(code), "_"), lambda w: F.trim(w) != "")
    title = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " "
    )
    return F.when(is_blank(c), fv.LABEL_OF_BLANK).otherwise(F.coalesce(F.element_at(table, code), title))
