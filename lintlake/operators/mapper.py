"""SQL of mapper files: statement elements, included fragments, dynamic tags.

The text of one file is rewritten inside its row: elements without inner tags are resolved
first, level by level, down to the depth limit.  Includes look only into their own file, so
no join is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text as tx
from lintlake.functions.sqltext import let
from lintlake.operators.extract import CLOSE, MARK, OPEN, candidate, explode_candidates, per_line, tagged
from lintlake.sources.corpus import extension

ATTRS = r"""(?:[^<>"'/]++|/(?!>)|"[^"]*+"|'[^']*+')*+"""
FRAGMENTS = "array<struct<id:string,body:string>>"

# control characters that hold the alternatives of a choose until it is resolved
WHEN_OPEN, WHEN_CLOSE, ELSE_OPEN, ELSE_CLOSE = "\x03", "\x04", "\x05", "\x06"


def rewrite_each(text: Column, opening: str, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``fn(match)``; text without ``opening`` is left alone."""

    def rewritten(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), fn)
        return F.array_join(
            F.zip_with(tx.split_by(t, pattern), found, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""
        )

    return let(text, lambda t: F.when(t.rlike(opening), rewritten(t)).otherwise(t))


def open_tag(element: Column) -> Column:
    return F.regexp_extract(element, rf"^<{ATTRS}/?>", 0)


def attr(tag: Column, name: str) -> Column:
    value = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    both = lambda t: F.concat(F.regexp_extract(t, value, 1), F.regexp_extract(t, value, 2))
    return let(tag, lambda t: F.when(t.contains("="), both(t)).when(t.isNotNull(), ""))


def inner(element: Column) -> Column:
    return F.regexp_extract(element, rf"(?s)^<{ATTRS}>(.*)</[^<>]*>$", 1)


def spaced(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


# --- tags (EXT-11..13) -------------------------------------------------------------------------------


def where_clause(body: Column) -> Column:
    cut = tx.strip(F.regexp_replace(body, r"(?i)^\s*(AND|OR)\s+", ""))
    return let(cut, lambda t: F.when(t == "", "").otherwise(F.concat(F.lit("WHERE "), t)))


def set_clause(body: Column) -> Column:
    cut = tx.strip(F.regexp_replace(F.regexp_replace(body, r"^\s*,\s*", ""), r"\s*,\s*$", ""))
    return let(cut, lambda t: F.when(t == "", "").otherwise(F.concat(F.lit("SET "), t)))


def _first_override(text: Column, overrides: Column, test: Callable[[Column, Column], Column]) -> Column:
    tokens = F.transform(F.split(overrides, r"\|"), lambda k: F.trim(k))
    return F.coalesce(F.get(F.filter(tokens, lambda k: (k != "") & test(F.upper(text), F.upper(k))), F.lit(0)), F.lit(""))


def trim_element(tag: Column, body: Column) -> Column:
    """EXT-13: drop the first override that fits at each end, then add prefix and suffix."""

    def cut_front(s: Column) -> Column:
        token = _first_override(s["text"], s["po"], lambda t, k: t.startswith(k))
        return tx.strip(F.substr(s["text"], F.length(token) + 1))

    def cut_back(s: Column) -> Column:
        token = _first_override(s["text"], s["so"], lambda t, k: t.endswith(k))
        return tx.strip(F.substr(s["text"], F.lit(1), F.length(s["text"]) - F.length(token)))

    def state(text: Column, s: Column | None = None) -> Column:
        get = lambda k, a: (s[k] if s is not None else attr(tag, a)).alias(k)
        return F.struct(
            text.alias("text"), get("po", "prefixOverrides"), get("so", "suffixOverrides"),
            get("pre", "prefix"), get("suf", "suffix"),
        )

    front = F.transform(F.array(state(tx.strip(body))), lambda s: state(cut_front(s), s))
    back = F.transform(front, lambda s: state(cut_back(s), s))
    done = F.transform(
        back,
        lambda s: F.when(s["text"] == "", "").otherwise(
            F.concat(
                F.when(F.trim(s["pre"]) != "", F.concat(s["pre"], F.lit(" "))).otherwise(""),
                s["text"],
                F.when(F.trim(s["suf"]) != "", F.concat(F.lit(" "), s["suf"])).otherwise(""),
            )
        ),
    )
    return done[0]


def choose_element(body: Column) -> Column:
    whens = F.regexp_extract_all(body, F.lit(f"{WHEN_OPEN}([^{WHEN_CLOSE}]*){WHEN_CLOSE}"), F.lit(1))
    others = F.regexp_extract_all(body, F.lit(f"{ELSE_OPEN}([^{ELSE_CLOSE}]*){ELSE_CLOSE}"), F.lit(1))
    return F.coalesce(
        F.get(F.filter(whens, lambda t: tx.strip(t) != ""), F.lit(0)), F.try_element_at(others, F.lit(-1)), F.lit("")
    )


def foreach_element(tag: Column, body: Column) -> Column:
    return F.concat(F.trim(attr(tag, "open")), F.when(body == "", "1").otherwise(body), F.trim(attr(tag, "close")))


def resolve_element(e: Column) -> Column:
    """EXT-11: text of an element without inner tags."""
    name, tag, body = e["name"], e["tag"], e["body"]
    text = (
        F.when(name == "when", F.concat(F.lit(WHEN_OPEN), body, F.lit(WHEN_CLOSE)))
        .when(name == "otherwise", F.concat(F.lit(ELSE_OPEN), body, F.lit(ELSE_CLOSE)))
        .when(name == "choose", choose_element(body))
        .when(name == "foreach", foreach_element(tag, body))
        .when(name == "where", where_clause(body))
        .when(name == "set", set_clause(body))
        .when(name == "trim", trim_element(tag, body))
        .otherwise(body)
    )
    return spaced(text)


_LEAF = rf"(?s)<([A-Za-z][\w:.-]*)\b{ATTRS}(?:/>|>[^<]*</\1\s*>)"


def _one_level(text: Column) -> Column:
    def parts(m: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(m, r"^<([\w:.-]+)", 1)).alias("name"),
            open_tag(m).alias("tag"),
            tx.strip(inner(m)).alias("body"),
        )

    found = F.transform(F.regexp_extract_all(text, F.lit(_LEAF), F.lit(0)), parts)
    return F.array_join(
        F.zip_with(
            tx.split_by(text, _LEAF), found,
            lambda p, e: F.concat(p, F.when(e.isNull(), "").otherwise(resolve_element(e))),
        ),
        "",
    )


def flatten_tags(body: Column) -> Column:
    """EXT-11..13: resolve dynamic tags from the inside out, to any depth.

    A pass resolves one level, so as many as there are tags suffice; once a pass changes
    nothing the others only read a flag.
    """
    def state(text: Column, is_open: Column) -> Column:
        return F.struct(text.alias("text"), is_open.alias("open"))

    def one_pass(s: Column) -> Column:
        return let(_one_level(s["text"]), lambda t: state(t, t.contains("<") & (t != s["text"])))

    def resolved(text: Column) -> Column:
        rounds = F.array_repeat(F.lit(0), F.regexp_count(text, F.lit("<[A-Za-z]")).cast("int"))
        flat = F.aggregate(
            rounds, state(text, F.lit(True)), lambda s, _: F.when(s["open"], one_pass(s)).otherwise(s))["text"]
        flat = let(flat, lambda t: F.when(t.contains("<"), F.regexp_replace(t, r"<[^<>]*>", " ")).otherwise(t))
        return F.translate(flat, WHEN_OPEN + WHEN_CLOSE + ELSE_OPEN + ELSE_CLOSE, "    ")

    # the body is a chain of rewrites of its own: computed once here, not once for each use
    marks = WHEN_OPEN + WHEN_CLOSE + ELSE_OPEN + ELSE_CLOSE
    return let(body, lambda t: tx.normalize(F.when(t.contains("<"), resolved(t)).otherwise(F.translate(t, marks, "    "))))


# --- includes (EXT-10) ---------------------------------------------------------------------------------------

_INCLUDE = rf"(?is)<include\b{ATTRS}(?:/>|>.*?</include\s*>)"
_BIND = rf"(?is)<bind\b{ATTRS}(?:/>|>\s*</bind\s*>)"
_SELECT_KEY = rf"(?is)<selectKey\b{ATTRS}>.*?</selectKey\s*>"


def resolve_includes(text: Column, fragments: Column) -> Column:
    """Included fragments by full id, else by the part behind the last dot; unknown ones leave a mark."""

    def hit(key: Column) -> Column:
        return F.try_element_at(F.filter(fragments, lambda f: f["id"] == key), F.lit(-1))["body"]

    def body_of(ref: Column) -> Column:
        return F.coalesce(hit(ref), F.when(ref.contains("."), let(F.substring_index(ref, ".", -1), hit)))

    def named(ref: Column) -> Column:
        missing = F.when(F.trim(ref) == "", "").otherwise(F.concat(F.lit("/* INCLUDE:"), ref, F.lit(" */")))
        return spaced(F.coalesce(body_of(ref), missing))

    def one(m: Column) -> Column:
        return let(attr(open_tag(m), "refid"), named)

    return rewrite_each(text, "(?i)<include", _INCLUDE, one)


def _binds(text: Column) -> Column:
    return rewrite_each(
        text, "(?i)<bind", _BIND,
        lambda m: let(open_tag(m), lambda tag: F.concat(
            F.lit(" /* BIND:"), attr(tag, "name"), F.lit("="), attr(tag, "value"), F.lit(" */ "))),
    )


def flatten_body(body: Column, fragments: Column) -> Column:
    return flatten_tags(_binds(resolve_includes(body, fragments)))


def fragments_of(text: Column) -> Column:
    """The <sql> fragments in order; each may include those before it."""
    found = F.regexp_extract_all(text, F.lit(rf"(?is)<sql\b{ATTRS}>.*?</sql\s*>"), F.lit(0))

    def add(acc: Column, m: Column) -> Column:
        fid = attr(open_tag(m), "id")
        entry = F.transform(
            F.array(F.struct(fid.alias("id"), flatten_body(inner(m), acc).alias("body"))),
            lambda f: F.when((F.trim(f["id"]) == "") | (f["body"] == ""), acc).otherwise(
                F.concat(
                    acc,
                    F.array(f),
                    F.when(
                        f["id"].contains("."),
                        F.array(F.struct(F.substring_index(f["id"], ".", -1).alias("id"), f["body"].alias("body"))),
                    ).otherwise(F.array().cast(FRAGMENTS)),
                )
            ),
        )
        return entry[0]

    return F.aggregate(found, F.array().cast(FRAGMENTS), add)


# --- statements (EXT-9, EXT-14) ------------------------------------------------------------------------------------


def _escaped_cdata(text: Column) -> Column:
    def escape(c: Column) -> Column:
        for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(raw), F.lit(code))
        return c

    end = "]]>"
    parts = F.transform(
        tx.split_by(text, r"<!\[CDATA\["),
        lambda p, i: F.when(i == 0, p).otherwise(
            F.concat(
                escape(F.substring_index(p, end, 1)),
                F.when(p.contains(end), F.substr(p, F.instr(p, end) + F.lit(len(end)))).otherwise(""),
            )
        ),
    )
    return F.array_join(parts, "")


def _entities(c: Column) -> Column:
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


_TAGS = "|".join(fv.STATEMENT_TAGS)


def prepared_text(content: Column) -> Column:
    """Line numbers in the statement tags; no comments, tests or CDATA marks."""
    numbered = per_line(
        content,
        lambda t, i: F.when(
            t.contains("<"),
            F.regexp_replace(
                t, F.lit(rf"(?i)<({_TAGS})\b"),
                F.concat(F.lit("<$1 " + OPEN), (i + 1).cast("string"), F.lit(CLOSE + " ")),
            ),
        ).otherwise(t),
    )
    text = F.regexp_replace(_escaped_cdata(numbered), r"(?s)<!--.*?-->", "")
    return F.regexp_replace(text, rf"(?i)<(if|when)\b{ATTRS}>", "<$1>")


def _elements(text: Column, fragments: Column) -> Column:
    outer = rf"(?is)<(select|insert|update|delete)\b{ATTRS}>.*?</\1\s*>"
    found = F.concat(
        F.transform(
            F.regexp_extract_all(text, F.lit(outer), F.lit(0)),
            lambda m: F.struct(open_tag(m).alias("tag"), F.regexp_replace(inner(m), _SELECT_KEY, "").alias("body")),
        ),
        F.transform(
            F.regexp_extract_all(text, F.lit(_SELECT_KEY), F.lit(0)),
            lambda m: F.struct(open_tag(m).alias("tag"), inner(m).alias("body")),
        ),
    )
    return F.transform(
        found,
        lambda e: F.struct(
            F.lower(F.regexp_extract(e["tag"], r"^<(\w+)", 1)).alias("name"),
            attr(e["tag"], "id").alias("id"),
            F.regexp_extract(e["tag"], MARK, 1).cast("int").alias("line"),
            _entities(flatten_body(e["body"], fragments)).alias("sql"),
        ),
    )


def mapper_statements(content: Column) -> Column:
    """EXT-9: (line, sql) of each statement element; a select without its verb gets one.

    EXT-14: the line is that of the first element with the same tag and id, or with the same
    tag where the element has no id.
    """
    text = F.transform(F.array(prepared_text(tx.printable(content))), lambda t: F.struct(t.alias("text"), fragments_of(t).alias("frag")))
    elements = F.transform(text, lambda s: _elements(s["text"], s["frag"]))[0]
    places = lambda es: F.transform(es, lambda e: F.struct(e["name"], e["id"], e["line"]))
    located = F.transform(F.array(elements), lambda es: F.struct(es.alias("es"), places(es).alias("ps")))[0]
    done = F.transform(
        F.array(located),
        lambda s: F.transform(
            s["es"],
            lambda e: candidate(
                F.array_min(
                    F.transform(
                        F.filter(
                            s["ps"],
                            lambda p: (p["name"] == e["name"]) & ((F.trim(e["id"]) == "") | (p["id"] == e["id"])),
                        ),
                        lambda p: p["line"],
                    )
                ),
                F.when(
                    (e["name"] == "select") & ~e["sql"].rlike(r"(?i)^(SELECT|WITH|EXPLAIN)"),
                    F.concat(F.lit("SELECT "), e["sql"]),
                ).otherwise(e["sql"]),
            ),
        ),
    )[0]
    starts = r"(?i)^(" + "|".join(fv.MAPPER_KEYWORDS) + ")"
    return F.filter(
        done, lambda x: x["sql"].rlike(starts) & (F.upper(tx.strip(x["sql"])) != "SELECT")
    )


def extract_mapper(files: DataFrame) -> DataFrame:
    wanted = files.where(extension(F.col("path")) == "xml")
    return explode_candidates(wanted, tagged(mapper_statements(F.col("content")), "MYBATIS"))
