"""SQL twins: the statement corpus, fingerprints, preprocess record, rule findings, scores.

The SQL here is written for DuckDB over the given tables.  ``with_(...)`` puts the named
parts in front of a final SELECT.
"""

from __future__ import annotations

from lintlake import fixed_values as fv
from lintlake.suite.corpus import SOURCE_OF_EVENT, TEMPLATES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(items) -> str:
    return ", ".join(q(i) for i in items)


def case_of(expr: str, table: dict, other: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {other} END"


def filled(sql: str) -> str:
    return f"replace(replace({sql}, '{{e}}', event_id::VARCHAR), '{{u}}', user_id::VARCHAR)"


PARTS: dict[str, str] = {}
ORDER: list[str] = []
NEEDS: dict[str, list[str]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = sql
    NEEDS[name] = list(needs)
    ORDER.append(name)


def with_(final: str, *names: str) -> str:
    """WITH the named parts and what they need, then the final SELECT."""
    wanted: set[str] = set()

    def add(n: str) -> None:
        if n not in wanted:
            for d in NEEDS[n]:
                add(d)
            wanted.add(n)

    for n in names:
        add(n)
    body = ",\n".join(f"{n} AS ({PARTS[n]})" for n in ORDER if n in wanted)
    return f"WITH {body}\n{final}"


# --- corpus -----------------------------------------------------------------------------------

_TEMPLATE = "CASE event_id % 32 " + " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(TEMPLATES)) + " END"
_SOURCE = "CASE event_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in SOURCE_OF_EVENT.items()) + " END"

part("raw_occ", f"""
SELECT event_id AS occ_id,
       'svc' || (user_id % 5) || (CASE source_type WHEN 'MYBATIS' THEN '/src/main/resources/'
            WHEN 'SQL_FILE' THEN '/db/' ELSE '/src/main/java/' END) || file_name AS path,
       file_name, CAST(1 + event_id % 200 AS INTEGER) AS line, source_type, sql
FROM (SELECT event_id, user_id, {_SOURCE} AS source_type,
        CASE {_SOURCE} WHEN 'MYBATIS' THEN 'M' || user_id || '.xml' WHEN 'SQL_FILE' THEN 'S' || user_id || '.sql'
             ELSE 'F' || user_id || '.java' END AS file_name,
        {filled(_TEMPLATE)} AS sql FROM events)""")

KEYWORD_SHAPE = r"""(
     regexp_matches(u, '^SELECT .')
  OR (regexp_matches(u, '^(INSERT|REPLACE) ') AND contains(u, ' INTO '))
  OR (starts_with(u, 'UPDATE ') AND contains(u, ' SET '))
  OR (starts_with(u, 'DELETE ') AND contains(u, ' FROM '))
  OR regexp_matches(u, '^CREATE (TEMPORARY )?(TABLE|INDEX|UNIQUE INDEX|VIEW|DATABASE|SCHEMA)\b')
  OR regexp_matches(u, '^ALTER (TABLE|INDEX|DATABASE|SCHEMA)\b')
  OR regexp_matches(u, '^DROP (TABLE|INDEX|VIEW|DATABASE|SCHEMA)\b')
  OR regexp_matches(u, '^TRUNCATE \S')
  OR regexp_matches(u, '^(WITH|CALL|SHOW|DESC|DESCRIBE) .'))"""
CACHE_KEY = """((contains(t, ':') AND NOT contains(t, ' '))
  OR (length(t) - length(replace(t, ':', '')) > 2
      AND length(t) - length(replace(t, ':', '')) > length(t) - length(replace(t, ' ', ''))))"""

part("judged_occ", rf"""
SELECT *, {CACHE_KEY} AS cache_key, length(sql) >= 10 AND NOT {CACHE_KEY} AND {KEYWORD_SHAPE} AS is_sql
FROM (SELECT *, trim(sql) AS t, upper(trim(regexp_replace(sql, '\s+', ' ', 'g'))) AS u FROM raw_occ)""", "raw_occ")
part("occ", "SELECT occ_id, path, file_name, line, source_type, sql FROM judged_occ WHERE is_sql", "judged_occ")


SINGLE_QUOTED = r"'''([^''\\]|\\.)*'''"
DOUBLE_QUOTED = "'" + r'"([^"\\]|\\.)*"' + "'"


def abstract(c: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, {SINGLE_QUOTED}, '?', 'g'), "
        rf"{DOUBLE_QUOTED}, '?', 'g'), '\b\d+(\.\d+)?\b', '?', 'g'), '\s+', ' ', 'g'))"
    )


def one_space(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def masked(c: str) -> str:
    return (
        f"regexp_replace(regexp_replace(upper({one_space(c)}), {SINGLE_QUOTED}, '''''', 'g'), "
        f"{DOUBLE_QUOTED}, '" + '""' + "', 'g')"
    )


part("fp", f"SELECT *, {abstract('sql')} AS abstract_sql, sha256(upper({abstract('sql')})) AS stmt_key FROM occ", "occ")


def sql_type_case(c: str) -> str:
    u = f"upper(trim({c}))"
    return "CASE " + " ".join(f"WHEN starts_with({u}, '{t}') THEN '{t}'" for t in fv.SQL_TYPES) + " ELSE 'OTHER' END"


part("stmt", f"""
SELECT 'sql-' || sha256(abstract_sql) AS stmt_id, stmt_key, {sql_type_case('sql')} AS sql_type,
       sql AS original_sql, abstract_sql, source_type, path AS first_path, file_name AS first_file,
       line AS first_line, occ_id AS first_occ_id, location_count
FROM (SELECT *, count(*) OVER (PARTITION BY stmt_key) AS location_count,
        row_number() OVER (PARTITION BY stmt_key ORDER BY path, line, source_type, sql, occ_id) AS rn FROM fp)
WHERE rn = 1""", "fp")


def category_case(c: str, src: str) -> str:
    return rf"""CASE WHEN {src} = 'MYBATIS' THEN
       CASE WHEN regexp_matches({c}, '(?i)<(if|choose|when|otherwise|foreach|trim|where|set)\b')
            THEN 'MYBATIS_XML_DYNAMIC' ELSE 'MYBATIS_XML_STATIC' END
     WHEN {src} = 'MYBATIS_ANNOTATION' THEN 'MYBATIS_ANNOTATION'
     WHEN {src} = 'JPA_ANNOTATION' THEN 'JPA_NATIVE_QUERY'
     WHEN contains({c}, '#{{') OR contains({c}, '${{') THEN 'PLACEHOLDER_TEMPLATE'
     WHEN {src} = 'STRING_LITERAL' THEN 'STRING_CONCAT' ELSE 'UNKNOWN' END"""


def chain(c: str, steps: list[tuple[str, str]]) -> str:
    for pattern, rep in steps:
        c = f"regexp_replace({c}, {q(pattern)}, {q(rep)}, 'g')"
    return c


TEMPLATE_STEPS = [
    (r"/\*\s*INCLUDE:[^*]+\*/", "*"),
    (r"/\*\s*BIND:[^*]+\*/", ""),
    (r"(?i)</?(if|choose|when|otherwise|foreach|trim|where|set)\b[^>]*>", " "),
    (r"(?i)\bin\s*\(\s*#\{[^}]+\}\s*\)", "IN (1)"),
    (r"(?i)\bin\s*#\{[^}]+\}", "IN (1)"),
    (r"#\{[^}]+\}", "1"),
    (r"\s*,\s*,+\s*", ", "),
    (r"(?i)\bfrom\s+([`\w.]+)\s+and\s+", r"FROM \1 WHERE "),
    (r"(?i)\bcase\s*\?\s*end\b", "1"),
    (r"(?i)\bvalues\s*\?(\s|$)", r"VALUES (1)\1"),
    (r"(?i)\bset\s*\?(\s*where\b|\s*$)", r"SET template_value = 1\1"),
    (r"(?i)\bwhere\s*\?(\s|$)", r"WHERE 1 = 1\1"),
    (r"(?i)\band\s*\?(\s|$)", r"AND 1 = 1\1"),
    (r"(?i)\bor\s*\?(\s|$)", r"OR 1 = 1\1"),
]


def fix_template(c: str) -> str:
    return one_space(chain(c, TEMPLATE_STEPS))


def fix_concat(c: str) -> str:
    glued = chain(c, [(r'"\s*\+\s*"', ""), (r"'\s*\+\s*'", "")])
    return one_space("replace(" + glued + r""", '\"', '"')""")


def fixed(c: str, category: str) -> str:
    return f"""CASE WHEN {category} = 'PLACEHOLDER_TEMPLATE' THEN {fix_concat(fix_template(c))}
      WHEN {category} IN ('MYBATIS_XML_DYNAMIC', 'MYBATIS_XML_STATIC', 'MYBATIS_ANNOTATION') THEN {fix_template(c)}
      WHEN {category} = 'STRING_CONCAT' THEN {fix_concat(c)} ELSE {c} END"""


def shape(m: str) -> str:
    lead = (r"^\(?\s*(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|TRUNCATE|REPLACE|WITH|CALL|SHOW|DESC|DESCRIBE"
            r"|EXPLAIN|MERGE|SET|USE)\b")
    broken = "|".join([
        r"#\{|\$\{", r",\s*,", r"\(\s*,|,\s*\)",
        r"\bFROM\s*(WHERE\b|AND\b|OR\b|GROUP\b|ORDER\b|LIMIT\b|$)",
        r"\bWHERE\s*(AND\b|OR\b|GROUP\b|ORDER\b|LIMIT\b|$)",
        r"\b(AND|OR|SET|BY|VALUES|ON)\s*$",
        r"\b(WHERE|VALUES|SET|CASE)\s*\?(\s|$)",
        r"\bFROM\s+[`\w.]+\s+AND\b",
    ])
    return f"""(regexp_matches({m}, {q(lead)})
       AND length(replace({m}, '(', '')) = length(replace({m}, ')', ''))
       AND NOT contains(replace({m}, '''''', ''), '''') AND NOT regexp_matches({m}, {q(broken)}))"""


part("pre1", f"""SELECT *, {category_case('original_sql', 'source_type')} AS category,
  {one_space('original_sql')} AS plain, {masked('original_sql')} AS plain_mask,
  contains(original_sql, '${{') AS dollar FROM stmt""", "stmt")
part("pre2", f"SELECT *, {shape('plain_mask')} AS plain_ok FROM pre1", "pre1")
part("pre3", f"SELECT *, CASE WHEN plain_ok THEN plain ELSE {fixed('plain', 'category')} END AS norm FROM pre2", "pre2")
part("pre4", f"SELECT *, {masked('norm')} AS masked FROM pre3", "pre3")
part("pre5", f"SELECT *, {shape('masked')} AS parsed FROM pre4", "pre4")

_MUT = r"^(INSERT|UPDATE|DELETE|REPLACE|MERGE)"


def guard(c: str) -> dict[str, str]:
    target = rf"trim(regexp_replace(trim({c}), '(?is)^\s*EXPLAIN\s+(\([^)]*\)\s*)?', ''))"
    mutating = (f"(regexp_matches(upper({target}), '{_MUT}') OR "
                rf"regexp_matches({target}, '(?is)^\s*WITH\b.*\)\s*(INSERT|UPDATE|DELETE|REPLACE|MERGE)\b'))")
    readable = f"regexp_matches(upper(trim({c})), '^(SELECT|WITH|EXPLAIN)')"
    marked = chain(c, TEMPLATE_STEPS[:2])
    bound = chain(marked, TEMPLATE_STEPS[3:6])
    dollar = rf"regexp_matches({marked}, '\$\{{[^}}]+\}}')"
    reason = (f"CASE WHEN {mutating} THEN {q(fv.REASON_MUTATING)} WHEN NOT {readable} THEN {q(fv.REASON_NOT_READONLY)} "
              f"WHEN {dollar} THEN {q(fv.REASON_EXPLAIN_DOLLAR)} END")
    return {
        "reason": reason,
        "eligibility": f"CASE WHEN ({reason}) IS NULL THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END",
        "explain_sql": f"CASE WHEN ({reason}) IS NULL THEN {bound} END",
        "changed": f"CASE WHEN {mutating} OR NOT {readable} THEN false WHEN {dollar} THEN {marked} <> {c} "
                   f"ELSE {bound} <> {c} END",
    }


_G = guard("norm")
part("pre", f"""
SELECT * EXCLUDE (g_reason, plain, plain_mask, plain_ok),
  CASE WHEN dollar AND g_reason IS NOT NULL THEN g_reason || {q(fv.REASON_DOLLAR_SUFFIX)}
       WHEN NOT parsed AND dollar THEN {q(fv.REASON_DOLLAR)}
       WHEN NOT parsed THEN {q(fv.REASON_UNPARSED)} ELSE g_reason END AS reason
FROM (SELECT *, CASE WHEN dollar THEN 'UNKNOWN' WHEN parsed THEN 'VALID' ELSE 'INVALID' END AS validity,
   {_G['eligibility']} AS eligibility, {_G['explain_sql']} AS explain_sql, {_G['reason']} AS g_reason FROM pre5)""",
     "pre5")

# --- texts of the rules -----------------------------------------------------------------------------

_INNER = r"\([^()]*\)"
_SEL = r"(?:\bFROM|\bJOIN|^|\bUNION|\bUNION ALL|\bINTERSECT|\bEXCEPT|\bMINUS) ?\( ?(SELECT [^()]*)\)"
WITH_HEAD = r'^WITH (?:RECURSIVE )?(?:[\w`"]+ ?(?:~ ?)?AS ?~ ?,? ?)+'



def rule_texts(name: str, source: str) -> None:
    """Parts ``name``: the texts of the rules for the rows of ``source`` (norm, masked, ...)."""
    part(f"{name}_0", f"SELECT *, upper(norm) AS up, regexp_extract(masked, ' WHERE (.*)$', 1) AS wh, masked AS t0 "
         f"FROM {source}", source)
    for i in range(1, 7):
        part(f"{name}_{i}", f"""SELECT *, regexp_replace(t{i - 1}, {q(_INNER)}, '~', 'g') AS t{i},
          regexp_extract_all(t{i - 1}, {q(_SEL)}, 1) AS f{i} FROM {name}_{i - 1}""", f"{name}_{i - 1}")
    part(name, f"""
SELECT * EXCLUDE (t0, t1, t2, t3, t4, t5, f1, f2, f3, f4, f5, f6), regexp_replace(t6, {q(WITH_HEAD)}, '') AS skeleton,
  list_filter(list_transform(flatten(list_transform(
     list_concat([regexp_replace(t6, {q(WITH_HEAD)}, '')], f1, f2, f3, f4, f5, f6),
     lambda x: string_split_regex(x, ' (?:UNION ALL|UNION DISTINCT|UNION|INTERSECT|EXCEPT|MINUS) '))),
     lambda x: trim(x)), lambda x: starts_with(x, 'SELECT ')) AS blocks FROM {name}_6""", f"{name}_6")


rule_texts("txt", "pre")
part("log", f"""SELECT occ_id AS stmt_id, file_name AS first_file, sql AS original_sql, {one_space('sql')} AS norm,
  {masked('sql')} AS masked FROM occ""", "occ")
rule_texts("logtxt", "log")

# --- findings ------------------------------------------------------------------------------------------


def any_block(test: str) -> str:
    return f"len(list_filter(blocks, lambda b: {test})) > 0"


_FROM = "regexp_extract(b, ' FROM (.*?)(?: WHERE | GROUP BY | HAVING | ORDER BY | LIMIT |$)', 1)"
_STAR = r"regexp_matches(regexp_extract(b, '^SELECT (.*?)(?: FROM |$)', 1), '(^|, ?|DISTINCT |ALL )([A-Z0-9_.`]+\.)?\*( ?,|$)')"
_DJOIN = f"starts_with(b, 'SELECT DISTINCT ') AND (contains({_FROM}, ' JOIN ') OR contains({_FROM}, ','))"
DESC = {r[0]: r[2] for r in fv.RULE_CATALOGUE}
SEV = {r[0]: r[4] for r in fv.RULE_CATALOGUE}
PRIO = {r[0]: r[6] for r in fv.RULE_CATALOGUE}
TIP = fv.RULE_SUGGESTION
_SEGS = "string_split(wh, ' OR ')"
_DEPTH = (r"list_max(list_transform(range(1, length(regexp_replace(norm, '[^()]', '', 'g')) + 1), lambda i: "
          r"2 * length(replace(left(regexp_replace(norm, '[^()]', '', 'g'), i), ')', '')) - i))")
_MAGIC = (r"len(regexp_extract_all(regexp_replace(norm, '(?i)(LIMIT|OFFSET|TOP)\s+\d+', '', 'g'), "
          r"'[=<>!]\s*\b\d{2,}\b'))")
_SAME = rf"""len(list_filter(range(2, len({_SEGS}) + 1), lambda k: regexp_extract({_SEGS}[k], '^\s*(\w+)\s*=', 1) <> ''
   AND list_contains(flatten(list_transform({_SEGS}[1:k-1], lambda s: regexp_extract_all(s, '\b(\w+)\s*=', 1))),
                     regexp_extract({_SEGS}[k], '^\s*(\w+)\s*=', 1)))) > 0"""
_REST = r"trim(regexp_replace(up, '^INSERT\s+INTO\s+(\w+)', ''))"
_LINES = r"len(string_split(regexp_replace(norm, '\n+$', ''), chr(10)))"

# rule -> list of (test, message, suggestion)
FINDINGS: dict[str, list[tuple[str, str, str]]] = {}
for _rid, _test in {
    "select-star": any_block(_STAR),
    "missing-where": any_block("NOT contains(b, ' WHERE ') AND NOT contains(b, ' LIMIT ')"),
    "like-leading-wildcard": r"regexp_matches(norm, '(?i)\bLIKE\s+''%[^'']+''')",
    "orderby-without-limit": any_block(
        r"contains(b, ' ORDER BY ') AND NOT contains(b, ' LIMIT ') AND NOT regexp_matches("
        r"regexp_extract(b, ' ORDER BY (.*)$', 1), '(^|, ?)\d+( ASC| DESC)?( ?,|$)')"),
    "having-without-where": "contains(up, 'HAVING') AND "
                            + any_block("contains(b, ' GROUP BY ') AND NOT contains(b, ' WHERE ')"),
    "implicit-join": any_block(f"contains({_FROM}, ',')"),
    "multi-column-in": r"regexp_matches(masked, '\([^()]*,[^()]*\) IN ?\( ?SELECT')",
    "in-subquery": r"regexp_matches(masked, '\bIN ?\( ?SELECT ')",
    "not-in": r"regexp_matches(masked, '\bNOT IN\b')",
    "insert-without-columns": f"starts_with(up, 'INSERT INTO') AND regexp_matches({_REST}, '^(VALUES|SELECT)')",
}.items():
    FINDINGS[_rid] = [(_test, q(DESC[_rid]), q(TIP[_rid]))]
FINDINGS["multi-column-or"] = [(
    f"len(blocks) > 0 AND contains(wh, ' OR ') AND NOT ({_SAME})",
    f"{q(DESC['multi-column-or'] + ' (检测到 ')} || (len({_SEGS}) - 1) || ' 个 OR 条件)'", q(TIP["multi-column-or"]))]
FINDINGS["null-comparison"] = [
    ("contains(up, '= NULL')", q(DESC["null-comparison"] + " (= NULL)"), q(TIP["null-comparison"])),
    ("contains(up, '!= NULL') OR contains(up, '<> NULL')", q(DESC["null-comparison"] + " (!= NULL / <> NULL)"),
     q(TIP["null-comparison"]))]
FINDINGS["delete-update-no-where"] = [
    (f"starts_with(up, '{p}') AND NOT contains(up, ' WHERE ')", q(f"{v} 语句缺少 WHERE 条件，将影响所有行！"),
     q(TIP["delete-update-no-where"])) for v, p in (("DELETE", "DELETE FROM"), ("UPDATE", "UPDATE "))]
FINDINGS["dangerous-drop-truncate"] = [
    (f"contains(up, '{op}')", q(f"检测到危险操作: {op}"), q(TIP["dangerous-drop-truncate"]))
    for op in ("DROP TABLE", "TRUNCATE TABLE")]
FINDINGS["unnecessary-distinct"] = [
    (any_block(_DJOIN), q(f"{DESC['unnecessary-distinct']} - {fv.DISTINCT_JOIN_REASON}"),
     q(fv.DISTINCT_JOIN_SUGGESTION)),
    (any_block(f"starts_with(b, 'SELECT DISTINCT ') AND contains(b, ' GROUP BY ') AND NOT ({_DJOIN})"),
     q(f"{DESC['unnecessary-distinct']} - {fv.DISTINCT_GROUP_REASON}"), q(fv.DISTINCT_GROUP_SUGGESTION))]
FINDINGS["complex-subquery"] = [(
    f"len(blocks) > 0 AND coalesce({_DEPTH}, 0) > 3",
    f"{q(DESC['complex-subquery'] + ' (嵌套深度: ')} || ({_DEPTH}) || ')'", q(TIP["complex-subquery"]))]
FINDINGS["long-sql-statement"] = [(
    f"length(norm) > 500 OR {_LINES} > 20",
    f"{q(DESC['long-sql-statement'] + ' (')} || CASE WHEN length(norm) > 500 THEN '字符数超过 500' ELSE '行数超过 20' END "
    f"|| ': ' || length(norm) || ' 字符, ' || {_LINES} || ' 行)'", q(TIP["long-sql-statement"]))]
FINDINGS["magic-numbers"] = [(
    f"{_MAGIC} >= 2", f"{q(DESC['magic-numbers'] + ' (检测到 ')} || {_MAGIC} || ' 个魔法数字)'", q(TIP["magic-numbers"]))]

SMELLS = {
    "SQL_INJECTION": [("contains(original_sql, '${')", q(fv.MSG_INJECTION), "NULL")],
    "SQL_SYNTAX_ERROR": [
        (r"regexp_matches(original_sql, '\w\s*,\s*,+\s*\w')", q(fv.MSG_DOUBLED_COMMA), q(fv.FIX_DOUBLED_COMMA)),
        (r"regexp_matches(upper(original_sql), '\bFROM\s+[`\w.]+\s+AND\b')", q(fv.MSG_FROM_AND), q(fv.FIX_FROM_AND))],
}
ANY_LIKE = r"""'LIKE\s+[''"]%'"""
FALLBACK = {
    "SELECT_STAR": [("contains(upper(original_sql), 'SELECT *')", q(fv.MSG_BASIC_STAR), "NULL")],
    "LIKE_LEADING_WILDCARD": [
        (f"regexp_matches(upper(original_sql), {ANY_LIKE})", q(fv.MSG_BASIC_LIKE), "NULL")],
}
_UPN = "upper(norm)"
BASIC = [
    ("SELECT_STAR", "WARNING", f"contains({_UPN}, 'SELECT *')", fv.MSG_BASIC_STAR),
    ("MISSING_WHERE", "CRITICAL", f"regexp_matches({_UPN}, '^(UPDATE|DELETE)') AND NOT contains({_UPN}, ' WHERE ')",
     fv.MSG_BASIC_WHERE),
    ("LIKE_LEADING_WILDCARD", "WARNING", f"regexp_matches({_UPN}, {ANY_LIKE})",
     fv.MSG_BASIC_LIKE),
    ("ORDER_BY_WITHOUT_LIMIT", "WARNING", f"contains({_UPN}, 'ORDER BY') AND NOT contains({_UPN}, 'LIMIT')",
     fv.MSG_BASIC_ORDER),
    ("IMPLICIT_JOIN", "WARNING", "contains(norm, ',')", fv.MSG_BASIC_JOIN),
    ("COMPLEX_SUBQUERY", "INFO", "length(norm) - length(replace(norm, '(', '')) > 2", fv.MSG_BASIC_NEST),
]


def rule_name(rid: str) -> str:
    n = rid.replace("-", "_").upper()
    return "ORDER_BY_WITHOUT_LIMIT" if n == "ORDERBY_WITHOUT_LIMIT" else n


def issue_type(name: str) -> str:
    return fv.ISSUE_TYPE_OF_RULE.get(name, name)


def _rows(rid, sev, prio, k, test, msg, tip, src="txt") -> str:
    name = rule_name(rid)
    return (f"SELECT stmt_id, first_file AS evidence, {q(rid)} AS rule_id, '{name}' AS rule_name, "
            f"'{issue_type(name)}' AS type, '{sev}' AS severity, {msg} AS message, "
            f"CAST({tip} AS VARCHAR) AS suggestion, {prio} AS prio, {k} AS ord FROM {src} WHERE {test}")


def rule_rows(rid: str, guard_: str = "true", src: str = "txt") -> str:
    """UNION ALL of the findings of one rule."""
    if rid == "function-on-indexed-column":
        fns = "|".join(fv.NON_SARGABLE_FUNCTIONS)
        names = rf"regexp_extract_all(wh, '\b({fns})\s*\(', 1)"
        msg = f"{q(DESC[rid] + ' (函数: ')} || n || ')'"
        return (f"SELECT stmt_id, first_file AS evidence, {q(rid)} AS rule_id, '{rule_name(rid)}' AS rule_name, "
                f"'{rule_name(rid)}' AS type, '{SEV[rid]}' AS severity, {msg} AS message, {q(TIP[rid])} AS suggestion, "
                f"{PRIO[rid]} AS prio, list_position(all_names, n) AS ord FROM (SELECT stmt_id, first_file, "
                f"{names} AS all_names, unnest(list_distinct({names})) AS n FROM {src} "
                f"WHERE len(blocks) > 0 AND {guard_})")
    return " UNION ALL ".join(
        _rows(rid, SEV[rid], PRIO[rid], k, f"({t}) AND {guard_}", m, s, src)
        for k, (t, m, s) in enumerate(FINDINGS[rid]))


_ALL = [r[0] for r in fv.RULE_CATALOGUE]
_SMELL_ROWS = [
    _rows(rid, "CRITICAL", p, k, t, m, s)
    for p, rid in ((-3, "SQL_INJECTION"), (-2, "SQL_SYNTAX_ERROR")) for k, (t, m, s) in enumerate(SMELLS[rid])]
_FALL_ROWS = [
    _rows(rid, "CRITICAL", p, 0, f"({FALLBACK[rid][0][0]}) AND NOT parsed", FALLBACK[rid][0][1], "NULL")
    for p, rid in ((1, "SELECT_STAR"), (2, "LIKE_LEADING_WILDCARD"))]
_NUMBERED = "SELECT *, CAST(row_number() OVER (PARTITION BY stmt_id ORDER BY prio, ord) AS INTEGER) AS issue_no FROM"
part("full_issue", f"{_NUMBERED} ({' UNION ALL '.join([*_SMELL_ROWS, *[rule_rows(r) for r in _ALL]])})", "txt")
part("issue", f"{_NUMBERED} ({' UNION ALL '.join([*_SMELL_ROWS, *[rule_rows(r, 'parsed') for r in _ALL], *_FALL_ROWS])})",
     "txt")
part("per_stmt", """SELECT stmt_id, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS c,
  count(*) FILTER (severity = 'WARNING') AS w, count(*) FILTER (severity = 'INFO') AS i FROM issue GROUP BY 1""",
     "issue")
LABEL = lambda c: case_of(c, fv.LABELS, (
    f"array_to_string(list_transform(list_filter(string_split(lower({c}), '_'), lambda w: w <> ''), "
    f"lambda w: upper(w[1]) || w[2:]), ' ')"))
part("rule_text", f"""SELECT stmt_id, string_agg(lbl || CASE WHEN n > 1 THEN 'x' || n ELSE '' END, ', ' ORDER BY first_no)
  AS rules FROM (SELECT stmt_id, {LABEL('rule_name')} AS lbl, rule_name, count(*) AS n, min(issue_no) AS first_no
  FROM issue GROUP BY ALL) GROUP BY 1""", "issue")
part("scored", """
SELECT p.*, coalesce(n, 0) AS issue_count, coalesce(c, 0) AS critical_count, coalesce(w, 0) AS warning_count,
  coalesce(i, 0) AS info_count,
  CASE WHEN coalesce(c, 0) > 0 THEN 'CRITICAL' WHEN coalesce(w, 0) > 0 THEN 'WARNING' ELSE 'INFO' END AS severity,
  greatest(0, 100 - 30 * coalesce(c, 0) - 15 * coalesce(w, 0) - 5 * coalesce(i, 0)) AS score, rules
FROM pre p LEFT JOIN per_stmt USING (stmt_id) LEFT JOIN rule_text USING (stmt_id)""", "pre", "per_stmt", "rule_text")
