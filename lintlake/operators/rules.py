"""Static rules as column expressions.

Every rule is a SQL expression over the texts of one statement which yields an array of
(message, suggestion).  All rules stand in one projection, so a statement is read once
and nothing is shuffled; the long form is an explode of the result.

Texts a rule may use:

==============  ==============================================================
``t_sql``       text to analyse (normalised, repaired where needed)
``t_original``  text as found
``t_upper``     upper case, one space
``t_masked``    ``t_upper`` with literals emptied
``t_wheres``    array of the WHERE conditions of ``t_masked``, one a block, without later clauses
``t_where``     these conditions in one text, '' when none
``t_blocks``    array of SELECT blocks
==============  ==============================================================

Rules follow their declared meaning: ``implicit-join`` means a comma join, ``in-subquery``
and ``not-in`` mean what their names say, and rules on whole statements apply to every
statement.  Branches of set operations are checked like the top level.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import fixed_values as fv
from lintlake.functions import text as tx
from lintlake.functions.sqltext import quote, sql_map, with_computed
from lintlake.operators.config import one_per_rule

ISSUE_ARRAY = (
    "array<struct<rule_id:string,rule_name:string,type:string,severity:string,message:string,suggestion:string>>"
)
NULL_TEXT = "cast(null as string)"


def hit(test: str, message: str, suggestion: str = NULL_TEXT) -> str:
    """SQL of one possible finding; null when the test fails."""
    return f"if({test}, named_struct('message', {message}, 'suggestion', {suggestion}), null)"


def hits(*found: str) -> str:
    return "array(" + ", ".join(found) + ")"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    priority: int
    find: str  # SQL giving array<struct<message, suggestion>>; {param:key:default} reads the rule config
    name: str = ""
    description: str = ""
    rule_type: str = "PROBLEM"
    category: str = "BEST_PRACTICE"
    tags: list[str] = field(default_factory=list)
    deprecated: bool = False
    enabled: bool = True
    predicate: Column | None = None  # user rules: computed first, read by ``find``
    message: Column | None = None


# --- parts of a block, b being the block --------------------------------------------------------

_SELECT_LIST = f"regexp_extract(b, {quote('^SELECT (.*?)(?: FROM |$)')}, 1)"
_FROM_PART = f"regexp_extract(b, {quote(' FROM (.*?)(?: WHERE | GROUP BY | HAVING | ORDER BY | LIMIT |$)')}, 1)"
_STAR = quote(r"(^|, ?|DISTINCT |ALL )([A-Z0-9_.`]+\.)?\*( ?,|$)")
_POSITION = quote(r"(^|, ?)\d+( ASC| DESC)?( ?,|$)")

_HAS_STAR = f"contains(b, '*') AND {_SELECT_LIST} RLIKE {_STAR}"
_UNBOUNDED = "NOT contains(b, ' WHERE ') AND NOT contains(b, ' LIMIT ')"
_OPEN_ORDER = (
    "contains(b, ' ORDER BY ') AND NOT contains(b, ' LIMIT ') "
    f"AND NOT regexp_extract(b, ' ORDER BY (.*)$', 1) RLIKE {_POSITION}"
)
_COMMA_JOIN = f"contains(b, ',') AND contains({_FROM_PART}, ',')"
_LATE_FILTER = "contains(b, ' GROUP BY ') AND NOT contains(b, ' WHERE ')"
_DISTINCT = "startswith(b, 'SELECT DISTINCT ')"
_DISTINCT_JOIN = f"{_DISTINCT} AND (contains({_FROM_PART}, ' JOIN ') OR contains({_FROM_PART}, ','))"
_DISTINCT_GROUP = f"{_DISTINCT} AND contains(b, ' GROUP BY ')"


def any_block(test: str) -> str:
    return f"exists(t_blocks, b -> {test})"


IS_SELECT = "size(t_blocks) > 0"

# The conditions in which no term after an OR starts with a column compared by "=" before that OR.
_NAMES = r"regexp_extract_all({}, '\\b(\\w+)\\s*=', 1)"
_LEAD = r"regexp_extract({}, '^\\s*(\\w+)\\s*=', 1)"
_OTHER_COLUMNS = (
    "filter(t_wheres, w -> contains(w, ' OR ') AND NOT aggregate(slice(split(w, ' OR '), 2, size(split(w, ' OR '))), "
    f"named_struct('seen', {_NAMES.format("split(w, ' OR ')[0]")}, 'again', false), "
    f"(s, t) -> named_struct('seen', array_union(s.seen, {_NAMES.format('t')}), "
    f"'again', s.again OR ({_LEAD.format('t')} <> '' AND array_contains(s.seen, {_LEAD.format('t')}))), "
    "s -> s.again))"
)

_FUNCTIONS = quote(r"\b(" + "|".join(fv.NON_SARGABLE_FUNCTIONS) + r")\s*\(")

# Deepest nesting: only the parentheses are walked, and only when there are enough of them.
_DEPTH = (
    r"aggregate(split(regexp_replace(t_sql, '[^()]+', ''), ''), named_struct('d', 0, 'm', 0), "
    r"(s, c) -> named_struct('d', s.d + case c when '(' then 1 when ')' then -1 else 0 end, "
    r"'m', greatest(s.m, s.d + if(c = '(', 1, 0))), s -> s.m)"
)


# --- the built-in rules ------------------------------------------------------------------------------


def _finders() -> dict[str, str]:
    desc = {r[0]: r[2] for r in fv.RULE_CATALOGUE}
    tip = {k: quote(v) for k, v in fv.RULE_SUGGESTION.items()}

    def plain(rid: str, test: str) -> str:
        return hits(hit(test, quote(desc[rid]), tip[rid]))

    def counted(rid: str, test: str, before: str, number: str, after: str) -> str:
        message = f"concat({quote(desc[rid] + before)}, cast({number} as string), {quote(after)})"
        return hits(hit(test, message, tip[rid]))

    rid = "delete-update-no-where"
    no_where = hits(*[
        hit(f"startswith(t_upper, {quote(p)}) AND NOT contains(t_upper, ' WHERE ')",
            quote(f"{verb} 语句缺少 WHERE 条件，将影响所有行！"), tip[rid])
        for verb, p in (("DELETE", "DELETE FROM"), ("UPDATE", "UPDATE "))
    ])
    rid = "null-comparison"
    null_compare = hits(
        hit("contains(t_upper, '= NULL')", quote(desc[rid] + " (= NULL)"), tip[rid]),
        hit("contains(t_upper, '!= NULL') OR contains(t_upper, '<> NULL')",
            quote(desc[rid] + " (!= NULL / <> NULL)"), tip[rid]),
    )
    rid = "dangerous-drop-truncate"
    drop_truncate = hits(*[
        hit(f"contains(t_upper, {quote(op)})", quote(f"检测到危险操作: {op}"), tip[rid])
        for op in ("DROP TABLE", "TRUNCATE TABLE")
    ])
    rid = "function-on-indexed-column"
    functions_in_where = (
        f"if({IS_SELECT} AND contains(t_where, '('), "
        f"transform(array_distinct(regexp_extract_all(t_where, {_FUNCTIONS}, 1)), n -> named_struct("
        f"'message', concat({quote(desc[rid] + ' (函数: ')}, n, ')'), 'suggestion', {tip[rid]})), null)"
    )
    rid = "insert-without-columns"
    rest = r"trim(regexp_replace(t_upper, '^INSERT\\s+INTO\\s+(\\w+)', ''))"
    insert_columns = plain(
        rid,
        f"startswith(t_upper, 'INSERT INTO') AND (startswith({rest}, 'VALUES') OR startswith({rest}, 'SELECT'))",
    )
    rid = "unnecessary-distinct"
    distinct = hits(
        hit(any_block(_DISTINCT_JOIN), quote(f"{desc[rid]} - {fv.DISTINCT_JOIN_REASON}"),
            quote(fv.DISTINCT_JOIN_SUGGESTION)),
        hit(any_block(f"{_DISTINCT_GROUP} AND NOT ({_DISTINCT_JOIN})"),
            quote(f"{desc[rid]} - {fv.DISTINCT_GROUP_REASON}"), quote(fv.DISTINCT_GROUP_SUGGESTION)),
    )
    rid = "long-sql-statement"
    max_chars, max_lines = f"{{param:max_chars:{fv.MAX_SQL_CHARS}}}", f"{{param:max_lines:{fv.MAX_SQL_LINES}}}"
    chars = "length(t_sql)"
    lines = r"size(split(regexp_replace(t_sql, '\\n+$', ''), '\\n'))"
    why = (
        f"if({chars} > {max_chars}, concat('字符数超过 ', cast({max_chars} as string)), "
        f"concat('行数超过 ', cast({max_lines} as string)))"
    )
    long_sql = hits(hit(
        f"{chars} > {max_chars} OR {lines} > {max_lines}",
        f"concat({quote(desc[rid] + ' (')}, {why}, ': ', cast({chars} as string), ' 字符, ', "
        f"cast({lines} as string), ' 行)')",
        tip[rid],
    ))
    numbers = (
        f"regexp_count(regexp_replace(t_sql, {quote(fv.LIMIT_NUMBER)}, ''), {quote(fv.MAGIC_NUMBER)})"
    )
    like = quote(r"(?i)\bLIKE\s+'%[^']+'")
    not_in, in_select = quote(r"\bNOT IN\b"), quote(r"\bIN ?\( ?SELECT ")
    row_in = quote(r"\([^()]*,[^()]*\) IN ?\( ?SELECT")
    return {
        "delete-update-no-where": no_where,
        "null-comparison": null_compare,
        "dangerous-drop-truncate": drop_truncate,
        "select-star": plain("select-star", any_block(_HAS_STAR)),
        "function-on-indexed-column": functions_in_where,
        "like-leading-wildcard": plain("like-leading-wildcard", f"t_sql RLIKE {like}"),
        "missing-where": plain("missing-where", any_block(_UNBOUNDED)),
        "orderby-without-limit": plain("orderby-without-limit", any_block(_OPEN_ORDER)),
        "implicit-join": plain("implicit-join", any_block(_COMMA_JOIN)),
        "multi-column-or": counted(
            "multi-column-or", f"{IS_SELECT} AND contains(t_where, ' OR ') AND size({_OTHER_COLUMNS}) > 0", " (检测到 ",
            f"aggregate({_OTHER_COLUMNS}, 0, (n, w) -> n + size(split(w, ' OR ')) - 1)", " 个 OR 条件)"),
        "insert-without-columns": insert_columns,
        "not-in": plain("not-in", f"t_masked RLIKE {not_in}"),
        "having-without-where": plain(
            "having-without-where", f"contains(t_upper, 'HAVING') AND {any_block(_LATE_FILTER)}"),
        "complex-subquery": counted(
            "complex-subquery",
            f"{IS_SELECT} AND contains(t_sql, '(') AND {_DEPTH} > {{param:max_depth:{fv.MAX_NESTING}}}",
            " (嵌套深度: ", _DEPTH, ")"),
        "in-subquery": plain("in-subquery", f"t_masked RLIKE {in_select}"),
        "unnecessary-distinct": distinct,
        "multi-column-in": plain("multi-column-in", f"t_masked RLIKE {row_in}"),
        "long-sql-statement": long_sql,
        "magic-numbers": counted(
            "magic-numbers", f"{numbers} >= {{param:min_count:{fv.MIN_MAGIC_NUMBERS}}}",
            " (检测到 ", numbers, " 个魔法数字)"),
    }


def builtin_rules() -> list[Rule]:
    finders = _finders()
    return [
        Rule(rid, sev, prio, finders[rid], name, description, rtype, cat, tags)
        for rid, name, description, rtype, sev, cat, prio, tags in fv.RULE_CATALOGUE
    ]


def _check(rule_id: str, severity: str, priority: int, *found: tuple) -> Rule:
    return Rule(rule_id, severity, priority, hits(*[
        hit(f[0], quote(f[1]), quote(f[2]) if len(f) > 2 else NULL_TEXT) for f in found
    ]))


_ANY_LIKE = quote(fv.LIKE_WILDCARD_ANY_QUOTE)


def smell_rules() -> list[Rule]:
    """RUL-20..22: checks on the text as found, before any repair."""
    return [
        _check("SQL_INJECTION", "CRITICAL", -3, (f"contains(t_original, {quote('${')})", fv.MSG_INJECTION)),
        _check("SQL_SYNTAX_ERROR", "CRITICAL", -2,
               (f"t_original RLIKE {quote(fv.DOUBLED_COMMA)}", fv.MSG_DOUBLED_COMMA, fv.FIX_DOUBLED_COMMA),
               (f"upper(t_original) RLIKE {quote(fv.FROM_AND)}", fv.MSG_FROM_AND, fv.FIX_FROM_AND)),
    ]


def fallback_rules() -> list[Rule]:
    """RUL-23: what is still checked when a statement has no valid shape."""
    return [
        _check("SELECT_STAR", "CRITICAL", 1, ("contains(upper(t_original), 'SELECT *')", fv.MSG_BASIC_STAR)),
        _check("LIKE_LEADING_WILDCARD", "CRITICAL", 2, (f"upper(t_original) RLIKE {_ANY_LIKE}", fv.MSG_BASIC_LIKE)),
    ]


def basic_rules() -> list[Rule]:
    """RUL-24: the six plain text checks used without the rule engine."""
    return [
        _check("SELECT_STAR", "WARNING", 1, ("contains(t_upper, 'SELECT *')", fv.MSG_BASIC_STAR)),
        _check("MISSING_WHERE", "CRITICAL", 2, (
            "(startswith(t_upper, 'UPDATE') OR startswith(t_upper, 'DELETE')) AND NOT contains(t_upper, ' WHERE ')",
            fv.MSG_BASIC_WHERE)),
        _check("LIKE_LEADING_WILDCARD", "WARNING", 3, (f"t_upper RLIKE {_ANY_LIKE}", fv.MSG_BASIC_LIKE)),
        _check("ORDER_BY_WITHOUT_LIMIT", "WARNING", 4, (
            "contains(t_upper, 'ORDER BY') AND NOT contains(t_upper, 'LIMIT')", fv.MSG_BASIC_ORDER)),
        _check("IMPLICIT_JOIN", "WARNING", 5, ("contains(t_sql, ',')", fv.MSG_BASIC_JOIN)),
        _check("COMPLEX_SUBQUERY", "INFO", 6, ("length(t_sql) - length(replace(t_sql, '(', '')) > 2",
                                               fv.MSG_BASIC_NEST)),
    ]


class RuleSet:
    """The rules in force.  Registering an id again replaces the earlier rule (UDF-1)."""

    def __init__(self, rules: list[Rule] | None = None):
        self._rules: dict[str, Rule] = {r.rule_id: r for r in (builtin_rules() if rules is None else rules)}

    @classmethod
    def only(cls, *rule_ids: str) -> RuleSet:
        return cls([r for r in builtin_rules() if r.rule_id in rule_ids])

    def register(
        self, rule_id: str, severity: str, predicate: Column | str, message: Column | str,
        suggestion: str | None = None, priority: int = 100, **meta,
    ) -> RuleSet:
        """Add a user rule.

        ``predicate`` is SQL text or a boolean Column over the statement columns (``norm``,
        ``original_sql`` ...) and the texts above; a Column may call a boolean pandas_udf.
        """
        test = F.expr(predicate) if isinstance(predicate, str) else predicate
        text = F.lit(message) if isinstance(message, str) else message
        tip = NULL_TEXT if suggestion is None else quote(suggestion)
        slot = "u_" + re.sub(r"\W", "_", rule_id)
        find = hits(hit(f"{slot}_test", f"{slot}_text", tip))
        self._rules[rule_id] = Rule(rule_id, severity, priority, find, predicate=test, message=text, **meta)
        return self

    def unregister(self, rule_id: str) -> RuleSet:
        self._rules.pop(rule_id, None)
        return self

    def disable(self, rule_id: str) -> RuleSet:
        self._rules[rule_id] = replace(self._rules[rule_id], enabled=False)
        return self

    def __len__(self) -> int:
        return len(self._rules)

    def __contains__(self, rule_id: str) -> bool:
        return rule_id in self._rules

    def active(self) -> list[Rule]:
        """RUL-32: enabled, not deprecated, by priority."""
        live = [r for r in self._rules.values() if r.enabled and not r.deprecated]
        return sorted(live, key=lambda r: (r.priority, r.rule_id))

    def frame(self, spark) -> DataFrame:
        """The rules as a dimension: one row per registered rule."""
        from lintlake.sizing import constant_frame

        rows = [
            (r.rule_id, r.name, r.description, r.rule_type, r.severity, r.category, r.priority, r.tags,
             r.deprecated, r.enabled)
            for r in self._rules.values()
        ]
        names = ["rule_id", "name", "description", "rule_type", "severity", "category", "priority", "tags",
                 "deprecated", "enabled"]
        return constant_frame(spark, rows, names)


# --- rule names -------------------------------------------------------------------------------


def normalize_rule_id(c: Column) -> Column:
    """RUL-30."""
    snake = F.regexp_replace(F.replace(tx.strip(c), F.lit("-"), F.lit("_")), r"([a-z0-9])([A-Z])", "$1_$2")
    name = F.upper(snake)
    return (
        F.when(tx.is_blank(c), "UNKNOWN")
        .when(name == "ORDERBY_WITHOUT_LIMIT", "ORDER_BY_WITHOUT_LIMIT")
        .otherwise(name)
    )


def issue_type(rule_name: Column) -> Column:
    """RUL-31: report type of a normalised rule name; unmapped names stay as they are."""
    table = F.expr(sql_map(fv.ISSUE_TYPE_OF_RULE))
    return F.coalesce(F.element_at(table, F.upper(rule_name)), F.upper(rule_name))


def _names_of(rule_id: str) -> tuple[str, str]:
    """The same two steps for the constant id of a rule."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", rule_id.strip().replace("-", "_")).upper()
    name = "ORDER_BY_WITHOUT_LIMIT" if name == "ORDERBY_WITHOUT_LIMIT" else name
    return name, fv.ISSUE_TYPE_OF_RULE.get(name, name)


# --- evaluation ------------------------------------------------------------------------------------


def _issues_sql(rules: list[Rule], config: bool) -> str:
    """SQL of the issue array of some rules."""
    if not rules:
        return f"cast(array() as {ISSUE_ARRAY})"
    parts = []
    for r in rules:
        name, itype = _names_of(r.rule_id)
        entry = f"t_cfg[{quote(r.rule_id)}]"

        def param(m: re.Match, entry=entry) -> str:
            key, default = m.group(1), m.group(2)
            return f"coalesce(try_cast({entry}.params[{quote(key)}] as int), {default})" if config else default

        find = re.sub(r"\{param:(\w+):(\d+)\}", param, r.find)
        severity = f"coalesce({entry}.severity, {quote(r.severity)})" if config else quote(r.severity)
        parts.append(
            f"coalesce(transform(filter({find}, h -> h is not null), h -> named_struct("
            f"'rule_id', {quote(r.rule_id)}, 'rule_name', {quote(name)}, 'type', {quote(itype)}, "
            f"'severity', {severity}, 'message', h.message, 'suggestion', h.suggestion)), "
            f"cast(array() as {ISSUE_ARRAY}))"
        )
    return f"cast(concat({', '.join(parts)}) as {ISSUE_ARRAY})"


def lint(
    stmts: DataFrame,
    rules: RuleSet | None = None,
    profile: str = "scan",
    config: DataFrame | None = None,
    sql_col: str = "norm",
) -> DataFrame:
    """RUL-28/29: add ``issues``, the findings of each statement, in the statement's own row.

    Profiles: ``scan`` runs the text smells, then the rules on statements of valid shape and
    the fallback checks on the others; ``full`` runs smells and rules on every statement;
    ``rules``, ``smells``, ``basic`` and ``fallback`` run only those checks.
    The list is bounded by the number of rules.  With a ``config`` frame, thresholds,
    severities, switched-off rules and exceptions are taken from it (a map of rules, one value for all rows;
    of several rows for a rule see ``config.one_per_rule``).
    """
    active = (rules or RuleSet()).active()
    base = list(stmts.columns)
    work = stmts
    if config is not None:
        entry = F.struct("enabled", "severity", "exceptions", "params")
        one_row = one_per_rule(config).agg(F.map_from_entries(F.collect_list(F.struct("rule_id", entry))).alias("t_cfg"))
        work = work.withColumn("t_cfg", one_row.scalar())
    cfg = ["t_cfg"] if config is not None else []
    sql = F.col(sql_col)
    mask = F.col("masked") if "masked" in base and sql_col == "norm" else tx.masked(sql)
    work = work.select(
        *base, *cfg,
        sql.alias("t_sql"),
        (F.col("original_sql") if "original_sql" in base else sql).alias("t_original"),
        F.upper(tx.normalize(sql)).alias("t_upper"),
        mask.alias("t_masked"),
    )
    texts = ["t_sql", "t_original", "t_upper", "t_masked"]
    work = work.select(
        *base, *cfg, *texts,
        tx.where_conditions(F.col("t_masked")).alias("t_wheres"),
        tx.select_blocks(F.col("t_masked")).alias("t_blocks"),
    )
    work = work.withColumn("t_where", F.array_join("t_wheres", " ; "))
    user = {}
    for r in active:
        if r.predicate is not None:
            slot = "u_" + re.sub(r"\W", "_", r.rule_id)
            user[f"{slot}_test"], user[f"{slot}_text"] = F.coalesce(r.predicate, F.lit(False)), r.message
    if user:
        work = work.withColumns(user)
    on = config is not None
    if profile == "scan":
        issues = (
            f"concat({_issues_sql(smell_rules(), on)}, "
            f"if(parsed, {_issues_sql(active, on)}, {_issues_sql(fallback_rules(), on)}))"
        )
    elif profile == "full":
        issues = _issues_sql([*smell_rules(), *active], on)
    elif profile == "rules":
        issues = _issues_sql(active, on)
    elif profile == "smells":
        issues = _issues_sql(smell_rules(), on)
    elif profile == "basic":
        issues = _issues_sql(basic_rules(), on)
    elif profile == "fallback":
        issues = f"if(validity = 'INVALID', {_issues_sql(fallback_rules(), on)}, {_issues_sql([], on)})"
    else:
        raise ValueError(f"unknown profile: {profile}")
    issues = f"array_distinct({issues})"
    if on:
        issues = (
            f"filter({issues}, i -> coalesce(t_cfg[i.rule_id].enabled, true) AND NOT "
            "exists(coalesce(t_cfg[i.rule_id].exceptions, cast(array() as array<string>)), "
            "e -> e <> '' AND contains(t_sql, e)))"
        )
    return with_computed(work, issues=F.expr(issues)).select(*base, "issues")


def explode_issues(linted: DataFrame) -> DataFrame:
    """The long form: one row per issue, numbered in the order found."""
    file_name = F.col("first_file") if "first_file" in linted.columns else F.lit(None).cast("string")
    rows = linted.select("stmt_id", file_name.alias("evidence"), F.posexplode_outer("issues").alias("_no", "i"))
    return rows.where(F.col("i").isNotNull()).select(
        "stmt_id",
        F.lit("STATIC").alias("source"),
        (F.col("_no") + 1).alias("issue_no"),
        "i.rule_id", "i.rule_name", "i.type", "i.severity", "i.message", "i.suggestion",
        "evidence",
    )


def evaluate(
    stmts: DataFrame,
    rules: RuleSet | None = None,
    profile: str = "full",
    config: DataFrame | None = None,
    sql_col: str = "norm",
) -> DataFrame:
    """RUL-28: issues of a batch of statements in long form."""
    return explode_issues(lint(stmts, rules, profile, config, sql_col))
