"""Fixed values.

Word lists, lookup tables, thresholds, constants, message texts and text
patterns whose exact value decides the result.  They are plain data in their
natural order; the logic which uses them lives in the other modules.
"""

from __future__ import annotations

# --- Fixed values: source files ------------------------------------------------
SCAN_EXTENSIONS = ["java", "xml", "sql", "js", "ts"]
IGNORED_DIRS = [
    "target", "build", "out", "dist", "coverage",
    ".git", ".idea", ".mvn", ".gradle", "node_modules",
]
MAX_FILE_MB = 10

# --- Fixed values: enumerations ------------------------------------------------
SEVERITIES = ["CRITICAL", "WARNING", "INFO"]
SEVERITY_RANK = {"CRITICAL": 3, "WARNING": 2, "INFO": 1}
SQL_TYPES = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP"]

# --- Fixed values: score policy ------------------------------------------------
BASE_SCORE = 100
DEDUCTION = {"CRITICAL": 30, "WARNING": 15, "INFO": 5}

# --- Fixed values: what counts as SQL text ---------------------------------------
MIN_SQL_LENGTH = 10
FRAGMENT_KEYWORDS = [
    "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER",
    "DROP", "TRUNCATE", "REPLACE", "WITH", "CALL", "SHOW",
]
MAPPER_KEYWORDS = [
    "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER",
    "DROP", "TRUNCATE", "REPLACE", "WITH", "CALL",
]
ALWAYS_SQL_KEYWORDS = ["WITH", "CALL", "SHOW", "DESC", "DESCRIBE"]
LITERAL_KEYWORDS = [
    "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "TRUNCATE", "REPLACE",
]
CREATE_OBJECTS = ["TABLE", "INDEX", r"UNIQUE\s+INDEX", "VIEW", "DATABASE", "SCHEMA"]
ALTER_OBJECTS = ["TABLE", "INDEX", "DATABASE", "SCHEMA"]
DROP_OBJECTS = ["TABLE", "INDEX", "VIEW", "DATABASE", "SCHEMA"]

# --- Fixed values: mapper tags ---------------------------------------------------
DYNAMIC_TAGS = ["if", "choose", "when", "otherwise", "foreach", "trim", "where", "set"]
STATEMENT_TAGS = ["select", "insert", "update", "delete", "selectKey"]

# --- Fixed values: template repair patterns ----------------------------------------
INCLUDE_MARK = r"/\*\s*INCLUDE:[^*]+\*/"
BIND_MARK = r"/\*\s*BIND:[^*]+\*/"
TEMPLATE_TAG = r"(?i)</?(if|choose|when|otherwise|foreach|trim|where|set)\b[^>]*>"
IN_HASH_PAREN = r"(?i)\bin\s*\(\s*#\{[^}]+}\s*\)"
IN_HASH = r"(?i)\bin\s*#\{[^}]+}"
HASH_PARAM = r"#\{[^}]+}"
DOLLAR_PARAM = r"\$\{[^}]+}"

# --- Fixed values: preprocess and EXPLAIN reasons ----------------------------------
REASON_EMPTY = "SQL 为空"
REASON_UNPARSED = "SQL 无法解析"
REASON_DOLLAR = "包含 ${} 文本占位符，无法安全静态归一化；请改用 #{} 参数绑定或白名单映射"
REASON_DOLLAR_SUFFIX = "；请改用 #{} 参数绑定或白名单映射"
REASON_MUTATING = "EXPLAIN 仅允许只读查询语句，已跳过变更语句"
REASON_NOT_READONLY = "仅对可执行 EXPLAIN 的只读查询语句执行"
REASON_EXPLAIN_DOLLAR = "包含 ${} 文本占位符，已跳过 EXPLAIN"
MUTATING_KEYWORDS = ["INSERT", "UPDATE", "DELETE", "REPLACE", "MERGE"]

# --- Fixed values: rule thresholds -------------------------------------------------
MAX_NESTING = 3
MAX_SQL_CHARS = 500
MAX_SQL_LINES = 20
MIN_MAGIC_NUMBERS = 2
NON_SARGABLE_FUNCTIONS = [
    "UPPER", "LOWER", "TRIM", "LTRIM", "RTRIM",
    "SUBSTRING", "SUBSTR", "LEFT", "RIGHT",
    "CONCAT", "REPLACE",
    "DATE", "YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND",
    "TO_CHAR", "TO_DATE", "DATE_FORMAT",
    "COALESCE", "IFNULL", "ISNULL", "NULLIF",
    "CAST", "CONVERT",
]
LIMIT_NUMBER = r"(?i)(LIMIT|OFFSET|TOP)\s+\d+"
MAGIC_NUMBER = r"[=<>!]\s*\b\d{2,}\b"
DOUBLED_COMMA = r"\w\s*,\s*,+\s*\w"
FROM_AND = r"\bFROM\s+[`\w.]+\s+AND\b"

# --- Fixed values: the rule catalogue ------------------------------------------------
# id, name, description, rule type, severity, category, priority, tags
RULE_CATALOGUE = [
    ("delete-update-no-where", "DELETE/UPDATE without WHERE", "DELETE 或 UPDATE 语句缺少 WHERE 条件会影响所有行",
     "PROBLEM", "CRITICAL", "BEST_PRACTICE", 2, ["dangerous", "correctness"]),
    ("null-comparison", "Incorrect NULL comparison", "使用 = NULL 或 != NULL 是错误的，应该使用 IS NULL 和 IS NOT NULL",
     "PROBLEM", "CRITICAL", "BEST_PRACTICE", 3, ["correctness", "null"]),
    ("dangerous-drop-truncate", "DROP/TRUNCATE TABLE detected", "DROP TABLE 和 TRUNCATE TABLE 是危险操作，会导致数据丢失",
     "PROBLEM", "CRITICAL", "SECURITY", 5, ["security", "dangerous"]),
    ("select-star", "Avoid SELECT *", "使用 SELECT * 会查询所有列，可能造成不必要的 I/O 和网络开销",
     "PROBLEM", "CRITICAL", "PERFORMANCE", 10, ["performance", "readability"]),
    ("function-on-indexed-column", "Function on indexed column in WHERE", "在索引列上使用函数会导致无法使用索引（非 SARGable 查询）",
     "PROBLEM", "CRITICAL", "PERFORMANCE", 12, ["performance", "index", "sargable"]),
    ("like-leading-wildcard", "Avoid LIKE with leading wildcard", "LIKE 以通配符开头无法使用索引，会导致全表扫描",
     "PROBLEM", "CRITICAL", "PERFORMANCE", 15, ["performance", "index"]),
    ("missing-where", "SELECT without WHERE clause", "SELECT 语句缺少 WHERE 条件可能导致全表扫描",
     "PROBLEM", "WARNING", "PERFORMANCE", 20, ["performance"]),
    ("orderby-without-limit", "ORDER BY without LIMIT", "ORDER BY 缺少 LIMIT 可能导致大结果集排序",
     "PROBLEM", "WARNING", "PERFORMANCE", 25, ["performance"]),
    ("implicit-join", "Implicit JOIN detected", "检测到隐式 JOIN (逗号连接表)，建议使用显式 JOIN",
     "PROBLEM", "WARNING", "BEST_PRACTICE", 30, ["readability", "best-practice"]),
    ("multi-column-or", "Multi-column OR condition", "在不同列上使用 OR 条件可能导致索引失效",
     "PROBLEM", "WARNING", "PERFORMANCE", 35, ["performance", "index"]),
    ("insert-without-columns", "INSERT without column list", "INSERT 未指定列名，表结构变化会导致查询失败",
     "PROBLEM", "WARNING", "BEST_PRACTICE", 38, ["maintainability", "best-practice"]),
    ("not-in", "NOT IN with potential NULL issue", "NOT IN 对 NULL 值处理有问题，且性能通常不如 NOT EXISTS",
     "PROBLEM", "WARNING", "PERFORMANCE", 40, ["performance", "correctness", "null"]),
    ("having-without-where", "HAVING without WHERE", "在可以过滤原始数据的情况下使用 HAVING 而不是 WHERE 会降低性能",
     "PROBLEM", "WARNING", "PERFORMANCE", 45, ["performance"]),
    ("complex-subquery", "Complex subquery detected", "检测到复杂的嵌套结构，建议拆分或使用 CTE",
     "SUGGESTION", "INFO", "MAINTAINABILITY", 50, ["maintainability", "readability"]),
    ("in-subquery", "IN with subquery", "IN 子查询通常可以改写为 JOIN 以获得更好的性能",
     "SUGGESTION", "INFO", "PERFORMANCE", 55, ["performance", "subquery"]),
    ("unnecessary-distinct", "Unnecessary DISTINCT", "过度使用 DISTINCT 可能掩盖表设计问题或 JOIN 条件缺失",
     "SUGGESTION", "INFO", "PERFORMANCE", 60, ["performance", "readability"]),
    ("multi-column-in", "Multi-column IN detected", "多列 IN 语法可读性差，建议改写为 JOIN 或多个单列 IN",
     "SUGGESTION", "INFO", "BEST_PRACTICE", 65, ["readability", "portability"]),
    ("long-sql-statement", "Long SQL statement", "SQL 语句过长，难以维护和调试",
     "SUGGESTION", "INFO", "MAINTAINABILITY", 70, ["maintainability", "readability"]),
    ("magic-numbers", "Magic numbers detected", "SQL 中包含魔法数字（硬编码的数字常量），降低可读性",
     "SUGGESTION", "INFO", "MAINTAINABILITY", 75, ["maintainability", "readability"]),
]

# Suggestion of each rule
RULE_SUGGESTION = {
    "delete-update-no-where": "添加 WHERE 条件或使用 LIMIT 限制影响的行数",
    "null-comparison": "使用 IS NULL 或 IS NOT NULL 代替 = NULL 或 != NULL",
    "dangerous-drop-truncate": "确保这是预期的操作，考虑使用事务保护",
    "select-star": "明确列出需要的列名，减少数据传输",
    "function-on-indexed-column": "考虑使用函数索引、计算列或重构查询条件",
    "like-leading-wildcard": "考虑使用全文索引、反转索引或后缀索引",
    "missing-where": "添加 WHERE 条件或使用 LIMIT 限制结果集",
    "orderby-without-limit": "添加 LIMIT 子句限制结果集数量",
    "implicit-join": "使用显式 JOIN ... ON 语法，提高可读性并避免笛卡尔积",
    "multi-column-or": "考虑使用 UNION ALL 或索引优化来提升性能",
    "insert-without-columns": "明确指定列名：INSERT INTO table (col1, col2, ...) VALUES (...)",
    "not-in": "考虑改写为 NOT EXISTS 或 LEFT JOIN ... WHERE ... IS NULL",
    "having-without-where": "考虑将可以在聚合前过滤的条件移到 WHERE 子句",
    "complex-subquery": "考虑使用 CTE (WITH 子句) 或拆分为多个查询",
    "in-subquery": "考虑改写为 INNER JOIN 或 EXISTS 子查询",
    "multi-column-in": "考虑改写为 JOIN 或使用多个单列 IN 条件",
    "long-sql-statement": "考虑拆分为多个查询、使用视图或 CTE (WITH 子句)",
    "magic-numbers": "使用命名常量或参数代替硬编码数字",
}
DISTINCT_JOIN_REASON = "与 JOIN 一起使用"
DISTINCT_JOIN_SUGGESTION = "检查 JOIN 条件是否完整"
DISTINCT_GROUP_REASON = "与 GROUP BY 一起使用"
DISTINCT_GROUP_SUGGESTION = "DISTINCT 与 GROUP BY 冗余，移除其中一个"

# Messages of the checks made outside the rule catalogue
MSG_INJECTION = "检测到 ${} 动态拼接，可能存在 SQL 注入风险"
MSG_DOUBLED_COMMA = "检测到连续逗号，SQL 可能在运行时语法错误"
FIX_DOUBLED_COMMA = "修正多余逗号后再发布"
MSG_FROM_AND = "检测到 FROM 后直接跟 AND，疑似缺少 WHERE"
FIX_FROM_AND = "将 AND 改为 WHERE 或补全 JOIN 条件"
MSG_BASIC_STAR = "使用了 SELECT *"
MSG_BASIC_WHERE = "UPDATE/DELETE 缺少 WHERE 条件"
MSG_BASIC_LIKE = "LIKE 以通配符开头"
MSG_BASIC_ORDER = "ORDER BY 未限制数量"
MSG_BASIC_JOIN = "检测到隐式 JOIN，建议使用显式 JOIN"
MSG_BASIC_NEST = "检测到复杂的嵌套结构，建议拆分"
LIKE_WILDCARD_ANY_QUOTE = r"LIKE\s+['\"]%"

# --- Fixed values: rule name -> report issue type ------------------------------------
ISSUE_TYPE_OF_RULE = {
    "SELECT_STAR": "SELECT_STAR",
    "MISSING_WHERE": "SELECT_WITHOUT_WHERE",
    "ORDER_BY_WITHOUT_LIMIT": "ORDER_BY_WITHOUT_LIMIT",
    "LIKE_LEADING_WILDCARD": "LIKE_LEADING_WILDCARD",
    "IMPLICIT_JOIN": "CROSS_JOIN",
    "MULTI_COLUMN_OR": "MISSING_INDEX",
    "MULTI_COLUMN_IN": "MISSING_INDEX",
    "NOT_IN": "MISSING_INDEX",
    "COMPLEX_SUBQUERY": "SUBQUERY_IN_SELECT",
    "N_PLUS_ONE": "POTENTIAL_N_PLUS_ONE",
    "SQL_INJECTION": "SQL_INJECTION_RISK",
    "SQL_SYNTAX_ERROR": "SQL_SYNTAX_ERROR",
}

# --- Fixed values: display labels ------------------------------------------------------
LABELS = {
    "MYBATIS_XML_STATIC": "MyBatis XML 静态",
    "MYBATIS_XML_DYNAMIC": "MyBatis XML 动态",
    "MYBATIS_ANNOTATION": "MyBatis 注解",
    "JPA_NATIVE_QUERY": "JPA 原生查询",
    "STRING_CONCAT": "字符串拼接",
    "PLACEHOLDER_TEMPLATE": "占位符模板",
    "UNKNOWN": "未知",
    "VALID": "合法",
    "INVALID": "非法",
    "SUPPORTED": "可执行",
    "NOT_SUPPORTED": "不支持",
    "SKIPPED": "已跳过",
    "JAVA": "Java",
    "JAVASCRIPT": "JavaScript/TypeScript",
    "MYBATIS": "MyBatis XML",
    "JPA_ANNOTATION": "JPA 注解",
    "STRING_LITERAL": "字符串拼接",
    "SQL_FILE": "SQL 文件",
    "SELECT_STAR": "SELECT *",
    "SELECT_WITHOUT_WHERE": "SELECT 无 WHERE",
    "ORDER_BY_WITHOUT_LIMIT": "ORDER BY 无 LIMIT",
    "MISSING_INDEX": "缺失索引",
    "IMPLICIT_TYPE_CONVERSION": "隐式类型转换",
    "SUSPICIOUS_JOIN_ORDER": "可疑 JOIN 顺序",
    "CROSS_JOIN": "隐式/CROSS JOIN",
    "SUBQUERY_IN_SELECT": "SELECT 中子查询",
    "UNCORRELATED_SUBQUERY": "非相关子查询",
    "POTENTIAL_N_PLUS_ONE": "潜在 N+1",
    "SQL_INJECTION_RISK": "SQL 注入风险",
    "DYNAMIC_SQL": "动态 SQL",
    "SQL_SYNTAX_ERROR": "SQL 语法错误",
    "TOO_MANY_JOINS": "过多 JOIN",
    "LIKE_LEADING_WILDCARD": "前置通配符 LIKE",
    "FULL_TABLE_SCAN": "全表扫描",
    "NO_INDEX_USED": "未使用索引",
    "HIGH_ROWS": "扫描行数过多",
    "USING_TEMPORARY": "使用临时表",
    "USING_FILESORT": "使用文件排序",
}
LABEL_OF_BLANK = "未知"
LABEL_OF_NULL = "Unknown"

# --- Fixed values: plan rows -----------------------------------------------------------
HIGH_ROWS_THRESHOLD = 10000
ACCESS_TYPE_NOTE = {
    "ALL": " (全表扫描)",
    "index": " (索引扫描)",
    "range": " (范围扫描)",
    "ref": " (索引查找)",
    "eq_ref": " (索引查找)",
}

# --- Fixed values: schema words ----------------------------------------------------------
CONSTRAINT_PREFIXES = [
    "PRIMARY KEY", "UNIQUE KEY", "UNIQUE INDEX", "KEY ", "INDEX ",
    "FULLTEXT KEY", "FULLTEXT INDEX", "SPATIAL KEY", "SPATIAL INDEX",
    "CONSTRAINT ", "FOREIGN KEY", "CHECK ",
]
PREDICATE_STOP_WORDS = [
    "select", "from", "where", "and", "or", "order", "group", "by", "limit",
    "join", "on", "as", "in", "like", "between", "is", "null", "not", "exists",
]
INFER_STOP_WORDS = [
    "SELECT", "FROM", "WHERE", "AND", "OR", "IN", "LIKE", "IS", "BETWEEN",
    "CASE", "WHEN", "THEN", "END", "AS", "SET", "VALUES", "UPDATE", "DELETE",
    "INSERT", "INTO", "ORDER", "GROUP", "BY", "LIMIT",
]
TABLE_REFERENCE = r"(?i)(?:\bFROM|\bJOIN|^\s*UPDATE|\bINTO)\s+([`\w.]+)"
GAP_EVIDENCE = "SQL 引用的表未在扫描范围 DDL 中出现"
UNINDEXED_EVIDENCE = "过滤/排序/关联字段未在 DDL 索引列中命中: "
GAP_RECOMMENDATION = "确认 DDL 是否缺失、是否由迁移系统托管，或在扫描时补充 schema-path。"
UNINDEXED_RECOMMENDATION = "结合访问频次和表规模评估单列或联合索引，并用 EXPLAIN 验证访问路径。"
WARN_NO_DDL = "未在扫描范围内发现 CREATE TABLE DDL，无法进行表结构关联分析。"
WARN_PARTIAL_DDL = "部分 SQL 引用的表未在项目 DDL 中出现，需确认 DDL 是否完整或由迁移系统托管。"
INFERRED_SOURCE = "INFERRED_FROM_DML"
REFERENCE_ONLY_SOURCE = "SQL_REFERENCE_ONLY"

# --- Fixed values: repair of DML before inference, in this order ---------------------------
DML_REPAIRS = [
    (r"#\{[^}]+\}", "'placeholder'"),
    (r"\$\{[^}]+\}", "placeholder"),
    (r"/\*\s*INCLUDE:[^*]+\*/", "*"),
    (r"/\*\s*BIND:[^*]+\*/", ""),
    (r"(?s)/\*.*?\*/", " "),
    (r"(?m)--.*$", " "),
    (r"(?i)\bFROM\s+([`\w.]+)\s+AND\b", "FROM $1 WHERE "),
    (r"(?i)\bWHERE\s+(AND|OR)\b", "WHERE "),
    (r"(?i)\b(AND|OR)\s+(AND|OR)\b", "$1"),
    (r"(?i)\bSET\s*,\s*", "SET "),
    (r",\s*,", ","),
    (r"(?i),\s*(WHERE|AND|OR|GROUP\s+BY|ORDER\s+BY|LIMIT)", " $1"),
    (r"(?i)\bCASE\s+([`\w\.]+)\s+([^\s]+)\s+END", "CASE WHEN $1 THEN $2 END"),
    (r"(?i)\bCASE\s+([`\w\.]+)\s+END", "CASE WHEN $1 THEN 1 END"),
    (r"\(\s*,", "("),
    (r",\s*\)", ")"),
    (r",\s*;", ";"),
    (r",\s*$", ""),
    (r"(?i)\bIN\s*\(\s*\)", "IN (NULL)"),
    (r"(?i)\bVALUES\s*\(\s*\)", "VALUES (NULL)"),
    (r"(?i)=\s*(,|\)|\bWHERE\b|\bAND\b|\bOR\b|\bGROUP\b|\bORDER\b|\bLIMIT\b|$)", "= 1 $1"),
    (r"(?i)\bWHERE\s*(GROUP\s+BY|ORDER\s+BY|LIMIT|$)", "WHERE 1=1 $1"),
]

# --- Fixed values: report limits -------------------------------------------------------------
TOP_STATS = 8
TOP_INSIGHTS = 6
TOP_DRIVERS = 3
CAMPAIGN_FILES = 6
CAMPAIGN_EXAMPLES = 5

# (critical issues at least, cap), then (warnings at least, cap)
CRITICAL_CAPS = [(20, 59), (5, 69), (1, 79)]
WARNING_CAPS = [(10, 84), (1, 89)]

# --- Fixed values: default recommendation of an issue type -------------------------------------
RECOMMENDATION_OF_TYPE = {
    "SQL_INJECTION_RISK": "把 ${} 或字符串拼接改为参数绑定；动态列名、排序字段必须走白名单映射。",
    "DYNAMIC_SQL": "把 ${} 或字符串拼接改为参数绑定；动态列名、排序字段必须走白名单映射。",
    "SELECT_WITHOUT_WHERE": "补充可命中索引的 WHERE 条件；确需全量读取时增加 LIMIT/分页并在代码中说明业务边界。",
    "ORDER_BY_WITHOUT_LIMIT": "补充 LIMIT/分页边界；如果用于离线全量排序，需要说明业务上限并确认排序字段索引。",
    "SELECT_STAR": "改为显式列清单，只返回业务需要字段，避免字段变更和大字段传输拖慢查询。",
    "MISSING_INDEX": "确认 WHERE/JOIN/ORDER BY 字段组合，为高频过滤条件补充单列或联合索引，并用 EXPLAIN 验证。",
    "SQL_SYNTAX_ERROR": "先修正 SQL 结构错误，再用数据库方言解析或最小样例执行验证。",
    "LIKE_LEADING_WILDCARD": "避免前置通配符；可改为后缀匹配、全文索引、反向索引或搜索服务。",
    "CROSS_JOIN": "改为显式 JOIN ... ON，并确认关联条件能限制结果集规模。",
    "SUBQUERY_IN_SELECT": "评估改写为 JOIN、EXISTS 或 CTE，减少重复执行和中间结果膨胀。",
    "UNCORRELATED_SUBQUERY": "评估改写为 JOIN、EXISTS 或 CTE，减少重复执行和中间结果膨胀。",
    "POTENTIAL_N_PLUS_ONE": "批量预取关联数据，或把循环内查询改为一次 IN/JOIN 查询。",
    "IMPLICIT_TYPE_CONVERSION": "确保比较两侧类型一致，必要时调整字段类型或入参类型，避免索引失效。",
    "SUSPICIOUS_JOIN_ORDER": "检查 JOIN 顺序和驱动表选择，把过滤性强的小结果集放在前面。",
    "TOO_MANY_JOINS": "拆分查询或沉淀中间表/视图，降低单条 SQL 的 JOIN 复杂度。",
    "UNKNOWN": "先确认规则来源和触发条件，再按原始 SQL 与位置复核是否需要修复。",
}
RECOMMEND_FULL_SCAN = "补充过滤条件或索引，并用 EXPLAIN 确认访问类型不再是全表扫描。"
RECOMMEND_INDEX = "按过滤、关联和排序字段补充合适索引，并验证扫描行数下降。"
RECOMMEND_OTHER = "结合位置、SQL 和证据复核风险，补充最小化修复并重新扫描确认。"

# --- Fixed values: insight and diagnostic texts ---------------------------------------------------
PARSE_FAILURE_TITLES = ["动态拼接待确认", "模板归一化失败", "MyBatis 模板待确认", "SQL 语法错误"]
TEMPLATE_GAPS = ["WHERE ?", "VALUES ?", "CASE ?", " SET ?", " AND ?", " OR ?"]
SKIP_REASON_SKIPPED = "未启用数据库连接或 EXPLAIN，当前仅有静态诊断证据"
SKIP_REASON_NOT_SUPPORTED = "非只读语句、动态模板或安全策略不支持执行计划"
REVIEW_UNKNOWN = "需要人工确认 SQL 模板和占位符"
REVIEW_DYNAMIC = "动态模板需确认白名单或参数绑定边界"
EVIDENCE_DML = "优先确认影响范围和 WHERE 条件"
EVIDENCE_INJECTION = "优先替换动态拼接，改用参数绑定或白名单映射"
EVIDENCE_FULL_SCAN = "结合表规模和过滤列补充索引或收窄扫描范围"

# --- Fixed values: remediation ----------------------------------------------------------------------
RULE_RANK = {
    "SQL_INJECTION_RISK": 0,
    "DYNAMIC_SQL": 1,
    "DANGEROUS_DROP_TRUNCATE": 2,
    "DELETE_UPDATE_NO_WHERE": 3,
    "SELECT_WITHOUT_WHERE": 4,
    "ORDER_BY_WITHOUT_LIMIT": 5,
    "FULL_TABLE_SCAN": 6,
    "NO_INDEX_USED": 7,
    "MISSING_INDEX": 8,
    "SELECT_STAR": 9,
    "LIKE_LEADING_WILDCARD": 10,
    "CROSS_JOIN": 11,
    "SUBQUERY_IN_SELECT": 12,
    "UNCORRELATED_SUBQUERY": 13,
    "POTENTIAL_N_PLUS_ONE": 14,
    "SUSPICIOUS_JOIN_ORDER": 15,
    "TOO_MANY_JOINS": 16,
    "IMPLICIT_TYPE_CONVERSION": 17,
    "UNKNOWN": 90,
    "SQL_SYNTAX_ERROR": 91,
}
RULE_RANK_DEFAULT = 100
SAFETY_RULES = ["SQL_INJECTION_RISK", "DYNAMIC_SQL", "DANGEROUS_DROP_TRUNCATE", "DELETE_UPDATE_NO_WHERE"]
PERFORMANCE_RULES = [
    "SELECT_WITHOUT_WHERE", "ORDER_BY_WITHOUT_LIMIT", "MISSING_INDEX", "NO_INDEX_USED", "FULL_TABLE_SCAN",
]
REVIEW_RULES = ["UNKNOWN", "SQL_SYNTAX_ERROR"]
DYNAMIC_RULES = ["SQL_INJECTION_RISK", "DYNAMIC_SQL"]
DML_RULES = ["DANGEROUS_DROP_TRUNCATE", "DELETE_UPDATE_NO_WHERE"]

TASK_IMPACT = {
    "P0_SAFETY": "可能导致 SQL 注入、越权读取或破坏性变更，需优先止血。",
    "PERFORMANCE": "可能扩大扫描范围或排序成本，影响数据库稳定性。",
    "MAINTAINABILITY": "模板或规则证据不足，需先复核以降低误报和漏报。",
    "OTHER": "可能导致查询结果或业务约束偏离预期。",
}
TASK_RECOMMENDATION = {
    "DYNAMIC": "把动态值改为参数绑定；动态列名、排序字段使用白名单映射。",
    "PERFORMANCE": "补充业务过滤、分页边界或索引，并用 EXPLAIN 验证扫描范围。",
    "SELECT_STAR": "改为显式字段清单，只返回业务需要字段。",
    "DML": "为危险 DML 增加 WHERE、影响行数校验和审批保护。",
    "REVIEW": "先归一化模板或修正语法，再重新扫描归类。",
    "OTHER": "按规则建议完成最小化修复，并重新扫描确认。",
}
FIRST_PASS_FOCUS = {
    "NONE": "暂无修复任务。",
    "P0": "优先处理 P0 安全止血任务，完成后重新扫描。",
    "P1": "优先收敛 P1 无边界查询与索引风险。",
    "P2": "优先复核模板和低风险正确性任务。",
}
ACTION_DYNAMIC = "P0: 先处理动态 SQL 安全止血，替换 ${} 或字符串拼接。"
ACTION_UNBOUNDED = "P1: 收敛无边界读取和排序分页风险。"
ACTION_SCHEMA = "P1: 按 DDL 关联分析复核表结构、索引覆盖和缺失 schema 证据。"
ACTION_BASELINE = "P2: 保留当前报告作为治理基线，持续关注人工复核项。"
LIMIT_EXPLAIN = "未配置或未执行 EXPLAIN，性能判断以静态规则为主。"
LIMIT_REVIEW = "动态模板、解析异常或 EXPLAIN 异常需要人工复核。"
LIMIT_PARSE = "部分 SQL 需要修正模板或占位符后再进入精确诊断。"
LIMIT_SCHEMA = "部分 SQL 引用表缺少项目内 DDL，schema 关联结论需要补充迁移文件或 schema-path。"
EVIDENCE_SOURCES = ["Static AST rules", "EXPLAIN evidence", "DDL schema association"]

# id, title, rules, unsafe pattern, safe pattern, steps, verification, known limits
RECIPES = [
    ("dynamic-value-binding", "动态值改为参数绑定",
     ["SQL_INJECTION_RISK", "DYNAMIC_SQL"],
     "${value} 或字符串拼接直接进入 SQL", "#{value} / ? 参数绑定；动态标识符走白名单",
     ["定位动态片段来源。", "普通值改为参数绑定。", "列名、排序方向等标识符改为白名单映射。"],
     "重新扫描确认 SQL_INJECTION_RISK/DYNAMIC_SQL 消失，并补充动态分支测试。",
     ["表名、列名等标识符不能直接参数绑定，必须白名单。"]),
    ("dynamic-order-by-whitelist", "动态排序白名单",
     ["DYNAMIC_SQL", "SQL_INJECTION_RISK"],
     "ORDER BY ${orderBy}", "ORDER BY <mapped_column> <mapped_direction>",
     ["枚举允许排序字段。", "枚举 ASC/DESC。", "默认值落到安全排序。"],
     "重新扫描并覆盖非法排序字段回退分支。",
     ["排序字段来自业务枚举时仍需处理默认分支。"]),
    ("unbounded-query-containment", "无边界查询收敛",
     ["SELECT_WITHOUT_WHERE", "ORDER_BY_WITHOUT_LIMIT", "MISSING_INDEX", "NO_INDEX_USED", "FULL_TABLE_SCAN"],
     "缺少 WHERE/LIMIT 或无法命中索引", "业务过滤 + 分页边界 + 可验证索引路径",
     ["补充业务过滤条件。", "增加分页或 LIMIT 上限。", "用 EXPLAIN 验证访问路径和扫描行数。"],
     "重新扫描并记录 EXPLAIN 访问类型、索引和 rows 下降。",
     ["离线批处理全量读取需要显式说明业务边界。"]),
    ("select-star-field-list", "SELECT * 改为字段清单",
     ["SELECT_STAR"],
     "SELECT *", "SELECT id, status, updated_at",
     ["确认调用方实际读取字段。", "替换为稳定字段清单。", "回归序列化和映射结果。"],
     "重新扫描确认 SELECT_STAR 消失。",
     ["字段清单需随业务 DTO 演进同步维护。"]),
    ("dangerous-dml-guardrail", "危险 DML 防护",
     ["DANGEROUS_DROP_TRUNCATE", "DELETE_UPDATE_NO_WHERE"],
     "DROP/TRUNCATE 或无 WHERE UPDATE/DELETE", "审批保护 + WHERE 边界 + 影响行数校验",
     ["确认语句是否允许在线执行。", "补充 WHERE 或迁移审批保护。", "增加影响行数阈值和回滚预案。"],
     "重新扫描确认危险 DML 规则消失或完成审批记录。",
     ["结构变更类 SQL 可能需要迁移系统单独治理。"]),
    ("template-review-normalization", "模板归一化复核",
     ["UNKNOWN", "SQL_SYNTAX_ERROR"],
     "动态模板或方言语法无法稳定解析", "最小样例 + 模板归一化 + 明确规则归类",
     ["抽取最小 SQL 样例。", "修正模板占位符或数据库方言。", "重新扫描并归类到明确规则。"],
     "重新扫描确认 UNKNOWN/SQL_SYNTAX_ERROR 下降或已有人工复核结论。",
     ["复杂模板可能需要结合运行时参数人工确认。"]),
    ("general-rule-remediation", "通用规则修复",
     ["KNOWN_RULE"],
     "已识别规则暂无专用修复模板", "按规则建议做最小化修复并保留验证证据",
     ["确认规则消息和 SQL 位置。", "按规则建议完成最小化修改。", "重新扫描确认该规则不再触发。"],
     "重新扫描确认规则消失，必要时补充 SQL 单元或集成测试。",
     ["复杂 SQL 可能需要结合业务语义决定最终改写方式。"]),
]

# id, priority, theme, title, summary, evidence level, rules, recommendations, checklist
CAMPAIGNS = [
    ("p0-dynamic-sql-safety", "P0", "SAFETY", "动态 SQL 安全止血",
     "集中处理 ${}、字符串拼接和潜在注入风险，先消除可导致越权查询或 SQL 注入的入口。", "STRONG",
     ["SQL_INJECTION_RISK", "DYNAMIC_SQL"],
     ["把 ${} 改为参数绑定；动态列名和排序字段使用白名单映射。"],
     ["重新扫描并确认该战役 finding 数为 0。", "为动态排序/筛选分支补充单元或集成测试。"]),
    ("p1-unbounded-query-containment", "P1", "PERFORMANCE", "无边界查询和排序风险收敛",
     "处理 SELECT 无 WHERE、ORDER BY 无 LIMIT、潜在全表扫描等会扩大数据库负载的查询。", "MEDIUM",
     ["SELECT_WITHOUT_WHERE", "ORDER_BY_WITHOUT_LIMIT", "MISSING_INDEX", "NO_INDEX_USED", "FULL_TABLE_SCAN"],
     ["补充可命中索引的过滤条件、分页边界，并用 EXPLAIN 验证访问路径。"],
     ["重新扫描确认 P1 高风险项下降。", "对关键查询执行 EXPLAIN 并记录访问类型、行数和索引命中。"]),
    ("p2-template-review", "P2", "MAINTAINABILITY", "模板解析与未知规则复核",
     "集中复核 UNKNOWN、SQL_SYNTAX_ERROR 等无法直接派修的模板问题，先把噪音转成明确规则或修复项。", "NEEDS_REVIEW",
     ["UNKNOWN", "SQL_SYNTAX_ERROR"],
     ["定位 MyBatis 动态分支、数据库方言或占位符归一化问题，补齐最小样例后重新扫描。"],
     ["重新扫描并确认 UNKNOWN/SQL_SYNTAX_ERROR 已下降，或被归类到明确规则。"]),
]

# --- fixed values: patterns whose matches must agree ------------------------------------------------------

# of DDL and of the columns that a statement compares
CREATE_INDEX = (
    r"(?is)CREATE\s+(?:UNIQUE\s+)?INDEX\s+`?\w+`?\s+ON\s+(?:`?\w+`?\.)?`?(\w+)`?\s*\(([^)]+)\)"
)
INLINE_INDEX = r"(?i)(?:UNIQUE\s+|FULLTEXT\s+|SPATIAL\s+)?(?:KEY|INDEX)\s+`?\w+`?\s*\(([^)]+)\)"
TABLE_NAME = r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:`?\w+`?\.)?`?(\w+)`?"
PREDICATE = (
    r"(?i)(?:\b[`\w]+`?\.)?`?([A-Za-z_]\w*)`?\s*(?:=|<>|!=|<=|>=|<|>|\bIN\b|\bLIKE\b|\bBETWEEN\b|\bIS\b)"
)

# what makes a mapper template parseable, in this order
TEMPLATE_REPAIRS = [
    (r"(?<!['\"])\s*,\s*,+\s*", ", "),
    (r"(?i)\bfrom\s+([`\w.]+)\s+and\s+", "FROM $1 WHERE "),
    (r"(?i)\bcase\s*\?\s*end\b", "1"),
    (r"(?i)\bvalues\s*\?(?=\s|$)", "VALUES (1)"),
    (r"(?i)\bset\s*\?(?=\s*(where\b|$))", "SET template_value = 1"),
    (r"(?i)\bwhere\s*\?(?=\s|$)", "WHERE 1 = 1"),
    (r"(?i)\band\s*\?(?=\s|$)", "AND 1 = 1"),
    (r"(?i)\bor\s*\?(?=\s|$)", "OR 1 = 1"),
]
