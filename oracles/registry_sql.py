"""SQL for the queries of ``logsieve.plans.registry``."""

from __future__ import annotations

from logsieve.functions import words
from logsieve.session import TABLES
from logsieve.sources.samples import FLOW_TEMPLATES, DDL_TEMPLATES, DIALECT_SPELLINGS, DIALECT_TEMPLATES
from oracles.lint_sql import (
    _AFTER_PAREN, CATALOG_CTE, COLUMN_REFS, FOUND, IS_TABLE, LABEL_DIM, LOG, MESSAGE_DIM, NAMES, OPERANDS,
    RULE_DIM, RULE_SQL, TABLE_REFS, TOKENS, among, lit, name_rule_query, rule_query,
)

_NESTED = """counted AND (scope_kind = 'derived' OR (in_linted AND (scope_kind = 'in_subquery' OR (scope_kind = 'scalar' AND NOT seg_opaque))))"""
_ITEM = "(marker = 'SELECT' OR (base AND tok = ',' AND clause = 'SELECT'))"

STATS = f"""
stat AS (
  SELECT texts.text_id, any_value(b.error) AS error,
    count(*) FILTER (k.first) AS statement_count,
    count(*) FILTER ({IS_TABLE} AND depth = bd AND counted) AS table_count,
    count(*) FILTER (u = 'JOIN' AND kind = 'path' AND base AND sel IS NOT NULL AND counted) AS join_count,
    count(*) FILTER ({_NESTED}) AS subquery_count,
    count(*) FILTER ({_ITEM} AND sel IS NOT NULL AND counted) AS column_count,
    coalesce(bool_or(marker = 'WHERE' AND sel IS NOT NULL AND counted), false) AS has_where,
    coalesce(bool_or(marker = 'GROUP' AND sel IS NOT NULL AND counted), false) AS has_group_by,
    coalesce(bool_or(marker = 'ORDER' AND query_level AND counted), false) AS has_order_by,
    coalesce(bool_or(marker = 'LIMIT' AND query_level AND counted), false) AS has_limit
  FROM texts LEFT JOIN k USING (text_id) LEFT JOIN bad_texts b ON b.text_id = texts.text_id
  GROUP BY texts.text_id)"""

_SIDE = "(u IN ('INNER', 'LEFT', 'RIGHT', 'FULL', 'CROSS', 'NATURAL') AND kind = 'path' AND coalesce(n1 <> '(', true))"
_CALLED = f"""(k1 = 'path' AND (p1 NOT IN {among(words.RESERVED)} OR p1 IN {among(words.FUNCTION_WORDS)} OR p1 IN {among(words.CALL_PRINTED)}))"""
FORMAT = f"""
pieces AS (
  SELECT text_id, pos,
    CASE WHEN first THEN CASE WHEN pos > 0 THEN chr(10) || chr(10) ELSE '' END
      WHEN {_SIDE} AND p1 IN {among(words.JOIN_MODIFIERS)} THEN ' '
      WHEN base AND kind = 'path' AND (u IN ('WHERE', 'HAVING', 'LIMIT', 'OFFSET', 'SET')
        OR (u = 'FROM' AND coalesce(p1 <> 'DISTINCT', true)) OR (u IN ('GROUP', 'ORDER') AND n1 = 'BY')) THEN chr(10)
      WHEN kind = 'path' AND u IN {among(words.SET_OPERATORS)} THEN chr(10)
      WHEN {_SIDE} OR (kind = 'path' AND u = 'JOIN' AND coalesce(p1 NOT IN {among(words.JOIN_MODIFIERS)}, true)) THEN chr(10) || '  '
      WHEN u = 'ON' AND kind = 'path' AND coalesce(p1 <> 'DISTINCT', true) THEN chr(10) || '    '
      WHEN p1 = 'UNION' AND u <> 'ALL' THEN chr(10)
      WHEN p1 IN ('(', '::') OR u IN (',', ')', ';', '::') OR (u = '(' AND {_CALLED}) THEN ''
      ELSE ' ' END
    || CASE WHEN kind = 'path' AND u IN {among(words.RESERVED)} THEN u ELSE tok END AS piece
  FROM k WHERE tok <> ';'),
printed AS (SELECT text_id, string_agg(piece, '' ORDER BY pos) AS formatted FROM pieces GROUP BY text_id)"""

ALL_FOUND = f"""{NAMES}, {FOUND},
every AS (SELECT *, false AS quirk FROM found UNION ALL SELECT * FROM named)"""

KEPT_FOUND = f"""{ALL_FOUND},
all_found AS (SELECT * FROM every WHERE NOT quirk)"""

_DDL_LOG = f"""
log AS (
  SELECT event_id AS query_id,
         replace(replace(([{", ".join(lit(t) for t in DDL_TEMPLATES)}])[(event_id % {len(DDL_TEMPLATES)}) + 1],
                 '{{u}}', user_id::VARCHAR), '{{e}}', event_id::VARCHAR) AS sql FROM events),
texts AS (SELECT sql, min(query_id) AS ddl_id FROM log GROUP BY sql)"""

# What each DDL template defines, by template number: table, column, type, family, key.
_DDL_RESULT = [
    (0, "sensor", "code", "int", "numeric", False),
    (1, "sensor", "code", "int", "numeric", False),
    (1, "sensor", "place", "varchar", "string", False),
    (2, "sensor", "code", "int", "numeric", False),
    (2, "sensor", "place", "varchar", "string", False),
    (2, "reading", "sensor_code", "int", "numeric", False),
    (2, "reading", "degrees", "double", "numeric", False),
    (3, "sensor", "code", "int", "numeric", True),
    (3, "sensor", "place", "varchar", "string", False),
    (4, "t_{u}", "a", "bigint", "numeric", True),
    (4, "t_{u}", "b", "text", "string", True),
    (4, "t_{u}", "c", "decimal", "numeric", True),
    (5, "shop.item_{e}", "id", "bigint", "numeric", True),
    (5, "shop.item_{e}", "made", "date", "other", True),
    (6, "log_{e}", "a", "int", "numeric", True),
    (6, "log_{e}", "b", "int", "numeric", False),
    (7, "twice_{e}", "b", "double", "numeric", False),
    (7, "twice_{e}", "c", "timestamp", "other", False),
    (9, "n_{u}", "name", "string", "string", False),
    (9, "n_{u}", "size", "float", "numeric", False),
]

# What the lexical rules of each dialect make of the dialect templates: error, or the rules found.
# "*" stands for the dialects that are not named.
_QUOTE, _OPEN, _CUT = "unterminated quote", "unterminated comment", "incomplete statement"
_DIALECT_RESULT = [
    {"*": "", "mysql": _QUOTE},
    {"*": ""},
    {"*": ""},
    {"*": _QUOTE, "mysql": "", "bigquery": ""},
    {"*": "L015", "mysql": "", "bigquery": ""},
    {"*": "", "mssql": "L015", "sqlite": "L015"},
    {"*": "L003", "mysql": _QUOTE, "bigquery": _QUOTE},
    {"*": _QUOTE, "bigquery": ""},
    {"*": "", "mysql": "L003"},
    {"*": "L001,L026"},
    {"*": _OPEN},
    {"*": "L026", "mysql": _CUT, "bigquery": _CUT},
    {"*": "L015"},
    {"*": "L015"},
    {"*": "L026", "mysql": _QUOTE},
    {"*": "L003"},
    {"*": _OPEN},
]
_DIALECT_NAMES = ["generic", "ansi", "postgresql", "mysql", "mssql", "bigquery", "sqlite"]
_DIALECT_ROWS = [(n, d, r.get(d, r["*"])) for n, r in enumerate(_DIALECT_RESULT) for d in _DIALECT_NAMES]
_DIALECT_LINT = f"""WITH expected(n, dialect, outcome) AS (VALUES {", ".join(str(r) for r in _DIALECT_ROWS)}),
  named AS (SELECT event_id AS query_id, event_id % {len(DIALECT_TEMPLATES)} AS n,
    lower(([{", ".join(lit(d) for d in DIALECT_SPELLINGS)}])[((event_id // {len(DIALECT_TEMPLATES)}) % {len(DIALECT_SPELLINGS)}) + 1]) AS d FROM events),
  spoken AS (SELECT query_id, n, CASE WHEN d IN {among(_DIALECT_NAMES)} THEN d ELSE 'generic' END AS dialect FROM named)
  SELECT query_id, dialect, CASE WHEN outcome LIKE '% %' THEN outcome END AS error,
    CASE WHEN outcome LIKE '% %' THEN '' ELSE outcome END AS rules
  FROM spoken JOIN expected USING (n, dialect)"""


def _unpivoted(table: str, made: str, value: str) -> str:
    return f"UNPIVOT (SELECT {made} FROM {table}) ON COLUMNS(*) INTO NAME column_name VALUE {value}"


_COLUMN_COUNTS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, rows, rows - filled AS nulls "
    f"FROM ({_unpivoted(t, 'count(COLUMNS(*))', 'filled')}), (SELECT count(*) AS rows FROM {t})"
    for t in TABLES
)

# Per table the columns as declared and as they are (an empty side: not there), and whether the column is a key.
_CONFORMANCE = """region r_regionkey int int k,region r_name string string,region r_comment string -,
nation n_nationkey int int k,nation n_name string string,nation n_regionkey bigint int,
customer c_custkey bigint bigint k,customer c_name string string,customer c_nationkey int int,customer c_acctbal int double,
customer c_mktsegment - string,supplier s_suppkey int bigint k,supplier s_name string string,supplier s_nationkey int int,
supplier s_acctbal double double,part p_partkey bigint bigint k,part p_name string string,part p_brand string string,
part p_type string string,part p_size string int,part p_retailprice bigint double,orders o_orderkey bigint bigint k,
orders o_custkey bigint bigint k,orders o_orderstatus string string,orders o_totalprice double double,
orders o_orderdate timestamp timestamp,orders o_clerk string -,orders o_orderpriority - string,
lineitem l_orderkey bigint bigint,lineitem l_partkey int bigint,lineitem l_suppkey bigint bigint,lineitem l_linenumber int int,
lineitem l_quantity int double,lineitem l_extendedprice double double,lineitem l_discount int double,lineitem l_tax double double,
lineitem l_returnflag string string,lineitem l_linestatus string string,lineitem l_shipdate timestamp timestamp,
events event_id bigint bigint k,events ts timestamp timestamp,events user_id int bigint,events event_type bigint string,
events value double double,events props string string"""


def _conformance() -> str:
    rows = []
    for table, column, declared, actual, *key in (x.split() for x in _CONFORMANCE.replace("\n", "").split(",")):
        stated = "NULL" if declared == "-" else f"'{declared}'"
        if actual == "-":
            rows.append(f"SELECT '{table}' AS table_name, '{column}' AS column_name, {stated} AS declared, NULL AS actual, "
                        "NULL::BIGINT AS rows, NULL::BIGINT AS nulls, NULL::BIGINT AS fits, 'missing' AS status")  # fmt: skip
            continue
        status = "extra" if declared == "-" else "type" if declared != actual else "same"
        status = f"CASE WHEN count(*) > count({column}) THEN 'nulls' ELSE '{status}' END" if key and status == "same" else f"'{status}'"
        fits = "NULL" if declared == "-" else f"count(*) FILTER (TRY_CAST(TRY_CAST({column} AS {declared}) AS {actual}) = {column})"
        rows.append(f"SELECT '{table}' AS table_name, '{column}' AS column_name, {stated} AS declared, '{actual}' AS actual, "
                    f"count(*) AS rows, count(*) - count({column}) AS nulls, {fits} AS fits, {status} AS status FROM {table}")  # fmt: skip
    return " UNION ALL ".join(rows)


# The edges of each flow template, by template number: target and source.
_FLOWS = [
    (0, "stage_{u}", "raw_{u}"), (0, "stage_{u}", "calendar"),
    (1, "mart_{u}", "stage_{u}"), (1, "mart_{u}", "fixes_{u}"),
    (2, "report_{u}", "mart_{u}"), (2, "report_{u}", "regions"),
    (3, "raw_{u}", "report_{u}"), (3, "raw_{u}", "seen_{u}"),
    (4, "total", "mart_{u}"),
    (5, "daily_{u}", "stage_{u}"),
    (7, "plain_{u}", "total"),
]
_REACH = f"""WITH RECURSIVE defs(n, t, s) AS (VALUES {", ".join(str(r) for r in _FLOWS)}),
  edges AS (SELECT DISTINCT replace(t, '{{u}}', user_id::VARCHAR) AS target, replace(s, '{{u}}', user_id::VARCHAR) AS source
    FROM events JOIN defs ON n = event_id % {len(FLOW_TEMPLATES)}),
  walk(a, b, distance) AS (SELECT target, source, 1 FROM edges
    UNION SELECT a, source, distance + 1 FROM walk JOIN edges ON b = target WHERE distance < 14)
  SELECT a AS table, b AS ancestor, min(distance) AS distance FROM walk GROUP BY ALL"""

_PROFILED = ["event_id", "user_id", "event_type", "value", "props"]
_NUMBERS = ["event_id", "user_id", "value"]


def lint_oracles() -> dict[str, str]:
    out = {
        "source_log": f"WITH {LOG} SELECT query_id, user_id, 'generic' AS dialect, rtrim(ltrim(sql)) AS sql FROM log",
        "dialect_usage": f"""WITH {LOG}, named AS (
            SELECT sql, lower(([{", ".join(lit(d) for d in DIALECT_SPELLINGS)}])[(query_id % {len(DIALECT_SPELLINGS)}) + 1]) AS d FROM log),
          resolved AS (SELECT sql, CASE WHEN d IN ('generic', 'ansi', 'postgresql', 'mysql', 'mssql', 'bigquery', 'sqlite') THEN d ELSE 'generic' END AS dialect FROM named)
          SELECT dialect, count(*) AS queries, count(DISTINCT sql) AS texts, dialect IN ('mysql', 'bigquery') AS dq_is_string,
            dialect IN ('mysql', 'bigquery') AS backslash_escapes, dialect IN ('mssql', 'sqlite') AS brackets
          FROM resolved GROUP BY dialect""",
        "text_usage": f"WITH {LOG} SELECT text_id, sql, uses FROM texts",
        "ddl_catalog": f"""WITH {_DDL_LOG}, defs(n, table_tpl, column_name, data_type, type_family, is_indexed) AS (VALUES {", ".join(str(r) for r in _DDL_RESULT)})
          SELECT ddl_id, replace(replace(table_tpl, '{{u}}', user_id::VARCHAR), '{{e}}', event_id::VARCHAR) AS table_name,
            column_name, data_type, type_family, is_indexed
          FROM texts JOIN events ON event_id = ddl_id JOIN defs ON n = ddl_id % {len(DDL_TEMPLATES)}""",
        "live_catalog": f"WITH {CATALOG_CTE}, counts AS ({_COLUMN_COUNTS}) SELECT * FROM cat JOIN counts USING (table_name, column_name)",
        "tokens": f"""WITH {TOKENS} SELECT text_id, pos::INT AS pos, tok, kind, stmt, depth::INT AS depth, scope::INT AS scope,
            bd::INT AS bd, (k.arm - coalesce(a.arm, 0))::INT AS arm, clause
          FROM k LEFT JOIN (SELECT text_id, pos AS scope, arm FROM k) a USING (text_id, scope)""",
        "well_formed": f"""WITH {TOKENS} SELECT query_id, error IS NULL AS success, error FROM ids LEFT JOIN bad_texts USING (text_id)""",
        "scopes": f"""WITH {TOKENS} SELECT h.text_id, h.stmt, h.pos::INT AS scope, CASE WHEN h.first THEN 'top' ELSE o.scope_kind END AS own_kind,
            CASE WHEN NOT h.first THEN o.sel END::INT AS parent_sel, h.reached, h.counted
          FROM k h LEFT JOIN k o ON o.text_id = h.text_id AND o.pos = h.pos - 1 AND NOT h.first WHERE h.head""",
        "table_references": f"""WITH {TOKENS}, {TABLE_REFS} SELECT text_id, stmt, sel::INT AS sel, pos::INT AS pos, alias, table_name, ref_kind, counted, reached FROM refs""",
        "column_references": f"""WITH {TOKENS}, {COLUMN_REFS} SELECT text_id, stmt, sel::INT AS sel, pos::INT AS pos,
            lower(qualifier) AS qualifier, column_name, clause, against, expr_visible AS linted_expr FROM cols""",
        "comparison_operands": f"""WITH {TOKENS}, {OPERANDS}, hits AS ({RULE_SQL["L012"]}),
          maths AS (SELECT text_id, pos FROM ({RULE_SQL["L012"].replace("role = 'cmp' AND in_filter", "role = 'cmp'")}) WHERE variant = 'math')
          SELECT text_id, stmt, sel::INT AS sel, pos::INT AS pos, tok AS op, array_to_string(lefts, ' ') AS left_operand,
            array_to_string(rights, ' ') AS right_operand, clause,
            EXISTS (SELECT 1 FROM maths m WHERE m.text_id = k.text_id AND m.pos = k.pos) AS math_operand,
            len(lefts) > 0 AND lefts = rights AS same_sides
          FROM k JOIN operands USING (text_id, pos) WHERE role = 'cmp' AND sel IS NOT NULL""",
        "dialect_lint": _DIALECT_LINT,
        "projection_sizes": f"""WITH {TOKENS} SELECT text_id, sel::INT AS sel, count(*) AS items, bool_and(counted) AS counted FROM k WHERE {_ITEM} AND sel IS NOT NULL GROUP BY text_id, sel""",
        "query_stats": f"""WITH {TOKENS}, {STATS} SELECT query_id, stat.* EXCLUDE (text_id), len(string_split(sql, chr(10)))::INT AS line_count,
            length(sql)::INT AS char_count FROM ids JOIN stat USING (text_id) JOIN texts USING (text_id)""",
        "formatted": f"WITH {TOKENS}, {FORMAT} SELECT * FROM printed",
        "severity_summary": f"""WITH {TOKENS}, {KEPT_FOUND}, {RULE_DIM}, per_text AS (
            SELECT text_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
              count(*) FILTER (severity = 'info') AS infos, count(*) AS total FROM all_found JOIN rule_dim USING (rule_id) GROUP BY text_id)
          SELECT query_id, errors, warnings, infos, total,
            CASE WHEN errors > 0 THEN 'error' WHEN warnings > 0 THEN 'warning' ELSE 'info' END AS worst,
            CASE WHEN errors > 0 THEN 'error' WHEN warnings > 0 THEN 'warning' ELSE 'none' END AS badge
          FROM ids JOIN per_text USING (text_id)""",
        "analysis_records": f"""WITH {TOKENS}, {ALL_FOUND}, {STATS}, {FORMAT}
          SELECT texts.text_id, texts.uses, stat.error IS NULL AS success, stat.error, coalesce(formatted, '') AS formatted_sql,
            (SELECT count(*) FROM every WHERE every.text_id = texts.text_id AND visible) AS n_issues,
            statement_count, table_count, has_where
          FROM texts JOIN stat USING (text_id) LEFT JOIN printed USING (text_id)""",
        "lineage_reach": _REACH,
        "lint_incremental": f"""WITH {TOKENS}, {KEPT_FOUND} SELECT rule_id, count(*) AS findings, count(DISTINCT query_id) AS queries
          FROM ids JOIN all_found USING (text_id) GROUP BY rule_id""",
        "ledger_batches": f"""WITH {LOG}, early AS (SELECT DISTINCT sql FROM log WHERE query_id % 3 = 0)
          SELECT 0::BIGINT AS batch_id, count(*) AS texts FROM early
          UNION ALL SELECT 1, count(DISTINCT sql) FROM log WHERE sql NOT IN (SELECT sql FROM early)""",
        "record_roundtrip": f"""WITH {TOKENS}, {ALL_FOUND}, {STATS}, {FORMAT}
          SELECT texts.text_id, 1::BIGINT AS copies, texts.uses, stat.error, coalesce(formatted, '') AS formatted_sql,
            (SELECT count(*) FROM every WHERE every.text_id = texts.text_id AND visible)::INT AS n_issues, 0::BIGINT AS bad_lines
          FROM texts JOIN stat USING (text_id) LEFT JOIN printed USING (text_id)""",
        "schema_conformance": _conformance(),
        "props_fields": """SELECT event_type, field, CASE WHEN t IN ('BIGINT', 'UBIGINT') THEN 'BIGINT' WHEN t = 'VARCHAR' THEN 'STRING' ELSE t END AS data_type,
            count(*) AS values FROM (SELECT event_type, field, json_type(props, '$.' || field) AS t
              FROM (SELECT event_type, props, unnest(json_keys(props)) AS field FROM events)) GROUP BY ALL""",
        "column_profile": " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, "
            f"true AS distinct_close, {'true' if c in _NUMBERS else 'NULL::BOOLEAN'} AS median_close FROM events" for c in _PROFILED),
        "lineage": f"""WITH {TOKENS}, {TABLE_REFS}
          SELECT h.text_id, 'scope' AS edge, h.pos::INT AS child, o.sel::VARCHAR AS parent
          FROM k h JOIN k o ON o.text_id = h.text_id AND o.pos = h.pos - 1 WHERE h.head AND NOT h.first AND o.sel IS NOT NULL
          UNION ALL SELECT text_id, 'table', sel::INT, table_name FROM refs WHERE table_name IS NOT NULL""",
        "clean_queries": f"""WITH {TOKENS}, {KEPT_FOUND}, {RULE_DIM} SELECT query_id FROM ids WHERE text_id NOT IN (SELECT text_id FROM bad_texts)
          AND text_id NOT IN (SELECT text_id FROM all_found JOIN rule_dim USING (rule_id) WHERE severity <> 'info')""",
        "rules_per_user_day": f"""WITH {TOKENS}, {KEPT_FOUND}, counts AS (
            SELECT user_id, ts::DATE AS day, rule_id, count(*) AS findings, count(DISTINCT query_id) AS queries FROM ids JOIN all_found USING (text_id) GROUP BY ALL)
          SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY findings DESC, rule_id)::INT AS rank FROM counts QUALIFY rank <= 3""",
        "rules_rollup": f"""WITH {TOKENS}, {KEPT_FOUND} SELECT user_id, rule_id, count(*) AS findings, grouping_id(user_id, rule_id)::BIGINT AS level
          FROM ids JOIN all_found USING (text_id) GROUP BY ROLLUP (user_id, rule_id)""",
    }
    out["stream_rule_windows"] = f"""WITH {TOKENS}, {KEPT_FOUND}, issues AS (SELECT ts, rule_id FROM ids JOIN all_found USING (text_id))
      SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' AS window_end,
        rule_id, count(*) AS findings FROM issues
      WHERE time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes'
        <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10 minutes' FROM issues) GROUP BY ALL"""
    for rule in RULE_SQL:
        out[f"lint_{rule}"] = rule_query(rule)
    for rule in ("L020", "L021", "L022"):
        out[f"lint_{rule}"] = name_rule_query(rule)
    for name, keep in (("lint_counts", "NOT quirk"), ("lint_counts_parity", "visible")):
        out[name] = f"""WITH {TOKENS}, {ALL_FOUND}, {RULE_DIM}
          SELECT rule_id, severity, category, count(*) AS findings, count(DISTINCT query_id) AS queries
          FROM ids JOIN every USING (text_id) JOIN rule_dim USING (rule_id) WHERE {keep} GROUP BY ALL"""
    for lang in ("en", "tr"):
        out[f"messages_{lang}"] = f"""WITH {TOKENS}, {ALL_FOUND}, {RULE_DIM}, {MESSAGE_DIM}, {LABEL_DIM}
          SELECT text_id, pos, e.rule_id, replace(replace(message_tpl, '{{1}}', coalesce(p1, '')), '{{2}}', coalesce(p2, '')) AS message,
            replace(replace(advice_tpl, '{{1}}', coalesce(p1, '')), '{{2}}', coalesce(p2, '')) AS advice,
            sl.label AS severity_label, cl.label AS category_label
          FROM every e JOIN rule_dim r ON r.rule_id = e.rule_id
          JOIN message_dim m ON m.rule_id = e.rule_id AND m.variant = e.variant AND m.lang = '{lang}'
          JOIN label_dim sl ON sl.kind = 'severity' AND sl.code = severity AND sl.lang = '{lang}'
          JOIN label_dim cl ON cl.kind = 'category' AND cl.code = category AND cl.lang = '{lang}'
          WHERE NOT quirk"""
    return out
