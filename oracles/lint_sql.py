"""Standard SQL for the lint queries, written with self-joins over parenthesis ranges.

The library finds scopes with running windows; here a scope is the innermost parenthesis range
around a token, found by joining tokens to ranges. Only the word lists and templates are shared.
"""

from __future__ import annotations

from logsieve.functions import words
from logsieve.sources.dims import LABELS, MESSAGES, RULES
from logsieve.sources.samples import TEMPLATES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


LOG = f"""
log AS (
  SELECT event_id AS query_id, ts, user_id,
         replace(replace(([{", ".join(lit(t) for t in TEMPLATES)}])[(event_id % {len(TEMPLATES)}) + 1],
                 '{{u}}', user_id::VARCHAR), '{{e}}', event_id::VARCHAR) AS sql
  FROM events),
texts AS (SELECT sql, min(query_id) AS text_id, count(*) AS uses FROM log GROUP BY sql),
ids AS (SELECT query_id, ts, user_id, text_id FROM log JOIN texts USING (sql))"""

# tokens of the generic dialect, for an engine that has neither possessive repetition nor back references
_WORD = r'[\p{L}_@#][\p{L}\p{N}_$@#]*|"[^"]*"|`[^`]*`'
_TOKEN = "|".join([
    r"--[^\n]*", r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/", r"[eE]'(?:[^'\\]|\\[\s\S]|'')*'", r"'(?:[^']|'')*'",
    rf"(?:{_WORD})(?:[ \t\n]*\.[ \t\n]*(?:{_WORD}))*(?:[ \t\n]*\.[ \t\n]*\*)?",
    r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?",
    r"<=>|->>|<=|>=|<>|!=|==|\|\||::|->|=>|:=", r"[^ \t\r\n\f\x0B]",
])
CLOSING = ["END", "NULL", "TRUE", "FALSE", "CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP"]
OTHER_PARTS = [w for w in words.PART_WORDS if w not in ("DISTINCT", "FROM")]


def _operand_end(u: str, k: str) -> str:
    return (
        f"coalesce({k} IN ('num','str') OR ({k}='path' AND ({u} NOT IN {among(words.RESERVED)} "
        f"OR {u} IN {among(CLOSING)})) OR {u} IN (')', ']'), false)"
    )


def _is_name(u: str, k: str) -> str:
    return f"coalesce({k}='path' AND {u} NOT IN {among(words.RESERVED)}, false)"


def _not_in(u: str, values) -> str:
    return f"coalesce({u} NOT IN {among(values)}, true)"


TOKENS = (
    LOG
    + f""",
lexed AS (
  SELECT text_id,
         len(list_filter(regexp_extract_all(sql, '[A-Za-z0-9_]+'),
             lambda w: lower(w) IN {among(words.CASE_STYLE_WORDS)} AND w <> upper(w))) > 0 AS lower_words,
         list_filter(regexp_extract_all(sql, {lit(_TOKEN)}),
             lambda t: NOT (starts_with(t, '--') OR starts_with(t, '/*'))) AS toks
  FROM texts),
raws AS (
  SELECT text_id, lower_words, unnest(toks) AS raw, generate_subscripts(toks, 1) - 1 AS pos FROM lexed),
tok00 AS (
  SELECT text_id, lower_words, pos, CASE WHEN kind = 'path' THEN regexp_replace(raw, '[ \\t\\n]*\\.[ \\t\\n]*', '.', 'g') ELSE raw END AS tok, kind
  FROM (SELECT *,
    CASE WHEN raw IN ('''', '"', '`') THEN 'bad'
         WHEN raw[1] = '''' OR regexp_matches(raw, '^[eE]''') THEN 'str'
         WHEN raw[1] = '"' OR regexp_matches(raw, '^(?:[\\p{{L}}_@`]|#.)') THEN 'path'
         WHEN regexp_matches(raw, '^\\.?[0-9]') THEN 'num' ELSE 'op' END AS kind
  FROM raws)),
tok01 AS (
  SELECT *, upper(tok) AS up, lag(upper(tok)) OVER w AS bu, lead(upper(tok)) OVER w AS au, lead(kind) OVER w AS ak
  FROM tok00 WINDOW w AS (PARTITION BY text_id ORDER BY pos)),
tok0 AS (
  SELECT text_id, lower_words, pos, tok, kind,
    CASE WHEN kind = 'path' AND up IN {among(words.SOMETIMES_NAMES)} AND coalesce(bu IN {among(words.BEFORE_OPERAND)}, false)
      AND coalesce(au NOT IN ('(', 'BY') AND (ak <> 'path' OR au IN {among(words.RESERVED)}), true) THEN '"' || up || '"' ELSE up END AS u
  FROM tok01),
tok1 AS (
  SELECT *,
    lag(u, 1) OVER w AS p1, lag(kind, 1) OVER w AS k1, lag(tok, 1) OVER w AS pt1,
    lag(u, 2) OVER w AS p2, lag(kind, 2) OVER w AS k2, lag(u, 3) OVER w AS p3,
    lead(u, 1) OVER w AS n1, lead(kind, 1) OVER w AS nk1, lead(tok, 1) OVER w AS nt1,
    lead(u, 2) OVER w AS n2, lead(kind, 2) OVER w AS nk2, lead(tok, 2) OVER w AS nt2, lag(tok, 2) OVER w AS pt2,
    lead(u, 3) OVER w AS n3, lead(tok, 3) OVER w AS nt3, lead(u, 4) OVER w AS n4,
    sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS cum,
    coalesce(sum(CASE WHEN tok = ';' THEN 1 ELSE 0 END)
      OVER (PARTITION BY text_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS stmt
  FROM tok0 WINDOW w AS (PARTITION BY text_id ORDER BY pos)),
tok2 AS (
  SELECT *, tok <> ';' AND coalesce(p1 = ';', true) AS first,
    cum - CASE WHEN tok = '(' THEN 1 ELSE 0 END AS depth FROM tok1),
problems AS (
  SELECT text_id, pos,
    CASE WHEN kind = 'bad' THEN 'unterminated quote'
         WHEN tok = '/' AND nt1 = '*' THEN 'unterminated comment'
         WHEN cum < 0 OR (n1 IS NULL AND cum <> 0) THEN 'unbalanced parenthesis'
         WHEN first AND u NOT IN {among(words.STATEMENT_VERBS)} THEN 'not a statement'
         WHEN (n1 IS NULL OR n1 = ';') AND u IN {among(words.DANGLING)} THEN 'incomplete statement'
    END AS code FROM tok2),
bad_texts AS (SELECT text_id, arg_min(code, pos) AS error FROM problems WHERE code IS NOT NULL GROUP BY text_id),
t AS MATERIALIZED (SELECT * FROM tok2 ANTI JOIN bad_texts USING (text_id)),
stmts AS (
  SELECT *, verb IN ('SELECT', 'WITH', '(') AND coalesce(verb <> 'WITH' OR main IN ('SELECT', 'VALUES', 'TABLE'), true) AS reads
  FROM (SELECT text_id, stmt, arg_min(pos, pos) FILTER (first) AS start_pos, arg_min(u, pos) FILTER (first) AS verb,
      arg_min(u, pos) FILTER (cum = 0 AND kind = 'path' AND NOT first AND u IN {among(words.MAIN_VERBS)}) AS main
    FROM t GROUP BY text_id, stmt) WHERE verb IS NOT NULL),
par AS MATERIALIZED (
  SELECT o.text_id, o.stmt, o.pos AS open_pos, min(c.pos) AS close_pos, any_value(o.depth) AS depth,
    CASE WHEN any_value(o.n1) IN ('SELECT', 'WITH') THEN 'query'
         WHEN any_value(o.k1) = 'path' AND any_value(o.p1) IN {among(words.OPAQUE_CALLS)} THEN 'opaque'
         WHEN any_value(o.k1) = 'path' AND (any_value(o.p1) NOT IN {among(words.RESERVED)}
              OR any_value(o.p1) IN {among(words.FUNCTION_WORDS)}) THEN 'call'
         ELSE 'plain' END AS pk
  FROM t o JOIN t c ON c.text_id = o.text_id AND c.tok = ')' AND c.depth = o.depth AND c.pos > o.pos
  WHERE o.tok = '(' GROUP BY ALL),
around AS (
  SELECT t.text_id, t.pos,
    max(p.open_pos) FILTER (p.pk = 'query' AND p.open_pos < t.pos AND t.pos < p.close_pos) AS query_open,
    coalesce(max(p.open_pos) FILTER (p.pk <> 'plain'), -1) AS call_open,
    coalesce(bool_or(p.pk = 'opaque' AND p.open_pos < t.pos AND t.pos < p.close_pos), false) AS in_opaque
  FROM t LEFT JOIN par p ON p.text_id = t.text_id AND p.open_pos <= t.pos AND t.pos <= p.close_pos
  GROUP BY ALL),
case_level AS (
  SELECT text_id, pos, case_up, case_up > 0 AS in_case FROM (
    SELECT text_id, pos, sum(CASE WHEN u = 'CASE' THEN 1 WHEN u = 'END' AND NOT first THEN -1 ELSE 0 END)
      OVER (PARTITION BY text_id ORDER BY pos) AS case_up FROM t)),
s AS (
  SELECT t.*, a.call_open, a.in_opaque, cl.in_case, cl.case_up, st.verb, st.reads, p.pk, p.close_pos,
    coalesce(a.query_open + 1, st.start_pos) AS scope, q.close_pos AS scope_end,
    coalesce(q.depth + 1, 0) AS bd,
    t.depth = coalesce(q.depth + 1, 0) AS base,
    a.call_open = coalesce(a.query_open, -1) AS same_call,
    t.first OR coalesce(a.query_open + 1 = t.pos, false) AS head,
    CASE WHEN a.query_open IS NULL THEN true ELSE
      coalesce(qt.p1 IN ('UNION', 'INTERSECT', 'EXCEPT', 'MINUS', ';'), true)
      OR (qt.p1 IN ('ALL', 'DISTINCT') AND coalesce(qt.p2 IN ('UNION', 'INTERSECT', 'EXCEPT', 'MINUS'), false))
    END AS query_level
  FROM t JOIN around a USING (text_id, pos) JOIN case_level cl USING (text_id, pos)
  LEFT JOIN stmts st ON st.text_id = t.text_id AND st.stmt = t.stmt
  LEFT JOIN par p ON p.text_id = t.text_id AND p.open_pos = t.pos
  LEFT JOIN par q ON q.text_id = t.text_id AND q.open_pos = a.query_open
  LEFT JOIN t qt ON qt.text_id = t.text_id AND qt.pos = a.query_open),
m AS (
  SELECT *,
    CASE WHEN u = ';' THEN 'END'
         WHEN head AND u = '(' THEN 'SETOP'
         WHEN kind <> 'path' THEN NULL
         WHEN u = 'SELECT' AND base THEN 'SELECT'
         WHEN u = 'WITH' AND head THEN 'WITH'
         WHEN head THEN 'STMT'
         WHEN u IN ('ON', 'USING') AND same_call AND coalesce(p1 <> 'DISTINCT', true) THEN 'ON'
         WHEN u = 'JOIN' AND same_call THEN 'FROM'
         WHEN NOT base THEN NULL
         WHEN u = 'FROM' AND coalesce(p1 <> 'DISTINCT', true) THEN 'FROM'
         WHEN u IN ('GROUP', 'ORDER') AND n1 = 'BY' THEN u
         WHEN u IN ('INNER', 'LEFT', 'RIGHT', 'FULL', 'CROSS', 'NATURAL') AND coalesce(n1 <> '(', true) THEN 'FROM'
         WHEN u IN {among(words.SET_OPERATORS)} THEN 'SETOP'
         WHEN u IN {among(words.OTHER_CLAUSES)} THEN u END AS marker,
    CASE WHEN kind = 'op' AND u IN {among(words.COMPARISONS)} THEN 'cmp'
         WHEN kind = 'op' AND u IN {among(words.ARITHMETIC)} AND {_operand_end("p1", "k1")} THEN 'math'
         WHEN kind = 'op' AND u IN (',', ';') THEN 'part'
         WHEN kind <> 'path' THEN NULL
         WHEN u = 'AND' THEN 'and' WHEN u = 'BETWEEN' THEN 'between'
         WHEN u IN {among(words.OPAQUE_PREDICATES)} THEN 'opaque'
         WHEN u IN {among(OTHER_PARTS)} THEN 'part'
         WHEN u = 'DISTINCT' AND NOT coalesce(p1 = 'IS' OR (p1 = 'NOT' AND p2 = 'IS'), false) THEN 'part'
         WHEN u = 'FROM' AND coalesce(p1 <> 'DISTINCT', true) THEN 'part'
         WHEN u NOT IN {among(words.RESERVED)} AND NOT ends_with(tok, '*') AND {_not_in("n1", ["(", "=>"])}
              AND coalesce(nk1 <> 'str', true)
              AND {_not_in("p1", ["AS", "::", "AT", "FROM", "JOIN", "INTO", "UPDATE", "TABLE"])}
              AND coalesce(p2 <> 'AT', true)
              AND NOT ({_operand_end("p1", "k1")} AND coalesce(p2 <> 'TOP', true)) AND NOT first THEN 'ident'
    END AS role
  FROM s),
c1 AS (
  SELECT *,
    last_value(marker IGNORE NULLS) OVER w AS label,
    max(CASE WHEN marker IS NOT NULL THEN pos END) OVER w AS label_at,
    max(CASE WHEN base AND tok = ',' THEN pos END) OVER w AS comma_at,
    max(CASE WHEN base AND tok = ',' THEN pos END) OVER b AS comma_before,
    max(CASE WHEN marker = 'SELECT' THEN pos END) OVER w AS sel,
    max(CASE WHEN base AND u = 'FROM' AND marker = 'FROM' THEN pos END) OVER w AS from_at,
    first_value(CASE WHEN base AND (marker IS NOT NULL OR tok = ',') THEN u END IGNORE NULLS) OVER a AS after_join,
    sum(CASE WHEN marker = 'SETOP' AND kind = 'path' THEN 1 ELSE 0 END) OVER w AS arm
  FROM m
  WINDOW w AS (PARTITION BY text_id, stmt, scope ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY text_id, stmt, scope ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (PARTITION BY text_id, stmt, scope ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
c2 AS (
  SELECT *,
    CASE WHEN label = 'ON' AND comma_at > label_at THEN 'FROM' ELSE label END AS clause,
    coalesce(role = 'part' OR pk <> 'plain' OR (tok = ')' AND call_closer), false) AS is_part
  FROM (SELECT c1.*, EXISTS (SELECT 1 FROM par WHERE par.text_id = c1.text_id AND par.close_pos = c1.pos
                             AND par.pk <> 'plain') AS call_closer FROM c1)),
c3 AS (
  SELECT *, is_part OR (role = 'and' AND coalesce(prev_mark <> 'between', true)) AS edge
  FROM (SELECT *, last_value(CASE WHEN is_part THEN 'part' WHEN role IN ('and', 'between') THEN role END IGNORE NULLS)
          OVER (PARTITION BY text_id, call_open ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_mark
        FROM c2)),
c4 AS (
  SELECT *,
    coalesce(max(CASE WHEN edge THEN pos END) OVER w, -1) AS seg_from,
    coalesce(min(CASE WHEN edge THEN pos END) OVER a, 1000000000) AS seg_to,
    coalesce(max(CASE WHEN edge OR role = 'cmp' THEN pos END) OVER b, -1) AS lo,
    coalesce(min(CASE WHEN edge OR role = 'cmp' THEN pos END) OVER a, 1000000000) AS hi
  FROM c3
  WINDOW w AS (PARTITION BY text_id, call_open ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY text_id, call_open ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (PARTITION BY text_id, call_open ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
preds AS (SELECT text_id, call_open, pos FROM c4 WHERE role IN ('opaque', 'between')),
own_seg AS (
  SELECT c4.text_id, c4.pos, count(p.pos) > 0 AS seg
  FROM c4 LEFT JOIN preds p ON p.text_id = c4.text_id AND p.call_open = c4.call_open
    AND p.pos >= c4.seg_from AND p.pos < c4.seg_to GROUP BY ALL),
k0 AS (
  SELECT c4.*, CASE WHEN c4.pk <> 'plain' THEN coalesce(before.seg, false) ELSE o.seg END AS seg_opaque,
    CASE WHEN c4.pk = 'query' THEN
      CASE WHEN coalesce(p1 IN ('UNION', 'INTERSECT', 'EXCEPT', 'MINUS', ';'), true) THEN 'set_arm'
           WHEN p1 IN ('ALL', 'DISTINCT') AND p2 IN {among(words.SET_OPERATORS)} THEN 'set_arm'
           WHEN p1 = 'AS' AND clause = 'WITH' THEN 'cte'
           WHEN p1 = 'USING' THEN 'statement_part'
           WHEN p1 = 'EXISTS' THEN 'exists'
           WHEN p1 = 'IN' THEN 'in_subquery'
           WHEN p1 IN ('ANY', 'ALL', 'SOME') THEN 'quantified'
           WHEN clause = 'FROM' THEN 'derived'
           WHEN clause IN ('STMT', 'INTO', 'END') THEN 'statement_part'
           WHEN k1 = 'path' AND (p1 NOT IN {among(words.RESERVED)} OR p1 IN {among(words.FUNCTION_WORDS)})
             THEN 'call_argument'
           ELSE 'scalar' END END AS scope_kind
  FROM c4 JOIN own_seg o USING (text_id, pos)
  LEFT JOIN own_seg before ON before.text_id = c4.text_id AND before.pos = c4.pos - 1),
hidden AS (
  SELECT text_id, pos AS open_pos, close_pos, scope_kind,
    CASE WHEN pk = 'query' THEN NOT (scope_kind = 'set_arm' OR (scope_kind IN ('in_subquery', 'scalar')
           AND clause IN ('SELECT', 'WHERE', 'GROUP', 'HAVING') AND (p1 = 'IN' OR NOT seg_opaque)))
         WHEN pk = 'opaque' THEN true ELSE seg_opaque END AS shut
  FROM k0 WHERE pk IS NOT NULL),
k AS MATERIALIZED (
  SELECT k0.*, k0.reads AND NOT EXISTS (
      SELECT 1 FROM hidden h WHERE h.text_id = k0.text_id AND h.shut AND h.open_pos < k0.pos AND k0.pos < h.close_pos) AS reached,
    k0.reads AND NOT EXISTS (
      SELECT 1 FROM hidden h WHERE h.text_id = k0.text_id AND h.shut AND coalesce(h.scope_kind <> 'derived', true)
        AND h.open_pos < k0.pos AND k0.pos < h.close_pos) AS counted,
    coalesce(clause IN ('SELECT', 'WHERE', 'GROUP', 'HAVING'), false) AS in_linted,
    coalesce(clause IN ('WHERE', 'GROUP', 'HAVING'), false) AS in_filter
  FROM k0)"""
)

#: Operands of comparisons: per comparison the nearest looser token before it, the nearest that is not tighter after it,
#: both at its own level of parentheses and CASE, found by joining comparisons to such tokens.
OPERANDS = f"""
lv AS (
  SELECT *, coalesce(role = 'part' OR u IN {among([")", "CASE", "NOT", *words.SLICE_ENDS])} OR tok = '(' OR (u = 'END' AND NOT first)
      OR (kind = 'path' AND marker = 'FROM' AND u <> 'FROM' AND coalesce(n1 <> '(', true)), false) AS hard,
    depth + (tok IN ('(', ')'))::INT + (u = 'END' AND NOT first)::INT + case_up AS xl
  FROM k),
ands AS (
  SELECT a.text_id, a.pos, arg_max(m.role, m.pos) IS NOT DISTINCT FROM 'between'
      AND NOT arg_max(m.hard, m.pos) AS of_between
  FROM lv a LEFT JOIN lv m ON m.text_id = a.text_id AND m.xl = a.xl AND m.pos < a.pos AND (m.hard OR m.role IN ('and', 'between'))
  WHERE a.role = 'and' GROUP BY ALL),
stops AS (
  SELECT lv.text_id, xl, lv.pos, u, hard OR (role = 'and' AND NOT of_between) AS loose
  FROM lv LEFT JOIN ands USING (text_id, pos) WHERE hard OR role IN ('and', 'cmp', 'opaque', 'between')),
sizes AS (SELECT text_id, max(pos) + 1 AS n_toks FROM k GROUP BY text_id),
ends AS (
  SELECT c.text_id, c.pos, coalesce(max(z.pos) FILTER (z.pos < c.pos AND z.loose), -1) AS lo, min(z.pos) FILTER (z.pos > c.pos) AS hi
  FROM lv c LEFT JOIN stops z ON z.text_id = c.text_id AND z.xl = c.xl WHERE c.role = 'cmp' GROUP BY ALL),
operands AS (
  SELECT e.text_id, e.pos, any_value(lo) AS lo, any_value(hi) AS hi,
    coalesce(list(t.tok ORDER BY t.pos) FILTER (t.pos < e.pos), []) AS lefts,
    coalesce(list(t.tok ORDER BY t.pos) FILTER (t.pos > e.pos), []) AS rights
  FROM ends e JOIN sizes USING (text_id)
  LEFT JOIN t ON t.text_id = e.text_id AND t.pos > e.lo AND t.pos < coalesce(e.hi, n_toks) GROUP BY ALL)"""

_LEFT = lambda u: _not_in(u, words.BINDING_BEFORE)
_RIGHT = lambda u: _not_in(u, words.BINDING_AFTER + words.OPAQUE_PREDICATES)
_END = lambda u: f"({u} IS NULL OR {u} IN {among(words.AFTER_CONDITION)})"
_EXPR = "reached AND in_linted AND NOT seg_opaque"
_SEEN = "reached AND in_linted"
_NAME = "regexp_extract(tok, '([^.\"`]+)[\"`]?$', 1)"
_ALIAS = f"CASE WHEN n1 = 'AS' THEN nt2 WHEN {_is_name('n1', 'nk1')} THEN nt1 END"
_STOPS = "(n1 IS NULL OR n1 = ';' OR (n1 = ')' AND base))"
_SOURCE_WORD = """coalesce(p1 IN ('FROM', 'JOIN', ',', '(', 'LATERAL', 'ONLY') AND NOT (p1 = 'FROM' AND coalesce(p2 = 'DISTINCT', false)), false)"""
IS_TABLE = f"""({_is_name('u', 'kind')} AND {_SOURCE_WORD} AND sel IS NOT NULL AND clause = 'FROM' AND same_call)"""
_AFTER_JOIN = "(p1 = 'JOIN' OR (p1 = 'LATERAL' AND p2 = 'JOIN'))"
_FREE = """(coalesce(p1 IN ('CROSS', 'NATURAL', 'SEMI', 'ANTI', 'ASOF'), false)
  OR coalesce(p1 IN ('INNER', 'LEFT', 'RIGHT', 'FULL') AND p2 = 'NATURAL', false)
  OR coalesce(p1 = 'OUTER' AND p3 = 'NATURAL', false))"""
_AFTER_PAREN = f"""(SELECT {_ALIAS.replace('n1', 'z.n1').replace('nt2', 'z.nt2').replace('nt1', 'z.nt1').replace('nk1', 'z.nk1')}
  FROM t z WHERE z.text_id = k.text_id AND z.pos = k.close_pos)"""


def _rule(rule_id: str, variant: str, where: str, visible: str, pos: str = "pos", p1: str = "NULL", p2: str = "NULL") -> str:
    return (
        f"SELECT text_id, stmt, '{rule_id}' AS rule_id, {variant} AS variant, ({pos})::INT AS pos, "
        f"({visible}) AS visible, {p1} AS p1, {p2} AS p2 FROM k WHERE {where}"
    )


_MATH_SIDE = """EXISTS (SELECT 1 FROM k m WHERE m.text_id = k.text_id AND m.call_open = k.call_open AND m.role = 'math'
    AND m.pos > {a} AND m.pos < {b})
  AND EXISTS (SELECT 1 FROM k i WHERE i.text_id = k.text_id AND i.scope = k.scope AND i.role = 'ident'
    AND NOT i.in_opaque AND i.pos > {a} AND i.pos < {b})"""

RULE_SQL = {
    "L001": _rule("L001", "''", """base AND clause = 'SELECT' AND kind IN ('op', 'path')
        AND ((tok = '*' AND p1 IN ('SELECT', 'DISTINCT', 'ALL', ',')) OR (kind = 'path' AND ends_with(tok, '*')))
        QUALIFY row_number() OVER (PARTITION BY text_id, sel ORDER BY pos) = 1""", "reached", "sel"),
    "L002": "SELECT st.text_id, st.stmt, 'L002' AS rule_id, st.verb AS variant, st.start_pos::INT AS pos, true AS visible, "
            "NULL AS p1, NULL AS p2 FROM stmts st WHERE st.verb IN ('UPDATE', 'DELETE') AND NOT EXISTS "
            "(SELECT 1 FROM k WHERE k.text_id = st.text_id AND k.stmt = st.stmt AND k.marker = 'WHERE' AND k.scope = st.start_pos)",
    "L003": _rule("L003", "''", "u = 'OR' AND kind = 'path' AND in_linted", _EXPR),
    "L004": "SELECT text_id, 0 AS stmt, 'L004' AS rule_id, '' AS variant, 0 AS pos, true AS visible, NULL AS p1, NULL AS p2 "
            "FROM lexed ANTI JOIN bad_texts USING (text_id) WHERE lower_words",
    "L005": _rule("L005", "''", f"""u = 'LIKE' AND kind = 'path' AND coalesce(p1 <> 'NOT', true) AND nk1 = 'str'
        AND nt1[2] = '%' AND {_not_in('n2', words.BINDING_AFTER)}""", _SEEN),
    "L006": _rule("L006", "''", "u = 'DISTINCT' AND kind = 'path' AND p1 = 'SELECT'", "reached"),
    "L007": _rule("L007", "verb", "first AND ((u = 'DROP' AND n1 = 'TABLE') OR u = 'TRUNCATE')", "true"),
    "L008": _rule("L008", "''", "u = 'IN' AND p1 = 'NOT' AND n1 = '(' AND n2 IN ('SELECT', 'WITH')", _SEEN),
    "L009": _rule("L009", "''", f"{IS_TABLE} AND {_AFTER_JOIN} AND base AND ({_ALIAS}) IS NULL AND coalesce(n1 <> '(', true)",
                  "reached", p1=_NAME, p2=f"lower({_NAME}[1])"),
    "L010": _rule("L010", "''", "scope_kind = 'scalar' AND clause <> 'SELECT'", _EXPR),
    "L011": _rule("L011", "''", "u = 'UNION' AND kind = 'path' AND coalesce(n1 <> 'ALL', true)", "reached"),
    "L012": _rule("L012", "'math'", f"role = 'cmp' AND in_filter AND (({_MATH_SIDE.format(a='k.lo', b='k.pos')}) "
                  f"OR ({_MATH_SIDE.format(a='k.pos', b='k.hi')}))", _EXPR)
            + " UNION ALL "
            + _rule("L012", "'call'", """pk = 'call' AND in_filter AND EXISTS (SELECT 1 FROM k i WHERE i.text_id = k.text_id
                AND i.scope = k.scope AND i.role = 'ident' AND NOT i.in_opaque AND i.pos > k.pos AND i.pos < k.close_pos
                AND (k.in_case OR NOT i.in_case))""", _EXPR),
    "L013": _rule("L013", "''", """marker = 'GROUP' AND EXISTS (SELECT 1 FROM t d WHERE d.text_id = k.text_id
        AND d.pos = k.sel + 1 AND d.u = 'DISTINCT')""", "reached", "sel"),
    "L014": _rule("L014", "''", """marker = 'HAVING' AND sel IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c1 g
        WHERE g.text_id = k.text_id AND g.sel = k.sel AND g.marker = 'GROUP')""", "reached", "sel"),
    "L015": _rule("L015", "''", f"""role = 'cmp' AND in_linted AND {_is_name('p1', 'k1')} AND {_is_name('n1', 'nk1')}
        AND pt1 = nt1 AND {_LEFT('p2')} AND {_RIGHT('n2')}""", _EXPR),
    "L016": _rule("L016", "''", f"""u = 'JOIN' AND kind = 'path' AND base AND sel IS NOT NULL AND NOT {_FREE}
        AND coalesce(after_join NOT IN ('ON', 'USING'), true)""", "reached")
            + " UNION ALL "
            + _rule("L016", "''", f"""u = 'ON' AND marker = 'ON' AND base
        AND ((n1 IN ('TRUE', '1') AND {_END('n2')})
          OR EXISTS (SELECT 1 FROM operands o JOIN k c ON c.text_id = o.text_id AND c.pos = o.pos
               LEFT JOIN k z ON z.text_id = o.text_id AND z.pos = o.hi
             WHERE o.text_id = k.text_id AND o.lo = k.pos AND c.u IN ('=', '==') AND len(o.lefts) > 0 AND o.lefts = o.rights
               AND (z.u IS NULL OR z.u IN {among(words.AFTER_CONDITION)})))
        AND NOT coalesce((SELECT arg_max({_FREE.replace('p1', 'j.p1').replace('p2', 'j.p2').replace('p3', 'j.p3')}, j.pos)
          FROM k j WHERE j.text_id = k.text_id AND j.scope = k.scope AND j.base AND j.u = 'JOIN' AND j.pos < k.pos), true)""", "reached"),
    "L017": _rule("L017", "''", """base AND clause = 'ORDER' AND kind = 'num' AND p1 IN ('BY', ',')
        AND NOT coalesce(nk1 = 'op' AND n1 NOT IN (',', ')', ';'), false)
        QUALIFY row_number() OVER (PARTITION BY text_id, stmt, scope, label_at ORDER BY pos) = 1""", "reached AND query_level"),
    "L018": _rule("L018", "''", """base AND tok = ',' AND sel IS NOT NULL AND label IN ('FROM', 'ON')
        QUALIFY row_number() OVER (PARTITION BY text_id, sel ORDER BY pos) = 1""", "reached"),
    "L019": _rule("L019", f"CASE WHEN coalesce({_AFTER_JOIN}, false) THEN 'join' ELSE 'from' END",
                  f"scope_kind = 'derived' AND {_AFTER_PAREN} IS NULL", "reached"),
    "L023": _rule("L023", "''", f"""role = 'cmp' AND u IN ('=', '<>', '!=') AND in_linted
        AND coalesce((n1 = 'NULL' AND {_RIGHT('n2')}) OR (p1 = 'NULL' AND {_LEFT('p2')}), false)""", _EXPR),
    "L024": _rule("L024", "''", "scope_kind = 'scalar' AND clause = 'SELECT'", _EXPR),
    "L025": _rule("L025", "''", """pk = 'plain' AND clause IN ('SELECT', 'WHERE', 'GROUP', 'HAVING', 'ON')
        AND EXISTS (SELECT 1 FROM par q WHERE q.text_id = k.text_id AND q.open_pos = k.pos + 1 AND q.pk = 'plain'
          AND q.close_pos = k.close_pos - 1)""", _EXPR),
    "L026": _rule("L026", "''", f"""{_STOPS} AND sel IS NOT NULL AND query_level AND reads
        AND from_at > sel AND NOT EXISTS (SELECT 1 FROM k l WHERE l.text_id = k.text_id AND l.stmt = k.stmt
          AND l.scope = k.scope AND (l.marker = 'LIMIT' OR (l.marker = 'SETOP' AND l.kind = 'path')))""", "reached", "sel"),
}

# Tables, columns, type families and key columns of the test data.
CATALOG = {
    "region": "r_regionkey:numeric:k r_name:string",
    "nation": "n_nationkey:numeric:k n_name:string n_regionkey:numeric",
    "customer": "c_custkey:numeric:k c_name:string c_nationkey:numeric c_acctbal:numeric c_mktsegment:string",
    "supplier": "s_suppkey:numeric:k s_name:string s_nationkey:numeric s_acctbal:numeric",
    "part": "p_partkey:numeric:k p_name:string p_brand:string p_type:string p_size:numeric p_retailprice:numeric",
    "orders": "o_orderkey:numeric:k o_custkey:numeric o_orderstatus:string o_totalprice:numeric o_orderdate:other o_orderpriority:string",
    "lineitem": "l_orderkey:numeric:k l_partkey:numeric l_suppkey:numeric l_linenumber:numeric l_quantity:numeric l_extendedprice:numeric l_discount:numeric l_tax:numeric l_returnflag:string l_linestatus:string l_shipdate:other",
    "events": "event_id:numeric:k ts:other user_id:numeric event_type:string value:numeric props:string",
    "documents": "doc_id:numeric:k text:string lang:string source:string n_chars:numeric",
    "embeddings": "vec_id:numeric embedding:other label:numeric",
    "pages": "page_id:numeric url:string html:string",
    "benchmark": "item_id:numeric text:string",
    "labels": "doc_id:numeric:k quality:numeric toxic:numeric",
    "conversations": "conv_id:numeric turn:numeric role:string text:string",
}
_CAT_ROWS = [
    (t, *(c.split(":") + ["n"])[:3]) for t, cols in CATALOG.items() for c in cols.split()
]
CATALOG_CTE = "cat(table_name, column_name, type_family, is_indexed) AS (VALUES " + ", ".join(
    f"('{t}', '{c}', '{f}', {str(k == 'k').lower()})" for t, c, f, k in _CAT_ROWS
) + ")"

_OTHER_SIDE = f"""CASE
  WHEN coalesce(n1 IN {among(words.COMPARISONS)}, false) AND {_LEFT('p1')} THEN
    CASE WHEN {_RIGHT('n3')} AND nk2 IN ('num', 'str') THEN nk2 ELSE 'other' END
  WHEN coalesce(p1 IN {among(words.COMPARISONS)}, false) AND {_RIGHT('n1')} THEN
    CASE WHEN {_LEFT('p3')} AND k2 IN ('num', 'str') THEN k2 ELSE 'other' END END"""

TABLE_REFS = f"""
refs AS (
  SELECT text_id, stmt, scope, coalesce(scope_end, 1000000000) AS scope_end, sel, pos, tok,
    CASE WHEN scope_kind = 'derived' THEN 'derived' WHEN depth > bd THEN 'nested'
         WHEN {_AFTER_JOIN} THEN 'join' ELSE 'base' END AS ref_kind,
    CASE WHEN scope_kind IS NULL THEN lower(tok) END AS table_name,
    lower(CASE WHEN scope_kind = 'derived' THEN {_AFTER_PAREN} ELSE {_ALIAS} END) AS alias, counted, reached
  FROM k WHERE {IS_TABLE} OR (scope_kind = 'derived' AND sel IS NOT NULL))"""

COLUMN_REFS = f"""
cols AS (
  SELECT text_id, stmt, scope, sel, pos, tok, clause, in_filter, {_EXPR} AS expr_visible,
    len(string_split(tok, '.')) AS n_parts,
    CASE WHEN contains(tok, '.') THEN string_split(tok, '.')[-2] END AS qualifier,
    lower(string_split(tok, '.')[-1]) AS column_name,
    {_OTHER_SIDE} AS against
  FROM k WHERE role = 'ident' AND in_linted AND sel IS NOT NULL AND NOT in_opaque)"""

NAMES = f"""{CATALOG_CTE},{TABLE_REFS},{COLUMN_REFS},
ctes AS (SELECT text_id, stmt, lower(pt2) AS name FROM k WHERE scope_kind = 'cte'),
usage AS (
  SELECT text_id, stmt, scope, sel, pos, tok, clause, in_filter, expr_visible, lower(qualifier) AS qualifier, qualifier AS shown,
         column_name, against FROM cols WHERE n_parts <= 2
  UNION ALL
  SELECT text_id, stmt, scope, sel, pos, tok, clause, false, reached, lower(string_split(tok, '.')[-2]),
         string_split(tok, '.')[-2], '*', NULL
  FROM k WHERE kind = 'path' AND ends_with(tok, '.*') AND base AND clause = 'SELECT' AND len(string_split(tok, '.')) = 2),
own AS (
  SELECT g.text_id, g.pos, r.pos AS src, r.table_name, r.alias FROM usage g JOIN refs r
  ON r.text_id = g.text_id AND r.sel = g.sel AND (g.qualifier IS NULL OR g.qualifier = r.alias OR g.qualifier = r.table_name)),
outside AS (
  SELECT g.text_id, g.pos, arg_max(r.pos, r.scope) AS src, arg_max(r.table_name, r.scope) AS table_name
  FROM usage g JOIN refs r ON r.text_id = g.text_id AND r.stmt = g.stmt AND r.scope <> g.scope AND r.scope < g.pos
    AND g.pos < r.scope_end AND (g.qualifier = r.alias OR g.qualifier = r.table_name)
  WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.text_id = g.text_id AND own.pos = g.pos)
  GROUP BY ALL),
cand AS (
  SELECT text_id, pos, src, table_name, alias, false AS is_outer FROM own
  UNION ALL SELECT text_id, pos, src, table_name, NULL, true FROM outside),
judged AS (
  SELECT g.text_id, g.stmt, g.pos, any_value(g.tok) AS tok, any_value(g.shown) AS shown, any_value(g.qualifier) AS qualifier,
    any_value(g.column_name) AS column_name, any_value(g.in_filter) AS in_filter, any_value(g.against) AS against,
    any_value(g.expr_visible) AS expr_visible,
    count(d.src) FILTER (NOT d.is_outer) AS n_own, coalesce(bool_or(d.is_outer), false) AS is_outer,
    coalesce(bool_or(d.table_name IN (SELECT table_name FROM cat)), false) AS any_known,
    count(DISTINCT d.src) FILTER (c.table_name IS NOT NULL) AS owners,
    (SELECT count(*) FROM (SELECT d2.table_name AS n FROM cand d2 JOIN cat c2 ON c2.table_name = d2.table_name AND c2.column_name = g.column_name
        WHERE d2.text_id = g.text_id AND d2.pos = g.pos
      UNION SELECT d2.alias FROM cand d2 JOIN cat c2 ON c2.table_name = d2.table_name AND c2.column_name = g.column_name
        WHERE d2.text_id = g.text_id AND d2.pos = g.pos AND d2.alias IS NOT NULL)) AS owner_names,
    string_agg(DISTINCT c.table_name, ', ' ORDER BY c.table_name) AS tables,
    min(c.table_name) AS first_table,
    arg_min(c.type_family, c.table_name) AS family, arg_min(c.is_indexed, c.table_name) AS is_indexed
  FROM usage g LEFT JOIN cand d ON d.text_id = g.text_id AND d.pos = g.pos
  LEFT JOIN cat c ON c.table_name = d.table_name AND c.column_name = g.column_name
  GROUP BY g.text_id, g.stmt, g.pos, g.column_name),
named(text_id, stmt, rule_id, variant, pos, visible, p1, p2, quirk) AS (
  SELECT text_id, stmt, 'L020', 'table', pos::INT, reached, tok, NULL,
    EXISTS (SELECT 1 FROM ctes WHERE ctes.text_id = refs.text_id AND ctes.stmt = refs.stmt AND ctes.name = refs.table_name)
  FROM refs WHERE table_name IS NOT NULL AND table_name NOT IN (SELECT table_name FROM cat)
  UNION ALL
  SELECT text_id, stmt, 'L020', 'alias', pos::INT, expr_visible, shown, NULL, is_outer
  FROM judged WHERE qualifier IS NOT NULL AND n_own = 0
  UNION ALL
  SELECT text_id, stmt, 'L020', 'column', pos::INT, expr_visible AND NOT is_outer, tok, NULL, false
  FROM judged WHERE column_name <> '*' AND any_known AND owners = 0
  UNION ALL
  SELECT text_id, stmt, 'L020', 'ambiguous', pos::INT, expr_visible, tok, tables, owners < 2
  FROM judged WHERE qualifier IS NULL AND owner_names > 1
  UNION ALL
  SELECT text_id, stmt, 'L021', family, pos::INT, expr_visible AND NOT is_outer, tok, NULL, false
  FROM judged WHERE in_filter AND ((family = 'numeric' AND against = 'str') OR (family = 'string' AND against = 'num'))
  UNION ALL
  SELECT text_id, stmt, 'L022', '', pos::INT, expr_visible AND NOT is_outer, column_name, first_table, false
  FROM judged WHERE in_filter AND against IS NOT NULL AND NOT is_indexed
    AND first_table IN (SELECT table_name FROM cat WHERE is_indexed))"""

RULE_DIM = "rule_dim(rule_id, severity, category) AS (VALUES " + ", ".join(
    f"('{r}', '{s}', '{c}')" for r, s, c in RULES
) + ")"
MESSAGE_DIM = "message_dim(rule_id, variant, lang, message_tpl, advice_tpl) AS (VALUES " + ", ".join(
    f"({lit(r)}, {lit(v)}, 'en', {lit(a)}, {lit(b)}), ({lit(r)}, {lit(v)}, 'tr', {lit(c)}, {lit(d)})"
    for r, v, a, b, c, d in MESSAGES
) + ")"
LABEL_DIM = "label_dim(kind, code, lang, label) AS (VALUES " + ", ".join(
    "(" + ", ".join(lit(x) for x in row) + ")" for row in LABELS
) + ")"
FOUND = f"{OPERANDS}, found AS (" + " UNION ALL ".join(f"({q})" for q in RULE_SQL.values()) + ")"


def rule_query(rule_id: str) -> str:
    operands = f", {OPERANDS}" if rule_id == "L016" else ""
    return f"""WITH {TOKENS}{operands}, hits AS ({RULE_SQL[rule_id]})
SELECT ids.query_id, h.stmt, h.variant, h.pos, h.visible FROM ids JOIN hits h USING (text_id)"""


def name_rule_query(rule_id: str) -> str:
    return f"""WITH {TOKENS}, {NAMES}
SELECT ids.query_id, h.stmt, h.variant, h.pos, h.visible, h.p1, h.p2, h.quirk
FROM ids JOIN named h USING (text_id) WHERE h.rule_id = '{rule_id}'"""
