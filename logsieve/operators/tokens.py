"""SQL text as a relation: one row per token, with its place in the statement.

Every column is a window over the tokens of one text. The texts are hash-partitioned by
``text_id`` before the explode and every window partitions by ``text_id`` first, so none needs an
exchange; two are made to cut the step into stages, the rest are sorts inside partitions, which spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions import words
from logsieve.functions.lexing import flat_text, lexemes, token_array, token_kind
from logsieve.functions.memo import per_session
from logsieve.functions.sequences import BASES, same_run, terms

LINTED_CLAUSES = ["SELECT", "WHERE", "GROUP", "HAVING"]
FILTER_CLAUSES = ["WHERE", "GROUP", "HAVING"]
VISIBLE_SCOPES = ["set_arm", "in_subquery", "scalar"]


def _text():
    return W.partitionBy("text_id").orderBy("pos")


def _level():
    return W.partitionBy("text_id", "lvl").orderBy("pos")


def _expression():
    return W.partitionBy("text_id", "xl").orderBy("pos")


def _query():
    return W.partitionBy("text_id", "qd").orderBy("pos")


def _call():
    return W.partitionBy("text_id", "fd").orderBy("pos")


def _upto(w):
    return w.rowsBetween(W.unboundedPreceding, W.currentRow)


def _before(w):
    return w.rowsBetween(W.unboundedPreceding, -1)


def _whole(w):
    return w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def _last(value: Column, over) -> Column:
    return F.last(value, ignorenulls=True).over(over)


def _near(expr: str, func: str, key: str) -> Column:
    """Nearest earlier (lag) or later (lead) non-null value of ``expr`` in the window."""
    return F.expr(f"{func}({expr}, 1) IGNORE NULLS OVER (PARTITION BY text_id, {key} ORDER BY pos)")


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _int(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


@per_session
def operand_end(t: str) -> Column:
    """The token can close an operand, so what follows is an operator or an alias."""
    u, kind = F.col(f"{t}.u"), F.col(f"{t}.kind")
    closing = ["END", "NULL", "TRUE", "FALSE", "CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP"]
    return _flag(
        kind.isin("num", "str")
        | ((kind == "path") & (~u.isin(words.RESERVED) | u.isin(closing)))
        | u.isin(")", "]")
    )


@per_session
def left_free(t: str) -> Column:
    """Nothing before the operand binds it into a longer expression."""
    return ~_flag(F.col(f"{t}.u").isin(words.BINDING_BEFORE))


@per_session
def right_free(t: str) -> Column:
    stops = words.BINDING_AFTER + words.OPAQUE_PREDICATES
    return ~_flag(F.col(f"{t}.u").isin(stops))


@per_session
def ends_condition(t: str) -> Column:
    """The token after a complete join condition."""
    return F.col(f"{t}.u").isNull() | F.col(f"{t}.u").isin(words.AFTER_CONDITION)


@per_session
def _lower_words() -> Column:
    return F.exists(
        F.regexp_extract_all("sql", F.lit("[A-Za-z0-9_]+"), F.lit(0)),
        lambda w: F.lower(w).isin(words.CASE_STYLE_WORDS) & (w != F.upper(w)),
    )


@per_session
def _flat() -> Column:
    return flat_text(F.col("sql"), F.col("dialect"))


@per_session
def _lexemes() -> Column:
    return lexemes(F.col("flat"), F.col("dialect"))


@per_session
def _kept() -> Column:
    return token_array(F.col("found"), F.col("flat"), F.col("dialect"))


@per_session
def _terms() -> list[Column]:
    return terms(F.col("tok"), F.col("pos"))


@per_session
def _same_sides(size: int) -> Column:
    left = [F.col(f"h{i}") - F.coalesce(f"from.h{i}", F.lit(0)) for i in range(size)]
    right = [F.coalesce(f"to.h{i}", f"all{i}") - F.col(f"h{i}") - F.col(f"t{i}") for i in range(size)]
    length = F.col("pos") - F.coalesce("from.pos", F.lit(-1))
    until = F.coalesce("to.pos", "n_toks") - F.col("pos")
    return (length > 1) & (length == until) & same_run(left, right, length)


def explode_tokens(texts: DataFrame) -> DataFrame:
    """One row per token of ``texts(text_id, dialect, sql)``.

    A text without any token keeps one row of kind ``none``.
    """
    return (
        # computed below the explode, so once per text and not once per token
        texts.select("text_id", "dialect", _lower_words().alias("lower_words"), _flat().alias("flat"))
        .select("*", _lexemes().alias("found"))
        .select("text_id", "dialect", "lower_words", _kept().alias("toks"))
        .select("text_id", "dialect", "lower_words", F.posexplode_outer("toks").alias("pos", "raw"))
        .select(
            "text_id",
            "lower_words",
            F.coalesce("pos", F.lit(0)).alias("pos"),
            F.coalesce("raw", F.lit("")).alias("tok"),
            F.when(F.col("raw").isNull(), "none")
            .otherwise(token_kind(F.col("raw"), F.col("dialect")))
            .alias("kind"),
        )
        .withColumn("upper", F.upper("tok"))
        .withColumn("u", F.when(_named_by_place(), F.concat(F.lit('"'), "upper", F.lit('"'))).otherwise(F.col("upper")))
        .drop("upper")
    )


def _named_by_place() -> Column:
    """A reserved word that stands for a name here: an operand is due, and no further name follows."""
    before, after = F.lag("upper").over(_text()), F.lead(F.struct("upper", "kind")).over(_text())
    plain = (after["kind"] == "path") & ~after["upper"].isin(words.RESERVED)
    return _flag(
        (F.col("kind") == "path") & F.col("upper").isin(words.SOMETIMES_NAMES) & before.isin(words.BEFORE_OPERAND)
        & ~_flag(plain | after["upper"].isin("(", "BY"))
    )


@per_session
def _roles() -> Column:
    """What part the token plays in an expression, from its neighbours alone."""
    u, p1, p2, n1 = F.col("u"), F.col("p1.u"), F.col("p2.u"), F.col("n1.u")
    path, op = F.col("kind") == "path", F.col("kind") == "op"
    ident = (
        ~u.isin(words.RESERVED)
        & ~F.col("tok").endswith("*")
        & ~_flag(n1.isin("(", "=>"))
        & ~_flag(F.col("n1.kind") == "str")
        & ~_flag(p1.isin("AS", "::", "AT", "FROM", "JOIN", "INTO", "UPDATE", "TABLE"))
        & ~_flag(p2 == "AT")
        & ~(operand_end("p1") & ~_flag(p2 == "TOP"))
        & ~F.col("first")
    )
    null_safe = _flag((p1 == "IS") | ((p1 == "NOT") & (p2 == "IS")))
    part = ((u == "DISTINCT") & ~null_safe) | ((u == "FROM") & ~_flag(p1 == "DISTINCT"))
    other_parts = [w for w in words.PART_WORDS if w not in ("DISTINCT", "FROM")]
    return (
        F.when(op & u.isin(words.COMPARISONS), "cmp")
        .when(op & u.isin(words.ARITHMETIC) & operand_end("p1"), "math")
        .when(op & u.isin(",", ";"), "part")
        .when(path & (u == "AND"), "and")
        .when(path & (u == "BETWEEN"), "between")
        .when(path & u.isin(words.OPAQUE_PREDICATES), "opaque")
        .when(path & (part | u.isin(other_parts)), "part")
        .when(path & ident, "ident")
    )


@per_session
def _words() -> Column:
    """Clause label the token would start, if it turns out to stand at the level of its query."""
    u, p1, n1 = F.col("u"), F.col("p1.u"), F.col("n1.u")
    open_next = _flag(n1 == "(")
    label = (
        F.when(u == "SELECT", "SELECT")
        .when(F.col("head").isNotNull() & (u == "WITH"), "WITH")
        .when(F.col("head").isNotNull() & (u == "("), "SETOP")
        .when(F.col("head").isNotNull(), "STMT")
        .when((u == "FROM") & ~_flag(p1 == "DISTINCT"), "FROM")
        .when(u.isin("GROUP", "ORDER"), F.when(n1 == "BY", u))
        .when(u.isin("ON", "USING"), F.when(~_flag(p1 == "DISTINCT"), "ON"))
        .when(u == "JOIN", "JOIN")
        .when(u.isin("INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL") & ~open_next, "SIDE")
        .when(u.isin(words.SET_OPERATORS), "SETOP")
        .when(u.isin(words.OTHER_CLAUSES), u)
    )
    return F.when(u == ";", "END").when((F.col("kind") == "path") | (u == "("), label)


@per_session
def _hints() -> Column:
    """Finding the token would cause, as far as its neighbours can tell."""
    u, p1, p2, n1, n2 = (F.col(c) for c in ("u", "p1.u", "p2.u", "n1.u", "n2.u"))
    path, cmp_op = F.col("kind") == "path", F.col("role") == "cmp"
    dotted = lambda t: (F.col(f"{t}.kind") == "path") & ~F.col(f"{t}.u").isin(words.RESERVED)
    exempt_join = (
        p1.isin("CROSS", "NATURAL", "SEMI", "ANTI", "ASOF")
        | (p1.isin("INNER", "LEFT", "RIGHT", "FULL") & (p2 == "NATURAL"))
        | ((p1 == "OUTER") & (F.col("p3.u") == "NATURAL"))
    )
    always_true = n1.isin("TRUE", "1") & ends_condition("n2")
    on_path = (
        F.when(u == "OR", "L003")
        .when(u == "LIKE", F.when(
            ~_flag(p1 == "NOT") & (F.col("n1.kind") == "str") & (F.substring("n1.tok", 2, 1) == "%")
            & ~_flag(n2.isin(words.BINDING_AFTER)), "L005"))
        .when(u == "DISTINCT", F.when(p1 == "SELECT", "L006"))
        .when(F.col("first") & (u == "DROP"), F.when(n1 == "TABLE", "L007"))
        .when(F.col("first") & (u == "TRUNCATE"), "L007")
        .when(u == "IN", F.when((p1 == "NOT") & (n1 == "(") & n2.isin("SELECT", "WITH"), "L008"))
        .when(u == "UNION", F.when(~_flag(n1 == "ALL"), "L011"))
        .when(u == "ON", F.when(always_true, "L016"))
        .when(u == "JOIN", F.when(_flag(exempt_join), "free_join").otherwise("join"))
    )
    null_side = ((n1 == "NULL") & right_free("n2")) | ((p1 == "NULL") & left_free("p2"))
    self_compare = (
        dotted("p1") & dotted("n1") & (F.col("p1.tok") == F.col("n1.tok"))
        & left_free("p2") & right_free("n2")
    )
    on_cmp = F.when(u.isin("=", "<>", "!=") & null_side, "L023").when(self_compare, "L015")
    bare_star = (u == "*") & _flag(p1.isin("SELECT", "DISTINCT", "ALL", ","))
    ordinal = _flag(p1.isin("BY", ",")) & ~_flag(
        (F.col("n1.kind") == "op") & ~n1.isin(",", ")", ";")
    )
    return (
        F.when(cmp_op, on_cmp)
        .when(F.col("kind") == "num", F.when(ordinal, "ordinal"))
        .when(bare_star | (path & F.col("tok").endswith("*")), "star")
        .when(path, on_path)
    )


@per_session
def _fact_columns() -> tuple[dict, dict]:
    """Everything the neighbouring tokens say, so the neighbours need not be carried along."""
    u, p1, p2, n1 = F.col("u"), F.col("p1.u"), F.col("p2.u"), F.col("n1.u")
    p1_path = F.col("p1.kind") == "path"
    after_set = p1.isNull() | p1.isin(*words.SET_OPERATORS, ";")
    after_set_word = p1.isin("ALL", "DISTINCT") & p2.isin(words.SET_OPERATORS)
    before_arm = (
        p2.isNull()
        | p2.isin(*words.SET_OPERATORS, ";")
        | (p2.isin("ALL", "DISTINCT") & F.col("p3.u").isin(words.SET_OPERATORS))
    )
    head = F.when(F.col("first"), "top").when(
        (p1 == "(") & (F.col("kind") == "path") & u.isin("SELECT", "WITH"),
        F.when(_flag(before_arm), "arm").otherwise("nested"),
    )
    callable_ = p1_path & (~p1.isin(words.RESERVED) | p1.isin(words.FUNCTION_WORDS))
    paren = (
        F.when(_flag(n1.isin("SELECT", "WITH")), "query")
        .when(_flag(p1_path & p1.isin(words.OPAQUE_CALLS)), "opaque")
        .when(_flag(callable_), "call")
        .otherwise("plain")
    )
    use = (
        F.when(_flag(after_set | after_set_word), "set_arm")
        .when(p1 == "AS", "as")
        .when(p1 == "USING", "statement_part")
        .when(p1 == "EXISTS", "exists")
        .when(p1 == "IN", "in_subquery")
        .when(p1.isin("ANY", "ALL", "SOME"), "quantified")
        .when(_flag(callable_), "call_argument")
        .otherwise("scalar")
    )
    plain_name = lambda t: (F.col(f"{t}.kind") == "path") & ~F.col(f"{t}.u").isin(words.RESERVED)
    alias = F.when(n1 == "AS", F.col("n2.tok")).when(plain_name("n1"), F.col("n1.tok"))
    from_word = _flag(
        (p1.isin("FROM", "JOIN", ",", "(", "LATERAL", "ONLY"))
        & ~((p1 == "FROM") & _flag(p2 == "DISTINCT"))
    )
    source = F.when(
        (F.col("kind") == "path") & ~u.isin(words.RESERVED) & from_word,
        F.when(_flag((p1 == "JOIN") | ((p1 == "LATERAL") & (p2 == "JOIN"))), "join").otherwise("base"),
    )
    derived = F.when(_flag((p1 == "JOIN") | ((p1 == "LATERAL") & (p2 == "JOIN"))), "join").otherwise("base")
    literal = lambda t: F.when(F.col(f"{t}.kind").isin("num", "str"), F.col(f"{t}.kind"))
    is_cmp = lambda t: F.col(f"{t}.u").isin(words.COMPARISONS)
    against = F.when(
        _flag(is_cmp("n1")) & left_free("p1"),
        F.coalesce(F.when(right_free("n3"), literal("n2")), F.lit("other")),
    ).when(
        _flag(is_cmp("p1")) & right_free("n1"),
        F.coalesce(F.when(left_free("p3"), literal("p2")), F.lit("other")),
    )
    glued = p1.isNull() | (p1.isin("(", "::")) | u.isin(",", ")", ";", "::") | (
        (u == "(") & _flag(callable_ | (p1_path & p1.isin(words.CALL_PRINTED)))
    )
    is_open, is_close = F.col("tok") == "(", F.col("tok") == ")"
    return {"head": head, "role": _roles()}, {
        "word": _words(),
        "hint": _hints(),
        "pk": F.when(is_open, paren),
        "use": F.when(is_open, use),
        "src": F.when(is_open, derived).otherwise(source),
        "alias": F.when(is_close | source.isNotNull(), alias),
        "called": source.isNotNull() & _flag(n1 == "("),
        "against": F.when(F.col("role") == "ident", against),
        "stop": F.when(n1.isNull() | (n1 == ";"), "end").when(n1 == ")", "close"),
        "distinct_next": _flag(n1 == "DISTINCT"),
        "cte_name": F.when(is_open & (p1 == "AS"), F.col("p2.tok")),
        "in_next": is_open & _flag(p1 == "IN"),
        "glued": glued,
        "prev_u": p1,
        "next_u": n1,
    }


def screen(tokens: DataFrame) -> DataFrame:
    """Neighbour facts, parenthesis depth, statement number, and the well-formedness check.

    A text that fails keeps only its first row, emptied, with ``error`` set.
    """
    here = F.struct("u", "kind", "tok")
    near = tokens.select(
        "*",
        *[F.lag(here, i).over(_text()).alias(f"p{i}") for i in (1, 2, 3)],
        *[F.lead(here, i).over(_text()).alias(f"n{i}") for i in (1, 2, 3)],
        F.sum(F.when(F.col("tok") == "(", 1).when(F.col("tok") == ")", -1).otherwise(0))
        .over(_upto(_text()))
        .alias("cum"),
        F.coalesce(F.sum(_int(F.col("tok") == ";")).over(_before(_text())), F.lit(0)).alias("stmt"),
    ).withColumn(
        "first",
        (F.col("tok") != ";")
        & (F.col("kind") != "none")
        & (F.col("p1.u").isNull() | (F.col("p1.u") == ";")),
    )
    last = F.col("n1.u").isNull()
    problem = (
        F.when(F.col("kind") == "bad", "unterminated quote")
        .when(F.col("tok").startswith("/*"), "unterminated comment")
        .when((F.col("cum") < 0) | (last & (F.col("cum") != 0)), "unbalanced parenthesis")
        .when(F.col("first") & ~F.col("u").isin(words.STATEMENT_VERBS), "not a statement")
        .when(
            (last | (F.col("n1.u") == ";")) & F.col("u").isin(words.DANGLING),
            "incomplete statement",
        )
    )
    own, derived = _fact_columns()
    facts = (
        near.withColumn("problem", problem)
        .withColumns(own)
        .withColumns(derived)
        .drop("p1", "p2", "p3", "n1", "n2", "n3")
    )
    main_verbs = ", ".join(f"'{w}'" for w in words.MAIN_VERBS)
    after_list = F.expr(
        f"lead(CASE WHEN cum = 0 AND kind = 'path' AND u IN ({main_verbs}) THEN u END, 1) "
        "IGNORE NULLS OVER (PARTITION BY text_id ORDER BY pos)"
    )
    checked = facts.withColumn("main", F.when(F.col("first") & (F.col("u") == "WITH"), after_list)).withColumns(
        {
            "error": F.min(
                F.when(F.col("problem").isNotNull(), F.struct("pos", F.col("problem").alias("code")))
            )
            .over(_whole(_text()))
            .getField("code"),
            "verb": _last(F.when(F.col("first"), F.col("u")), _upto(_text())),
            "does": _last(F.when(F.col("first"), F.coalesce("main", "u")), _upto(_text())),
        }
    ).filter(F.col("error").isNull() | (F.col("pos") == 0))
    failed = F.col("error").isNotNull()
    empty = {"tok": F.lit(""), "u": F.lit(""), "kind": F.lit("none"), "stmt": F.lit(0).cast("bigint"),
             "cum": F.lit(0).cast("bigint"), "first": F.lit(False), "glued": F.lit(True),
             "called": F.lit(False), "in_next": F.lit(False), "distinct_next": F.lit(False)}
    cleared = ["head", "role", "word", "hint", "pk", "use", "src", "alias", "against", "stop",
               "cte_name", "prev_u", "next_u", "verb", "does"]
    return checked.select(
        "text_id",
        "pos",
        "lower_words",
        "error",
        *[F.when(failed, v).otherwise(F.col(c)).alias(c) for c, v in empty.items()],
        *[F.when(~failed, F.col(c)).alias(c) for c in cleared],
    ).withColumn("depth", F.col("cum") - _int(F.col("tok") == "("))


def match_parentheses(tokens: DataFrame) -> DataFrame:
    """Where each parenthesis closes, and how deep in queries and calls each token is.

    Both parentheses of a pair count as outside it for ``qd`` (query nesting) and as inside it
    for ``fd`` (call nesting), so each nesting key sees its groups bracketed the way it needs.
    """
    is_open, is_close = F.col("pk").isNotNull(), F.col("tok") == ")"
    matched = (
        tokens.withColumn("lvl", F.col("depth") + _int(is_open | is_close))
        .withColumns(
            {
                "shut": F.when(
                    is_open,
                    _near("CASE WHEN tok = ')' THEN struct(pos, alias) END", "lead", "lvl"),
                ),
                "opk": F.when(is_close, _last(F.col("pk"), _upto(_level()))),
            }
        )
        .withColumns(
            {
                "close": F.col("shut.pos"),
                "alias": F.when(is_open, F.col("shut.alias")).otherwise(F.col("alias")),
            }
        )
        .drop("lvl", "shut")
    )
    q_open, q_shut = _flag(F.col("pk") == "query"), _flag(F.col("opk") == "query")
    f_open, f_shut = _flag(F.col("pk") != "plain"), _flag(F.col("opk") != "plain")
    step = lambda o, c: F.when(o, 1).when(c, -1).otherwise(0)
    opens_case, ends_case = F.col("u") == "CASE", (F.col("u") == "END") & ~F.col("first")
    return matched.withColumns(
        {
            "qd": F.sum(step(q_open, q_shut)).over(_upto(_text())) - _int(q_open),
            "fd": F.sum(step(f_open, f_shut)).over(_upto(_text())) + _int(f_shut),
            "in_opaque": _flag(
                F.max(F.when(F.col("pk") == "opaque", F.col("close"))).over(_before(_text()))
                > F.col("pos")
            ),
            "in_case": F.sum(step(opens_case, ends_case)).over(_upto(_text())) > 0,
            "xl": F.col("depth") + _int(is_open | is_close) + _int(ends_case)
            + F.sum(step(opens_case, ends_case)).over(_upto(_text())),
            "next_close": F.lead(F.when(F.col("pk") == "plain", F.col("close")), 1).over(_text()),
            "prev_close": F.lag(F.when(F.col("pk") == "query", F.col("close")), 1).over(_text()),
        }
    )


@per_session
def _clause_columns() -> list[dict]:
    """The columns of ``label_clauses``, layer by layer."""
    head = F.struct(
        F.col("pos").alias("scope"),
        F.col("depth").alias("bd"),
        F.col("fd").alias("bfd"),
        F.col("prev_close").alias("scope_end"),
        (F.col("head") != "nested").alias("query_level"),
    )
    place = {
        "scope": F.col("h.scope"),
        "scope_end": F.col("h.scope_end"),
        "bd": F.col("h.bd"),
        "query_level": _flag(F.col("h.query_level")),
        "base": _flag(F.col("depth") == F.col("h.bd")),
        "same_call": _flag(F.col("fd") == F.col("h.bfd")),
    }
    word, base = F.col("word"), F.col("base")
    stands = (
        F.when(word.isin("ON", "JOIN"), F.col("same_call"))
        .when(word == "END", F.col("qd") == 0)
        .otherwise(base)
    )
    label = F.when(word.isin("JOIN", "SIDE"), "FROM").otherwise(word)
    at = lambda c: F.when(c, F.col("pos"))
    is_comma = base & (F.col("tok") == ",")
    setop = base & (word == "SETOP") & (F.col("kind") == "path")
    countable = (F.col("role") == "ident") & ~F.col("in_opaque")
    upto, before, whole = _upto(_query()), _before(_query()), _whole(_query())
    sum0 = lambda c: F.coalesce(F.sum(_int(c)).over(before), F.lit(0))
    mark = F.struct(F.col("marker").alias("label"), "pos")
    block = F.struct(
        at(F.col("marker") == "SELECT").alias("sel"),
        (F.col("distinct_next") & (F.col("marker") == "SELECT")).alias("dist"),
    )
    marks = {
        "m": _last(F.when(F.col("marker").isNotNull(), mark), upto),
        "comma_at": _last(at(is_comma), upto),
        "comma_before": _last(at(is_comma), before),
        "block": _last(
            F.when(F.col("head").isNotNull() | (F.col("marker") == "SELECT"), block), upto
        ),
        "from_at": _last(at(base & (word == "FROM")), upto),
        "where_at": _last(at(F.col("marker") == "WHERE"), upto),
        "group_at": _last(at(F.col("marker") == "GROUP"), upto),
        "order_at": _last(at(F.col("marker") == "ORDER"), upto),
        "limit_at": _last(at(F.col("marker") == "LIMIT"), upto),
        "setop_at": _last(at(setop), upto),
        "nset": F.sum(_int(setop)).over(upto),
        "star_before": _last(at(base & (F.col("hint") == "star")), before),
        "ordinal_before": _last(at(base & (F.col("hint") == "ordinal")), before),
        "free_join": _last(
            F.when(base & F.col("hint").isin("join", "free_join"), F.col("hint") == "free_join"), upto
        ),
        "after_join": _near(
            "CASE WHEN base AND (marker IS NOT NULL OR tok = ',') THEN u END", "lead", "qd"
        ),
        "ids": sum0(countable),
        "ids_plain": sum0(countable & ~F.col("in_case")),
        "ids_total": F.sum(_int(countable)).over(whole),
    }
    moved_on = (F.col("m.label") == "ON") & _flag(F.col("comma_at") > F.col("m.pos"))
    labels = {
        "clause": F.when(moved_on, "FROM").otherwise(F.col("m.label")),
        "sel": F.col("block.sel"),
        "has_distinct": _flag(F.col("block.dist")),
        "comma_join": is_comma
        & F.col("block.sel").isNotNull()
        & _flag(F.col("m.label").isin("FROM", "ON")),
        "arm": F.col("nset") - _last(F.when(F.col("head").isNotNull(), F.col("nset")), upto),
    }
    headed = {"h": _last(F.when(F.col("head").isNotNull(), head), upto)}
    return [headed, place, {"marker": F.when(stands, label)}, marks, labels]


def label_clauses(tokens: DataFrame) -> DataFrame:
    """Query scope, SELECT block, set-operation arm and clause of each token."""
    for layer in _clause_columns():
        tokens = tokens.withColumns(layer)
    return tokens.drop("h", "m", "block", "nset")


def cut_operands(tokens: DataFrame) -> DataFrame:
    """Operand contents around comparisons and calls, by differences of running counts.

    Inside one call level the tokens between two boundary words form one operand; the number of
    identifiers or operators in it is the difference of a running count at both ends.
    """
    role = F.col("role")
    part = (
        _flag(role == "part") | _flag(F.col("pk") != "plain") | _flag(F.col("opk") != "plain")
    )
    sum0 = lambda c: F.coalesce(F.sum(_int(c)).over(_before(_call())), F.lit(0))
    predicate = role.isin("opaque", "between")
    counted = tokens.withColumn("part", part).withColumns(
        {
            "between_open": _flag(
                _last(
                    F.when(F.col("part") | role.isin("and", "between"), role == "between"),
                    _before(_call()),
                )
            ),
            "maths": sum0(role == "math"),
            "maths_total": F.sum(_int(role == "math")).over(_whole(_call())),
            "opaques": sum0(predicate),
            "opaques_total": F.sum(_int(predicate)).over(_whole(_call())),
        }
    )
    edge = F.col("part") | (_flag(role == "and") & ~F.col("between_open"))
    edge_counts = "CASE WHEN edge OR role = 'cmp' THEN struct(maths, ids) END"
    around = counted.withColumn("edge", edge).withColumns(
        {
            "lo": _near(edge_counts, "lag", "fd"),
            "hi": _near(edge_counts, "lead", "fd"),
            "seg_lo": _last(F.when(F.col("edge"), F.col("opaques")), _upto(_call())),
            "seg_hi": _near("CASE WHEN edge THEN opaques END", "lead", "fd"),
            "args": _near(
                "CASE WHEN opk IS NOT NULL AND opk <> 'plain' THEN struct(ids, ids_plain) END",
                "lead",
                "fd",
            ),
        }
    )
    zero = F.lit(0)
    left_math = (F.col("maths") > F.coalesce(F.col("lo.maths"), zero)) & (
        F.col("ids") > F.coalesce(F.col("lo.ids"), zero)
    )
    right_math = (F.coalesce(F.col("hi.maths"), F.col("maths_total")) > F.col("maths")) & (
        F.coalesce(F.col("hi.ids"), F.col("ids_total")) > F.col("ids")
    )
    call_ids = F.when(F.col("in_case"), F.col("args.ids") - F.col("ids")).otherwise(
        F.col("args.ids_plain") - F.col("ids_plain")
    )
    return around.withColumns(
        {
            "math_operand": _flag(role == "cmp") & (left_math | right_math),
            "call_on_ident": _flag((F.col("pk") == "call") & (call_ids > 0)),
            "seg_opaque": F.coalesce(F.col("seg_hi"), F.col("opaques_total"))
            > F.coalesce(F.col("seg_lo"), zero),
        }
    ).drop("part", "edge", "between_open", "maths", "maths_total", "opaques", "opaques_total",
           "lo", "hi", "seg_lo", "seg_hi", "args", "ids", "ids_plain", "ids_total")


def slice_operands(tokens: DataFrame) -> DataFrame:
    """Where the two operands of each comparison begin and end, and whether they are the same tokens.

    An expression level is what stands between two parentheses or between CASE and END; whatever is deeper belongs
    to an operand as a whole. The left operand reaches back to the nearest looser operator (NOT, AND, OR, or
    a word that begins another part), the right one on to the nearest that is not tighter.
    """
    u, role = F.col("u"), F.col("role")
    bracket = F.col("pk").isNotNull() | u.isin(")", "CASE") | ((u == "END") & ~F.col("first"))
    hard = _flag(bracket | (role == "part") | (F.col("word") == "SIDE") | u.isin("NOT", *words.SLICE_ENDS))
    runs = range(len(BASES))
    level = tokens.withColumns({"hard": hard} | {f"t{i}": t for i, t in enumerate(_terms())}).withColumns(
        {f"h{i}": F.coalesce(F.sum(f"t{i}").over(_before(_text())), F.lit(0)) for i in runs}
        | {f"all{i}": F.sum(f"t{i}").over(_whole(_text())) for i in runs}
        | {"n_toks": F.count("*").over(_whole(_text()))}
    )
    of_between = _flag(_last(F.when(F.col("hard") | role.isin("and", "between"), role == "between"), _before(_expression())))
    loose = F.col("hard") | (_flag(role == "and") & ~F.col("of_between"))
    ends = "hard OR role IN ('and', 'cmp', 'opaque', 'between')"
    sums = ", ".join(f"h{i}" for i in range(len(BASES)))
    edged = level.withColumn("of_between", of_between).withColumn("loose", loose).withColumns(
        {
            "from": _last(F.when(F.col("loose"), F.struct("pos", "u", *[(F.col(f"h{i}") + F.col(f"t{i}")).alias(f"h{i}") for i in range(len(BASES))])), _before(_expression())),
            "to": F.expr(f"lead(CASE WHEN {ends} THEN struct(pos, u, {sums}) END, 1) IGNORE NULLS OVER (PARTITION BY text_id, xl ORDER BY pos)"),
        }
    )
    begins, stops = F.coalesce("from.pos", F.lit(-1)), F.coalesce("to.pos", "n_toks")
    cmp_only = lambda c: F.when(role == "cmp", c)
    return edged.withColumns(
        {
            "same_sides": _flag(cmp_only(_same_sides(len(BASES)))),
            "left_from": cmp_only(begins + 1),
            "right_to": cmp_only(stops - 1),
            "before_left": cmp_only(F.col("from.u")),
            "after_right": cmp_only(F.col("to.u")),
        }
    ).drop("hard", "of_between", "loose", "from", "to", "xl", "n_toks",
           *[f"{c}{i}" for c in ("h", "t", "all") for i in range(len(BASES))])


@per_session
def is_query_statement() -> Column:
    """The statement only reads; a WITH list may also lead to one that writes."""
    return _flag(F.col("does").isin("SELECT", "WITH", "(", "VALUES", "TABLE") & F.col("verb").isin("SELECT", "WITH", "("))


@per_session
def scope_kind() -> Column:
    """What a query in parentheses is used as, from the words before it and its clause."""
    use, clause = F.col("use"), F.col("clause")
    kind = (
        F.when(use == "set_arm", "set_arm")
        .when((use == "as") & _flag(clause == "WITH"), "cte")
        .when(use.isin("exists", "in_subquery", "quantified", "statement_part"), use)
        .when(_flag(clause == "FROM"), "derived")
        .when(_flag(clause.isin("STMT", "INTO", "END")), "statement_part")
        .when(use == "call_argument", use)
        .otherwise("scalar")
    )
    return F.when(F.col("pk") == "query", kind)


def mark_visibility(tokens: DataFrame) -> DataFrame:
    """Which tokens the recursion of a tree walker would reach (and which it would count).

    A token is hidden when a parenthesis whose inside is never visited opened before it and
    closes after it, i.e. when the running maximum of their closing positions is beyond it.
    """
    # a parenthesis that opens a call is keyed inside it; its segment is the one just before
    outer_segment = F.when(
        _flag(F.col("pk") != "plain"), F.coalesce(F.lag("seg_opaque", 1).over(_text()), F.lit(False))
    ).otherwise(F.col("seg_opaque"))
    tokens = tokens.withColumn("seg_opaque", outer_segment)
    query = F.col("pk") == "query"
    linted = _flag(F.col("clause").isin(LINTED_CLAUSES))
    hidden_segment = F.col("seg_opaque") & ~F.col("in_next")
    expression_query = F.col("scope_kind").isin("in_subquery", "scalar") & linted & ~hidden_segment
    seen_query = (F.col("scope_kind") == "set_arm") | expression_query
    closes = lambda shut_query: F.when(
        F.when(query, shut_query)
        .when(F.col("pk") == "opaque", F.lit(True))
        .otherwise(F.col("seg_opaque") & F.col("pk").isNotNull()),
        F.col("close"),
    )
    uncounted_query = ~seen_query & (F.col("scope_kind") != "derived")
    is_query = is_query_statement()
    inside = lambda c: _flag(F.max(c).over(_before(_text())) > F.col("pos"))
    headed = F.col("head").isNotNull()
    return (
        tokens.withColumn("scope_kind", scope_kind())
        .withColumns(
            {
                "reached": is_query & ~inside(closes(~seen_query)),
                "counted": is_query & ~inside(closes(uncounted_query)),
                "parent_sel": F.when(headed, F.lag("sel", 1).over(_text())),
                "own_kind": F.when(
                    headed,
                    F.when(F.col("first"), "top").otherwise(F.lag("scope_kind", 1).over(_text())),
                ),
            }
        )
        .withColumn("linted", F.col("reached") & linted)
        .withColumn("linted_expr", F.col("linted") & ~F.col("seg_opaque"))
    )


def annotate(texts: DataFrame, partitions: int | None = None) -> DataFrame:
    """All token columns for distinct texts; unused ones are pruned by the optimizer."""
    n = partitions or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matched = match_parentheses(screen(explode_tokens(texts.repartition(n, "text_id"))))
    # stages of their own: a worker keeps 100 generated classes, and where one stage needs more, each task
    # compiles all of them anew and runs cold code. Spark drops an exchange into as many parts as there are
    operands = cut_operands(label_clauses(matched.repartition(n + 1, "text_id")))
    return mark_visibility(slice_operands(operands.repartition(n, "text_id")))
