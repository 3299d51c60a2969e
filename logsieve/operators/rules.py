"""Lint rules that need nothing but the token relation: one condition per rule."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import words
from logsieve.operators.tokens import FILTER_CLAUSES, LINTED_CLAUSES, is_query_statement


def last_name(tok: Column) -> Column:
    """Last part of a dotted name, without quotes."""
    parts = F.regexp_extract_all(tok, F.lit(r'[^."`\[\]]+'), F.lit(0))
    return F.element_at(parts, -1)


def _rules() -> list[tuple]:
    """(rule_id, variant, condition, position, visible, p1, p2)."""
    c = F.col
    pos, sel, scope = c("pos"), c("sel"), c("scope")
    hint = lambda h: c("hint") == h
    linted = c("clause").isin(LINTED_CLAUSES)
    filtered = c("clause").isin(FILTER_CLAUSES)
    block = sel.isNotNull()
    since = lambda a, b: F.coalesce(a > b, F.lit(False))
    reached, expr = c("reached"), c("linted_expr")
    always, none = F.lit(True), F.lit(None).cast("string")
    ends = (c("stop") == "end") | ((c("stop") == "close") & c("base"))
    join_ref = (
        (c("src") == "join") & c("pk").isNull() & c("base") & block & c("alias").isNull()
        & ~c("called") & (c("clause") == "FROM")
    )
    name = last_name(c("tok"))
    return [
        ("L001", "", hint("star") & c("base") & (c("clause") == "SELECT") & ~since(c("star_before"), sel),
         sel, reached, none, none),
        ("L002", c("verb"), (c("stop") == "end") & c("verb").isin("UPDATE", "DELETE")
         & ~since(c("where_at"), scope), scope, always, none, none),
        ("L003", "", hint("L003") & linted, pos, expr, none, none),
        ("L004", "", c("lower_words") & (pos == 0) & c("error").isNull(), pos, always, none, none),
        ("L005", "", hint("L005"), pos, c("linted"), none, none),
        ("L006", "", hint("L006"), pos, reached, none, none),
        ("L007", c("verb"), hint("L007"), pos, always, none, none),
        ("L008", "", hint("L008"), pos, c("linted"), none, none),
        ("L009", "", join_ref, pos, reached, name, F.lower(F.substring(name, 1, 1))),
        ("L010", "", (c("scope_kind") == "scalar") & (c("clause") != "SELECT"), pos, expr, none, none),
        ("L011", "", hint("L011"), pos, reached, none, none),
        ("L012", "math", c("math_operand") & filtered, pos, expr, none, none),
        ("L012", "call", c("call_on_ident") & filtered, pos, expr, none, none),
        ("L013", "", (c("marker") == "GROUP") & c("has_distinct"), sel, reached, none, none),
        ("L014", "", (c("marker") == "HAVING") & block & ~since(c("group_at"), sel), sel, reached,
         none, none),
        ("L015", "", hint("L015") & linted, pos, expr, none, none),
        ("L016", "", hint("L016") & c("base") & (c("marker") == "ON") & ~c("free_join"), pos, reached,
         none, none),
        ("L016", "", c("same_sides") & c("u").isin("=", "==") & (c("before_left") == "ON") & c("base")
         & (c("after_right").isNull() | c("after_right").isin(words.AFTER_CONDITION)) & (c("clause") == "ON")
         & ~c("free_join"), c("left_from") - 1, reached, none, none),
        ("L016", "", hint("join") & c("base") & block
         & ~F.coalesce(c("after_join").isin("ON", "USING"), F.lit(False)), pos, reached, none, none),
        ("L017", "", hint("ordinal") & c("base") & (c("clause") == "ORDER")
         & ~since(c("ordinal_before"), c("order_at")), pos, reached & c("query_level"), none, none),
        ("L018", "", c("comma_join") & ~since(c("comma_before"), c("from_at")), pos, reached, none, none),
        ("L019", F.when(c("src") == "join", "join").otherwise("from"),
         (c("scope_kind") == "derived") & c("alias").isNull(), pos, reached, none, none),
        ("L023", "", hint("L023") & linted, pos, expr, none, none),
        ("L024", "", (c("scope_kind") == "scalar") & (c("clause") == "SELECT"), pos, expr, none, none),
        ("L025", "", (c("pk") == "plain") & (c("next_close") == c("close") - 1)
         & c("clause").isin(*LINTED_CLAUSES, "ON"), pos, expr, none, none),
        ("L026", "", ends & block & c("query_level") & is_query_statement()
         & since(c("from_at"), sel) & ~since(c("limit_at"), scope) & ~since(c("setop_at"), scope),
         sel, reached, none, none),
    ]


TOKEN_RULES = [
    "L001", "L002", "L003", "L004", "L005", "L006", "L007", "L008", "L009", "L010", "L011",
    "L012", "L013", "L014", "L015", "L016", "L017", "L018", "L019", "L023", "L024", "L025", "L026",
]


#: What a text must hold, in capitals, for a rule to find anything: patterns that all match. Rules not named here take any text.
NEEDS = {"L009": ["JOIN"], "L013": ["GROUP", "DISTINCT"], "L014": ["HAVING"], "L018": [","]}


def may_find(only: list[str] | None = None) -> Column:
    """Whether a text can hold findings of the rules at all, seen from its characters; no text with findings is left out."""
    if only is None or not set(only) <= set(NEEDS):
        return F.lit(True)
    each = [reduce(and_, [F.upper("sql").rlike(p) for p in NEEDS[rule]]) for rule in only]
    return reduce(or_, each, F.lit(False))


FINDING = "rule_id string, variant string, pos int, visible boolean, p1 string, p2 string, quirk boolean"


def finding(rule_id, variant, pos, visible, p1, p2, quirk) -> Column:
    """``visible``: a walker that skips what it does not descend into reports it too.
    ``quirk``: only such a walker reports it."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(rule_id).alias("rule_id"),
        as_col(variant).alias("variant"),
        as_col(pos).cast("int").alias("pos"),
        as_col(visible).alias("visible"),
        as_col(p1).alias("p1"),
        as_col(p2).alias("p2"),
        as_col(quirk).alias("quirk"),
    )


FINDINGS = f"array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>"


def token_hits(only: list[str] | None = None) -> Column:
    """Array of the findings of the token rules caused by one token.

    Most tokens cause none. They are told apart first, by conditions that Spark compiles; what takes the empty places
    out of an array it interprets.
    """
    rules = [r for r in _rules() if only is None or r[0] in only]
    found = [
        F.when(cond, finding(rule_id, variant, at, visible, p1, p2, False))
        for rule_id, variant, cond, at, visible, p1, p2 in rules
    ]
    some = reduce(or_, [F.coalesce(r[2], F.lit(False)) for r in rules])
    return F.when(some, F.array_compact(F.array(*found))).otherwise(F.array().cast(FINDINGS))


ILL_FORMED = "ill formed"


def ill_formed() -> Column:
    """Array of one finding that is no rule's, on the one row an ill-formed text has."""
    none = F.lit(None).cast("string")
    found = finding(ILL_FORMED, F.col("error"), F.col("pos"), True, none, none, False)
    return F.when(F.col("error").isNotNull(), F.array(found)).otherwise(F.array().cast(FINDINGS))


SUMMARY = "summary"


def kept_rows(rows: DataFrame, wanted: Column, columns: list[str], summary: Column | None = None) -> DataFrame:
    """``columns`` of the wanted token rows. With ``summary``, a finding that is an aggregate over the tokens of a text, each
    text has a row more, at position -1, that holds it among its ``hits``; the tokens are still read once."""
    if summary is None:
        return rows.filter(wanted).select(*columns)
    names = [c for c in columns if c != "text_id"]
    held = F.collect_list(F.when(wanted, F.struct(*names))).alias("held")
    per_text = rows.groupBy("text_id").agg(held, summary.alias("summary"))
    types = {f.name: f.dataType for f in rows.select(*names).schema.fields}
    own = {"stmt": F.lit(-1), "pos": F.lit(-1), "hits": F.array("summary")}
    more = F.struct(*[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])
    return per_text.select("text_id", F.explode(F.concat("held", F.array(more))).alias("r")).select("text_id", *[f"r.{n}" for n in names])


def token_findings(tokens: DataFrame, only: list[str] | None = None, more: Column | None = None,
                   summary: Column | None = None) -> DataFrame:
    """Findings of the token rules, and those in the array ``more``, in one pass over the tokens."""
    found = token_hits(only)
    hits = tokens.withColumn("hits", found if more is None else F.concat(found, more))
    return (
        kept_rows(hits, F.size("hits") > 0, ["text_id", "stmt", "pos", "hits"], summary)
        .select("text_id", F.col("stmt").cast("int").alias("stmt"), F.explode("hits").alias("hit"))
        .select("text_id", "stmt", "hit.*")
    )
