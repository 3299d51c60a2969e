"""Relations read off the tokens: table references, column references, comparisons, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import words
from logsieve.operators.tokens import LINTED_CLAUSES


def name_parts(tok: Column) -> Column:
    """Parts of a dotted name, quotes removed."""
    return F.regexp_extract_all(tok, F.lit(r'[^."`\[\]]+'), F.lit(0))


def bare_lower(tok: Column) -> Column:
    """A name as it is looked up: quotes removed, lower case."""
    return F.lower(F.regexp_replace(tok, r'["`\[\]]', ""))


def is_table() -> Column:
    return (
        F.col("src").isNotNull()
        & F.col("pk").isNull()
        & F.col("sel").isNotNull()
        & (F.col("clause") == "FROM")
        & F.col("same_call")
    )


def is_column() -> Column:
    return (
        (F.col("role") == "ident")
        & F.col("sel").isNotNull()
        & F.col("clause").isin(LINTED_CLAUSES)
        & ~F.col("in_opaque")
    )


def table_refs(tokens: DataFrame) -> DataFrame:
    """Tables and derived tables in FROM: base, join, nested (in parentheses) or derived."""
    derived = F.coalesce(F.col("scope_kind") == "derived", F.lit(False)) & F.col("sel").isNotNull()
    kind = (
        F.when(derived, "derived").when(F.col("depth") > F.col("bd"), "nested").otherwise(F.col("src"))
    )
    return tokens.filter(is_table() | derived).select(
        "text_id",
        F.col("stmt").cast("int").alias("stmt"),
        "scope",
        "scope_end",
        "sel",
        "pos",
        bare_lower(F.col("alias")).alias("alias"),
        F.when(~derived, F.lower("tok")).alias("table_name"),
        kind.alias("ref_kind"),
        "counted",
        "reached",
    )


def column_refs(tokens: DataFrame) -> DataFrame:
    """Column names used in SELECT, WHERE, GROUP BY and HAVING, with up to one qualifier."""
    parts = name_parts(F.col("tok"))
    return tokens.filter(is_column()).select(
        "text_id",
        F.col("stmt").cast("int").alias("stmt"),
        "scope",
        "sel",
        "pos",
        F.when(F.size(parts) > 1, F.lower(F.element_at(parts, -2))).alias("qualifier"),
        F.lower(F.element_at(parts, -1)).alias("column_name"),
        F.size(parts).alias("n_parts"),
        "clause",
        "against",
        "linted_expr",
    )


def comparisons(tokens: DataFrame) -> DataFrame:
    """Binary comparisons with both operands, of any length, as they stand in the text.

    One aggregate per text holds its tokens once; each comparison then takes its two slices of them.
    """
    place = F.struct(
        F.col("stmt").cast("int").alias("stmt"), "sel", "pos", F.col("tok").alias("op"),
        "left_from", "right_to", "clause", "math_operand", "same_sides",
    )
    compared = F.collect_list(F.when((F.col("role") == "cmp") & F.col("sel").isNotNull(), place))
    per_text = tokens.groupBy("text_id").agg(compared.alias("found"), F.collect_list(F.struct("pos", "tok")).alias("toks"))
    every = per_text.where(F.size("found") > 0).select(
        "text_id", "found", F.transform(F.array_sort("toks"), lambda t: t["tok"]).alias("toks")
    )
    each = every.select("text_id", "toks", F.explode("found").alias("c"))
    words_of = lambda start, end: F.array_join(F.slice("toks", start + 1, F.greatest(end - start, F.lit(0))), " ")
    return each.select(
        "text_id", "c.stmt", "c.sel", "c.pos", "c.op",
        words_of(F.col("c.left_from"), F.col("c.pos")).alias("left_operand"),
        words_of(F.col("c.pos") + 1, F.col("c.right_to").cast("int") + 1).alias("right_operand"),
        "c.clause", "c.math_operand", "c.same_sides",
    )


def projection_items(tokens: DataFrame) -> DataFrame:
    """Number of items in each SELECT list."""
    item = (F.col("marker") == "SELECT") | (
        F.col("base") & (F.col("tok") == ",") & (F.col("clause") == "SELECT")
    )
    return (
        tokens.filter(item & F.col("sel").isNotNull())
        .groupBy("text_id", "sel")
        .agg(F.count(F.lit(1)).alias("items"), F.first("counted").alias("counted"))
    )


def query_scopes(tokens: DataFrame) -> DataFrame:
    """Each query in a text: how it is used and the SELECT block around it."""
    return tokens.filter(F.col("own_kind").isNotNull()).select(
        "text_id",
        F.col("stmt").cast("int").alias("stmt"),
        "scope",
        "own_kind",
        F.when(F.col("own_kind") != "top", F.col("parent_sel")).alias("parent_sel"),
        "reached",
        "counted",
    )


def lineage_edges(tokens: DataFrame) -> DataFrame:
    """Query graph as edges: a scope to the block holding it, a block to each table it reads."""
    scopes = query_scopes(tokens).filter(F.col("parent_sel").isNotNull())
    up = scopes.select(
        "text_id",
        F.lit("scope").alias("edge"),
        F.col("scope").alias("child"),
        F.col("parent_sel").cast("string").alias("parent"),
    )
    tables = table_refs(tokens).filter(F.col("table_name").isNotNull())
    down = tables.select(
        "text_id",
        F.lit("table").alias("edge"),
        F.col("sel").alias("child"),
        F.col("table_name").alias("parent"),
    )
    return up.unionByName(down)


def text_stats(tokens: DataFrame) -> DataFrame:
    """Counters and flags per text, with the walker's notion of what is counted."""
    return tokens.groupBy("text_id").agg(F.max("error").alias("error"), *[c.alias(n) for n, c in counters().items()])


def counters() -> dict[str, Column]:
    """Aggregates over the tokens of a text: bigints and flags, none of them null."""
    c = F.col
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    block = c("sel").isNotNull()
    linted_query = (c("scope_kind") == "in_subquery") | (
        (c("scope_kind") == "scalar") & ~c("seg_opaque")
    )
    nested = c("counted") & (
        (c("scope_kind") == "derived") | (linted_query & c("clause").isin(LINTED_CLAUSES))
    )
    item = (c("marker") == "SELECT") | (c("base") & (c("tok") == ",") & (c("clause") == "SELECT"))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    any_ = lambda cond: F.max(yes(cond))
    return {
        "statement_count": count(c("first")),
        "table_count": count(is_table() & (c("depth") == c("bd")) & c("counted")),
        "join_count": count(c("hint").isin("join", "free_join") & c("base") & block & c("counted")),
        "subquery_count": count(nested),
        "column_count": count(item & block & c("counted")),
        "has_where": any_((c("marker") == "WHERE") & block & c("counted")),
        "has_group_by": any_((c("marker") == "GROUP") & block & c("counted")),
        "has_order_by": any_((c("marker") == "ORDER") & c("query_level") & c("counted")),
        "has_limit": any_((c("marker") == "LIMIT") & c("query_level") & c("counted")),
    }


def normalised(tokens: DataFrame) -> DataFrame:
    """Text printed again, see ``printed``; texts of which nothing is left have no row."""
    return tokens.filter(_is_printed()).groupBy("text_id").agg(printed().alias("formatted"))


def _is_printed() -> Column:
    return (F.col("tok") != ";") & F.col("error").isNull() & (F.col("kind") != "none")


def printed() -> Column:
    """Aggregate over the tokens of a text: keywords upper-case, single blanks, each clause on its own line.

    Literals are left as they are; comments are gone; statements are parted by a blank line.
    """
    c = F.col
    word = c("word")
    opens_line = (
        F.when(word.isin("FROM", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "SET")
               & c("base"), "\n")
        .when((word == "SETOP") & (c("kind") == "path"), "\n")
        .when((word == "SIDE") | ((word == "JOIN") & ~c("prev_u").isin(words.JOIN_MODIFIERS)), "\n  ")
        .when(c("u") == "ON", F.when(word == "ON", "\n    "))
    )
    gap = (
        F.when(c("first"), F.when(c("pos") > 0, "\n\n").otherwise(""))
        .when((word == "SIDE") & c("prev_u").isin(words.JOIN_MODIFIERS), " ")
        .when(opens_line.isNotNull(), opens_line)
        .when(c("prev_u").isin("UNION") & (c("u") != "ALL"), "\n")
        .when(c("glued"), "")
        .otherwise(" ")
    )
    piece = F.when((c("kind") == "path") & c("u").isin(words.RESERVED), c("u")).otherwise(c("tok"))
    pieces = F.collect_list(F.when(_is_printed(), F.struct("pos", F.concat(gap, piece).alias("piece"))))
    return F.array_join(F.transform(F.array_sort(pieces), lambda x: x["piece"]), "")
