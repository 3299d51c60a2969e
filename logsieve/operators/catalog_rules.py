"""Lint rules that compare names in a query with a catalog of tables and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.operators.relations import bare_lower, is_column, is_table, name_parts
from logsieve.operators.rules import FINDINGS, finding, kept_rows, token_hits
from logsieve.operators.tokens import FILTER_CLAUSES

CATALOG_RULES = ["L020", "L021", "L022"]


def _spread(name: Column) -> Column:
    """Join key that never meets in one task for the many rows without a table name."""
    nowhere = F.concat(F.lit("?"), F.pmod(F.xxhash64("text_id"), F.lit(4096)).cast("string"))
    return F.coalesce(name, nowhere)


def named_things(tokens: DataFrame, hits: Column, summary: Column | None = None) -> DataFrame:
    """The tokens the catalog rules look at: table sources, column references, CTE names.

    Tokens with findings of their own (``hits``) come along, so that all rules together read the
    token relation once. For ``summary`` see ``rules.kept_rows``.
    """
    derived = F.coalesce(F.col("scope_kind") == "derived", F.lit(False)) & F.col("sel").isNotNull()
    cte = F.coalesce(F.col("scope_kind") == "cte", F.lit(False))
    column, table = is_column(), is_table()
    # a qualified star names a source too
    qualified_star = (
        (F.col("hint") == "star") & F.col("tok").endswith(".*") & F.col("base")
        & (F.col("clause") == "SELECT")
    )
    parts = name_parts(F.col("tok"))
    col_parts = F.when(F.col("star"), F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.lit("*")))).otherwise(parts)
    marked = tokens.withColumn(
        "thing",
        F.when(table, "table").when(derived, "derived").when(cte, "cte").when(column | qualified_star, "column"),
    ).withColumn("hits", hits)
    wanted = F.col("thing").isNotNull() | (F.size("hits") > 0)
    needed = ["text_id", "stmt", "thing", "scope", "scope_end", "sel", "pos", "tok", "cte_name", "alias", "clause", "against",
              "reached", "linted_expr", "star", "hits"]
    return (
        kept_rows(marked.withColumn("star", qualified_star), wanted, needed, summary)
        .withColumn("parts", F.when(F.col("thing") == "column", col_parts))
        .select(
            "text_id",
            F.col("stmt").cast("int").alias("stmt"),
            "thing",
            "scope",
            F.coalesce("scope_end", F.lit(2147483647)).alias("scope_end"),
            "sel",
            "pos",
            F.when(F.col("thing") == "table", F.lower("tok")).alias("table_name"),
            F.when(F.col("thing") == "cte", bare_lower(F.col("cte_name")))
            .when(F.col("thing") != "column", bare_lower(F.col("alias")))
            .alias("alias"),
            F.when(F.size("parts") == 2, F.element_at("parts", 1)).alias("qualifier"),
            F.when(F.size("parts") <= 2, F.element_at("parts", -1)).alias("column_name"),
            "clause",
            "against",
            F.when(F.col("star"), F.col("reached")).otherwise(F.col("linted_expr")).alias("linted_expr"),
            "reached",
            F.col("tok").alias("text"),
            "hits",
        )
    )


def candidate_sources(things: DataFrame, catalog: DataFrame) -> DataFrame:
    """Column references, each with the sources its name may come from; table references too.

    A bare name may come from every source of its SELECT; a qualified one from the source with
    that alias or name, or failing that from the innermost enclosing query having one.
    """
    tables = catalog.groupBy("table_name").agg(F.max("is_indexed").alias("has_index"))
    thing = F.col("thing")
    is_source = thing.isin("table", "derived")
    with_known = (
        things.withColumn("table_key", _spread(F.col("table_name")))
        .join(tables.withColumnRenamed("table_name", "table_key"), "table_key", "left")
        .withColumn("known", F.col("has_index").isNotNull())
    )
    source = F.struct(
        "pos", "scope", "scope_end", "table_name", "alias", "known",
        F.coalesce("has_index", F.lit(False)).alias("has_index"),
    )
    qualifier = F.lower("qualifier")
    keys = (
        F.when(is_source, F.array_compact(F.array_distinct(F.array("alias", "table_name"))))
        .when(thing == "cte", F.array("alias"))
        .when(thing == "column", F.array(qualifier))
    )
    named_once = (thing == "table") & (F.col("key") == F.col("table_name"))
    block = W.partitionBy("text_id", "stmt", "sel")
    # sources sharing a name meet the references qualified with it; bare names pass through
    same_name = W.partitionBy("text_id", "stmt", "key")
    keyed = (
        with_known.withColumns(
            {"sources": F.collect_list(F.when(is_source, source)).over(block), "keys": keys}
        )
        .withColumn("key", F.explode_outer("keys"))
        .withColumns(
            {
                "namesakes": F.when(
                    F.col("key").isNotNull(), F.collect_list(F.when(is_source, source)).over(same_name)
                ),
                "is_cte": F.max(F.coalesce(thing, F.lit("")) == "cte").over(same_name),
            }
        )
        .filter(
            F.coalesce(thing == "column", F.lit(False))
            | F.coalesce(named_once, F.lit(False))
            | (F.coalesce(~thing.isin("column", "table"), F.lit(True)) & (F.size("hits") > 0))
        )
    )
    around = F.filter(
        "namesakes",
        lambda s: (s["scope"] != F.col("scope")) & (s["scope"] < F.col("pos")) & (F.col("pos") < s["scope_end"]),
    )
    innermost = F.reverse(
        F.array_sort(F.transform(around, lambda s: F.struct(s["scope"].alias("at"), s.alias("s"))))
    )
    matches = lambda s: (s["alias"] == qualifier) | (s["table_name"] == qualifier)
    own = (
        F.when(F.coalesce(thing != "column", F.lit(True)), F.slice("sources", 1, 0))
        .when(F.col("qualifier").isNull(), F.col("sources"))
        .otherwise(F.filter("sources", matches))
    )
    unowned = F.col("qualifier").isNotNull() & (F.size("own") == 0)
    return keyed.withColumn("own", own).withColumn("outer", F.when(unowned, F.get(innermost, 0)["s"]))


def resolved_names(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each reference with the number of its sources that have the column, and its type."""
    sources = F.when(F.col("outer").isNotNull(), F.array("outer")).otherwise(F.col("own"))
    pairs = refs.withColumns(
        {
            "from_outer": F.col("outer").isNotNull(),
            "n_own": F.size("own"),
            "source": F.explode_outer(sources),
            "lookup": F.lower("column_name"),
        }
    )
    columns = catalog.select(
        F.col("table_name").alias("cat_table"),
        F.col("column_name").alias("cat_column"),
        "type_family",
        "is_indexed",
    )
    joined = pairs.withColumn("table_key", _spread(F.col("source.table_name"))).join(
        columns,
        (F.col("table_key") == F.col("cat_table")) & (F.col("lookup") == F.col("cat_column")),
        "left",
    )
    has = F.col("cat_table").isNotNull()
    names = F.array_compact(F.array("source.alias", "source.table_name"))
    carried = ["thing", "qualifier", "column_name", "text", "clause", "against", "linted_expr",
               "reached", "from_outer", "n_own", "known", "is_cte"]
    return (
        joined.groupBy("text_id", "stmt", "pos")
        .agg(
            *[F.first(x).alias(x) for x in carried],
            F.first("hits").alias("hits"),
            F.max("source.known").alias("any_known"),
            F.sum(F.when(has, 1).otherwise(0)).alias("owners"),
            F.collect_list(F.when(has, names)).alias("owner_names"),
            F.array_sort(F.collect_set("cat_table")).alias("tables"),
            F.min(
                F.when(has, F.struct("cat_table", "type_family", "is_indexed", "source.has_index"))
            ).alias("column"),
        )
        .withColumn("owner_names", F.size(F.array_distinct(F.flatten("owner_names"))))
    )


def name_findings(resolved: DataFrame) -> DataFrame:
    """L020 (table, alias, column, ambiguous), L021 (type mismatch) and L022 (unindexed filter).

    Names of CTEs and aliases of enclosing queries count as known, and a column is ambiguous when
    two sources have it; a walker without these notions reports more, marked ``quirk``.
    """
    c = F.col
    column = (c("thing") == "column") & c("column_name").isNotNull()
    real = column & (c("column_name") != "*")
    bare = real & c("qualifier").isNull()
    visible = c("linted_expr") & ~c("from_outer")
    filtered = real & c("clause").isin(FILTER_CLAUSES) & c("against").isNotNull()
    family = c("column.type_family")
    mismatch = ((family == "numeric") & (c("against") == "str")) | (
        (family == "string") & (c("against") == "num")
    )
    unindexed = c("column.has_index") & ~c("column.is_indexed")
    none, no = F.lit(None).cast("string"), F.lit(False)
    filled = c("filled").isNotNull()
    rows = [
        ((c("thing") == "table") & ~c("known"), "L020", F.lit("table"), c("reached"), c("text"), none,
         c("is_cte")),
        (column & c("qualifier").isNotNull() & (c("n_own") == 0), "L020", F.lit("alias"),
         c("linted_expr"), c("qualifier"), none, c("from_outer")),
        (real & c("any_known") & (c("owners") == 0), "L020", F.lit("column"), visible, c("text"), none, no),
        (bare & (c("owner_names") > 1), "L020", F.lit("ambiguous"), visible, c("text"),
         F.array_join("tables", ", "), c("owners") < 2),
        (filtered & mismatch, "L021", family, visible, c("text"), none, no),
        (filtered & unindexed, "L022", F.lit(""), visible, F.lower("column_name"), c("column.cat_table"), no),
    ]
    hits = [
        F.when(cond & filled, finding(rule, variant, F.col("pos"), visible, p1, p2, quirk))
        for cond, rule, variant, visible, p1, p2, quirk in rows
    ]
    all_hits = F.concat(F.array_compact(F.array(*hits)), F.col("hits"))
    return resolved.select("text_id", "stmt", F.explode(all_hits).alias("hit")).select(
        "text_id", "stmt", "hit.*"
    )


def all_findings(tokens: DataFrame, catalog: DataFrame, only: list[str] | None = None,
                 more: Column | None = None, summary: Column | None = None) -> DataFrame:
    """Findings of the catalog rules and of the token rules, in one pass over the tokens.

    With an empty catalog nothing is known about names and no catalog rule reports anything.
    ``more``: an array of further findings of each token. ``summary``: one finding more of each text.
    """
    no_hits = F.array().cast(FINDINGS)
    wanted = only is None or bool(set(only) - set(CATALOG_RULES))
    hits = token_hits(only) if wanted else no_hits
    # a stage of its own, as in ``annotate``: the rows are few and narrow here
    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    things = named_things(tokens, hits if more is None else F.concat(hits, more), summary).repartition(n + 1, "text_id")
    filled = catalog.select(F.lit(True).alias("filled")).limit(1)
    refs = candidate_sources(things, catalog)
    resolved = resolved_names(refs, catalog).join(F.broadcast(filled), F.lit(True), "left")  # one row
    found = name_findings(resolved)
    return found if only is None else found.filter(F.col("rule_id").isin(only))
