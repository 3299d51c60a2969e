"""Named queries over the test tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.operators import conformance, flows, outputs, ranges, relations, sketches
from logsieve.operators.catalog_rules import CATALOG_RULES
from logsieve.operators.rules import TOKEN_RULES
from logsieve.plans import incremental, lint
from logsieve.session import TABLES, table
from logsieve.sources import catalog as catalogs
from logsieve.sources.querylog import clean_log, dialect_dim, distinct_texts
from logsieve.sources.samples import FLOW_TEMPLATES, TABLE_DDL, dialect_log, sample_ddl, sample_log, spread_dialects
from logsieve.streaming.stream import work_folder

# Key columns of the test tables.
KEY_COLUMNS = {
    "r_regionkey", "n_nationkey", "c_custkey", "s_suppkey", "p_partkey", "o_orderkey",
    "l_orderkey", "event_id", "doc_id",
}

Query = Callable[[SparkSession, str], DataFrame]


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_log(table(spark, sf_dir, "events"))


def tables_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {t: table(spark, sf_dir, t) for t in TABLES}
    return catalogs.catalog_from_frames(spark, frames, KEY_COLUMNS)


def _work(spark, sf_dir, only=None):
    return lint.prepare(events_log(spark, sf_dir), only)


def source_log(spark, sf_dir):
    return clean_log(events_log(spark, sf_dir)).select("query_id", "user_id", "dialect", "sql")


def dialect_usage(spark, sf_dir):
    log = clean_log(spread_dialects(events_log(spark, sf_dir)))
    dims = F.broadcast(dialect_dim(spark))  # seven rows
    return (
        log.groupBy("dialect")
        .agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("sql").alias("texts"))
        .join(dims, "dialect")
    )


def dialect_lint(spark, sf_dir):
    return lint.outcomes(dialect_log(table(spark, sf_dir, "events"))).select("query_id", "dialect", "error", "rules")


def text_usage(spark, sf_dir):
    return distinct_texts(clean_log(events_log(spark, sf_dir))).select(
        F.col("first_query").alias("text_id"), "sql", "uses"
    )


def ddl_catalog(spark, sf_dir):
    return catalogs.catalog_from_ddl(sample_ddl(table(spark, sf_dir, "events"))).select(
        "ddl_id", "table_name", "column_name", "data_type", "type_family", "is_indexed"
    )


def live_catalog(spark, sf_dir):
    """Columns of the live tables with the rows and NULLs they hold."""
    counts = conformance.column_counts({t: table(spark, sf_dir, t) for t in TABLES}).drop("actual", "fits")
    return tables_catalog(spark, sf_dir).join(counts, ["table_name", "column_name"]).select(
        "table_name", "column_name", "type_family", "is_indexed", "rows", "nulls"
    )


def schema_conformance(spark, sf_dir):
    """The tables beside what DDL texts say of them, with the values that keep to it."""
    ddl = spark.createDataFrame([(i, "generic", s) for i, s in enumerate(TABLE_DDL)], "ddl_id bigint, dialect string, sql string")
    names = [s.split()[2] for s in TABLE_DDL]
    return conformance.conformance({t: table(spark, sf_dir, t) for t in names}, catalogs.catalog_from_ddl(ddl))


def props_fields(spark, sf_dir):
    return conformance.json_fields(table(spark, sf_dir, "events"), "props", "event_type")


def lineage_reach(spark, sf_dir):
    """All tables that a table is filled from, over the statements of a whole log."""
    work = lint.prepare(sample_log(table(spark, sf_dir, "events"), FLOW_TEMPLATES))
    return flows.reach(flows.flow_edges(work.tokens), f"{work_folder(spark)}/reach")


def _in_batches(spark, sf_dir):
    """A ledger after a third of the log, all of it, and the first batch once more."""
    log, folder, cat = events_log(spark, sf_dir), f"{work_folder(spark)}/ledger", tables_catalog(spark, sf_dir)
    first = log.filter(F.col("query_id") % 3 == 0)
    for batch_id, rows in ((0, first), (1, log), (0, first)):
        incremental.update(rows, folder, batch_id, cat)
    return log, folder, cat


def lint_incremental(spark, sf_dir):
    log, folder, cat = _in_batches(spark, sf_dir)
    found = incremental.findings_of(log, folder, cat)
    counts = found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("query_id").alias("queries"))
    return counts


def ledger_batches(spark, sf_dir):
    _, folder, _ = _in_batches(spark, sf_dir)
    return incremental.batches(spark, folder)


def column_profile(spark, sf_dir):
    """Profiles of the events from sketches per day, stored in two turns and merged, held against exact counts."""
    events, names = table(spark, sf_dir, "events"), ["event_id", "user_id", "event_type", "value", "props"]
    day, folder = F.to_date("ts"), f"{work_folder(spark)}/profiles"
    even = F.dayofmonth("ts") % 2 == 0
    for part in (events.filter(even), events.filter(~even)):
        sketches.store(sketches.by_day(part, day, names), folder)
    return sketches.checked(sketches.merged(spark.read.parquet(folder)), events, names)


def record_roundtrip(spark, sf_dir):
    """The records written twice as JSON lines and read back."""
    base = work_folder(spark)
    # analysed once, though written twice
    records = lint.analysed(events_log(spark, sf_dir), f"{base}/made", tables_catalog(spark, sf_dir), parity=True)
    folder = f"{base}/records"
    for _ in range(2):
        outputs.write_records(records, folder, "all")
    back = outputs.read_records(spark, folder, records.schema)
    return back.groupBy(F.col("first_query").alias("text_id")).agg(
        F.count(F.lit(1)).alias("copies"), F.max("uses").alias("uses"), F.max(F.size("lint_issues")).alias("n_issues"),
        F.max("formatted_sql").alias("formatted_sql"), F.max("error").alias("error"), F.count("bad_line").alias("bad_lines"),
    )


def tokens(spark, sf_dir):
    """Texts that fail the well-formedness screen have no tokens here: all of a text or nothing."""
    work = _work(spark, sf_dir)
    return work.by_first_query(work.tokens.filter(F.col("error").isNull())).select(
        "text_id", "pos", "tok", "kind", F.col("stmt").cast("int").alias("stmt"),
        F.col("depth").cast("int").alias("depth"), F.col("scope").cast("int").alias("scope"),
        F.col("bd").cast("int").alias("bd"), F.col("arm").cast("int").alias("arm"), "clause",
    )


def well_formed(spark, sf_dir):
    work = _work(spark, sf_dir)
    per_text = work.tokens.groupBy("text_id").agg(F.max("error").alias("error"))
    return work.per_query(per_text).select("query_id", F.col("error").isNull().alias("success"), "error")


def scopes(spark, sf_dir):
    work = _work(spark, sf_dir)
    return work.by_first_query(relations.query_scopes(work.tokens))


def table_references(spark, sf_dir):
    work = _work(spark, sf_dir)
    return work.by_first_query(relations.table_refs(work.tokens)).select(
        "text_id", "stmt", "sel", "pos", "alias", "table_name", "ref_kind", "counted", "reached"
    )


def column_references(spark, sf_dir):
    work = _work(spark, sf_dir)
    return work.by_first_query(relations.column_refs(work.tokens)).select(
        "text_id", "stmt", "sel", "pos", "qualifier", "column_name", "clause", "against", "linted_expr"
    )


def comparison_operands(spark, sf_dir):
    work = _work(spark, sf_dir)
    return work.by_first_query(relations.comparisons(work.tokens))


def projection_sizes(spark, sf_dir):
    work = _work(spark, sf_dir)
    return work.by_first_query(relations.projection_items(work.tokens))


def rule_hits(rule_id, spark, sf_dir):
    work = _work(spark, sf_dir, [rule_id])
    found = lint.findings(work, only=[rule_id])
    return work.per_query(found).select("query_id", "stmt", "variant", "pos", "visible")


def name_rule_hits(rule_id, spark, sf_dir):
    work = _work(spark, sf_dir, [rule_id])
    # both kinds of findings: those of the default mode and those only a walker reports
    found = lint.all_findings(work.tokens, tables_catalog(spark, sf_dir), [rule_id])
    return work.per_query(found).select(
        "query_id", "stmt", "variant", "pos", "visible", "p1", "p2", "quirk"
    )


def _all_findings(work, spark, sf_dir, parity=False):
    return lint.findings(work, tables_catalog(spark, sf_dir), parity)


def lint_counts(parity, spark, sf_dir):
    work = _work(spark, sf_dir)
    found = _all_findings(work, spark, sf_dir, parity)
    weighted = outputs.weighted_rules(work.log, found)
    return outputs.with_severity(weighted).select("rule_id", "severity", "category", "findings", "queries")


def query_stats(spark, sf_dir):
    return lint.stats(events_log(spark, sf_dir)).drop("uses")


def formatted(spark, sf_dir):
    work = _work(spark, sf_dir)
    return work.by_first_query(relations.normalised(work.tokens))


def severity_summary(spark, sf_dir):
    work = _work(spark, sf_dir)
    return work.per_query(outputs.severity_counts(_all_findings(work, spark, sf_dir))).select(
        "query_id", "errors", "warnings", "infos", "total", "worst", "badge"
    )


def messages(lang, spark, sf_dir):
    work = _work(spark, sf_dir)
    return work.by_first_query(outputs.localised(_all_findings(work, spark, sf_dir), lang)).select(
        "text_id", "pos", "rule_id", "message", "advice", "severity_label", "category_label"
    )


def analysis_records(spark, sf_dir):
    folder = f"{work_folder(spark)}/analysed"
    records = lint.analysed(events_log(spark, sf_dir), folder, tables_catalog(spark, sf_dir), parity=True)
    return records.select(
        F.col("first_query").alias("text_id"), "uses", "success", "error", "formatted_sql",
        F.size("lint_issues").cast("bigint").alias("n_issues"), "stats.statement_count",
        "stats.table_count", "stats.has_where",
    )


def lineage(spark, sf_dir):
    work = _work(spark, sf_dir)
    return work.by_first_query(relations.lineage_edges(work.tokens))


def clean_queries(spark, sf_dir):
    return lint.clean_queries(events_log(spark, sf_dir), tables_catalog(spark, sf_dir)).select("query_id")


def rules_per_user_day(spark, sf_dir):
    work = _work(spark, sf_dir)
    day = F.to_date("ts")
    counts = outputs.weighted_rules(work.log, _all_findings(work, spark, sf_dir), "user_id", ("day", day))
    return outputs.top_rules(counts, 3, "user_id", "day").select(
        "user_id", "day", "rule_id", "findings", "queries", "rank"
    )


def rules_rollup(spark, sf_dir):
    work = _work(spark, sf_dir)
    counts = outputs.weighted_rules(work.log, _all_findings(work, spark, sf_dir), "user_id")
    return (
        counts.rollup("user_id", "rule_id")
        .agg(F.sum("findings").alias("findings"), F.grouping_id().cast("bigint").alias("level"))
    )


def lint_queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "source_log": source_log,
        "dialect_usage": dialect_usage,
        "dialect_lint": dialect_lint,
        "text_usage": text_usage,
        "ddl_catalog": ddl_catalog,
        "live_catalog": live_catalog,
        "tokens": tokens,
        "well_formed": well_formed,
        "scopes": scopes,
        "table_references": table_references,
        "column_references": column_references,
        "comparison_operands": comparison_operands,
        "projection_sizes": projection_sizes,
    }
    for rule in TOKEN_RULES:
        out[f"lint_{rule}"] = partial(rule_hits, rule)
    for rule in CATALOG_RULES:
        out[f"lint_{rule}"] = partial(name_rule_hits, rule)
    out.update(
        {
            "lint_counts": partial(lint_counts, False),
            "lint_counts_parity": partial(lint_counts, True),
            "query_stats": query_stats,
            "formatted": formatted,
            "severity_summary": severity_summary,
            "messages_en": partial(messages, "en"),
            "messages_tr": partial(messages, "tr"),
            "analysis_records": analysis_records,
            "lineage": lineage,
            "clean_queries": clean_queries,
            "lineage_reach": lineage_reach,
            "lint_incremental": lint_incremental,
            "ledger_batches": ledger_batches,
            "record_roundtrip": record_roundtrip,
            "schema_conformance": schema_conformance,
            "props_fields": props_fields,
            "column_profile": column_profile,
            "rules_per_user_day": rules_per_user_day,
            "rules_rollup": rules_rollup,
        }
    )
    return out


def _holes(df: DataFrame, key: str, every: int, column: str) -> DataFrame:
    """The table with NULL in ``column`` on every n-th key; the test tables have no NULLs."""
    return df.withColumn(column, F.when(F.col(key) % every != 0, F.col(column)))


def _skips(df: DataFrame, **bounds: tuple) -> DataFrame:
    """Per column, what a range filter on it skips in blocks of 100 rows."""
    each = [ranges.skipped(ranges.zones(df, c, 100), *b).withColumn("column_name", F.lit(c)) for c, b in bounds.items()]
    return reduce(DataFrame.unionByName, each)


def impact_queries() -> dict[str, Query]:
    from logsieve.operators import impact as im

    def on(name, run):
        return lambda spark, d: run(table(spark, d, name))

    def on_two(a, b, run):
        return lambda spark, d: run(table(spark, d, a), table(spark, d, b))

    holed = lambda t: _holes(t, "o_orderkey", 10, "o_custkey")
    suffix = lambda c: c.withColumn("column_name", F.substring_index("column_name", "_", -1))

    def schema_check(spark, d):
        cat = tables_catalog(spark, d)
        pick = lambda t: suffix(cat.filter(F.col("table_name") == t))
        return im.schema_diff(pick("orders"), pick("lineitem"))

    return {
        "impact_column_bytes": on_two("orders", "lineitem", lambda o, li: im.column_bytes(o, "orders")
            .unionByName(im.column_bytes(li, "lineitem"))),
        "impact_or_split": on("orders", lambda o: im.or_split(
            holed(o), F.col("o_orderstatus") == "F", F.col("o_custkey") < 500)),
        "impact_like_forms": on("part", lambda p: im.like_forms(p, "p_name", "ring", "p_brand")),
        "impact_distinct": on("lineitem", lambda li: im.distinct_gain(li, ["l_orderkey", "l_linenumber"])
            .unionByName(im.distinct_gain(li, ["l_orderkey"]))
            .unionByName(im.distinct_gain(li, ["l_returnflag", "l_linestatus"]))),
        "impact_not_in": on_two("customer", "orders", lambda c, o: im.not_in_check(
            _holes(c, "c_custkey", 10, "c_custkey"), holed(o), "c_custkey", "o_custkey")),
        "impact_not_in_rows": on_two("customer", "orders", lambda c, o: im.not_in(
            _holes(c.withColumn("id", F.col("c_custkey")), "id", 10, "c_custkey"),
            holed(o).filter("o_custkey IS NOT NULL"), "c_custkey", "o_custkey").select("id")),
        "impact_scalar_subquery": on_two("orders", "lineitem", lambda o, li: im.scalar_as_join(
            o.select("o_orderkey", "o_custkey"), li, "o_orderkey", "l_orderkey",
            F.max("l_extendedprice").alias("max_price"), F.max("l_shipdate").alias("last_ship"))),
        "impact_union": on_two("customer", "supplier", lambda c, s: im.union_dedup(
            c.select("c_nationkey"), s.select("s_nationkey"))),
        "impact_sargable_year": on("orders", lambda o: im._count(
            o.filter(F.year("o_orderdate") == 1996), "function").unionByName(
            im._count(o.filter(im.year_range("o_orderdate", 1996)), "range"))),
        "impact_sargable_math": on("part", lambda p: im._count(
            p.filter(F.col("p_size") + 10 > 20), "column").unionByName(
            im._count(p.filter(F.col("p_size") > 10), "literal"))),
        "impact_having": on("orders", lambda o: im.global_having(
            o, F.col("n") > 5, F.max("o_totalprice").alias("top"), F.count(F.lit(1)).alias("n"))),
        "impact_self_comparison": on("orders", lambda o: im.self_comparison(holed(o), "o_custkey")),
        "impact_join_fanout": on_two("events", "orders", lambda e, o: im.join_fanout(
            e, o, "user_id", "o_custkey").orderBy(F.col("pairs").desc(), "key").limit(10)),
        "impact_join_totals": on_two("events", "orders", lambda e, o: im.fanout_totals(
            e, o, "user_id", "o_custkey")),
        "impact_ordinal_sort": on("customer", lambda c: im.top_by_name(
            c.select("c_name", "c_acctbal", "c_custkey"), [F.col("c_acctbal").desc(), F.col("c_custkey")], 20)),
        "impact_comma_join": on_two("customer", "nation", lambda c, n: im.comma_join(
            c, n, F.col("c_nationkey") == F.col("n_nationkey"), "n_name")),
        "impact_schema_diff": schema_check,
        "impact_cast_share": on("events", lambda e: im.castable_share(e, {
            "props": F.col("props"), "k": F.regexp_extract("props", "[0-9]+", 0),
            "event_type": F.col("event_type"),
            "k_below_50": F.when(F.regexp_extract("props", "[0-9]+", 0).cast("int") < 50,
                                 F.regexp_extract("props", "[0-9]+", 0)).otherwise("many")})),
        "impact_column_layout": on("orders", lambda o: im.column_layout(
            holed(o), ["o_custkey", "o_orderstatus", "o_orderpriority"])),
        "impact_null_comparison": on("orders", lambda o: im.null_comparison(holed(o), "o_custkey")),
        "impact_guarded_rows": on("orders", lambda o: im.guarded_rows(holed(o), F.col("o_custkey") < 100)),
        "impact_page": on("orders", lambda o: ranges.page(
            o.select("o_orderkey", "o_totalprice"), [("o_totalprice", False), ("o_orderkey", True)], 10, 2)),
        "impact_page_deep": on("orders", lambda o: ranges.page(
            holed(o).select("o_orderkey", "o_custkey", "o_orderstatus"),
            [("o_orderstatus", False), ("o_custkey", True), ("o_orderkey", False)], 10, 1000, at_once=100)),
        "impact_zone_skip": on("orders", lambda o: _skips(o, o_orderkey=(F.lit(500), F.lit(700)), o_orderdate=im.year_bounds(1996))),
    }


def stream_rule_windows(spark, sf_dir):
    from logsieve.streaming.stream import run_rule_windows

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    log = sample_log(events).withColumn("ts", F.col("ts").cast("timestamp"))
    return run_rule_windows(spark, log, catalog=tables_catalog(spark, sf_dir))


def stream_queries() -> dict[str, Query]:
    return {"stream_rule_windows": stream_rule_windows}
