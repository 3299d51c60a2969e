"""Catalogs: ``schema_columns(table_name, column_name, data_type, type_family, is_indexed)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions import words
from logsieve.operators.relations import bare_lower
from logsieve.operators.tokens import explode_tokens, screen
from logsieve.sources.querylog import clean_log, distinct_texts

CATALOG_SCHEMA = (
    "table_name string, column_name string, data_type string, type_family string, is_indexed boolean"
)


def type_family(data_type: Column) -> Column:
    base = F.lower(F.regexp_extract(data_type, "^[A-Za-z]+", 0))
    return (
        F.when(base.isin(words.NUMERIC_TYPES), "numeric")
        .when(base.isin(words.STRING_TYPES), "string")
        .otherwise("other")
    )


def catalog_from_frames(
    spark: SparkSession, frames: dict[str, DataFrame], keys: set[str] = frozenset()
) -> DataFrame:
    """Catalog of live tables, from their schemas alone; ``keys`` names the key columns."""
    rows = [
        (t.lower(), f.name.lower(), f.dataType.simpleString(), None, f.name.lower() in keys)
        for t, df in frames.items()
        for f in df.schema.fields
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA).withColumn(
        "type_family", type_family(F.col("data_type"))
    )


def catalog_from_metastore(spark: SparkSession, database: str, keys: set[str] = frozenset()) -> DataFrame:
    """Catalog of the tables registered in one database; reads metadata only."""
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    frames = {n: spark.table(f"{database}.{n}") for n in names}
    return catalog_from_frames(spark, frames, keys)


def empty_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CATALOG_SCHEMA)


def ddl_statements(tokens: DataFrame) -> DataFrame:
    """Tokens of CREATE TABLE and CREATE INDEX statements, with statement-wide facts.

    ``item`` numbers the comma-separated parts at the first parenthesis level.
    """
    stmt = W.partitionBy("text_id", "stmt").orderBy("pos")
    before = stmt.rowsBetween(W.unboundedPreceding, -1)
    upto = stmt.rowsBetween(W.unboundedPreceding, 0)
    u, pos = F.col("u"), F.col("pos")
    at = lambda c: F.when(c, pos)
    starts = F.min(at(F.col("tok") == "(")).over(stmt.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    tagged = tokens.filter(F.col("verb") == "CREATE").withColumns(
        {
            "open_at": starts,
            "table_at": F.first(at(u == "TABLE"), ignorenulls=True).over(upto),
            "index_at": F.first(at(u == "INDEX"), ignorenulls=True).over(upto),
            "on_at": F.first(at(u == "ON"), ignorenulls=True).over(upto),
            "item": F.coalesce(
                F.sum(F.when((F.col("tok") == ",") & (F.col("depth") == 1), 1).otherwise(0)).over(before),
                F.lit(0),
            ),
        }
    )
    return tagged.withColumn(
        "creates",
        F.when(F.col("table_at") < F.col("open_at"), "table")
        .when(F.col("index_at") < F.col("open_at"), "index"),
    )


def catalog_from_ddl(ddl: DataFrame) -> DataFrame:
    """Catalogs out of DDL texts: one per row of ``ddl(ddl_id, dialect, sql)``.

    CREATE TABLE gives the columns; a column marked UNIQUE or PRIMARY KEY, one listed in such a
    table constraint, or one listed in a later CREATE INDEX on the table is indexed. The last
    CREATE TABLE of a name wins. A text that is not well formed gives nothing.
    """
    log = clean_log(ddl.withColumnRenamed("ddl_id", "query_id"))
    texts = distinct_texts(log)
    n = int(ddl.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = screen(explode_tokens(texts.repartition(n, "text_id")))
    parts = ddl_statements(tokens)
    u = F.col("u")
    named = F.col("kind") == "path"
    keyword = u.isin("IF", "NOT", "EXISTS", "TABLE", "INDEX", "UNIQUE", "TEMPORARY", "TEMP")
    per_stmt = F.min(
        F.when(
            named & ~keyword & (F.col("pos") < F.col("open_at"))
            & F.when(F.col("creates") == "table", F.col("pos") > F.col("table_at")).otherwise(
                F.col("pos") > F.col("on_at")
            ),
            F.struct("pos", F.lower("tok").alias("name")),
        )
    ).over(W.partitionBy("text_id", "stmt"))
    # facts known only after the parenthesis opens are spread over the statement
    creates = F.max(F.when(F.col("tok") == "(", F.col("creates"))).over(W.partitionBy("text_id", "stmt"))
    body = (
        parts.withColumn("creates", creates)
        .filter(F.col("creates").isNotNull())
        .withColumn("table_name", per_stmt["name"])
        .filter((F.col("pos") > F.col("open_at")) & (F.col("depth") >= 1))
    )
    first_of = F.first(F.struct("u", "tok", "kind")).over(
        W.partitionBy("text_id", "stmt", "item").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    )
    # the comma that starts an item is not part of it
    items = body.filter((F.col("tok") != ",") | (F.col("depth") > 1)).withColumn("lead", first_of)
    constraint_words = ["PRIMARY", "UNIQUE", "CONSTRAINT", "FOREIGN", "CHECK", "KEY", "INDEX", "EXCLUDE"]
    is_constraint = (F.col("creates") == "table") & F.col("lead.u").isin(constraint_words)
    grouped = items.groupBy("text_id", "stmt", "item", "table_name", "creates").agg(
        F.min("lead").alias("lead"),
        F.max(is_constraint).alias("is_constraint"),
        F.max(u.isin("PRIMARY", "UNIQUE") & (F.col("depth") == 1)).alias("has_key_word"),
        F.max(u == "FOREIGN").alias("is_foreign"),
        F.collect_list(F.when((F.col("depth") == 2) & named, bare_lower(F.col("tok")))).alias("listed"),
        F.min(F.when(F.col("tok") == "(", F.col("pos"))).alias("inner_open"),
        F.min(F.when((F.col("depth") == 1) & (F.col("tok") != F.col("lead.tok")) & named,
                     F.struct("pos", "tok"))).alias("type_tok"),
        F.count(F.when(F.col("depth") >= 1, 1)).alias("n_tokens"),
    )
    table_item = F.col("creates") == "table"
    columns = grouped.filter(table_item & ~F.col("is_constraint")).select(
        "text_id",
        "table_name",
        "stmt",
        bare_lower(F.col("lead.tok")).alias("column_name"),
        F.lower("type_tok.tok").alias("data_type"),
        F.col("has_key_word").alias("is_indexed"),
    )
    constraint_keys = grouped.filter(
        table_item & F.col("is_constraint") & F.col("has_key_word") & ~F.col("is_foreign")
    ).select("text_id", "table_name", "stmt", F.explode("listed").alias("column_name"))
    index_keys = grouped.filter((F.col("creates") == "index") & (F.col("lead.kind") == "path")).select(
        "text_id", "table_name", "stmt", bare_lower(F.col("lead.tok")).alias("column_name")
    )
    last = W.partitionBy("text_id", "table_name")
    latest = columns.withColumn("last_stmt", F.max("stmt").over(last)).filter(
        F.col("stmt") == F.col("last_stmt")
    )
    keys = constraint_keys.unionByName(index_keys).withColumnRenamed("stmt", "key_stmt")
    matched = latest.join(keys, ["text_id", "table_name", "column_name"], "left").groupBy(
        "text_id", "table_name", "column_name"
    )
    per_text = matched.agg(
        F.max("data_type").alias("data_type"),
        (F.max("is_indexed") | F.coalesce(F.max(F.col("key_stmt") >= F.col("stmt")), F.lit(False))).alias(
            "is_indexed"
        ),
    )
    return per_text.join(texts.select("text_id", "first_query"), "text_id").select(
        F.col("first_query").alias("ddl_id"),
        "table_name",
        "column_name",
        "data_type",
        type_family(F.col("data_type")).alias("type_family"),
        "is_indexed",
    )
