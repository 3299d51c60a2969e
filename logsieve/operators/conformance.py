"""Do the rows of a table keep to its declaration? Types and counts from data, not from names alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type names of DDL texts and of schemas, as one name.
SAME_TYPE = {
    "integer": "int", "int4": "int", "int8": "bigint", "long": "bigint", "real": "float", "number": "double",
    "varchar": "string", "char": "string", "text": "string", "timestamp_ntz": "timestamp", "datetime": "timestamp",
    "bool": "boolean",
}
CASTABLE = {"int", "bigint", "smallint", "tinyint", "float", "double", "string", "boolean", "date", "timestamp"}


def one_name(data_type: str) -> str:
    base = data_type.lower().split("(")[0].strip()
    return SAME_TYPE.get(base, base)


def _survives(field: T.StructField, declared: str | None) -> Column:
    """The value can be cast to the declared type and back without a change."""
    c = F.col(f"`{field.name}`")
    if declared is None or declared not in CASTABLE or not isinstance(field.dataType, T.AtomicType):
        return F.lit(None).cast("boolean")
    return c.isNotNull() & F.coalesce(c.try_cast(declared).try_cast(field.dataType) == c, F.lit(False))


def column_counts(frames: dict[str, DataFrame], declared: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """(table_name, column_name, actual, rows, nulls, fits): one scan and one aggregate a table.

    ``fits`` counts the values that survive a cast to the type in ``declared``; NULL where there is none.
    """
    out = None
    for table, df in frames.items():
        made = []
        for f in df.schema.fields:
            c, name = F.col(f"`{f.name}`"), f.name.lower()
            fits = _survives(f, (declared or {}).get((table.lower(), name)))
            made.append(F.struct(
                F.lit(table.lower()).alias("table_name"), F.lit(name).alias("column_name"),
                F.lit(one_name(f.dataType.simpleString())).alias("actual"), F.count(F.lit(1)).alias("rows"),
                F.count_if(c.isNull()).alias("nulls"), F.when(F.count(fits.cast("int")) > 0, F.count_if(fits)).alias("fits"),
            ))
        each = df.agg(F.array(*made).alias("columns")).select(F.inline("columns"))
        out = each if out is None else out.unionByName(each)
    return out


def conformance(frames: dict[str, DataFrame], catalog: DataFrame) -> DataFrame:
    """L020: declared columns beside those of the tables, with how many values keep to the declaration.

    status: missing (declared only), extra (in the table only), type (another type), nulls (a key column
    with NULLs) or same. The catalog's rows for these tables, as many as they have columns, reach the driver.
    """
    wanted = catalog.filter(F.lower("table_name").isin([t.lower() for t in frames]))
    lines = [(r.table_name.lower(), r.column_name.lower(), one_name(r.data_type), r.is_indexed) for r in wanted.collect()]
    spark = catalog.sparkSession
    stated = spark.createDataFrame(lines, "table_name string, column_name string, declared string, is_key boolean")
    counts = column_counts(frames, {(t, c): d for t, c, d, _ in lines})
    status = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("declared").isNull(), "extra")
        .when(F.col("actual") != F.col("declared"), "type")
        .when(F.col("is_key") & (F.col("nulls") > 0), "nulls")
        .otherwise("same")
    )
    both = stated.join(counts, ["table_name", "column_name"], "full_outer")
    return both.select("table_name", "column_name", "declared", "actual", "rows", "nulls", "fits", status.alias("status"))


def json_fields(df: DataFrame, column: str, *by: str) -> DataFrame:
    """(by..., field, data_type, values): the fields of JSON texts with their types and how often they occur.

    Texts are read as Variant; a text that is not a JSON object counts under field NULL, its type
    ``invalid`` where it cannot be read at all. NULL texts are left out.
    """
    spark = df.sparkSession
    read = df.filter(F.col(column).isNotNull()).select(*by, F.try_parse_json(column).alias("v"))
    kind = F.schema_of_variant("v")
    objects = read.filter(kind.startswith("OBJECT"))
    fields = objects.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(
        *by, F.col("key").alias("field"), F.schema_of_variant("value").alias("data_type")
    )
    others = read.filter(~F.coalesce(kind, F.lit("")).startswith("OBJECT")).select(
        *by, F.lit(None).cast("string").alias("field"), F.coalesce(kind, F.lit("invalid")).alias("data_type")
    )
    return fields.unionByName(others).groupBy(*by, "field", "data_type").agg(F.count(F.lit(1)).alias("values"))
