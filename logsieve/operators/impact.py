"""Does a finding matter on the data? Checks that compare the advised form with the original."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
    T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def _counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """Rows (form, rows): how many rows meet each condition, in one scan."""
    one = df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    return one.unpivot([], list(conditions), "form", "rows")


def _count(df: DataFrame, form: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(form).alias("form"), "rows")


def _bytes(field: T.StructField) -> Column:
    c, kind = F.col(field.name), field.dataType
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.sum(F.octet_length(c)).cast("bigint")
    if isinstance(kind, T.DecimalType):
        return F.count(c) * (8 if kind.precision <= 18 else 16)
    width = _WIDTH.get(type(kind))
    return F.count(c) * width if width else F.lit(None).cast("bigint")


def column_bytes(df: DataFrame, name: str) -> DataFrame:
    """L001: bytes each column holds, so what reading fewer columns saves; NULL for nested types."""
    one = df.agg(*[_bytes(f).cast("bigint").alias(f.name) for f in df.schema.fields])
    return one.unpivot([], df.columns, "column_name", "bytes").withColumn("table_name", F.lit(name))


def or_split(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """L003: rows of ``a OR b``, of its split into disjoint branches, and the overlap."""
    not_first = ~F.coalesce(first, F.lit(False))
    split = df.filter(first).unionByName(df.filter(second & not_first))
    return _counts(df, either=first | second, overlap=first & second).unionByName(
        _count(split, "union_all")
    )


def like_forms(df: DataFrame, column: str, text: str, by: str) -> DataFrame:
    """L005: matches of the anchored and the unanchored forms of a pattern."""
    c = F.col(column)
    return df.groupBy(by).agg(
        F.count_if(c.startswith(text)).alias("prefix"),
        F.count_if(c.endswith(text)).alias("suffix"),
        F.count_if(c.contains(text)).alias("contains"),
    )


def distinct_gain(df: DataFrame, keys: list[str]) -> DataFrame:
    """L006, L013: what DISTINCT over ``keys`` removes."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows")
    ).select(F.lit(",".join(keys)).alias("keys"), "rows", "distinct_rows")


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``left_key NOT IN (right_key)`` with its NULL rules, as an anti join of any size.

    Spark's own plan broadcasts the right side. Here one row tells whether the right side is
    empty (all rows stay) or holds a NULL (none stays); the rest is a plain anti join.
    """
    facts = right.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(right_key).isNull()).alias("nulls")
    )
    keep = (F.col("n") == 0) | ((F.col("nulls") == 0) & F.col(left_key).isNotNull())
    unmatched = not_exists(left, right, left_key, right_key)
    return unmatched.join(F.broadcast(facts), keep, "left_semi")  # one row


def not_exists(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    keys = right.select(F.col(right_key).alias("right_key")).distinct()  # hot keys become one row
    return left.join(keys, F.col(left_key) == F.col("right_key"), "left_anti")


def not_in_check(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """L008: rows of both forms and the NULLs that make them differ."""
    n = F.count(F.lit(1))
    a = left.groupBy(F.col(left_key).alias("k")).agg(n.alias("a"))  # each side is read once, and reduced before it moves
    b = right.groupBy(F.col(right_key).alias("k")).agg(n.alias("b"))
    both = a.alias("l").join(b.alias("r"), F.col("l.k").eqNullSafe(F.col("r.k")), "full_outer")
    total = lambda c, cond=F.lit(True): F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    key = F.coalesce("l.k", "r.k")
    facts = both.agg(
        total("a").alias("rows"), total("a", F.col("b").isNull() & key.isNotNull()).alias("alone"),
        total("a", key.isNull()).alias("left_nulls"), total("b", key.isNull()).alias("right_nulls"), total("b").alias("others"),
    )
    kept = F.when(F.col("others") == 0, F.col("rows")).when(F.col("right_nulls") > 0, F.lit(0)).otherwise(F.col("alone"))
    forms = facts.select(
        kept.alias("not_in"), (F.col("alone") + F.col("left_nulls")).alias("not_exists"), "left_nulls", "right_nulls"
    )
    return forms.unpivot([], forms.columns, "form", "rows")


def scalar_as_join(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, *aggs: Column) -> DataFrame:
    """L010, L024: a correlated scalar subquery as a left join with the aggregated inner side."""
    per_key = inner.groupBy(inner_key).agg(*aggs)
    return outer.join(per_key, F.col(outer_key) == F.col(inner_key), "left").drop(inner_key)


def union_dedup(left: DataFrame, right: DataFrame) -> DataFrame:
    """L011: rows UNION ALL returns and rows UNION returns."""
    both = left.union(right)
    groups = both.groupBy(*both.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("union_all"), F.count(F.lit(1)).alias("union_rows")
    ).withColumn("removed", F.col("union_all") - F.col("union_rows"))


def year_range(column: str, year: int) -> Column:
    """L012: ``year(column) = year`` as a range on the bare column, which can be pushed down."""
    c = F.col(column)
    first, end = year_bounds(year)
    return (c >= first) & (c < end)


def year_bounds(year: int) -> tuple[Column, Column]:
    first, end = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (year, year + 1))
    return first, end


def global_having(df: DataFrame, condition: Column, *aggs: Column) -> DataFrame:
    """L014: HAVING without GROUP BY is a filter on the single row of a global aggregate."""
    return df.agg(*aggs).filter(condition)


def self_comparison(df: DataFrame, column: str) -> DataFrame:
    """L015: ``c = c`` keeps the rows where c is not NULL."""
    c = F.col(column)
    return _counts(df, all_rows=F.lit(True), self_equal=c == c, not_null=c.isNotNull(), lost=c.isNull())


def join_fanout(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """L016: rows per key on both sides and the pairs a join on it makes, from counts alone."""
    n = F.count(F.lit(1))
    a = left.filter(F.col(left_key).isNotNull()).groupBy(F.col(left_key).alias("key")).agg(n.alias("left_rows"))
    b = right.filter(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("key")).agg(n.alias("right_rows"))
    return a.join(b, "key").withColumn("pairs", F.col("left_rows") * F.col("right_rows"))


def fanout_totals(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows a join makes with its condition and without it."""
    keyed = join_fanout(left, right, left_key, right_key).agg(F.sum("pairs").alias("rows"))
    sizes = _count(left, "left").unionByName(_count(right, "right"))
    cartesian = sizes.agg(
        (F.max(F.when(F.col("form") == "left", F.col("rows"))) * F.max(F.when(F.col("form") == "right", F.col("rows")))).alias("rows")
    )
    return keyed.select(F.lit("joined").alias("form"), "rows").unionByName(
        cartesian.select(F.lit("cartesian").alias("form"), "rows")
    )


def top_by_name(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """L017: the first n rows by named columns with a total order, numbered."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # n rows


def schema_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """L020: columns missing, extra or of another type family."""
    e = expected.select("column_name", F.col("type_family").alias("expected"))
    a = actual.select("column_name", F.col("type_family").alias("actual"))
    return e.join(a, "column_name", "full_outer").withColumn(
        "status",
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("expected").isNull(), "extra")
        .when(F.col("expected") != F.col("actual"), "type")
        .otherwise("same"),
    )


def castable_share(df: DataFrame, columns: dict[str, Column], to: str = "int") -> DataFrame:
    """L021: how many values of each string column would survive the implicit cast."""
    counted = [
        F.struct(F.lit(n).alias("column_name"), F.count(c).alias("n_values"), F.count(c.try_cast(to)).alias("castable"))
        for n, c in columns.items()
    ]
    return df.agg(F.array(*counted).alias("all")).select(F.inline("all"))


def column_layout(df: DataFrame, columns: list[str]) -> DataFrame:
    """L022: distinct values, NULLs, the most frequent value and the range of filter columns, and advice.

    Each column is counted by its own values first, so a value that fills a third of the table is one row
    from then on, and the range keeps the order of the column's type. Advice: few values make partitions;
    with many, a filter profits from buckets or sorting unless one value fills most of the table.
    """
    out = None
    for name in columns:
        per_value = df.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        one = per_value.agg(
            F.sum("n").alias("rows"),
            F.count("value").alias("distinct_values"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_rows"),
            F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top_rows"),
            F.min("value").cast("string").alias("min_value"),
            F.max("value").cast("string").alias("max_value"),
        ).withColumn("column_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    few, filled = F.col("distinct_values") <= 50, F.col("top_rows") * 2 > F.col("rows")
    return out.withColumn("advice", F.when(few, "partition").when(filled, "none").otherwise("bucket"))


def null_comparison(df: DataFrame, column: str) -> DataFrame:
    """L023: rows of ``= NULL`` and of ``IS NULL``."""
    c = F.col(column)
    return _counts(df, equals_null=c == F.lit(None), not_equals_null=c != F.lit(None), is_null=c.isNull())


def guarded_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """L002: rows a statement without WHERE touches, and those the predicate would protect."""
    kept = ~F.coalesce(predicate, F.lit(False))
    return _counts(df, touched=F.lit(True), meant=predicate, protected=kept)


def comma_join(left: DataFrame, right: DataFrame, on: Column, by: str) -> DataFrame:
    """L018: rows per value of ``by`` of the comma form and of the join with its condition.

    The optimiser moves the condition of the comma form into the join, so no product is made.
    """
    n = F.count(F.lit(1))
    comma = left.join(right).where(on).groupBy(by).agg(n.alias("comma_rows"))
    joined = left.join(right, on).groupBy(by).agg(n.alias("join_rows"))
    return comma.join(joined, by, "full_outer")
