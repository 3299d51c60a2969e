"""Work on ranges of rows: a page of a total order, and the blocks of a table that a filter can skip."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDS = 63  # cuts a round makes; a round leaves about a 64th of the rows
SAMPLED = 16  # sampled keys per cut
AT_ONCE = 100_000  # so few rows may be sorted by one task

Order = list[tuple[str, bool]]


def _before(order: Order, bound) -> Column:
    """The row comes strictly before the bound; NULLs first where ascending, last where descending."""
    out = F.lit(False)
    for name, ascending in reversed(order):
        # structs of one field compare without three-valued logic, NULL as the least value
        own, other = F.struct(F.col(name).alias("v")), F.struct(F.lit(bound[name]).alias("v"))
        out = (own < other if ascending else own > other) | ((own == other) & out)
    return out


def _sorting(order: Order) -> list[Column]:
    return [F.col(n).asc() if ascending else F.col(n).desc() for n, ascending in order]


def _cuts(df: DataFrame, order: Order) -> list:
    """At most BOUNDS rows of the order's columns, evenly spread over a sample by key hash; no data but these reach the driver."""
    names = [n for n, _ in order]
    keys = df.select(*names)
    hashed = keys.withColumn("_at", F.xxhash64(*names)).orderBy("_at").limit(BOUNDS * SAMPLED)
    return hashed.drop("_at").distinct().orderBy(*_sorting(order)).collect()[SAMPLED // 2 :: SAMPLED][:BOUNDS]


def page(df: DataFrame, order: Order, size: int, number: int, at_once: int = AT_ONCE) -> DataFrame:
    """L026: page ``number`` (from 0) of the rows in a total order, with the number of rows without a bound.

    ``order`` lists (column, ascending). Rows are counted between a few sampled cuts; the prefix sums of
    the counts tell between which cuts the page lies, and the next round looks at those rows alone. Each
    round is one scan with a map-side aggregate; the last one sorts at most about ``at_once`` rows, however
    deep the page. Rows equal in all columns of the order cannot be cut: which of them a page shows
    is open, as with LIMIT. A page beyond the end is empty.
    """
    skip, rest, total = size * number, df, df.count()
    left = total
    while left > at_once and skip < total:
        cuts = _cuts(rest, order)
        passed = reduce(lambda a, b: a + b, [(~_before(order, c)).cast("int") for c in cuts], F.lit(0))
        counted = {r.part: r.n for r in rest.groupBy(passed.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
        rows = sum(counted.values())
        seen, wanted = 0, []
        for part in sorted(counted):
            if seen < skip + size and seen + counted[part] > skip:
                wanted.append((part, seen))
            seen += counted[part]
        first, last = wanted[0][0], wanted[-1][0]
        left = sum(counted[p] for p, _ in wanted)
        skip -= wanted[0][1]
        if first > 0:
            rest = rest.filter(~_before(order, cuts[first - 1]))
        if last < len(cuts):
            rest = rest.filter(_before(order, cuts[last]))
        if left == rows:
            break
    shown = rest.orderBy(*_sorting(order)).offset(skip).limit(size)
    return shown.withColumn("all_rows", F.lit(total).cast("bigint"))


def zones(df: DataFrame, column: str, rows: int) -> DataFrame:
    """Zone map of a table read from files: least and greatest value per block of ``rows`` rows of a file.

    A block whose values are all NULL has no bounds. The result has one row per block; store it
    beside the table and ask it instead of the rows.
    """
    block = F.floor(F.col("_metadata.row_index") / rows)
    return (
        df.select(F.col("_metadata.file_path").alias("file"), block.alias("block"), column)
        .groupBy("file", "block")
        .agg(F.min(column).alias("least"), F.max(column).alias("most"), F.count(F.lit(1)).alias("rows"))
    )


def skipped(zone_map: DataFrame, low: Column, high: Column) -> DataFrame:
    """L012, L003: blocks in all, and blocks and rows that ``low <= column < high`` need not read.

    The same condition hidden in a function of the column reads every block: it has no range to
    hold against the bounds.
    """
    out = F.coalesce((F.col("most") < low) | (F.col("least") >= high), F.lit(True))
    return zone_map.agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(out).alias("skipped_blocks"),
        F.coalesce(F.sum(F.when(out, F.col("rows"))), F.lit(0)).alias("skipped_rows"),
    )
