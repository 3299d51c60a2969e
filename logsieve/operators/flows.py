"""Which tables a log of statements fills from which others, directly and over any number of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.operators.relations import bare_lower, table_refs


def flow_edges(tokens: DataFrame) -> DataFrame:
    """(text_id, stmt, target, source) of CREATE TABLE or VIEW ... AS and INSERT ... SELECT.

    A name that a WITH list defines stands for what its body reads: such names are no sources where
    they follow the body. One aggregate per statement gives the target and the names.
    """
    c = F.col
    starts = (
        (c("does") == "CREATE") & (c("prev_u").isin("TABLE", "VIEW", "EXISTS") & ~c("u").isin("IF"))
        | (c("does") == "INSERT") & c("prev_u").isin("INTO", "OVERWRITE", "TABLE") & ~c("u").isin("TABLE")
    )
    target = F.min_by(F.when(starts, c("tok")), F.when(starts & (c("kind") == "path") & (c("depth") == 0), c("pos")))
    named = F.collect_list(F.when(c("cte_name").isNotNull(), F.struct(bare_lower(c("cte_name")).alias("name"), c("pos"))))
    heads = tokens.filter(c("does").isin("CREATE", "INSERT") & c("error").isNull()).groupBy("text_id", "stmt").agg(
        bare_lower(target).alias("target"), named.alias("named")
    )
    refs = table_refs(tokens).filter(c("table_name").isNotNull())
    sources = refs.groupBy("text_id", "stmt").agg(
        F.collect_set(F.struct(bare_lower(c("table_name")).alias("source"), "pos", "scope")).alias("read")
    )
    each = heads.filter(c("target").isNotNull()).join(sources, ["text_id", "stmt"]).select(
        "text_id", c("stmt").cast("int").alias("stmt"), "target", "named", F.explode("read").alias("r")
    )
    # inside its own body, which begins right after the parenthesis, the name is still that of a table
    known = F.exists("named", lambda n: (n["name"] == c("r.source")) & (n["pos"] < c("r.pos")) & (n["pos"] + 1 != c("r.scope")))
    return each.filter(~known).select("text_id", "stmt", "target", c("r.source").alias("source")).distinct()


SPREAD = 1024  # tables on either side of a block of pairs


def reach(edges: DataFrame, folder: str) -> DataFrame:
    """(table, ancestor, distance): all tables that a table is made from, with the least number of steps.

    ``edges(target, source)``. Only tables that others are filled from are walked, in rounds: each joins the pairs
    found in the round before, and no others, with the edges and keeps what no round has had; rounds are written under
    ``folder``, which cuts the lineage. Cycles end by themselves: a table may be its own ancestor, once. Only a
    count of each round reaches the driver. A table that nothing is filled from has the ancestors of its
    sources, a step further off; these pairs, most of all, are made once, when the result is read.
    """
    spark = edges.sparkSession
    direct = edges.filter("target IS NOT NULL AND source IS NOT NULL").select("target", "source").distinct()
    direct = _written(direct, f"{folder}/edges")
    read = direct.select(F.col("source").alias("target")).distinct()
    inner = _written(direct.join(read, "target", "left_semi"), f"{folder}/inner")
    last = direct.join(read, "target", "left_anti")
    ends = _written(last.join(last.groupBy("target").agg((F.count(F.lit(1)) == 1).alias("lone")), "target"), f"{folder}/ends")
    found = inner.select(F.col("target").alias("table"), F.col("source").alias("ancestor"), F.lit(1).alias("distance"))
    schema, rounds = found.schema, 0
    while True:
        rounds += 1
        place = f"{folder}/rounds/{rounds:05d}"
        found.write.mode("overwrite").parquet(place)
        last = spark.read.schema(schema).parquet(place)
        every = spark.read.schema(schema).parquet(*[f"{folder}/rounds/{i + 1:05d}" for i in range(rounds)])
        if last.isEmpty():
            break
        step = last.join(inner, last.ancestor == inner.target).select(
            "table", F.col("source").alias("ancestor"), F.lit(rounds + 1).alias("distance")
        )
        found = step.distinct().join(every.select("table", "ancestor"), ["table", "ancestor"], "left_anti")
    lone, several = ends.filter("lone"), ends.filter("NOT lone")
    # by one source a pair is found once, but for a source that is its own ancestor
    of_one = _one_further(lone, every.filter(F.col("table") != F.col("ancestor"))).unionByName(_one_step(lone))
    of_several = _one_further(several, every).unionByName(_one_step(several)).groupBy("table", "ancestor").agg(F.min("distance").alias("distance"))
    return every.unionByName(of_one).unionByName(of_several)


def _written(df: DataFrame, place: str) -> DataFrame:
    df.write.mode("overwrite").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def _one_step(ends: DataFrame) -> DataFrame:
    return ends.select(F.col("target").alias("table"), F.col("source").alias("ancestor"), F.lit(1).alias("distance"))


def _one_further(ends: DataFrame, known: DataFrame) -> DataFrame:
    """The ancestors of each target's sources. What many targets share with many ancestors is made in blocks, each
    of some targets and some ancestors of one source, so that no source is one task's work."""
    parts = lambda c: F.ceil(F.count(F.lit(1)) / SPREAD).alias(c)
    sizes = ends.groupBy("source").agg(parts("across")).join(
        known.groupBy(F.col("table").alias("source")).agg(parts("along")), "source"
    )
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = ends.join(sizes, "source").select("source", "target", part("target", "across").alias("p"), each("along").alias("q"))
    right = known.withColumnRenamed("table", "source").join(sizes, "source").select(
        "source", "ancestor", "distance", each("across").alias("p"), part("ancestor", "along").alias("q")
    )
    return left.hint("merge").join(right, ["source", "p", "q"]).select(
        F.col("target").alias("table"), "ancestor", (F.col("distance") + 1).alias("distance")
    )
