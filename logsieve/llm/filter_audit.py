"""Filter interaction audit: what every order of a few filters removes at every step.

A row is known by the set (mask) of the filters that it fails; rows of equal mask and part are counted
together. The orders, sorted, are numbered by their Lehmer rank. All orders that begin with the same
filters have consecutive ranks, so a mask is lost at step s to filter f in whole intervals of ranks: those
of the beginnings that end in f, which the mask fails, after s - 1 filters that it passes. Its counts are
added where such an interval starts and taken off where it ends; a running sum over the ranks
gives the rows lost at each step of each order.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_FILTERS = 6  # 720 orders, 6 steps


def orders(letters: str) -> Iterator[tuple[int, str]]:
    """(Lehmer rank, order) of all orders, least first."""
    for rank in range(factorial(len(letters))):
        left, rest, order = sorted(letters), rank, ""
        for places in range(len(letters) - 1, -1, -1):
            digit, rest = divmod(rest, factorial(places))
            order += left.pop(digit)
        yield rank, order


def intervals(count: int) -> Iterator[tuple[int, int, int, int]]:
    """(mask, step, first rank, number of ranks): where a mask is lost, for `count` filters, bit i the i-th."""

    def begin(mask: int, used: tuple[int, ...], first: int) -> Iterator[tuple[int, int, int, int]]:
        span = factorial(count - len(used) - 1)
        for digit, f in enumerate(i for i in range(count) if i not in used):
            if mask >> f & 1:
                yield mask, len(used) + 1, first + digit * span, span
            else:
                yield from begin(mask, (*used, f), first + digit * span)

    for mask in range(1, 1 << count):
        yield from begin(mask, (), 0)


def audit(masks: DataFrame, letters: str, weights: tuple[str, ...]) -> DataFrame:
    """Per part, order and step what was removed, kept and lost.

    masks(part, mask, n, *weights): counts of rows that fail exactly the filters in `mask` (bit i for
    letters[i], letters in ascending order); several rows of a part and mask are added. Gives (part,
    filter_order, step, kept, removed, redundant, unique_fails, *<weight>_lost, shapley), a row
    for each part that `masks` has, order and step, zeros included; without parts no row. A null part or
    count is the caller's to fill.
    """
    if list(letters) != sorted(set(letters)) or len(letters) > MOST_FILTERS:
        raise ValueError(f"up to {MOST_FILTERS} different letters in ascending order")
    spark, k = masks.sparkSession, len(letters)
    counts = masks.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", *weights)))
    # both have a size that depends on the number of filters alone
    spans = F.broadcast(spark.createDataFrame(list(intervals(k)), "mask int, step int, first int, ranks int"))
    named = F.broadcast(spark.createDataFrame(list(orders(letters)), "rank int, filter_order string"))

    ends = F.explode(F.array(
        F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")),
        F.struct((F.col("first") + F.col("ranks")).alias("rank"), F.lit(-1).alias("sign")),
    ))
    changes = (
        counts.join(spans, "mask").select("part", "step", "n", *weights, ends.alias("end"))
        .groupBy("part", "step", F.col("end.rank").alias("rank"))
        .agg(*(F.sum(F.col(c) * F.col("end.sign")).alias(c) for c in ("n", *weights)))
    )
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"))
    ranked = parts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(k) - 1)))).join(named, "rank")
    grid = ranked.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    along = Window.partitionBy("part", "step").orderBy("rank")
    summed = grid.join(changes, ["part", "step", "rank"], "left").select(
        "part", "total", "step", "rank", "filter_order", F.substring("filter_order", F.col("step"), F.lit(1)).alias("letter"),
        F.coalesce(F.sum("n").over(along), F.lit(0)).alias("removed"),
        *(F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"{c}_lost") for c in weights),
    )

    bit = F.explode(F.array(*(F.struct(F.lit(c).alias("letter"), F.lit(1 << i).alias("bit")) for i, c in enumerate(letters))))
    failing = counts.select("part", "mask", "n", bit.alias("of")).groupBy("part", "of.letter").agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("of.bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("mask") == F.col("of.bit"), F.col("n")).otherwise(0)).alias("unique_fails"),
    )
    worth = summed.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    by_letter = failing.join(worth, ["part", "letter"])
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return summed.join(by_letter, ["part", "letter"]).select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(so_far)).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *(f"{c}_lost" for c in weights), "shapley",
    )


def text_fails(text: Column) -> list[Column]:
    """Whether a text fails A (fewer than 100 words), B (under 80 % different words), C (over 10 % A-Z), D (symbols)."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, capitals = F.size(words), F.regexp_count(text, F.lit("[A-Z]"))
    return [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike(r"[#$%&*|]")]


def document_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic) for the filters A to D of text_fails and E, a copy of an earlier text.

    A null text is empty, a null part the empty string. A row fails E if some row of the table has the same
    text and a smaller id; rows with a null id are neither smaller nor larger than others, so they never
    fail it and make no other row fail it. Repeated rows count each. A row is good (toxic) if some label row of its
    id has quality (toxic) 1; null labels and labels of a null id say nothing. Texts are compared by
    SHA-256. Equal rows are combined before each shuffle, and copies of one text by part, so that
    a text or source that a third of the rows have is no hot key.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_fails(text))), F.lit(0))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("name"), mask.alias("mask"),
    ).groupBy("id", "part", "name", "mask").agg(F.count("*").alias("n"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    told = rows.where("id IS NOT NULL").join(known, "id", "left").unionByName(rows.where("id IS NULL"), allowMissingColumns=True)
    # one row per text, part and labels: all rows of it, those without an id, and those of its least id
    same = told.groupBy("name", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
    )
    first = F.min("least.id").over(Window.partitionBy("name"))
    passing = F.col("unnamed") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    split = same.withColumn("passing", passing).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), F.col("passing").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
    )).alias("s")).where("s.n > 0")
    counted = lambda c: F.sum(F.when(F.col(c), F.col("s.n")).otherwise(0)).alias(c)
    return split.groupBy("part", "s.mask").agg(F.sum("s.n").alias("n"), counted("good"), counted("toxic"))


#: The same for documents and labels in DuckDB's SQL, order by order and without intervals.
AUDIT_SQL = r"""
WITH l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    concat(CASE WHEN len(words) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
      CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' END,
      CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN w.doc_id > least THEN 'E' END) AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
p AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS earlier FROM s),
m AS (
  SELECT part, filter_order, step, letter, sum(n) AS total,
    sum(CASE WHEN contains(fails, letter) THEN n ELSE 0 END) AS failing,
    sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, letter) AND translate(earlier, fails, '') = earlier THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, letter) AND translate(earlier, fails, '') = earlier THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, letter) AND translate(earlier, fails, '') = earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, p GROUP BY ALL)
SELECT part, filter_order, step, CAST(total - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step) AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(failing - removed AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM m
"""
