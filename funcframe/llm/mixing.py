"""Mixing sources to target weights with DataFrame functions alone: random keys, distributed prefix sums, exact budgets.

Defined cases. A null or empty text has size 0 and takes nothing. A null source is a source of its own and sorts last. A
null id hashes as the empty string. Rows that repeat are taken one by one; rows with equal keys go by size and then by a
hash of all their columns. An empty table gives an empty result. All columns travel in one struct, so names cannot clash.

No stage gathers a source in one task: a source is cut into small ranges of its random keys, sums of the ranges give
each range its offset, and only within a range are rows sorted. A range with many rows, as one id in many rows makes, is cut
by a hash of all columns, and a piece of it with many equal rows by their places, so rows of one id are many tasks' work.
What meets in one task is one row for each source. Words are counted once: rows, sizes and ranges are written and reread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funcframe.llm.common import WORD, materialise, table

#: Weights of the sources in order of their names, repeating; a source is used at most so many times.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Rows in a range of keys, and ranges whose sums are added up together.
RANGE_ROWS, GROUP_RANGES = 256, 1024
#: A range, or a piece of one, of more rows is cut into pieces of about so many.
MOST_ROWS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def targets(totals: DataFrame) -> DataFrame:
    """``target`` for rows (absent, source, source_size): by weight, at most ``MOST_EPOCHS`` times the size.

    With sources in order of limit / weight, those that stop at their limit come first; the level of all others is what
    then is left for each unit of weight. The first source whose limit reaches its level ends the stopped ones.
    """
    by_name = Window.orderBy("absent", "source")
    weights = F.array(*map(F.lit, WEIGHTS))
    w = totals.withColumn("weight", F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(WEIGHTS)) + 1))
    w = w.withColumn("full", MOST_EPOCHS * F.col("source_size")).withColumn("edge", F.col("full").cast("double") / F.col("weight"))
    before = Window.orderBy("edge", "absent", "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    w = w.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0)))
    w = w.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", F.col("left").cast("double") / F.col("left_weight"))
    level = F.min(F.when(F.col("level") <= F.col("edge"), F.struct("edge", "absent", "source", "level"))).over(every)
    return w.select("absent", "source", "source_size", F.least(F.col("full").cast("double"), F.coalesce(level["level"], F.lit(0.0)) * F.col("weight")).alias("target"))


def _cut(rows: DataFrame, by: list[str], spread: Column, piece: str) -> DataFrame:
    """``rows`` with a column ``piece``: 0, or for groups of more than ``MOST_ROWS`` rows the range of ``spread``."""
    large = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > MOST_ROWS)
    share = (F.shiftrightunsigned(spread, 33).cast("double") / F.lit(float(1 << 31)))
    pieces = F.floor(share * F.ceil(F.col("many") / F.lit(float(MOST_ROWS)))).cast("long")
    return rows.join(large, by, "left").withColumn(piece, F.coalesce(pieces, F.lit(0).cast("long"))).drop("many")


def plan(documents: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of ``keep``, by default all columns), size, source_size, target and the words that the mix takes."""
    keep = documents.columns if keep is None else keep
    key = F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary"))
    base = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        key.alias("key"),
        F.col(f"`{source}`").isNull().alias("absent"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"),
        n_words(F.col(f"`{text}`")).alias("size"),
        F.xxhash64(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in keep]).alias("content"),
        F.xxhash64(F.monotonically_increasing_id()).alias("place"),
    )
    base = materialise(base, "sizes")
    count = base.select(F.lit(1)).count()
    ranges = max(1, -(-count // RANGE_ROWS))
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32))
    base = base.withColumn("part", part)
    name = ["absent", "source"]
    if not base.groupBy(*name, "part").count().where(F.col("count") > MOST_ROWS).isEmpty():
        base = _cut(base, [*name, "part"], F.col("content"), "piece")
        base = _cut(base, [*name, "part", "piece"], F.col("place"), "bit")
    else:
        base = base.withColumns({"piece": F.lit(0).cast("long"), "bit": F.lit(0).cast("long")})
    cell = ["part", "piece", "bit"]
    sums = base.groupBy(*name, *cell).agg(F.sum("size").alias("size"))
    sums = sums.withColumn("group", F.floor(F.col("part") / GROUP_RANGES))
    groups = sums.groupBy(*name, "group").agg(F.sum("size").alias("size"))
    so_far = (Window.unboundedPreceding, -1)
    lead = F.coalesce(F.sum("size").over(Window.partitionBy(*name).orderBy("group").rowsBetween(*so_far)), F.lit(0))
    totals = groups.groupBy(*name).agg(F.sum("size").alias("source_size"))
    groups = groups.select(*name, "group", lead.alias("lead")).join(targets(totals), name)
    own = F.coalesce(F.sum("size").over(Window.partitionBy(*name, "group").orderBy(*cell).rowsBetween(*so_far)), F.lit(0))
    offsets = sums.select(*name, "group", *cell, own.alias("own")).join(groups, [*name, "group"])
    offsets = offsets.select(*name, *cell, (F.col("lead") + F.col("own")).alias("offset"), "source_size", "target")

    order = Window.partitionBy(*name, *cell).orderBy("key", "size", "content").rowsBetween(*so_far)
    placed = base.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).join(offsets, [*name, *cell])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(documents: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself, in the documents' columns: a row for each time that a document is taken, cut after the last word
    taken where the budget ends within it."""
    p = plan(documents, text)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    over = F.col("taken") - whole * F.col("size")
    body = F.col("row")[text]
    cut = F.when(over > 0, F.array(first_words(body, over))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat(body, whole), cut)
    rows = p.where("taken > 0").select("row", F.explode(texts).alias("body"))
    return rows.select(*[F.col("body").alias(c) if c == text else F.col("row")[c].alias(c) for c in documents.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS absent, coalesce(source, '') AS source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT absent, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, 3 * source_size AS full_size, CASE (row_number() OVER (ORDER BY absent, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
e AS (SELECT *, CAST(full_size AS DOUBLE) / weight AS edge FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(full_size) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
      FROM e WINDOW b AS (ORDER BY edge, absent, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE level <= edge ORDER BY edge, absent, source LIMIT 1),
t AS (SELECT absent, source, source_size, least(CAST(full_size AS DOUBLE), coalesce((SELECT level FROM f), 0.0) * weight) AS target FROM e),
p AS (SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
             coalesce(sum(size) OVER (PARTITION BY absent, source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t USING (absent, source)),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM q
"""
