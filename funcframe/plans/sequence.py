"""Order at scale: ordinals by range partitions and prefix sums, neighbours by overlapping blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funcframe.scratch import materialise

#: Rows of a block, within which order is worked out by one task.
BLOCK = 1 << 15
_PLACE = "__place"


def with_ordinal(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Adds the row's number from 0 in the order of ``keys``. Only one row a partition meets in one task."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_PLACE, F.monotonically_increasing_id())
    ordered = materialise(ordered, "ordered")  # so that counts and rows come of the same partitions
    part = F.shiftright(_PLACE, 33)
    counts = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    lead = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__lead"))
    placed = ordered.withColumn("__part", part).join(F.broadcast(lead), "__part")  # a row for each partition
    return placed.withColumn(name, F.col("__lead") + F.col(_PLACE).bitwiseAND((1 << 33) - 1)).drop("__part", "__lead", _PLACE)


def with_neighbours(df: DataFrame, ordinal: str, before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """Adds values of the row before and of the row after, by one shuffle. Blocks hold a row of each neighbour, too."""
    block, at = F.floor(F.col(ordinal) / BLOCK), F.col(ordinal) % BLOCK
    copy = lambda step, guest: F.struct((block + step).alias("block"), F.lit(guest).alias("guest"))
    none = F.array().cast("array<struct<block:bigint,guest:boolean>>")
    copies = F.concat(
        F.array(copy(0, False)),
        F.when(at == BLOCK - 1, F.array(copy(1, True))).otherwise(none) if before else none,
        F.when(at == 0, F.array(copy(-1, True))).otherwise(none) if after else none,
    )
    w = Window.partitionBy("__copy.block").orderBy(ordinal)
    made = {k: F.lag(v).over(w) for k, v in before.items()} | {k: F.lead(v).over(w) for k, v in after.items()}
    return df.withColumn("__copy", F.explode(copies)).withColumns(made).where("NOT __copy.guest").drop("__copy")


def behind(df: DataFrame, parts: list[tuple[Column, bool]], n: int) -> DataFrame:
    """All rows but the first n in the order of ``parts`` (a key, and whether it falls), without sorting the others.

    The n-th row is found by a top-n of each partition, and others are held against its key. Rows with this very key, of
    which some may be among the first n, are numbered.
    """
    sort = [c.desc() if falls else c for c, falls in parts]
    keyed = df.select(*[c.alias(f"__e{i}") for i, (c, _) in enumerate(parts)])
    named = [F.col(f"__e{i}") for i in range(len(parts))]
    first = keyed.orderBy(*[c.desc() if falls else c for c, (_, falls) in zip(named, parts, strict=True)]).limit(n)
    edge = F.struct(*named)
    last = first.groupBy(*named).agg(F.count(F.lit(1)).alias("__ties")).orderBy(*[c if falls else c.desc() for c, (_, falls) in zip(named, parts, strict=True)]).limit(1)
    rows = df.join(F.broadcast(last.select(edge.alias("__edge"), "__ties")))  # one row
    later, same = F.lit(False), F.lit(True)
    for i, (c, falls) in enumerate(parts):
        e = F.col("__edge")[f"__e{i}"]
        beyond = F.coalesce(c < e, c.isNull() & e.isNotNull()) if falls else F.coalesce(c > e, e.isNull() & c.isNotNull())
        later, same = later | (same & beyond), same & c.eqNullSafe(e)
    marked = rows.withColumn("__same", same).where(later | F.col("__same"))
    tied = marked.where("__same").withColumn("__k", F.row_number().over(Window.partitionBy("__same").orderBy(*sort))).where("__k > __ties").drop("__k")
    return marked.where("NOT __same").unionByName(tied).drop("__same", "__edge", "__ties")
