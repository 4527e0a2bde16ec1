"""Exact percentiles by counts of value ranges.

A percentile is one or two order statistics. Each is looked for in a range, at first from the smallest to the largest value: a pass over
the rows counts them in equal parts of the range (counts are combined in every task before the shuffle), and the part that
holds the rank is the next range. When few rows are left in it, their values are counted one by one and the rank is read off. No task
or group ever holds the values of a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept

#: Parts of a range, rows of a range whose values are counted one by one, and ranges that are sent to every task at most.
PARTS, FEW, BROADCAST_ROWS = 1024, 100_000, 50_000


def tall(df: DataFrame, by: str, values: list[str]) -> DataFrame:
    """key (the group), name, value of every number in `values`; nulls are no values."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values]))
    return df.select(F.col(by).alias("key"), each.alias("x")).select("key", "x.name", "x.value").filter("value IS NOT NULL")


def met(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows with the ranges of their group that they lie in. Ranges are few for each group; they are sent to the rows while they are few in all."""
    few = ranges.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    r = ranges.select(F.col("key").alias("_key"), F.col("name").alias("_name"), "low", "high")
    on = F.col("key").eqNullSafe(F.col("_key")) & (F.col("name") == F.col("_name")) & F.col("value").between(F.col("low"), F.col("high"))
    joined = rows.join(F.broadcast(r), on) if few else rows.hint("merge").join(r.hint("merge"), on)
    return joined.drop("_key", "_name")


def part_of(value: Column, low: Column, high: Column) -> Column:
    """The part of a range that a value lies in; halves first, as the difference of two doubles may be infinite.

    Where the range has no finite length that can be divided, its ends are parts of their own and the rest is one.
    """
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    length = high / 2 - low / 2
    apart = F.when(value == low, 0).when(value == high, PARTS - 1).otherwise(1)
    equal = F.least(F.floor(F.try_divide(value / 2 - low / 2, length) * PARTS), F.lit(PARTS - 1))
    return F.when(finite(low) & finite(high) & (length > 0), equal).otherwise(apart).cast("int")


def order_statistics(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, name, rank, value: the values at the ranks (from 0) that `wanted` (key, name, rank, low, high, n) asks for; low, high and n are the group's least and largest value and its count."""
    names, done = ["key", "name", "low", "high"], []
    open_ranks = wanted.withColumn("before", F.lit(0).cast("long"))
    while True:
        few = open_ranks.filter(F.col("n") <= FEW)
        many = open_ranks.filter(F.col("n") > FEW)
        done.append(read_off(rows, few))
        if many.isEmpty():
            return reduce(DataFrame.unionByName, done)
        inside = met(rows, many.select(*names).distinct()).withColumn("part", part_of(F.col("value"), F.col("low"), F.col("high")))
        counts = inside.groupBy(*names, "part").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
        next_ranks = kept(at_ranks(many, counts, "part").select("key", "name", "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("before") + F.col("upto") - F.col("_n")).alias("before"), F.col("_n").alias("n")))
        done.append(next_ranks.filter("low = high").select("key", "name", "rank", F.col("low").alias("value")))
        open_ranks = next_ranks.filter("low < high")


def at_ranks(ranks: DataFrame, counts: DataFrame, order: str) -> DataFrame:
    """The row of `counts` that each rank falls on, by running counts inside its range: PARTS rows, or FEW values, at most."""
    names = ["key", "name", "low", "high"]
    sums = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*names).orderBy(order))).withColumnRenamed("n", "_n")
    asked = ranks.select(*[F.col(c).alias(f"_{c}") for c in names], "rank", "before")
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), names, F.lit(True))
    at = (F.col("rank") >= F.col("before") + F.col("upto") - F.col("_n")) & (F.col("rank") < F.col("before") + F.col("upto"))
    return asked.hint("merge").join(sums.hint("merge"), same).filter(at)


def read_off(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """The values at ranks of ranges with few rows, by counts of each value."""
    counts = met(rows, ranks.select("key", "name", "low", "high").distinct()).groupBy("key", "name", "low", "high", "value").agg(F.count("*").alias("n"))
    return kept(at_ranks(ranks, counts, "value").select("key", "name", "rank", "value"))


def percentiles(df: DataFrame, by: str, values: list[str], shares: dict[str, float]) -> DataFrame:
    """`by` and `<value>_<name>` for each of `values` and `shares` (name: share from 0 to 1), between ranks in proportion.

    Null values are left out; a group without values has nulls, and a null group is a group. NaN is larger than all numbers.
    """
    groups = df.select(F.col(by)).distinct()
    rows = tall(df, by, values)
    sizes = kept(rows.groupBy("key", "name").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")))
    place = F.col("share") * (F.col("n") - 1)
    asked = sizes.withColumn("s", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(p).alias("share")) for k, p in shares.items()])))
    asked = asked.select("key", "name", "low", "high", "n", "s.label", "s.share").select("key", "name", "low", "high", "n", "label", place.alias("place"))
    asked = asked.withColumns({"under": F.floor("place").cast("long"), "over": F.ceil("place").cast("long")})
    wanted = asked.select("key", "name", "low", "high", "n", F.explode(F.array_distinct(F.array("under", "over"))).alias("rank")).distinct()
    found = order_statistics(rows, wanted)
    for side in ("under", "over"):
        f = found.select(F.col("key").alias("_key"), F.col("name").alias("_name"), F.col("rank").alias("_rank"), F.col("value").alias(f"{side}_value"))
        on = F.col("key").eqNullSafe(F.col("_key")) & (F.col("name") == F.col("_name")) & (F.col(side) == F.col("_rank"))
        asked = asked.hint("merge").join(f.hint("merge"), on).drop("_key", "_name", "_rank")
    value = F.when(F.col("under") == F.col("over"), F.col("under_value")).otherwise((F.col("over") - F.col("place")) * F.col("under_value") + (F.col("place") - F.col("under")) * F.col("over_value"))
    columns = [F.max(F.when((F.col("name") == v) & (F.col("label") == k), value)).alias(f"{v}_{k}") for v in values for k in shares]
    wide = asked.groupBy("key").agg(*columns)
    return groups.hint("merge").join(wide.hint("merge"), groups[by].eqNullSafe(wide["key"]), "left").drop("key")
