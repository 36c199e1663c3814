"""Places in long orders without a task that sees a whole group.

A table is laid out once by ranges of (group, order): Spark samples bounds, each range is one task and one folder. A
row's place is its place in its range, plus the rows of its group in earlier ranges. Those carried counts come from a
count of each range; only the group that a range begins in the middle of has one, so there are at most as many as
ranges, and they are broadcast. Only a few ranges need to be read for a few places."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

PART = "_part"


def met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left joined with a broadcast of right on null-safe keys; right is of one row a range at most."""
    names = {k: f"_right_{k}" for k in keys}
    other = right.withColumnsRenamed(names)
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[n]) for k, n in names.items()])
    return left.join(F.broadcast(other), on, how).drop(*names.values())


@dataclass
class Ranges:
    """`rows` with the number of their range; `groups` and a total `order` within them."""

    rows: DataFrame
    groups: list[str]
    order: list

    def where(self, condition: Column) -> Ranges:
        return Ranges(self.rows.where(condition), self.groups, self.order)

    def within(self) -> Window:
        """The window of one group's rows of one range."""
        return Window.partitionBy(*self.groups, PART).orderBy(*self.order)

    def earlier(self) -> Window:
        """The window of one group's ranges before a range, over a table of one row a group and range."""
        return Window.partitionBy(*self.groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)

    def counts(self) -> DataFrame:
        """groups, range, n, before: the group's rows of a range and of its earlier ranges."""
        n = self.rows.groupBy(*self.groups, PART).agg(F.count("*").alias("n"))
        return n.withColumn("before", F.coalesce(F.sum("n").over(self.earlier()), F.lit(0)))

    def totals(self) -> DataFrame:
        """groups, n."""
        return self.rows.groupBy(*self.groups).agg(F.count("*").alias("n"))

    def numbered(self, name: str = "position", kind: str = "int") -> DataFrame:
        """All rows with their place in their group, from 1."""
        carried = self.counts().where("before > 0").drop("n")
        placed = self.rows.withColumn("_k", F.row_number().over(self.within()))
        place = (F.col("_k") + F.coalesce("before", F.lit(0))).cast(kind)
        return met(placed, carried, [*self.groups, PART]).withColumn(name, place).drop("_k", "before", PART)

    def between(self, wanted: DataFrame, name: str = "position", kind: str = "int") -> DataFrame:
        """The rows at places first..last of their group, from `wanted` (one row a group: groups, first, last; more columns
        stay): only ranges that hold such places are read, numbered and sorted."""
        own = {k: f"_wanted_{k}" for k in self.groups}
        asked = wanted.withColumnsRenamed(own)
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in own.items()], (F.col("before") < F.col("last")) & (F.col("before") + F.col("n") >= F.col("first")))
        hit = self.counts().join(asked, on).drop("n", *own.values())
        hit = stored(hit)
        parts = [r[0] for r in hit.select(PART).distinct().collect()]  # at most as many as ranges
        placed = self.rows.where(F.col(PART).isin(parts)).withColumn("_k", F.row_number().over(self.within()))
        names = {k: f"_right_{k}" for k in [*self.groups, PART]}
        other = hit.withColumnsRenamed(names)
        both = placed.join(other, reduce(lambda a, b: a & b, [placed[k].eqNullSafe(other[n]) for k, n in names.items()]))
        place = (F.col("_k") + F.col("before")).cast(kind)
        return both.withColumn(name, place).where((F.col(name) >= F.col("first")) & (F.col(name) <= F.col("last"))).drop("_k", "before", "first", "last", PART, *names.values())


def spread(rows: DataFrame, groups: list[str], order: list, parts: int | None = None) -> Ranges:
    """Lays the rows out by ranges, as many as shuffle partitions unless told. `order` must be total within a group,
    so that any group can be cut anywhere. The rows are stored first: bounds are sampled from them."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows).repartitionByRange(n, *groups, *order).withColumn(PART, F.spark_partition_id())
    return Ranges(stored(dealt, PART), groups, order)
