"""Joins with a table of one row a key, where a key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more than one in so many rows is hot; there are at most so many, whatever the table's size.
HOT_SHARE = 1000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys of more than one in HOT_SHARE of all rows, counted before any shuffle of rows."""
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    return n.where(F.col("_n") * HOT_SHARE > total).select(key)


def join_one(rows: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows.join(one, key, how), how being inner or left, for a table `one` of one row a key. Rows of hot keys stay where
    they are and meet a broadcast of at most HOT_SHARE rows; the others meet by a shuffle. `rows` is read three times."""
    hot = hot_keys(rows, key)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    cold = marked.where("_hot is null").drop("_hot").join(one, key, how)
    few = F.broadcast(one.join(F.broadcast(hot), key, "left_semi"))
    return cold.unionByName(marked.where("_hot").drop("_hot").join(few, key, how))
