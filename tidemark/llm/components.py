"""Connected components of a link table, by hooking and contraction.

Each round every vertex points to its smallest neighbour, pointers are shortened, and the links are moved to
the vertices pointed to; links inside one component vanish. Stars and cliques end after a round or two, and no
adjacency list is ever collected. The round's tables are stored in the shared folder: read again, small ones take few
tasks and are joined by broadcast, where a checkpoint's would take one for each shuffle partition in every step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each end of a link (a, b) the smallest id that links reach from it."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    result = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().select("id", F.col("id").alias("component"))
    first = True
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a"))
        point = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p"))
        point = stored(point)
        further = point.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        point = stored(point.join(further, "p").select("v", F.col("pp").alias("p")))
        if first:
            result, first = point.select(F.col("v").alias("id"), F.col("p").alias("component")), False
        else:
            step = point.select(F.col("v").alias("component"), "p")
            result = stored(result.join(step, "component", "left").select("id", F.coalesce("p", "component").alias("component")))
        at_a, at_b = point.select(F.col("v").alias("a"), F.col("p").alias("x")), point.select(F.col("v").alias("b"), F.col("p").alias("y"))
        moved = edges.join(at_a, "a").join(at_b, "b").where("x <> y")
        edges = stored(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        tidy(links.sparkSession)
    return result
