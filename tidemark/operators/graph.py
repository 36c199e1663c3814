"""Neighbours and evidence. An OR over two ends is written as a union of two equi-joins. Any entity may be an
end of most edges, or have most of the evidence: ends that are common meet their entity by broadcast, and places are
carried over ranges, so that no task holds an entity's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ranges import spread
from ..skew import join_one
from ..storage import stored

PAGE = 50


def isolated(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """The edges whose both ends are entities of the edge's own investigation, with the ends' keys."""
    side = lambda p: entities.select(F.col("entity_id").alias(f"{p}_id"), F.col("inv_id").alias(f"{p}_inv"), F.col("type").alias(f"{p}_type"), F.col("norm").alias(f"{p}_norm"))
    met = join_one(stored(join_one(stored(relationships), side("src"), "src_id")), side("dst"), "dst_id")
    return met.where("src_inv = inv_id and dst_inv = inv_id").drop("src_inv", "dst_inv")


def neighbours(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """G1 for all entities at once: entity_id, direction out or in, the edge, its place in the entity's order and
    its page."""
    edges = isolated(relationships, entities).select("rel_id", "inv_id", "type", "src_id", "dst_id", "src_norm", "dst_norm")
    both = edges.select(F.col("src_id").alias("entity_id"), F.lit("out").alias("direction"), "*").unionByName(edges.select(F.col("dst_id").alias("entity_id"), F.lit("in").alias("direction"), "*"))
    placed = spread(both, ["entity_id"], ["type", "src_norm", "dst_norm", "rel_id"]).numbered()
    return placed.withColumn("page", F.ceil(F.col("position") / PAGE).cast("int"))


def neighbour_page(rows: DataFrame, entity_id: str, number: int) -> DataFrame:
    """One page of one entity's neighbours; the number is clamped."""
    own = rows.where(F.col("entity_id") == entity_id)
    last = own.groupBy("entity_id").agg(F.max("page").alias("_last"))  # one row
    return own.join(F.broadcast(last), "entity_id").where(F.col("page") == F.least(F.greatest(F.lit(1), F.lit(number)), F.col("_last"))).drop("_last")


def evidence_chain(observations: DataFrame, newest_first: bool = True) -> DataFrame:
    """Adds each observation's place in its entity's chain."""
    time = F.desc("observed_at") if newest_first else F.asc("observed_at")
    return spread(observations, ["entity_id"], [time, "obs_id"]).numbered()


def lineage(observations: DataFrame, jobs: DataFrame, entities: DataFrame) -> DataFrame:
    """The observations whose job and entity belong to one investigation, with it."""
    job = jobs.select("job_id", F.col("inv_id").alias("_job_inv"))
    return observations.join(job, "job_id").join(entities.select("entity_id", "inv_id"), "entity_id").where("inv_id = _job_inv").drop("_job_inv")
