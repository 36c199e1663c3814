"""Parsed observations to entities, observations and relationships, as one batch job over all given jobs.

`ingest` normalizes every value, observed or only related to, where it stands, corrects host types, splits what is
valid from what is rejected, and folds the rest by key: the fold is the only shuffle of the values. Merging with stored tables is the same fold again, stored rows first.
The order that decides which raw value is kept is (job creation, job id, seq, relation position)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import correct_type, normalize_values
from ..schema import entity_id, obs_id, rel_id, tool_spec
from ..storage import cut


@dataclass
class Ingested:
    entities: DataFrame
    observations: DataFrame
    relationships: DataFrame
    rejected: DataFrame  # I1: job_id, seq, rel_pos (null for the observation itself), type, raw, error
    summary: DataFrame  # I7, without `enqueued`: see `with_enqueued`


def settled(new: Ingested) -> Ingested:
    """The same with entities, observations and relationships computed once, for readers that use them often."""
    return replace(new, entities=cut(new.entities), observations=cut(new.observations), relationships=cut(new.relationships))


def _keyed(df: DataFrame) -> DataFrame:
    """Adds norm, error and entity_id; corrects the types of hosts."""
    keyed = normalize_values(df)
    return keyed.withColumn("type", correct_type(F.col("type"), F.col("norm"), F.col("root"))).drop("root").withColumn("entity_id", entity_id())


def _mentions(parsed: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observed values, relation targets of valid ones), each with its job's data and its key. Relations travel with
    their observation, so neither meets the other in a join. Both are computed once: all results are made from them."""
    job = jobs.select("job_id", "inv_id", "tool", "tool_version", F.col("created_at").alias("_created"), F.coalesce("ended_at", "created_at").alias("at"))
    own = cut(_keyed(parsed.select("job_id", "seq", "type", "raw", "data", "confidence", "raw_path", "relations").join(job, "job_id")))
    valid = own.where("norm is not null").select("job_id", "seq", "inv_id", "at", "_created", F.col("entity_id").alias("_from"), F.posexplode("relations").alias("rel_pos", "r"))
    return own, cut(_keyed(valid.select("*", F.col("r.target_type").alias("type"), F.col("r.target_raw").alias("raw"), F.col("r.rel_type").alias("rel_type"), F.col("r.direction").alias("direction")).drop("r")))


def ingest(parsed: DataFrame, jobs: DataFrame, raw_root: str = "") -> Ingested:
    """The new rows of all jobs together. A rejected observation takes its relations with it; a rejected relation
    target only that relation. Relations that would end where they begin are dropped."""
    observed, targets = _mentions(parsed, jobs)
    accepted, valid = observed.where("norm is not null"), targets.where("norm is not null")
    rejected = observed.where("norm is null").select("job_id", "seq", F.lit(None).cast("int").alias("rel_pos"), "type", "raw", "error").unionByName(targets.where("norm is null").select("job_id", "seq", "rel_pos", "type", "raw", "error"))
    touch = lambda df, place, n: df.select("entity_id", "inv_id", "type", "norm", "raw", "at", F.struct("_created", "job_id", "seq", place.alias("rel_pos")).alias("_o"), F.lit(n).cast("bigint").alias("n"))
    touched = touch(accepted, F.lit(-1), 1).unionByName(touch(valid, F.col("rel_pos"), 0))
    entities = touched.groupBy("entity_id", "inv_id", "type", "norm").agg(F.min_by("raw", "_o").alias("raw"), F.lit(None).cast("string").alias("attrs"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.sum("n").alias("obs_count"))
    spec = F.broadcast(tool_spec(parsed.sparkSession).select("tool", "default_confidence"))
    observations = accepted.join(spec, "tool", "left").select(
        obs_id().alias("obs_id"), "entity_id", "job_id", "tool", "tool_version", F.concat(F.lit(raw_root + "/"), "job_id", F.lit("/output.json")).alias("raw_ref"), "raw_path",
        F.coalesce("confidence", "default_confidence").cast("smallint").alias("confidence"), "data", F.col("at").alias("observed_at"),
    )
    inward = F.col("direction") == "in"
    edges = valid.select("inv_id", F.when(inward, F.col("entity_id")).otherwise(F.col("_from")).alias("src_id"), F.when(inward, F.col("_from")).otherwise(F.col("entity_id")).alias("dst_id"), F.col("rel_type").alias("type"), "at").where("src_id <> dst_id")
    relationships = edges.groupBy("inv_id", "src_id", "dst_id", "type").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen")).select(rel_id().alias("rel_id"), "inv_id", "src_id", "dst_id", "type", "first_seen", "last_seen", F.lit(None).cast("string").alias("attrs"))
    return Ingested(entities, observations, relationships, rejected, _summary(jobs, observed, targets))


def _summary(jobs: DataFrame, observed: DataFrame, targets: DataFrame) -> DataFrame:
    """Upsert calls (not distinct entities), observations, relations without loops, and what was skipped."""
    good = F.col("norm").isNotNull()
    own = observed.select("job_id", good.alias("observation"), F.lit(False).alias("target"), F.lit(False).alias("relation"))
    related = targets.select("job_id", F.lit(False).alias("observation"), good.alias("target"), (good & (F.col("entity_id") != F.col("_from"))).alias("relation"))
    counted = own.unionByName(related).groupBy("job_id").agg(*[F.count_if(c).alias(c) for c in ("observation", "target", "relation")], F.count_if(~F.col("observation") & ~F.col("target")).alias("skipped"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return jobs.select("job_id").join(counted, "job_id", "left").select("job_id", (zero("observation") + zero("target")).alias("upserts"), zero("observation").alias("observations"), zero("relation").alias("relations"), zero("skipped").alias("skipped"))


def with_enqueued(summary: DataFrame, chained: DataFrame) -> DataFrame:
    """Adds `enqueued`, the follow-up jobs that a job's observations led to (`chain.chained_jobs`)."""
    n = chained.groupBy(F.col("parent_job_id").alias("job_id")).agg(F.count("*").alias("enqueued"))
    return summary.join(n, "job_id", "left").withColumn("enqueued", F.coalesce("enqueued", F.lit(0)))


def merge_entities(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored raw values and attributes stay, times widen, counts add up."""
    both = stored.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    return both.groupBy("entity_id", "inv_id", "type", "norm").agg(F.min_by("raw", "_n").alias("raw"), F.min_by("attrs", "_n").alias("attrs"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("obs_count").alias("obs_count"))


def merge_relationships(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored attributes stay, times widen."""
    both = stored.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    return both.groupBy("rel_id", "inv_id", "src_id", "dst_id", "type").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min_by("attrs", "_n").alias("attrs"))


def only_new(parsed: DataFrame, stored_observations: DataFrame) -> DataFrame:
    """The parsed rows whose observation is not stored yet, so that a replay counts nothing twice."""
    return parsed.withColumn("obs_id", obs_id()).join(stored_observations.select("obs_id"), "obs_id", "left_anti").drop("obs_id")
