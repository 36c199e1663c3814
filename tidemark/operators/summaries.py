"""Q1-Q7: the documented queries and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import latest


def ranked_by_score(entities: DataFrame, assessments: DataFrame) -> DataFrame:
    """Q1: entities with their latest score, best first, unscored last, then most observations."""
    scores = latest(assessments).select("entity_id", "score")
    return entities.join(scores, "entity_id", "left").orderBy(F.desc_nulls_last("score"), F.desc("obs_count"), "entity_id")


def single_observation(entities: DataFrame) -> DataFrame:
    """Q2."""
    return entities.where("obs_count = 1")


def single_source_share(listed: DataFrame) -> DataFrame:
    """Q3: n and the share of entities with one tool, by type and in all (type null)."""
    return listed.rollup("type").agg(F.count("*").alias("n"), F.avg(F.when(F.size("tools") == 1, 1.0).otherwise(0.0)).alias("share"))


def observations_per_entity(observations: DataFrame) -> DataFrame:
    """Q4."""
    return observations.groupBy("tool").agg(F.count("*").alias("observations"), F.countDistinct("entity_id").alias("entities")).withColumn("per_entity", F.col("observations") / F.col("entities"))


def score_histogram(assessments: DataFrame, versions: list[str]) -> DataFrame:
    """Q5: one row a band of scores, one column a prompt version."""
    s = F.col("score")
    band = F.when(s >= 90, "90-100").when(s >= 80, "80-89").when(s >= 70, "70-79").when(s >= 50, "50-69").when(s >= 30, "30-49").otherwise("0-29")
    return assessments.withColumn("band", band).groupBy("band").pivot("prompt_version", versions).count().na.fill(0)


def repeated_reasons(assessments: DataFrame) -> DataFrame:
    """Q6: reasons given to several entities, with their mean score."""
    return assessments.groupBy("reason").agg(F.countDistinct("entity_id").alias("entities"), F.avg("score").alias("mean_score")).where("entities > 1")


def type_shares(entities: DataFrame) -> DataFrame:
    """Q7: the share of each type; the total comes from the few grouped rows."""
    from pyspark.sql import Window

    counted = entities.groupBy("type").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
