"""The ranked list of entities. Aggregates come before joins, so no observation meets a relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ranges import Ranges, spread

GROUPS = ["priority", "review", "context", "certificate"]
FLAGS = ["hedefe_ait_degil", "saglayici_olabilir", "prefiks_sinir_asildi"]
FLAG_REASONS = ["may not belong to the target", "may be a provider", "prefix limit exceeded"]
#: Distinct tools from which an entity of a type counts as confirmed; 1 for the others.
THRESHOLDS = {"subdomain": 2, "netblock": 2}
PAGE = 100


def flags_of(json: Column) -> list[Column]:
    """Whether each flag is the JSON boolean true (text "true" is not)."""
    parsed = F.from_json(json, ", ".join(f"{f} boolean" for f in FLAGS))
    return [F.coalesce(parsed[f], F.lit(False)).alias(f) for f in FLAGS]


def evidence(observations: DataFrame) -> DataFrame:
    """entity_id, sorted distinct tools, and each flag if any observation has it."""
    rows = observations.select("entity_id", "tool", *flags_of(F.col("data")))
    return rows.groupBy("entity_id").agg(F.array_sort(F.collect_set("tool")).alias("tools"), *[F.bool_or(f).alias(f) for f in FLAGS])


def connected(relationships: DataFrame) -> DataFrame:
    """inv_id, entity_id of both ends of all edges."""
    return relationships.select("inv_id", F.col("src_id").alias("entity_id")).union(relationships.select("inv_id", "dst_id")).distinct()


def entity_list(entities: DataFrame, observations: DataFrame, relationships: DataFrame, investigations: DataFrame) -> DataFrame:
    """Every entity with tools, flags (its own attributes' too), connected and is_root (a domain that is the
    investigation's root; an address is never)."""
    ends = connected(relationships).withColumn("_c", F.lit(True))
    roots = investigations.select("inv_id", "root_value")
    met = entities.join(evidence(observations), "entity_id", "left").join(ends, ["inv_id", "entity_id"], "left").join(roots, "inv_id", "left")
    own = F.from_json("attrs", ", ".join(f"{f} boolean" for f in FLAGS))
    flag = lambda f: (F.coalesce(F.col(f), F.lit(False)) | F.coalesce(own[f], F.lit(False))).alias(f)
    root = (F.col("type") == "domain") & (F.col("norm") == F.col("root_value"))
    return met.select("entity_id", "inv_id", "type", "norm", "raw", "obs_count", F.coalesce("tools", F.array().cast("array<string>")).alias("tools"), *[flag(f) for f in FLAGS], F.coalesce("_c", F.lit(False)).alias("connected"), F.coalesce(root, F.lit(False)).alias("is_root"))


def judged(listed: DataFrame) -> DataFrame:
    """T4: adds n_tools, threshold, triage (the group) and reasons, in their fixed order."""
    n = F.size("tools")
    threshold = F.lit(1)
    for kind, value in THRESHOLDS.items():
        threshold = F.when(F.col("type") == kind, value).otherwise(threshold)
    low, any_flag = n < threshold, F.col(FLAGS[0]) | F.col(FLAGS[1]) | F.col(FLAGS[2])
    group = F.when(F.col("type") == "cert", "certificate").when(F.col("is_root"), "priority").when(any_flag, "context").when(low | ~F.col("connected"), "review").otherwise("priority")
    of = lambda end: F.concat(F.col("type"), F.lit(": threshold of "), threshold.cast("string"), F.lit(" tools "), F.lit(end))
    reasons = F.array_compact(F.array(
        F.when(F.col("is_root"), "root of the investigation"),
        F.when(n == 0, "no direct observation").when(low, of("missed")).otherwise(of("met")),
        F.when(~F.col("connected"), "no relation"),
        *[F.when(F.col(f), r) for f, r in zip(FLAGS, FLAG_REASONS, strict=True)],
        F.when(F.col("type") == "cert", "certificate: supporting evidence"),
    ))
    return listed.select("*", n.alias("n_tools"), threshold.alias("threshold"), group.alias("triage"), reasons.alias("reasons"))


def rank_of(group: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in GROUPS]), group)


def laid_out(rows: DataFrame) -> Ranges:
    """T5: the list by ranges of its total order: group, most tools, type, key, id; no task holds an investigation."""
    return spread(rows, ["inv_id"], [rank_of(F.col("triage")), F.desc("n_tools"), F.col("type"), F.col("norm"), F.col("entity_id")])


def ordered(rows: DataFrame) -> DataFrame:
    """T5: adds position in the investigation."""
    return laid_out(rows).numbered()


def group_counts(rows: DataFrame) -> DataFrame:
    """N of each group over all rows."""
    return rows.groupBy("inv_id", "triage").agg(F.count("*").alias("n"))


def page(listed: Ranges, number: int, group: str | None = None, size: int = PAGE) -> DataFrame:
    """One page of each investigation's list, of one group or of all, with its number, clamped to what there is.
    The counts of the ranges tell which of them hold the page; the others are neither read nor sorted."""
    chosen = listed if group is None else listed.where(F.col("triage") == group)
    last = F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("int")
    wanted = chosen.totals().withColumn("page", F.least(F.greatest(F.lit(1), F.lit(number)), last))
    rows = chosen.between(wanted.select("inv_id", "page", ((F.col("page") - 1) * size + 1).alias("first"), (F.col("page") * size).alias("last")))
    if group is None:
        return rows
    ahead = listed.where(rank_of(F.col("triage")) <= GROUPS.index(group)).totals()
    return rows.join(ahead, "inv_id", "left").withColumn("position", (F.col("position") + F.coalesce("n", F.lit(0))).cast("int")).drop("n")
