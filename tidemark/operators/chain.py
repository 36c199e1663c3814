"""Which follow-up jobs the data asks for. Every join is an equi-join to the seven-row tool table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import entity_id, job_id
from ..storage import stored

MAX_DEPTH = 3


def edges(tools: DataFrame) -> DataFrame:
    """Producer, type, consumer among the enabled tools."""
    on = tools.where("enabled")
    made = on.select(F.col("tool").alias("producer"), F.explode("produces").alias("type"))
    used = on.select(F.col("tool").alias("consumer"), F.explode("accepts").alias("type"))
    return made.join(F.broadcast(used), "type").select("producer", "type", "consumer")


def _new_job(depth, parent) -> list:
    return [
        job_id(value="norm").alias("job_id"), "inv_id", "tool", "tool_version", entity_id().alias("target_entity_id"), F.col("norm").alias("target_value"), F.lit("queued").alias("status"),
        parent.alias("parent_job_id"), depth.cast("smallint").alias("depth"),
    ]


def chained_jobs(observed: DataFrame, jobs: DataFrame, investigations: DataFrame, tools: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(job_id, type, norm) rows of observed entities, never of relation targets, times the consumers of the
    type that the investigation allows; one job a (investigation, tool, value), first asked for first."""
    used = F.broadcast(tools.where("enabled").select("tool", "tool_version", F.explode("accepts").alias("type")))
    parent = jobs.where(F.col("depth") < max_depth).select("job_id", "inv_id", "depth", "created_at")
    allowed = investigations.select("inv_id", "selected_tools")
    asked = observed.select("job_id", "type", "norm").distinct().join(parent, "job_id").join(used, "type").join(allowed, "inv_id")
    asked = asked.where((F.coalesce(F.size("selected_tools"), F.lit(0)) == 0) | F.array_contains("selected_tools", F.col("tool")))
    # the first asker by pre-aggregation; a popular value never gathers in one place
    first = asked.groupBy("inv_id", "tool", "tool_version", "type", "norm").agg(F.min(F.struct("created_at", "job_id", "depth")).alias("p"))
    one = first.groupBy("inv_id", "tool", "norm").agg(F.min(F.struct("p", "type", "tool_version")).alias("b")).select("inv_id", "tool", "norm", F.col("b.type").alias("type"), F.col("b.tool_version").alias("tool_version"), F.col("b.p").alias("p"))
    return one.select(*_new_job(F.col("p.depth") + 1, F.col("p.job_id"))).join(jobs.select("job_id"), "job_id", "left_anti")


def rounds(start: DataFrame, outputs: DataFrame, investigations: DataFrame, tools: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """C2 over all depths as one run: the jobs that `start` leads to, itself included. `outputs` has what the archive holds
    of each (inv_id, tool, target_value): the observed (type, norm). Each round meets only the jobs of its own depth, the
    frontier, with the outputs, and what it asks for and no earlier round has is the next one. The rounds are as many as
    depths; a new job takes its parent's time, so that who asked first stays first."""
    columns = ["job_id", "inv_id", "tool", "target_value", "parent_job_id", "depth", "created_at"]
    frontier = stored(start.select(*columns))
    every = frontier
    for _ in range(max_depth):
        observed = frontier.select("job_id", "inv_id", "tool", "target_value").join(outputs, ["inv_id", "tool", "target_value"]).select("job_id", "type", "norm")
        new = chained_jobs(observed, frontier, investigations, tools, max_depth).join(every.select("job_id"), "job_id", "left_anti")
        parents = frontier.select(F.col("job_id").alias("parent_job_id"), "created_at")
        frontier = stored(new.join(parents, "parent_job_id").select(*columns))
        if frontier.isEmpty():
            break
        every = every.unionByName(frontier)
    return every


def starting_jobs(investigations: DataFrame, tools: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs to start, root entities with count 0, errors): the selected tools (all enabled if none) that
    accept the root's type; those of passivity P2 or A only with authorization."""
    chosen = investigations.withColumn("wanted", F.array_distinct("selected_tools"))
    names = F.broadcast(tools.where("enabled").select("tool"))
    bad = chosen.select("inv_id", F.explode("wanted").alias("tool")).join(names, "tool", "left_anti").groupBy("inv_id").agg(F.array_sort(F.collect_set("tool")).alias("bad"))
    unknown = bad.select("inv_id", F.concat(F.lit("unknown tool: "), F.array_join("bad", ", ")).alias("error"))
    used = F.broadcast(tools.where("enabled").select("tool", "tool_version", "passivity", F.explode("accepts").alias("root_type")))
    start = chosen.join(used, "root_type").where((F.coalesce(F.size("wanted"), F.lit(0)) == 0) | F.array_contains("wanted", F.col("tool")))
    none = investigations.join(start.select("inv_id").distinct(), "inv_id", "left_anti").select("inv_id", F.concat(F.lit("no selected tool accepts "), "root_type").alias("error"))
    rows = start.where(~F.col("passivity").isin("P2", "A") | F.coalesce("authorized", F.lit(False))).select("inv_id", "tool", "tool_version", F.col("root_type").alias("type"), F.col("root_value").alias("norm"))
    new = rows.select(*_new_job(F.lit(0), F.lit(None).cast("string"))).join(jobs.select("job_id"), "job_id", "left_anti")
    roots = start.select("inv_id", F.col("root_type").alias("type"), F.col("root_value").alias("norm")).distinct().select(entity_id().alias("entity_id"), "inv_id", "type", "norm", F.col("norm").alias("raw"), F.lit(0).cast("bigint").alias("obs_count"))
    return new, roots, unknown.unionByName(none)


def reachable(tools: DataFrame, root_types: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """C4: root_type, depth, tool: the tools that a root type reaches at each depth (each tool at its first)."""
    used = F.broadcast(tools.where("enabled").select("tool", F.explode("accepts").alias("type")))
    made = F.broadcast(tools.where("enabled").select("tool", F.explode("produces").alias("type")))
    now = root_types.select("root_type", F.col("root_type").alias("type")).distinct()
    found = None
    for depth in range(max_depth + 1):
        here = now.join(used, "type").select("root_type", F.lit(depth).alias("depth"), "tool").distinct()
        found = here if found is None else found.unionByName(here)
        now = here.join(made, "tool").select("root_type", "type").distinct()
    return found.groupBy("root_type", "tool").agg(F.min("depth").alias("depth"))


def gate(jobs: DataFrame, investigations: DataFrame, tools: DataFrame, keys: DataFrame) -> DataFrame:
    """job_id, skip_reason (null: may run); checked in order: a missing required key, missing authorization
    for P2 or A, a disabled tool. `keys` has the names of the keys there are."""
    spec = F.broadcast(tools.select("tool", "auth_required", "auth_env", "passivity", "enabled"))
    lacks = tools.select("tool", F.explode("auth_env").alias("key")).join(keys.select("key").distinct(), "key", "left_anti").groupBy("tool").agg(F.array_sort(F.collect_set("key")).alias("missing"))
    met = jobs.select("job_id", "inv_id", "tool").join(spec, "tool").join(F.broadcast(lacks), "tool", "left").join(investigations.select("inv_id", "authorized"), "inv_id")
    missing = F.coalesce("missing", F.array().cast("array<string>"))
    reason = (
        F.when(F.col("auth_required") & (F.size(missing) > 0), F.concat(F.lit("missing key: "), F.array_join(missing, ", ")))
        .when(F.col("passivity").isin("P2", "A") & ~F.coalesce("authorized", F.lit(False)), "not authorized")
        .when(~F.col("enabled"), "tool disabled")
    )
    return met.select("job_id", reason.alias("skip_reason"))


def first_asked(jobs: DataFrame) -> DataFrame:
    """Jobs of one key in the order in which they were asked for; the first has position 1."""
    return jobs.withColumn("position", F.row_number().over(Window.partitionBy("inv_id", "tool", "target_value").orderBy("created_at", "job_id")))
