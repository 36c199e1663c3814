"""Listings of jobs, and audits over a stored log of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ranges import PART, met, spread
from ..storage import stored

#: Exit codes after which another attempt may help.
TRANSIENT = [408, 429, 502, 503, 504, -1]
ERROR_LIMIT = 2000


def listing(rows: DataFrame, key: str = "job_id") -> DataFrame:
    """Newest first, with each row's place; rows are numbered within ranges of that order."""
    return spread(rows, [], [F.desc("created_at"), F.desc(key)]).numbered("place").orderBy("place")


def status_counts(jobs: DataFrame) -> DataFrame:
    """N per investigation and status."""
    return jobs.groupBy("inv_id", "status").agg(F.count("*").alias("n"))


def round_state(jobs: DataFrame) -> DataFrame:
    """Jobs, in_progress and complete per investigation; complete: nothing queued or running."""
    pending = F.col("status").isin("queued", "running")
    return jobs.groupBy("inv_id").agg(F.count("*").alias("jobs"), F.bool_or(pending).alias("in_progress"), (F.count_if(pending) == 0).alias("complete"))


def outcome(timed_out: Column, success: Column, code: Column) -> Column:
    """Transient, permanent or success of one attempt."""
    return F.when(timed_out, "transient").when(success, "success").when(code.isNull(), "permanent").when(code.isin(TRANSIENT), "transient").otherwise("permanent")


def retry_audit(attempts: DataFrame, tools: DataFrame) -> DataFrame:
    """For each attempt its outcome, the wait before the next, the time used so far, the tool's budget, and
    whether another attempt was allowed. Only tools in `api` mode get more than one. A wait beyond the doubles is
    infinite, and so is the time used after it; without a backoff there is none."""
    spec = F.broadcast(tools.select("tool", "timeout_s", "max_attempts", "backoff_s", "run_mode"))
    w = Window.partitionBy("job_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    most = F.when(F.col("run_mode") == "api", F.col("max_attempts")).otherwise(1)
    doubled = F.pow(F.lit(2.0), F.col("n") - 1)
    waits = lambda times: F.when(F.col("backoff_s") == 0, 0.0).otherwise(F.col("backoff_s") * times)
    wait, before = waits(doubled), waits(doubled - 1)
    met = attempts.join(spec, "tool").withColumn("max_n", most)
    met = met.select("*", outcome(F.col("timed_out"), F.col("success"), F.col("code")).alias("outcome"), wait.alias("wait_s"), (F.sum("seconds").over(w) + before).alias("elapsed_s"), (F.col("timeout_s") * F.col("max_n") + F.col("backoff_s") * (F.pow(F.lit(2.0), F.col("max_n") - 1) - 1)).alias("budget_s"))
    allowed = (F.col("outcome") == "transient") & (F.col("n") < F.col("max_n")) & (F.col("elapsed_s") + F.col("wait_s") < F.col("budget_s"))
    return met.select("job_id", "tool", "n", "outcome", "wait_s", "elapsed_s", "budget_s", allowed.alias("retry_allowed"))


def slots(requests: DataFrame, tools: DataFrame, key: str = "request_id") -> DataFrame:
    """When each request of a tool may start: at its time, but at least 60 / per_minute seconds after the one
    before. That recurrence is a scan by (max, +): over a range of requests it is (rows, greatest time - rank * interval),
    and two neighbouring ranges combine to one. So requests are laid out by ranges of time, of any length, each range is
    scanned by itself, and what the earlier ranges of its tool combine to is added. Times count in whole microseconds."""
    spec = F.broadcast(tools.select("tool", (60e6 / F.col("per_minute")).alias("_gap")))
    dealt = spread(requests.join(spec, "tool").withColumn("_us", F.round(F.col("t") * 1e6)), ["tool"], ["_us", key])
    free = F.col("_us") - F.col("_k") * F.col("_gap")
    scanned = dealt.rows.withColumn("_k", F.row_number().over(dealt.within())).withColumn("_free", F.max(free).over(dealt.within().rowsBetween(Window.unboundedPreceding, 0)))
    scanned = stored(scanned)
    each = scanned.groupBy("tool", PART, "_gap").agg(F.count("*").alias("_n"), F.max("_free").alias("_top"))
    before = dealt.earlier()
    each = each.withColumn("_before", F.sum("_n").over(before))
    each = each.withColumn("_carried", F.max(F.col("_top") - F.coalesce("_before", F.lit(0)) * F.col("_gap")).over(before))
    done = met(scanned, each.where("_before > 0").select("tool", PART, "_before", "_carried"), ["tool", PART])
    rows_before = F.coalesce("_before", F.lit(0))
    slot = F.greatest(F.col("_free") - rows_before * F.col("_gap"), F.col("_carried")) + (rows_before + F.col("_k")) * F.col("_gap")
    return done.select(key, "tool", "t", (slot / 1e6).alias("slot"))


def quota(requests: DataFrame, tools: DataFrame, key: str = "request_id") -> DataFrame:
    """Admitted while the tool's count of the UTC calendar month is below its quota: a rank by tool and month, its
    segments cut into ranges wherever there are many rows."""
    spec = F.broadcast(tools.select("tool", "monthly_quota"))
    months = requests.select(key, "tool", "ts", F.date_trunc("month", "ts").alias("_month"))
    placed = spread(months, ["tool", "_month"], ["ts", key]).numbered("rn").join(spec, "tool")
    return placed.select(key, "tool", "rn", (F.col("monthly_quota").isNull() | (F.col("rn") <= F.col("monthly_quota"))).alias("admitted"))


def fold_attempts(attempts: DataFrame) -> DataFrame:
    """One row a job: the last attempt's status, code and duration, the number of attempts, and its error, cut
    and with the attempt's number before it if there were several."""
    last = attempts.groupBy("job_id").agg(F.max_by(F.struct("status", "code", "seconds", "error"), "n").alias("a"), F.max("n").alias("attempts"))
    error = F.when(F.col("a.error").isNotNull(), F.concat(F.when(F.col("attempts") > 1, F.concat(F.col("attempts").cast("string"), F.lit(". deneme: "))).otherwise(""), F.col("a.error")))
    return last.select("job_id", F.col("a.status").alias("status"), F.col("a.code").alias("exit_code"), F.col("a.seconds").alias("seconds"), "attempts", F.substring(error, 1, ERROR_LIMIT).alias("error"))
