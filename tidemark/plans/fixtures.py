"""The driver tables as model tables, for the registered queries. `SQL` has the same tables as DuckDB CTEs.

pages: one investigation per registrable root, one job per root and first path segment (which stands for a tool), one
host observation per page, related to its root. events: attempts, requests and assessments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import Ingested, ingest
from ..schema import RELATIONS

#: Path segments and the tools they stand for.
SEGMENT_TOOLS = {"en": "crtsh", "fr": "subfinder", "de": "dns-resolver", "es": "theharvester"}
EVENT_TOOLS = {"click": "crtsh", "view": "dns-resolver", "error": "shodan-lookup", "purchase": "asn-bgp"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _mapped(column, mapping: dict[str, str], default: str):
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, host, inv_id (the root), tool, job_id."""
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1))
    segment = F.regexp_extract("url", "^[a-zA-Z]+://[^/]+/([a-z]+)/", 1)
    p = read(spark, sf_dir, "pages").select("page_id", "url", host.alias("host"), _mapped(segment, SEGMENT_TOOLS, "whois-rdap").alias("tool"))
    p = p.withColumn("inv_id", F.regexp_extract("host", r"([a-z0-9-]+\.[a-z]+)$", 1))
    return p.withColumn("job_id", F.concat_ws("|", "inv_id", "tool"))


def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).groupBy("inv_id").agg(F.count("*").alias("n"))
    return p.select("inv_id", F.concat(F.lit("round "), "inv_id").alias("name"), F.col("inv_id").alias("root_value"), F.lit("domain").alias("root_type"), F.lit("a <scope> & more").alias("scope_note"), F.array(F.lit("crtsh"), F.lit("dns-resolver"), F.lit("unheard-of")).alias("selected_tools"), F.lit(False).alias("authorized"), F.lit("driver").alias("created_by"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = _mapped(F.col("tool"), {"crtsh": "0", "subfinder": "1", "dns-resolver": "2"}, "3").cast("smallint")
    g = pages(spark, sf_dir).groupBy("job_id", "inv_id", "tool").agg(F.min("page_id").alias("lowest"), F.count("*").alias("n"))
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("lowest"))
    return g.select("job_id", "inv_id", "tool", F.lit("1.0").alias("tool_version"), F.col("inv_id").alias("target_value"), F.when(F.col("n") > 8, "done").otherwise("running").alias("status"), depth.alias("depth"), F.lit(None).cast("string").alias("error"), F.lit(1).cast("smallint").alias("attempts"), created.alias("created_at"), F.lit(None).cast("timestamp").alias("ended_at"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    flags = F.when(F.col("host").startswith("spam"), '{"hedefe_ait_degil":true}').when(F.col("host").startswith("blog"), '{"saglayici_olabilir":"true"}').otherwise("{}")
    relation = F.array(F.struct(F.lit("subdomain_of").alias("rel_type"), F.lit("domain").alias("target_type"), F.col("inv_id").alias("target_raw"), F.lit("out").alias("direction")))
    return p.select("job_id", F.col("page_id").alias("seq"), F.lit("subdomain").alias("type"), F.col("url").alias("raw"), flags.alias("data"), F.lit(None).cast("smallint").alias("confidence"), F.format_string("$[%d].url", "page_id").alias("raw_path"), relation.cast(RELATIONS).alias("relations"))


def ingested(spark: SparkSession, sf_dir: str) -> Ingested:
    return ingest(parsed(spark, sf_dir), jobs(spark, sf_dir), "/archive")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt an event: a job is a user's events of one type; its code and duration come from the event."""
    from pyspark.sql import Window

    e = events(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    code = F.when(F.col("k") < 20, 502).when(F.col("k") < 30, 404).when(F.col("k") < 35, F.lit(None)).otherwise(200).cast("int")
    return e.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("job_id"), "tool", n.alias("n"), (F.col("k") >= 95).alias("timed_out"), F.coalesce(code == 200, F.lit(False)).alias("success"), code.alias("code"), (F.col("k") % 7).cast("double").alias("seconds"), F.when(F.col("k") >= 95, "timeout").when(code == 200, "done").otherwise("error").alias("status"), F.when(F.col("k") < 35, F.concat(F.lit("code "), F.col("k").cast("string"))).alias("error"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), _mapped(F.col("event_type"), EVENT_TOOLS, "whois-rdap").alias("tool"))


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    version = F.when(F.col("event_type") == "click", "1.0").otherwise("2.0")
    return e.select(F.col("event_id").cast("string").alias("assessment_id"), F.col("user_id").cast("string").alias("entity_id"), F.col("k").cast("smallint").alias("score"), F.concat(F.lit("seen "), (F.col("k") % 5).cast("string")).alias("reason"), F.array().cast("array<string>").alias("tags"), F.lit("m").alias("model"), version.alias("prompt_version"), F.lit("").alias("input_hash"), F.col("ts").alias("scored_at"))


#: The same tables in SQL: pg, inv, job, mention, ent, obs, rel, ev, att, ass.
SQL = r"""
pg0 AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host,
  CASE regexp_extract(url, '^[a-zA-Z]+://[^/]+/([a-z]+)/', 1) WHEN 'en' THEN 'crtsh' WHEN 'fr' THEN 'subfinder' WHEN 'de' THEN 'dns-resolver' WHEN 'es' THEN 'theharvester' ELSE 'whois-rdap' END AS tool FROM pages),
pg AS (SELECT *, regexp_extract(host, '([a-z0-9-]+\.[a-z]+)$', 1) AS inv_id, regexp_extract(host, '([a-z0-9-]+\.[a-z]+)$', 1) || '|' || tool AS job_id FROM pg0),
inv AS (SELECT DISTINCT inv_id, inv_id AS root_value FROM pg),
job AS (SELECT job_id, inv_id, tool, inv_id AS target_value, CASE WHEN count(*) > 8 THEN 'done' ELSE 'running' END AS status,
  CASE tool WHEN 'crtsh' THEN 0 WHEN 'subfinder' THEN 1 WHEN 'dns-resolver' THEN 2 ELSE 3 END AS depth, 1704067200 + min(page_id) AS tm FROM pg GROUP BY job_id, inv_id, tool),
mention AS (
  SELECT p.job_id, p.inv_id, p.tool, p.page_id AS seq, -1 AS rel_pos, CASE WHEN p.host = p.inv_id THEN 'domain' ELSE 'subdomain' END AS type, p.host AS norm, p.url AS raw, 1 AS n, j.tm,
    CASE WHEN starts_with(p.host, 'spam') THEN true ELSE false END AS flag FROM pg p JOIN job j USING (job_id)
  UNION ALL SELECT p.job_id, p.inv_id, p.tool, p.page_id, 0, 'domain', p.inv_id, p.inv_id, 0, j.tm, false FROM pg p JOIN job j USING (job_id)),
keyed AS (SELECT *, sha256(inv_id || chr(1) || type || chr(1) || norm) AS entity_id FROM mention),
ent AS (SELECT entity_id, inv_id, type, norm, arg_min(raw, (tm, job_id, seq, rel_pos)) AS raw, min(tm) AS first_seen, max(tm) AS last_seen, CAST(sum(n) AS BIGINT) AS obs_count FROM keyed GROUP BY ALL),
obs AS (SELECT sha256(job_id || chr(1) || seq) AS obs_id, entity_id, job_id, inv_id, tool, seq, tm, flag FROM keyed WHERE n = 1),
rel AS (SELECT DISTINCT a.inv_id, a.entity_id AS src_id, b.entity_id AS dst_id, 'subdomain_of' AS type, sha256(a.entity_id || chr(1) || b.entity_id || chr(1) || 'subdomain_of') AS rel_id
  FROM keyed a JOIN keyed b ON a.job_id = b.job_id AND a.seq = b.seq AND a.n = 1 AND b.n = 0 WHERE a.entity_id <> b.entity_id),
ev AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CASE event_type WHEN 'click' THEN 'crtsh' WHEN 'view' THEN 'dns-resolver' WHEN 'error' THEN 'shodan-lookup' WHEN 'purchase' THEN 'asn-bgp' ELSE 'whois-rdap' END AS tool FROM events),
att AS (SELECT CAST(user_id AS VARCHAR) || '|' || event_type AS job_id, user_id, tool, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS n, k,
  CASE WHEN k < 20 THEN 502 WHEN k < 30 THEN 404 WHEN k < 35 THEN NULL ELSE 200 END AS code, CAST(k % 7 AS DOUBLE) AS seconds FROM ev),
ass AS (SELECT CAST(event_id AS VARCHAR) AS assessment_id, CAST(user_id AS VARCHAR) AS entity_id, k AS score, 'seen ' || (k % 5) AS reason, CASE WHEN event_type = 'click' THEN '1.0' ELSE '2.0' END AS prompt_version, ts FROM ev),
ev1 AS (SELECT entity_id, array_to_string(list_sort(list_distinct(list(tool))), ',') AS tools, CAST(count(DISTINCT tool) AS INTEGER) AS n_tools, bool_or(flag) AS flag FROM obs GROUP BY entity_id),
con AS (SELECT src_id AS entity_id FROM rel UNION SELECT dst_id FROM rel),
lst AS (SELECT e.entity_id, e.inv_id, e.type, e.norm, e.raw, e.obs_count, coalesce(v.tools, '') AS tools, coalesce(v.n_tools, 0) AS n_tools, coalesce(v.flag, false) AS flag, c.entity_id IS NOT NULL AS connected,
  e.type = 'domain' AND e.norm = e.inv_id AS is_root, CASE WHEN e.type IN ('subdomain', 'netblock') THEN 2 ELSE 1 END AS threshold FROM ent e LEFT JOIN ev1 v USING (entity_id) LEFT JOIN con c USING (entity_id)),
tri AS (SELECT *, CASE WHEN is_root THEN 'priority' WHEN flag THEN 'context' WHEN n_tools < threshold OR NOT connected THEN 'review' ELSE 'priority' END AS triage FROM lst),
pos AS (SELECT *, CAST(row_number() OVER (PARTITION BY inv_id ORDER BY CASE triage WHEN 'priority' THEN 1 WHEN 'review' THEN 2 WHEN 'context' THEN 3 ELSE 4 END, n_tools DESC, type, norm, entity_id) AS INTEGER) AS position FROM tri)
"""
