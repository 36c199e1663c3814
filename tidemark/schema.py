"""The data model: table schemas, enumerations, deterministic ids, the tool table and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY_TYPES = ["domain", "subdomain", "ip", "netblock", "asn", "email", "service", "cert", "org", "tech"]
RELATION_TYPES = ["subdomain_of", "resolves_to", "cname_for", "mx_for", "ns_for", "cert_for", "in_netblock", "announced_by", "owned_by", "runs_on", "uses_tech", "email_at"]
JOB_STATUSES = ["queued", "running", "done", "empty", "timeout", "error", "skipped"]
PASSIVITY = ["P0", "P1", "P2", "A"]

RELATIONS = "array<struct<rel_type:string,target_type:string,target_raw:string,direction:string>>"

TABLES = {
    "investigation": "inv_id string, name string, root_value string, root_type string, scope_note string, selected_tools array<string>, authorized boolean, auth_note string, created_by string, status string, created_at timestamp, updated_at timestamp",
    "entity": "entity_id string, inv_id string, type string, norm string, raw string, attrs string, first_seen timestamp, last_seen timestamp, obs_count bigint",
    "observation": "obs_id string, entity_id string, job_id string, tool string, tool_version string, raw_ref string, raw_path string, confidence smallint, data string, observed_at timestamp",
    "relationship": "rel_id string, inv_id string, src_id string, dst_id string, type string, first_seen timestamp, last_seen timestamp, attrs string",
    "job": "job_id string, inv_id string, tool string, tool_version string, target_entity_id string, target_value string, status string, parent_job_id string, depth smallint, error string, exit_code int, attempts smallint, started_at timestamp, ended_at timestamp, duration_ms int, created_at timestamp",
    "assessment": "assessment_id string, entity_id string, score smallint, reason string, tags array<string>, model string, prompt_version string, input_hash string, scored_at timestamp",
    "hypothesis": "hyp_id string, inv_id string, title string, body string, confidence smallint, entity_ids array<string>, model string, prompt_version string, analyst_status string, created_at timestamp",
    "parsed_observation": f"job_id string, seq bigint, type string, raw string, data string, confidence smallint, raw_path string, relations {RELATIONS}",
}

#: Fixed values of the tool table: name, version, passivity, accepts, produces, run mode, required keys, key
#: required, timeout, requests a minute, monthly quota, default confidence, enabled, attempts, backoff seconds.
TOOL_ROWS = [
    ("asn-bgp", "1.0", "P0", ["ip", "asn"], ["asn", "netblock", "org"], "api", [], False, 45, 20, None, 85, True, 3, 2.0),
    ("crtsh", "1.0", "P0", ["domain"], ["subdomain", "cert"], "api", [], False, 45, 5, None, 90, True, 3, 2.0),
    ("dns-resolver", "1.0", "P1", ["domain", "subdomain"], ["ip", "subdomain", "tech", "org"], "api", [], False, 30, 60, None, 85, True, 3, 2.0),
    ("shodan-lookup", "1.0", "P0", ["ip"], ["service", "tech", "org"], "api", ["SHODAN_API_KEY"], True, 30, 60, 100, 75, True, 3, 2.0),
    ("subfinder", "2.14.0", "P0", ["domain"], ["subdomain"], "docker", ["SUBFINDER_API_KEYS"], False, 120, 5, None, 70, True, 1, 2.0),
    ("theharvester", "4.6.0", "P0", ["domain"], ["email", "subdomain"], "docker", [], False, 180, 5, None, 60, True, 1, 2.0),
    ("whois-rdap", "1.0", "P0", ["domain", "ip", "netblock"], ["org", "subdomain", "netblock", "asn"], "api", [], False, 30, 10, None, 90, True, 3, 2.0),
]
TOOL_SCHEMA = "tool string, tool_version string, passivity string, accepts array<string>, produces array<string>, run_mode string, auth_env array<string>, auth_required boolean, timeout_s int, per_minute int, monthly_quota int, default_confidence smallint, enabled boolean, max_attempts int, backoff_s double"


def tool_spec(spark: SparkSession) -> DataFrame:
    """The tool capability and limit table (seven rows, safe to broadcast)."""
    return spark.createDataFrame(TOOL_ROWS, TOOL_SCHEMA)


def _id(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def entity_id(inv_id="inv_id", type_="type", norm="norm") -> Column:
    return _id(inv_id, type_, norm)


def rel_id(src="src_id", dst="dst_id", type_="type") -> Column:
    return _id(src, dst, type_)


def job_id(inv_id="inv_id", tool="tool", value="target_value") -> Column:
    return _id(inv_id, tool, value)


def obs_id(job="job_id", seq="seq") -> Column:
    return _id(job, F.col(seq).cast("string") if isinstance(seq, str) else seq)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One model table with its schema; partition pruning works on inv_id where the table has one."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """By investigation where there is one. Observations, assessments and hypotheses are append-only."""
    if name in ("observation", "assessment", "hypothesis") and mode != "append":
        raise ValueError(f"{name} rows are only ever added")
    columns = [c.split(" ")[0] for c in _split_fields(TABLES[name])]
    out = df.select(*columns).write.mode(mode)
    (out.partitionBy("inv_id") if "inv_id" in columns else out).parquet(f"{root}/{name}")


def _split_fields(ddl: str) -> list[str]:
    depth, parts, now = 0, [], ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(now.strip())
            now = ""
        else:
            now += c
    return [*parts, now.strip()]


#: The checks of each table, as SQL conditions that a valid row meets.
CHECKS = {
    "investigation": {"root_type": "root_type in ('domain', 'ip')"},
    "entity": {"type": f"type in ({', '.join(repr(t) for t in ENTITY_TYPES)})", "count": "obs_count >= 0"},
    "observation": {"confidence": "confidence between 0 and 100"},
    "relationship": {"self": "src_id <> dst_id", "type": f"type in ({', '.join(repr(t) for t in RELATION_TYPES)})"},
    "job": {"status": f"status in ({', '.join(repr(t) for t in JOB_STATUSES)})", "depth": "depth >= 0"},
    "assessment": {"score": "score between 0 and 100"},
    "hypothesis": {"confidence": "confidence between 0 and 100"},
}
KEYS = {"entity": ["inv_id", "type", "norm"], "relationship": ["src_id", "dst_id", "type"], "job": ["inv_id", "tool", "target_value"]}


def violations(df: DataFrame, table: str) -> DataFrame:
    """check, n: broken row checks and repeated keys of a table (parquet enforces none)."""
    found = None
    for name, rule in CHECKS[table].items():
        one = df.where(~F.coalesce(F.expr(rule), F.lit(False))).agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        found = one if found is None else found.unionByName(one)
    if table in KEYS:
        twice = df.groupBy(*KEYS[table]).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("key").alias("check"), "n")
        found = found.unionByName(twice)
    return found.where("n > 0")
