"""Registered queries, one or more an operator, over the driver tables; each with its DuckDB SQL."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..operators import chain, graph, jobs as joblog, report, scoring, summaries, triage
from ..operators.ingest import Ingested, settled, with_enqueued
from ..schema import job_id, read_table, tool_spec, write_table
from ..sources import archive, extract, splits
from ..storage import cut, drop, shared_folder, stored
from ..streaming.incremental import Store, merge_parsed
from . import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True):
    """Registers a query under its function's name; `prelude` puts the model tables' CTEs before the SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {fx.SQL.strip()}\n{sql.strip()}" if prelude else sql.strip())
        return f

    return add


def _epoch(c: str):
    return F.unix_timestamp(c).alias(c)


# -- 2.1 sources -------------------------------------------------------------------------------------------------


@query(
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND d.lang <> 'fr' THEN '/archive/' || d.doc_id || '/output.json' END AS raw_ref FROM documents d LEFT JOIN labels l USING (doc_id)", False
)
def s5_trusted_refs(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("job_id"), "lang")
    ref = F.concat(F.lit("/archive/"), F.when(F.col("lang") == "fr", F.lit("../x/")).otherwise(""), "job_id", F.lit("/output.json"))
    there = fx.read(spark, d, "labels").select(F.concat(F.lit("file:/archive/"), F.col("doc_id").cast("string"), F.lit("/output.json")).alias("path"))
    return archive.trusted(docs.withColumn("raw_ref", ref), there, "/archive").select("doc_id", "raw_ref")


@query("SELECT CAST(doc_id AS VARCHAR) AS job_id, text AS preview, strlen(text) > 262144 AS truncated FROM documents", False)
def s6_previews(spark: SparkSession, d: str) -> DataFrame:
    return archive.previews(fx.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("job_id"), F.col("text").cast("binary").alias("content")))


@query("SELECT entity_id, inv_id, type, norm, raw, first_seen, obs_count FROM ent")
def s2_stored_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities written by investigation and read again."""
    root = _table_root(spark)
    write_table(fx.ingested(spark, d).entities, root, "entity", "overwrite")
    return read_table(spark, root, "entity").select("entity_id", "inv_id", "type", "norm", "raw", _epoch("first_seen"), "obs_count")


@query("SELECT obs_id, entity_id, job_id, tool FROM obs")
def s3_appended_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations in two appends; none replaces what is there."""
    root, rows = _table_root(spark), cut(fx.ingested(spark, d).observations)
    for own in (F.col("tool") == "crtsh", F.col("tool") != "crtsh"):
        write_table(rows.where(own), root, "observation")
    return read_table(spark, root, "observation").select("obs_id", "entity_id", "job_id", "tool")


def _table_root(spark: SparkSession) -> str:
    root = f"{shared_folder(spark)}/tidemark-tables-{uuid.uuid4().hex}"
    atexit.register(drop, spark, root)
    return root


# -- 2.2 extraction: the JSON is built from driver rows ------------------------------------------------------------


def _content(df: DataFrame, job, body) -> DataFrame:
    return df.select(job.cast("string").alias("job_id"), body.cast("binary").alias("content"))


def _shown(parsed: DataFrame) -> DataFrame:
    """Rows of an extraction as plain columns; relations as text."""
    rel = F.array_join(F.transform("relations", lambda r: F.concat_ws(">", r["rel_type"], r["target_type"], r["target_raw"], r["direction"])), ",")
    return parsed.select("job_id", "type", "raw", "raw_path", rel.alias("relations"))


@query("""
SELECT CAST(page_id AS VARCHAR) AS job_id, 'subdomain' AS type, n AS raw, '$[0].name_value' AS raw_path, 'cert_for>cert>' || md5(url) || '>in' AS relations FROM (SELECT page_id, url, unnest(list_distinct([host, '*.' || inv_id])) AS n FROM pg)
UNION ALL SELECT CAST(page_id AS VARCHAR), 'cert', md5(url), '$[0]', '' FROM pg""")
def x1_ct_log(spark: SparkSession, d: str) -> DataFrame:
    p = fx.pages(spark, d)
    record = F.struct(F.concat(F.lit("*."), "inv_id", F.lit("\n"), "host", F.lit("\nwith blank")).alias("name_value"), F.col("host").alias("common_name"), F.md5(F.col("url").cast("binary")).alias("serial_number"), F.lit("x").alias("issuer_name"), F.col("page_id").alias("id"))
    return _shown(extract.extract_ct_log(_content(p, F.col("page_id"), F.to_json(F.array(record)))))


@query("SELECT CAST(page_id AS VARCHAR) AS job_id, 'subdomain' AS type, host AS raw, '$[2].host' AS raw_path, CASE WHEN host <> inv_id THEN 'subdomain_of>domain>' || inv_id || '>out' ELSE '' END AS relations FROM pg")
def x2_subdomain_list(spark: SparkSession, d: str) -> DataFrame:
    p = fx.pages(spark, d)
    line = F.to_json(F.struct("host", F.col("inv_id").alias("input"), F.lit("s").alias("source")))
    return _shown(extract.extract_subdomain_list(_content(p, F.col("page_id"), F.concat(F.lit("\nnot json\n"), line, F.lit("\n{}")))))


@query("""
SELECT j AS job_id, 'ip' AS type, '10.0.0.' || (s_suppkey % 256) AS raw, '$.kayitlar.A.veri[0]' AS raw_path, 'resolves_to>subdomain>www.example.com>in' AS relations FROM (SELECT CAST(s_suppkey AS VARCHAR) AS j, * FROM supplier)
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'subdomain', 'edge.example.net', '$.cname_zinciri[0]', 'cname_for>subdomain>www.example.com>in' FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'subdomain', 'last.example.org', '$.cname_zinciri[2]', 'cname_for>subdomain>edge.example.net>in' FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'subdomain', 'mx' || s_nationkey || '.example.com', '$.kayitlar.MX.veri[0]', 'mx_for>domain>www.example.com>out' FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'subdomain', 'ns1.host' || s_nationkey || '.net', '$.kayitlar.NS.veri[0]', 'ns_for>domain>www.example.com>out' FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'org', 'host' || s_nationkey, '$.kayitlar.NS.veri[0]', '' FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'tech', 'spf-include:mail' || s_nationkey || '.net', '$.kayitlar.TXT', '' FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'subdomain', 'www.example.com', '$.kayitlar', '' FROM supplier""", False)
def x3_dns(spark: SparkSession, d: str) -> DataFrame:
    s = fx.read(spark, d, "supplier")
    n = F.col("s_nationkey").cast("string")
    body = F.concat(
        F.lit('{"hedef":"www.example.com.","kayitlar":{"A":{"durum":"ok","veri":["10.0.0.'), (F.col("s_suppkey") % 256).cast("string"), F.lit('"]},"MX":{"durum":"ok","veri":["10 mx'), n,
        F.lit('.example.com."]},"NS":{"durum":"ok","veri":["ns1.host'), n, F.lit('.net."]},"TXT":{"durum":"ok","veri":["\\"v=spf1 include:mail'), n, F.lit('.net. ip4:192.0.2\\" \\".0/24 ~all\\""]}},"dmarc":{"durum":"nodata","veri":[]},"cname_zinciri":["edge.example.net.","  ","last.example.org"]}'),
    )
    return _shown(extract.extract_dns(_content(s, F.col("s_suppkey"), body)))


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS job_id, s_nationkey % 2 = 1 AS spf_yok, CASE s_nationkey % 4 WHEN 0 THEN '?all' WHEN 2 THEN '-all' END AS spf_all, CASE s_nationkey % 4 WHEN 0 THEN true WHEN 2 THEN false END AS spf_zayif,
  CASE WHEN s_nationkey % 2 = 0 THEN 'mail' || s_nationkey || '.net,b.example.org' END AS spf_include, CASE WHEN s_nationkey % 2 = 0 THEN '192.0.2.0/24' END AS spf_ip4, s_suppkey % 3 = 0 AS dmarc_yok,
  CASE WHEN s_suppkey % 3 <> 0 THEN CASE s_suppkey % 3 WHEN 1 THEN 'None' ELSE 'reject' END END AS dmarc_p, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS dmarc_pct, CASE s_suppkey % 3 WHEN 1 THEN true WHEN 2 THEN false END AS dmarc_zayif,
  s_nationkey % 5 <> 0 AS caa_yok, CASE WHEN s_nationkey % 5 = 0 THEN '0 issue ca' || s_nationkey || '.example' END AS caa, 'ns.example.com. ' || s_suppkey AS soa FROM supplier""", False)
def x3e_mail_policy(spark: SparkSession, d: str) -> DataFrame:
    s, n = fx.read(spark, d, "supplier"), F.col("s_nationkey").cast("string")
    odd = F.col("s_nationkey") % 2 == 1
    spf = F.concat(F.lit('"other text","\\"v=spf1 include:mail'), n, F.lit('.net. ip4:192.0.2\\" \\".0/24 include:b.example.org '), F.when(F.col("s_nationkey") % 4 == 0, "?all").otherwise("-ALL"), F.lit('\\""'))
    caa = F.when(F.col("s_nationkey") % 5 == 0, F.concat(F.lit('"0 issue ca'), n, F.lit('.example"'))).otherwise("")
    dmarc = F.when(F.col("s_suppkey") % 3 == 0, F.lit('"v=other"')).otherwise(F.concat(F.lit('"v=DMARC1; P='), F.when(F.col("s_suppkey") % 3 == 1, "None").otherwise("reject"), F.lit(" ; pct="), n, F.lit('; x"')))
    body = F.concat(F.lit('{"hedef":"www.example.com","kayitlar":{"TXT":{"durum":"ok","veri":['), F.when(odd, F.lit('"other text"')).otherwise(spf), F.lit(']},"CAA":{"durum":"ok","veri":['), caa, F.lit(']},"SOA":{"durum":"ok","veri":["ns.example.com. '), F.col("s_suppkey").cast("string"), F.lit('"]}},"dmarc":{"durum":"ok","veri":['), dmarc, F.lit("]}}"))
    rows = extract.extract_dns(_content(s, F.col("s_suppkey"), body)).where("raw_path = '$.kayitlar'")
    fields = {"spf_yok": "boolean", "spf_all": "string", "spf_zayif": "boolean", "spf_include": "array<string>", "spf_ip4": "array<string>", "dmarc_yok": "boolean", "dmarc_p": "string", "dmarc_pct": "string", "dmarc_zayif": "boolean", "caa_yok": "boolean", "caa": "array<string>", "soa": "string"}
    found = F.from_json("data", ", ".join(f"{k} {v}" for k, v in fields.items()))
    return rows.select("job_id", *[(F.array_join(found[k], ",") if v.startswith("array") else found[k]).alias(k) for k, v in fields.items()])


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS job_id, 'org' AS type, c_name AS raw, '$.entities[?(@.roles==''registrant'')]' AS raw_path, 'owned_by>domain>example.com>in' AS relations FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'subdomain', 'ns1.example.net', '$.nameservers[1].ldhName', 'ns_for>domain>example.com>out' FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'domain', 'example.com', '$', '' FROM customer""", False)
def x4_rdap_domain(spark: SparkSession, d: str) -> DataFrame:
    c = fx.read(spark, d, "customer")
    owner = F.when(F.col("c_mktsegment") == "BUILDING", "REDACTED FOR PRIVACY").otherwise(F.col("c_name"))
    body = F.concat(F.lit('{"hedef":"example.com","yanit":{"objectClassName":"domain","ldhName":"example.com.","status":["active"],"events":[{"eventAction":"expiration","eventDate":"2024-03-01T00:00:00Z"},{"eventAction":"last update of RDAP database","eventDate":"2024-01-01T12:00:00Z"}],"entities":[{"roles":["registrant"],"vcardArray":["vcard",[["fn",{},"text","A Person"],["org",{},"text","'), owner, F.lit('"]]]}],"nameservers":[7,{"ldhName":"ns1.example.net."}]}}'))
    return _shown(extract.extract_rdap(_content(c, F.col("c_custkey"), body)))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2030-01-01') AS BIGINT) AS days_left, date_diff('day', CAST(o_orderdate AS DATE), DATE '2030-01-01') <= 90 AS near FROM orders", False)
def x4b_expiry(spark: SparkSession, d: str) -> DataFrame:
    o = fx.read(spark, d, "orders")
    body = F.concat(F.lit('{"objectClassName":"domain","ldhName":"example.com","events":[{"eventAction":"expiration","eventDate":"2030-01-01T00:00:00Z"},{"eventAction":"last update of RDAP database","eventDate":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T00:00:00Z"}]}'))
    rows = extract.extract_rdap(_content(o, F.col("o_orderkey"), body)).where("type = 'domain'")
    parsed = F.from_json("data", "bitise_kalan_gun bigint, bitis_yakin boolean")
    return rows.select("job_id", parsed["bitise_kalan_gun"].alias("days_left"), parsed["bitis_yakin"].alias("near"))


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS job_id, 'netblock' AS type, '10.' || s_nationkey || '.0.0/16' AS raw, '$.cidr0_cidrs[0]' AS raw_path, 'in_netblock>ip>10.0.0.1>in' AS relations FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'org', s_name, '$.entities', 'owned_by>netblock>10.' || s_nationkey || '.0.0/16>in' FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'asn', CAST(s_suppkey AS VARCHAR), '$.arin_originas0_originautnums[0]', 'announced_by>netblock>10.' || s_nationkey || '.0.0/16>in' FROM supplier""", False)
def x4d_rdap_network(spark: SparkSession, d: str) -> DataFrame:
    s = fx.read(spark, d, "supplier")
    body = F.concat(F.lit('{"hedef":"10.0.0.1","yanit":{"objectClassName":"ip network","cidr0_cidrs":[{"v4prefix":"10.'), F.col("s_nationkey").cast("string"), F.lit('.0.0","length":16},{"v4prefix":"x"}],"entities":[{"roles":["administrative"],"vcardArray":["vcard",[["fn",{},"text","'), F.col("s_name"), F.lit('"]]]}],"arin_originas0_originautnums":['), F.col("s_suppkey").cast("string"), F.lit("]}}"))
    return _shown(extract.extract_rdap(_content(s, F.col("s_suppkey"), body)))


@query("""
WITH n AS (SELECT n_nationkey, n_name, list('10.' || (s_suppkey % 200) || '.0.0/16' ORDER BY s_suppkey) AS l, count(*) AS c FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL)
SELECT 'j' || n_nationkey AS job_id, 'asn' AS type, CAST(n_nationkey AS VARCHAR) AS raw, '$.asn_bilgi.' || n_nationkey AS raw_path, 'announced_by>netblock>10.0.0.0/8>in' AS relations FROM n
UNION ALL SELECT 'j' || n_nationkey, 'org', n_name, '$.asn_bilgi.' || n_nationkey || '.holder', 'owned_by>asn>' || n_nationkey || '>in' FROM n
UNION ALL SELECT 'j' || n_nationkey, 'netblock', l[i], '$.prefixler.' || n_nationkey || '.liste[' || (i - 1) || ']', 'announced_by>asn>' || n_nationkey || '>out' FROM (SELECT *, unnest(range(1, c + 1)) AS i FROM n WHERE c <= 50)""", False)
def x5_bgp(spark: SparkSession, d: str) -> DataFrame:
    n = fx.read(spark, d, "nation").join(fx.read(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    block = F.concat(F.lit("10."), (F.col("s_suppkey") % 200).cast("string"), F.lit(".0.0/16"))
    g = n.groupBy("n_nationkey", "n_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", block.alias("b")))), lambda x: x["b"]).alias("liste"))
    key = F.col("n_nationkey").cast("string")
    body = F.to_json(F.struct(F.struct(F.lit("10.0.0.0/8").alias("prefix")).alias("network_info"), F.create_map(key, F.struct(F.concat(F.upper("n_name"), F.lit(" - "), "n_name").alias("holder"))).alias("asn_bilgi"), F.create_map(key, F.struct(F.size("liste").alias("sayi"), "liste")).alias("prefixler")))
    return _shown(extract.extract_bgp(_content(g, F.concat(F.lit("j"), key), body)))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS job_id, 'org' AS type, p_brand AS raw, '$.org' AS raw_path, 'owned_by>ip>192.0.2.1>in' AS relations FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'service', '192.0.2.1:' || p_size || '/tcp', '$.data[1]', 'runs_on>ip>192.0.2.1>out' FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'tech', p_name || ':' || p_name || ':*', '$.data[1].product', 'uses_tech>service>192.0.2.1:' || p_size || '/tcp>in' FROM part""", False)
def x6_host_index(spark: SparkSession, d: str) -> DataFrame:
    p = fx.read(spark, d, "part")
    body = F.to_json(F.struct(F.lit("192.0.2.1").alias("ip_str"), F.col("p_brand").alias("org"), F.array(F.struct(F.lit(0).alias("port"), F.lit("bad").alias("product")), F.struct(F.col("p_size").alias("port"), F.col("p_name").alias("product"))).alias("data")))
    return _shown(extract.extract_host_index(_content(p, F.col("p_partkey"), body)))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '…[kirpildi]' ELSE text END AS banner FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS text FROM documents)", False)
def x6a_banner(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "documents").select("doc_id", extract.clean_banner(F.col("text")).alias("banner"))


@query("""
SELECT CAST(page_id AS VARCHAR) AS job_id, 'subdomain' AS type, host AS raw, '$.hosts[0]' AS raw_path, '' AS relations FROM pg
UNION ALL SELECT CAST(page_id AS VARCHAR), 'email', 'info@' || host, '$.emails[1]', 'email_at>domain>' || host || '>out' FROM pg""")
def x7_harvest(spark: SparkSession, d: str) -> DataFrame:
    p = fx.pages(spark, d)
    body = F.to_json(F.struct(F.array(F.concat("host", F.lit(":192.0.2.7")), F.concat(F.lit("2F"), "host"), F.lit("nodot")).alias("hosts"), F.array(F.lit("a@b"), F.concat(F.lit("info@"), "host")).alias("emails")))
    return _shown(extract.extract_harvest(_content(p, F.col("page_id"), body)))


def _written(lines: DataFrame) -> str:
    """A folder of the shared storage with one text file a job, of its lines in order (job, place, line)."""
    path = f"{shared_folder(lines.sparkSession)}/tidemark-archive-{uuid.uuid4().hex}"
    lines.repartition("job").sortWithinPartitions("job", "place").select("job", F.col("line").alias("value")).write.partitionBy("job").text(path)
    atexit.register(drop, lines.sparkSession, path)
    return path


_FILES = ("part-*", r"/job=([^/]*)/[^/]*$")


@query("""
SELECT tool || '-' || inv_id AS job_id, 'subdomain' AS type, host AS raw, '$[' || (3 * (row_number() OVER (PARTITION BY tool, inv_id ORDER BY page_id) - 1) + 1) || '].host' AS raw_path,
  CASE WHEN host <> inv_id THEN 'subdomain_of>domain>' || inv_id || '>out' ELSE '' END AS relations FROM pg""")
def x2_large_lists(spark: SparkSession, d: str) -> DataFrame:
    p = fx.pages(spark, d)
    good = F.to_json(F.struct("host", F.col("inv_id").alias("input"), F.lit("s").alias("source")))
    lines = p.select(F.concat_ws("-", "tool", "inv_id").alias("job"), "page_id", F.posexplode(F.array(F.lit("{not json"), F.concat(good, F.lit("\r")), F.lit(""))).alias("n", "line"))
    path = _written(lines.select("job", (F.col("page_id") * 3 + F.col("n")).alias("place"), "line"))
    return _shown(extract.subdomain_lines(splits.read_lines(spark, path, *_FILES)))


@query("""
, n AS (SELECT *, tool || '-' || inv_id AS j, 2 * (row_number() OVER (PARTITION BY tool, inv_id ORDER BY page_id) - 1) AS i FROM pg)
SELECT j AS job_id, 'subdomain' AS type, host AS raw, '$[' || i || '].name_value' AS raw_path, 'cert_for>cert>' || md5(url) || '>in' AS relations FROM n
UNION ALL SELECT j, 'cert', md5(url), '$[' || i || ']', '' FROM n""")
def x1_large_arrays(spark: SparkSession, d: str) -> DataFrame:
    p = fx.pages(spark, d)
    record = F.to_json(F.struct(F.lit('a "}],[{" \\').alias("issuer_name"), F.struct(F.array(F.lit("}")).alias("x")).alias("more"), F.col("host").alias("name_value"), F.md5(F.col("url").cast("binary")).alias("serial_number")))
    lines = p.select(F.concat_ws("-", "tool", "inv_id").alias("job"), F.col("page_id").alias("place"), F.concat(record, F.lit(', [17, {"common_name": "no"}] ,')).alias("line"))
    ends = lines.select("job").distinct().select("job", F.explode(F.array(F.struct(F.lit(-1).cast("bigint").alias("place"), F.lit(" [").alias("line")), F.struct(F.lit(1 << 60).alias("place"), F.lit("null ]").alias("line")))).alias("e")).select("job", "e.*")
    return _shown(extract.ct_records(splits.read_records(spark, _written(lines.unionByName(ends)), *_FILES)))


# -- 2.3 normalization -------------------------------------------------------------------------------------------


def _keys(df: DataFrame, kind: str, raw) -> DataFrame:
    return nz.normalize_values(df.select(F.lit(kind).alias("type"), df[df.columns[0]].alias("k"), raw.alias("raw"))).select("k", "norm")


@query("SELECT page_id, host AS norm, inv_id AS root, CASE WHEN host = inv_id THEN 'domain' ELSE 'subdomain' END AS type FROM pg")
def n1_hosts(spark: SparkSession, d: str) -> DataFrame:
    p = fx.read(spark, d, "pages").select("page_id", F.col("url").alias("raw"), F.lit("subdomain").alias("type"))
    keys = nz.normalize_values(p)
    return keys.select("page_id", "norm", "root", nz.correct_type(F.col("type"), F.col("norm"), F.col("root")).alias("type"))


@query("SELECT s_suppkey AS k, CASE WHEN s_nationkey < 5 THEN NULL WHEN s_suppkey % 2 = 0 THEN '2001:db8::' || printf('%x', s_suppkey % 65535 + 1) ELSE '10.1.' || (s_suppkey // 256) || '.' || (s_suppkey % 256) END AS norm FROM supplier", False)
def n3_ips(spark: SparkSession, d: str) -> DataFrame:
    s = fx.read(spark, d, "supplier")
    last = F.when(F.col("s_nationkey") < 5, F.lit("999")).otherwise((F.col("s_suppkey") % 256).cast("string"))
    four = F.concat(F.lit("  10.1."), F.floor(F.col("s_suppkey") / 256).cast("string"), F.lit("."), last, F.lit(":8080 "))
    six = F.concat(F.lit("[2001:0DB8:0::"), F.hex(F.col("s_suppkey") % 65535 + 1), F.when(F.col("s_nationkey") < 5, F.lit("::")).otherwise(""), F.lit("]:53"))
    return _keys(s, "ip", F.when(F.col("s_suppkey") % 2 == 0, six).otherwise(four))


@query("SELECT s_suppkey AS k, '10.' || (s_suppkey % 256) || '.' || (s_nationkey // 16 * 16) || '.0/20' AS norm FROM supplier", False)
def n4_netblocks(spark: SparkSession, d: str) -> DataFrame:
    s = fx.read(spark, d, "supplier")
    return _keys(s, "netblock", F.concat(F.lit("10."), (F.col("s_suppkey") % 256).cast("string"), F.lit("."), F.col("s_nationkey").cast("string"), F.lit(".77/20")))


@query("SELECT c_custkey AS k, lower(c_name) || '@mail.example.com' AS norm FROM customer", False)
def n5_emails(spark: SparkSession, d: str) -> DataFrame:
    c = fx.read(spark, d, "customer")
    return _keys(c, "email", F.concat(F.lit("mailto:"), "c_name", F.lit("+tag@Mail.Example.COM.")))


@query("SELECT c_custkey AS k, md5(c_name) AS norm FROM customer", False)
def n6_certificates(spark: SparkSession, d: str) -> DataFrame:
    c = fx.read(spark, d, "customer")
    return _keys(c, "cert", F.concat(F.lit("SHA256:"), F.regexp_replace(F.upper(F.md5(F.col("c_name").cast("binary"))), "(..)", "$1: ")))


@query("SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS norm FROM customer", False)
def n7_networks(spark: SparkSession, d: str) -> DataFrame:
    c = fx.read(spark, d, "customer")
    return _keys(c, "asn", F.concat(F.lit(" as 000"), F.col("c_custkey").cast("string")))


@query("SELECT p_partkey AS k, '192.0.2.1:' || p_size || '/udp' AS norm, '192.0.2.1' AS ip, p_size AS port, 'udp' AS proto FROM part", False)
def n8_services(spark: SparkSession, d: str) -> DataFrame:
    keys = _keys(fx.read(spark, d, "part"), "service", F.concat(F.lit("192.0.2.1:"), F.col("p_size").cast("string"), F.lit(" /UDP")))
    s = nz.split_service(F.col("norm"))
    return keys.select("k", "norm", s["ip"].alias("ip"), s["port"].alias("port"), s["proto"].alias("proto"))


@query("SELECT c_custkey AS k, replace(lower(c_name), '#', ' ') AS norm FROM customer", False)
def n10_organizations(spark: SparkSession, d: str) -> DataFrame:
    c = fx.read(spark, d, "customer")
    return _keys(c, "org", F.concat("c_name", F.lit("   A.Ş. Inc.")))


@query("SELECT p_partkey AS k, lower(p_brand) || ':' || lower(p_name) || ':*' AS norm FROM part", False)
def n11_technologies(spark: SparkSession, d: str) -> DataFrame:
    p = fx.read(spark, d, "part")
    return _keys(p, "tech", F.concat("p_brand", F.lit(" : "), "p_name"))


@query("SELECT page_id, url = host AS canonical FROM pg")
def n12_canonical(spark: SparkSession, d: str) -> DataFrame:
    p = fx.read(spark, d, "pages").select("page_id", F.col("url").alias("raw"), F.lit("subdomain").alias("type"))
    return nz.is_canonical(p).select("page_id", "canonical")


@query("SELECT page_id, inv_id AS root_value, 'domain' AS root_type FROM pg")
def n13_root_targets(spark: SparkSession, d: str) -> DataFrame:
    return nz.resolve_roots(fx.read(spark, d, "pages").select("page_id", F.col("url").alias("raw"))).select("page_id", "root_value", "root_type")


#: Addresses at and beside the ends of special ranges, with their classes.
_ADDRESSES = [
    ("9.255.255.255", None), ("10.0.0.0", "private"), ("10.255.255.255", "private"), ("11.0.0.0", None), ("0.0.0.0", "private"), ("1.0.0.0", None), ("126.255.255.255", None), ("127.0.0.0", "loopback"), ("128.0.0.0", None),
    ("169.253.255.255", None), ("169.254.0.0", "link_local"), ("172.15.255.255", None), ("172.31.255.255", "private"), ("192.0.0.8", "private"), ("192.0.0.9", None), ("192.0.0.10", None), ("192.0.0.255", "private"), ("192.0.1.0", None),
    ("198.17.255.255", None), ("198.19.255.255", "private"), ("223.255.255.255", None), ("224.0.0.0", "multicast"), ("240.0.0.0", "reserved"), ("255.255.255.255", "reserved"), ("::", "reserved"), ("::1", "loopback"), ("::2", "reserved"),
    ("::ffff:127.0.0.1", "loopback"), ("::ffff:10.0.0.1", "reserved"), ("64:ff9b:1::1", "reserved"), ("2001::1", "private"), ("2001:20::1", None), ("2001:1ff:ffff::", "private"), ("2001:200::", None), ("2001:db8::1", "private"), ("2002::1", "private"),
    ("2003::", None), ("3fff:ffff::1", None), ("4000::1", "reserved"), ("fbff::1", "reserved"), ("fc00::1", "private"), ("fe00::1", "reserved"), ("fe80::1", "link_local"), ("fec0::1", None), ("ff02::1", "multicast"),
]
_LISTED = ", ".join(f"'{c}'" if c else "NULL" for _, c in _ADDRESSES)


@query(f"SELECT c_custkey AS k, [{_LISTED}][1 + c_custkey % {len(_ADDRESSES)}] AS address_class FROM customer", False)
def n14_address_classes(spark: SparkSession, d: str) -> DataFrame:
    ip = F.get(F.array(*[F.lit(a) for a, _ in _ADDRESSES]), (F.col("c_custkey") % len(_ADDRESSES)).cast("int"))
    return nz.with_address_class(fx.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), ip.alias("norm"))).select("k", "address_class")


# -- 2.4 ingest --------------------------------------------------------------------------------------------------


@query("SELECT job_id, seq, 'no value' AS error FROM (SELECT job_id, page_id AS seq FROM pg) WHERE false UNION ALL SELECT lang, doc_id, 'invalid subdomain: ' || source FROM documents")
def i1_rejected(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.read(spark, d, "documents").select(F.col("lang").alias("job_id"), F.col("doc_id").alias("seq"), F.lit("subdomain").alias("type"), F.col("source").alias("raw"))
    return nz.normalize_values(docs).where("norm is null").select("job_id", "seq", "error")


@query("SELECT entity_id, inv_id, type, norm, raw, first_seen, last_seen, obs_count FROM ent")
def i3_entities(spark: SparkSession, d: str) -> DataFrame:
    return fx.ingested(spark, d).entities.select("entity_id", "inv_id", "type", "norm", "raw", _epoch("first_seen"), _epoch("last_seen"), "obs_count")


@query("SELECT obs_id, entity_id, job_id, tool, CAST(CASE tool WHEN 'crtsh' THEN 90 WHEN 'subfinder' THEN 70 WHEN 'dns-resolver' THEN 85 WHEN 'theharvester' THEN 60 ELSE 90 END AS SMALLINT) AS confidence, '$[' || seq || '].url' AS raw_path, '/archive/' || job_id || '/output.json' AS raw_ref FROM obs")
def i4_observations(spark: SparkSession, d: str) -> DataFrame:
    return fx.ingested(spark, d).observations.select("obs_id", "entity_id", "job_id", "tool", "confidence", "raw_path", "raw_ref")


@query("SELECT rel_id, inv_id, src_id, dst_id, type FROM rel")
def i6_relationships(spark: SparkSession, d: str) -> DataFrame:
    return fx.ingested(spark, d).relationships.select("rel_id", "inv_id", "src_id", "dst_id", "type")


@query("""
SELECT entity_id, inv_id, type, norm, arg_min(raw, (seq % 3, tm, job_id, seq, rel_pos)) AS raw, min(tm) AS first_seen, max(tm) AS last_seen, CAST(sum(n) AS BIGINT) AS obs_count
FROM keyed GROUP BY entity_id, inv_id, type, norm""")
def i8_incremental_entities(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).read("entity").select("entity_id", "inv_id", "type", "norm", "raw", _epoch("first_seen"), _epoch("last_seen"), "obs_count")


@query("SELECT obs_id, entity_id, job_id, tool, '$[' || seq || '].url' AS raw_path FROM obs")
def i8_incremental_observations(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).read("observation").select("obs_id", "entity_id", "job_id", "tool", "raw_path")


def _merged(spark: SparkSession, d: str) -> Store:
    """All pages merged into a new store in three batches, the second of them twice; its runs are merged as well."""
    store = Store(spark, f"{shared_folder(spark)}/tidemark-store-{uuid.uuid4().hex}", fan=2, checkpoint=2)
    atexit.register(drop, spark, store.root)
    parsed, jobs = fx.parsed(spark, d), cut(fx.jobs(spark, d))
    for batch in (0, 1, 1, 2):
        merge_parsed(store, parsed.where(F.col("seq") % 3 == batch), jobs)
        store.compact()
    return store


# -- 2.5 chaining ------------------------------------------------------------------------------------------------

_SPEC = "(VALUES ('asn-bgp','ip'),('asn-bgp','asn'),('crtsh','domain'),('dns-resolver','domain'),('dns-resolver','subdomain'),('shodan-lookup','ip'),('subfinder','domain'),('theharvester','domain'),('whois-rdap','domain'),('whois-rdap','ip'),('whois-rdap','netblock')) AS spec(tool, type)"


_CHAINED = f"""
SELECT sha256(inv_id || chr(1) || tool || chr(1) || norm) AS job_id, inv_id, tool, norm AS target_value, arg_min(parent, (tm, parent)) AS parent_job_id, CAST(arg_min(depth, (tm, parent)) + 1 AS SMALLINT) AS depth
FROM (SELECT DISTINCT k.inv_id, s.tool, k.norm, k.job_id AS parent, j.depth, j.tm FROM keyed k JOIN job j USING (job_id) JOIN {_SPEC} ON s.type = k.type WHERE k.n = 1 AND j.depth < 3 AND s.tool IN ('crtsh', 'dns-resolver'))
GROUP BY inv_id, tool, norm""".replace("AS spec(tool, type)", "AS s(tool, type)")


def _chained(spark: SparkSession, d: str, new: Ingested) -> DataFrame:
    seen = new.observations.join(new.entities.select("entity_id", "type", "norm"), "entity_id").select("job_id", "type", "norm")
    return chain.chained_jobs(seen, fx.jobs(spark, d), fx.investigations(spark, d), tool_spec(spark))


@query(_CHAINED)
def c2_chained_jobs(spark: SparkSession, d: str) -> DataFrame:
    return _chained(spark, d, fx.ingested(spark, d)).select("job_id", "inv_id", "tool", "target_value", "parent_job_id", "depth")


_OUTPUTS = """(SELECT DISTINCT * FROM (
  SELECT inv_id, 'crtsh' AS tool, inv_id AS value, CASE WHEN host = inv_id THEN 'domain' ELSE 'subdomain' END AS type, host AS norm FROM pg WHERE tool = 'crtsh'
  UNION ALL SELECT inv_id, 'dns-resolver', host, 'ip', '10.' || (page_id % 200) || '.0.' || (page_id % 250) FROM pg
  UNION ALL SELECT inv_id, 'asn-bgp', '10.' || (page_id % 200) || '.0.' || (page_id % 250), 'asn', CAST(page_id % 100 AS VARCHAR) FROM pg
  UNION ALL SELECT inv_id, 'asn-bgp', CAST(page_id % 100 AS VARCHAR), 'netblock', '10.' || (page_id % 50) || '.0.0/24' FROM pg
  UNION ALL SELECT inv_id, 'whois-rdap', '10.' || (page_id % 200) || '.0.' || (page_id % 250), 'netblock', '10.' || (page_id % 200) || '.0.0/16' FROM pg))"""


@query(f"""
, spec(tool, type) AS {_SPEC.removesuffix(" AS spec(tool, type)")},
asked AS (SELECT o.inv_id, o.tool AS by_tool, o.value AS by_value, s.tool, o.norm AS value FROM {_OUTPUTS} o JOIN spec s ON s.type = o.type),
walk AS (
  WITH RECURSIVE w AS (
    SELECT inv_id, tool, inv_id AS value, 0 AS depth FROM (SELECT DISTINCT inv_id FROM pg), (VALUES ('crtsh'), ('dns-resolver')) AS t(tool)
    UNION SELECT a.inv_id, a.tool, a.value, w.depth + 1 FROM w JOIN asked a ON a.inv_id = w.inv_id AND a.by_tool = w.tool AND a.by_value = w.value WHERE w.depth < 3
  ) SELECT inv_id, tool, value, min(depth) AS depth, sha256(inv_id || chr(1) || tool || chr(1) || value) AS job_id FROM w GROUP BY inv_id, tool, value
)
SELECT j.job_id, j.inv_id, j.tool, j.value AS target_value, min(p.job_id) AS parent_job_id, CAST(j.depth AS SMALLINT) AS depth FROM walk j
LEFT JOIN (SELECT a.*, w.job_id, w.depth FROM asked a JOIN walk w ON a.inv_id = w.inv_id AND a.by_tool = w.tool AND a.by_value = w.value) p
  ON p.inv_id = j.inv_id AND p.tool = j.tool AND p.value = j.value AND p.depth = j.depth - 1
GROUP BY ALL""")
def c2_rounds(spark: SparkSession, d: str) -> DataFrame:
    p = fx.pages(spark, d)
    n = lambda m: (F.col("page_id") % m).cast("string")
    ip = F.concat(F.lit("10."), n(200), F.lit(".0."), n(250))
    saw = lambda rows, tool, value, kind, norm: rows.select("inv_id", F.lit(tool).alias("tool"), value.alias("target_value"), kind.alias("type"), norm.alias("norm"))
    outputs = saw(p.where("tool = 'crtsh'"), "crtsh", F.col("inv_id"), F.when(F.col("host") == F.col("inv_id"), "domain").otherwise("subdomain"), F.col("host"))
    for tool, value, kind, norm in (("dns-resolver", F.col("host"), "ip", ip), ("asn-bgp", ip, "asn", n(100)), ("asn-bgp", n(100), "netblock", F.concat(F.lit("10."), n(50), F.lit(".0.0/24"))), ("whois-rdap", ip, "netblock", F.concat(F.lit("10."), n(200), F.lit(".0.0/16")))):
        outputs = outputs.unionByName(saw(p, tool, value, F.lit(kind), norm))
    inv = fx.investigations(spark, d).withColumn("selected_tools", F.array().cast("array<string>"))
    tools = F.explode(F.array(F.lit("crtsh"), F.lit("dns-resolver"))).alias("tool")
    start = inv.select("inv_id", tools, F.col("root_value").alias("target_value")).select(job_id().alias("job_id"), "*", F.lit(None).cast("string").alias("parent_job_id"), F.lit(0).cast("smallint").alias("depth"), F.timestamp_seconds(F.lit(0)).alias("created_at"))
    return chain.rounds(start, stored(outputs.distinct()), inv, tool_spec(spark)).drop("created_at")


@query(f"""SELECT s.*, coalesce(q.n, 0) AS enqueued FROM (
  SELECT a.job_id, 2 * count(*) AS upserts, count(*) AS observations, count(*) FILTER (a.entity_id <> b.entity_id) AS relations, CAST(0 AS BIGINT) AS skipped
  FROM keyed a JOIN keyed b ON a.job_id = b.job_id AND a.seq = b.seq AND a.n = 1 AND b.n = 0 GROUP BY a.job_id) s
LEFT JOIN (SELECT parent_job_id, count(*) AS n FROM ({_CHAINED}) GROUP BY ALL) q ON q.parent_job_id = s.job_id""")
def i7_summary(spark: SparkSession, d: str) -> DataFrame:
    new = fx.ingested(spark, d)
    s = with_enqueued(new.summary, _chained(spark, d, new))
    return s.select("job_id", *[F.col(c).cast("bigint").alias(c) for c in ("upserts", "observations", "relations", "skipped", "enqueued")])


@query("SELECT inv_id, t AS tool, inv_id AS target_value, '' AS error FROM inv, (VALUES ('crtsh'), ('dns-resolver')) AS x(t) UNION ALL SELECT inv_id, NULL, NULL, 'unknown tool: unheard-of' FROM inv")
def c3_starting_jobs(spark: SparkSession, d: str) -> DataFrame:
    new, _, errors = chain.starting_jobs(fx.investigations(spark, d), tool_spec(spark), fx.jobs(spark, d))
    none = F.lit(None).cast("string")
    return new.select("inv_id", "tool", "target_value", F.lit("").alias("error")).unionByName(errors.select("inv_id", none.alias("tool"), none.alias("target_value"), "error"))


@query("SELECT inv_id, t AS tool, CAST(n AS INTEGER) AS depth FROM inv, (VALUES ('crtsh', 0), ('dns-resolver', 0), ('subfinder', 0), ('theharvester', 0), ('whois-rdap', 0), ('asn-bgp', 1), ('shodan-lookup', 1)) AS x(t, n)")
def c4_reachable(spark: SparkSession, d: str) -> DataFrame:
    inv = fx.investigations(spark, d)
    return inv.select("inv_id", "root_type").join(chain.reachable(tool_spec(spark), inv.select("root_type")), "root_type").select("inv_id", "tool", "depth")


@query("""SELECT job_id, CASE WHEN tool = 'shodan-lookup' THEN 'missing key: SHODAN_API_KEY' WHEN tool = 'asn-bgp' AND inv_id <> 'example.org' THEN 'not authorized' WHEN tool = 'whois-rdap' THEN 'tool disabled' END AS skip_reason
FROM (SELECT DISTINCT job_id, tool, ['example.com', 'example.net', 'example.org'][1 + user_id % 3] AS inv_id FROM att) JOIN inv USING (inv_id)""")
def c5_gate(spark: SparkSession, d: str) -> DataFrame:
    inv_id = F.get(F.array(*[F.lit(f"example.{end}") for end in ("com", "net", "org")]), (F.substring_index("job_id", "|", 1).cast("bigint") % 3).cast("int"))
    jobs = fx.attempts(spark, d).select("job_id", "tool").distinct().withColumn("inv_id", inv_id)
    inv = fx.investigations(spark, d).withColumn("authorized", F.col("inv_id") == "example.org")
    tools = tool_spec(spark).withColumn("passivity", F.when(F.col("tool") == "asn-bgp", "P2").otherwise(F.col("passivity"))).withColumn("enabled", F.col("tool") != "whois-rdap")
    keys = fx.read(spark, d, "region").select(F.col("r_name").alias("key"))
    return chain.gate(jobs, inv, tools, keys)


# -- 2.6 job log -------------------------------------------------------------------------------------------------


@query("SELECT job_id, inv_id, CAST(row_number() OVER (ORDER BY tm DESC, job_id DESC) AS INTEGER) AS place FROM job")
def j1_listing(spark: SparkSession, d: str) -> DataFrame:
    return joblog.listing(fx.jobs(spark, d)).select("job_id", "inv_id", "place")


@query("SELECT inv_id, status, count(*) AS n FROM job GROUP BY ALL")
def j2_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return joblog.status_counts(fx.jobs(spark, d))


@query("SELECT inv_id, count(*) AS jobs, bool_or(status = 'running') AS in_progress, NOT bool_or(status = 'running') AS complete FROM job GROUP BY inv_id")
def j3_round_state(spark: SparkSession, d: str) -> DataFrame:
    return joblog.round_state(fx.jobs(spark, d))


_OUTCOME = "CASE WHEN k >= 95 THEN 'transient' WHEN code = 200 THEN 'success' WHEN code IS NULL THEN 'permanent' WHEN code IN (408, 429, 502, 503, 504, -1) THEN 'transient' ELSE 'permanent' END"


@query(f"""
SELECT job_id, n, outcome, wait_s, elapsed_s, budget_s, outcome = 'transient' AND n < m AND elapsed_s + wait_s < budget_s AS retry_allowed FROM (
  SELECT job_id, n, {_OUTCOME} AS outcome, 2.0 * pow(2, n - 1) AS wait_s, 3 AS m,
    sum(seconds) OVER w + 2.0 * (pow(2, n - 1) - 1) AS elapsed_s, CASE tool WHEN 'crtsh' THEN 45 WHEN 'asn-bgp' THEN 45 ELSE 30 END * 3 + 6.0 AS budget_s
  FROM att WINDOW w AS (PARTITION BY job_id ORDER BY n))""")
def j5_retry_audit(spark: SparkSession, d: str) -> DataFrame:
    return joblog.retry_audit(fx.attempts(spark, d), tool_spec(spark)).select("job_id", F.col("n").cast("int").alias("n"), "outcome", "wait_s", "elapsed_s", "budget_s", "retry_allowed")


@query("""
SELECT event_id AS request_id, tool, (max(t - rn * gap) OVER w + rn * gap) / 1000000.0 AS slot FROM (
  SELECT event_id, tool, CAST(epoch_us(ts) AS DOUBLE) AS t, row_number() OVER (PARTITION BY tool ORDER BY ts, event_id) AS rn,
    60000000.0 / CASE tool WHEN 'crtsh' THEN 5 WHEN 'dns-resolver' THEN 60 WHEN 'shodan-lookup' THEN 60 WHEN 'asn-bgp' THEN 20 ELSE 10 END AS gap FROM ev)
WINDOW w AS (PARTITION BY tool ORDER BY rn)""")
def j6_slots(spark: SparkSession, d: str) -> DataFrame:
    r = fx.events(spark, d).select(F.col("event_id").alias("request_id"), "tool", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return joblog.slots(r, tool_spec(spark)).select("request_id", "tool", "slot")


@query("SELECT event_id AS request_id, tool, CAST(row_number() OVER (PARTITION BY tool, date_trunc('month', ts) ORDER BY ts, event_id) AS INTEGER) AS rn, tool <> 'shodan-lookup' OR row_number() OVER (PARTITION BY tool, date_trunc('month', ts) ORDER BY ts, event_id) <= 100 AS admitted FROM ev")
def j7_quota(spark: SparkSession, d: str) -> DataFrame:
    return joblog.quota(fx.events(spark, d).withColumnRenamed("event_id", "request_id"), tool_spec(spark)).select("request_id", "tool", "rn", "admitted")


@query("""
SELECT job_id, CASE WHEN k >= 95 THEN 'timeout' WHEN code = 200 THEN 'done' ELSE 'error' END AS status, code AS exit_code, seconds, n AS attempts, CASE WHEN k < 35 THEN CASE WHEN n > 1 THEN n || '. deneme: ' ELSE '' END || 'code ' || k END AS error
FROM (SELECT *, max(n) OVER (PARTITION BY job_id) AS m FROM att) WHERE n = m""")
def j8_job_rows(spark: SparkSession, d: str) -> DataFrame:
    return joblog.fold_attempts(fx.attempts(spark, d))


# -- 2.7 triage --------------------------------------------------------------------------------------------------


def _triaged(spark: SparkSession, d: str) -> DataFrame:
    new = fx.ingested(spark, d)
    return triage.judged(triage.entity_list(new.entities, new.observations, new.relationships, fx.investigations(spark, d)))


@query("SELECT entity_id, tools, flag AS hedefe_ait_degil, false AS saglayici_olabilir FROM ev1")
def t1_evidence(spark: SparkSession, d: str) -> DataFrame:
    return triage.evidence(fx.ingested(spark, d).observations).select("entity_id", F.array_join("tools", ",").alias("tools"), "hedefe_ait_degil", "saglayici_olabilir")


@query("SELECT inv_id, src_id AS entity_id FROM rel UNION SELECT inv_id, dst_id FROM rel")
def t2_connected(spark: SparkSession, d: str) -> DataFrame:
    return triage.connected(fx.ingested(spark, d).relationships)


@query("SELECT entity_id, inv_id, type, norm, tools, flag AS hedefe_ait_degil, connected, is_root FROM lst")
def t3_entity_list(spark: SparkSession, d: str) -> DataFrame:
    return _triaged(spark, d).select("entity_id", "inv_id", "type", "norm", F.array_join("tools", ",").alias("tools"), "hedefe_ait_degil", "connected", "is_root")


@query("""
SELECT entity_id, triage, array_to_string(list_filter([CASE WHEN is_root THEN 'root of the investigation' END,
  CASE WHEN n_tools = 0 THEN 'no direct observation' ELSE type || ': threshold of ' || threshold || ' tools ' || CASE WHEN n_tools < threshold THEN 'missed' ELSE 'met' END END,
  CASE WHEN NOT connected THEN 'no relation' END, CASE WHEN flag THEN 'may not belong to the target' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM tri""")
def t4_groups(spark: SparkSession, d: str) -> DataFrame:
    return _triaged(spark, d).select("entity_id", "triage", F.array_join("reasons", "; ").alias("reasons"))


@query("SELECT inv_id, position, entity_id, type, norm, triage, n_tools FROM pos")
def t5_triage_order(spark: SparkSession, d: str) -> DataFrame:
    return triage.ordered(_triaged(spark, d)).select("inv_id", "position", "entity_id", "type", "norm", "triage", "n_tools")


@query("SELECT inv_id, triage, count(*) AS n FROM tri GROUP BY ALL")
def t6_group_counts(spark: SparkSession, d: str) -> DataFrame:
    return triage.group_counts(_triaged(spark, d))


@query("SELECT inv_id, position, entity_id, CAST(p AS INTEGER) AS page FROM (SELECT *, least(2, greatest(1, ceil(count(*) OVER (PARTITION BY inv_id) / 100.0))) AS p FROM pos) WHERE position > (p - 1) * 100 AND position <= p * 100")
def t6_page(spark: SparkSession, d: str) -> DataFrame:
    return triage.page(triage.laid_out(_triaged(spark, d)), 2).select("inv_id", "position", "entity_id", "page")


@query("SELECT inv_id, position, entity_id, CAST(p AS INTEGER) AS page FROM (SELECT *, row_number() OVER (PARTITION BY inv_id ORDER BY position) AS k, least(3, greatest(1, ceil(count(*) OVER (PARTITION BY inv_id) / 50.0))) AS p FROM pos WHERE triage = 'review') WHERE k > (p - 1) * 50 AND k <= p * 50")
def t6_group_page(spark: SparkSession, d: str) -> DataFrame:
    return triage.page(triage.laid_out(_triaged(spark, d)), 3, "review", 50).select("inv_id", "position", "entity_id", "page")


# -- 2.8 graph and evidence --------------------------------------------------------------------------------------


@query("""
SELECT entity_id, direction, rel_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY s, t, rel_id) AS INTEGER) AS position FROM (
  SELECT src_id AS entity_id, 'out' AS direction, rel_id, a.norm AS s, b.norm AS t FROM rel JOIN ent a ON a.entity_id = src_id JOIN ent b ON b.entity_id = dst_id
  UNION ALL SELECT dst_id, 'in', rel_id, a.norm, b.norm FROM rel JOIN ent a ON a.entity_id = src_id JOIN ent b ON b.entity_id = dst_id)""")
def g1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    new = fx.ingested(spark, d)
    return graph.neighbours(new.relationships, new.entities).select("entity_id", "direction", "rel_id", "position")


@query("SELECT obs_id, entity_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY tm DESC, obs_id) AS INTEGER) AS position FROM obs")
def e1_evidence_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph.evidence_chain(fx.ingested(spark, d).observations).select("obs_id", "entity_id", "position")


@query("SELECT obs_id, entity_id, job_id, inv_id FROM obs")
def e2_lineage(spark: SparkSession, d: str) -> DataFrame:
    new = fx.ingested(spark, d)
    return graph.lineage(new.observations, fx.jobs(spark, d), new.entities).select("obs_id", "entity_id", "job_id", "inv_id")


# -- 2.9 scoring -------------------------------------------------------------------------------------------------


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return scoring.candidates(triage.laid_out(_triaged(spark, d)))


@query("SELECT inv_id, entity_id, position AS place, CAST((position - 1) // 120 AS INTEGER) AS batch FROM pos")
def a2_batches(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("inv_id", "entity_id", "place", "batch")


@query("SELECT inv_id, entity_id, position AS place, CAST((position - 1) // 7 AS INTEGER) AS batch FROM pos WHERE (position - 1) // 7 BETWEEN 1 AND 2")
def a2_some_batches(spark: SparkSession, d: str) -> DataFrame:
    return scoring.batches(triage.laid_out(_triaged(spark, d)), 1, 2, 7).select("inv_id", "entity_id", "place", "batch")


#: Every third entity of a batch has a stored score.
_RECORD = """'["' || replace(tools, ',', '","') || '"]'"""
_BATCHES = f"""
WITH c AS (SELECT *, CAST((position - 1) // 120 AS INTEGER) AS batch, CASE WHEN tools = '' THEN '[]' ELSE {_RECORD} END AS tool_list, CASE WHEN flag THEN '["hedefe_ait_degil"]' ELSE '[]' END AS flag_list FROM pos),
h AS (SELECT inv_id, batch, sha256('2.0' || chr(10) || string_agg('{{"entity_id":"' || entity_id || '","type":"' || type || '","norm":"' || norm || '","n_tools":' || n_tools || ',"tools":' || tool_list || ',"triage":"' || triage || '","flags":' || flag_list || ',"connected":' || connected || '}}', ',' ORDER BY position)) AS input_hash FROM c GROUP BY ALL),
l AS (SELECT *, 'v' || row_number() OVER (PARTITION BY inv_id, batch ORDER BY position) AS label FROM c WHERE position % 3 <> 0),
r AS (SELECT inv_id, batch, count(*) AS n, '[' || string_agg('{{"id":"' || label || '","tip":"' || type || '","deger":"' || norm || '","farkli_tool":' || n_tools || ',"tools":' || tool_list || ',"on_eleme_grubu":"' || triage || '","isaretler":' || flag_list || ',"iliskisi_var":' || connected || '}}', ', ' ORDER BY position) || ']' AS body FROM l GROUP BY ALL)
SELECT inv_id, batch, n, greatest(1, CAST(round_even(n * 0.03, 0) AS BIGINT)) AS budget_90, greatest(1, CAST(round_even(n * 0.03, 0) AS BIGINT), CAST(round_even(n * 0.08, 0) AS BIGINT)) AS budget_80, input_hash, body, substr(sha256(body), 1, 16) AS delimiter FROM r JOIN h USING (inv_id, batch)"""


@query(_BATCHES.replace("\nWITH c AS", ", c AS", 1))
def a5_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(_candidates(spark, d))
    hashes = scoring.input_hashes(rows)
    stored = rows.join(hashes, ["inv_id", "batch"]).where("place % 3 = 0").select("entity_id", "input_hash", F.lit(scoring.PROMPT_VERSION).alias("prompt_version"))
    made = scoring.requests(scoring.uncached(rows, hashes, stored))
    return made.select("inv_id", "batch", "n", "budget_90", "budget_80", "input_hash", "body", "delimiter")


def _responses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Responses for up to 120 customers, with a score each; labels by rank of the customer's key."""
    from pyspark.sql import Window

    c = fx.read(spark, d, "customer").select(F.expr("c_custkey div 120").alias("batch"), "c_custkey", "c_name", F.floor("c_acctbal").cast("bigint").alias("v"))
    c = c.withColumn("label", F.concat(F.lit("v"), F.row_number().over(Window.partitionBy("batch").orderBy("c_custkey")).cast("string"))).withColumn("inv_id", F.lit("i"))
    one = F.to_json(F.struct(F.col("label").alias("id"), (F.col("v") % 300).alias("skor"), F.col("c_name").alias("gerekce"), F.array(F.lit("A b"), F.lit("a b"), F.lit("c!")).alias("etiketler")))
    scores = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", one.alias("j")))), lambda s: s["j"]), ",")
    hyp = '{"baslik":"t","aciklama":"b","guven":50,"ids":["v2","v1","v2","v999999"]},{"baslik":"t","aciklama":"b","guven":true,"ids":["v1"]}'
    body = F.concat(F.lit('{"skorlar":['), scores, F.lit(',{"id":"v1","skor":5,"gerekce":"again"},{"id":"x1","skor":5,"gerekce":"g"},7],"hipotezler":['), F.lit(hyp), F.lit("]}"))
    return c.groupBy("inv_id", "batch").agg(body.alias("response")), c.select("inv_id", "batch", "label", F.col("c_custkey").cast("string").alias("entity_id"))


_LABELLED = "WITH c AS (SELECT c_custkey // 120 AS batch, c_custkey, c_name, CAST(floor(c_acctbal) AS BIGINT) % 300 AS v, row_number() OVER (PARTITION BY c_custkey // 120 ORDER BY c_custkey) AS r FROM customer)"


@query(f"{_LABELLED} SELECT batch, CAST(c_custkey AS VARCHAR) AS entity_id, CAST(CASE WHEN v BETWEEN 0 AND 100 THEN v ELSE 5 END AS SMALLINT) AS score, CASE WHEN v BETWEEN 0 AND 100 THEN c_name ELSE 'again' END AS reason, CASE WHEN v BETWEEN 0 AND 100 THEN 'a b,c' ELSE '' END AS tags FROM c WHERE v BETWEEN 0 AND 100 OR r = 1", False)
def a7_scores(spark: SparkSession, d: str) -> DataFrame:
    scores, _, _ = scoring.checked_scores(*_responses(spark, d))
    return scores.select("batch", "entity_id", "score", "reason", F.array_join("tags", ",").alias("tags"))


@query(f"{_LABELLED} SELECT batch, 't' AS title, 'b' AS body, CAST(50 AS SMALLINT) AS confidence, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY r DESC) AS ids FROM c WHERE r <= 2 GROUP BY batch", False)
def a9_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    return scoring.checked_hypotheses(*_responses(spark, d)).select("batch", "title", "body", "confidence", F.array_join("entity_ids", ",").alias("ids"))


_LIVE = "(SELECT DISTINCT o_custkey FROM orders)"


def _live(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "orders").select(F.lit("i").alias("inv_id"), F.col("o_custkey").cast("string").alias("entity_id")).distinct()


@query(f"{_LABELLED}, s AS (SELECT * FROM c WHERE v BETWEEN 0 AND 100 OR r = 1) SELECT batch, CAST(c_custkey AS VARCHAR) AS entity_id FROM s JOIN {_LIVE} ON o_custkey = c_custkey", False)
def a10_live_scores(spark: SparkSession, d: str) -> DataFrame:
    responses, labels = _responses(spark, d)
    scores, _, _ = scoring.checked_scores(responses, labels)
    return scoring.live_only(scores, scoring.checked_hypotheses(responses, labels), _live(spark, d))[0].select("batch", "entity_id")


@query(f"{_LABELLED} SELECT batch, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY r DESC) AS ids FROM c JOIN {_LIVE} ON o_custkey = c_custkey WHERE r <= 2 AND (v BETWEEN 0 AND 100 OR r = 1) GROUP BY batch", False)
def a10_live_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    responses, labels = _responses(spark, d)
    scores, _, _ = scoring.checked_scores(responses, labels)
    return scoring.live_only(scores, scoring.checked_hypotheses(responses, labels), _live(spark, d))[1].select("batch", F.array_join("entity_ids", ",").alias("ids"))


@query(f"""{_LABELLED}, s AS (SELECT *, v BETWEEN 0 AND 100 AS fine, o_custkey IS NOT NULL AS live FROM c LEFT JOIN {_LIVE} ON o_custkey = c_custkey),
n AS (SELECT batch, count(*) FILTER (r <= 2 AND live AND (fine OR r = 1)) AS ids FROM s GROUP BY batch)
SELECT 'i' AS inv_id, CAST(count(*) FILTER (live AND (fine OR r = 1)) AS BIGINT) AS scores_written, (SELECT count(*) FROM n WHERE ids > 0) AS hypotheses_written,
  count(*) FILTER (NOT fine) + count(*) FILTER (NOT live AND (fine OR r = 1)) - count(*) FILTER (r = 1 AND NOT fine) + 3 * count(DISTINCT batch) + count(DISTINCT batch) + (SELECT count(*) FROM n WHERE ids = 0) AS hallucinated,
  count(*) FILTER (NOT fine AND r <> 1) AS missing FROM s""", False)
def a10_counters(spark: SparkSession, d: str) -> DataFrame:
    return scoring.counters(*_responses(spark, d), _live(spark, d))


@query("SELECT entity_id, assessment_id, CAST(score AS SMALLINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, assessment_id DESC) AS r FROM ass) WHERE r = 1")
def a11_latest(spark: SparkSession, d: str) -> DataFrame:
    return scoring.latest(fx.assessments(spark, d)).select("entity_id", "assessment_id", "score")


_SEVERITY = "CASE WHEN score IS NULL THEN 'unscored' WHEN score >= 90 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END"


@query(f"SELECT v AS inv_id, s AS severity, count(x.score) AS n FROM (SELECT DISTINCT prompt_version AS v FROM ass), (VALUES ('critical'), ('high'), ('medium'), ('low'), ('unscored')) AS t(s) LEFT JOIN ass x ON x.prompt_version = v AND {_SEVERITY.replace('score', 'x.score')} = s GROUP BY ALL")
def a12_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.severity_counts(fx.assessments(spark, d).select(F.col("prompt_version").alias("inv_id"), "score"))


# -- 2.10 report -------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, regexp_replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_{}\[\]()#+.!|~\-])', '\\\1', 'g') AS text FROM pages", False)
def r1_escaped(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "pages").select("page_id", report.escaped(F.col("url")).alias("text"))


@query("SELECT i.inv_id, (SELECT count(*) FROM ent e WHERE e.inv_id = i.inv_id) AS entities, (SELECT count(*) FROM obs o WHERE o.inv_id = i.inv_id) AS observations, (SELECT count(*) FROM rel r WHERE r.inv_id = i.inv_id) AS relations, (SELECT count(*) FROM job j WHERE j.inv_id = i.inv_id) AS jobs FROM inv i")
def r3_totals(spark: SparkSession, d: str) -> DataFrame:
    new = fx.ingested(spark, d)
    return report.totals(new.entities, new.observations, new.relationships, fx.jobs(spark, d))


def _hypotheses(spark: SparkSession, d: str) -> DataFrame:
    h = fx.read(spark, d, "customer")
    return h.select(F.col("c_custkey").cast("string").alias("hyp_id"), F.lit("example.com").alias("inv_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("body"), F.lit(50).cast("smallint").alias("confidence"), F.array(F.sha2(F.concat_ws("\u0001", F.lit("example.com"), F.lit("domain"), F.lit("example.com")), 256), F.col("c_name")).alias("entity_ids"), F.lit("m").alias("model"), F.when(F.col("c_nationkey") < 12, "confirmed").otherwise("open").alias("analyst_status"), F.timestamp_seconds(F.col("c_custkey")).alias("created_at"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS hyp_id, c_nationkey < 12 AS confirmed, sha256('example.com' || chr(1) || 'domain' || chr(1) || 'example.com') || ', outside the investigation or missing' AS ids FROM customer", False)
def r4_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    return report.hypothesis_rows(_hypotheses(spark, d), fx.ingested(spark, d).entities).select("hyp_id", "confirmed", "ids")


def _report_lines(spark: SparkSession, d: str) -> DataFrame:
    new, inv = settled(fx.ingested(spark, d)), fx.investigations(spark, d)
    listed = triage.ordered(triage.judged(triage.entity_list(new.entities, new.observations, new.relationships, inv)))
    return report.sections(inv, listed, new.observations, new.relationships, fx.jobs(spark, d), fx.assessments(spark, d), _hypotheses(spark, d), new.entities)


def _sql_line(*cells: str) -> str:
    """R1 and a table's row in SQL."""
    out = []
    for c in cells:
        c = f"trim(regexp_replace(coalesce(CAST({c} AS VARCHAR), '—'), '\\s+', ' ', 'g'))"
        c = f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
        out.append(rf"regexp_replace({c}, '([\\`*_{{}}\[\]()#+.!|~\-])', '\\\1', 'g')")
    return f"'| ' || concat_ws(' | ', {', '.join(out)}) || ' |'"


_TIME = "strftime(make_timestamp(CAST({} AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')"
_REASONS = """array_to_string(list_filter([CASE WHEN is_root THEN 'root of the investigation' END,
  CASE WHEN n_tools = 0 THEN 'no direct observation' ELSE type || ': threshold of ' || threshold || ' tools ' || CASE WHEN n_tools < threshold THEN 'missed' ELSE 'met' END END,
  CASE WHEN NOT connected THEN 'no relation' END, CASE WHEN flag THEN 'may not belong to the target' END], lambda x: x IS NOT NULL), '; ')"""
_IDS = "sha256('example.com' || chr(1) || 'domain' || chr(1) || 'example.com') || ', outside the investigation or missing'"
_REPORT = f""", b AS (
  SELECT inv_id, CASE triage WHEN 'priority' THEN 1 WHEN 'review' THEN 2 WHEN 'context' THEN 3 ELSE 4 END AS section, '+' || lpad(CAST(position AS VARCHAR), 12, '0') AS k1, '' AS k2, '' AS k3,
    {_sql_line("entity_id", "type", "raw", "obs_count", "n_tools", "replace(tools, ',', ', ')", _REASONS)} AS line FROM pos
  UNION ALL SELECT inv_id, 5, '+' || type, rel_id, '', {_sql_line("src_id", "type", "dst_id")} FROM rel
  UNION ALL SELECT inv_id, 6, '+' || {_TIME.format("tm")}, job_id, '', {_sql_line("job_id", "tool", "target_value", "status", "1", "NULL")} FROM job
  UNION ALL SELECT inv_id, 7, '+' || entity_id, {_TIME.format("tm")}, obs_id,
    {_sql_line("obs_id", "entity_id", "tool || ' / 1.0'", "CASE tool WHEN 'crtsh' THEN 90 WHEN 'subfinder' THEN 70 WHEN 'dns-resolver' THEN 85 WHEN 'theharvester' THEN 60 ELSE 90 END", _TIME.format("tm"), "'/archive/' || job_id || '/output.json'", "'$[' || seq || '].url'")} FROM obs
  UNION ALL SELECT 'example.com', CASE WHEN c_nationkey < 12 THEN 9 ELSE 10 END, '+' || {_TIME.format("c_custkey")}, CAST(c_custkey AS VARCHAR), '',
    {_sql_line("c_name", "c_mktsegment", "50", "CASE WHEN c_nationkey < 12 THEN 'confirmed' ELSE 'open' END", _IDS, "'m'")} FROM customer),
m AS (SELECT i.inv_id, count(*) FILTER (section = 1) AS n1, count(*) FILTER (section = 2) AS n2, count(*) FILTER (section = 3) AS n3, count(*) FILTER (section = 4) AS n4,
  count(*) FILTER (section = 5) AS n5, count(*) FILTER (section = 6) AS n6, count(*) FILTER (section = 7) AS n7 FROM inv i LEFT JOIN b ON b.inv_id = i.inv_id GROUP BY i.inv_id),
f AS (SELECT inv_id, x.s AS section, x.l AS line, n AS place FROM (SELECT inv_id, unnest(l) AS x, unnest(range(0, 16)) AS n FROM (SELECT inv_id, [
  {{'s': 0, 'l': '# Report: ' || replace('round ' || inv_id, '.', '\\.')}}, {{'s': 0, 'l': '- Root: ' || replace(inv_id, '.', '\\.')}}, {{'s': 0, 'l': '- Scope: a &lt;scope&gt; &amp; more'}}, {{'s': 0, 'l': '- Created by: driver'}}, {{'s': 0, 'l': '- Authorized: no'}},
  {{'s': 0, 'l': 'Entities: ' || (n1 + n2 + n3 + n4) || ' · Observations: ' || n7 || ' · Relations: ' || n5 || ' · Jobs: ' || n6}},
  {{'s': 1, 'l': '## priority (' || n1 || ')'}}, {{'s': 2, 'l': '## review (' || n2 || ')'}}, {{'s': 3, 'l': '## context (' || n3 || ')'}}, {{'s': 4, 'l': '## certificate (' || n4 || ')'}},
  {{'s': 5, 'l': '## Relations'}}, {{'s': 6, 'l': '## Jobs'}}, {{'s': 7, 'l': '## Evidence'}}, {{'s': 8, 'l': '## Latest assessments'}}, {{'s': 9, 'l': '## Confirmed hypotheses'}}, {{'s': 10, 'l': '## Other hypotheses'}}] AS l FROM m))),
g AS (SELECT inv_id, CAST(section AS INTEGER) AS section, k1, k2, k3, line FROM b UNION ALL SELECT inv_id, CAST(section AS INTEGER), ' ' || lpad(CAST(place AS VARCHAR), 2, '0'), '', '', line FROM f)
"""


@query(_REPORT + "SELECT inv_id, section, line FROM g")
def r2_report_sections(spark: SparkSession, d: str) -> DataFrame:
    return _report_lines(spark, d).select("inv_id", "section", "line")


@query(_REPORT + "SELECT inv_id, string_agg(line, chr(10) ORDER BY section, k1, k2, k3) AS markdown FROM g GROUP BY inv_id")
def r5_reports(spark: SparkSession, d: str) -> DataFrame:
    return report.documents(_report_lines(spark, d))


@query(_REPORT + "SELECT inv_id, row_number() OVER (PARTITION BY inv_id ORDER BY section, k1, k2, k3, line) AS place, line FROM g")
def r5_document_lines(spark: SparkSession, d: str) -> DataFrame:
    return report.document_lines(_report_lines(spark, d))


# -- 2.11 documented queries -------------------------------------------------------------------------------------


@query("SELECT c.c_custkey, c_name, CAST(s.score AS SMALLINT) AS score FROM customer c LEFT JOIN (SELECT entity_id, arg_max(score, (ts, assessment_id)) AS score FROM ass GROUP BY entity_id) s ON s.entity_id = CAST(c_custkey AS VARCHAR)")
def q1_ranked_by_score(spark: SparkSession, d: str) -> DataFrame:
    people = fx.read(spark, d, "customer").select("c_custkey", "c_name", F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_nationkey").alias("obs_count"))
    return summaries.ranked_by_score(people, fx.assessments(spark, d)).select("c_custkey", "c_name", "score")


@query("SELECT entity_id, norm FROM ent WHERE obs_count = 1")
def q2_single_observation(spark: SparkSession, d: str) -> DataFrame:
    return summaries.single_observation(fx.ingested(spark, d).entities).select("entity_id", "norm")


@query("SELECT type, count(*) AS n, avg(CASE WHEN n_tools = 1 THEN 1.0 ELSE 0.0 END) AS share FROM lst GROUP BY ROLLUP (type)")
def q3_single_source_share(spark: SparkSession, d: str) -> DataFrame:
    return summaries.single_source_share(_triaged(spark, d))


@query("SELECT tool, count(*) AS observations, count(DISTINCT entity_id) AS entities, count(*) / count(DISTINCT entity_id) AS per_entity FROM obs GROUP BY tool")
def q4_observations_per_entity(spark: SparkSession, d: str) -> DataFrame:
    return summaries.observations_per_entity(fx.ingested(spark, d).observations)


@query("""SELECT CASE WHEN score >= 90 THEN '90-100' WHEN score >= 80 THEN '80-89' WHEN score >= 70 THEN '70-79' WHEN score >= 50 THEN '50-69' WHEN score >= 30 THEN '30-49' ELSE '0-29' END AS band,
  count(*) FILTER (prompt_version = '1.0') AS v1, count(*) FILTER (prompt_version = '2.0') AS v2 FROM ass GROUP BY band""")
def q5_score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return summaries.score_histogram(fx.assessments(spark, d), ["1.0", "2.0"]).withColumnsRenamed({"1.0": "v1", "2.0": "v2"})


@query("SELECT reason, count(DISTINCT entity_id) AS entities, avg(score) AS mean_score FROM ass GROUP BY reason HAVING count(DISTINCT entity_id) > 1")
def q6_repeated_reasons(spark: SparkSession, d: str) -> DataFrame:
    return summaries.repeated_reasons(fx.assessments(spark, d))


@query("SELECT type, count(*) AS n, count(*) / (SELECT count(*) FROM ent) AS share FROM ent GROUP BY type")
def q7_type_shares(spark: SparkSession, d: str) -> DataFrame:
    return summaries.type_shares(fx.ingested(spark, d).entities)
