"""Extraction with bad input, ingest laws, chaining, job log, triage, graph, scoring, report and the streaming path."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import chain, graph, ingest as ing, jobs as joblog, report, scoring, triage
from tidemark.plans import queries
from tidemark.sources import archive, extract
from tidemark.streaming.incremental import Store, merge_batch, stream_archive

T0 = dt.datetime(2024, 1, 1)
JOB = "job_id string, inv_id string, tool string, tool_version string, target_value string, status string, depth smallint, created_at timestamp, ended_at timestamp"


def job(spark, *rows):
    return spark.createDataFrame([(i, "inv", tool, "1.0", "example.com", "done", depth, T0 + dt.timedelta(hours=n), None) for n, (i, tool, depth) in enumerate(rows)], JOB)


def bodies(spark, *texts):
    return spark.createDataFrame([(f"j{i}", t if isinstance(t, bytes) else t.encode()) for i, t in enumerate(texts)], "job_id string, content binary")


BAD = ["", "<html>502</html>", "17", '"text"', "null", b"\xff\xfe{", "[1,2]", "{}", "[{]"]


@pytest.mark.parametrize("tool", list(extract.EXTRACTORS))
def test_bad_bodies_give_no_rows(spark, tool):
    assert extract.EXTRACTORS[tool](bodies(spark, *BAD)).count() == 0


def test_ct_log_skips_broken_records_and_names(spark):
    good = {"name_value": "*.a.example.com\nb.example.com\nbad name\nx@example.com", "common_name": "b.example.com", "serial_number": "0aff", "id": 9}
    got = extract.extract_ct_log(bodies(spark, json.dumps([5, good, {"name_value": 3}, {"common_name": "c.example.com"}]))).collect()
    assert [(r.type, r.raw, r.raw_path, len(r.relations)) for r in sorted(got, key=lambda r: r.seq)] == [
        ("subdomain", "*.a.example.com", "$[1].name_value", 1), ("subdomain", "b.example.com", "$[1].name_value", 1), ("cert", "0aff", "$[1]", 0), ("subdomain", "c.example.com", "$[3].name_value", 0)
    ]
    assert json.loads(got[0].data or "{}").get("wildcard") in (True, None)


def test_bgp_limit_and_holder_names(spark):
    body = {"network_info": {"prefix": "192.0.2.0/24"}, "asn_bilgi": {"13335": {"holder": "NET - Net, Inc."}, "65000": {"holder": "H-AS Holder GmbH"}}, "prefixler": {"13335": {"sayi": 51, "liste": ["10.0.0.0/8"]}, "65000": {"sayi": 1, "liste": ["10.0.0.0/8"]}}}
    got = [(r.type, r.raw, json.loads(r.data)) for r in extract.extract_bgp(bodies(spark, json.dumps(body))).collect()]
    assert sorted((t, v) for t, v, _ in got) == [("asn", "13335"), ("asn", "65000"), ("netblock", "10.0.0.0/8"), ("org", "Holder GmbH"), ("org", "Net, Inc.")]
    cloud = next(d for t, v, d in got if v == "13335")
    assert cloud["hedefe_ait_degil"] is True and cloud["prefiks_sinir_asildi"] is True and "saglayici_olabilir" not in cloud


PARSED = schema.TABLES["parsed_observation"]


def parsed(spark, *rows):
    """(job, seq, type, raw, relations)."""
    return spark.createDataFrame([(j, s, t, r, "{}", None, "$", rel) for j, s, t, r, rel in rows], PARSED)


def sample(spark):
    rel = [("subdomain_of", "domain", "Example.com.", "out"), ("cert_for", "cert", "zz", "in")]
    return parsed(spark, ("a", 0, "subdomain", "WWW.Example.com", rel), ("a", 1, "subdomain", "www.example.com.", []), ("b", 0, "subdomain", "https://www.example.com/x", []), ("b", 1, "ip", "nope", rel), ("b", 2, "subdomain", "example.com", rel[:1]))


def test_ingest_merges_spellings_and_traces_rejects(spark):
    new = ing.ingest(sample(spark), job(spark, ("a", "crtsh", 0), ("b", "crtsh", 0)))
    got = {(r.type, r.norm): (r.raw, r.obs_count) for r in new.entities.collect()}
    assert got == {("subdomain", "www.example.com"): ("WWW.Example.com", 3), ("domain", "example.com"): ("Example.com.", 1)}
    assert [(r.type) for r in new.relationships.collect()] == ["subdomain_of"]
    assert sorted((r.job_id, r.seq, r.rel_pos, r.type) for r in new.rejected.collect()) == [("a", 0, 1, "cert"), ("b", 1, None, "ip")]
    assert new.observations.count() == 4 and {r.confidence for r in new.observations.collect()} == {90}
    assert {r.job_id: (r.observations, r.relations, r.skipped) for r in new.summary.collect()} == {"a": (2, 1, 1), "b": (2, 0, 1)}


def test_merge_equals_ingest_of_all_and_replay_adds_nothing(spark):
    jobs, rows = job(spark, ("a", "crtsh", 0), ("b", "crtsh", 0)), sample(spark)
    whole = ing.ingest(rows, jobs)
    one, two = (ing.ingest(rows.where(F.col("job_id") == j), jobs) for j in "ab")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(ing.merge_entities(one.entities, two.entities).select(*whole.entities.columns)) == key(whole.entities)
    assert key(ing.merge_relationships(one.relationships, two.relationships).select("rel_id", "first_seen")) == key(whole.relationships.select("rel_id", "first_seen"))
    assert ing.only_new(rows, whole.observations).where("raw <> 'nope'").count() == 0


def test_streaming_ingest_and_replay(spark, tmp_path):
    for j, name in (("s1", "a.example.com"), ("s2", "b.example.com")):
        (tmp_path / "raw" / j).mkdir(parents=True)
        (tmp_path / "raw" / j / "output.jsonl").write_text(json.dumps({"host": name, "input": "example.com", "source": "x"}))
    jobs, store = job(spark, ("s1", "subfinder", 0), ("s2", "subfinder", 0)), Store(spark, f"{tmp_path}/store")
    query = stream_archive(spark, f"{tmp_path}/raw", jobs, store, f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    before = sorted((r.norm, r.obs_count) for r in store.read("entity").collect())
    assert before == [("a.example.com", 1), ("b.example.com", 1), ("example.com", 0)]
    merge_batch(store, archive.read_archive(spark, f"{tmp_path}/raw").select("job_id", "content"), jobs)
    assert sorted((r.norm, r.obs_count) for r in store.read("entity").collect()) == before and store.read("observation").count() == 2


def test_parallel_writers_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    jobs, store = job(spark, *[(f"w{i}", "subfinder", 0) for i in range(3)]), Store(spark, f"{tmp_path}/store", buckets=4)
    line = json.dumps({"host": "a.example.com", "input": "example.com", "source": "x"})

    def write(i):
        merge_batch(store, spark.createDataFrame([(f"w{i}", line.encode())], "job_id string, content binary"), jobs)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    assert sorted((r.norm, r.obs_count) for r in store.read("entity").collect()) == [("a.example.com", 3), ("example.com", 0)]
    assert store.read("observation").count() == 3 and store.read("relationship").count() == 1 and store.version() == 2


def test_tables_are_written_and_read(spark, tmp_path):
    row = spark.createDataFrame([("r", "i", "a", "b", "runs_on", T0, T0, None)], schema.TABLES["relationship"])
    for mode in ("append", "overwrite"):
        schema.write_table(row, str(tmp_path), "relationship", mode)
        assert [tuple(r) for r in schema.read_table(spark, str(tmp_path), "relationship").where("inv_id = 'i'").select(row.columns).collect()] == [tuple(row.first())]
    seen = spark.createDataFrame([("o", "e", "j", "t", "1", None, None, 5, "{}", T0)], schema.TABLES["observation"])
    schema.write_table(seen, str(tmp_path), "observation")
    schema.write_table(seen, str(tmp_path), "observation")
    assert schema.read_table(spark, str(tmp_path), "observation").count() == 2
    with pytest.raises(ValueError):
        schema.write_table(seen, str(tmp_path), "observation", "overwrite")


def test_chain_edges_reach_and_depth(spark):
    tools = schema.tool_spec(spark)
    assert ("subfinder", "subdomain", "dns-resolver") in {tuple(r) for r in chain.edges(tools).collect()}
    reach = {r.tool: r.depth for r in chain.reachable(tools, spark.createDataFrame([("domain",)], "root_type string")).collect()}
    assert reach["crtsh"] == 0 and reach["shodan-lookup"] == 1
    seen = spark.createDataFrame([("d2", "subdomain", "a.example.com"), ("d3", "subdomain", "b.example.com"), ("d2", "subdomain", "a.example.com")], "job_id string, type string, norm string")
    inv = spark.createDataFrame([("inv", [])], "inv_id string, selected_tools array<string>")
    got = chain.chained_jobs(seen, job(spark, ("d2", "x", 2), ("d3", "x", 3)), inv, tools).collect()
    assert [(r.tool, r.target_value, r.depth, r.parent_job_id) for r in got] == [("dns-resolver", "a.example.com", 3, "d2")]


def test_slots_follow_the_recurrence(spark):
    import random

    rng = random.Random(1)
    times = sorted(rng.uniform(0, 300) for _ in range(60))
    got = joblog.slots(spark.createDataFrame([(i, "crtsh", t) for i, t in enumerate(times)], "request_id int, tool string, t double"), schema.tool_spec(spark)).collect()
    last, want = float("-inf"), {}
    for i, t in enumerate(times):
        last = want[i] = max(t, last + 12)
    assert all(abs(r.slot - want[r.request_id]) < 1e-6 for r in got)


def test_retry_audit_of_long_jobs(spark):
    rows = [(job, tool, n, True, False, None, 0.5) for job, tool in (("a", "crtsh"), ("b", "none")) for n in range(1, 1101)]
    attempts = spark.createDataFrame(rows, "job_id string, tool string, n int, timed_out boolean, success boolean, code int, seconds double")
    tools = schema.tool_spec(spark).where("tool = 'crtsh'").select("tool", "timeout_s", "max_attempts", F.lit(2.0).alias("backoff_s"), "run_mode")
    tools = tools.union(tools.select(F.lit("none"), "timeout_s", "max_attempts", F.lit(0.0), "run_mode"))
    got = {(r.job_id, r.n): (r.wait_s, r.elapsed_s) for r in joblog.retry_audit(attempts, tools).collect()}
    power = lambda n: 2.0 ** (n - 1) if n <= 1024 else float("inf")
    want = {("a", n): (2 * power(n), n * 0.5 + 2 * (power(n) - 1)) for n in range(1, 1101)} | {("b", n): (0.0, n * 0.5) for n in range(1, 1101)}
    assert got == want


def test_retry_audit_query_has_every_attempt(spark, tmp_path):
    events = spark.range(70).select(F.col("id").alias("event_id"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 40}').alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.n for r in queries.QUERIES["j5_retry_audit"](spark, str(tmp_path)).collect()) == list(range(1, 71))


def test_triage_flags_must_be_booleans(spark):
    obs = spark.createDataFrame([("e", "t1", '{"hedefe_ait_degil":"true"}'), ("e", "t2", '{"saglayici_olabilir":true}'), ("e", "t2", '{"saglayici_olabilir":false}'), ("f", "t1", None)], "entity_id string, tool string, data string")
    got = {r.entity_id: (r.tools, r.hedefe_ait_degil, r.saglayici_olabilir) for r in triage.evidence(obs).collect()}
    assert got == {"e": (["t1", "t2"], False, True), "f": (["t1"], False, False)}


def test_neighbours_leave_out_other_investigations(spark):
    ent = spark.createDataFrame([(f"e{i}", "i1" if i < 60 else "i2", "ip", f"n{i:02d}") for i in range(62)], "entity_id string, inv_id string, type string, norm string")
    edges = [(f"r{i:02d}", "i1", "e0", f"e{i}", "runs_on") for i in range(1, 55)] + [("x1", "i1", "e0", "e61", "runs_on"), ("x2", "i2", "e0", "e1", "runs_on")]
    rows = graph.neighbours(spark.createDataFrame(edges, "rel_id string, inv_id string, src_id string, dst_id string, type string"), ent)
    assert [graph.neighbour_page(rows, "e0", n).count() for n in (1, 2, 999)] == [50, 4, 4]


def test_scores_of_wrong_kind_are_dropped(spark):
    items = [{"id": "v1", "skor": s, "gerekce": "g"} for s in (-1, 101, "80", None, True, 3.5)] + [{"id": "v9", "skor": 1, "gerekce": "g"}, {"id": "v1", "skor": 80, "gerekce": " g "}, {"id": "v1", "skor": 70, "gerekce": "late"}, {"id": "v2", "skor": 5, "gerekce": " "}]
    response = spark.createDataFrame([("i", 0, json.dumps({"skorlar": items})), ("i", 1, "broken")], "inv_id string, batch int, response string")
    labels = spark.createDataFrame([("i", 0, "v1", "a"), ("i", 0, "v2", "b"), ("i", 1, "v1", "c")], "inv_id string, batch int, label string, entity_id string")
    scores, dropped, missing = scoring.checked_scores(response, labels)
    assert [(r.entity_id, r.score, r.reason) for r in scores.collect()] == [("a", 80, "g")]
    assert [r.dropped for r in dropped.collect()] == [9] and sorted((r.batch, r.label) for r in missing.collect()) == [(0, "v2"), (1, "v1")]


def test_severity_and_escape(spark):
    got = [r[0] for r in spark.createDataFrame([(s,) for s in (100, 90, 89, 70, 69, 50, 49, 0, None)], "s int").select(scoring.severity(F.col("s"))).collect()]
    assert got == ["critical", "critical", "high", "high", "medium", "medium", "low", "low", "unscored"]
    texts = spark.createDataFrame([("<b> a|b\n*x*",), (None,)], "t string").select(report.escaped(F.col("t"))).collect()
    assert [r[0] for r in texts] == ["&lt;b&gt; a\\|b \\*x\\*", "—"]


def test_reports_line_by_line_and_as_documents(spark, tmp_path):
    rows = [(inv, section, f"{k:03d}", "", "", f"{inv} line {section} {k}") for inv in ("a", "b") for section in (0, 1) for k in range(40)]
    lines = spark.createDataFrame(rows, "inv_id string, section int, k1 string, k2 string, k3 string, line string").repartition(5)
    report.write_lines(lines, f"{tmp_path}/reports")
    want = {inv: [r[-1] for r in rows if r[0] == inv] for inv in ("a", "b")}
    for inv, text in want.items():
        files = sorted((tmp_path / "reports" / f"inv_id={inv}").glob("part-*"))
        assert [line for f in files for line in f.read_text().splitlines()] == text
    assert {r.inv_id: r.markdown for r in report.documents(lines).collect()} == {inv: "\n".join(text) for inv, text in want.items()}


def test_counters_of_answers(spark):
    items = [{"id": "v1", "skor": 5, "gerekce": "g"}, {"id": "v2", "skor": 7, "gerekce": "g"}, {"id": "v9", "skor": 1, "gerekce": "g"}, 5]
    guesses = [{"baslik": "t", "aciklama": "b", "guven": 1, "ids": ["v1"]}, {"baslik": "t", "aciklama": "b", "guven": 1, "ids": ["v2"]}, {"baslik": "", "aciklama": "b", "guven": 1, "ids": ["v1"]}, {"baslik": "t", "aciklama": "b", "guven": 1, "ids": ["v8"]}]
    response = spark.createDataFrame([("i", 0, json.dumps({"skorlar": items, "hipotezler": guesses})), ("j", 0, "broken")], "inv_id string, batch int, response string")
    labels = spark.createDataFrame([("i", 0, "v1", "a"), ("i", 0, "v2", "b"), ("i", 0, "v3", "c"), ("j", 0, "v1", "d")], "inv_id string, batch int, label string, entity_id string")
    here = spark.createDataFrame([("i", "a"), ("i", "c")], "inv_id string, entity_id string")
    got = {r.inv_id: (r.scores_written, r.hypotheses_written, r.hallucinated, r.missing) for r in scoring.counters(response, labels, here).collect()}
    assert got == {"i": (1, 1, 2 + 2 + 1 + 1, 1), "j": (0, 0, 0, 1)}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rdap_bodies_are_parsed_once_for_each_kind(spark):
    body = '{"objectClassName":"domain","ldhName":"a.example.","events":[{"eventAction":"Expiration","eventDate":"2030-01-01T00:00:00Z"},{"eventAction":"expiration"}],"nameservers":[7,{"ldhName":"ns1.b.example."},{"ldhName":"."}],"entities":[{"roles":["registrant"],"vcardArray":["vcard",[["org",{},"text","Some Org"]]]}]}'
    found = extract.extract_rdap(spark.createDataFrame([("j", body.encode())], "job_id string, content binary"))
    rows = {(r.type, r.raw, r.seq, r.raw_path) for r in found.collect()}
    assert rows == {("org", "Some Org", 0, "$.entities[?(@.roles=='registrant')]"), ("subdomain", "ns1.b.example", 2, "$.nameservers[1].ldhName"), ("domain", "a.example", 9 << 31, "$")}
    domains = found.where("type <> 'netblock'")
    assert '"bitis":"2030-01-01T00:00:00Z"' in domains.where("type = 'domain'").first().data
    made = found._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("Generate inline") >= 3 and made.lower().count("parse_json") + made.lower().count("parsejson") <= 8


def test_answers_meet_labels_without_a_broadcast(spark):
    body = '{"skorlar":[{"id":"v1","skor":5,"gerekce":"g"}],"hipotezler":[{"baslik":"t","aciklama":"b","guven":50,"ids":["v1"]}]}'
    responses = spark.createDataFrame([("i", 0, body)], "inv_id string, batch int, response string")
    labels = spark.createDataFrame([("i", 0, "v1", "e1"), ("i", 0, "v2", "e2")], "inv_id string, batch int, label string, entity_id string")
    counted = scoring.counters(responses, labels, spark.createDataFrame([("i", "e1")], "inv_id string, entity_id string"))
    assert [tuple(r) for r in counted.collect()] == [("i", 1, 1, 0, 1)]
    assert "Broadcast" not in _plan(counted)


def test_listing_slots_and_quota_over_days(spark):
    import random

    rng = random.Random(3)
    times = sorted(rng.choice((T0, T0 + dt.timedelta(days=40))) + dt.timedelta(seconds=rng.randrange(3 * 86400)) for _ in range(300))
    rows = [(i, "shodan-lookup", t, t.timestamp()) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "request_id int, tool string, ts timestamp, t double")
    got = {r.request_id: (r.rn, r.admitted) for r in joblog.quota(df, schema.tool_spec(spark)).collect()}
    month, want = {}, {}
    for i, t in enumerate(times):
        month[t.month] = month.get(t.month, 0) + 1
        want[i] = month[t.month], month[t.month] <= 100
    assert got == want
    slots = {r.request_id: r.slot for r in joblog.slots(df, schema.tool_spec(spark)).collect()}
    last = float("-inf")
    for i, t in enumerate(times):
        last = max(t.timestamp(), last + 1)
        assert abs(slots[i] - last) < 1e-5
    listed = joblog.listing(df.select(F.col("request_id").cast("string").alias("job_id"), F.col("ts").alias("created_at"))).collect()
    assert [r.job_id for r in listed] == [str(i) for i, _ in sorted(enumerate(times), key=lambda x: (x[1], str(x[0])), reverse=True)] and [r.place for r in listed] == list(range(1, 301))


def test_constraint_checks(spark):
    rel = spark.createDataFrame([("r", "i", "a", "a", "runs_on"), ("q", "i", "a", "b", "odd"), ("p", "i", "a", "b", "odd")], "rel_id string, inv_id string, src_id string, dst_id string, type string")
    assert {r.check: r.n for r in schema.violations(rel, "relationship").collect()} == {"self": 1, "type": 2, "key": 1}


def test_library_stands_without_the_optional_part():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "tidemark"
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            assert "llm" not in file.read_text()
