"""Places over ranges, splits of large bodies, and the store of runs, against plain versions; hot keys over several tasks."""

import datetime as dt
import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark import ranges, schema
from tidemark.operators import chain, graph, jobs as joblog, report, triage
from tidemark.sources import archive, extract, splits
from tidemark.streaming.incremental import Conflict, Store, merge_batch, merge_parsed

T0 = dt.datetime(2024, 1, 1)
JOB = "job_id string, inv_id string, tool string, tool_version string, target_value string, status string, depth smallint, created_at timestamp, ended_at timestamp"


def job(spark, *rows):
    return spark.createDataFrame([(i, "inv", tool, "1.0", "example.com", "done", depth, T0 + dt.timedelta(hours=n), None) for n, (i, tool, depth) in enumerate(rows)], JOB)


@pytest.fixture(scope="module")
def hot(spark):
    """A group of most rows, one of null, and small ones; with repeated order keys."""
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + [None, "a", "b", "c"]), rng.choice([None, *range(20)]), k) for k in range(4000)]
    return rows, spark.createDataFrame(rows, "g string, x int, id int").repartition(5)


def ordered(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_places_are_carried_over_ranges(hot, parts):
    rows, df = hot
    dealt = ranges.spread(df, ["g"], ["x", "id"], parts)
    want = {r[2]: n for v in ordered(rows).values() for n, r in enumerate(v, 1)}
    assert {r.id: r.position for r in dealt.numbered().collect()} == want
    most = dealt.rows.where("g = 'hot'").groupBy(ranges.PART).count().agg(F.max("count")).first()[0]
    assert parts == 1 or most < 4000 / parts * 3  # the hot group is cut like any other rows
    assert dealt.numbered().columns == ["g", "x", "id", "position"]


def test_only_some_places_are_read(hot):
    rows, df = hot
    dealt = ranges.spread(df, ["g"], ["x", "id"], 16)
    wanted = dealt.totals().select("g", F.lit(101).alias("first"), F.lit(140).alias("last"))
    got = dealt.between(wanted)
    want = sorted((r[2], n) for v in ordered(rows).values() for n, r in enumerate(v, 1) if 101 <= n <= 140)
    assert sorted((r.id, r.position) for r in got.collect()) == want
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted") if hasattr(got, "_sc") else got._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and ranges.PART in plan
    nobody = dealt.where(F.col("g") == "nobody")
    assert nobody.numbered().count() == 0 and nobody.between(wanted).count() == 0


def test_one_root_of_a_million_edges(spark):
    n = 1_000_000
    ids = spark.range(n, numPartitions=8)
    edges = ids.select(F.col("id").cast("string").alias("rel_id"), F.lit("i").alias("inv_id"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("src_id"), F.lit("root").alias("dst_id"), F.lit("subdomain_of").alias("type"))
    hosts = ids.select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity_id"), F.lit("i").alias("inv_id"), F.lit("subdomain").alias("type"), F.lpad(F.col("id").cast("string"), 9, "0").alias("norm"))
    entities = hosts.unionByName(spark.createDataFrame([("root", "i", "domain", "r"), ("other", "j", "domain", "o")], hosts.schema))
    placed = graph.neighbours(edges, entities).where("entity_id = 'root'")
    wrong = placed.where(F.col("position") != F.col("src_norm").cast("int") + 1).count()
    assert wrong == 0 and placed.count() == n
    chain_ = graph.evidence_chain(ids.select(F.col("id").alias("obs_id"), F.lit("root").alias("entity_id"), F.timestamp_seconds(F.col("id") % 1000).alias("observed_at")))
    first = {r.obs_id: r.position for r in chain_.where("position <= 3").collect()}
    assert first == {999: 1, 1999: 2, 2999: 3} and chain_.agg(F.max("position")).first()[0] == n


def test_one_busy_day(spark):
    rng = random.Random(6)
    times = [rng.random() * 3600 for _ in range(1200)]
    rows = [(k, "crtsh", t, T0 + dt.timedelta(seconds=t), f"j{k:04d}", T0 + dt.timedelta(seconds=int(t))) for k, t in enumerate(times)]
    df = spark.createDataFrame(rows, "request_id int, tool string, t double, ts timestamp, job_id string, created_at timestamp").repartition(3)
    tools = schema.tool_spec(spark)
    free, want = -1e18, {}
    for k, t in sorted(enumerate(times), key=lambda x: (round(x[1] * 1e6), x[0])):
        free = max(round(t * 1e6), free + 12e6)
        want[k] = free / 1e6
    assert {r.request_id: r.slot for r in joblog.slots(df, tools).collect()} == want
    ranked = {k: n for n, (k, _) in enumerate(sorted(enumerate(times), key=lambda x: (rows[x[0]][3], x[0])), 1)}
    limited = tools.withColumn("monthly_quota", F.lit(1000))
    assert {r.request_id: (r.rn, r.admitted) for r in joblog.quota(df, limited).collect()} == {k: (n, n <= 1000) for k, n in ranked.items()}
    listed = [r.job_id for r in joblog.listing(df).collect()]
    assert listed == [r[4] for r in sorted(rows, key=lambda r: (r[5], r[4]), reverse=True)]


def test_pages_of_one_investigation(spark):
    rows = [("i", f"e{k:03d}", ("priority", "review", "context")[k % 3], k % 5, "ip", f"n{k % 50}") for k in range(340)] + [("j", "x", "review", 0, "ip", "n")]
    listed = triage.laid_out(spark.createDataFrame(rows, "inv_id string, entity_id string, triage string, n_tools int, type string, norm string").repartition(4))
    place = {}
    for inv in "ij":
        some = sorted((r for r in rows if r[0] == inv), key=lambda r: (triage.GROUPS.index(r[2]), -r[3], r[4], r[5], r[1]))
        place |= {r[1]: n for n, r in enumerate(some, 1)}
    for number, group, size in ((1, None, 100), (2, None, 100), (99, None, 100), (0, None, 7), (2, "review", 60), (5, "context", 50)):
        want = set()
        for inv in "ij":
            some = sorted((place[r[1]], r[1]) for r in rows if r[0] == inv and group in (None, r[2]))
            page = min(max(1, number), max(1, -(-len(some) // size)))
            want |= {(e, p, page) for p, e in some[(page - 1) * size : page * size]}
        assert {(r.entity_id, r.position, r.page) for r in triage.page(listed, number, group, size).collect()} == want


def test_documents_over_several_tasks(spark, tmp_path):
    rows = [("a b/%", s, f"{k:04d}", "", "", f"line {s} {k}") for s in range(3) for k in range(300)] + [("c", 0, "0", "", "", "alone")]
    lines = spark.createDataFrame(rows, "inv_id string, section int, k1 string, k2 string, k3 string, line string").repartition(3)
    got = {(r.inv_id, r.place): r.line for r in report.document_lines(lines).collect()}
    assert got == {("a b/%", n): r[5] for n, r in enumerate(sorted(rows[:-1]), 1)} | {("c", 1): "alone"}
    parts = sorted(report.write_documents(lines, f"{tmp_path}/r").collect())
    assert len([p for p in parts if p.inv_id == "a b/%"]) > 1
    for inv in ("a b/%", "c"):
        own, whole = [p for p in parts if p.inv_id == inv], []
        for p in own:
            assert p.first_place == len(whole) + 1
            whole += spark.read.text(p.file).toPandas()["value"].tolist()
        assert whole == [got[inv, n] for n in range(1, len(whole) + 1)] and len(whole) == sum(i == inv for i, _ in got)


# -- splits


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def put(folder, job_id, text, kind="json"):
    path = folder / job_id
    path.mkdir(parents=True)
    (path / f"output.{kind}").write_bytes(text.encode() if isinstance(text, str) else text)


def rows_of(df):
    return sorted((r.job_id, r.seq, r.type, r.raw, r.data, r.raw_path, str(r.relations)) for r in df.collect())


def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    for j in range(4):
        lines = [rng.choice(["", "not json", "{}", json.dumps({"host": f"h{k}.example.com", "input": "example.com", "source": "é" * rng.randrange(30)})]) for k in range(60 * j)]
        put(tmp_path, f"j {j}+x%", rng.choice(["\n", "\r\n"]).join(lines) + "\n" * (j % 2), "jsonl")
    put(tmp_path, "bad", b"\xff\xfe\n{\"host\":\"a.example.com\"}\r\n", "jsonl")
    whole = extract.extract_subdomain_list(archive.read_archive(spark, str(tmp_path)).select("job_id", "content"))
    cut = extract.subdomain_lines(splits.read_lines(spark, str(tmp_path)))
    assert rows_of(cut) == rows_of(whole) and cut.count() > 50
    assert splits.fragments(spark, str(tmp_path), "\n").select("file", "start").distinct().count() > 20


def test_records_are_found_over_splits(spark, tmp_path, small_splits):
    rng = random.Random(2)
    texts = ["}", "{", "[", "]", '"', "\\", 'a "}],[{" \\" b', "plain", ",", "é{"]
    for j in range(6):
        items = []
        for k in range(1 + 12 * j):
            record = {"name_value": f"{'*.' * (k % 2)}h{k}.example.com", "serial_number": f"{k:04x}", "issuer_name": "".join(rng.choice(texts) for _ in range(rng.randrange(6))), "id": k, "x": {"y": [{"z": rng.choice(texts)}, {}]}}
            items.append(rng.choice([record, record, record, 17, "}", [record, {}], None, {}, "two \" {"]))
        put(tmp_path, f"j{j}", json.dumps(items, indent=rng.choice([None, 1]), ensure_ascii=j % 2 == 0))
    for j, bad in enumerate(["", "[]", "[1, 2]", "[{}", '[{"a":1} {"b":2}]', '{"a":[{}]}', '[{"serial_number":"00"}, nope]', "[{},]", '[{"serial_number":"01"},]', ' [ {"serial_number":"02"} ] ', '"}"', "[,{}]", '[{"serial_number":"03"},{"serial_number":"04"}'], 10):
        put(tmp_path, f"j{j}", bad)
    whole = extract.extract_ct_log(archive.read_archive(spark, str(tmp_path)).select("job_id", "content"))
    cut = extract.ct_records(splits.read_records(spark, str(tmp_path)))
    assert rows_of(cut) == rows_of(whole) and cut.count() > 60
    put(tmp_path / "more", "j", '[{"serial_number":"05"}]]')
    assert splits.read_records(spark, str(tmp_path / "more")).count() == 0


def test_archives_with_large_bodies(spark, tmp_path, small_splits):
    put(tmp_path, "s1", "\n".join(json.dumps({"host": f"h{k}.example.com", "input": "example.com"}) for k in range(40)), "jsonl")
    put(tmp_path, "c1", json.dumps([{"name_value": f"h{k}.example.com", "serial_number": f"{k:04x}"} for k in range(40)]))
    put(tmp_path, "c2", json.dumps([{"name_value": "small.example.com"}]))
    jobs = job(spark, ("s1", "subfinder", 0), ("c1", "crtsh", 0), ("c2", "crtsh", 0))
    both = [rows_of(extract.extract_archive(spark, str(tmp_path), jobs, large)) for large in (500, 1 << 40)]
    assert both[0] == both[1] and len(both[0]) == 40 + 80 + 1


# -- the store


def parsed(spark, *rows):
    """(job, seq, host) observations, each related to example.com."""
    relation = [("subdomain_of", "domain", "example.com", "out")]
    return spark.createDataFrame([(j, s, "subdomain", h, "{}", None, f"$[{s}]", relation) for j, s, h in rows], schema.TABLES["parsed_observation"])


def plain(store):
    return sorted((r.norm, r.raw, r.obs_count) for r in store.read("entity").collect())


def test_store_of_many_batches(spark, tmp_path):
    jobs = job(spark, *[(f"j{i}", "subfinder", 0) for i in range(4)])
    store = Store(spark, f"{tmp_path}/s", fan=2, checkpoint=4)
    for i in range(4):
        merge_parsed(store, parsed(spark, (f"j{i}", 0, "A.example.com" if i == 0 else "a.example.com"), (f"j{i}", 1, f"h{i}.example.com")), jobs)
        if i == 1:
            store.compact()
    want = sorted([("a.example.com", "A.example.com", 4), ("example.com", "example.com", 0), *[(f"h{i}.example.com", f"h{i}.example.com", 1) for i in range(4)]])
    assert plain(store) == want
    before = store.state()
    store.compact()
    after = store.state()
    assert plain(store) == want and len(after.runs) < len(before.runs) and plain_at(store, before) == want
    assert store.read("observation").count() == 8 and store.read("relationship").count() == 5
    assert Store(spark, f"{tmp_path}/s").state() == after  # read again from the last checkpoint on
    assert merge_parsed(store, parsed(spark, ("j3", 0, "a.example.com")), jobs).version == after.version  # a replay is no version
    assert store.vacuum(3600) == 0 and plain_at(store, before) == want
    assert store.vacuum(-1) > 0 and plain(store) == want and store.state() == after


def plain_at(store, state):
    return sorted((r.norm, r.raw, r.obs_count) for r in store.read("entity", state).collect())


def test_a_batch_costs_by_its_own_size(spark, tmp_path):
    jobs = job(spark, *[(f"j{i}", "subfinder", 0) for i in range(40)])
    sizes = []
    for n in (1, 10):
        store = Store(spark, f"{tmp_path}/s{n}", bucket_rows=16)
        merge_parsed(store, parsed(spark, *[(f"j{j}", k, f"h0x{j}x{k}.example.com") for j in range(30) for k in range(4 * n)]), jobs)
        known = {r.path for r in store.state().runs}
        state = merge_parsed(store, parsed(spark, ("j35", 0, "new.example.com"), ("j35", 1, "h0x0x0.example.com")), jobs)
        sizes.append([(r.table, r.rows, r.bits) for r in state.runs if r.path not in known])
        first = state.of("observation")[0]
        assert first.bits >= 3 and store.seen([first], spark.createDataFrame([("j35",)], "job_id string")).count() < first.rows / 2
    assert sizes[0] == sizes[1] == [("observation", 2, 0), ("entity", 3, 0), ("relationship", 2, 0)]


def test_lost_races(spark, tmp_path):
    jobs = job(spark, *[(f"w{i}", "subfinder", 0) for i in range(4)])
    store = Store(spark, f"{tmp_path}/s", fan=2)
    line = json.dumps({"host": "a.example.com", "input": "example.com", "source": "x"}).encode()
    batches = [f"w{i % 2}" for i in range(4)]  # each comes twice, at once
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda j: merge_batch(store, spark.createDataFrame([(j, line)], "job_id string, content binary"), jobs), batches))
    assert plain(store) == [("a.example.com", "a.example.com", 2), ("example.com", "example.com", 0)]
    assert store.read("observation").count() == 2 and store.read("relationship").count() == 1
    store.vacuum(-1)
    there = {n for n, _ in store._listed("data")}
    assert there == {r.path.rpartition("/")[2] for r in store.state().runs}
    state = store.state()
    runs = store.write("entity", store.read("entity"), 99)
    store.commit(state, runs)
    with pytest.raises(Conflict):
        store.commit(state, runs)


# -- chaining over depths


def test_rounds_over_depths(spark):
    start = spark.createDataFrame([("r", "inv", "crtsh", "example.com", None, 0, T0)], "job_id string, inv_id string, tool string, target_value string, parent_job_id string, depth smallint, created_at timestamp")
    outputs = spark.createDataFrame(
        [("inv", "crtsh", "example.com", "subdomain", "a.example.com"), ("inv", "dns-resolver", "a.example.com", "ip", "192.0.2.1"), ("inv", "dns-resolver", "a.example.com", "subdomain", "a.example.com"), ("inv", "asn-bgp", "192.0.2.1", "asn", "7"), ("inv", "asn-bgp", "7", "asn", "8"), ("other", "crtsh", "example.com", "subdomain", "no.example.com")],
        "inv_id string, tool string, target_value string, type string, norm string",
    )
    inv = spark.createDataFrame([("inv", [])], "inv_id string, selected_tools array<string>")
    got = sorted((r.depth, r.tool, r.target_value) for r in chain.rounds(start, outputs, inv, schema.tool_spec(spark)).collect())
    assert got == [(0, "crtsh", "example.com"), (1, "dns-resolver", "a.example.com"), (2, "asn-bgp", "192.0.2.1"), (2, "shodan-lookup", "192.0.2.1"), (2, "whois-rdap", "192.0.2.1"), (3, "asn-bgp", "7")]
    assert chain.rounds(start.limit(0), outputs, inv, schema.tool_spec(spark)).count() == 0
