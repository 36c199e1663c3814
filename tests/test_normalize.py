"""Value tables: raw values, and the match key that each must have (None: invalid)."""

import pytest

from tidemark.functions import normalize as n

VALID = [
    ("subdomain", "MAIL.Oakridge.NET.", "mail.oakridge.net"),
    ("subdomain", "ftp://depot.oakridge.net:2121/pub?list#top", "depot.oakridge.net"),
    ("domain", "köprü.web.tr", "xn--kpr-sna6a.web.tr"),
    ("subdomain", "https://ann:secret@Shop.Oakridge.Net:8443", "shop.oakridge.net"),
    ("subdomain", "*.*.*.cdn.oakridge.net", "cdn.oakridge.net"),
    ("subdomain", "_sip._tcp.oakridge.net", "_sip._tcp.oakridge.net"),
    ("subdomain", "IŞIK.oakridge.net", "xn--iik-sza.oakridge.net"),
    ("subdomain", "www.oakridge.net", "www.oakridge.net"),
    ("domain", "fernhill.org.uk", "fernhill.org.uk"),
    ("ip", "2001:0db8:00AA::0B", "2001:db8:aa::b"),
    ("ip", "[2001:db8::7]:853", "2001:db8::7"),
    ("ip", "198.51.100.7:53", "198.51.100.7"),
    ("ip", "\t203.0.113.9\n", "203.0.113.9"),
    ("netblock", "198.51.100.200/25", "198.51.100.128/25"),
    ("netblock", "203.0.113.9", "203.0.113.9/32"),
    ("netblock", "2001:db8:1:2::3/48", "2001:db8:1::/48"),
    ("email", "Jo.Field+news+2@OakRidge.net", "jo.field@oakridge.net"),
    ("email", "MAILTO:Desk@Fernhill.org.uk", "desk@fernhill.org.uk"),
    ("email", "büro@köprü.web.tr", "büro@xn--kpr-sna6a.web.tr"),
    ("cert", "SHA256: 0A:1b:2C:3d:4E", "0a1b2c3d4e"),
    ("asn", "as64500", "64500"),
    ("asn", " +000065551 ", "65551"),
    ("service", "198.51.100.7:53/UDP", "198.51.100.7:53/udp"),
    ("service", "203.0.113.9:8080", "203.0.113.9:8080/tcp"),
    ("service", "[2001:DB8::7]:853/", "[2001:db8::7]:853/tcp"),
    ("org", "Oak  Ridge,  GmbH", "oak ridge"),
    ("org", "Fernhill Co. Inc.", "fernhill"),
    ("org", "Çınar Ltd. Şti.", "çınar"),
    ("org", "Inc. & Sons B.V.", "inc sons"),
    ("tech", "OpenLitespeed", "openlitespeed:openlitespeed:*"),
    ("tech", " Exim : Exim ", "exim:exim:*"),
    ("tech", "Oracle:MySQL:8.0:beta", "oracle:mysql:8.0:beta"),
]
INVALID = [
    ("domain", " "), ("domain", "printserver"), ("domain", "oakridge.nosuchtld"), ("domain", "oak..ridge.net"), ("domain", "*."), ("domain", "oak ridge.net"), ("domain", "ftp://?x"),
    ("domain", "org.uk"), ("subdomain", "x" * 70 + ".oakridge.net"), ("subdomain", "-a.oakridge.net"), ("subdomain", "[2001:db8::7"), ("ip", "198.51.100.256"), ("ip", "oakridge.net"), ("ip", "01.2.3.4"), ("ip", "198.51.100.0/28"),
    ("netblock", "198.51.100.0/99"), ("netblock", "oak"), ("email", "oakridge.net"), ("email", "@oakridge.net"), ("email", "jo@"), ("email", "+news@oakridge.net"), ("email", "jo field@oakridge.net"),
    ("email", "jo@printserver"), ("asn", "ASN"), ("asn", "-1"), ("asn", "AS 4294967297"), ("asn", "6.5"), ("service", "198.51.100.7/udp"), ("service", "2001:db8::7:853"),
    ("service", "[2001:db8::7]"), ("service", "[oakridge.net]:25"), ("service", "198.51.100.7:0/tcp"), ("service", "oakridge.net:25/tcp"), ("service", "198.51.100.7:dns/udp"),
    ("cert", "0a1b2c3"), ("cert", "0g" * 10), ("cert", "0" * 65), ("org", "  "), ("org", "Ltd. Şti."), ("org", "?!"), ("tech", " "), ("tech", "::1"), ("tech", "exim::4"),
]


@pytest.fixture(scope="module")
def keys(spark):
    rows = [(t, r) for t, r, _ in VALID] + INVALID + [("domain", None)]
    return {(r.type, r.raw): r for r in n.normalize_values(spark.createDataFrame(rows, "type string, raw string")).collect()}


@pytest.mark.parametrize("kind,raw,expected", VALID)
def test_valid(keys, kind, raw, expected):
    assert keys[kind, raw].norm == expected and keys[kind, raw].error is None


@pytest.mark.parametrize("kind,raw", [*INVALID, ("domain", None)])
def test_invalid(keys, kind, raw):
    assert keys[kind, raw].norm is None and keys[kind, raw].error


def test_keys_are_their_own_keys(spark):
    rows = sorted({(t, e) for t, _, e in VALID})
    assert all(r.canonical for r in n.is_canonical(spark.createDataFrame(rows, "type string, raw string")).collect())


def test_registrable_roots_and_types(spark):
    rows = [
        ("fernhill.org.uk", "fernhill.org.uk", "domain"), ("news.fernhill.org.uk", "fernhill.org.uk", "subdomain"), ("a.b.oakridge.net", "oakridge.net", "subdomain"),
        ("one.two.kawasaki.jp", "one.two.kawasaki.jp", "domain"), ("zero.one.two.kawasaki.jp", "one.two.kawasaki.jp", "subdomain"), ("city.kawasaki.jp", "city.kawasaki.jp", "domain"), ("lake.city.kawasaki.jp", "city.kawasaki.jp", "subdomain"),
    ]
    df = n.normalize_values(spark.createDataFrame([("subdomain", r, 1) for r, _, _ in rows], "type string, raw string, norm_ int"))
    got = {r.raw: (r.root, r.t) for r in df.select("raw", "root", n.correct_type(df.type, df.norm, df.root).alias("t")).collect()}
    assert got == {r: (root, t) for r, root, t in rows} and df.columns == ["type", "raw", "norm_", "norm", "root", "error"]


def test_suffix_rules_come_with_the_package(tmp_path):
    """Where Python takes Spark from a zip file there are no jars beside it."""
    import subprocess
    import sys
    import zipfile
    from pathlib import Path

    import pyspark

    with zipfile.ZipFile(tmp_path / "pyspark.zip", "w") as z:
        for file in Path(pyspark.__file__).parent.rglob("*"):
            if file.suffix in (".py", ".json"):
                z.write(file, Path("pyspark") / file.relative_to(Path(pyspark.__file__).parent))
    code = "import pyspark, tidemark.functions.suffix as s; assert '.zip' in pyspark.__file__; print(len(s._rules()))"
    root = str(Path(__file__).parent.parent)
    out = subprocess.run([sys.executable, "-c", code], env={"PYTHONPATH": f"{tmp_path / 'pyspark.zip'}:{root}", "PATH": "/usr/bin:/bin"}, cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 5000, out.stderr


def test_root_targets(spark):
    rows = [("oakridge.net", "oakridge.net", "domain"), ("Shop.Oakridge.NET:443", "oakridge.net", "domain"), ("https://a.b.fernhill.org.uk/x", "fernhill.org.uk", "domain"), ("198.51.100.7", "198.51.100.7", "ip"), ("[2001:0db8::7]:1", "2001:db8::7", "ip"), ("printserver", None, None), (None, None, None)]
    got = {r.raw: (r.root_value, r.root_type) for r in n.resolve_roots(spark.createDataFrame([(r,) for r, _, _ in rows], "raw string")).collect()}
    assert got == {r: (v, t) for r, v, t in rows}


def test_services_split(spark):
    df = spark.createDataFrame([("198.51.100.7:53/udp",), ("[2001:db8::7]:853/tcp",), ("198.51.100.7",)], "norm string").select(n.split_service(n.F.col("norm")).alias("s"))
    assert [tuple(r.s) if r.s else None for r in df.collect()] == [("198.51.100.7", 53, "udp"), ("2001:db8::7", 853, "tcp"), None]


def test_address_classes_at_all_ends(spark):
    """Against the standard library: the ends of each range, their neighbours, and random addresses."""
    import ipaddress
    import random

    rng, ips = random.Random(7), set()
    for _, blocks in n.SPECIAL_RANGES:
        for block in map(ipaddress.ip_network, blocks):
            low, high, bits = int(block[0]), int(block[-1]), block.max_prefixlen
            for x in (low - 1, low, low + 1, high - 1, high, high + 1, rng.randint(low, high), rng.getrandbits(bits)):
                if 0 <= x < 1 << bits:
                    ips.add(type(block[0])(x))

    def known(a):
        return next((name for name in ("loopback", "link_local", "multicast", "reserved", "private") if getattr(a, f"is_{name}")), None)

    got = n.with_address_class(spark.createDataFrame([(str(a),) for a in ips] + [(None,), ("oakridge.net",)], "norm string")).collect()
    assert {r.norm: r.address_class for r in got} == {str(a): known(a) for a in ips} | {None: None, "oakridge.net": None}
