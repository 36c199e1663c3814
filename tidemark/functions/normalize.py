"""Match keys of raw values, row by row: no row moves.

`normalize_values` adds `norm` (null if invalid) and `error`. ASCII values stay in built-in functions. Only rows that
hold other characters, or IPv6 text, go through Arrow-batched functions for composition, IDNA labels and address
text. IPv6 text is printed as Python 3.13's ipaddress does. Integers are ASCII digits
with an optional sign."""

from __future__ import annotations

import ipaddress
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .suffix import with_root

#: The legal forms that end an organization's name, in the order in which they are tried.
LEGAL_FORMS = ["ltd. şti.", "ltd. sti.", "a.ş.", "a.s.", "inc.", "llc", "gmbh", "b.v.", "co."]
HOST_TYPES = ["domain", "subdomain"]
_BLANKS = r"(?U)^\s+|\s+$"
_ASCII = r"^\p{ASCII}*$"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: as a lambda's variable it is not copied into each place of use,
    which would grow the plan with every step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(c, _BLANKS, "")


def fold(c: Column) -> Column:
    """N0, for composed text: both Turkish capital I's to i, then lower case."""
    return F.lower(F.translate(c, "İI", "ii"))


@F.pandas_udf(StringType())
def composed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(StringType())
def ascii_labels(hosts: pd.Series) -> pd.Series:
    """Each label that is not ASCII by IDNA 2003; a label without such a form makes the host null."""

    def one(host):
        try:
            return None if host is None else ".".join(p if p.isascii() else p.encode("idna").decode("ascii") for p in host.split("."))
        except UnicodeError:
            return None

    return hosts.map(one)


@F.pandas_udf(StringType())
def ipv6_text(values: pd.Series) -> pd.Series:
    """Shortest lower-case text of an IPv6 address or network (host bits cleared); null for anything else."""

    def one(v):
        try:
            if v is None or ":" not in v:
                return None
            return str(ipaddress.ip_network(v, strict=False) if "/" in v else ipaddress.IPv6Address(v))
        except ValueError:
            return None

    return values.map(one)


# -- pieces of values --------------------------------------------------------------------------------------------


def without_port(c: Column) -> Column:
    """host of host:port and [v6]:port; null for an open or misused bracket. Bare IPv6 text stays."""
    bracket = r"(?s)^\[([^\]]*)\](?::.*)?$"
    return let(c, lambda x: F.when(x.startswith("["), F.when(x.rlike(bracket), F.regexp_extract(x, bracket, 1))).when(x.rlike(r"(?s)^[^:]*:[^:]*$"), F.substring_index(x, ":", 1)).otherwise(x))


def host_part(raw: Column) -> Column:
    """N1 up to letter case: scheme, path, user, port, root dot and wildcards are dropped; `www` never is."""
    s = F.regexp_replace(strip(raw), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", "")
    s = F.regexp_extract(s, r"(?s)^([^/?#]*)", 1)
    s = F.substring_index(s, "@", -1)
    s = F.regexp_replace(without_port(s), r"\.+$", "")
    return F.regexp_replace(s, r"^(?:\*\.)+", "")


def host_shape(host: Column) -> Column:
    """Whether an ASCII host has a valid form; its public suffix is another matter."""
    # fixed value: the shape of a label
    fine = lambda p: p.rlike(r"^[a-z0-9_]([a-z0-9_\-]*[a-z0-9_])?$") & (F.length(p) <= 63)
    return let(host, lambda h: (F.length(h) <= 253) & h.contains(".") & F.forall(F.split(h, r"\."), fine))


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def ipv4_number(c: Column) -> Column:
    """The address as a BIGINT; null for anything else."""
    number = lambda x: F.aggregate(F.split(x, r"\."), F.lit(0).cast("bigint"), lambda a, p: a * 256 + p.cast("bigint"))
    return let(c, lambda x: F.when(x.rlike(IPV4), number(x)))


def ipv4_text(n: Column) -> Column:
    byte = lambda x, shift: F.shiftright(x, shift).bitwiseAND(F.lit(255)).cast("string")
    return let(n, lambda x: F.concat_ws(".", byte(x, 24), byte(x, 16), byte(x, 8), byte(x, 0)))


def netblock4(c: Column) -> Column:
    """N4 for IPv4: a.b.c.d/length with host bits cleared; without a length /32."""
    size = lambda x: F.when(x.contains("/"), F.nullif(F.regexp_extract(x, r"^[^/]*/(\d{1,2})$", 1), F.lit(""))).otherwise("32").cast("int")
    parts = let(c, lambda x: F.struct(ipv4_number(F.substring_index(x, "/", 1)).alias("n"), size(x).alias("size")))

    def cleared(p: Column) -> Column:
        shift = (F.lit(32) - p["size"]).cast("int")
        return ipv4_text(F.call_function("shiftleft", F.call_function("shiftright", p["n"], shift), shift))

    return let(parts, lambda p: F.when(p["n"].isNotNull() & (p["size"] <= 32), F.concat(cleared(p), F.lit("/"), p["size"].cast("string"))))


def cert_key(raw: Column) -> Column:
    """8 to 64 hex digits without blanks, colons and a sha256 prefix."""
    s = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(raw, r"(?U)\s+", ""), ":", "")), "^sha256", "")
    return let(s, lambda x: F.when(x.rlike("^[0-9a-f]{8,64}$"), x))


def asn_key(raw: Column) -> Column:
    """The number of an autonomous system, of 32 bits."""
    s = strip(F.regexp_replace(F.upper(strip(raw)), "^AS", ""))
    n = let(s, lambda x: F.when(x.rlike(r"^[+]?\d{1,18}$"), F.regexp_replace(x, r"^\+", "").cast("bigint")))
    return let(n, lambda x: F.when((x >= 0) & (x <= 4294967295), x.cast("string")))


def service_parts(raw: Column) -> Column:
    """struct(ip text, port or null, proto) of ip:port/proto and [v6]:port/proto; null ip if ambiguous."""
    v6, plain = r"(?s)^\[([^\]]*)\]:(.*)$", r"(?s)^([^:\[][^:]*):([^:]*)$"

    def cut(s: Column) -> Column:
        proto = F.when(s.contains("/"), fold(strip(F.substring_index(s, "/", -1)))).otherwise("")
        address = strip(F.when(s.contains("/"), F.regexp_extract(s, r"(?s)^(.*)/[^/]*$", 1)).otherwise(s))
        return F.struct(address.alias("address"), F.coalesce(F.nullif(proto, F.lit("")), F.lit("tcp")).alias("proto"))

    def parts(p: Column) -> Column:
        either = lambda i: F.when(p["address"].rlike(v6), F.regexp_extract(p["address"], v6, i)).when(p["address"].rlike(plain), F.regexp_extract(p["address"], plain, i))
        port = let(strip(either(2)), lambda t: F.when(t.rlike(r"^[+]?\d{1,9}$"), F.regexp_replace(t, r"^\+", "").cast("int")))
        return F.struct(F.nullif(strip(either(1)), F.lit("")).alias("ip"), let(port, lambda n: F.when((n >= 1) & (n <= 65535), n)).alias("port"), p["proto"].alias("proto"))

    return let(let(strip(raw), cut), parts)


def org_key(folded: Column) -> Column:
    """Blanks squeezed, legal forms taken off the end as long as one is there, punctuation to blanks."""
    s = strip(F.regexp_replace(folded, r"(?U)\s+", " "))
    forms = "|".join(f.replace(".", r"\.") for f in LEGAL_FORMS)
    s = F.regexp_replace(s, rf"(?:(?:^| )(?:{forms}))+$", "")
    s = strip(F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    return F.nullif(s, F.lit(""))


def tech_key(folded: Column) -> Column:
    """Vendor:product:version, one part doubled, a missing version is *."""
    def made(p: Column) -> Column:
        product = F.when(F.size(p) == 1, p[0]).otherwise(F.get(p, F.lit(1)))
        version = F.when(F.size(p) > 2, F.array_join(F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0))), ":"))
        return F.struct(p[0].alias("vendor"), product.alias("product"), F.coalesce(F.nullif(version, F.lit("")), F.lit("*")).alias("version"))

    parts = let(F.transform(F.split(strip(folded), ":"), strip), made)
    return let(parts, lambda p: F.when((p["vendor"] != "") & (p["product"] != ""), F.concat_ws(":", p["vendor"], p["product"], p["version"])))


@lru_cache(maxsize=32)
def _steps(type_col: str, raw_col: str, hard: bool, gateway: int) -> tuple[tuple[Column, ...], ...]:
    """The columns that lead to norm, before the suffix check, and to _host of hosts and e-mail domains; each step uses
    those before it. `hard` rows may use the Arrow functions. Columns are names and functions only, so they serve any
    table; as there are some hundreds of them, they are made once for a connection to the JVM."""
    kind, raw, none = F.col(type_col), F.col(raw_col), F.lit(None).cast("string")
    # hosts, also those of e-mail addresses
    mail = F.when(kind == "email", F.regexp_replace(strip(raw), r"^(?i:mailto:)", ""))
    source = F.when(kind.isin(HOST_TYPES), raw).otherwise(F.substring_index(mail, "@", -1))
    host = fold(composed(host_part(source)) if hard else host_part(source))
    local = F.regexp_extract(mail, r"(?s)^(.*)@[^@]*$", 1)
    local = F.regexp_extract(fold(composed(local) if hard else local), r"(?s)^([^+]*)", 1)
    local = let(local, lambda x: F.when((x != "") & ~x.rlike(r"(?U)\s"), x))
    service = F.when(kind == "service", service_parts(raw))
    first = (fold(composed(raw) if hard else raw).alias("_folded"), (ascii_labels(host) if hard else host).alias("_any"), local.alias("_local"), service.alias("_s"))
    ip = F.when(kind == "ip", without_port(strip(raw))).when(kind == "service", F.col("_s.ip")).when(kind == "netblock", strip(raw))
    address = F.when(F.col("_ip").rlike(IPV4), F.col("_ip")).when(~F.col("_ip").contains("/"), F.col("_ip6"))
    block = F.coalesce(netblock4(F.col("_ip")), F.when(F.col("_ip6").contains("/"), F.col("_ip6")).otherwise(F.concat("_ip6", F.lit("/128"))))
    shown = F.when(F.col("_address").contains(":"), F.concat(F.lit("["), "_address", F.lit("]"))).otherwise(F.col("_address"))
    port, proto = F.col("_s.port"), F.col("_s.proto")
    key = (
        F.when(kind.isin(HOST_TYPES), F.col("_good"))
        .when(kind == "email", F.when(F.col("_good").isNotNull() & F.col("_local").isNotNull(), F.concat_ws("@", "_local", "_good")))
        .when(kind == "ip", F.col("_address"))
        .when(kind == "netblock", block)
        .when(kind == "cert", cert_key(raw))
        .when(kind == "asn", asn_key(raw))
        .when(kind == "service", F.when(port.isNotNull() & F.col("_address").isNotNull(), F.concat(shown, F.lit(":"), port.cast("string"), F.lit("/"), proto)))
        .when(kind == "org", org_key(F.col("_folded")))
        .when(kind == "tech", tech_key(F.col("_folded")))
    )
    named = F.when(kind.isin(*HOST_TYPES, "email") & F.col("norm").isNotNull(), F.col("_good"))
    return (
        first, (ip.alias("_ip"),), ((ipv6_text("_ip") if hard else none).alias("_ip6"),), (address.alias("_address"), F.when(host_shape(F.col("_any")), F.col("_any")).alias("_good")),
        (F.when(raw.isNotNull(), key).alias("norm"),), (named.alias("_host"),),
    )


def _keys(df: DataFrame, type_col: str, raw_col: str, hard: bool) -> DataFrame:
    """Adds norm and _host."""
    columns = df.columns
    for step in _steps(type_col, raw_col, hard, id(df.sparkSession._jvm)):
        df = df.select("*", *step)
    return df.select(*columns, "norm", "_host")


def normalize_values(df: DataFrame, type_col: str = "type", raw_col: str = "raw") -> DataFrame:
    """Adds norm, error and root (the registrable root of hosts and e-mail domains)."""
    kind, raw = F.col(type_col), F.col(raw_col)
    plain = raw.rlike(_ASCII) & ~(kind.isin("ip", "netblock", "service") & raw.contains(":") & raw.rlike(r":.*:|\["))
    plain = F.coalesce(plain, F.lit(True))
    keys = _keys(df.where(plain), type_col, raw_col, False).unionByName(_keys(df.where(~plain), type_col, raw_col, True))
    rooted = with_root(keys, "_host")
    bare = F.col("_host").isNotNull() & F.col("root").isNull()
    error = F.when(raw.isNull() | kind.isNull(), "no value").when(bare, F.concat(F.lit("no public suffix: "), raw)).when(F.col("norm").isNull(), F.concat(F.lit("invalid "), kind, F.lit(": "), raw))
    done = rooted.withColumn("error", error).withColumn("norm", F.when(~bare, F.col("norm")))
    return done.select(*df.columns, "norm", "root", "error")


def correct_type(type_: Column, norm: Column, root: Column) -> Column:
    """A host is a domain if it is its own registrable root, else a subdomain; other types stay."""
    return F.when(type_.isin(HOST_TYPES), F.when(norm == root, "domain").otherwise("subdomain")).otherwise(type_)


def is_canonical(df: DataFrame, type_col: str = "type", raw_col: str = "raw") -> DataFrame:
    """Adds `canonical`, whether the value is its own match key."""
    return normalize_values(df, type_col, raw_col).withColumn("canonical", F.coalesce(F.col("norm") == F.col(raw_col), F.lit(False)))


def split_service(norm: Column) -> Column:
    """struct(ip, port, proto) of a canonical service key; null for anything else."""
    shape = r"^(?:\[([^\]]+)\]|([^:\[\]]+)):(\d+)/(\S+)$"
    ip = F.coalesce(F.nullif(F.regexp_extract(norm, shape, 1), F.lit("")), F.regexp_extract(norm, shape, 2))
    return F.when(norm.rlike(shape), F.struct(ip.alias("ip"), F.regexp_extract(norm, shape, 3).cast("int").alias("port"), F.regexp_extract(norm, shape, 4).alias("proto")))


def resolve_roots(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds root_value and root_type: an IP address, else the registrable root of a host, else nulls."""
    ip = normalize_values(df.withColumn("_type", F.lit("ip")), "_type", raw_col).select(*df.columns, F.col("norm").alias("_root_ip"))
    both = normalize_values(ip.withColumn("_type", F.lit("domain")), "_type", raw_col).withColumn("_root", F.when(F.col("norm").isNotNull(), F.col("root")))
    kind = F.when(F.col("_root_ip").isNotNull(), "ip").when(F.col("_root").isNotNull(), "domain")
    return both.select(*df.columns, F.coalesce("_root_ip", "_root").alias("root_value"), kind.alias("root_type"))


#: Special address ranges by class, and those that an earlier line takes out of a later one (class None),
#: in the order in which they count; the first that holds an address wins.
SPECIAL_RANGES = [
    ("loopback", ["127.0.0.0/8", "::1/128", "::ffff:127.0.0.0/104"]),
    ("link_local", ["169.254.0.0/16", "fe80::/10"]),
    ("multicast", ["224.0.0.0/4", "ff00::/8"]),
    ("reserved", ["240.0.0.0/4", "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9"]),
    (None, ["192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]),
    ("private", ["0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7"]),
]


def ipv6_hex(c: Column) -> Column:
    """32 hex digits of an IPv6 address in canonical text, so that ranges compare as text; null for other text."""
    tail = r"(\d+)\.(\d+)\.(\d+)\.(\d+)$"
    pair = lambda x, i: F.lower(F.hex(F.regexp_extract(x, tail, i).cast("int") * 256 + F.regexp_extract(x, tail, i + 1).cast("int")))
    plain = lambda x: F.when(x.rlike(tail), F.concat(F.regexp_replace(x, tail, ""), pair(x, 1), F.lit(":"), pair(x, 3))).otherwise(x)
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")

    def digits(x: Column) -> Column:
        before, after = groups(F.substring_index(x, "::", 1)), F.when(x.contains("::"), groups(F.substring_index(x, "::", -1))).otherwise(F.array().cast("array<string>"))
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(before) - F.size(after)))
        return F.array_join(F.transform(F.concat(before, zeros, after), lambda g: F.lpad(g, 4, "0")), "")

    return let(let(c, plain), lambda x: F.when(x.rlike(r"^[0-9a-f:]*:[0-9a-f:]*$"), digits(x)))


def address_class(ip: Column) -> Column:
    """The class of a special address in canonical text, else null."""

    def of(key: Column, version: int, bound) -> Column:
        out = None
        for name, blocks in SPECIAL_RANGES:
            for block in map(ipaddress.ip_network, blocks):
                if block.version == version:
                    inside = key.between(bound(int(block[0])), bound(int(block[-1])))
                    out = F.when(inside, F.lit(name)) if out is None else out.when(inside, F.lit(name))
        return out

    four = let(ipv4_number(ip), lambda n: of(n, 4, lambda x: F.lit(x).cast("bigint")))
    six = let(ipv6_hex(ip), lambda h: of(h, 6, lambda x: F.lit(f"{x:032x}")))
    return F.when(ip.contains(":"), six).otherwise(four)


def with_address_class(df: DataFrame, ip_col: str = "norm") -> DataFrame:
    """Adds address_class; comparisons with fixed bounds, so no row moves."""
    return df.withColumn("address_class", address_class(F.col(ip_col)))
