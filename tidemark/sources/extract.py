"""Stored tool output to parsed observations.

Each extractor takes (job_id, content) rows and returns the parsed_observation schema: values, never ids. A broken
record is skipped and never fails its job; a body that is not what it should be gives no rows. Positions inside the
JSON become raw_path and the order `seq`. All is built-in functions: from_json in permissive mode, VARIANT where the
keys or the value types are open, and explode with positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import ascii_labels, fold, host_part, ipv6_text, strip
from ..functions.suffix import with_root
from ..schema import RELATIONS
from . import splits
from .archive import read_archive, text_of

PREFIX_LIMIT = 50
EXPIRY_DAYS = 90
BANNER_LIMIT = 2000

#: Text that marks a registrant as hidden.
HIDDEN = ["redacted", "privacy", "private", "not disclosed", "withheld", "data protected", "gdpr masked", "statutory masking enabled"]

#: Networks of cloud and delivery providers.
CLOUD_ASN = [
    ("13335", "Cloudflare"), ("16509", "AWS"), ("14618", "AWS"), ("15169", "Google"), ("396982", "Google Cloud"), ("8075", "Microsoft Azure"), ("54113", "Fastly"), ("20940", "Akamai"),
    ("16625", "Akamai"), ("14061", "DigitalOcean"), ("24940", "Hetzner"), ("16276", "OVH"), ("63949", "Linode"), ("13414", "Twitter"), ("32934", "Meta"),
]


#: `seq` counts by kinds of rows in steps that no array's length reaches.
_STEP = 1 << 31


def _bodies(raw: DataFrame) -> DataFrame:
    return raw.select("job_id", text_of(F.col("content")).alias("body"))


def _rel(kind: str, target_type: str, target: Column, direction: str) -> Column:
    one = F.struct(F.lit(kind).alias("rel_type"), F.lit(target_type).alias("target_type"), target.alias("target_raw"), F.lit(direction).alias("direction"))
    return F.when(target.isNotNull(), F.array(one))


def _row(kind: str, raw: Column, data: Column, path: Column, seq: Column, relations: Column | None = None) -> list[Column]:
    none = F.array().cast(RELATIONS)
    return [
        F.col("job_id"), seq.cast("bigint").alias("seq"), F.lit(kind).alias("type"), raw.alias("raw"), data.alias("data"), F.lit(None).cast("smallint").alias("confidence"),
        path.alias("raw_path"), (none if relations is None else F.coalesce(relations.cast(RELATIONS), none)).alias("relations"),
    ]


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _once(d: DataFrame, *columns: Column) -> DataFrame:
    """job_id and the columns, computed once a row: whatever filter or column follows reads them, where the optimizer would
    else write what they are made of (a parsed body, say) into each of them again."""
    return d.select("job_id", F.inline(F.array(F.struct(*columns))))


def _cell(kind: str, raw: Column, data: Column, path: Column, seq: Column, relations: Column | None = None) -> Column:
    """A row as one struct, for arrays of rows."""
    return F.struct(*_row(kind, raw, data, path, seq, relations)[1:])


def _json(*fields: Column) -> Column:
    """JSON of the fields that are not null."""
    return F.to_json(F.struct(*fields)) if fields else F.lit("{}")


def _path(template: str, *parts) -> Column:
    return F.format_string(template, *parts)


def _v(path: str, kind: str, column: str = "v") -> Column:
    return F.try_variant_get(column, path, kind)


def _text(column: str | Column) -> Column:
    """A VARIANT's string; null for any other type of value."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))


def _blank(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def _variants(raw: DataFrame, root: str) -> DataFrame:
    """job_id, v: bodies that are JSON with the wanted kind of root."""
    v = F.try_parse_json("body")
    return _bodies(raw).select("job_id", v.alias("v")).where(F.schema_of_variant("v").startswith(root))


def _items(path: str, column: str = "v") -> Column:
    return F.coalesce(F.try_variant_get(column, path, "array<variant>"), F.array().cast("array<variant>"))


def extract_ct_log(raw: DataFrame) -> DataFrame:
    """Certificate-transparency records: names of each record, and its certificate."""
    return ct_records(_variants(raw, "ARRAY").select("job_id", F.posexplode(_items("$")).alias("i", "v")))


def ct_records(each: DataFrame) -> DataFrame:
    """X1 from the numbered elements (job_id, i, v) of its arrays, however they were read (see `splits.read_records`)."""
    each = each.where(F.schema_of_variant("v").startswith("OBJECT"))
    field = lambda name: _text(F.try_variant_get("v", f"$.{name}", "variant"))
    each = each.select("job_id", "i", "v", _blank(field("serial_number")).alias("serial"), field("name_value").alias("names"), field("common_name").alias("common"))
    names = F.array_union(F.coalesce(F.transform(F.split("names", "\n"), strip), F.array().cast("array<string>")), F.coalesce(F.array(strip(F.col("common"))), F.array().cast("array<string>")))
    good = F.filter(F.array_sort(F.array_compact(names)), lambda n: (n != "") & ~n.rlike(r"(?U)\s") & ~n.contains("@"))
    named = each.select("job_id", "i", "serial", F.posexplode(good).alias("k", "name"))
    hosts = named.select(*_row("subdomain", F.col("name"), _json(F.when(F.col("name").startswith("*."), True).alias("wildcard")), _path("$[%d].name_value", F.col("i")), F.col("i") * _STEP + F.col("k"), _rel("cert_for", "cert", F.col("serial"), "in")))
    kept = F.struct(*[field(n).alias(n) for n in ("issuer_name", "not_before", "not_after")], F.try_variant_get("v", "$.id", "bigint").alias("id"))
    certs = each.where("serial is not null").select(*_row("cert", F.col("serial"), F.to_json(kept), _path("$[%d]", F.col("i")), F.col("i") * _STEP + _STEP - 1))
    return _union(hosts, certs)


def extract_subdomain_list(raw: DataFrame) -> DataFrame:
    """One JSON object a line; blank and broken lines keep their number."""
    return subdomain_lines(_bodies(raw).select("job_id", F.posexplode(F.split("body", r"\r?\n")).alias("i", "line")))


def subdomain_lines(lines: DataFrame) -> DataFrame:
    """X2 from numbered lines (job_id, i, line), however they were read (see `splits.read_lines`)."""
    each = lines.select("job_id", "i", F.from_json("line", "host string, input string, source string").alias("r")).select("job_id", "i", "r.*")
    each = each.withColumn("host", _blank(F.col("host"))).where("host is not null")
    target = F.when(_blank(F.col("input")) != F.col("host"), _blank(F.col("input")))
    return each.select(*_row("subdomain", F.col("host"), _json(F.col("source").alias("subfinder_kaynak")), _path("$[%d].host", F.col("i")), F.col("i"), _rel("subdomain_of", "domain", target, "out")))


_DNS = "hedef string, kayitlar map<string,struct<durum:string,veri:array<string>>>, dmarc struct<durum:string,veri:array<string>>, cname_zinciri array<string>"


def _body_of_txt(c: Column) -> Column:
    """The parts of a TXT record, without quotes and joined without blanks."""
    return F.array_join(F.transform(F.split(c, '" "'), lambda p: F.regexp_replace(strip(p), '^"+|"+$', "")), "")


def extract_dns(raw: DataFrame) -> DataFrame:
    """Addresses, CNAME chain, mail and name servers, the DNS provider, and the mail policy."""
    d = _bodies(raw).select("job_id", F.from_json("body", _DNS).alias("d")).select("job_id", "d.*")
    d = d.withColumn("target", F.nullif(F.regexp_replace(strip(F.col("hedef")), r"\.+$", ""), F.lit(""))).where("target is not null")
    values = lambda kind: F.coalesce(F.try_element_at("kayitlar", F.lit(kind))["veri"], F.array().cast("array<string>"))
    out = []
    for order, kind in enumerate(("A", "AAAA")):
        each = d.select("job_id", "target", F.posexplode(values(kind)).alias("i", "value")).where("value is not null")
        out.append(each.select(*_row("ip", F.col("value"), _json(F.lit(kind).alias("dns_kayit")), _path(f"$.kayitlar.{kind}.veri[%d]", F.col("i")), F.col("i") + order * _STEP, _rel("resolves_to", "subdomain", F.col("target"), "in"))))
    # the chain's hops with their place in it; each points back to the last hop before that is not blank
    hops = F.filter(F.transform("cname_zinciri", lambda n, i: F.struct(i.alias("i"), F.regexp_replace(strip(n), r"\.+$", "").alias("name"))), lambda h: F.coalesce(h["name"] != "", F.lit(False)))
    chain = d.select("job_id", "target", hops.alias("hops")).select("job_id", "target", "hops", F.posexplode("hops").alias("k", "hop"))
    before = F.when(F.col("k") == 0, F.col("target")).otherwise(F.element_at("hops", F.greatest(F.col("k"), F.lit(1)))["name"])
    out.append(chain.select(*_row("subdomain", F.col("hop.name"), _json(F.lit("CNAME").alias("dns_kayit"), (F.col("hop.i") + 1).alias("cname_adim")), _path("$.cname_zinciri[%d]", F.col("hop.i")), F.col("hop.i") + 2 * _STEP, _rel("cname_for", "subdomain", before, "in"))))
    for order, (kind, relation) in enumerate((("MX", "mx_for"), ("NS", "ns_for")), 3):
        each = d.select("job_id", "target", F.posexplode(values(kind)).alias("i", "value"))
        words = F.filter(F.split("value", r"(?U)\s+"), lambda w: w != "")
        each = each.withColumn("words", words).where("size(words) > 0").withColumn("server", F.regexp_replace(F.element_at("words", -1), r"\.+$", "")).where("server <> ''")
        rank = F.when((F.lit(kind) == "MX") & (F.size("words") >= 2) & F.col("words")[0].rlike(r"^\d{1,9}$"), F.col("words")[0].cast("int"))
        out.append(each.select(*_row("subdomain", F.col("server"), _json(F.lit(kind).alias("dns_kayit"), rank.alias("mx_oncelik")), _path(f"$.kayitlar.{kind}.veri[%d]", F.col("i")), F.col("i") + order * _STEP, _rel(relation, "domain", F.col("target"), "out"))))
        if kind == "NS":
            out.append(_dns_provider(each))
    out.append(_mail_policy(d, values))
    out.append(_spf_includes(d, values))
    return _union(*out)


def _dns_provider(servers: DataFrame) -> DataFrame:
    """X3d: the first name server of each foreign registrable root names the provider."""
    keyed = servers.select("job_id", "i", "server", fold(host_part(F.col("server"))).alias("host"), fold(host_part(F.col("target"))).alias("thost"))
    rooted = with_root(keyed.withColumn("host", F.when(F.col("host").rlike(r"^\p{ASCII}*$"), F.col("host")).otherwise(ascii_labels("host"))))
    both = with_root(rooted, "thost", "troot").where("root is not null and not (root <=> troot)")
    first = both.groupBy("job_id", "root").agg(F.min_by(F.struct("i", "server"), "i").alias("f"))
    data = _json(F.lit("NS").alias("kaynak"), F.col("root").alias("ns_kok"), F.col("f.server").alias("ns"))
    return first.select(*_row("org", F.substring_index("root", ".", 1), data, _path("$.kayitlar.NS.veri[%d]", F.col("f.i")), F.col("f.i") + 5 * _STEP))


def _spf(values) -> Column:
    return _body_of_txt(F.get(F.filter(values("TXT"), lambda t: F.lower(_body_of_txt(t)).startswith("v=spf1")), F.lit(0)))


def _spf_list(words: Column, name: str) -> Column:
    return F.transform(F.filter(words, lambda w: F.lower(w).startswith(f"{name}:")), lambda w: F.regexp_extract(w, r"^[^:]*:(.*)$", 1))


def _mail_policy(d: DataFrame, values) -> DataFrame:
    """X3e: SPF, DMARC, CAA and SOA of the target; that a record is missing is recorded too."""
    d = d.select("job_id", "target", _spf(values).alias("spf"), _body_of_txt(F.get(F.filter("dmarc.veri", lambda t: F.lower(_body_of_txt(t)).startswith("v=dmarc1")), F.lit(0))).alias("dmarc"), values("CAA").alias("caa"), F.get(values("SOA"), F.lit(0)).alias("soa"))
    words = F.filter(F.split("spf", r"(?U)\s+"), lambda w: w != "")
    last = F.element_at(F.filter(F.transform(words, F.lower), lambda w: w.endswith("all") & (F.length(w) <= 4)), -1)
    everyone = F.when(F.size(F.filter(words, lambda w: F.lower(w).endswith("all") & (F.length(w) <= 4))) > 0, last)
    there = F.col("spf").isNotNull()
    pairs = F.map_from_entries(F.transform(F.filter(F.split("dmarc", ";"), lambda p: p.contains("=")), lambda p: F.struct(F.lower(strip(F.substring_index(p, "=", 1))), strip(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)))))
    tag = lambda n: F.try_element_at(pairs, F.lit(n)).alias(f"dmarc_{n}")
    some = lambda a: F.when(F.size(a) > 0, a)
    data = _json(
        F.lit("TXT").alias("dns_kayit"), (~there).alias("spf_yok"), F.col("spf").alias("spf_ham"), everyone.alias("spf_all"),
        F.when(there, F.coalesce(everyone.isin("?all", "+all"), F.lit(True))).alias("spf_zayif"), F.when(there, F.transform(_spf_list(words, "include"), lambda w: F.regexp_replace(w, r"\.+$", ""))).alias("spf_include"),
        some(_spf_list(words, "ip4")).alias("spf_ip4"), some(_spf_list(words, "ip6")).alias("spf_ip6"), F.col("dmarc").isNull().alias("dmarc_yok"), F.col("dmarc").alias("dmarc_ham"),
        *[tag(n) for n in ("p", "sp", "pct", "rua", "ruf", "adkim", "aspf")], F.when(F.col("dmarc").isNotNull(), F.lower(F.coalesce(F.try_element_at(pairs, F.lit("p")), F.lit("none"))) == "none").alias("dmarc_zayif"),
        (F.size("caa") == 0).alias("caa_yok"), some(F.col("caa")).alias("caa"), F.col("soa").alias("soa"),
    )
    return d.select(*_row("subdomain", F.col("target"), data, F.lit("$.kayitlar"), F.lit(9 * _STEP)))


def _spf_includes(d: DataFrame, values) -> DataFrame:
    words = F.filter(F.split("spf", r"(?U)\s+"), lambda w: w != "")
    each = d.select("job_id", "target", _spf(values).alias("spf")).select("job_id", "target", F.posexplode(_spf_list(words, "include")).alias("i", "name"))
    name = F.regexp_replace("name", r"\.+$", "")
    return each.select(*_row("tech", F.concat(F.lit("spf-include:"), name), _json(F.lit("SPF").alias("kaynak"), F.col("target").alias("hedef")), F.lit("$.kayitlar.TXT"), F.col("i") + 8 * _STEP))


_ENTITIES = "array<struct<roles:array<string>,vcardArray:variant>>"


def _role_name(role: str) -> Column:
    """The vCard name of the first entity of a role that has one: `org` before `fn`."""
    entities = F.transform(_items("$.entities"), lambda e: F.struct(F.transform(F.coalesce(F.try_variant_get(e, "$.roles", "array<string>"), F.array().cast("array<string>")), F.lower).alias("roles"), F.coalesce(F.try_variant_get(e, "$.vcardArray[1]", "array<variant>"), F.array().cast("array<variant>")).alias("card")))

    def named(card: Column, field: str) -> Column:
        texts = F.transform(F.filter(card, lambda f: F.try_variant_get(f, "$[0]", "string") == field), lambda f: _blank(_text(F.try_variant_get(f, "$[3]", "variant"))))
        return F.try_element_at(F.array_compact(texts), F.lit(-1))

    names = F.transform(F.filter(entities, lambda e: F.array_contains(e["roles"], role)), lambda e: F.coalesce(named(e["card"], "org"), named(e["card"], "fn")))
    return F.get(F.array_compact(names), F.lit(0))


def _hidden(c: Column) -> Column:
    return (strip(c) == "") | F.lower(c).rlike("|".join(HIDDEN))


def extract_rdap(raw: DataFrame) -> DataFrame:
    """Registration data of a domain or an IP network, plain or in an envelope with the queried target."""
    every = _once(_bodies(raw), F.try_parse_json("body").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    inner = F.when(F.schema_of_variant(F.try_variant_get("v", "$.yanit", "variant")).startswith("OBJECT"), F.try_variant_get("v", "$.yanit", "variant"))
    every = _once(every, F.coalesce(inner, F.col("v")).alias("v"), _v("$.hedef", "string").alias("asked"))
    kind = F.lower(_v("$.objectClassName", "string"))
    return _union(_rdap_domain(every.where(kind == "domain")), _rdap_network(every.where(kind == "ip network")))


def _rdap_domain(d: DataFrame) -> DataFrame:
    """Each body is read once; its rows are made together."""
    name = F.regexp_replace(strip(F.coalesce(F.nullif(_v("$.ldhName", "string"), F.lit("")), _v("$.unicodeName", "string"))), r"\.+$", "")
    server = lambda ns: F.nullif(F.regexp_replace(strip(F.try_variant_get(ns, "$.ldhName", "string")), r"\.+$", ""), F.lit(""))
    event = lambda e: F.struct(F.lower(F.try_variant_get(e, "$.eventAction", "string")).alias("action"), _text(F.try_variant_get(e, "$.eventDate", "variant")).alias("date"))
    d = _once(
        d, F.nullif(name, F.lit("")).alias("name"), _role_name("registrant").alias("owner"), _role_name("registrar").alias("registrar"), F.transform(_items("$.nameservers"), server).alias("servers"),
        F.transform(_items("$.events"), event).alias("events"), F.array_compact(F.transform(_items("$.status"), _text)).alias("status"),
    ).where("name is not null")
    open_owner = F.col("owner").isNotNull() & ~_hidden(F.col("owner"))
    org = F.when(open_owner, _cell("org", F.col("owner"), _json(F.lit("rdap").alias("kaynak"), F.lit("registrant").alias("rol"), F.col("name").alias("domain")), F.lit("$.entities[?(@.roles=='registrant')]"), F.lit(0), _rel("owned_by", "domain", F.col("name"), "in")))
    host = lambda s, i: F.when(s.isNotNull(), _cell("subdomain", s, _json(F.lit("rdap").alias("kaynak"), F.lit("nameserver").alias("rol")), _path("$.nameservers[%d].ldhName", i), i + 1, _rel("ns_for", "domain", F.col("name"), "out")))
    # The last date of each action; days left count from the registry's own update, not from today
    when = lambda action: F.try_element_at(F.array_compact(F.transform(F.filter("events", lambda e: e["action"] == action), lambda e: e["date"])), F.lit(-1))
    seconds = lambda c: F.unix_timestamp(F.try_to_timestamp(c))
    left = F.floor((seconds(when("expiration")) - seconds(when("last update of rdap database"))) / 86400)
    data = _json(
        F.lit("rdap").alias("kaynak"), F.when(F.size("status") > 0, F.col("status")).alias("rdap_durum"), when("registration").alias("olusturma"), when("expiration").alias("bitis"), when("last changed").alias("son_degisiklik"),
        when("last update of rdap database").alias("rdap_guncelleme"), left.alias("bitise_kalan_gun"), (left <= EXPIRY_DAYS).alias("bitis_yakin"), F.when(~_hidden(F.col("registrar")), F.col("registrar")).alias("registrar"),
        F.when(F.col("owner").isNull(), True).alias("kayit_sahibi_yok"), F.when(F.col("owner").isNotNull(), ~open_owner).alias("kayit_sahibi_gizli"), F.when(F.col("owner").isNotNull() & ~open_owner, F.col("owner")).alias("kayit_sahibi_ham"),
    )
    rows = F.concat(F.array(org), F.transform("servers", host), F.array(_cell("domain", F.col("name"), data, F.lit("$"), F.lit(9 * _STEP))))
    return d.select("job_id", F.inline(F.array_compact(rows)))


def _rdap_network(d: DataFrame) -> DataFrame:
    block = lambda c: F.concat(F.coalesce(_text(F.try_variant_get(c, "$.v4prefix", "variant")), _text(F.try_variant_get(c, "$.v6prefix", "variant"))), F.lit("/"), F.when(F.schema_of_variant(F.try_variant_get(c, "$.length", "variant")) == "BIGINT", F.try_variant_get(c, "$.length", "string")))
    owner = F.coalesce(_role_name("registrant"), _role_name("administrative"))
    numbers = F.flatten(F.map_values(F.map_filter(F.transform_values(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, x: F.try_variant_get(x, "$", "array<bigint>")), lambda k, x: F.lower(k).contains("autnum") & x.isNotNull())))
    fields = [_blank(_text(F.try_variant_get("v", f"$.{n}", "variant"))).alias(f"rdap_{n}") for n in ("name", "country", "type", "handle")]
    d = d.select("job_id", F.when(~F.col("asked").contains("/") & F.col("asked").rlike(r"^[0-9.]+$|:"), F.col("asked")).alias("ip"), F.array_compact(F.transform(_items("$.cidr0_cidrs"), block)).alias("blocks"), owner.alias("owner"), numbers.alias("numbers"), _json(F.lit("rdap").alias("kaynak"), *fields).alias("data"))
    first = F.get("blocks", F.lit(0))
    nets = d.select("job_id", "ip", "data", F.posexplode("blocks").alias("i", "block")).select(*_row("netblock", F.col("block"), F.col("data"), _path("$.cidr0_cidrs[%d]", F.col("i")), F.col("i"), _rel("in_netblock", "ip", F.col("ip"), "in")))
    orgs = d.where(F.col("owner").isNotNull() & ~_hidden(F.col("owner")) & (F.size("blocks") > 0)).select(*_row("org", F.col("owner"), _json(F.lit("rdap").alias("kaynak"), F.lit("ip-registrant").alias("rol")), F.lit("$.entities"), F.lit(_STEP), _rel("owned_by", "netblock", first, "in")))
    asns = d.select("job_id", first.alias("first"), F.posexplode("numbers").alias("i", "asn")).where("asn is not null").select(*_row("asn", F.col("asn").cast("string"), _json(F.lit("rdap").alias("kaynak")), _path("$.arin_originas0_originautnums[%d]", F.col("i")), F.col("i") + 2 * _STEP, _rel("announced_by", "netblock", F.col("first"), "in")))
    return _union(nets, orgs, asns)


def holder_name(c: Column) -> Column:
    """What follows ` - `, or what follows a first word that ends in -AS."""
    h = strip(c)
    after = strip(F.regexp_extract(h, r"(?s)^.*? - (.*)$", 1))
    return F.when(h.contains(" - "), F.when(after == "", h).otherwise(after)).when(h.rlike(r"(?is)^[^ ]*-AS .*\S"), strip(F.regexp_extract(h, r"(?s)^[^ ]* (.*)$", 1))).otherwise(h)


_BGP = "atlandi string, network_info struct<prefix:string>, asn_bilgi map<string,struct<holder:string>>, prefixler map<string,struct<sayi:int,liste:array<string>>>"


def extract_bgp(raw: DataFrame) -> DataFrame:
    """Networks with their holder and announced blocks; above the limit a network's blocks are not written."""
    d = _bodies(raw).select("job_id", F.from_json("body", _BGP).alias("d")).select("job_id", "d.*").where("asn_bilgi is not null and coalesce(atlandi, 'false') in ('false', '')")
    each = d.select("job_id", F.col("network_info.prefix").alias("cover"), "prefixler", F.posexplode(F.map_entries("asn_bilgi")).alias("k", "e")).select("job_id", "cover", F.col("e.key").alias("asn"), _blank(F.col("e.value.holder")).alias("holder"), F.try_element_at("prefixler", F.col("e.key")).alias("p"))
    cloud = F.broadcast(raw.sparkSession.createDataFrame(CLOUD_ASN, "asn string, cloud string"))
    each = each.withColumn("n", F.coalesce("p.sayi", F.lit(0))).withColumn("over", F.col("n") > PREFIX_LIMIT).join(cloud, "asn", "left")
    flag = lambda c: F.when(c, True)
    data = _json(F.lit("ripestat").alias("kaynak"), F.col("n").alias("duyurulan_prefiks_sayisi"), F.col("holder").alias("as_holder"), F.col("cloud").alias("bulut_saglayici"), flag(F.col("cloud").isNotNull()).alias("hedefe_ait_degil"), flag(F.col("cloud").isNull() & F.col("over")).alias("saglayici_olabilir"), flag(F.col("over")).alias("prefiks_sinir_asildi"), F.when(F.col("over"), PREFIX_LIMIT).alias("prefiks_siniri"))
    seq = F.dense_rank().over(_by_job("asn")) * _STEP
    each = each.withColumn("seq0", seq)
    asns = each.select(*_row("asn", F.col("asn"), data, _path("$.asn_bilgi.%s", F.col("asn")), F.col("seq0"), _rel("announced_by", "netblock", F.nullif(F.col("cover"), F.lit("")), "in")))
    orgs = each.where("holder is not null").select(*_row("org", holder_name(F.col("holder")), _json(F.lit("ripestat").alias("kaynak"), F.col("asn").alias("asn"), F.col("holder").alias("as_holder")), _path("$.asn_bilgi.%s.holder", F.col("asn")), F.col("seq0") + 1, _rel("owned_by", "asn", F.col("asn"), "in")))
    nets = each.where("not over").select("job_id", "asn", "seq0", F.posexplode("p.liste").alias("i", "block")).where("block is not null")
    nets = nets.select(*_row("netblock", F.col("block"), _json(F.lit("ripestat").alias("kaynak"), F.col("asn").alias("duyuran_asn")), _path("$.prefixler.%s.liste[%d]", F.col("asn"), F.col("i")), F.col("seq0") + 2 + F.col("i"), _rel("announced_by", "asn", F.col("asn"), "out")))
    return _union(asns, orgs, nets)


def _by_job(order: str):
    from pyspark.sql import Window

    return Window.partitionBy("job_id").orderBy(order)


def clean_banner(c: Column) -> Column:
    """Without control characters other than tab, line feed and carriage return; cut at the limit."""
    s = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.when(F.length(s) > BANNER_LIMIT, F.concat(F.substring(s, 1, BANNER_LIMIT), F.lit("…[kirpildi]"))).otherwise(s)


def extract_host_index(raw: DataFrame) -> DataFrame:
    """The owner of an address, and its services with product and version."""
    d = _variants(raw, "OBJECT").where(F.try_variant_get("v", "$.error", "variant").isNull() & ~F.coalesce(F.try_variant_get("v", "$.atlandi", "boolean"), F.lit(False)))
    field = lambda n, c="v": _text(F.try_variant_get(c, f"$.{n}", "variant"))
    d = d.select("job_id", "v", _blank(field("ip_str")).alias("ip")).where("ip is not null")
    org = _blank(F.coalesce(F.nullif(field("org"), F.lit("")), field("isp")))
    orgs = d.where(org.isNotNull()).select(*_row("org", org, _json(F.lit("shodan").alias("kaynak"), field("isp").alias("isp"), field("country_code").alias("ulke")), F.lit("$.org"), F.lit(0), _rel("owned_by", "ip", F.col("ip"), "in")))
    each = d.select("job_id", F.coalesce(F.when(F.col("ip").contains(":"), ipv6_text("ip")), F.col("ip")).alias("address"), "ip", F.posexplode(_items("$.data")).alias("i", "s"))
    whole = F.schema_of_variant(F.try_variant_get("s", "$.port", "variant")) == "BIGINT"
    each = each.withColumn("port", F.when(whole, F.try_variant_get("s", "$.port", "bigint"))).where("port between 1 and 65535")
    proto = F.lower(F.coalesce(F.nullif(field("transport", "s"), F.lit("")), F.lit("tcp")))
    shown = F.when(F.col("address").contains(":"), F.concat(F.lit("["), "address", F.lit("]"))).otherwise(F.col("address"))
    each = each.withColumn("proto", proto).withColumn("service", F.concat(shown, F.lit(":"), F.col("port").cast("string"), F.lit("/"), "proto"))
    banner = F.coalesce(F.nullif(field("banner", "s"), F.lit("")), field("data", "s"), field("banner", "s"))
    data = _json(F.lit("shodan").alias("kaynak"), F.col("port").alias("port"), F.col("proto").alias("proto"), F.try_variant_get("s", "$.product", "string").alias("product"), F.try_variant_get("s", "$.version", "string").alias("version"), field("timestamp", "s").alias("son_gorulme_shodan"), clean_banner(banner).alias("banner"))
    services = each.select(*_row("service", F.col("service"), data, _path("$.data[%d]", F.col("i")), F.col("i") * 2 + 1, _rel("runs_on", "ip", F.col("ip"), "out")))
    product = _blank(field("product", "s"))
    tech = F.concat_ws(":", product, product, F.coalesce(_blank(field("version", "s")), F.lit("*")))
    techs = each.where(product.isNotNull()).select(*_row("tech", tech, _json(F.lit("shodan").alias("kaynak"), F.col("port").alias("port")), _path("$.data[%d].product", F.col("i")), F.col("i") * 2 + 2, _rel("uses_tech", "service", F.col("service"), "in")))
    return _union(orgs, services, techs)


def extract_harvest(raw: DataFrame) -> DataFrame:
    """Harvested hosts `name[:ip]` and e-mail addresses, without scraping rests."""
    d = _variants(raw, "OBJECT")
    hosts = d.select("job_id", F.posexplode(_items("$.hosts")).alias("i", "h")).select("job_id", "i", strip(_text("h")).alias("h"))
    hosts = hosts.withColumn("name", F.regexp_replace(strip(F.substring_index("h", ":", 1)), r"\.+$", "")).where(F.col("name").contains(".") & ~F.col("name").rlike(r"(?U)[\s%@]|^2F"))
    ip = F.when(F.col("h").contains(":"), _blank(F.regexp_extract("h", r"(?s)^[^:]*:(.*)$", 1)))
    found = hosts.select(*_row("subdomain", F.col("name"), _json(F.lit("theharvester").alias("kaynak"), ip.alias("cozumlenen_ip")), _path("$.hosts[%d]", F.col("i")), F.col("i")))
    mails = d.select("job_id", F.posexplode(_items("$.emails")).alias("i", "m")).select("job_id", "i", strip(_text("m")).alias("mail"))
    mails = mails.where(F.col("mail").rlike(r"(?U)^[^@\s%]+@[^@\s%.][^@\s%]*\.[^@\s%]*$"))
    domain = F.nullif(F.regexp_replace(F.substring_index("mail", "@", -1), r"\.+$", ""), F.lit(""))
    addresses = mails.select(*_row("email", F.col("mail"), _json(F.lit("theharvester").alias("kaynak")), _path("$.emails[%d]", F.col("i")), F.col("i") + _STEP, _rel("email_at", "domain", domain, "out")))
    return _union(found, addresses)


#: 2.14: the extension point. A new source is one more entry.
EXTRACTORS = {
    "crtsh": extract_ct_log,
    "subfinder": extract_subdomain_list,
    "dns-resolver": extract_dns,
    "whois-rdap": extract_rdap,
    "asn-bgp": extract_bgp,
    "shodan-lookup": extract_host_index,
    "theharvester": extract_harvest,
}


#: Bytes from which on a body is read in splits, if its tool's records can be told apart.
LARGE = 64 << 20


def extract_archive(spark: SparkSession, paths: str | list[str], jobs: DataFrame, large: int = LARGE) -> DataFrame:
    """S1 and X1-X7 over the archived files below the paths: large bodies of the two tools whose output has no bound, by
    splits; all others as one row each. The contents of the former are never one row."""
    in_splits = {"crtsh": lambda found: ct_records(splits.read_records(spark, found)), "subfinder": lambda found: subdomain_lines(splits.read_lines(spark, found))}
    files, tools = read_archive(spark, paths), jobs.select("job_id", "tool")
    big: dict[str, list[str]] = {}
    for row in files.where(F.col("length") >= large).select("job_id", "path").join(tools, "job_id").where(F.col("tool").isin(*in_splits)).collect():  # a row for each 64 MB at most
        big.setdefault(row["tool"], []).append(row["path"])
    whole = files.where(F.col("length") < large).select("job_id", "content")
    if big:
        rest = tools.where(~F.col("tool").isin(*in_splits)).select("job_id")
        whole = whole.unionByName(files.where(F.col("length") >= large).join(rest, "job_id", "left_semi").select("job_id", "content"))
    else:
        whole = files.select("job_id", "content")
    return _union(extract_all(whole, jobs), *[in_splits[tool](found) for tool, found in big.items()])


def extract_all(archive: DataFrame, jobs: DataFrame) -> DataFrame:
    """The parsed observations of all archived outputs, each by its job's tool."""
    known = archive.select("job_id", "content").join(jobs.select("job_id", "tool"), "job_id")
    there = {r["tool"] for r in jobs.select("tool").distinct().collect()}  # names of tools, a handful
    used = [name for name in EXTRACTORS if name in there] or list(EXTRACTORS)[:1]
    return _union(*[EXTRACTORS[name](known.where(F.col("tool") == name)) for name in used])
