"""The public-suffix rules, and registrable roots by lookups of a host's ends.

The rules are the ICANN section of the public list (https://publicsuffix.org, Mozilla Public License 2.0; the notice
stands in the file), which comes with the package, so nothing depends on how Spark is installed. There is no implicit
`*` rule: an unknown top-level domain is no valid one."""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIST = "public_suffix_list.dat"
EXACT, WILDCARD, EXCEPTION = 1, 2, 4


@lru_cache(maxsize=1)
def _rules() -> dict[str, int]:
    """Suffix in ASCII -> the kinds of its rules, added up."""
    icann = resources.files(__package__).joinpath(LIST).read_text("utf-8").split("===BEGIN ICANN DOMAINS===")[1].split("===END ICANN DOMAINS===")[0]
    out: dict[str, int] = {}
    for line in icann.splitlines():
        rule = line.strip()
        if not rule or rule.startswith("//"):
            continue
        kind = EXCEPTION if rule[0] == "!" else WILDCARD if rule.startswith("*.") else EXACT
        name = rule[1:] if kind == EXCEPTION else rule[2:] if kind == WILDCARD else rule
        name = ".".join(p if p.isascii() else p.encode("idna").decode("ascii") for p in name.lower().split("."))
        out[name] = out.get(name, 0) | kind
    return out


@lru_cache(maxsize=4)
def rules(spark: SparkSession) -> DataFrame:
    """suffix, kinds: some 7,000 rows, fixed with the list's version; a local relation, no job makes it, and it is sent
    to the JVM once a session."""
    known = _rules()
    return spark.createDataFrame(pa.table({"suffix": list(known), "kinds": pa.array(known.values(), pa.int32())}))


def with_root(hosts: DataFrame, host: str = "host", root: str = "root") -> DataFrame:
    """Adds the registrable root of each host (lower-case ASCII); null without a known suffix or below it only.

    A host's last label, its last two and so on are looked up in the broadcast rules, as many as the longest rule
    has, so no row moves; the longest rule wins, an exception above all."""
    table = F.broadcast(rules(hosts.sparkSession))
    deepest = max(name.count(".") for name in _rules()) + 1
    labels = F.split(host, r"\.")
    rows = hosts.withColumn("_labels", F.size(labels))
    for n in range(1, deepest + 1):
        end = F.when(F.col("_labels") >= n, F.substring_index(host, ".", -n))
        rows = rows.join(table.select(F.col("suffix").alias(f"_s{n}"), F.col("kinds").alias(f"_k{n}")), end == F.col(f"_s{n}"), "left").drop(f"_s{n}")
    # labels of the public suffix: the rule's, one more for a wildcard (of which there must be one), one less for an exception
    has = lambda n, kind: F.coalesce(F.col(f"_k{n}").bitwiseAND(F.lit(kind)) != 0, F.lit(False))
    depths = range(1, deepest + 1)
    longest = F.greatest(*[F.when(has(n, WILDCARD) & (F.col("_labels") > n), n + 1).when(has(n, EXACT), n) for n in depths])
    rows = rows.withColumn("_n", F.coalesce(*[F.when(has(n, EXCEPTION), n - 1) for n in depths], longest))
    named = F.when(F.col("_labels") > F.col("_n"), F.call_function("substring_index", F.col(host), F.lit("."), -(F.col("_n") + 1)))
    return rows.withColumn(root, named).drop("_labels", "_n", *[f"_k{n}" for n in depths])
