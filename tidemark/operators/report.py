"""Markdown reports, one document an investigation, all in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ranges import spread
from ..storage import cut, stored
from .graph import isolated, lineage
from .scoring import latest
from .triage import GROUPS, rank_of

MARKER = "outside the investigation or missing"


def escaped(c: Column) -> Column:
    """Text that makes neither HTML nor Markdown: blanks squeezed, control characters out, both escaped."""
    s = F.coalesce(c.cast("string"), F.lit("—"))
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    s = F.regexp_replace(s, r"[\x00-\x1f]", "")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(char), F.lit(entity))
    return F.regexp_replace(s, r"([\\`*_{}\[\]()#+.!|~\-])", r"\\$1")


def _line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[escaped(c) for c in cells]), F.lit(" |"))


def totals(entities: DataFrame, observations: DataFrame, relationships: DataFrame, jobs: DataFrame) -> DataFrame:
    """Entities, observations, relations, jobs of each investigation; only what lies inside it."""
    parts = [("entities", entities.select("inv_id")), ("observations", lineage(observations, jobs, entities).select("inv_id")), ("relations", isolated(relationships, entities).select("inv_id")), ("jobs", jobs.select("inv_id"))]
    rows = reduce(DataFrame.unionByName, [df.groupBy("inv_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(name)) for name, df in parts])
    return rows.groupBy("inv_id").agg(*[F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(name) for name, _ in parts])


def hypothesis_rows(hypotheses: DataFrame, entities: DataFrame) -> DataFrame:
    """Confirmed or not, with ids outside the investigation replaced by a marker, in their order."""
    each = hypotheses.select("hyp_id", "inv_id", F.posexplode_outer("entity_ids").alias("p", "entity_id"))
    known = entities.select("inv_id", "entity_id", F.lit(True).alias("_k"))
    shown = each.join(known, ["inv_id", "entity_id"], "left").withColumn("shown", F.when(F.col("_k"), F.col("entity_id")).when(F.col("entity_id").isNotNull(), MARKER))
    ids = shown.groupBy("hyp_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "shown"))), lambda s: s["shown"]), ", ").alias("ids"))
    return hypotheses.join(ids, "hyp_id").select("hyp_id", "inv_id", "title", "body", "confidence", "analyst_status", "model", "created_at", "ids", F.coalesce(F.col("analyst_status") == "confirmed", F.lit(False)).alias("confirmed"))


TITLES = ["## Relations", "## Jobs", "## Evidence", "## Latest assessments", "## Confirmed hypotheses", "## Other hypotheses"]


def body(triaged, observations, relationships, jobs, assessments, hypotheses, entities) -> DataFrame:
    """R2: inv_id, section, k1, k2, k3 (order inside the section), line: the rows of all tables."""

    def rows(df: DataFrame, section: Column, line: Column, k1: Column, k2: Column | None = None, k3: Column | None = None) -> DataFrame:
        key = lambda c: (F.lit("") if c is None else c.cast("string"))
        return df.select("inv_id", section.cast("int").alias("section"), F.concat(F.lit("+"), k1.cast("string")).alias("k1"), key(k2).alias("k2"), key(k3).alias("k3"), line.alias("line"))

    newest = latest(assessments).join(entities.select("inv_id", "entity_id"), "entity_id")
    guesses = hypothesis_rows(hypotheses, entities)
    return reduce(DataFrame.unionByName, [
        rows(triaged, rank_of(F.col("triage")), _line(F.col("entity_id"), F.col("type"), F.col("raw"), F.col("obs_count"), F.col("n_tools"), F.array_join("tools", ", "), F.array_join("reasons", "; ")), F.lpad(F.col("position").cast("string"), 12, "0")),
        rows(isolated(relationships, entities), F.lit(5), _line(F.col("src_id"), F.col("type"), F.col("dst_id")), F.col("type"), F.col("rel_id")),
        rows(jobs, F.lit(6), _line(F.col("job_id"), F.col("tool"), F.col("target_value"), F.col("status"), F.col("attempts"), F.col("error")), F.col("created_at"), F.col("job_id")),
        rows(lineage(observations, jobs, entities), F.lit(7), _line(F.col("obs_id"), F.col("entity_id"), F.concat_ws(" / ", "tool", "tool_version"), F.col("confidence"), F.col("observed_at"), F.col("raw_ref"), F.col("raw_path")), F.col("entity_id"), F.col("observed_at"), F.col("obs_id")),
        rows(newest, F.lit(8), _line(F.col("entity_id"), F.col("score"), F.col("reason"), F.col("model"), F.col("prompt_version"), F.col("scored_at")), F.col("entity_id")),
        rows(guesses, F.when(F.col("confirmed"), 9).otherwise(10), _line(F.col("title"), F.col("body"), F.col("confidence"), F.col("analyst_status"), F.col("ids"), F.col("model")), F.col("created_at"), F.col("hyp_id")),
    ])


def sections(investigations, triaged, observations, relationships, jobs, assessments, hypotheses, entities) -> DataFrame:
    """R2: the lines of all reports. The tables' rows are made once; heads and totals are made from their numbers."""
    lines = cut(body(triaged, observations, relationships, jobs, assessments, hypotheses, entities))
    groups = range(1, len(GROUPS) + 1)
    n = lambda *sections: F.coalesce(F.sum(F.when(F.col("section").isin(*sections), F.col("n"))), F.lit(0)).cast("string")
    counts = lines.groupBy("inv_id", "section").agg(F.count("*").alias("n")).groupBy("inv_id").agg(n(*groups).alias("entities"), n(7).alias("observations"), n(5).alias("relations"), n(6).alias("jobs"), *[n(g).alias(f"n{g}") for g in groups])
    of = lambda name: F.coalesce(F.col(name), F.lit("0"))
    text = lambda label, name: F.concat(F.lit(label), escaped(F.col(name)))
    heads = [
        (0, text("# Report: ", "name")), (0, text("- Root: ", "root_value")), (0, text("- Scope: ", "scope_note")), (0, text("- Created by: ", "created_by")),
        (0, F.concat(F.lit("- Authorized: "), F.when(F.col("authorized"), "yes").otherwise("no"))),
        (0, F.concat(F.lit("Entities: "), of("entities"), F.lit(" · Observations: "), of("observations"), F.lit(" · Relations: "), of("relations"), F.lit(" · Jobs: "), of("jobs"))),
        *[(g, F.concat(F.lit(f"## {GROUPS[g - 1]} ("), of(f"n{g}"), F.lit(")"))) for g in groups], *[(len(GROUPS) + k, F.lit(title)) for k, title in enumerate(TITLES, 1)],
    ]
    made = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(f" {k:02d}").alias("k1"), line.alias("line")) for k, (section, line) in enumerate(heads)])
    first = investigations.join(counts, "inv_id", "left").select("inv_id", F.inline(made)).select("inv_id", "section", "k1", F.lit("").alias("k2"), F.lit("").alias("k3"), "line")
    return first.unionByName(lines)


#: The order of a report's lines; total, since a line may stand twice only with different keys or the same text.
ORDER = ["section", "k1", "k2", "k3", "line"]


def document_lines(lines: DataFrame) -> DataFrame:
    """inv_id, place (from 1), line of each document, whatever its length: places are carried over ranges."""
    return spread(lines, ["inv_id"], ORDER).numbered("place", "bigint").select("inv_id", "place", "line")


def documents(lines: DataFrame) -> DataFrame:
    """inv_id, markdown, for documents that fit a row; `write_documents` has no such bound."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "k1", "k2", "k3", "line")))
    return lines.groupBy("inv_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("markdown"))


def write_lines(lines: DataFrame, path: str) -> None:
    """The reports as text, partitioned by investigation, whatever their size: ranges of lines are written by tasks of
    their own, and a document is its files in the order of their names."""
    by, n = ["inv_id", *ORDER], int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored(lines).repartitionByRange(n, *by).sortWithinPartitions(*by).select("inv_id", F.col("line").alias("value")).write.partitionBy("inv_id").text(path)


def write_documents(lines: DataFrame, path: str) -> DataFrame:
    """Writes the reports and gives their tables of contents: inv_id, part (in order, from 1), file, first_place,
    lines. A reader gets any stretch of a document, or all of it, by joining files on."""
    write_lines(lines, path)
    spark = lines.sparkSession
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    files = spark.read.option("recursiveFileLookup", "true").text(path).groupBy(plain(F.input_file_name()).alias("file")).agg(F.count("*").alias("lines"))
    named = files.withColumn("inv_id", plain(F.regexp_extract("file", "inv_id=([^/]*)/", 1)))  # Spark writes some characters of a value as %XX
    w = Window.partitionBy("inv_id").orderBy("file")  # a row a file
    before = F.coalesce(F.sum("lines").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return named.select("inv_id", F.row_number().over(w).alias("part"), "file", (before + 1).alias("first_place"), "lines")
