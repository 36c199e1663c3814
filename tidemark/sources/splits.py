"""Bodies of any size in splits (S1, X1, X2): numbered lines of JSONL files and records of top-level JSON arrays.

A file is cut where Spark cuts text files, so that one body is many tasks. What a split must know of the splits before
it is a count: lines for their numbers; quotes, open brackets and ended records for an array. Counts are taken within
each split, added up over a file's splits (one row each), and broadcast to the splits that do not begin a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ranges import met
from ..storage import stored

SPLIT = ["file", "start"]


def _here(last: int):
    """The window of a split's fragments up to this one (0) or the one before (-1)."""
    return Window.partitionBy(*SPLIT).orderBy("k").rowsBetween(Window.unboundedPreceding, last)


def _earlier():
    """The window of a file's splits before one."""
    return Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def fragments(spark: SparkSession, paths: str | list[str], separator: str, name: str = "output.*", job: str = r"([^/]+)/[^/]*$") -> DataFrame:
    """job_id, file, start (of the split), k (from 1, in the split), value: files cut at a separator."""
    rows = spark.read.option("lineSep", separator).option("pathGlobFilter", name).option("recursiveFileLookup", "true").text(paths)
    rows = rows.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    path = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    placed = rows.withColumn("k", F.row_number().over(Window.partitionBy(*SPLIT).orderBy("at")))
    return placed.select(F.regexp_extract(path, job, 1).alias("job_id"), *SPLIT, "k", "value")


def read_lines(spark: SparkSession, paths: str | list[str], name: str = "output.*", job: str = r"([^/]+)/[^/]*$") -> DataFrame:
    """job_id, i (from 0), line; blank and broken lines keep their number, a carriage return at the end goes."""
    cut = stored(fragments(spark, paths, "\n", name, job))
    counts = cut.groupBy(*SPLIT).agg(F.count("*").alias("n"))
    carried = counts.withColumn("before", F.sum("n").over(_earlier())).where("before > 0").drop("n")
    line = F.call_function("make_valid_utf8", F.regexp_replace("value", r"\r$", ""))
    return met(cut, carried, SPLIT).select("job_id", (_zero(F.col("before")) + F.col("k") - 1).cast("int").alias("i"), line.alias("line"))


def _count(text: Column, chars: str) -> Column:
    """How many of some one-byte characters are in a text."""
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, f"[{chars}]", ""))


def read_records(spark: SparkSession, paths: str | list[str], name: str = "output.*", job: str = r"([^/]+)/[^/]*$") -> DataFrame:
    """job_id, i (from 0), v (a VARIANT): the elements of bodies that are JSON arrays; none of other bodies. A file is
    cut after each `}`. Whether one ends an element depends on the quotes and brackets before it: within a split both
    cases are counted, of beginning outside and inside of a text, until the splits before it decide. Memory is bounded
    by elements."""
    cut = fragments(spark, paths, "}", name, job)
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    cut = cut.withColumn("plain", plain).withColumn("quotes", _count(F.col("plain"), '"'))
    last = Window.partitionBy("file")
    cut = cut.withColumn("quotes_before", _zero(F.sum("quotes").over(_here(-1))))
    for inside in (0, 1):
        begins_in = (F.col("quotes_before") + inside) % 2 == 1
        outside = F.regexp_replace(F.concat(F.when(begins_in, '"').otherwise(""), "plain"), r'(?s)"[^"]*("|$)', "")
        closed = ((F.col("quotes_before") + F.col("quotes") + inside) % 2 == 0).cast("int")
        opened = _count(outside, r"\[{") - _count(outside, r"\]}") - closed
        cut = cut.withColumn(f"depth{inside}", F.sum(opened).over(_here(0))).withColumn(f"closed{inside}", closed)
    cut = stored(cut.drop("plain"))
    splits = cut.groupBy(*SPLIT).agg(F.sum("quotes").alias("q"), F.max_by("depth0", "k").alias("d0"), F.max_by("depth1", "k").alias("d1"), F.max("k").alias("most"))
    splits = splits.withColumn("inside", (_zero(F.sum("q").over(_earlier())) % 2).cast("int"))
    splits = splits.withColumn("before", _zero(F.sum(F.when(F.col("inside") == 1, F.col("d1")).otherwise(F.col("d0"))).over(_earlier())))
    splits = stored(splits.withColumn("ends_file", F.col("start") == F.max("start").over(last)))
    carried = splits.where("before <> 0 or inside <> 0").select(*SPLIT, "inside", "before")
    tails = splits.where("ends_file").select(*SPLIT, "most")  # a row a file, met by its last split alone
    met_ = met(cut, carried, SPLIT).join(tails, SPLIT, "left")
    at_end = _zero((F.col("k") == F.col("most")).cast("int")) == 1
    depth = F.when(F.col("inside") == 1, F.col("depth1")).otherwise(F.col("depth0")) + _zero(F.col("before"))
    closed = F.when(F.col("inside") == 1, F.col("closed1")).otherwise(F.col("closed0")) == 1
    done = met_.select("job_id", *SPLIT, "k", F.when(at_end, F.col("value")).otherwise(F.concat("value", F.lit("}"))).alias("value"), (closed & (depth == 1) & ~at_end).cast("int").alias("end"))
    done = stored(done.withColumn("group", _zero(F.sum("end").over(_here(-1)))))
    ends = done.groupBy(*SPLIT).agg(F.sum("end").alias("n")).withColumn("ended", F.sum("n").over(_earlier())).where("ended > 0").drop("n")
    grouped = met(done, ends, SPLIT).withColumn("group", F.col("group") + _zero(F.col("ended")))
    chunk = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "k", "value"))), lambda s: s["value"]), "")
    chunks = grouped.groupBy("job_id", "file", "group").agg(F.call_function("make_valid_utf8", chunk).alias("text"), F.max("end").alias("whole"))
    # a chunk is elements after a comma (the first: after the bracket), up to an object's end or the array's
    body = F.when(F.col("group") == 0, F.col("text")).when(F.col("text").rlike(r"^\s*\]\s*$"), "[]").otherwise(F.regexp_replace("text", r"^\s*,", "["))
    parsed = F.try_parse_json(F.when(F.col("whole") == 1, F.concat(body, F.lit("]"))).otherwise(body))
    items = F.when(F.schema_of_variant(parsed).startswith("ARRAY"), F.try_variant_get(parsed, "$", "array<variant>"))
    nothing = (F.col("group") > 0) & (F.size("items") == 0) & ~F.col("text").rlike(r"^\s*\]\s*$")  # a comma before the end
    listed = chunks.withColumn("items", items.cast("array<variant>")).withColumn("items", F.when(~nothing, F.col("items")))
    listed = stored(listed.select("job_id", "file", "group", "whole", "items"))
    whole = listed.groupBy("file").agg(F.bool_and(F.col("items").isNotNull()).alias("good"), F.min("whole").alias("tail")).where("good and tail = 0").select("file")
    counted = listed.select("file", "group", F.size("items").alias("n"))
    offset = _zero(F.sum("n").over(Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = counted.withColumn("offset", offset).join(whole, "file")
    each = listed.join(numbered.select("file", "group", "offset"), ["file", "group"]).select("job_id", "offset", F.posexplode("items").alias("p", "v"))
    return each.select("job_id", (F.col("offset") + F.col("p")).cast("int").alias("i"), "v")
