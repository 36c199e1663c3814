"""The raw archive: S1 reading, S5 trusted references, S6 previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREVIEW_BYTES = 262_144
_NAME = r"output\.[a-zA-Z0-9]+"


def read_archive(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """job_id, path, length, content of {root}/{job_id}/output.{format} below the paths, whatever the job's end was.
    Contents are only read where they are asked for: not for a listing, nor beyond a bound on `length`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "output.*").option("recursiveFileLookup", "true").load(paths)
    return files.select(F.regexp_extract("path", rf"([^/]+)/{_NAME}$", 1).alias("job_id"), "path", "length", "content").where("job_id <> ''")


def text_of(content: Column) -> Column:
    """UTF-8 with replacement of bad bytes."""
    return F.call_function("make_valid_utf8", content.cast("string"))


def trusted(observations: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """The observations, with raw_ref kept only if it names the job's own file in the archive and the file is
    there; else null."""
    root = root.rstrip("/")
    name = F.regexp_extract("raw_ref", rf"/({_NAME})$", 1)
    own = (name != "") & ~F.col("raw_ref").contains("..") & (F.col("raw_ref") == F.concat(F.lit(root + "/"), "job_id", F.lit("/"), name))
    there = listing.select(F.regexp_replace("path", "^file:/*", "/").alias("_there")).distinct()
    met = observations.withColumn("_own", F.when(own, F.col("raw_ref"))).join(there, F.col("_own") == F.col("_there"), "left")
    return met.withColumn("raw_ref", F.col("_there")).drop("_own", "_there")


def previews(archive: DataFrame) -> DataFrame:
    """job_id, preview (the first 256 KiB as text), truncated."""
    return archive.select("job_id", text_of(F.substring("content", 1, PREVIEW_BYTES)).alias("preview"), (F.length("content") > PREVIEW_BYTES).alias("truncated"))
