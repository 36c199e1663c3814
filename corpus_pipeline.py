"""A training-data pipeline over `documents`, of five stages that each apply one operator.

A stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with their columns; the last one gives
their token ids. `run` writes each stage's documents as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, lines, near, toxicity
from tidemark.llm.common import read, scratch, stored
from tidemark.llm.queries import bpe_digest


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; learned from the labels outside the held-out fold."""
    model = toxicity.fit(toxicity.learnable(docs), toxicity.learnable(read(spark, sf_dir, "labels")))
    return toxicity.without_toxic(docs, model)


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of 50 words or more."""
    return lines.without_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return near.one_of_each(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontaminate.without_hits(docs, decontaminate.blocks(read(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and the digests of ids and decoded bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_digest(bpe.round_trip(docs, path, public_tokenizers.PATTERN), F.col("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_copied_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), outlives=True)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the learned stage nor the near-duplicate groups' exact threshold at a fair cost.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
