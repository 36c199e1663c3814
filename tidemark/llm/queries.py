"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language, licenses, lines, lm, near, repair, token_counts, topk, toxicity, trie, urls
from .common import fold, read, stored


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored(decontaminate.index(read(spark, sf_dir, "documents")))
    return decontaminate.digest(decontaminate.search(index, decontaminate.blocks(read(spark, sf_dir, "benchmark"))))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_digest(bpe.round_trip(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def bpe_digest(decoded: DataFrame, *more) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.where(fold("doc_id", 5) != 0))
    found = language.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_all(read(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
    return scored.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.learnable(docs), toxicity.learnable(labels))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=90)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = repair.damage(read(spark, sf_dir, "conversations"))
    return repair.digests(damaged, repair.audits(damaged))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = licenses.scan(read(spark, sf_dir, "documents"))
    return found.drop("digest")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(read(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_decontaminate,
        op3_token_counts,
        op4_byte_bpe,
        op5_line_dedup,
        op6_language,
        op7_lm_score,
        op8_top_k,
        op9_toxicity,
        op10_jaccard_join,
        op11_conversation_repair,
        op12_license_scan,
        op13_prefix_trie,
    )
}

#: DuckDB SQL of those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op2_decontaminate": decontaminate.SQL, "op8_top_k": topk.SQL, "op10_jaccard_join": near.SQL, "op11_conversation_repair": repair.SQL, "op12_license_scan": licenses.SQL, "op13_prefix_trie": trie.SQL}
