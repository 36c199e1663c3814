"""Exact top-k inner-product search by MaxScore (operator 8).

Vectors become integers, floor(scale * x). A dimension is a term; a shard of candidates holds each term's postings,
its values of all candidates, between two bounds. What a term adds to a query's score above its least is its gain.
Terms are sorted by their greatest gain. Those of small gain whose sum cannot lift a candidate to the query's present
k-th score are non-essential: the essential terms' postings are traversed for all candidates, and the others are
probed for a candidate only while its score so far and the gains still possible stay competitive. The k-th score
stands for a whole shard. Each shard gives its k best of each query; Spark merges the shards by rank.

Candidates are dealt to shards of about SHARD rows by a hash of id and vector, queries to every shard, both by one
shuffle; a task holds one shard and streams the queries past it. Neither passes through the driver or is broadcast.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part, as query or
candidate, nor do rows of a null id; vectors of different lengths are compared over the components that both
have; rows of equal id are candidates of their own, but none of a query with that id; ties go to the smaller id;
an empty table gives no rows. Equal rows are folded into one with a count before they are dealt, so many copies of
one row weigh on no shard. Components and scores beyond 64 bits are the nearest 64-bit integer; what may go beyond them
while it is added up is added up in integers of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches
from .hashing import mix

#: Candidates of one shard, about: a task's memory, and the number of times that each query is sent.
SHARD = 32_768
#: Least candidates of a shard where the cluster has tasks to spare.
LEAST = 4096
#: Candidates of a shard between two updates of a query's k-th score.
STEP = 2048
_ROWS = "shard long, kind int, id long, copies long, v array<long>"


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v array<long> of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(scale * c)).alias("v"))


def _matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of the lists, shorter ones ending in zeros."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy()
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """Floating point while all sums stay exact in it, else integers, of any length if need be."""
    most = _greatest(a) * _greatest(b) * a.shape[1]
    return np.float64 if most < 2**52 else np.int64 if most < 2**60 else object


def _greatest(a: np.ndarray) -> float:
    """The greatest absolute value; the least 64-bit integer has none of 64 bits."""
    return max(float(a.max(initial=0)), -float(a.min(initial=0)))


def _clipped(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, -(2**63), 2**63 - 1) if scores.dtype == object and len(scores) else scores


class Shard:
    """The postings of some candidates: term by term, the value of each."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, matrix: np.ndarray):
        self.ids, self.copies, self.matrix = ids, copies, matrix
        self.postings: dict[type, tuple] = {}

    def of(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(postings, each term's least value, its greatest) in floating point or integers."""
        if kind not in self.postings:
            p = np.ascontiguousarray(self.matrix.T.astype(kind))
            self.postings[kind] = p, p.min(axis=1, initial=0), p.max(axis=1, initial=0)
        return self.postings[kind]

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates of one query."""
        width = self.matrix.shape[1]
        query = query[:width] if len(query) >= width else np.concatenate((query, np.zeros(width - len(query), np.int64)))
        kind = _exact(self.matrix, query[None, :])
        postings, low, high = self.of(kind)
        query = query.astype(kind)
        ends = np.stack((query * low, query * high))
        least, gain = ends.min(axis=0), ends.max(axis=0) - ends.min(axis=0)
        order = np.argsort(-gain, kind="stable")
        # what the terms from a place on can still add, at most and beyond their least
        rest = np.concatenate((np.cumsum((least + gain)[order][::-1])[::-1], [0]))
        over = np.concatenate((np.cumsum(gain[order][::-1])[::-1], [0]))
        best_ids, best, bar = np.zeros(0, np.int64), np.zeros(0, kind), None
        for start in range(0, len(self.ids), STEP):
            part = slice(start, start + STEP)
            keep = np.flatnonzero(self.ids[part] != query_id)
            # essential: all terms before the first place from which the gains alone are not enough
            essential = len(order) if bar is None else max(1, int(np.flatnonzero(over < bar - least.sum())[0])) if over[-1] < bar - least.sum() else len(order)
            block = postings[:, part]
            total = (query[order[:essential]] @ block[order[:essential]])[keep]
            at = essential
            while at < len(order) and len(keep):  # probe the others while competitive
                still = total + rest[at] >= bar
                keep, total = keep[still], total[still]
                upto = min(len(order), at + max(4, len(order) // 8))
                total = total + query[order[at:upto]] @ block[np.ix_(order[at:upto], keep)]
                at = upto
            if bar is not None:
                still = total >= bar
                keep, total = keep[still], total[still]
            total = _clipped(total)
            times = np.minimum(self.copies[part][keep], k)
            best_ids, best = np.concatenate((best_ids, np.repeat(self.ids[part][keep], times))), np.concatenate((best, np.repeat(total, times)))
            top = np.lexsort((best_ids, -best))[:k] if kind is not object else sorted(range(len(best)), key=lambda i: (-best[i], best_ids[i]))[:k]  # noqa: B023
            best_ids, best = best_ids[top], best[top]
            if len(best) == k:
                bar = best[-1]
        return best_ids, best


def _dealt(candidates: DataFrame, shards: int) -> DataFrame:
    """The candidates with their shard, equal ones of a batch as one row with their number."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            matrix = _matrix(lists)
            key = mix(ids.astype(np.uint64))
            for j in range(matrix.shape[1]):
                key = mix(key + matrix[:, j].astype(np.uint64))
            both = np.column_stack((ids, matrix))
            order = np.lexsort((ids, key))
            new = np.ones(len(order), bool)
            new[1:] = (both[order][1:] != both[order][:-1]).any(axis=1)
            first = np.flatnonzero(new)
            chosen, copies = order[first], np.diff(first, append=len(order))
            shard = (key[chosen] % np.uint64(shards)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.zeros(len(chosen), np.int32)), pa.array(ids[chosen]), pa.array(copies), lists.take(pa.array(chosen))], ["shard", "kind", "id", "copies", "v"])

    return candidates.mapInArrow(run, _ROWS)


def _found(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    of = np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([s for _, _, s in found]).astype(np.int64))], ["query_id", "vec_id", "score"])


def _search(batches, k: int):
    """Over rows sorted by shard, its candidates before the queries: each query's k best of the shard."""
    now, parts, index = None, [], None
    for batch in batches:
        shard, kind, ids, copies = (batch.column(i).to_numpy() for i in range(4))
        edges = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)], strict=True):
            if shard[a] != now:
                now, parts, index = shard[a], [], None
            matrix = _matrix(batch.column(4).slice(a, b - a))
            if kind[a] == 0:
                parts.append((ids[a:b], copies[a:b], matrix))
                continue
            if index is None and parts:
                width = max(m.shape[1] for _, _, m in parts)
                index = Shard(np.concatenate([i for i, _, _ in parts]), np.concatenate([c for _, c, _ in parts]), np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, _, m in parts]))
            if index is not None:
                yield _found([(int(q), *index.search(int(q), v, k)) for q, v in zip(ids[a:b], matrix, strict=True)])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of `vectors` other than its own."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    n = vectors.count()
    shards = max(1, -(-n // shard), min(spark.sparkContext.defaultParallelism, n // LEAST))
    asked = quantized(queries, id_col, vector_col, scale).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), "id", F.lit(1).cast("long").alias("copies"), "v")
    rows = _dealt(quantized(vectors, id_col, vector_col, scale), shards).unionByName(asked)
    every = rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "id").mapInArrow(lambda batches: _search(batches, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
