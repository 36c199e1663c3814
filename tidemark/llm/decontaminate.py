"""Benchmark decontamination over a distributed positional inverted index (operator 2).

The index is a DataFrame with one row per shard of documents: the shard's terms, and for each term the sorted
list of its positions in the shard (postings), beside each document's first position. It is stored once and searched
as often as wanted. A document lies whole in one shard, so a search needs no shuffle of postings: every shard
intersects the offset-adjusted lists of a phrase, from the term that is rarest in the whole index to the commonest.

Phrases come from a table of test items: tasks make blocks of bounded size of them, a few blocks at a time are
broadcast and searched in one pass over the stored index, and a document's hits from all passes are united. So no
number of items is too large. A hit is given as word spans. Proximity search takes the items as whole phrases: from
each occurrence of an item's rarest word it looks for the nearest place that holds all its words in order.

Defined results: null texts have no words; items without words give no phrase; an item without id hits, but is none
of the item_ids; rows keep their number and repeat if repeated in the input; empty tables on either side give no
hits; only id and text are read.
"""

from __future__ import annotations

import pickle
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Shipped
from .common import CHARS_AT_ONCE, LARGE_BLOCK, id_text, split_by_ids, stored, text_blocks

#: Words of one phrase; an item with fewer words is one phrase.
WINDOW = 10
#: Bytes of item text of one block.
BLOCK_BYTES = 4_000_000
#: Blocks that one pass over the index broadcasts: what a worker holds of phrases.
PASS_BLOCKS = 4

#: Bytes outside words: ASCII other than letters and digits. A-Z become a-z.
_WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))

INDEX = "shard long, doc_ids array<long>, starts binary, terms binary, ends binary, positions binary"
HITS = "shard long, row int, doc_id long, n_words long, spans array<struct<start:int,end:int>>, item_ids array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of ASCII letters, digits and all other characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).lower().split() if text else []


def _index_of(texts: list[str | None]):
    """(each text's first position, the number of each term, all positions term by term, where each term's end)."""
    words = [words_of(t) for t in texts]
    starts = np.zeros(len(words) + 1, np.int32)
    np.cumsum([len(w) for w in words], out=starts[1:])
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(words)), np.int32, starts[-1])
    order = np.argsort(ids, kind="stable").astype("<i4")
    return starts, number, order, np.cumsum(np.bincount(ids, minlength=len(number))).astype(np.int32)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional inverted index of whole texts, one row per shard; numbers are little-endian int32."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 40
        for shard, (block, texts) in enumerate(text_blocks(batches, "text", LARGE_BLOCK)):
            ids, (starts, number, order, ends) = block.column(0), _index_of(texts)
            packed = [pa.array([x], pa.binary()) for x in (starts.astype("<i4").tobytes(), b" ".join(number), ends.astype("<i4").tobytes(), order.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([task + shard]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), *packed], ["shard", "doc_ids", "starts", "terms", "ends", "positions"])

    return id_text(docs, id_col, text_col).mapInArrow(run, INDEX)


class Phrases:
    """A block of phrases: each distinct window of words (the whole item, if window is None), and the items that it
    comes from; `counts` has how often each of its terms occurs in the index that is searched."""

    counts: np.ndarray

    def __init__(self, items: list[tuple[object, str | None]], window: int | None):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = words_of(text)
            size = window or len(words)
            for i in range(max(1, len(words) - size + 1)) if words else ():
                found.setdefault(tuple(words[i : i + size]), set()).update([] if item is None else [str(item)])
        by_length: dict[int, list] = {}
        for words, owners in found.items():
            by_length.setdefault(len(words), []).append((words, sorted(owners)))
        self.groups = [([w for w, _ in g], [o for _, o in g]) for g in by_length.values()]
        self.terms = list({w for words, _ in self.groups for ws in words for w in ws})
        at = {w: i for i, w in enumerate(self.terms)}
        self.groups = [(np.array([[at[w] for w in ws] for ws in words], np.int64), owners) for words, owners in self.groups]


def _search_shard(starts: np.ndarray, terms: list[bytes], ends: np.ndarray, positions: np.ndarray, phrases: Phrases, counts: np.ndarray | None = None):
    """(document index, first position, phrase length, item lists) of each phrase that occurs in the shard. counts: of
    the block's terms in the whole index; without them, in the shard."""
    number = {t: i for i, t in enumerate(terms)}
    total = int(starts[-1])
    local = np.array([number.get(t, -1) for t in phrases.terms], np.int64)
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    # one sorted list of all postings, keyed by (term, position): a membership probe is a binary search
    keys = np.repeat(np.arange(len(terms)), ends - begins) * (total + 1) + positions
    out = []
    for windows, owners in phrases.groups:
        ids = local[windows]
        there = np.flatnonzero((ids >= 0).all(axis=1))
        if not len(there):
            continue
        ids, length = ids[there], windows.shape[1]
        size = ends[ids] - begins[ids]
        rarity = np.argsort(size if counts is None else counts[windows[there]], axis=1, kind="stable")
        row = np.arange(len(ids))
        # candidates: the rarest term's list, moved back by the term's place in the phrase
        first = ids[row, rarity[:, 0]]
        count = size[row, rarity[:, 0]].astype(np.int64)
        phrase = np.repeat(row, count)
        inner = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
        start = positions[begins[first][phrase] + inner].astype(np.int64) - rarity[phrase, 0]
        ok = start >= 0
        phrase, start = phrase[ok], start[ok]
        for k in range(1, length):
            if not len(phrase):
                break
            term = ids[phrase, rarity[phrase, k]]
            want = term * (total + 1) + start + rarity[phrase, k]
            at = np.searchsorted(keys, want)
            ok = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == want)
            phrase, start = phrase[ok], start[ok]
        document = np.searchsorted(starts, start, side="right") - 1
        ok = start + length <= starts[np.minimum(document + 1, len(starts) - 1)]  # not across two documents
        out.append((document[ok], start[ok], np.full(ok.sum(), length), there[phrase[ok]], owners))
    return out


def _united(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Sorted, merged [start, end) spans."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[new].tolist(), end[np.concatenate((new[1:] - 1, [len(start) - 1]))].tolist(), strict=True))


def _rows(shard: int, ids, starts: np.ndarray, found) -> pa.RecordBatch:
    spans: list = [[] for _ in range(len(ids))]
    items: list = [[] for _ in range(len(ids))]
    by_document: dict[int, list] = {}
    for document, start, length, phrase, owners in found:
        for d, s, n, p in zip(document.tolist(), start.tolist(), length.tolist(), phrase.tolist(), strict=True):
            by_document.setdefault(d, []).append((s - int(starts[d]), n, owners[p]))
    for d, hits in by_document.items():
        at = np.array([(s, s + n) for s, n, _ in hits])
        spans[d] = [{"start": a, "end": b} for a, b in _united(at[:, 0], at[:, 1])]
        items[d] = sorted(set(chain.from_iterable(o for _, _, o in hits)))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    columns = [pa.array(np.full(len(ids), shard)), pa.array(np.arange(len(ids), dtype=np.int32)), ids, pa.array(np.diff(starts).astype(np.int64)), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["shard", "row", "doc_id", "n_words", "spans", "item_ids"])


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int | None = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block (a pickled `Phrases`) of some items each: made in tasks, of bounded size; a very long item is one alone."""

    def run(batches):
        held, size = [], 0
        for block, texts in text_blocks(batches, text_col, min(block_bytes, CHARS_AT_ONCE)):
            held += zip(block.column(0).to_pylist(), texts, strict=True)
            size += sum(len(t or "") for t in texts)
            if size >= block_bytes:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Phrases(held, window))], pa.binary())], ["block"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Phrases(held, window))], pa.binary())], ["block"])

    return items.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, "block binary")


def passes(blocks: DataFrame, most: int = PASS_BLOCKS):
    """Lists of at most `most` broadcast blocks, one list after the other; only one is held."""
    sc, held = blocks.sparkSession.sparkContext, []
    for row in blocks.toLocalIterator():
        held.append(Shipped(sc.broadcast(pickle.loads(bytes(row[0])))))
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


def _shard(row: dict):
    numbers = lambda name: np.frombuffer(row[name], "<i4")
    return numbers("starts"), row["terms"].split(b" ") if row["terms"] else [], numbers("ends"), numbers("positions")


def term_counts(indexed: DataFrame, phrases: list[Shipped]) -> list[np.ndarray]:
    """How often each term of each block occurs in the whole index, from its terms alone."""

    def run(batches):
        at = [{t: i for i, t in enumerate(block.value.terms)} for block in phrases]
        total = [np.zeros(len(a), np.int64) for a in at]
        for batch in batches:
            for terms, ends in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                terms, n = terms.split(b" ") if terms else [], np.diff(np.frombuffer(ends, "<i4"), prepend=0)
                for own, sums in zip(at, total, strict=True):
                    met = [(own[t], i) for i, t in enumerate(terms) if t in own]
                    if met:
                        here = np.array(met)
                        sums[here[:, 0]] += n[here[:, 1]]
        for b, sums in enumerate(total):
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), b)), pa.array(used), pa.array(sums[used])], ["block", "term", "n"])

    out = [np.zeros(len(block.value.terms), np.int64) for block in phrases]
    # a row for each term of the blocks at most, by one job: a local iterator runs one for each shuffle partition
    summed = indexed.select("terms", "ends").mapInArrow(run, "block long, term long, n long").groupBy("block", "term").agg(F.sum("n").alias("n")).toArrow()
    block, term, n = (summed[c].to_numpy() for c in ("block", "term", "n"))
    for b, counts in enumerate(out):
        counts[term[block == b]] = n[block == b]
    return out


def _search_pass(indexed: DataFrame, phrases: list[Shipped]) -> DataFrame:
    counts = Shipped(indexed.sparkSession.sparkContext.broadcast(term_counts(indexed, phrases)))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = _shard(row)
                found = [x for block, n in zip(phrases, counts.value, strict=True) for x in _search_shard(*shard, block.value, n)]
                yield _rows(row["shard"], pa.array(row["doc_ids"], pa.int64()), shard[0], found)

    return indexed.mapInArrow(run, HITS)


def _joined_spans(spans: Column) -> Column:
    """Sorted spans with those that touch made one."""
    first = lambda s: s.cast("array<struct<start:int,end:int>>")

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (x["start"] <= F.get(done, F.size(done) - 1)["end"]), grown).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), first(F.array()), add)


def search(indexed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per document of a stored index: its number of words, the spans that phrases hit, and the phrases' items."""
    found = [_search_pass(indexed, phrases) for phrases in passes(blocks)] or [_search_pass(indexed, [])]
    if len(found) == 1:
        return found[0]
    every = reduce(DataFrame.unionByName, [stored(f) if n else f for n, f in enumerate(found)])
    one = every.groupBy("shard", "row", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return one.withColumn("spans", _joined_spans(F.col("spans")))


def without_hits(docs: DataFrame, blocks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, in which no phrase occurs. Their index is stored and searched like any other, so that
    rarity is that of the whole index and every pass of blocks reads the index alone. In it a document goes by a hash of
    its id and text, which any later reading of the row finds again; only rows whose hash may be a hit's meet the hits
    in a join. (That a clean document has a hit's hash by chance: one in 2^64 for each pair of them.)"""
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    indexed = stored(index(docs.select(key.alias("key"), F.col(text_col)), "key", text_col))
    hits = stored(search(indexed, blocks).where(F.size("spans") > 0).select(F.col("doc_id").alias("id")).distinct())
    maybe, clean = split_by_ids(docs, key, hits)
    return clean.unionByName(maybe.join(hits, key == F.col("id"), "left_anti"))


def search_near(indexed: DataFrame, items: DataFrame, slop: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, doc_id, start, end: for each occurrence of an item's rarest word (the first of equally rare ones) the
    narrowest place around it that holds all words of the item in order, if that has at most `slop` further words."""

    def one_pass(phrases: list[Shipped]) -> DataFrame:
        counts = Shipped(indexed.sparkSession.sparkContext.broadcast(term_counts(indexed, phrases)))

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    starts, terms, ends, positions = _shard(row)
                    number, begins = {t: i for i, t in enumerate(terms)}, np.concatenate(([0], ends[:-1]))
                    ids = np.array(row["doc_ids"], object)
                    for block, n in zip(phrases, counts.value, strict=True):
                        local = np.array([number.get(t, -1) for t in block.value.terms], np.int64)
                        for windows, owners in block.value.groups:
                            for p in np.flatnonzero((local[windows] >= 0).all(axis=1)).tolist():
                                lists = [positions[begins[t] : ends[t]].astype(np.int64) for t in local[windows[p]]]
                                first, last = _nearest(lists, int(np.argmin(n[windows[p]])))
                                document = np.searchsorted(starts, first, side="right") - 1
                                ok = (last - first < len(lists) + slop) & (last < starts[np.minimum(document + 1, len(starts) - 1)])
                                base, of = starts[document[ok]], ids[document[ok]].tolist()
                                for owner in owners[p] if ok.any() else ():
                                    yield pa.RecordBatch.from_arrays([pa.array([owner] * len(of)), pa.array(of, pa.int64()), pa.array(first[ok] - base, pa.int64()), pa.array(last[ok] + 1 - base, pa.int64())], ["item_id", "doc_id", "start", "end"])

        return indexed.mapInArrow(run, "item_id string, doc_id long, start long, end long")

    found = [one_pass(phrases) for phrases in passes(blocks(items, id_col, text_col, None))] or [one_pass([])]
    return reduce(DataFrame.unionByName, found)


def _nearest(lists: list[np.ndarray], anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) position of the narrowest place around each position of the anchor's list with one position of
    every list in order."""
    first = last = lists[anchor]
    for before in lists[:anchor][::-1]:
        at = np.searchsorted(before, first) - 1
        ok = at >= 0
        first, last = before[at[ok]], last[ok]
    for after in lists[anchor + 1 :]:
        at = np.searchsorted(after, last, side="right")
        ok = at < len(after)
        first, last = first[ok], after[at[ok]]
    return first, last


def digest(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, list_slice(w, k, least(k + 9, len(w))) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(win) AS n FROM p),
s AS (SELECT rid, k, n, list_slice(w, k, k + n - 1) AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, n WHERE len(w) >= n)),
h AS (SELECT rid, k, n, item_id FROM s JOIN p USING (win)),
c AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS place FROM (SELECT DISTINCT rid, k, n FROM h)) GROUP BY rid),
o AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN o USING (rid)
"""
