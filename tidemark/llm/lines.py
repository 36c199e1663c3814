"""Line dedup by a suffix array over line-ID sequences (operator 5).

A document is the sequence of its non-blank lines. Lines that occur once, as told by 128 bits of hash, break the
sequences; every other line gets a number, its ID, and what is left are segments of repeated lines. Equal segments are
one: only the first copy goes on, and its later copies are repeated as a whole. Over the distinct segments a suffix
array is built by prefix doubling: a suffix's rank by its first 2^k lines comes from the ranks of its two halves, the
distinct pairs of which are sorted over range partitions. Along the array, stretches of neighbours whose longest
common prefix is at least n lines are the LCP intervals of depth n; a suffix that is not at the earliest place
(document, then line) of its interval repeats n lines. A run of `min_words` words or more is deleted wherever it is
not the first copy, with blank lines inside it.

The array lies in ranges of bounded size, however many suffixes begin alike. Intervals reach across ranges: a first
pass gives for each range, at its either end, the earliest place by depth; the driver folds these few numbers a range
into what each range must know of its neighbours, and a second pass finds the runs.

A run of min_words lines has that many words, so suffixes need comparing over so many lines only: longer runs are
the union of such ones. That bounds the rounds and what a suffix carries.

Defined results: null and empty texts stay; documents are ordered by id (a null id last), then by a hash of the
text; equal rows of one id are one document and change alike; an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hot_keys, join_hot, scratch, split_by_ids, stored, tidy

MIN_WORDS = 50
#: Suffixes in a range of the array, about: a task's memory.
RANGE = 100_000
#: Inner columns begin with this.
_X = "__tidemark_"


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, twin, n, pos, h1, h2, words: each non-blank line by its number among them and among all lines."""
    text = F.col(text_col).cast("string")
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    some = F.filter(every, lambda s: s["line"].rlike(r"\S"))
    rows = docs.where(text.isNotNull()).select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(text).alias("twin"), F.posexplode(some).alias("n", "s"))
    # a constant before the line is a seed of its own
    return rows.select("doc", "twin", "n", F.col("s.pos").alias("pos"), F.xxhash64("s.line").alias("h1"), F.xxhash64(F.lit(1), "s.line").alias("h2"), F.regexp_count("s.line", F.lit(r"\S+")).alias("words"))


def segment_table(lines: DataFrame) -> DataFrame:
    """doc, twin, first, pos, lines, words: maximal stretches of lines that occur more than once, as arrays of IDs."""
    if not lines.where("n = 0").groupBy("doc", "twin").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        lines = stored(lines.distinct())  # equal rows of one id are one document
    names = stored(lines.groupBy("h1", "h2").agg(F.count("*").alias("n_lines")).where("n_lines > 1").withColumn("line", F.monotonically_increasing_id()))
    hot = hot_keys(names, ["h1", "h2"], "n_lines")
    kept = join_hot(lines, names.drop("n_lines"), ["h1", "h2"], hot).groupBy("doc", "twin").agg(F.array_sort(F.collect_list(F.struct("n", "pos", "line", "words"))).alias("all"))
    # a stretch goes on while the line numbers do
    breaks = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: (i == 0) | (F.element_at("all", i + 1)["n"] != F.element_at("all", F.greatest(i, F.lit(1)))["n"] + 1))
    each = kept.select("doc", "twin", "all", breaks.alias("breaks")).select("doc", "twin", "all", "breaks", F.posexplode("breaks").alias("k", "start"))
    end = F.when(F.col("k") + 1 < F.size("breaks"), F.element_at("breaks", F.least(F.col("k") + 2, F.size("breaks")))).otherwise(F.size("all"))
    part = each.select("doc", "twin", F.slice("all", F.col("start") + 1, end - F.col("start")).alias("part"))
    field = lambda name: F.transform("part", lambda s: s[name])
    return part.select("doc", "twin", F.col("part")[0]["n"].alias("first"), field("pos").alias("pos"), field("line").alias("lines"), field("words").alias("words"))


def _place(*more: Column | str) -> Column:
    return F.struct("doc", "twin", *more)


def suffix_ranks(suffixes: DataFrame, depth: int) -> DataFrame:
    """Adds `rank`, the order of each suffix by its first `depth` lines."""
    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def named(pairs: DataFrame) -> DataFrame:
        """The distinct (a, b) with a number in their order; range partitions follow each other."""
        ordered = pairs.distinct().repartitionByRange(parts, "a", "b").sortWithinPartitions("a", "b")
        return stored(ordered.withColumn("rank", F.monotonically_increasing_id()))

    now, length, known = suffixes.select("seg", "i", F.col("line").alias("rank")), 1, -1
    while length < depth:
        after = now.select("seg", (F.col("i") - length).alias("i"), F.col("rank").alias("b"))
        both = now.withColumnRenamed("rank", "a").join(after, ["seg", "i"], "left").select("seg", "i", "a", F.coalesce("b", F.lit(-(2**63))).alias("b"))
        names = named(both.select("a", "b"))
        now = stored(both.join(names, ["a", "b"]).select("seg", "i", "rank"))
        length, count = 2 * length, names.count()
        tidy(suffixes.sparkSession)
        if count == known:  # no class split: none will
            break
        known = count
    return suffixes.join(now, ["seg", "i"])


# -- LCP intervals over ranges of the suffix array -----------------------------------------------------------------


class Range:
    """One range of the suffix array: neighbours' longest common prefixes, and each suffix's place."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        column = lambda name: table.column(name).combine_chunks()
        self.places = np.stack([column(c).to_numpy().astype(np.int64) for c in ("doc", "twin", "at")], axis=1)
        self.seg, self.i, tails = column("seg").to_numpy(), column("i").to_numpy(), column("tail")
        self.size = np.diff(tails.offsets.to_numpy())
        lines, depth = tails.flatten().to_numpy(), int(self.size.max())
        start = np.cumsum(self.size) - self.size
        self.first, self.last = lines[: self.size[0]], lines[start[-1] :]
        # the first line in which neighbours differ, within the shorter of them
        shorter = np.minimum(self.size[1:], self.size[:-1])
        self.lcp, open_ = np.zeros(len(shorter), np.int64), np.arange(len(shorter))
        for n in range(depth):
            open_ = open_[(shorter[open_] > n)]
            open_ = open_[lines[start[open_] + n] == lines[start[open_ + 1] + n]]
            if not len(open_):
                break
            self.lcp[open_] = n + 1

    def ranks(self, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks of the range's places, ranks of other places) in one order."""
        every = np.concatenate((self.places, more))
        order = np.lexsort((every[:, 2], every[:, 1], every[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (every[order][1:] != every[order][:-1]).any(axis=1)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank[: len(self.places)], rank[len(self.places) :]

    def ends(self) -> dict:
        """The range's summary: the first and last suffix, the least common prefix of all, and at either end the
        earliest place of the suffixes that share 1, 2, ... lines with the one there."""
        rank, _ = self.ranks(np.zeros((0, 3), np.int64))

        def earliest(size: int, lcp: np.ndarray, rank: np.ndarray, places: np.ndarray) -> list:
            shared = np.concatenate(([size], np.minimum.accumulate(np.minimum(lcp, size))))
            best = places[np.minimum.accumulate(rank * len(rank) + np.arange(len(rank))) % len(rank)]
            return [best[np.searchsorted(-shared, -n, side="right") - 1].tolist() for n in range(1, size + 1)]

        left = earliest(int(self.size[0]), self.lcp, rank, self.places)
        right = earliest(int(self.size[-1]), self.lcp[::-1], rank[::-1], self.places[::-1])
        return {"first": self.first.tolist(), "last": self.last.tolist(), "whole": int(self.lcp.min(initial=min(self.size[0], self.size[-1]))), "left": left, "right": right}

    def runs(self, left: list, right: list) -> np.ndarray:
        """For each suffix the longest run of lines that one at an earlier place begins with; left and right: the
        earliest places beyond the range that share 1, 2, ... lines with its first and its last suffix."""
        rank, more = self.ranks(np.array([*left, *right], np.int64).reshape(-1, 3))
        before, after = more[: len(left)], more[len(left) :]
        run = np.zeros(len(rank), np.int64)
        for n in range(1, int(max(self.lcp.max(initial=0), len(left), len(right))) + 1):
            new = np.concatenate(([True], self.lcp < n))
            least = np.minimum.reduceat(rank, np.flatnonzero(new))
            if n <= len(left):
                least[0] = min(least[0], before[n - 1])
            if n <= len(right):
                least[-1] = min(least[-1], after[n - 1])
            run[rank > least[np.cumsum(new) - 1]] = n
        return run


def _summaries(batches):
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([json.dumps(Range(held).ends())])], ["range", "ends"])


def carried(ends: list[dict]) -> list[tuple[list, list]]:
    """For each range, in their order, the earliest places to its left and right by lines shared with its end."""

    def common(a: list, b: list) -> int:
        return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905

    def fold(ranges: list[dict], near: str, far: str, earliest: str) -> list[list]:
        out, known, last = [], [], []
        for r in ranges:
            met = known[: common(last, r[near])]
            out.append(met)
            known, last = [min(p, met[n]) if n < min(len(met), r["whole"]) else p for n, p in enumerate(r[earliest])], r[far]
        return out

    return list(zip(fold(ends, "first", "last", "right"), fold(ends[::-1], "last", "first", "left")[::-1], strict=True))


def longest_earlier(tails: DataFrame) -> DataFrame:
    """seg, i, run > 0: the longest run of lines that also begins at an earlier place."""
    spark = tails.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tails.count() // RANGE))
    by = ["rank", "doc", "twin", "at"]
    ranges = checkpointed(tails.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("doc", "twin", "at", "seg", "i", "tail"))
    # a few numbers a range, by one job: a local iterator runs one for each range, and the driver keeps what it knows of each
    summed = ranges.mapInArrow(_summaries, "range long, ends string").toArrow()
    found = sorted(zip(summed["range"].to_pylist(), summed["ends"].to_pylist(), strict=True))
    shipped = spark.sparkContext.broadcast(dict(zip([n for n, _ in found], carried([json.loads(e) for _, e in found]), strict=True)))

    def run(batches):
        from pyspark import TaskContext

        if held := [b for b in batches if b.num_rows]:
            own = Range(held)
            n = own.runs(*shipped.value[TaskContext.get().partitionId()])
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(own.seg[at]), pa.array(own.i[at]), pa.array(n[at].astype(np.int32))], ["seg", "i", "run"])

    return ranges.mapInArrow(run, "seg long, i int, run int")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, twin, spans array<struct<first, last>>: the lines (numbers among all) to delete, of documents that have any."""
    segments = segment_table(stored(line_table(docs, id_col, text_col)))
    segments = stored(segments.withColumn("seg", F.xxhash64(F.lit(1), "lines")).withColumn("check", F.xxhash64(F.lit(2), "lines")))
    first = stored(segments.groupBy("seg", "check").agg(F.min(_place("first")).alias("home"), F.count("*").alias("n_equal")))
    homed = join_hot(segments, first.drop("n_equal"), ["seg", "check"], hot_keys(first, ["seg", "check"], "n_equal"))
    is_home = (F.col("doc") == F.col("home.doc")) & (F.col("twin") == F.col("home.twin")) & (F.col("first") == F.col("home.first"))
    total = F.aggregate("words", F.lit(0), lambda a, b: a + b)
    copies = homed.where(~is_home & (total >= min_words)).select("doc", "twin", F.struct(F.col("pos")[0].alias("first"), F.element_at("pos", -1).alias("last")).alias("span"))
    homes = stored(homed.where(is_home).select("seg", "doc", "twin", "first", "pos", "lines", "words"))
    each = homes.select("seg", "doc", "twin", "first", F.posexplode("lines").alias("i", "line"))
    # suffixes whose first line no other suffix has share nothing, and end what is compared with them
    several = stored(each.groupBy("line").agg(F.count("*").alias("n_suffixes")).where("n_suffixes > 1"))
    shared = stored(join_hot(each, several.select("line"), ["line"], hot_keys(several, ["line"], "n_suffixes")).select("seg", "i", "line", "doc", "twin", (F.col("first") + F.col("i")).alias("at")))
    ranked = suffix_ranks(shared.select("seg", "i", "line"), min_words).drop("line")
    tails = stored(shared.drop("line").join(ranked, ["seg", "i"]).join(homes.select("seg", "lines"), "seg").select("rank", "doc", "twin", "at", "seg", "i", F.slice("lines", F.col("i") + 1, min_words).alias("tail")))
    inside = longest_earlier(tails).join(homes, "seg").withColumn("enough", F.aggregate(F.slice("words", F.col("i") + 1, F.col("run")), F.lit(0), lambda a, b: a + b) >= min_words).where("enough")
    later = inside.select("doc", "twin", F.struct(F.element_at("pos", F.col("i") + 1).alias("first"), F.element_at("pos", F.col("i") + F.col("run")).alias("last")).alias("span"))
    return later.union(copies).groupBy("doc", "twin").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def rewritten(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all columns, later copies deleted from the text, and __tidemark_lines (the lines it had)
    and __tidemark_removed (the lines that went)."""
    with scratch(docs.sparkSession):
        spans = stored(repeated_spans(docs, min_words, id_col, text_col), outlives=True)
    spans = spans.withColumnsRenamed({"doc": f"{_X}doc", "twin": f"{_X}twin", "spans": f"{_X}spans"})
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    lines = F.split(F.col(text_col).cast("string"), "\n")
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(f"{_X}lines")
    # only documents that may have spans are shuffled to them
    some, rest = split_by_ids(docs, key, spans.select(F.col(f"{_X}doc").alias("id")))
    met = some.join(spans, (key == F.col(f"{_X}doc")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(f"{_X}twin")), "left")
    gone = lambda i: F.exists(f"{_X}spans", lambda s: (s["first"] <= i) & (i <= s["last"]))
    kept = F.filter(lines, lambda line, i: ~gone(i))
    new = F.when(F.col(f"{_X}spans").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col(f"{_X}spans").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long").alias(f"{_X}removed")
    changed = met.select(*[new.alias(c) if c == text_col else F.col(c) for c in docs.columns], n_lines, removed)
    return changed.unionByName(rest.select("*", n_lines, F.lit(0).cast("long").alias(f"{_X}removed")))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `n_lines` the text had, `n_removed` of them that went, and the `text` that is left."""
    found = rewritten(docs, min_words, id_col, text_col)
    return found.select(F.col(id_col).alias("doc_id"), F.col(f"{_X}lines").alias("n_lines"), F.col(f"{_X}removed").alias("n_removed"), F.col(text_col).alias("text"))


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, same columns, with later copies of line runs deleted. A document of which nothing but blank
    is left goes; n_chars, if there, follows the text."""
    found = rewritten(docs, min_words, id_col, text_col)
    cut = F.col(f"{_X}removed") > 0
    left = found.where(~cut | F.col(text_col).rlike(r"\S"))
    size = lambda c: F.when(cut, F.length(text_col)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
    return left.select(*[size(c) if c == "n_chars" else F.col(c) for c in docs.columns])
