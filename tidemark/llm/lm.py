"""Language-model scoring by a hashed maximum-entropy model (operator 7).

Tokens are words and an end. Statistics come from the whole learning part: Spark counts every token, and the
additive unigram base follows from the counts. The model is a class-factored softmax, P(class | context) times
P(word | class, context): the commonest tokens (the head) stand in classes by rank, all others in classes by the
hash of their ending, where a word's share comes from its count. Logits are sums of rows of two weight tables,
found by hashing n-gram and skip features of the three tokens before. The head, its classes and the tables grow
with the number of tokens learned from up to a ceiling (`Sizes`). Training is by gradient rounds. The
gradient of a weight is what was observed with its feature less what the softmax of the present weights expects; every
task adds both up for its documents, Spark adds the tasks up by table block, and each weight moves by a share of
log(observed / expected), the gradient in the logarithm (iterative scaling), which cannot run away where a plain step
would. The first round takes all learning rows; its weights are all 0, so that the softmax is the same without context
and what it expects follows from the counts. Then follows an epoch through the class-factored softmax, in as many
rounds as there are BATCHES of rows (dealt by a hash of the document), so that every learning row is in one of them. Scoring works on batches of tokens in numpy.

The `known` commonest tokens travel as a broadcast of bounded size; what is rarer joins its counts in Spark.

Defined results: a null text is the empty text: one end. Nothing to learn from: no token is known, all score
log10(0.1 / 0.1) = 0 each. Repeated rows repeat; rows of a null id are scored, not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Shipped
from .common import LARGE_BLOCK, hot_keys, id_text, join_hot, stored, text_blocks, tidy
from .hashing import Words, mix

#: Least sizes; they hold for up to SMALL tokens.
HEAD, CLASS_WORDS, TAIL_CLASSES = 1024, 32, 32
ROW_BITS = 14
SMALL = 1 << 24
#: Doublings of the sizes, at most: a task's totals of a round then take 117 MB, and the weights 29 MB.
MOST_DOUBLINGS = 3
#: Rounds of the softmax an epoch, and all rounds.
BATCHES = 3
ROUNDS, TASKS = 1 + BATCHES, 8
#: How far a round moves a weight, as a share of log(observed / expected): beyond 1 / (features at once), which could
#: never overshoot, and well within what held-out text bears.
CLASS_STEP, WORD_STEP = 0.35, 0.45
#: Observations that each feature has beforehand, spread as the model without context expects.
PRIOR = 20.0
#: Commonest tokens whose counts are broadcast, at most.
KNOWN = 1 << 19
ALPHA = 0.1
_BLOCK = 512
_SPREAD = 1 << 17
#: Events whose logits are made at once, so that they stay in the processor's cache.
_AT_ONCE = 2048
#: Logits within this distance of 0 have exponentials that are whole float32 numbers, and so has a class's sum of them.
_FAR = 64.0
_U = np.uint64
_END = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Sizes:
    """Of the head, a head class and the tables: the head grows with the root of the tokens, and so do the weights
    by and by, so that all tasks' changes of a round, with tasks growing alike, stay in proportion to the input."""

    head: int
    words: int  # of a head class
    row_bits: int

    @classmethod
    def of(cls, total: int) -> Sizes:
        doublings = min(MOST_DOUBLINGS, max(0, int(np.log2(max(total, 1) / SMALL) / 2)))
        return cls(HEAD << doublings, CLASS_WORDS << (doublings + 1) // 2, ROW_BITS + doublings // 2)

    @property
    def head_classes(self) -> int:
        return self.head // self.words

    @property
    def classes(self) -> int:
        return self.head_classes + TAIL_CLASSES

    @property
    def model_bytes(self) -> int:
        return 8 * (self.classes + self.words + self.head_classes) << self.row_bits


class Tokens:
    """The token hashes of a block of texts, an end after each; tail class of each; where each text's begin."""

    def __init__(self, texts: list[str | None]):
        words = Words(texts)
        n = np.diff(words.starts)
        self.starts = np.concatenate(([0], np.cumsum(n + 1)))
        inside = np.ones(self.starts[-1], bool)
        inside[self.starts[1:] - 1] = False
        self.hashes = np.full(len(inside), _END)
        self.hashes[inside] = words.hashes
        ending = words.span_hashes(np.maximum(words.begin, words.end - 2), words.end)
        self.tail = np.zeros(len(inside), np.int64)
        self.tail[inside] = (ending % _U(TAIL_CLASSES)).astype(np.int64)
        self.owner = np.repeat(np.arange(len(n)), n + 1)
        self.texts = len(n)


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, tail, n over all texts; a task adds up what it reads before the shuffle."""

    def run(batches):
        held: list[tuple] = []

        def summed():
            hashes, n, tail = (np.concatenate(x) for x in zip(*held, strict=True))
            found, first, at = np.unique(hashes, return_index=True, return_inverse=True)
            held[:] = [(found, np.bincount(at, n).astype(np.int64), tail[first])]
            return held[0]

        def flush():
            hashes, n, tail = summed()
            held.clear()
            for start in range(0, len(hashes), 200_000):
                cut = slice(start, start + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[cut].view(np.int64)), pa.array(tail[cut]), pa.array(n[cut])], ["token", "tail", "n"])

        for _, texts in text_blocks(batches, "text", LARGE_BLOCK):
            tokens = Tokens(texts)
            found, first, n = np.unique(tokens.hashes, return_index=True, return_counts=True)
            held.append((found, n, tokens.tail[first]))
            if len(held) >= 8 and len(summed()[0]) > 2_000_000:
                yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(run, "token long, tail long, n long").groupBy("token").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Statistics:
    known: np.ndarray  # sorted hashes of the commonest tokens
    counts: np.ndarray
    rank: np.ndarray  # their rank where in the head, else -1
    total: int
    distinct: int
    tail_total: np.ndarray  # by tail class, without the head
    tail_distinct: np.ndarray
    least: int  # tokens of fewer counts are not among the known
    sizes: Sizes

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, or -1 if not among the known; rank, or -1 if not in the head)."""
        if not len(self.known):
            return np.full(len(hashes), -1), np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        found = self.known[at] == hashes
        return np.where(found, self.counts[at], -1), np.where(found, self.rank[at], -1)


    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """The rank alone, looked up among the head's tokens only."""
        head = np.flatnonzero(self.rank >= 0)
        if not len(head):
            return np.full(len(hashes), -1)
        own = self.known[head]
        at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        return np.where(own[at] == hashes, self.rank[head][at], -1)


def statistics(counts: DataFrame, known: int = KNOWN) -> Statistics:
    """What the driver needs of the stored counts: sums, and the commonest tokens, found through the histogram of
    the counts (few distinct values), so nothing is sorted in one place."""
    histogram = counts.groupBy("n").agg(F.count("*").alias("tokens")).toPandas().sort_values("n", ascending=False)
    more = histogram["tokens"].cumsum() <= known
    least = int(histogram["n"][more].min()) if more.any() else (int(histogram["n"].max()) + 1 if len(histogram) else 1)
    common = counts.where(F.col("n") >= least).toPandas().sort_values(["n", "token"], ascending=[False, True])
    hashes = common["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    tail_total, tail_distinct = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for row in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tail_total[row["tail"]], tail_distinct[row["tail"]] = row["n"], row["v"]
    total, distinct = int(tail_total.sum()), int(tail_distinct.sum())
    sizes = Sizes.of(total)
    rank = np.where(np.arange(len(common)) < sizes.head, np.arange(len(common)), -1)
    head = common[: sizes.head]
    np.subtract.at(tail_total, head["tail"].to_numpy().astype(np.int64), head["n"].to_numpy())
    np.subtract.at(tail_distinct, head["tail"].to_numpy().astype(np.int64), 1)
    return Statistics(hashes[order], common["n"].to_numpy()[order].astype(np.int64), rank[order], total, distinct, tail_total, tail_distinct, least, sizes)


@dataclass
class Model:
    classes: np.ndarray  # 2^row_bits x classes
    words: np.ndarray  # 2^row_bits x words of a class
    class_bias: np.ndarray
    word_bias: np.ndarray  # head classes x words of a class


def start_model(s: Statistics) -> Model:
    """Without context: the logs of all counts."""
    z = s.sizes
    head = np.zeros(z.head)
    head[s.rank[s.rank >= 0]] = s.counts[s.rank >= 0]
    head = head.reshape(-1, z.words) + ALPHA
    mass = np.concatenate((head.sum(axis=1), s.tail_total + ALPHA * (s.tail_distinct + 1)))
    f = np.float32
    return Model(np.zeros((1 << z.row_bits, z.classes), f), np.zeros((1 << z.row_bits, z.words), f), np.log(mass / mass.sum()).astype(f), np.log(head / head.sum(axis=1, keepdims=True)).astype(f))


def _row(bits: int, kind: int, *parts: np.ndarray) -> np.ndarray:
    """The hashed table row of a feature."""
    h = np.full(len(parts[0]), _U(kind * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    for p in parts:
        h = mix(h + p.astype(np.uint64) + _U(1))
    return (h >> _U(64 - bits)).astype(np.int64)


class Events:
    """Class, word in the class (-1 in tail classes) and hashed features of each token."""

    def __init__(self, tokens: Tokens, rank: np.ndarray, sizes: Sizes):
        symbol = np.where(rank >= 0, rank, sizes.head + tokens.tail)
        self.cls = np.where(rank >= 0, rank // sizes.words, sizes.head_classes + tokens.tail)
        self.word = np.where(rank >= 0, rank % sizes.words, -1)
        place = np.arange(len(symbol)) - tokens.starts[tokens.owner]
        before = []
        for k in (1, 2, 3):
            p = np.full(len(symbol), sizes.head + TAIL_CLASSES)
            ok = np.flatnonzero(place >= k)
            p[ok] = symbol[ok - k]
            before.append(p)
        a, b, c = before
        bits = sizes.row_bits
        self.class_rows = [_row(bits, 1, a), _row(bits, 2, b), _row(bits, 3, c), _row(bits, 4, a, b), _row(bits, 5, a, c)]  # n-grams and skips
        self.word_rows = [_row(bits, 6, self.cls, a), _row(bits, 7, self.cls, b), _row(bits, 8, self.cls, a, b)]

    def logits(self, model: Model, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of all classes; those of the class's words for the head tokens, and where these are."""
        z = np.take(model.classes, self.class_rows[0][part], axis=0)
        z += model.class_bias
        for r in self.class_rows[1:]:
            z += np.take(model.classes, r[part], axis=0)
        _level(z)
        at = np.flatnonzero(self.word[part] >= 0)
        w = np.take(model.word_bias, self.cls[part][at], axis=0)
        for r in self.word_rows:
            w += np.take(model.words, r[part][at], axis=0)
        _level(w)
        return z, w, at


def _level(z: np.ndarray) -> None:
    """Makes the greatest logit of each row 0, if any is so far from 0 that exponentials could leave the numbers' range."""
    if z.size and (z.max() > _FAR or z.min() < -_FAR):
        z -= z.max(axis=1, keepdims=True)


def _sums(p: np.ndarray) -> np.ndarray:
    return p @ np.ones(p.shape[1], p.dtype)


def _own_log(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The log probability of each row's own column."""
    at = z[np.arange(len(z)), own].astype(np.float64)
    return at - np.log(_sums(np.exp(z, out=z)))


def _probabilities(z: np.ndarray) -> np.ndarray:
    p = np.exp(z, out=z)
    p /= _sums(p)[:, None]
    return p


class Totals:
    """Counts of the features by row and class, and by row and word of a class. Of the first round also how often a word
    feature's row is met with each head class, from which follows what is expected while all weights are 0; of later
    rounds what the model expects, by column and row."""

    def __init__(self, z: Sizes, first: bool):
        rows = 1 << z.row_bits
        self.z, self.first, self.rooms = z, first, {}
        self.tables = {"classes": np.zeros((rows, z.classes)), "words": np.zeros((rows, z.words))}
        self.tables |= {"heads": np.zeros((rows, z.head_classes))} if first else {}
        self.expected = {} if first else {"classes": np.zeros((z.classes, rows)), "words": np.zeros((z.words, rows))}

    def add(self, events: Events, model: Model) -> None:
        head = np.flatnonzero(events.word >= 0)
        for r in events.class_rows:
            self._count("classes", r, events.cls)
        for r in events.word_rows:
            self._count("words", r[head], events.word[head])
            if self.first:
                self._count("heads", r[head], events.cls[head])
        if not self.first:
            self._expect(events, model)

    def _expect(self, events: Events, model: Model) -> None:
        """Adds what the model expects. Events stay in the order of the text: of an order by context, with its long runs
        of one row, each sum would wait for the one before."""
        for start in range(0, len(events.cls), _SPREAD):
            here = slice(start, min(start + _SPREAD, len(events.cls)))
            at = np.flatnonzero(events.word[here] >= 0) + start
            classes, words, done = self._room("classes", here.stop - start), self._room("words", len(at)), 0
            for k in range(start, here.stop, _AT_ONCE):  # turned in parts that stay in the cache
                z, w, own = events.logits(model, slice(k, min(k + _AT_ONCE, here.stop)))
                classes[:, k - start : k - start + len(z)] = _probabilities(z).T
                words[:, done : done + len(own)] = _probabilities(w).T
                done += len(own)
            self._spread("classes", [r[here] for r in events.class_rows], classes)
            self._spread("words", [r[at] for r in events.word_rows], words)

    def _room(self, name: str, events: int) -> np.ndarray:
        """By class or word and event, in memory that is kept from block to block."""
        columns = len(self.expected[name])
        if len(self.rooms.get(name, ())) < columns * events:
            self.rooms[name] = np.empty(columns * events, np.float32)
        return self.rooms[name][: columns * events].reshape(columns, events)

    def _count(self, name: str, row: np.ndarray, column: np.ndarray) -> None:
        """Adds one at each (row, column), at a cost by their number, not by the table's size."""
        table = self.tables[name]
        np.add.at(table.reshape(-1), row * table.shape[1] + column, 1.0)

    def _spread(self, name: str, rows: list[np.ndarray], p: np.ndarray) -> None:
        """Adds probabilities to the rows of their features, one class or word after the other."""
        for table, own in zip(self.expected[name], p, strict=True):
            own = own.astype(np.float64)
            for r in rows:
                table += np.bincount(r, own, len(table))

    def named(self) -> dict[str, np.ndarray]:
        """All tables by row."""
        return self.tables | {f"{name}_expected": table.T for name, table in self.expected.items()}


def _count_task(batches, model: Model, s: Statistics, first: bool):
    """The totals of a task's documents, in blocks of rows."""
    totals, seen = Totals(s.sizes, first), False
    for _, texts in text_blocks(batches, "text", LARGE_BLOCK):
        tokens, seen = Tokens(texts), True
        totals.add(Events(tokens, s.ranks(tokens.hashes), s.sizes), model)
    for name, table in totals.named().items() if seen else ():
        for block in range(0, len(table), _BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block]), pa.array([table[block : block + _BLOCK].astype("<f8").tobytes()], pa.binary())], ["name", "block", "total"])


def _added(batches):
    """The sum of each block, of rows sorted by block: one block in memory at a time."""
    key, total = None, None
    for batch in batches:
        for name, block, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (name, block) != key:
                if key:
                    yield _block(key, total)
                key, total = (name, block), np.zeros(len(part) // 8)
            total += np.frombuffer(part, "<f8")
    if key:
        yield _block(key, total)


def _block(key, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([total.tobytes()], pa.binary())], ["name", "block", "total"])


def moved(model: Model, tables: dict[str, np.ndarray], s: Statistics) -> Model:
    """The model after a round's totals; without expected ones its weights are all 0."""
    prior_class, prior_word = PRIOR * np.exp(model.class_bias.astype(float)), PRIOR / s.sizes.words
    if "heads" in tables:
        class_expected = tables["classes"].sum(axis=1, keepdims=True) * np.exp(model.class_bias.astype(float))
        word_expected = tables["heads"] @ np.exp(model.word_bias.astype(float))
    else:
        class_expected, word_expected = tables["classes_expected"], tables["words_expected"]
    classes = model.classes + CLASS_STEP * np.log((tables["classes"] + prior_class) / (class_expected + prior_class))
    words = model.words + WORD_STEP * np.log((tables["words"] + prior_word) / (word_expected + prior_word))
    return Model(classes.astype(np.float32), words.astype(np.float32), model.class_bias, model.word_bias)


def fit(docs: DataFrame, s: Statistics, rounds: int = ROUNDS, batches: int = BATCHES) -> Model:
    """Trains the weight tables on the learning part: first on all of it, then on one batch of it a round; tasks as many
    as keep the tables that they send in a round in proportion to the text."""
    model = start_model(s)
    lessons = docs.where("doc_id is not null").withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)))
    tasks = max(TASKS, 8 * s.total // s.sizes.model_bytes)
    sc, schema = docs.sparkSession.sparkContext, "name string, block long, total binary"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shipped_s = Shipped(sc.broadcast(s))
    for step in range(rounds):
        shipped = Shipped(sc.broadcast(model))

        def run(batches, shipped=shipped, first=step == 0):
            yield from _count_task(batches, shipped.value, shipped_s.value, first)

        own = lessons if step == 0 else lessons.where(F.col("batch") == (step - 1) % batches)
        sums = own.select("text").coalesce(tasks if step == 0 else max(TASKS, -(-tasks // batches))).mapInArrow(run, schema).repartition(parts, "name", "block").sortWithinPartitions("name", "block").mapInArrow(_added, schema)
        tables = {name: np.zeros(table.shape) for name, table in Totals(s.sizes, step == 0).named().items()}
        for row in sums.toLocalIterator():
            table = tables[row["name"]]
            table[row["block"] : row["block"] + _BLOCK] = np.frombuffer(row["total"], "<f8").reshape(_BLOCK, -1)
        model = moved(model, tables, s)
        del sums
        tidy(docs.sparkSession)
    return model


def score(docs: DataFrame, counts: DataFrame, s: Statistics, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10 probabilities) of each whole text."""
    sc = docs.sparkSession.sparkContext
    shipped, shipped_s = Shipped(sc.broadcast(model)), Shipped(sc.broadcast(s))

    def run(batches):
        now, st = shipped.value, shipped_s.value
        share = np.log10(st.tail_total + ALPHA * (st.tail_distinct + 1))
        for block, texts in text_blocks(batches, "text", LARGE_BLOCK):
            tokens = Tokens(texts)
            count, rank = st.look_up(tokens.hashes)
            events, logp = Events(tokens, rank, st.sizes), np.zeros(len(rank))
            for start in range(0, len(rank), 8192):
                part = slice(start, start + 8192)
                z, w, at = events.logits(now, part)
                own = _own_log(z, events.cls[part])
                own[at] += _own_log(w, events.word[part][at])
                logp[part] = own / np.log(10)
            tail = rank < 0
            logp[tail] -= share[tokens.tail[tail]]
            here = count >= 0
            logn = np.where(here, np.log10(np.maximum(count, 0) + ALPHA), 0.0)
            sums = lambda v: pa.array(np.bincount(tokens.owner, v, tokens.texts))
            rare = np.flatnonzero(~here)
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(tokens.owner[rare], minlength=tokens.texts)))).astype(np.int32))
            rares = pa.ListArray.from_arrays(ends, pa.array(tokens.hashes[rare].view(np.int64)))
            known = pa.array(np.bincount(tokens.owner, count > 0, tokens.texts).astype(np.int64))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(tokens.starts)), known, sums(logn), sums(logp + np.where(tail, logn, 0.0)), rares], ["doc_id", "n_tokens", "known", "logn", "logp", "rare"])

    part = docs.mapInArrow(run, "doc_id long, n_tokens long, known long, logn double, logp double, rare array<long>")
    rows = stored(part.withColumn("row", F.monotonically_increasing_id()))
    # a rare token of the learning part may be a common one of what is scored
    rare = rows.select("row", F.explode("rare").alias("token"))
    hot = hot_keys(rare.groupBy("token").agg(F.count("*").alias("n")), ["token"])
    rare = join_hot(rare, counts.where(F.col("n") < s.least).select("token", "n"), ["token"], hot, "left")
    n = F.coalesce("n", F.lit(0))
    late = rare.groupBy("row").agg(F.sum(F.log10(n + ALPHA)).alias("more"), F.sum((n > 0).cast("long")).alias("met"))
    base = F.col("logn") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(s.total + ALPHA * (s.distinct + 1))))
    return rows.drop("rare").join(late, "row", "left").select("doc_id", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), base.alias("base_score"), (F.col("logp") + F.coalesce("more", F.lit(0.0))).alias("score"))


def score_all(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows where `learn` holds; scores every row; adds train_tokens."""
    every = id_text(docs, id_col, text_col)
    lessons = id_text(docs.where(learn), id_col, text_col)
    counts = stored(count_tokens(lessons))
    s = statistics(counts)
    return score(every, counts, s, fit(lessons, s)).withColumn("train_tokens", F.lit(s.total).cast("long"))
