"""Toxicity by multiple-instance learning (operator 9).

A document is a bag of sentences. A sentence's probability is logistic in its hashed words and word pieces; a document's is
their leaky noisy-or, 1 - (1 - leak) * product(1 - sentence). Only document labels are needed to learn it: the
gradient of the bag's likelihood puts the blame on the sentences. Training is by full gradient steps: every task
sums the gradient of its documents, Spark adds the sums up by feature, and the driver keeps the weight vector of
at most FEATURES entries. It learns from at most `fit_rows` labelled rows (those of smallest id hash); scoring
covers every whole text, and gives the sentences to blame.

Defined results: a null or empty text has no sentence and scores the leak; without any labelled row of both
kinds every score is the leak; rows with a null id are scored, never learned from; repeated rows repeat; of
several labels of one id the largest counts; only id and text (and the labels' two columns) are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Shipped
from .common import fold, id_text, scratch, stored, text_blocks
from .hashing import LETTERS, Words

#: Labelled rows that training uses at most.
FIT_ROWS = 10_000
#: Features that the model has at most: those in most toxic documents of the sample.
FEATURES = 50_000
#: Toxic sample documents that a feature must be in.
MIN_DOCUMENTS = 5
#: Log odds against all documents from which a feature gets a weight.
MIN_LOG_ODDS = 1.0
ROUNDS = 12
SENTENCE_BIAS = -6.0
#: Besides whole words, features are their first and last pieces of so many bytes (first, last, first ...): a stem
#: or an ending stands for all words of its family.
PIECES = (4, 4, 5, 5, 6, 6)
_TABLE_BITS = 21


@dataclass
class Model:
    hashes: np.ndarray  # of the features, sorted
    weights: np.ndarray
    bias: float
    leak: float

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(each hash's index, whether it is a feature). A table has the first feature of the same leading bits; what
        else shares them follows it in order."""
        if not hasattr(self, "_table"):
            slots, first, n = np.unique((self.hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64), return_index=True, return_counts=True)
            self._table, self._deepest = np.full(1 << _TABLE_BITS, -1, np.int32), int(n.max())
            self._table[slots] = first
        at = self._table[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
        for _ in range(self._deepest - 1):
            on = np.flatnonzero((at >= 0) & (at < len(self.hashes) - 1) & (self.hashes[at] < hashes))
            at[on] += 1
        return at, (at >= 0) & (self.hashes[at] == hashes)


class Bags:
    """The sentences of a block of texts: for each word or piece its hash and sentence, for each sentence its text."""

    def __init__(self, texts: list[str | None]):
        words = Words(texts, LETTERS)
        self.words, self.n = words, len(texts)
        raw = words.raw
        stop = np.cumsum((raw == 46) | (raw == 33) | (raw == 63) | (raw == 10))
        number = stop[words.begin]
        new = np.ones(len(number), bool)
        new[1:] = number[1:] != number[:-1]
        self.first = np.flatnonzero(new)
        self.text = words.owners()[self.first]
        self.number = (np.cumsum(new) - 1).astype(np.int32)

    def features(self):
        """(hashes, numbers of their words), one kind of feature after the other."""
        words, size, every = self.words, self.words.end - self.words.begin, np.arange(len(self.number))
        yield words.hashes, every
        for kind, n in enumerate(PIECES):
            of = every[size > n]
            at = words.begin[of] if kind % 2 == 0 else words.end[of] - n
            yield words.span_hashes(at, at + n) * np.uint64(2 * kind + 3), of

    def found(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """(indexes of the model's features, their sentences)."""
        index, sentence = [], []
        if not len(model.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        for hashes, of in self.features():
            at, ok = model.place(hashes)
            index.append(at[ok])
            sentence.append(self.number[of[ok]])
        return np.concatenate(index).astype(np.int64), np.concatenate(sentence).astype(np.int64)

    def scores(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """(each sentence's logit, each text's log(1 - p) with the leak)."""
        index, sentence = self.found(model)
        z = model.bias + np.bincount(sentence, model.weights[index], len(self.first))
        return z, np.log1p(-model.leak) + np.bincount(self.text, -np.logaddexp(0, z), self.n)


def _candidates(toxic: DataFrame, most: int) -> np.ndarray:
    """Hashes of the features in most toxic documents."""

    def run(batches):
        for _, texts in text_blocks(batches, "text"):
            bags = Bags(texts)
            owner = bags.words.owners()
            found = []
            for hashes, of in bags.features():
                pair = np.unique(np.stack((hashes, owner[of].astype(np.uint64)), axis=1), axis=0)[:, 0]
                found.append(np.unique(pair, return_counts=True))
            for hashes, n in found:
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["hash", "n"])

    counted = toxic.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCUMENTS)
    rows = counted.orderBy(F.desc("n"), "hash").limit(most).select("hash").toArrow()
    return np.sort(rows["hash"].to_numpy().view(np.uint64))


def _compact(sample: DataFrame, model: Model) -> DataFrame:
    """label, sentences, features array<int>, at array<int> of each sample document: what training needs of it."""
    shipped = Shipped(sample.sparkSession.sparkContext.broadcast(model))

    def run(batches):
        for block, texts in text_blocks(batches, "text"):
            bags = Bags(texts)
            index, sentence = bags.found(shipped.value)
            text = bags.text[sentence]
            order = np.argsort(text, kind="stable")
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(texts))))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order].astype(np.int32))) for x in (index, sentence)]
            yield pa.RecordBatch.from_arrays([block.column(block.schema.get_field_index("label")), pa.array(np.bincount(bags.text, minlength=len(texts))), *lists], ["label", "sentences", "features", "at"])

    return sample.mapInArrow(run, "label long, sentences long, features array<int>, at array<int>")


def _gradient(compact: DataFrame, model: Model) -> np.ndarray:
    """The likelihood's gradient by weight, then bias, then leak (before its logistic)."""
    n = len(model.weights)
    shipped = Shipped(compact.sparkSession.sparkContext.broadcast(model))

    def run(batches):
        for batch in batches:
            now = shipped.value
            y, sentences, features, at = (batch.column(i) for i in range(4))
            y, sentences = y.to_numpy(), sentences.to_numpy()
            size = np.diff(features.offsets.to_numpy())
            index, where = features.flatten().to_numpy(), at.flatten().to_numpy().astype(np.int64)
            text = np.repeat(np.arange(len(y)), size)
            # sentences that hold a feature; all others have the bias for their logit
            key, number = np.unique(text * (1 << 32) + where, return_inverse=True)
            z = now.bias + np.bincount(number, now.weights[index], len(key))
            of = key >> 32
            plain = sentences - np.bincount(of, minlength=len(y))
            silent = np.log1p(-now.leak) - np.bincount(of, np.logaddexp(0, z), len(y)) - plain * np.logaddexp(0, now.bias)
            p = np.clip(-np.expm1(silent), 1e-9, 1 - 1e-9)
            by_text = np.where(y == 1, (1 - p) / p, -1.0)
            by_sentence = by_text[of] * np.exp(-np.logaddexp(0, -z))
            total = np.bincount(index, by_sentence[number], n + 2)
            total[n] = by_sentence.sum() + (by_text * plain).sum() * np.exp(-np.logaddexp(0, -now.bias))
            total[n + 1] = by_text.sum() * now.leak
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["feature", "value"])

    out = np.zeros(n + 2)
    # at most FEATURES + 2 rows, by one job: a local iterator runs one for each shuffle partition, in every round
    summed = compact.mapInArrow(run, "feature long, value double").groupBy("feature").agg(F.sum("value").alias("value")).toArrow()
    out[summed["feature"].to_numpy()] = summed["value"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Learns from the labelled documents (keep held-out rows away before)."""
    with scratch(docs.sparkSession):
        return _fit(docs, labels, label_col, id_col, text_col, fit_rows)


def _fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, fit_rows: int) -> Model:
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("long").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    # the sample is drawn from ids and labels alone; texts are read for it only
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = stored(id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "label"))
    hashes = _candidates(sample.where("label = 1"), FEATURES)
    empty = Model(hashes[:0], np.zeros(0), SENTENCE_BIAS, 1e-3)
    if not len(hashes):
        return empty
    compact = stored(_compact(sample, Model(hashes, np.ones(len(hashes)), 0.0, 0.0)))
    total, df = np.zeros(2), np.zeros((2, len(hashes)))
    for row in compact.groupBy("label").count().collect():
        total[row["label"]] = row["count"]
    counted = compact.select("label", F.explode(F.array_distinct("features")).alias("feature")).groupBy("feature", "label").count().toArrow()
    df[counted["label"].to_numpy(), counted["feature"].to_numpy()] = counted["count"].to_numpy()
    if not total.all():
        return empty
    odds = np.log((df[1] + 0.5) / (total[1] + 1)) - np.log((df[0] + 0.5) / (total[0] + 1))
    used = odds >= MIN_LOG_ODDS
    # start: what a feature's documents are beyond all documents, from where it is sure enough
    model = Model(hashes, np.where(used & (odds > 2.5), odds, 0.0), SENTENCE_BIAS, float(np.clip(total[1] / total.sum() / 8, 1e-3, 0.1)))
    n = len(hashes)
    momentum, power = np.zeros(n + 2), np.zeros(n + 2)
    for step in range(1, ROUNDS + 1):
        gradient = _gradient(compact, model)
        gradient[:n] = np.where(used, gradient[:n] - 0.05 * model.weights, 0)
        momentum, power = 0.8 * momentum + 0.2 * gradient, 0.95 * power + 0.05 * gradient**2
        move = 0.6 * (momentum / (1 - 0.8**step)) / (np.sqrt(power / (1 - 0.95**step)) + 1.0)
        leak = np.log(model.leak / (1 - model.leak)) + 0.5 * move[n + 1]
        model = Model(hashes, model.weights + move[:n], float(min(-3.0, model.bias + 0.5 * move[n])), float(np.clip(1 / (1 + np.exp(-leak)), 1e-4, 0.4)))
    kept = np.abs(model.weights) > 1e-3
    return Model(hashes[kept], model.weights[kept], model.bias, model.leak)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of each whole text, and where its most toxic sentence begins and ends (bytes of UTF-8; null
    without a sentence) with that sentence's score."""
    shipped = Shipped(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches):
        for block, texts in text_blocks(batches, "text"):
            bags = Bags(texts)
            z, silent = bags.scores(shipped.value)
            order = np.lexsort((z, bags.text))
            last = np.flatnonzero(np.append(bags.text[order][1:] != bags.text[order][:-1], True)) if len(order) else order
            worst = order[last]
            at, ends = bags.first, np.append(bags.first[1:], len(bags.words.begin))
            begin, end, top = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
            of, none = bags.text[worst], np.ones(len(texts), bool)
            none[of] = False
            begin[of] = bags.words.begin[at[worst]] - bags.words.text_at[of]
            end[of] = bags.words.end[ends[worst] - 1] - bags.words.text_at[of]
            top[of] = np.exp(-np.logaddexp(0, -z[worst]))
            columns = [block.column(0), pa.array(np.clip(-np.expm1(silent), 0.0, 1.0)), pa.array(begin, mask=none), pa.array(end, mask=none), pa.array(top, mask=none)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "begin", "end", "sentence_score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, begin long, end long, sentence_score double")


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose score is below the limit; no row moves."""
    shipped = Shipped(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches):
        for block, texts in text_blocks(batches, text_col):
            silent = Bags(texts).scores(shipped.value)[1]
            yield block.take(pa.array(np.flatnonzero(-np.expm1(silent) < limit)))

    return docs.mapInArrow(run, docs.schema)


def learnable(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose crc32(id as text) mod 5 is not 0."""
    return df.where(fold(id_col, 5) != 0)
