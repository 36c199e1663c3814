"""Language identification with spans (operator 6).

Each word has a score in every language, the log probability of its byte pairs and triples there. The scripts of
its characters narrow the languages that may be its own: only those that use the script in training. A text's
words are then labelled by Viterbi: the best sequence of languages, with a penalty for each switch, so that
mixed text falls into spans. A text in which no stretch gains enough to pay for a switch has one language, which
is found without stepping through its words.

Learning counts over at most `fit_rows` texts (those of smallest id hash). Defined results: `und` with score 0
for a null text or one without letters; no learned language: `und` for all; repeated rows repeat; only id, text
and, to learn, the language column are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Shipped
from .common import id_text, stored, text_blocks
from .hashing import LETTERS, Words

FIT_ROWS = 20_000
TRIPLE_BITS = 16
#: Pairs of bytes index the table directly; triples are hashed behind them.
TABLE = (1 << 16) + (1 << TRIPLE_BITS)
#: Nats that a change of language costs.
SWITCH = 25.0
#: Share of a script's words in training from which a language counts as using it.
SCRIPT_SHARE = 0.001


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # TABLE x languages, log probabilities
    scripts: np.ndarray  # SCRIPTS x languages, whether the language uses the script


#: Scripts by ranges of code points; what lies between them is of no script. The later one here is taken for a word
#: of several.
SCRIPT_RANGES = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("arabic", 0x8A0, 0x8FF), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("oriya", 0xB00, 0xB7F), ("tamil", 0xB80, 0xBFF),
    ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF), ("thai", 0xE00, 0xE7F),
    ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF),
    ("han", 0x20000, 0x323AF), ("kana", 0x3040, 0x30FF), ("kana", 0x31F0, 0x31FF),
]
NAMES = ["none", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES)]
SCRIPTS = len(NAMES)


def _bounds() -> tuple[np.ndarray, np.ndarray]:
    """(first code points, script from there on)."""
    at = {0: 0}
    for name, low, high in sorted(SCRIPT_RANGES, key=lambda r: r[1]):
        at[low] = NAMES.index(name)
        at.setdefault(high + 1, 0)
    first = sorted(at)
    return np.array(first), np.array([at[f] for f in first])


_FIRST, _SCRIPT = _bounds()


def scripts_of(b: np.ndarray) -> np.ndarray:
    """The script of each character of UTF-8 bytes, at its first byte; 0 elsewhere and where there is none."""
    out = np.zeros(len(b), np.int64)
    out[(b >= 97) & (b <= 122)] = NAMES.index("latin")
    wide = np.concatenate((b, np.zeros(3, b.dtype)))
    for low, high, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        at = np.flatnonzero((b >= low) & (b < high))
        point = wide[at] & bits
        for k in range(1, more + 1):
            point = point << 6 | wide[at + k] & 0x3F
        out[at] = _SCRIPT[np.searchsorted(_FIRST, point, side="right") - 1]
    return out


class Letters:
    """The words of a block of texts with their n-gram places, scripts and lengths."""

    def __init__(self, texts: list[str | None]):
        words = Words(texts, LETTERS)
        self.words, self.n = words, len(texts)
        b = words.buffer.astype(np.int64)
        self.length = words.end - words.begin
        # the n-grams of a word take in the blank on either side
        pair = b[:-1] * 256 + b[1:]
        triple = (1 << 16) + (((pair[:-1] * 256 + b[2:]) * 0x9E3779B1 >> 7) & ((1 << TRIPLE_BITS) - 1)) if len(b) > 2 else pair[:0]
        self.pair, self.triple = pair, triple
        self.first = np.maximum(words.begin - 1, 0)
        self.script = np.maximum.reduceat(scripts_of(b), words.begin) if len(words.begin) else np.zeros(0, np.int64)

    def has_letter(self, texts: list[str | None]) -> np.ndarray:
        out = np.diff(self.words.starts) > 0
        for i in np.flatnonzero(out).tolist():
            if not any(c.isalpha() for c in texts[i][:64]) and not any(map(str.isalpha, texts[i])):
                out[i] = False
        return out

    def word_scores(self, model: Model) -> np.ndarray:
        """words x languages."""
        out = np.empty((len(self.length), len(model.languages)))
        for k in range(len(model.languages)):
            column = model.scores[:, k]
            pairs = np.concatenate(([0.0], np.cumsum(column[self.pair])))
            triples = np.concatenate(([0.0], np.cumsum(column[self.triple])))
            end = self.words.end
            out[:, k] = pairs[np.minimum(end, len(self.pair))] - pairs[self.first] + triples[np.minimum(end - 1, len(self.triple))] - triples[np.minimum(self.first, len(self.triple))]
        allowed = model.scripts[self.script]
        out = np.where(allowed | ~allowed.any(axis=1)[:, None], out, out.max(axis=1, initial=0)[:, None] - 50.0 - np.abs(out))
        return out


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best sequence of languages of one text's words."""
    n, k = scores.shape
    back = np.zeros((n, k), np.int64)
    now = scores[0]
    for t in range(1, n):
        best = int(now.argmax())
        change = now[best] - penalty
        stay = now >= change
        back[t] = np.where(stay, np.arange(k), best)
        now = np.where(stay, now, change) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = now.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def labelled(letters: Letters, model: Model, penalty: float = SWITCH) -> tuple[np.ndarray, np.ndarray]:
    """(language of each word, each text's scores by language)."""
    scores, starts = letters.word_scores(model), letters.words.starts
    owner = letters.words.owners()
    sums = np.stack([np.bincount(owner, scores[:, k], letters.n) for k in range(scores.shape[1])], axis=1)
    main = sums.argmax(axis=1)
    path = main[owner]
    # the greatest gain of another language over a stretch of words; only a gain above the penalty can pay
    mixed = np.zeros(letters.n, bool)
    own = scores[np.arange(len(owner)), path]
    for k in range(scores.shape[1]):
        gain = np.concatenate(([0.0], np.cumsum(scores[:, k] - own)))
        step = (np.abs(gain).max(initial=0) + 1) * 2
        before = np.minimum.accumulate(gain[:-1] - step * owner) + step * owner if len(owner) else gain[:0]
        mixed[np.unique(owner[gain[1:] - before > penalty])] = True
    for i in np.flatnonzero(mixed).tolist():
        cut = slice(starts[i], starts[i + 1])
        path[cut] = viterbi(scores[cut], penalty)
    return path, sums


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Counts n-grams and scripts by language (keep held-out rows away before)."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = known.select(F.col(id_col).cast("long").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).distinct()
    sample = stored(known.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).join(F.broadcast(chosen), "doc_id"))

    def run(batches):
        for block, texts in text_blocks(batches, "text"):
            letters = Letters(texts)
            langs = np.array(block.column(block.schema.get_field_index("lang")).to_pylist())
            owner = letters.words.owners()
            inside = np.concatenate([np.repeat(owner, letters.length + 1), np.repeat(owner, letters.length)])
            places = [np.repeat(letters.first, letters.length + d) + _steps(letters.length + d) for d in (1, 0)]
            gram = np.concatenate([letters.pair[np.minimum(places[0], len(letters.pair) - 1)], letters.triple[np.minimum(places[1], len(letters.triple) - 1)]]) if len(owner) else inside
            for lang in set(langs.tolist()):
                mine = langs == lang
                for kind, keys in (("gram", gram[mine[inside]]), ("script", letters.script[mine[owner]])):
                    found, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array([kind] * len(found)), pa.array(found.astype(np.int64)), pa.array(n)], ["lang", "kind", "key", "n"])

    counted = sample.mapInArrow(run, "lang string, kind string, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # at most (TABLE + SCRIPTS) rows a language
    languages = sorted(table.lang.unique())
    n = np.full((TABLE, len(languages)), 0.3)
    scripts = np.zeros((SCRIPTS, len(languages)))
    for k, lang in enumerate(languages):
        own = table[table.lang == lang]
        grams, used = own[own.kind == "gram"], own[own.kind == "script"]
        n[grams.key.to_numpy(), k] += grams.n.to_numpy()
        scripts[used.key.to_numpy(), k] = used.n.to_numpy() / max(1, used.n.sum())
    logs = np.concatenate([np.log(part / part.sum(axis=0)) for part in (n[: 1 << 16], n[1 << 16 :])]) if languages else n
    return Model(languages, logs, scripts >= SCRIPT_SHARE)


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans (language with first and last word, in order)."""
    shipped = Shipped(docs.sparkSession.sparkContext.broadcast(model))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches):
        for block, texts in text_blocks(batches, "text"):
            now, letters = shipped.value, Letters(texts)
            if not now.languages:
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(["und"] * len(texts)), pa.array([0.0] * len(texts)), pa.array([[]] * len(texts), kind)], ["doc_id", "lang_pred", "score", "spans"])
                continue
            path, sums = labelled(letters, now)
            owner, k = letters.words.owners(), len(now.languages)
            share = np.bincount(owner * k + path, letters.length, letters.n * k).reshape(letters.n, k)
            main, there = share.argmax(axis=1), letters.has_letter(texts)
            total = share.sum(axis=1)
            sure = np.exp(np.clip(sums[np.arange(letters.n), main] - np.logaddexp.reduce(sums, axis=1), -50, 0))
            score = np.where(there, share.max(axis=1) / np.maximum(total, 1) * np.where(share.max(axis=1) == total, sure, 1.0), 0.0)
            new = np.ones(len(owner), bool)
            new[1:] = (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(owner))[: len(at)] - 1  # a block may hold no word at all
            spans: list = [[] for _ in texts]
            base = letters.words.starts
            for a, b in zip(at.tolist(), last.tolist(), strict=True):
                i = int(owner[a])
                spans[i].append({"lang": now.languages[path[a]], "first": a - int(base[i]), "last": b - int(base[i])})
            names = [now.languages[m] if ok else "und" for m, ok in zip(main.tolist(), there.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(names), pa.array(score), pa.array([s if ok else [] for s, ok in zip(spans, there.tolist(), strict=True)], kind)], ["doc_id", "lang_pred", "score", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first:int,last:int>>")
