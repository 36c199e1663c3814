"""Token counts by prefix dynamic programming (operator 3), for a BPE vocabulary with word ends.

BPE has one valid last token for every prefix: the one that ends there and that merges would not have joined
with the last token of the prefix before it. A pass over a word's prefixes from short to long therefore finds
the token count of each from counts already stored, and no prefix is ever encoded. A text is cut into words
first; counts of whole words add up, so a text's counts at all prefixes are the running sum of its words'
plus the stored counts inside the word that the prefix cuts.

Defined results: a null text is the empty text with 0 tokens; rows keep their number and repeat if repeated
in the input; an empty table gives an empty table; only the id and text columns are read. Prefixes are those
of the normalized text (composed, blanks squeezed, lower case), as the vocabulary's own normalizer makes it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Shipped
from .common import LARGE_BLOCK, id_text, text_blocks, worker_state

#: Entries after which a worker's caches start anew.
CACHE_ENTRIES = 500_000
#: The normalizers (and what they put in) that `PrefixCounter.normalized` does by itself.
NORMALIZERS = [("NFC", None), ("Replace", " "), ("Lowercase", None)]
#: Blanks of str.split() that are no blanks to the vocabulary's pattern.
_ODD_BLANKS = re.compile("[\x1c-\x1f]")


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PrefixCounter:
    """Token counts of words and of all their prefixes, from a vocabulary file with merges."""

    def __init__(self, vocabulary_file: bytes):
        spec = json.loads(vocabulary_file)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if [(n["type"], n.get("content")) for n in spec["normalizer"]["normalizers"]] != NORMALIZERS:
            raise ValueError(f"normalized() stands for {NORMALIZERS}, not for the file's normalizers")
        self.end = model["end_of_word_suffix"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.made = {a + b: (a, b, r) for (a, b), r in reversed(self.rank.items())}
        if len(self.made) < len(self.rank) or any(self.made[x][2] >= r for (a, b), r in self.rank.items() for x in (a, b) if x in self.made):
            raise ValueError("every token must come from one merge, of tokens that earlier merges made")
        self.vocabulary = {t for t in model["vocab"] if t in self.made or len(t.removesuffix(self.end)) == 1}
        self.longest = max(len(t) - len(self.end) * t.endswith(self.end) for t in self.vocabulary)
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.symbols = _byte_symbols()
        special = [t["content"] for t in spec["added_tokens"]]
        self.marks = {c[0] for c in special}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.apart: dict[tuple[str, str], bool] = {}
        self.edges: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    # -- the dynamic programme ---------------------------------------------------------------------------------

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The symbols that stand at one side (0 left, 1 right) of a token while it is merged, the whole token
        first, each with the rank of the merge that takes it away."""
        if (out := self.edges.get((token, side))) is None:
            out, taken, symbol = [], 1 << 40, token
            while symbol:
                out.append((symbol, taken))
                parts = self.made.get(symbol)
                symbol, taken = (parts[side], parts[2]) if parts else ("", 0)
            self.edges[token, side] = out
        return out

    def follows(self, left: str, right: str) -> bool:
        """Whether right may be the token after left (left '' is the word's start).

        It may not if some symbol at left's right side and some symbol at right's left side merge while both
        stand there. Of equal pairs the leftmost merges first."""
        if not left:
            return True
        key = (left, right)
        if (ok := self.apart.get(key)) is None:
            rank, ahead = self.rank.get, self.edge(right, 0)
            ok = True
            for x, x_taken in self.edge(left, 1):
                for y, y_taken in ahead:
                    if (r := rank((x, y))) is not None and r < x_taken and r <= y_taken:
                        ok = False
            self.apart[key] = ok
        return ok

    def extend(self, word: str, last: list[str], count: list[int]) -> None:
        """Goes on with the stored last tokens and token counts of a word's prefixes, up to the word itself, as if
        the word still went on after it."""
        known, apart, follows, longest = self.vocabulary, self.apart.get, self.follows, self.longest
        for i in range(len(last), len(word) + 1):
            for start in range(i - longest if i > longest else 0, i):
                if (token := word[start:i]) in known:
                    before = last[start]
                    if (ok := apart((before, token))) is None:
                        ok = follows(before, token)
                    if ok:
                        last.append(token)
                        count.append(count[start] + 1)
                        break
            else:
                raise ValueError(f"no token ends at {i} of {word!r}")

    def ended(self, word: str, last: list[str], count: list[int], i: int) -> int:
        """The token count of the first i characters as a whole word."""
        for start in range(max(0, i - self.longest), i):
            if (token := word[start:i] + self.end) in self.vocabulary and self.follows(last[start], token):
                return count[start] + 1
        raise ValueError(f"no token ends the word {word[:i]!r}")

    def symbols_of(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")])

    def count_words(self, words: set[str]) -> dict[str, int]:
        """The token count of each word. In sorted order, neighbours share their stored prefixes."""
        out, last, count, stored = {}, [""], [0], ""
        for whole, word in sorted((self.symbols_of(w), w) for w in words):
            if whole + self.end in self.vocabulary:
                out[word] = 1
                continue
            inner, shared = whole[:-1], 0
            for a, b in zip(inner, stored):  # noqa: B905
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], count[shared + 1 :]
            self.extend(inner, last, count)
            out[word], stored = self.ended(whole, last, count, len(whole)), inner
        return out

    def word_prefixes(self, word: str) -> list[int]:
        """The token count of each prefix of one word, 1 character to all, each counted as a whole word."""
        whole, last, count = self.symbols_of(word), [""], [0]
        self.extend(whole, last, count)
        at, out = 0, []
        for c in word:
            at += len(self.symbols_of(c))
            out.append(self.ended(whole, last, count, at))
        return out

    # -- whole texts -------------------------------------------------------------------------------------------

    def normalized(self, text: str) -> str:
        """Composed and in lower case, letter by letter; blanks are squeezed where words are cut."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Blank-separated chunks, which no word crosses, and the number of special tokens between them."""
        if self.special and any(m in text for m in self.marks) and (n := len(self.special.findall(text))):
            parts = [self.pieces(p)[0] for p in self.special.split(text)]
            return list(chain.from_iterable(parts)), n
        text = self.normalized(text)
        return (self.pattern.findall(text) if _ODD_BLANKS.search(text) else text.split()), 0

    def counts(self, texts: list[str | None]) -> list[int]:
        """The token count of each whole text."""
        if len(self.chunks) > CACHE_ENTRIES or len(self.apart) > 2 * CACHE_ENTRIES:
            self.chunks.clear()
            self.words.clear()
            self.apart.clear()
        cut = [self.pieces(t) if t else ([], 0) for t in texts]
        words, chunks = self.words, self.chunks
        new = {c: self.pattern.findall(c) for c in set(chain.from_iterable(p for p, _ in cut)).difference(chunks)}
        words.update(self.count_words(set(chain.from_iterable(new.values())).difference(words)))
        for chunk, parts in new.items():
            chunks[chunk] = words[parts[0]] if len(parts) == 1 else sum([words[w] for w in parts])
        return [sum(map(chunks.__getitem__, p)) + n for p, n in cut]

    def prefix_counts(self, text: str | None) -> list[int]:
        """The token count of each prefix of the normalized text, 0 characters to all."""
        out, total = [0], 0
        special = self.special.finditer(text) if self.special and text else iter(())
        spans = [m.span() for m in special]
        for start, stop in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text or "")], strict=True):
            part = regex.sub(r"\s+", " ", self.normalized((text or "")[start:stop]))
            at = 0
            for m in self.pattern.finditer(part):
                out += [total] * (m.start() - at)
                out += [total + n for n in self._cut_counts(m.group())]
                at, total = m.end(), out[-1]
            out += [total] * (len(part) - at)
            if stop < len(text or ""):
                total += 1
                out.append(total)  # a special token is one unit, not cut
        return out

    def _cut_counts(self, word: str) -> list[int]:
        """Counts of a word's prefixes; a cut contraction is two words."""
        if word[0] != "'" or len(word) == 1 or not word[1].isalpha():
            return self.word_prefixes(word)
        cut = [self.pattern.findall(word[:i]) for i in range(1, len(word) + 1)]
        count = self.count_words(set(chain.from_iterable(cut)))
        return [sum(map(count.__getitem__, parts)) for parts in cut]


def _load(file: Shipped) -> PrefixCounter:
    return worker_state("token_counts", file.id, lambda: PrefixCounter(file.value))


def _ship(df: DataFrame, path: str) -> Shipped:
    with open(path, "rb") as f:
        return Shipped(df.sparkSession.sparkContext.broadcast(f.read()))


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of each whole text."""
    file = _ship(docs, vocabulary_path)

    def run(batches):
        for block, texts in text_blocks(batches, "text", LARGE_BLOCK, operator="token_counts"):
            counts = np.array(_load(file).counts(texts), np.int64)
            size = np.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(size), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def prefix_table(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, prefix_tokens array<int>: element i is the token count of the first i characters."""
    file = _ship(docs, vocabulary_path)

    def run(batches):
        for block, texts in text_blocks(batches, "text", LARGE_BLOCK, operator="token_counts"):
            counter = _load(file)
            counter.counts([])
            table = pa.array([counter.prefix_counts(t) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([block.column(0), table], ["doc_id", "prefix_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, prefix_tokens array<int>")


def tokens_at(prefix_tokens: Column | str, characters: int) -> Column:
    """Tokens of the first `characters` characters (all, if the text is shorter)."""
    table = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    return F.element_at(table, F.least(F.lit(characters + 1), F.size(table)))


def longest_within(prefix_tokens: Column | str, budget: int) -> Column:
    """The most characters whose prefix has at most `budget` tokens."""
    table = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    fits = F.transform(table, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fits)
