"""Byte-level BPE encoding and decoding (operator 4).

Words of one batch are put into padded integer matrices, one per length bucket. In each round every row
looks up the ranks of all its adjacent pairs in a hashed table, merges its leftmost pair of minimum rank and
is compacted by one column; rows without a mergeable pair leave the matrix. Words repeat, so each Python
worker keeps a bounded cache of what it has encoded.

Defined results: a null text is the empty text and gives no ids; rows keep their number and repeat if
repeated in the input; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import re
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import LARGE_BLOCK, id_text, text_blocks, worker_state

#: Entries after which a worker's cache starts anew.
CACHE_ENTRIES = 120_000
#: Longer words would make their matrix quadratic; they are merged in the same order with a heap.
MATRIX_BYTES = 192
#: Rows of one matrix, so that it stays in the processor's cache.
ROWS_AT_ONCE = 4096
NONE = np.int32(2**31 - 1)
_TWO_SPACES = re.compile(r"\s\s")


class PairTable:
    """Open-addressing hash table from (left id, right id) to the id of the merged token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(8, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE, np.int32)
        self.probes, todo, slot = 0, np.arange(len(keys)), self._slot(keys)
        while len(todo):
            self.probes += 1
            at = slot[todo]
            free = self.keys[at] == np.uint64(2**64 - 1)
            self.keys[at[free]] = keys[todo[free]]
            placed = self.keys[at] == keys[todo]
            self.values[at[placed]] = value[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != np.uint64(2**64 - 1)))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at = (slot.flat[open_] + 1) & self.mask
            slot.flat[open_] = at
            hit = self.keys[at] == keys.flat[open_]
            found.flat[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.keys[at] != np.uint64(2**64 - 1))]
        return found


def tokens_of(rank_file: bytes) -> dict[int, bytes]:
    """The bytes of each id of a .tiktoken file."""
    return {int(b): base64.b64decode(a) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}


class Decoder:
    """The bytes of all tokens in one row, so that many ids are looked up at once."""

    def __init__(self, tokens: dict[int, bytes]):
        size = np.full(max(tokens) + 1, -1, np.int64)
        size[list(tokens)] = list(map(len, tokens.values()))
        self.size, self.start = size, np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        self.bytes = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of each text, whose ids lie between neighbouring offsets; KeyError for an unknown id."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or (self.size[ids] < 0).any()):
            raise KeyError("ids of no token")
        n = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(n)))
        data = self.bytes[np.repeat(self.start[ids] - ends[:-1], n) + np.arange(ends[-1])]
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets].astype(np.int32)), pa.py_buffer(data)])


class ByteBpe:
    """Ranks of a .tiktoken file and the pattern that cuts text into words."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.tokens = tokens_of(rank_file)
        self.decoder = Decoder(self.tokens)
        self.ranks = {t: i for i, t in self.tokens.items()}
        self.pattern = regex.compile(pattern)
        self.bytes_to_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get, splits = self.ranks.get, array("i")
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                if (a := get(token[:cut])) is not None and (b := get(token[cut:])) is not None:
                    splits.extend((a, b, rank))
        self.pairs = PairTable(*np.frombuffer(splits, np.int32).reshape(-1, 3).T)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge_rows(self, rows: list[bytes]) -> list[bytes]:
        """Ids, as little-endian int32, of words of similar length: a padded matrix, one merge per row and round.

        The pair ranks stand in a second matrix; a merge changes only the two pairs beside it."""
        width = max(map(len, rows))
        raw = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in rows]), np.uint8).reshape(len(rows), width)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        matrix = np.where(np.arange(width) < lengths[:, None], self.bytes_to_id[raw], NONE)
        rank = self.pairs.find(matrix[:, :-1], matrix[:, 1:])
        out: list = [b""] * len(rows)
        alive = np.arange(len(rows))
        while True:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rank), np.int64)
            best = rank[np.arange(len(rank)), at] if rank.shape[1] else np.full(len(rank), NONE)
            done = best == NONE
            if done.any():
                ended, size = matrix[done].astype("<i4").tobytes(), 4 * matrix.shape[1]
                for k, (i, n) in enumerate(zip(alive[done].tolist(), (4 * lengths[done]).tolist(), strict=True)):
                    out[i] = ended[k * size : k * size + n]
                if done.all():
                    return out
                keep = ~done
                matrix, rank, at, best, alive, lengths = matrix[keep], rank[keep], at[keep], best[keep], alive[keep], lengths[keep]
            row, lengths = np.arange(len(matrix)), lengths - 1
            matrix[row, at] = best
            columns = np.arange(matrix.shape[1] - 1)
            matrix = np.take_along_axis(matrix, columns + (columns > at[:, None]), axis=1)
            columns = columns[:-1]
            rank = np.take_along_axis(rank, columns + (columns >= at[:, None]), axis=1)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                rank[ok, side[ok]] = self.pairs.find(matrix[ok, side[ok]], matrix[ok, side[ok] + 1])

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges for one very long word, with a heap of (rank, position) over a linked list."""
        ids = self.bytes_to_id[np.frombuffer(word, np.uint8)].tolist()
        n, tokens, ranks = len(ids), self.tokens, self.ranks

        def find(pair):
            return ranks.get(tokens[pair[0]] + tokens[pair[1]]) if None not in pair else None

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := find((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if ids[i] is None or j >= n or find((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j], after[i] = rank, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := find((rank, ids[after[i]]))) is not None:
                    heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := find((ids[k], rank))) is not None:
                heappush(heap, (r, k))
        return [x for x in ids if x is not None]

    def encode_words(self, words: set[str]) -> None:
        """Adds the ids of words, as little-endian int32, to the cache."""
        buckets: dict[int, list[str]] = {}
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                self.words[word] = whole.to_bytes(4, "little")
            elif len(raw) > MATRIX_BYTES:
                self.words[word] = np.array(self.merge_long(raw), "<i4").tobytes()
            else:
                buckets.setdefault(len(raw) if len(raw) <= 16 else -(-len(raw) // 16) * 16, []).append(word)
        for bucket in buckets.values():
            for start in range(0, len(bucket), ROWS_AT_ONCE):
                part = bucket[start : start + ROWS_AT_ONCE]
                self.words.update(zip(part, self.merge_rows([w.encode("utf-8", "surrogatepass") for w in part]), strict=True))

    def split(self, text: str) -> list[str]:
        """Pieces whose words are the text's words: cut before each space and around each line feed, if no two blanks meet."""
        if "\0" in text or _TWO_SPACES.search(text):
            return self.pattern.findall(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian int32."""
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks.clear()
            self.words.clear()
        pieces = [self.split(t) if t else [] for t in texts]
        cut = {c: self.pattern.findall(c) for c in set(chain.from_iterable(pieces)).difference(self.chunks)}
        self.encode_words(set(chain.from_iterable(cut.values())).difference(self.words))
        words, chunks = self.words, self.chunks
        for c, parts in cut.items():
            chunks[c] = words[parts[0]] if len(parts) == 1 else b"".join([words[p] for p in parts])
        return [b"".join(map(chunks.__getitem__, p)) for p in pieces]


def _load(rank_file, pattern: str | None):
    """One per Python worker; the vocabulary comes as a broadcast of the file, whose size is fixed. Without a
    pattern only the tokens' bytes, which is all that decoding needs."""
    return worker_state("bpe", (rank_file.id, pattern), lambda: Decoder(tokens_of(rank_file.value)) if pattern is None else ByteBpe(rank_file.value, pattern))


def _broadcast_file(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return Shipped(df.sparkSession.sparkContext.broadcast(f.read()))


class Shipped:
    """A broadcast value with an id that workers can key their caches by."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if hasattr(broadcast, "_jbroadcast") else id(broadcast)

    @property
    def value(self):
        return self.broadcast.value


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the ids of each whole text."""
    file = _broadcast_file(docs, rank_path)

    def run(batches):
        for block, texts in text_blocks(batches, "text", LARGE_BLOCK, operator="bpe"):
            ids = _load(file, pattern).encode(texts)
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """doc_id, ids, decoded binary: the bytes that the ids stand for (an unknown id fails the task)."""
    file = _broadcast_file(encoded, rank_path)

    def run(batches):
        for batch in batches:
            decoder = _load(file, None)
            lists = batch.column(batch.schema.get_field_index("ids"))
            for start in range(0, len(lists), 500):
                part = lists.slice(start, 500)
                size = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                out = decoder.decode(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(size))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 500), part, out], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`decode(encode(docs))` in one pass: doc_id, ids, decoded. One Python worker a task instead of two."""
    file = _broadcast_file(docs, rank_path)

    def run(batches):
        for block, texts in text_blocks(batches, "text", LARGE_BLOCK, operator="bpe"):
            bpe = _load(file, pattern)
            ids = bpe.encode(texts)
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            flat = np.frombuffer(b"".join(ids), "<i4")
            decoded = bpe.decoder.decode(flat.astype(np.int64), offsets)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded], ["doc_id", "ids", "decoded"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
