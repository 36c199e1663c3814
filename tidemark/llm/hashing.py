"""Vectorized word hashes: all words of a block of texts at once, without a Python object per word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64

#: Byte tables: every byte as it is but A-Z in lower case; blanks are the ASCII ones.
BLANKS = bytes(32 if b in (9, 10, 11, 12, 13, 32) else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Only ASCII letters and digits and what lies beyond ASCII are part of words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Only ASCII letters and what lies beyond ASCII are part of words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each input bit reaches each output bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    odd = 0xB5AD4ECEDA1CE2A9
    up, down = np.full(size, _U(odd)), np.full(size, _U(pow(odd, -1, 1 << 64)))
    up[0] = down[0] = _U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """The words of a block of texts: `hashes` of 64 bits, `begin` and `end` in `buffer`, `starts` (the number of
    each text's first word, and of all at the end) and `text_at` (where each text begins in the buffer)."""

    def __init__(self, texts: list[str | None], table: bytes = BLANKS):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.text_at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)))
        joined = b"\n".join(raw) + b"\n"
        self.raw = np.frombuffer(joined, np.uint8)
        self.buffer = np.frombuffer(joined.translate(table), np.uint8)
        self.up, self.down = powers(1 << max(20, int(len(self.buffer) + 1).bit_length()))
        edge = np.flatnonzero(np.diff((self.buffer != 32).view(np.int8), prepend=np.int8(0)))
        self.begin, self.end = edge[0::2], edge[1::2]
        total = np.zeros(len(self.buffer) + 1, np.uint64)
        np.cumsum((self.buffer.astype(np.uint64) + _U(1)) * self.up[: len(self.buffer)], out=total[1:])
        self.total = total
        self.hashes = self.span_hashes(self.begin, self.end)
        self.starts = np.searchsorted(self.begin, self.text_at)

    def span_hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of buffer[begin:end] for each pair, the same for the same bytes."""
        return mix((self.total[end] - self.total[begin]) * self.down[begin])

    def owners(self) -> np.ndarray:
        """The number of the text that each word is of."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
