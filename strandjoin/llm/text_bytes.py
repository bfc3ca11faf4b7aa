"""Words of a whole Arrow batch of texts as arrays: no Python step per word.

Texts are joined by blanks into one run of UTF-8 bytes; word borders and hashes come from
cumulative sums over it. Hashes are polynomials in 64-bit arithmetic that wraps, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text handled at once; one longer text is handled alone.
BATCH_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """bytes: the texts, lower case as asked; start, end: borders of the words in it; doc: the
    text of each word; first: words before each text, with the total at the end."""

    bytes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word, of its bytes and length."""
        n = len(self.bytes)
        weighted = (self.bytes.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(weighted, out=sums[1:])
        back = powers(INVERSE, n + 1)
        length = (self.end - self.start).astype(np.uint64)
        return mix((sums[self.end] - sums[self.start]) * back[self.start] + length * BASE)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper * np.uint8(32)).astype(np.uint8)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def split_words(texts: pa.Array) -> Words:
    """Words between white space of ASCII, A-Z in lower case; a null text has none."""
    parts = [x.as_py().encode("utf-8", "surrogatepass") if x.is_valid else b"" for x in texts]
    data = lower_ascii(np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8))
    lengths = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    ends = np.cumsum(lengths)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~is_space(data)
    border = np.diff(inside)
    start, end = np.flatnonzero(border == 1), np.flatnonzero(border == -1)
    doc = np.searchsorted(ends, start, side="right")
    first = np.searchsorted(doc, np.arange(len(parts) + 1))
    return Words(data, start, end, doc, first)


def slices(batch: pa.RecordBatch, column: int):
    """The batch in slices of about BATCH_BYTES of text."""
    sizes = np.array([len(x.as_py()) if x.is_valid else 0 for x in batch.column(column)], dtype=np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > BATCH_BYTES:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size + 1
    if begin < len(sizes):
        yield batch.slice(begin)
