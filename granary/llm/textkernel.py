"""Vectorised word and n-gram hashing over Arrow string columns.

A batch of texts is one contiguous UTF-8 buffer with offsets.  Words are found with a
256-entry byte class, and hashed with prefix sums of ``byte * B**i`` modulo 2**64: the hash
of any span is one subtraction and one multiplication by the inverse power, so no text is
ever turned into Python strings.  Work goes through the buffer in blocks of whole documents
of about ``BLOCK`` bytes, which bounds memory whatever the Arrow batch size; one document
longer than that makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93


def _byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for word bytes: all bytes outside the given separator ranges."""
    lut = np.ones(256, dtype=bool)
    for a, b in ranges:
        lut[a : b + 1] = False
    return lut


#: Words end at spaces, tabs and line breaks only.
SPACED = _byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words are ASCII letters, digits and everything outside ASCII (texts are lower-cased first).
ALNUM = _byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand; what one long text
    needed beyond KEPT isn't kept."""

    KEPT = 4 << 20

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.up, self.down
        while len(up) < n:
            k = len(up)
            step = np.array([pow(self.base, k, 1 << 64), pow(self.inverse, k, 1 << 64)], dtype=np.uint64)
            up, down = np.concatenate([up, up * step[0]]), np.concatenate([down, down * step[1]])
            if len(up) <= self.KEPT:
                self.up, self.down = up, down
        return up[:n], down[:n]


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Whole documents ``first .. first + len(words) - 1`` of a batch.

    ``words``: number of words of each; ``at``: index of each document's first word, with the
    total at the end; ``start``, ``end``: byte span of each word in ``raw``; ``hash``: its hash.
    """

    first: int
    raw: np.ndarray
    doc_at: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.at) - 1

    @property
    def words(self) -> np.ndarray:
        return np.diff(self.at)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.words)


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span of ``raw``."""
    up, down = _BYTES.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def blocks(column: pa.Array, word_bytes: np.ndarray, lower: bool, block: int = BLOCK, inner: int | None = None) -> Iterator[Block]:
    """Words of every text of a string column, a block of documents at a time.

    ``inner``: a byte that belongs to a word if it stands between two word bytes.
    """
    raw_all, offsets = string_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, side="right")) - 1)
        raw = raw_all[offsets[i] : offsets[j]]
        if lower:
            raw = _LOWER[raw]
        doc_at = offsets[i : j + 1] - offsets[i]
        inside = np.zeros(len(raw) + 2, dtype=bool)
        inside[1:-1] = word_bytes[raw]
        if inner is not None:
            at = np.flatnonzero(raw == inner)
            at = at[~(np.isin(at, doc_at) | np.isin(at + 1, doc_at))]
            inside[1 + at[inside[at] & inside[at + 2]]] = True
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cut = doc_at[(doc_at > 0) & (doc_at < len(raw))]
        begins[cut] = inside[1:-1][cut]
        ends[cut - 1] = inside[1:-1][cut - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        at = np.searchsorted(start, doc_at, side="left")
        yield Block(i, raw, doc_at, at, start, end, span_hash(raw, start, end))
        i = j


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (document limits are the caller's care)."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WORDS.upto(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(hashes) - n + 1])


def run_hash(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the word runs ``start[i]:end[i]``; runs of n words agree with ``ngrams(_, n)``."""
    up, down = _WORDS.upto(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def ngram_starts(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, document) of every n-gram that lies within one document."""
    count = np.maximum(np.diff(at) - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    return np.arange(len(doc)) - first[doc] + at[:-1][doc], doc


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed integer, as Spark's long holds them."""
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)
