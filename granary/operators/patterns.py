"""Many byte patterns at once, by a table of first pairs and vectorised comparison."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Patterns:
    """Distinct patterns of at least one byte, found in whole buffers.

    A table of 65,536 bits says which pairs of bytes begin a pattern.  All pairs of a block of the buffer are
    looked up at once; at the few places that are left the further bytes of the patterns are compared, one byte
    of all places at a time.  No byte of the buffer is touched by Python code of its own.
    """

    BLOCK = 1 << 18

    def __init__(self, patterns: Iterable[bytes]):
        self.patterns = list(dict.fromkeys(patterns))
        if not self.patterns or b"" in self.patterns:
            raise ValueError("there must be patterns, none of them empty")
        self.longest = max(map(len, self.patterns))
        self.sizes = np.array([len(p) for p in self.patterns], dtype=np.int64)
        self.gate = np.zeros(1 << 16, dtype=bool)
        self.by_pair: dict[int, list[int]] = {}
        for k, p in enumerate(self.patterns):
            pairs = [p[0] << 8 | p[1]] if len(p) > 1 else [p[0] << 8 | b for b in range(256)]
            self.gate[pairs] = True
            for x in pairs:
                self.by_pair.setdefault(x, []).append(k)

    def find(self, data: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, indices of patterns) of all occurrences, overlapping ones too, by offset and then by index."""
        a = data if isinstance(data, np.ndarray) else np.frombuffer(data, np.uint8)
        padded = np.zeros(self.longest + 1, dtype=np.uint8)
        at: list[np.ndarray] = []
        which: list[np.ndarray] = []
        for lo in range(0, len(a), self.BLOCK):
            hi = min(lo + self.BLOCK, len(a))
            b = a[lo : hi + self.longest]
            if len(b) < hi - lo + self.longest:  # so that comparisons may look past the end
                b = np.concatenate([b, padded])
            pair = (b[: hi - lo].astype(np.uint16) << np.uint16(8)) | b[1 : hi - lo + 1]
            spots = np.flatnonzero(self.gate[pair])
            if not len(spots):
                continue
            codes = pair[spots]
            order = np.argsort(codes, kind="stable")
            codes, spots = codes[order], spots[order]
            edge = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                for k in self.by_pair[int(codes[i])]:
                    p, s = self.patterns[k], spots[i:j]
                    s = s[s + lo + len(p) <= len(a)]
                    for d in range(2, len(p)):
                        s = s[b[s + d] == p[d]]
                    if len(s):
                        at.append(s + lo)
                        which.append(np.full(len(s), k))
        if not at:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        offsets, indices = np.concatenate(at), np.concatenate(which)
        order = np.lexsort((indices, offsets))
        return offsets[order], indices[order]
