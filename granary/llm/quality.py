"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few dozen numbers.  Every number is cut into at most ``BINS`` bins, and
the model is one lookup table for each number and one for each chosen pair, learned by cyclic
boosting: in turn, each table gets a small step along a tree of at most ``LEAVES`` leaves over
its bins, fitted to the gradient that all others leave.  A score is a sum of looked-up values.

Fitting takes a sample of at most ``sample_rows`` labelled rows (those least in a hash order),
so the driver's share is bounded; counting and scoring cover every row in one pass without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import bound_batches, crc_split, tidy

BINS, LEAVES, RATE, ROUNDS, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 4, 0.1, 150, 8, 8, 50
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3

_MARKS = b"!?.,;:|*#&$%@_=+-~<>/\\\"'()[]{}"
FEATURES = (
    "log_words", "log_bytes", "mean_word", "long_word", "short_word", "upper", "digit", "outside_ascii", "mark", "space",
    "line_rate", "repeat_next", "repeat_second", "distinct", "top_word", "bare_word", "marked_word", "upper_word",
    *(f"mark_{c:02x}" for c in b"!?.,|*#&$%@"),
)


def features(b: tk.Block) -> np.ndarray:
    """One row of FEATURES for each document of a block; all finite, zeros for empty texts."""
    at, n = b.doc_at, b.n_docs

    def share(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(flags)][at]) / np.maximum(np.diff(at), 1)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(values)][b.at]) / np.maximum(b.words, 1)

    raw = b.raw
    upper = (raw >= 0x41) & (raw <= 0x5A)
    lower = (raw >= 0x61) & (raw <= 0x7A)
    digit = (raw >= 0x30) & (raw <= 0x39)
    high = raw >= 0x80
    mark = np.isin(raw, np.frombuffer(_MARKS, np.uint8))
    total = lambda flags: (c := np.r_[0, np.cumsum(flags)])[b.end] - c[b.start]
    size = b.end - b.start
    letters, marks, uppers = total(upper | lower | high), total(mark), total(upper)
    doc = b.doc_of_word()
    nxt = np.zeros(len(b.hash))
    if len(nxt) > 1:
        nxt[1:] = (b.hash[1:] == b.hash[:-1]) & (doc[1:] == doc[:-1])
    second = np.zeros(len(b.hash))
    if len(second) > 2:
        second[2:] = (b.hash[2:] == b.hash[:-2]) & (doc[2:] == doc[:-2])
    distinct, top = np.zeros(n), np.zeros(n)
    for d in range(n):
        if b.at[d] < b.at[d + 1]:
            c = np.unique(b.hash[b.at[d] : b.at[d + 1]], return_counts=True)[1]
            distinct[d], top[d] = len(c) / c.sum(), c.max() / c.sum()
    columns = [
        np.log1p(b.words), np.log1p(np.diff(at)), per_word(size), per_word(size > 12), per_word(size <= 3),
        share(upper), share(digit), share(high), share(mark), share(raw == 0x20), share(raw == 0x0A),
        per_word(nxt), per_word(second), distinct, top, per_word(letters == 0), per_word(marks >= 2),
        per_word((uppers > 1) & (uppers >= letters)), *(share(raw == c) for c in b"!?.,|*#&$%@"),
    ]
    return np.stack(columns, axis=1)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of the bins under the best tree with so many leaves over ordered bins."""
    G, H = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    worth = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(m[k])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = -(G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out


def _quad(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Steps of a grid under the best tree of one cut along each side, and its gain."""
    G = np.pad(g, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    H = np.pad(h, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    r, c = G.shape[0] - 1, G.shape[1] - 1
    best, out = 0.0, np.zeros_like(g)
    for i in range(1, r):
        for j in range(1, c):
            parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, c)), (slice(i, r), slice(0, j)), (slice(i, r), slice(j, c))]
            sums = [(G[a.stop, b.stop] - G[a.start, b.stop] - G[a.stop, b.start] + G[a.start, b.start], H[a.stop, b.stop] - H[a.start, b.stop] - H[a.stop, b.start] + H[a.start, b.start]) for a, b in parts]
            gain = sum(x * x / (y + ridge) for x, y in sums)
            if gain > best:
                best = gain
                for (a, b), (x, y) in zip(parts, sums, strict=True):
                    out[a, b] = -x / (y + ridge)
    return out, best


@dataclass
class AdditiveModel:
    """Lookup tables; ``edges[f]`` are the inner bin edges of number ``f``."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """``y`` holds 0 and 1.  Without rows the score is 0.5; with one label it is nearly constant."""
        n = len(y)
        share = (y.sum() + 1) / (n + 2)
        self = cls(float(np.log(share / (1 - share))))
        if n < 2:
            return self
        for f in range(x.shape[1]):
            self.edges.append(np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)))
            self.coarse.append(np.unique(np.quantile(x[:, f], np.arange(1, PAIR_BINS) / PAIR_BINS)))
            self.tables.append(np.zeros(len(self.edges[-1]) + 1))
        bins = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)]
        z = np.full(n, self.base)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return p - y, np.maximum(p * (1 - p), 1e-6)

        for _ in range(ROUNDS):
            for b, t in zip(bins, self.tables, strict=True):
                if len(t) > 1:
                    g, h = slopes()
                    step = RATE * _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)))
                    t += step
                    z += step[b]
        cells = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.coarse)]
        g, h = slopes()
        gains = []
        for i in range(len(cells)):
            for j in range(i):
                shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
                flat = cells[i] * shape[1] + cells[j]
                if min(shape) > 1:
                    size = shape[0] * shape[1]
                    gains.append((_quad(np.bincount(flat, g, size).reshape(shape), np.bincount(flat, h, size).reshape(shape))[1], i, j))
        self.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        self.grids = [np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (i, j), grid in zip(self.pairs, self.grids, strict=True):
                g, h = slopes()
                flat = cells[i] * grid.shape[1] + cells[j]
                step = RATE * _quad(np.bincount(flat, g, grid.size).reshape(grid.shape), np.bincount(flat, h, grid.size).reshape(grid.shape))[0]
                grid += step
                z += step[cells[i], cells[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, f], side="left")]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            z += grid[np.searchsorted(self.coarse[i], x[:, i], side="left"), np.searchsorted(self.coarse[j], x[:, j], side="left")]
        return 1 / (1 + np.exp(-z))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """text and y of at most ``sample_rows`` labelled rows that aren't held out.

    Null ids, null labels and labels other than 0 and 1 are left out, rows that repeat count
    once; the labels are sampled before the join, so what is broadcast is bounded.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    some = some.filter("doc_id is not null and y in (0, 1)").filter(~crc_split(F.col("doc_id"))).distinct()
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample_rows)
    return _rows(docs).join(F.broadcast(some), "doc_id").select("text", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Model of at most ``sample_rows`` labelled rows.

    Labels with a null id or other than 0 and 1 teach nothing; a null text counts as empty; rows
    that repeat count once.  Without labelled rows, as for empty tables, every text scores 0.5.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.blocks(batch.column("text"), tk.SPACED, False):
                x = pa.FixedSizeListArray.from_arrays(pa.array(features(b).ravel()), len(FEATURES))
                y = batch.column("y").slice(b.first, b.n_docs)
                yield pa.RecordBatch.from_arrays([x.cast(pa.list_(pa.float64())), y], names=["x", "y"])

    rows = labelled_sample(docs, labels, label, sample_rows).mapInArrow(tidy(run), "x array<double>, y int").toArrow()
    x = rows.column("x").combine_chunks()
    x = x.values.to_numpy().reshape(-1, len(FEATURES)) if len(rows) else np.zeros((0, len(FEATURES)))
    y = rows.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    return AdditiveModel.fit(x[order], y[order])


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """All columns of ``docs`` (which needs ``text``) and ``score``; null scores as empty text.

    A column named score is replaced; rows that repeat stay and score alike; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    schema = docs.select("*", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            scores = [shared.value.score(features(b)) for b in tk.blocks(text, tk.SPACED, False)]
            score = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(tidy(run), schema)


def op9_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null and empty texts score alike, rows that repeat, too;
    a null id stays null and isn't held out; an empty table stays empty."""
    scored = score_quality(_rows(docs), fit_quality(docs, labels))
    return scored.select(
        "doc_id",
        crc_split(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
