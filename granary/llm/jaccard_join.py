"""Similarity join of documents on word shingles by universe partition and pigeonhole.

A set of l shingles and a similar set differ in at most H shingles.  The universe of shingles
is cut into segments by hash, so a set falls apart into segment subsets, and if H + 1 subsets
are compared one of them must be equal in both sets.  Comparing a subset up to one deletion
counts double.  So each set

* belongs to the size band that holds l; bands fix the number of segments, and a set is also
  indexed for the band above if a similar set can be there;
* is indexed by the hashes of its segment subsets and, for large subsets, by their
  one-deletion neighbourhoods;
* probes the cheapest subsets whose allocation (1 each, 2 with one deletion) adds up to
  H + 1.  The cost of a subset falls with its size and rises if its shingles are frequent.

Hashes that two sets share make buckets.  Buckets give candidate pairs; sizes and parity bits of
the sets rule most of those out that aren't similar, and an exact comparison of the sets decides.  A larger bucket is a star around its least document first; only
buckets that this leaves in more than one component give further pairs, so no group of
copies or near copies is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import isqrt, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import bound_batches, cut, drop, small, tidy
from .components import connected_components

SHINGLE, NUM, DEN = 5, 75, 100
#: A shingle counts as frequent if this many documents have it in a run of CHUNK shingles.
#: Frequent shingles only make a subset dearer; results don't depend on them.
OFTEN, CHUNK, OFTEN_KEPT = 8, 1 << 20, 1 << 16
#: Signatures of one block of a task and of one part; both bound a task's memory.
SIGNATURES = 1 << 19
SIGNATURES_PER_PART = 1 << 21
#: Documents of a bucket that are compared with all its others in the first round; four times as many in each later one.
LEADERS = 64
#: Documents of a bucket in one row.
LISTED = 1 << 16
#: Passes with signatures of segments; sets that none of them serves are compared by single shingles in one more.
SEEDS = 3
#: How a signature takes part: indexed and probed, indexed only, one-deletion indexed,
#: one-deletion probed, indexed and probed up to one deletion.
BOTH, INDEX, LESS_INDEX, LESS_PROBE, WIDE = range(5)
#: Longs of parity bits of a set, by which most pairs that can't be similar are told before their sets are read.
PARITY = 16
_BITS = [f"b{i}" for i in range(PARITY)]
_K3 = np.uint64(0xD1B54A32D192ED03)
_K1, _K2 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


class Bands:
    """Size bands and the numbers of segments for a threshold num / den."""

    FIRST, FIRST_SEGMENTS = 16, 64

    def __init__(self, num: int, den: int):
        self.num, self.den, self.ratio = num, den, (den / num) ** 2 if num < den else 2.0

    def differ(self, l: int) -> int:
        """Most shingles in which a set of l and a similar one that is not larger differ."""
        return 2 * l * (self.den - self.num) // (self.den + self.num)

    def largest(self, l: int) -> int:
        """Size of the largest set similar to one of l."""
        return l * self.den // self.num

    def edge(self, band: int) -> int:
        return 1 if band <= 0 else int(np.ceil(self.FIRST * self.ratio ** (band - 1)))

    def band(self, l: int) -> int:
        k = 0
        while self.edge(k + 1) <= l:
            k += 1
        return k

    @lru_cache(maxsize=1 << 16)  # noqa: B019 one object for each task
    def plan(self, l: int) -> list[tuple[int, int, int, int]]:
        """(band, segments in all, segments that are indexed, segments to choose probes from)."""
        k = self.band(l)
        out = []
        for band in (k, k + 1):
            if band > k and self.largest(l) < self.edge(band):
                continue
            most = self.edge(band + 1) - 1
            need = self.differ(most) + 1
            n = self.FIRST_SEGMENTS if band == 0 else need + need // 20 + 2 * isqrt(need) + 2

            def use(x: int, n: int = n, band: int = band) -> int:
                h = self.differ(x) + 1
                return n if band == 0 else min(n, h + 7 * h // 20 + 2 * isqrt(h) + 4)

            out.append((band, n, use(min(self.largest(l), most)), use(l) if band == k else 0))
        return out


def shingle_sets(b: tk.Block, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block."""
    count = np.where(b.words >= size, b.words - size + 1, np.minimum(b.words, 1))
    first = np.r_[0, np.cumsum(count)]
    doc = np.repeat(np.arange(b.n_docs), count)
    start = b.at[:-1][doc] + np.arange(len(doc)) - first[:-1][doc]
    hashes = tk.run_hash(b.hash, start, np.minimum(start + size, b.at[1:][doc]))
    for d in range(b.n_docs):
        yield np.unique(hashes[first[d] : first[d + 1]])


def _set_hash(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return tk.mix(s * _K1).sum(dtype=np.uint64), tk.mix(s ^ _K2).sum(dtype=np.uint64)


def _parity(s: np.ndarray) -> np.ndarray:
    """PARITY longs: of each of their bits whether an odd number of shingles is dealt to it.

    Two sets differ in at least as many shingles as these differ in bits.
    """
    at = (tk.mix(s ^ _K3) >> np.uint64(32)).astype(np.int64) % (64 * PARITY)
    return np.packbits(np.bincount(at, minlength=64 * PARITY) & 1).view(np.int64)


def _summaries(size: int):
    """doc_id, set size, set hash and parities of each document; frequent shingles as rows of size -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n_held = set(), [], 0
        names = ["doc_id", "n_shingles", "v1", "v2", *_BITS]

        def often() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held), return_counts=True)
            value, count = value[count >= OFTEN], count[count >= OFTEN]
            n = len(value)
            columns = [pa.nulls(n, pa.int64()), pa.array(np.full(n, -1)), pa.array(tk.signed(value)), pa.array(count)]
            return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(n, pa.int64())] * PARITY], names=names)

        for batch in batches:
            sizes, v1, v2, bits = [], [], [], []
            for b in tk.blocks(batch.column("text"), tk.SPACED, True):
                for s in shingle_sets(b, size):
                    x, y = _set_hash(s)
                    sizes.append(len(s))
                    v1.append(x)
                    v2.append(y)
                    bits.append(_parity(s))
                    if int(x) not in seen:
                        seen.add(int(x))
                        held.append(s)
                        n_held += len(s)
                if n_held >= CHUNK:
                    yield often()
                    held, n_held = [], 0
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64())]
            columns += [pa.array(tk.signed(np.array(v, dtype=np.uint64))) for v in (v1, v2)]
            columns += [pa.array(c) for c in np.array(bits, dtype=np.int64).reshape(-1, PARITY).T.copy()]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if held:
            yield often()

    return run


def _chosen(count: np.ndarray, weight: np.ndarray, need: int, least: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Segments probed for equality and up to one deletion; None if their sum can't reach ``need``.

    ``least``: size from which one deletion is allowed.
    """
    filled = np.flatnonzero(count)
    order = filled[np.argsort(-weight[filled], kind="stable")]
    plain = order[:need]
    cost = 0.02 + 100 * np.exp(-1.5 * weight)
    wide = plain[count[plain] >= least]
    extra = 0.02 * (count[wide] + 1) + 100 * count[wide] * np.exp(-1.5 * np.maximum(weight[wide] - 1, 0))
    wide = wide[np.argsort(extra, kind="stable")]
    extra = np.sort(extra)
    missing = need - len(plain)
    if missing > len(wide):
        return None
    worst = plain[::-1]
    n = min(len(wide), len(worst))
    gain = np.zeros(len(wide), dtype=bool)
    gain[:missing] = True
    rest = np.arange(missing, n)
    gain[rest] = cost[worst[rest - missing]] > extra[rest]
    up = missing + int(np.argmin(np.r_[gain[missing:], False]))
    dropped = up - missing
    while dropped and np.intersect1d(wide[:up], worst[:dropped]).size:
        up, dropped = up - 1, dropped - 1
    return plain[: len(plain) - dropped], wide[:up]


def signatures(s: np.ndarray, bands: Bands, often: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, bool]:
    """Signatures of a set and their roles, and whether its probes reach H + 1 under this seed."""
    l = len(s)
    light = np.ones(l)
    if len(often):
        k = np.minimum(np.searchsorted(often, s), len(often) - 1)
        light[often[k] == s] = 0.1
    hashes, roles = [], []
    reach = True
    for band, n, indexed, choice in bands.plan(l):
        salt = np.uint64((band * 1000003 + seed + 1) * int(_K2) & 0xFFFFFFFFFFFFFFFF)
        token = tk.mix(s ^ salt)
        segment = ((token >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        order = np.argsort(segment, kind="stable")
        token, segment, w = tk.mix(token[order] * _K1), segment[order].astype(np.int64), light[order]
        at = np.searchsorted(segment, np.arange(indexed + 1))
        count = np.diff(at)
        total = np.r_[np.uint64(0), np.cumsum(token)]
        sums = total[at[1:]] - total[at[:-1]]
        name = (np.arange(indexed, dtype=np.uint64) + np.uint64(1)) * _K2 + salt
        role = np.full(indexed, INDEX, dtype=np.uint8)
        wide = np.zeros(0, dtype=np.int64)
        least = 2 if band == 0 else 6
        if choice:
            weight = np.r_[0.0, np.cumsum(w)]
            got = _chosen(count[:choice], (weight[at[1:]] - weight[at[:-1]])[:choice], bands.differ(l) + 1, least)
            if got is None:
                reach = False
            else:
                role[got[0]] = BOTH
                wide = got[1]
                role[wide] = WIDE
        filled = np.flatnonzero(count)
        hashes.append(tk.mix(sums[filled] + name[filled]))
        roles.append(role[filled])
        for which, r in ((np.flatnonzero(count > least), LESS_INDEX), (wide, LESS_PROBE)):
            if len(which):
                c = count[which]
                seg = np.repeat(which, c)
                tok = np.concatenate([np.arange(at[x], at[x + 1]) for x in which])
                hashes.append(tk.mix(sums[seg] - token[tok] + name[seg]))
                roles.append(np.full(len(tok), r, dtype=np.uint8))
    return np.concatenate(hashes), np.concatenate(roles), reach


def _step(l: int) -> int:
    """Size on a logarithmic scale, eight steps to a doubling."""
    return int(8 * np.log2(l))


def token_signatures(s: np.ndarray, bands: Bands, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every shingle as a signature, probed only by sets that no seed serves: similar sets share one."""
    served = any(signatures(s, bands, often, seed)[2] for seed in range(SEEDS))
    return tk.mix(s * _K2 ^ _K1), np.full(len(s), INDEX if served else BOTH, dtype=np.uint8)


_BLOCKS = "part int, base long, low binary, mid binary, doc binary, meta binary"


def _signed_blocks(size: int, bands: Bands, often_of, parts: int, seed: int):
    """Signatures in blocks for each part: 48 bits of hash, document, role and size step.

    A part holds a range of the upper 16 bits, so no bit of the hash is lost that tells
    signatures of one part apart.  Documents with one set count once in a task.  Part
    ``parts`` gets the documents whose probes don't reach H + 1 under this seed.
    """

    def block(h, meta, doc, parts_of) -> pa.RecordBatch:
        order = np.argsort(parts_of, kind="stable")
        h, meta, doc, parts_of = h[order], meta[order], doc[order], parts_of[order]
        at = np.searchsorted(parts_of, np.arange(parts + 2))
        base = int(doc.min())
        doc = (doc - base).astype(np.uint64 if int(doc.max()) - base >= 1 << 32 else np.uint32)
        rows = [p for p in range(parts + 1) if at[p] < at[p + 1]]
        spans = [slice(at[p], at[p + 1]) for p in rows]
        planes = (h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint16), doc, meta)
        columns = [pa.array(rows, pa.int32()), pa.array([base] * len(rows), pa.int64())]
        columns += [pa.array([x[s].tobytes() for s in spans], pa.binary()) for x in planes]
        return pa.RecordBatch.from_arrays(columns, names=["part", "base", "low", "mid", "doc", "meta"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = often_of.value
        seen: set[int] = set()
        held: list[tuple] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            h, meta = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            sizes = [len(x[0]) for x in held]
            doc = np.repeat(np.array([x[2] for x in held], dtype=np.int64), sizes)
            part = (((h >> np.uint64(48)) * np.uint64(parts)) >> np.uint64(16)).astype(np.int32)
            part[_first(sizes) & np.repeat([not x[3] for x in held], sizes)] = parts
            return block(h, meta, doc, part)

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for b in tk.blocks(batch.column("text"), tk.SPACED, True):
                for d, s in enumerate(shingle_sets(b, size)):
                    if not len(s) or (x := int(_set_hash(s)[0])) in seen:
                        continue
                    seen.add(x)
                    if seed < SEEDS:
                        hashes, roles, reach = signatures(s, bands, often, seed)
                    else:
                        (hashes, roles), reach = token_signatures(s, bands, often), True
                    if not reach:
                        hashes, roles = np.r_[hashes[:1], hashes], np.r_[roles[:1], roles]
                    meta = roles.astype(np.uint16) | np.uint16(_step(len(s)) << 3)
                    held.append((hashes, meta, ids[b.first + d], reach))
                    n_held += len(hashes)
                    if n_held >= SIGNATURES:
                        yield flush()
                        held, n_held = [], 0
        if held:
            yield flush()

    return run


def _first(sizes: list[int]) -> np.ndarray:
    """True at the first of each run of rows."""
    out = np.zeros(sum(sizes), dtype=bool)
    out[np.r_[0, np.cumsum(sizes)[:-1]]] = True
    return out


def _buckets(parts: int, gap: int):
    """The buckets of each part.

    Rows (a, b, null): a bucket of two, which is a candidate pair; (a, name, documents): documents of
    the bucket ``name`` of three or more, at most LISTED a row, ``a`` the least that probes, each with twice its
    size step and 1 more if it probes; (a, null, null): a document to sign again.  Buckets of the
    same documents in the same roles have one name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, docs, meta, again = [], [], [], []
        for batch in batches:
            for r in (dict(zip(batch.schema.names, x, strict=True)) for x in zip(*batch.columns, strict=True)):
                planes = {c: r[c].as_buffer() for c in ("low", "mid", "doc", "meta")}
                kind = np.uint32 if planes["doc"].size == planes["low"].size else np.uint64
                doc = np.frombuffer(planes["doc"], dtype=kind).astype(np.int64) + r["base"].as_py()
                if r["part"].as_py() == parts:
                    again.append(np.unique(doc))
                    continue
                low, mid = np.frombuffer(planes["low"], np.uint32), np.frombuffer(planes["mid"], np.uint16)
                part = np.uint64(r["part"].as_py()) << np.uint64(48)
                h.append(low.astype(np.uint64) | (mid.astype(np.uint64) << np.uint64(32)) | part)
                docs.append(doc)
                meta.append(np.frombuffer(planes["meta"], np.uint16).copy())
        names = ["a", "b", "members"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("m", pa.int64()), ("s", pa.int32())]))]

        def rows(n: int, *columns: pa.Array | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c for c, k in zip(columns, kinds, strict=True)], names=names)

        if again:
            a = np.unique(np.concatenate(again))
            yield rows(len(a), pa.array(a), None, None)
        if not h:
            return
        h, docs, meta = np.concatenate(h), np.concatenate(docs), np.concatenate(meta)
        order = np.argsort(h).astype(np.uint32)
        same = h[order[1:]] == h[order[:-1]]
        order = order[np.r_[same, False] | np.r_[False, same]]
        if not len(order):
            return
        h, docs, meta = h[order], docs[order], meta[order]
        order = np.lexsort((docs, h))
        h, docs, role, step = h[order], docs[order], meta[order] & 7, (meta[order] >> 3).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])])
        probes = np.maximum.reduceat(np.isin(role, (BOTH, LESS_PROBE, WIDE)), new)
        h, docs, step = h[new], docs[new], step[new]
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.r_[begin, len(h)])
        keep = np.repeat(np.maximum.reduceat(probes, begin) & (count > 1), count)
        h, docs, step, probes = h[keep], docs[keep], step[keep], probes[keep]
        if not len(docs):
            return
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.r_[begin, len(docs)])
        lead = np.repeat(begin, count)
        pair = (lead != np.arange(len(docs))) & (np.abs(step[lead] - step) <= gap) & (np.repeat(count, count) == 2)
        pairs = np.unique(np.stack([docs[lead[pair]], docs[pair]], axis=1), axis=0)
        yield rows(len(pairs), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), None)
        name = np.add.reduceat(tk.mix(docs.view(np.uint64) + probes * _K1), begin)
        _, first = np.unique(name, return_index=True)
        first = first[count[first] > 2]
        star = np.minimum.reduceat(np.where(probes, docs, np.iinfo(np.int64).max), begin)
        said = (2 * step + probes).astype(np.int32)
        pieces = -(-count[first] // LISTED)
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        of = np.repeat(first, pieces)
        size = np.minimum(count[of] - piece * LISTED, LISTED)
        for i in range(0, len(of), 1 << 14):
            k = slice(i, i + (1 << 14))
            at = np.repeat(begin[of[k]] + piece[k] * LISTED - np.r_[0, np.cumsum(size[k])[:-1]], size[k]) + np.arange(size[k].sum())
            values = pa.StructArray.from_arrays([pa.array(docs[at]), pa.array(said[at])], names=["m", "s"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[k])], pa.int32()), values)
            yield rows(len(lists), pa.array(star[of[k]]), pa.array(tk.signed(name[of[k]])), lists)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.blocks(batch.column("text"), tk.SPACED, True):
                sets = list(shingle_sets(b, size))
                at = np.r_[0, np.cumsum([len(s) for s in sets])]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tk.signed(np.concatenate(sets))))
                v = [pa.array(tk.signed(np.array(x, dtype=np.uint64))) for x in zip(*map(_set_hash, sets), strict=True)]
                ids = batch.column("doc_id").slice(b.first, b.n_docs)
                yield pa.RecordBatch.from_arrays([ids, *v, lists], names=["id", "v1", "v2", "shingles"])

    return run


def _sketches(size: int):
    """Like ``_sets``, but parity bits, four to eight for a shingle; a sketch of twice the bits folds into one of a smaller set."""

    def bits(s: np.ndarray) -> np.ndarray:
        n = 64 << max(0, (max(4 * len(s), 1) - 1).bit_length() - 6)
        at = (tk.mix(s ^ _K3) >> np.uint64(32)).astype(np.int64) % n
        return np.packbits(np.bincount(at, minlength=n) & 1).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.blocks(batch.column("text"), tk.SPACED, True):
                sets = list(shingle_sets(b, size))
                found = [bits(s) for s in sets]
                at = np.r_[0, np.cumsum([len(x) for x in found])]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(found)))
                v = [pa.array(tk.signed(np.array(x, dtype=np.uint64))) for x in zip(*map(_set_hash, sets), strict=True)]
                ids = batch.column("doc_id").slice(b.first, b.n_docs)
                yield pa.RecordBatch.from_arrays([ids, *v, pa.array([len(s) for s in sets], pa.int64()), lists], names=["id", "v1", "v2", "n", "bits"])

    return run


class JaccardJoin:
    """Links and link components of documents by the Jaccard similarity of their shingles.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Words are lower-cased
    for A-Z; a text of fewer than ``shingle`` words is one shingle; null, empty and blank texts
    have no shingles and link with nothing, and so do rows with a null ``doc_id``.  Two
    documents link if den * intersection >= num * union.  Rows that repeat a ``doc_id`` belong
    to one document, which has the links of all of them.

    Thresholds low enough that a set's subsets can't reach H + 1 cost further passes: SEEDS with
    other segments, then one in which such sets probe by every single shingle, which is exact.
    """

    def __init__(self, docs: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN):
        if not 0 < num <= den:
            raise ValueError("the threshold must be over 0 and at most 1")
        bound_batches(docs.sparkSession)
        self.spark, self.shingle, self.bands = docs.sparkSession, shingle, Bands(num, den)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        kinds = "doc_id long, n_shingles long, v1 long, v2 long, " + ", ".join(f"{b} long" for b in _BITS)
        said = cut(self.docs.mapInArrow(tidy(_summaries(shingle)), kinds), "sizes")
        self._tables: list[DataFrame] = []
        self.rows = said.filter("n_shingles >= 0")
        self.often = said.filter("n_shingles < 0")
        keyed = self.rows.filter("n_shingles > 0 and doc_id is not null")
        #: Classes of equal sets: (v1, v2) and the least document, which stands for the class.
        self.classes = self._cut(keyed.groupBy("v1", "v2").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.min("n_shingles").alias("size"), *[F.min(b).alias(b) for b in _BITS]
        ), "classes")
        self.n_classes = self.classes.count()

    def _frequent(self) -> np.ndarray:
        """At most OFTEN_KEPT frequent shingles (they only steer costs)."""
        rows = self.often.groupBy("v1").agg(F.sum("v2").alias("n")).orderBy(F.desc("n"), "v1").limit(OFTEN_KEPT).collect()
        return np.sort(np.array([r.v1 for r in rows], dtype=np.int64).view(np.uint64))

    def _rep(self, df: DataFrame, *columns: str) -> DataFrame:
        """Ids replaced by those of the documents that stand for their classes."""
        other = self.others.select("doc_id", "rep")
        for c in columns:
            side = small(other.withColumnRenamed("doc_id", c), self.n_others * 16)
            df = df.join(side, c, "left").withColumn(c, F.coalesce("rep", c)).drop("rep")
        return df

    def _signed(self, often, seed: int) -> DataFrame:
        total = self.rows.agg(F.sum("n_shingles")).first()[0] or 0
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), total // SIGNATURES_PER_PART + 1)
        parts = min(parts, 1 << 16)
        rows = self.docs.filter("doc_id is not null and text is not null")
        blocks = rows.mapInArrow(tidy(_signed_blocks(self.shingle, self.bands, often, parts, seed)), _BLOCKS)
        gap = int(8 * np.log2(self.bands.den / self.bands.num)) + 2
        found = blocks.repartitionById(parts, F.col("part") % parts).mapInArrow(
            tidy(_buckets(parts, gap)), "a long, b long, members array<struct<m: long, s: int>>"
        )
        return self._cut(found, "buckets")

    def _of_texts(self, kernel, what: str, ids: DataFrame, c: str, n: int) -> DataFrame:
        """What ``kernel`` makes of the sets of the ids in column ``c``, at most ``n``: made where texts are read, as a
        table of all sets would be several times the texts."""
        texts = self.docs.join(small(ids.select(F.col(c).alias("doc_id")).distinct(), 16 * n), "doc_id", "left_semi")
        made = texts.mapInArrow(tidy(kernel(self.shingle)), f"id long, v1 long, v2 long, {what}")
        if self.several:  # an id with several sets may stand for a class by some of them only
            made = made.join(small(self.wanted, 32 * self.n_bits), ["id", "v1", "v2"], "left_semi").dropDuplicates(["id", "v1"])
        return made.drop("v1", "v2").withColumnRenamed("id", c)

    def _closer(self, pairs: DataFrame, n: int) -> DataFrame:
        """Those of the pairs that longer parities don't rule out: PARITY longs tell little of large sets, and whole sets are dear to move."""
        a, b = (self._of_texts(_sketches, "n long, bits array<long>", pairs, c, n).withColumnsRenamed({"n": f"n{c}", "bits": f"s{c}"}) for c in "ab")
        num, den = self.bands.num, self.bands.den

        def fits(x: Column, y: Column) -> Column:
            differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, k: t + k)
            return differ * (den + num) <= (F.col("na") + F.col("nb")) * (den - num)

        def half(x: str, size: Column) -> Column:
            return F.zip_with(F.slice(x, 1, size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q))

        m, k = F.size("sa"), F.size("sb")
        near = F.when(m == k, fits(F.col("sa"), F.col("sb"))).when(m == 2 * k, fits(half("sa", k), F.col("sb")))
        near = near.when(2 * m == k, fits(F.col("sa"), half("sb", m))).otherwise(True)
        return b.join(small(pairs, 24 * n), "b").join(a, "a").filter(near).select("a", "b").distinct()

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets link."""
        for c in "ab":
            pairs = self._with_bits(pairs, c)
        pairs = self._cut(pairs.filter(self._alike("a", "b")).select("a", "b"), "alike")
        if not (n := pairs.count()):
            return pairs
        alike, pairs = pairs, self._cut(self._closer(pairs, n), "closer")
        self._drop(alike)
        if not (n := pairs.count()):
            return pairs
        num, den = self.bands.num, self.bands.den
        a, b = (self._of_texts(_sets, "shingles array<long>", pairs, c, n).withColumnRenamed("shingles", f"s{c}") for c in "ab")
        both = b.join(small(pairs, 24 * n), "b").join(a, "a")
        shared = F.size(F.array_intersect("sa", "sb"))
        similar = den * shared >= num * (F.size("sa") + F.size("sb") - shared)
        quick = F.least(F.size("sa"), F.size("sb")) * den >= num * F.greatest(F.size("sa"), F.size("sb"))
        links = self._cut(both.filter(quick).filter(similar).select("a", "b"), "links")
        self._drop(pairs)
        return links

    def _with_bits(self, df: DataFrame, c: str) -> DataFrame:
        """``df`` with the set size and the parities of the set of ``c``."""
        side = self.bits.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("size", *_BITS)])
        return df.join(small(side, self.n_bits * (16 + 8 * PARITY)), c, "left")

    def _alike(self, a: str, b: str) -> Column:
        """False where sizes or parities tell that sets don't link."""
        differ = sum((F.bit_count(F.col(f"{a}_{x}").bitwiseXOR(F.col(f"{b}_{x}"))) for x in _BITS), F.lit(0))
        x, y, num, den = F.col(f"{a}_size"), F.col(f"{b}_size"), self.bands.num, self.bands.den
        near = (F.least(x, y) * den >= num * F.greatest(x, y)) & (differ * (den + num) <= (x + y) * (den - num))
        return F.coalesce(near, F.lit(True))

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(links, components): links (a, b) between representatives of equal sets that connect whatever
        is connected, and (id, component) for representatives that link.

        Not every linked pair is among them: a group of copies is a star.  All pairs of a group
        follow from ``components()`` joined with itself on ``component_id`` and compared.
        """
        reps = self.rows.filter("n_shingles > 0 and doc_id is not null").join(
            small(self.classes.select("v1", "v2", "rep"), self.n_classes * 32), ["v1", "v2"]
        )
        self.others = self._cut(reps.filter("doc_id <> rep").select("doc_id", "rep", "v1", "v2").distinct(), "others")
        self.n_others = self.others.count()
        often = self.spark.sparkContext.broadcast(self._frequent())
        found = self._signed(often, 0)
        signed = [found]
        again, seed = found.filter("b is null and members is null").select("a"), 0
        while again.count():
            seed += 1
            more = self._signed(often, seed)
            signed.append(more)
            again = self._cut(again.intersect(more.filter("b is null and members is null").select("a")), "again")
            found = found.unionByName(more)
        # parts may have the same bucket; a row of a bucket is known by its first document
        listed = found.filter("members is not null").withColumn("at", F.get("members", F.lit(0))["m"]).dropDuplicates(["b", "at"])
        members = listed.select(F.col("b").alias("bucket"), "a", F.explode("members").alias("x")).select("bucket", "a", "x.m", "x.s")
        members = self._cut(members, "members")
        stars = found.filter("b is not null and members is null").select("a", "b").unionByName(members.filter("a <> m").select("a", F.col("m").alias("b")))
        pairs = cut(stars.distinct(), "pairs")
        stars = self._rep(pairs, "a", "b").filter("a <> b")
        stars = self._cut(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
        drop(pairs)
        self._drop(*signed)
        ids = stars.select(F.col("a").alias("rep")).union(stars.select("b")).distinct()
        wanted = self._cut(self.classes.join(ids, "rep").select(F.col("rep").alias("id"), "v1", "v2", "size", *_BITS), "ids")
        n = wanted.count() * 32
        # a doc_id with several sets is its own class several times; its pairs are left to the comparison
        self.bits = wanted.groupBy("id").agg(*[F.when(F.count("*") == 1, F.min(c)).alias(c) for c in ("size", *_BITS)])
        self.bits, self.n_bits = self._cut(self.bits, "bits"), n // 32
        self.wanted = wanted.select("id", "v1", "v2")
        named, self.several = self._twice_named()

        first = self._cut(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
        links = self._verified(first)
        links = links.unionByName(named)
        labels = self._labels(links)
        rest = stars.join(first.withColumn("done", F.lit(True)), ["a", "b"], "left").filter("done is null").drop("done")
        rest = self._cut(self._apart(rest, labels), "pairs")
        self._drop(stars, first)
        if rest.count():
            more = self._verified(rest)
            links = links.unionByName(more)
            labels = self._labels(links) if not more.isEmpty() else labels
        self._drop(rest)
        return self._settle(members, links, labels)

    def _cut(self, df: DataFrame, what: str) -> DataFrame:
        """A table that ``close`` removes."""
        self._tables.append(cut(df, what))
        return self._tables[-1]

    def _drop(self, *frames: DataFrame) -> None:
        """Remove tables that no later step reads."""
        drop(*frames)
        self._tables = [t for t in self._tables if not any(t is f for f in frames)]

    def close(self) -> None:
        """Remove the tables of all steps but the sizes; what ``links`` returned can't be read any more."""
        drop(*self._tables)
        self._tables = []

    def _labels(self, links: DataFrame) -> DataFrame:
        found = connected_components(links)
        labels = self._cut(found, "labels")
        drop(found)
        return labels

    def _twice_named(self) -> tuple[DataFrame, int]:
        """Links between the classes of one doc_id that has several sets; how many ids have several rows."""
        keyed = self.rows.filter("n_shingles > 0 and doc_id is not null")
        several = self._cut(keyed.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id"), "several")
        some = keyed.join(several, "doc_id").join(self.classes, ["v1", "v2"])
        some = some.groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("r"))
        return self._cut(some.select("a", F.explode("r").alias("b")).filter("a <> b"), "named"), several.count()

    def _apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs whose ends aren't connected yet."""
        side = small(labels, labels.count() * 24)
        for c in ("a", "b"):
            name = side.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in"))
            pairs = pairs.join(name, c, "left").withColumn(f"{c}_in", F.coalesce(f"{c}_in", c))
        return pairs.filter("a_in <> b_in").select("a", "b")

    def _settle(self, members: DataFrame, links: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Compare what is left: in rounds, the least documents that probe of each bucket that isn't in one
        component against its others in other components that sizes and parities don't rule out; then they leave the bucket.  A
        bucket stays in rows, and each task keeps only its least documents to find them, so none is ever gathered."""
        buckets = self._rep(members.select("bucket", "m", "s"), "m").groupBy("bucket", "m").agg(F.max("s").alias("s"))
        buckets, tried, most = self._cut(buckets, "members"), None, LEADERS
        self._drop(members, self.others)
        probes = F.col("s") % 2 == 1
        while True:
            side = small(labels.withColumnRenamed("id", "m"), labels.count() * 24)
            now = buckets.join(side, "m", "left").withColumn("component", F.coalesce("component", "m"))
            ends = now.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max(F.col("s") % 2).alias("p"))
            open_ = self._cut(ends.filter("x <> y and p = 1").select("bucket"), "open")
            n = open_.count()
            if not n:
                return links, labels
            held = now.join(small(open_, n * 16), "bucket", "left_semi").select("bucket", "m", "s", "component")
            held = self._cut(held if tried is not None else self._merged(held), "held")
            place = F.row_number().over(Window.partitionBy("bucket").orderBy("m"))
            lead = held.filter(probes).withColumn("place", place).filter(F.col("place") <= most)
            lead = lead.select("bucket", F.col("m").alias("a"), F.col("component").alias("of"))
            lead = self._cut(self._with_bits(lead, "a"), "leaders")
            n = lead.count()
            pairs = self._near_sizes(self._with_bits(held, "m"), lead, n)
            pairs = pairs.filter("of <> component").filter(self._alike("a", "m"))
            pairs = pairs.select(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = self._cut(pairs, "pairs")
            tried = pairs if tried is None else tried.unionByName(pairs)
            if pairs.count():
                more = self._verified(pairs)
                links = links.unionByName(more)
                labels = self._labels(links) if not more.isEmpty() else labels
            gone = small(lead.select("bucket", F.col("a").alias("m")), n * 24)
            left = self._cut(held.select("bucket", "m", "s").join(gone, ["bucket", "m"], "left_anti"), "members")
            self._drop(buckets, open_, held, lead)
            buckets, most = left, most * 4

    def _merged(self, held: DataFrame) -> DataFrame:
        """Open buckets with one least document as one bucket of all their documents, where that has no more pairs than they have.

        A passage that documents share fills many segments, and each gives a bucket of most of these documents: the same pairs once for
        each segment.  The merged bucket has every pair of its parts, and as its documents all meet the least one, it doesn't go on to others.
        """
        held = self._cut(held, "unmerged")
        parts = self._cut(held.groupBy("bucket").agg(F.min("m").alias("least"), F.count("*").alias("n")), "parts")
        side = small(parts.select("bucket", "least"), parts.count() * 24)
        whole = held.join(side, "bucket").groupBy("least", "m").agg(F.max("s").alias("s"), F.min("component").alias("component"))
        whole = self._cut(whole, "whole")
        pairs = parts.groupBy("least").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
        fewer = whole.groupBy("least").agg(F.count("*").alias("n")).join(pairs, "least").filter(F.col("n") * F.col("n") <= F.col("pairs"))
        fewer = self._cut(fewer.select("least"), "fewer")
        n = fewer.count() * 16
        merged = whole.join(small(fewer, n), "least", "left_semi").select(F.col("least").alias("bucket"), "m", "s", "component")
        gone = parts.join(small(fewer, n), "least", "left_semi").select("bucket")
        return held.join(small(gone, parts.count() * 16), "bucket", "left_anti").unionByName(merged)

    def _near_sizes(self, held: DataFrame, lead: DataFrame, n: int) -> DataFrame:
        """Leaders of buckets with those of its documents whose sets are of a size that can link: a leader meets three
        steps of size, each as wide as the threshold, not the whole bucket."""
        width = max(log(self.bands.den / self.bands.num) * 1.0001, 1e-6)
        step = lambda size: F.floor(F.log(size) / width)
        near = F.explode(F.array(*[step(F.col("a_size")) + k for k in (-1, 0, 1)], F.lit(-9).cast("long")))
        by_size = lead.filter("a_size is not null").withColumn("step", near)
        pairs = held.withColumn("step", F.coalesce(step(F.col("m_size")), F.lit(-9))).join(small(by_size, n * 3 * (48 + 8 * PARITY)), ["bucket", "step"]).drop("step")
        # an id with several sets has no one size and meets all
        return pairs.unionByName(held.join(small(lead.filter("a_size is null"), n * (32 + 8 * PARITY)), "bucket").select(*pairs.columns))

    def components(self) -> DataFrame:
        """doc_id, n_shingles and component_id (least document reachable by links) of every row."""
        _, labels = self.links()
        reps = self.classes.select("v1", "v2", "rep")
        named = cut(
            reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
                "v1", "v2", F.coalesce("component", "rep").alias("label")
            ),
            "named",
        )
        self.close()
        side = small(named, self.n_classes * 32)
        return self.rows.join(side, ["v1", "v2"], "left").select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("label")))
            .otherwise(F.col("doc_id"))
            .alias("component_id"),
        )


def op1_jaccard_join(docs: DataFrame) -> DataFrame:
    return JaccardJoin(docs).components()


ORACLE = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w from documents),
s as materialized (
  select distinct doc_id, md5(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) as t
  from d, unnest(range(1, len(w) - least(5, len(w)) + 2)) as r(i) where len(w) > 0),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
both_ as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y using (t)
  where x.doc_id < y.doc_id group by all),
link as materialized (
  select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * c >= 75 * (x.n + y.n - c)),
edge as materialized (select a, b from link union all select b, a from link),
reach(a, b) as (select a, a from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
low as (select a, min(b) as c from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(c, doc_id) as component_id
from documents left join n using (doc_id) left join low on low.a = doc_id
"""
