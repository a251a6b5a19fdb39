"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

Every window of ``window`` consecutive words of a benchmark item is a pattern; an item with
fewer words is one pattern.  Patterns of one length make a search group with

* a shift table over hashed blocks of two words: how far the search may jump because the
  block at the end of the current window ends no pattern, or ends none nearer.  It has at
  least SPARSE slots for each block, so most blocks of a text that isn't in the benchmark let
  the search jump, whatever the benchmark's size;
* buckets of patterns by the hash of their last block, refined by their first block;
* a direct comparison of the words' bytes for what is left.

A pattern is an offset into the benchmark's words, which are kept once, so a group holds some
20 bytes a word.  Texts are cut into lanes of equal length that overlap by a pattern less one word, and all
lanes of a block of texts jump at once, each by its own shift.  The benchmark is broadcast
in shards whose size as sent is measured and held to a bound; more shards mean more passes over the documents, which
are written once with a number and searched for their hits alone.  Documents are not shuffled
but for those with hits in such passes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .common import bound_batches, cut, small, tidy

WINDOW = 10
LANE = 256
#: Bytes of benchmark text in a shard, and the most that a shard may have as it is sent.
SHARD_BYTES, SENT_BYTES = 16 << 20, 64 << 20
#: Slots of a shift table for each block of words, and the bounds of its size.
SPARSE, LEAST_BITS, MOST_BITS = 3, 12, 24

ADDED = ["n_words", "hit_start", "hit_end", "items"]
_KINDS = "n_words long, hit_start array<int>, hit_end array<int>, items array<string>"


@dataclass
class Benchmark:
    """Words of all items of a shard: ``raw`` holds them with a space after each, ``start`` where each begins (and
    the end); ``item_at`` is the first word of each item of ``names``."""

    raw: bytes
    start: np.ndarray
    item_at: np.ndarray
    names: list[str]

    def text(self, at: int, n: int) -> bytes:
        return self.raw[self.start[at] : self.start[at + n] - 1]

    def item(self, at: int) -> str:
        return self.names[int(np.searchsorted(self.item_at, at, side="right")) - 1]


def _block(hashes: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends at each word ``end``."""
    return tk.mix(sum(hashes[end - i] * np.uint64(2 * i + 3) for i in range(size)))


class SearchGroup:
    """Patterns of one length in words, each by the number of its first word in ``words``."""

    def __init__(self, length: int, words: Benchmark, hashes: np.ndarray, at: np.ndarray):
        self.length, self.block, self.words = length, min(2, length), words
        n_blocks = len(at) if length < 4 else int(np.minimum(len(at) + length, len(hashes)))
        self.bits = int(np.clip(np.ceil(np.log2(max(1, SPARSE * n_blocks))), LEAST_BITS, MOST_BITS))
        far = length - self.block + 1
        self.shift = np.full(1 << self.bits, far, dtype=np.uint8 if far < 256 else np.int64)
        for k in range(far):
            slot = self._slot(_block(hashes, at + self.block - 1 + k, self.block))
            self.shift[slot] = np.minimum(self.shift[slot], far - 1 - k)
        key = self._key(_block(hashes, at + length - 1, self.block), _block(hashes, at + self.block - 1, self.block))
        order = np.argsort(key, kind="stable")
        self.keys, self.at = key[order], at[order].astype(np.int32)

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _key(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        """32 bits of a pattern's last and first block; the comparison decides."""
        return (tk.mix(last + first * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)

    def find(self, b: tk.Block) -> tuple[np.ndarray, list[str]]:
        """(first word, item) of every occurrence in a block of documents."""
        m, h = self.length, b.hash
        per_doc = np.where(b.words >= m, -(-(b.words - m + 1) // LANE), 0)
        doc = np.repeat(np.arange(b.n_docs), per_doc)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        pos = b.at[:-1][doc] + nth * LANE + m - 1
        limit = np.minimum(b.at[1:][doc], pos + LANE)
        found_at, found = [], []
        while len(pos):
            block = _block(h, pos, self.block)
            jump = self.shift[self._slot(block)].astype(np.int64)
            end = pos[jump == 0]
            if len(end):
                key = self._key(block[jump == 0], _block(h, end - m + self.block, self.block))
                lo, hi = np.searchsorted(self.keys, key, side="left"), np.searchsorted(self.keys, key, side="right")
                for e, x, y in zip(end[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                    s = e - m + 1
                    spans = zip(b.start[s : e + 1].tolist(), b.end[s : e + 1].tolist(), strict=True)
                    text = b" ".join(b.raw[u:v].tobytes() for u, v in spans)
                    items = {self.words.item(p) for p in self.at[x:y].tolist() if self.words.text(p, m) == text}
                    found_at += [s] * len(items)
                    found += sorted(items)
            pos = pos + np.maximum(jump, 1)
            on = pos < limit
            pos, limit = pos[on], limit[on]
        return np.array(found_at, dtype=np.int64), found


def build_groups(rows: list[tuple[str, str | None]], window: int) -> list[SearchGroup]:
    """Search groups of the items (id, text)."""
    raw, size, hashes, per_item = [], [], [], []
    for b in tk.blocks(pa.array([t for _, t in rows], pa.string()), tk.ALNUM, True):
        length = b.end - b.start
        to = np.cumsum(length + 1) - (length + 1)
        out = np.full(int((length + 1).sum()), 0x20, dtype=np.uint8)
        inside = np.repeat(to - b.start, length) + _spread(b.start, length)
        out[inside] = b.raw[_spread(b.start, length)]
        raw.append(out.tobytes())
        size.append(length + 1)
        hashes.append(b.hash)
        per_item.append(b.words)
    if not raw:
        return []
    h, n = np.concatenate(hashes), np.concatenate(per_item)
    item_at = np.r_[0, np.cumsum(n)[:-1]]
    full = n > 0
    start = np.r_[0, np.cumsum(np.concatenate(size))].astype(np.int64 if sum(map(len, raw)) >= 1 << 31 else np.int32)
    words = Benchmark(b"".join(raw), start, item_at[full].astype(np.int32), [i for (i, _), f in zip(rows, full, strict=True) if f])
    groups = []
    for m in sorted(set(np.minimum(n[full], window).tolist())):
        mine = full & (np.minimum(n, window) == m)
        at = _spread(item_at[mine], n[mine] - m + 1)
        groups.append(SearchGroup(m, words, h, at))
    return groups


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + n[i] - 1 of all i."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans with the same union."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]


def _hits(groups: list[SearchGroup], text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """(number of words, first words and ends of disjoint spans, item ids) of each text."""
    for b in tk.blocks(text, tk.ALNUM, True):
        found = [(g, *g.find(b)) for g in groups]
        at = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        end = np.concatenate([f[1] + f[0].length for f in found]) if found else at
        names = [n for f in found for n in f[2]]
        doc = np.searchsorted(b.at, at, side="right") - 1
        order = np.argsort(doc, kind="stable")
        bound = np.searchsorted(doc[order], np.arange(b.n_docs + 1))
        for d in range(b.n_docs):
            mine = order[bound[d] : bound[d + 1]]
            yield int(b.words[d]), *_merge(at[mine] - b.at[d], end[mine] - b.at[d]), sorted({names[i] for i in mine.tolist()})


def _columns(hits: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
    return [pa.array(c, k) for c, k in zip(zip(*hits, strict=True) if hits else [[]] * 4, kinds, strict=True)]


def _scan(groups_of):
    """All rows of a batch with ADDED."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = list(_hits(groups_of.value, batch.column(batch.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(hits)], names=[*batch.schema.names, *ADDED])

    return scan


def _scan_hits(groups_of):
    """``_row`` and spans and items of the rows that have hits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = list(_hits(groups_of.value, batch.column("text")))
            on = [i for i, h in enumerate(hits) if len(h[1])]
            columns = _columns([hits[i] for i in on])[1:]
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(on, pa.int64())), *columns], names=["_row", *ADDED[1:]])

    return scan


def shards_of(items: DataFrame, window: int, shard_bytes: int, sent_bytes: int = SENT_BYTES) -> Iterator[list[SearchGroup]]:
    """Search groups of the items (item_id, text), so many at a time that a shard has about ``shard_bytes`` of text
    and never more than ``sent_bytes`` as it is sent; one item that alone has more is an error."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    todo = [(i, n) for n in [-(-size // shard_bytes) or 1] for i in range(n)]
    while todo:
        i, n = todo.pop(0)
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows = [(r.item_id, r.text) for r in part.toLocalIterator()]
        groups = build_groups(rows, window)
        if len(pickle.dumps(groups)) <= sent_bytes:
            yield groups
        elif len(set(rows)) == 1:
            raise ValueError("an item of the benchmark is too large to be sent")
        else:
            todo[:0] = [(i, 2 * n), (i + n, 2 * n)]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Occurrences of benchmark windows in documents.

    ``docs`` needs ``text`` and keeps all its columns but those named like an added one;
    ``benchmark`` needs ``item_id`` and ``text``.  One row per input row; added are ``n_words``, the
    disjoint word spans ``hit_start[i]:hit_end[i]`` that occurrences cover, and ``items``, the sorted ids
    (as text) of the items that occur.  Null and empty texts have no words and no hits; items
    without words, or with a null id, match nothing; items that repeat count once; an empty
    benchmark hits nothing.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.drop(*ADDED)
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(_KINDS).fields])
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).filter(
        "item_id is not null and text is not null"
    )
    shards = shards_of(items, window, shard_bytes)
    first, second = next(shards), next(shards, None)
    if second is None:
        return docs.mapInArrow(tidy(_scan(spark.sparkContext.broadcast(first))), schema)
    return _in_passes(spark, docs, schema, [first, second], shards)


def _in_passes(spark: SparkSession, docs: DataFrame, schema: T.StructType, begun: list, shards: Iterator) -> DataFrame:
    """The same with a pass for each shard: numbered documents are written once, passes write hits only."""
    none = spark.sparkContext.broadcast([])
    rows = docs.select(F.struct("*").alias("_all"), "text", F.monotonically_increasing_id().alias("_row"))
    counted = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(_KINDS).fields])
    base = cut(rows.mapInArrow(tidy(_scan(none)), counted).drop(*ADDED[1:]), "numbered")
    hits = None
    while begun:
        shared = spark.sparkContext.broadcast(begun.pop(0))
        kinds = "_row long, hit_start array<int>, hit_end array<int>, items array<string>"
        part = cut(base.select("_row", "text").mapInArrow(tidy(_scan_hits(shared)), kinds), "hits")
        shared.destroy()
        hits = part if hits is None else hits.unionByName(part)
        if not begun and (more := next(shards, None)) is not None:
            begun.append(more)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_start", "hit_end"))))
    united = hits.groupBy("_row").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # sorted spans are united where one begins before, or where, the last one ends
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["e"] >= x["hit_start"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["s"].alias("s"), F.greatest(F.element_at(a, -1)["e"], x["hit_end"]).alias("e")))),
        ).otherwise(F.concat(a, F.array(F.struct(x["hit_start"].alias("s"), x["hit_end"].alias("e"))))),
    )
    united = cut(united.select("_row", merged.alias("spans"), "items"), "united")
    size = united.agg(F.sum(F.size("spans") * 8 + F.size("items") * 24 + 48)).first()[0] or 0
    out = base.join(small(united, size), "_row", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return out.select(
        *[F.col("_all")[c].alias(c) for c in docs.columns], "n_words",
        none(F.col("spans.s"), "int").alias("hit_start"), none(F.col("spans.e"), "int").alias("hit_end"), none(F.col("items"), "string").alias("items"),
    )


def op6_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = decontaminate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    n_hit = F.aggregate(
        F.zip_with("hit_start", "hit_end", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y
    )
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
with d as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select cast(item_id as varchar) as item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
win as (
  select distinct item, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as t
  from b, unnest(range(1, len(w) - least(10, len(w)) + 2)) as r(i) where len(w) > 0),
sizes as (select distinct n from win),
dw as (
  select rid, n, i, array_to_string(w[i : i + n - 1], ' ') as t
  from d, sizes, unnest(range(1, len(w) - n + 2)) as r(i) where len(w) >= n),
hit as (select rid, dw.n, i, item from dw join win on dw.n = win.n and dw.t = win.t),
words as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from hit) group by rid),
its as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as l
  from (select distinct rid, item from hit) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (rid) left join its using (rid)
"""
