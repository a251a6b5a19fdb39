"""Exact deduplication by naming blocks.

A normalised text is cut into blocks of fixed size.  Equal blocks get one integer, their place among the
sorted distinct blocks; then adjacent names are paired and the pairs are named in the same
way, until one name is left of each document: two texts are equal if and only if their last names are,
as a name stands for one block or one pair, never for a hash.

What occurs once needs no name, and a document that holds such a block or pair leaves: it equals no
other.  A first look by 64-bit hashes finds most of these before any text is moved; the blocks that
are left are told apart by their bytes.  The distinct ones are aggregated before they are exchanged, so a block that a
third of all documents have is a row for each task.  Levels after the first carry names only, and each
holds half of the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bound_batches, cut, drop, small, tidy

#: Bytes of a block.
BLOCK = 4_096
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_ROWS = "uid long, doc_id long, text_sha256 string, hashes array<long>"


def _blocks(text: bytes, block: int) -> list[bytes]:
    """Blocks of the normalised text; the empty text is one empty block."""
    text = text.translate(_LOWER)
    return [text[k : k + block] for k in range(0, len(text), block)] or [b""]


def _hash(block: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(block, digest_size=8).digest(), "little", signed=True)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for cell in batch.column("text").cast(pa.binary()):
        yield cell.as_py() or b""


def _digests(block: int):
    """Digest and block hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, hashes = [], []
            for text in _texts(batch):
                shas.append(hashlib.sha256(text.translate(_LOWER)).hexdigest())
                hashes.append([_hash(b) for b in _blocks(text, block)])
            columns = [batch.column("uid"), batch.column("doc_id"), pa.array(shas, pa.string()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "text_sha256", "hashes"])

    return run


def _contents(block: int):
    """Every block with its hash, those of one batch once with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[bytes, int] = {}
            for text in _texts(batch):
                for b in _blocks(text, block):
                    count[b] = count.get(b, 0) + 1
            columns = [pa.array([_hash(b) for b in count], pa.int64()), pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "block", "c"])

    return run


def _located(block: int):
    """Every block with the document and place that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                sha, found = hashlib.sha256(text.translate(_LOWER)).hexdigest(), _blocks(text, block)
                n = len(found)
                columns = [
                    pa.array([doc_id] * n, pa.int64()), pa.array([sha] * n), pa.array(range(n), pa.int64()),
                    pa.array([_hash(b) for b in found], pa.int64()), pa.array(found, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_sha256", "j", "h", "block"])

    return run


def _named(groups: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``groups`` (distinct ``keys``) in the order of the keys with ``name``, a number of their own; written once."""
    rows = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(rows.withColumn("name", F.monotonically_increasing_id()), what)


def _block_names(docs: DataFrame, blocks: DataFrame, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """(uid, doc_id, j, n, name) of the blocks that occur twice or more, and the tables that it reads."""
    often = cut(blocks.groupBy("h").agg(F.count("*").alias("all")).filter("all > 1"), "often")
    contents = docs.select("text").mapInArrow(tidy(_contents(block)), "h long, block binary, c long")
    n_bytes = often.count() * 16
    if n_bytes <= BROADCAST_BYTES:  # beyond it the aggregation alone finds them, at the price of moving every block
        contents = contents.join(F.broadcast(often.select("h")), "h", "left_semi")
    names = _named(contents.groupBy("h", "block").agg(F.sum("c").alias("c")).filter("c > 1"), ["h", "block"], "names")
    # a hash that another block has, too, says nothing: its rows are looked up by their bytes
    n_names = names.count()
    totals = names.select("h", "c", "name").join(small(often, n_bytes), "h")
    doubtful = cut(totals.filter("c <> all").select("h").distinct(), "doubtful")
    known = totals.filter("c = all").select("h", "name")
    out = blocks.join(small(known, n_names * 32), "h").select("uid", "doc_id", "j", "n", "name")
    if n_doubtful := doubtful.count():
        rows = docs.mapInArrow(tidy(_located(block)), "doc_id long, text_sha256 string, j long, h long, block binary")
        places = rows.join(small(doubtful, n_doubtful * 16), "h", "left_semi").join(names, ["h", "block"])
        places = places.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), F.col("j").alias("k"), "name").distinct()
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha256") == F.col("sha")) & (F.col("j") == F.col("k"))
        out = out.unionByName(blocks.join(places, same).select("uid", "doc_id", "j", "n", "name"))
    return out, [often, names, doubtful]


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(uid, doc_id, text_sha256, keep_id, keep_uid, group_size) for every row of ``docs`` (``doc_id``, an integer, ``text``,
    and ``uid``, a number of each row that reading it again doesn't change, or no such column).

    Texts are equal if they are so after lower-casing A to Z only.  Of equal texts the row with the largest ``doc_id`` stays, of rows
    that tie one of them, the one of the largest ``uid``; a null id is less than any other.  A null text is
    an empty one, and empty texts equal each other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    uid = F.col("uid") if "uid" in docs.columns else F.monotonically_increasing_id()
    docs = docs.select(uid.alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(docs.mapInArrow(tidy(_digests(block)), _ROWS), "rows")  # uid holds from here on
    blocks = rows.select("uid", "doc_id", "text_sha256", F.size("hashes").cast("long").alias("n"), F.posexplode("hashes").alias("j", "h"))
    level, used = _block_names(docs.drop("uid"), blocks.withColumn("j", F.col("j").cast("long")), block)
    level = cut(level, "level-0")
    drop(*used)
    done, depth, tables = None, 0, [level]
    while True:
        last = level.filter("n = 1").select("uid", "doc_id", F.lit(depth).alias("depth"), "name")
        done = last if done is None else done.unionByName(last)
        at = F.shiftright("j", 1).alias("j")
        sides = [F.max(F.when(F.col("j") % 2 == k, F.col("name"))).alias(c) for k, c in ((0, "left"), (1, "right"))]
        pairs = level.filter("n > 1").groupBy("uid", "doc_id", at, "n").agg(*sides)
        # a side that isn't there is right only at the odd end of a text
        odd = (F.col("j") * 2 + 1 == F.col("n")) & F.col("right").isNull()
        pairs = pairs.withColumn("right", F.when(odd, F.lit(-1)).otherwise(F.col("right"))).filter("left is not null and right is not null")
        pairs = cut(pairs.select("uid", "doc_id", "j", F.shiftright(F.col("n") + 1, 1).alias("n"), "left", "right"), "pairs")
        if pairs.isEmpty():
            drop(pairs)
            break
        names = _named(pairs.groupBy("left", "right").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), ["left", "right"], "names")
        depth += 1
        level = cut(pairs.join(small(names, names.count() * 40), ["left", "right"]).select("uid", "doc_id", "j", "n", "name"), f"level-{depth}")
        tables.append(level)
        drop(pairs, names)
    best = F.max(F.struct("doc_id", "uid")).alias("best")
    done = cut(done, "done")
    drop(*tables)
    groups = cut(done.groupBy("depth", "name").agg(best, F.count("*").alias("group_size")).filter("group_size > 1"), "groups")
    found = done.join(small(groups, groups.count() * 56), ["depth", "name"])
    found = cut(found.select("uid", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "group_size"), "found")
    drop(done, groups)
    out = rows.drop("hashes").join(small(found, found.count() * 48), "uid", "left")
    alone = F.col("keep_uid").isNull()
    return out.select(
        "uid", "doc_id", "text_sha256", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("keep_uid", "uid").alias("keep_uid"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    )


def drop_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay (see ``identities``), with all their columns.

    The table is written once with a number for each row, as a table that is read twice may come in another order.
    """
    rows = cut(docs.select(F.struct("*").alias("row"), F.col("doc_id"), "text", F.monotonically_increasing_id().alias("uid")), "numbered")
    gone = cut(identities(rows.select("uid", "doc_id", "text"), block).filter("uid <> keep_uid").select("uid"), "copies")
    return rows.join(small(gone, gone.count() * 16), "uid", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op13_exact_dedup(docs: DataFrame) -> DataFrame:
    rows = identities(docs.select("doc_id", "text"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")


ORACLE = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from d
"""
