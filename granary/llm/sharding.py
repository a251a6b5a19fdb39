"""Sharding by a permutation-filled lookup table (native: DataFrame functions only).

Each shard orders the slots of a table of prime size by its own permutation
``(offset + j * skip) mod size``.  The shards take turns, each claiming the first slot of its
order that is free, until the table is full: every shard gets the same number of slots to
within one, and adding or removing a shard moves few slots beside those it must.  The table
is small and of fixed size, so it is broadcast, and a row finds its shard with one hash and
one lookup; rows are never moved to be placed.
"""

from __future__ import annotations

import hashlib
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


@cache
def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> tuple[int, ...]:
    """Index of the shard of every slot.  ``slots`` must be a prime over the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must have distinct names, and there must be one")
    if slots <= len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime over the number of shards")
    at = [_number(f"{s}/offset") % slots for s in shards]
    skip = [_number(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return tuple(table)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 52 bits of the md5 of its text (null: of the empty text)."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % slots


def table_frame(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard) as a DataFrame of ``slots`` rows."""
    places = F.lit(",".join(map(str, lookup_table(shards, slots))))
    names = F.array(*map(F.lit, shards))
    rows = spark.range(1, numPartitions=1).select(F.posexplode(F.split(places, ",")).alias("slot", "place"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("place").cast("int") + 1).alias("shard"))


def place(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (columns of these names are replaced).

    Equal keys go to one shard; null keys count as an empty text and go to one shard, too; an
    empty table stays empty.  The order and number of rows don't matter.
    """
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return rows.join(F.broadcast(table_frame(df.sparkSession, shards, slots)), "slot").select(
        *[F.col(c) for c in rows.columns], "shard"
    )


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> None:
    """Write a folder ``shard=NAME`` for each shard, by tasks that each write what they read."""
    place(df, key, shards, slots).drop("slot").write.partitionBy("shard").parquet(path)


def op8_sharding(docs: DataFrame) -> DataFrame:
    return place(docs.select("doc_id"))


def oracle(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> str:
    table = ",".join(map(str, lookup_table(shards, slots)))
    names = ",".join(f"'{s}'" for s in shards)
    return f"""
with t as (select ([{table}]) as places, ([{names}]) as names),
d as (select doc_id, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint % {slots} as slot from documents)
select doc_id, slot, names[places[slot + 1] + 1] as shard from d, t
"""
