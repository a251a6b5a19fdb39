"""Checksums that aren't reflected, of chunks, and of wholes from those of their chunks.

The checksum of A followed by B is that of A, shifted by as many zero bytes as B has, plus that of B, both without presets, over GF(2).
Shifting by n bytes is multiplication with a power of x, so every chunk is shifted for itself by what comes
behind it, and the whole is the exclusive or of all chunks in any order: an aggregate that Spark sums up before it shuffles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


@dataclass(frozen=True)
class Checksum:
    """Width in bits, polynomial without its leading term, preset, and what is added at the end."""

    width: int
    polynomial: int
    preset: int = 0
    final: int = 0

    def times(self, a: int, b: int) -> int:
        """Product of two polynomials, reduced."""
        out, top, mask = 0, 1 << (self.width - 1), (1 << self.width) - 1
        while b:
            if b & 1:
                out ^= a
            a = ((a << 1) & mask) ^ (self.polynomial if a & top else 0)
            b >>= 1
        return out

    def zeros(self, n: int) -> int:
        """The factor that stands for ``n`` zero bytes: x to the power of 8n."""
        out, square = 1, self.times(1 << 4, 1 << 4)
        while n:
            if n & 1:
                out = self.times(out, square)
            square, n = self.times(square, square), n >> 1
        return out

    def plain(self, data: bytes) -> int:
        """Of a chunk, without preset and final."""
        if (self.width, self.polynomial) == (32, 0x04C11DB7):  # the reflected one of the standard library, of mirrored bytes
            return int(f"{zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)
        lanes = max(1, min(1 << 12, len(data) // 64))
        size = len(data) // lanes
        body = np.frombuffer(data[: size * lanes], np.uint8).reshape(lanes, size)
        table, crc, shift = _table(self), np.zeros(lanes, np.int64), self.width - 8
        for k in range(size):  # all lanes go on by a byte
            crc = ((crc << 8) & ((1 << self.width) - 1)) ^ table[(crc >> shift) ^ body[:, k]]
        whole, step = 0, self.zeros(size)
        for c in crc.tolist():
            whole = self.times(whole, step) ^ c
        for b in data[size * lanes :]:
            whole = ((whole << 8) & ((1 << self.width) - 1)) ^ int(table[(whole >> shift) ^ b])
        return whole

    def whole(self, plain: int, n: int) -> int:
        """With preset and final, for ``n`` bytes."""
        return plain ^ self.times(self.preset, self.zeros(n)) ^ self.final


def _table(c: Checksum) -> np.ndarray:
    top, mask, out = 1 << (c.width - 1), (1 << c.width) - 1, []
    for b in range(256):
        x = b << (c.width - 8)
        for _ in range(8):
            x = ((x << 1) & mask) ^ (c.polynomial if x & top else 0)
        out.append(x)
    return np.array(out, dtype=np.int64)


#: Of Ogg pages, and the one of 16 bits with preset and final ones.
OGG = Checksum(32, 0x04C11DB7)
SIXTEEN = Checksum(16, 0x1021, 0xFFFF, 0xFFFF)


def chunked(df: DataFrame, key: str, column: str, chunk: int) -> DataFrame:
    """(key, at, data, behind): chunks of the bytes of a column, and how many bytes come behind each; an empty value is one empty chunk, a null none."""
    rows = df.select(key, F.col(column).cast("binary").alias("_v")).filter("_v is not null").withColumn("_n", F.octet_length("_v").cast("long"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_n") - 1, F.lit(0).cast("long")), F.lit(chunk).cast("long")))
    rows = rows.select(key, "_v", "_n", at.alias("at"))
    behind = F.greatest(F.col("_n") - F.col("at") - chunk, F.lit(0).cast("long"))
    return rows.select(key, "at", F.expr(f"substring(_v, cast(at as int) + 1, {chunk})").alias("data"), behind.alias("behind"))


def checksum(chunks: DataFrame, key: list[str], kind: Checksum) -> DataFrame:
    """(key, n, checksum) of wholes from their chunks (key, data, behind), in any order and of any sizes.

    Each chunk is a row with its share, and shares are added by an aggregate of the JVM: no chunk waits for another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift: dict[int, int] = {}
        for batch in batches:
            share, size = [], []
            for data, behind in zip(batch.column("data"), batch.column("behind").to_pylist(), strict=True):
                value = data.as_py() or b""
                if behind not in shift:
                    if len(shift) > 1 << 14:
                        shift.clear()
                    shift[behind] = kind.zeros(behind)
                share.append(kind.times(kind.plain(value), shift[behind]))
                size.append(len(value))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], pa.array(share, pa.int64()), pa.array(size, pa.int64())], names=[*key, "share", "n"])

    rows = chunks.select(*key, "data", "behind")
    schema = rows.select(*key, F.lit(0).cast("long").alias("share"), F.lit(0).cast("long").alias("n")).schema
    total = rows.mapInArrow(run, schema).groupBy(*key).agg(F.sum("n").alias("n"), F.bit_xor("share").alias("_plain"))
    if not kind.preset:
        return total.select(*key, "n", F.col("_plain").bitwiseXOR(F.lit(kind.final)).alias("checksum"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [kind.whole(p, n) for p, n in zip(batch.column("_plain").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], batch.column("n"), pa.array(out, pa.int64())], names=[*key, "n", "checksum"])

    return total.mapInArrow(finish, total.withColumnRenamed("_plain", "checksum").select(*key, "n", "checksum").schema)
