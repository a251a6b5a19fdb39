"""Integers in binary columns, pitches, hashes and durations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def big_endian(data: Column, offset: int, width: int) -> Column:
    """Unsigned integer of ``width`` bytes (at most 7) at ``offset``; null if the bytes end before."""
    part = F.substring(data, offset + 1, width)
    return F.when(F.octet_length(part) == width, F.conv(F.hex(part), 16, 10).cast("long"))


def little_endian(data: Column, offset: int, width: int) -> Column:
    """Bytes are put in order one by one, as ``reverse`` takes binary for UTF-8 text."""
    digits = F.concat(*[F.hex(F.substring(data, offset + 1 + i, 1)) for i in reversed(range(width))])
    return F.when(F.length(digits) == 2 * width, F.conv(digits, 16, 10).cast("long"))


def likely_big(data: Column, offset: int, width: int) -> Column:
    """A field is taken as big-endian if that reading is the smaller one."""
    return little_endian(data, offset, width) > big_endian(data, offset, width)


def sane_rate(rate: Column) -> Column:
    """Whether a header's sample rate may be one: 4,000 to 96,000 Hz."""
    return F.coalesce(rate.between(4_000, 96_000), F.lit(False))


def pitch_to_rate(pitch: Column) -> Column:
    """Sample rate of a 12-bit fixed-point pitch relative to 48 kHz."""
    return F.floor(pitch.cast("long") * 48000 / 4096)


def to_tens(rate: Column) -> Column:
    return F.floor((rate + 5) / 10) * 10


def duration(samples: Column, rate: Column) -> Column:
    """Seconds as a double; a rate under 1 counts as 1."""
    return samples.cast("double") / F.greatest(rate, F.lit(1)).cast("double")


def clock(seconds: Column) -> Column:
    """m:ss or h:mm:ss of whole seconds."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    short = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    long_ = F.concat(h.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    return F.when(h > 0, long_).otherwise(short)


@F.pandas_udf(T.LongType())
def name_hash(names: pd.Series) -> pd.Series:
    """One-at-a-time hash (32 bits) of lower-case names; all names of a batch step together."""
    data = [(n or "").lower().encode() for n in names]
    size = np.array([len(d) for d in data])
    h = np.zeros(len(data), dtype=np.uint32)
    wide = np.zeros((len(data), int(size.max(initial=0))), dtype=np.uint32)
    for i, d in enumerate(data):
        wide[i, : len(d)] = np.frombuffer(d, np.uint8)
    for k in range(wide.shape[1]):
        x = h + wide[:, k]
        x = x + (x << np.uint32(10))
        h = np.where(k < size, x ^ (x >> np.uint32(6)), h)
    h = h + (h << np.uint32(3))
    h = h ^ (h >> np.uint32(11))
    return pd.Series((h + (h << np.uint32(15))).astype(np.int64)).where(names.notna().to_numpy())
