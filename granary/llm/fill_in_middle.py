"""Fill-in-the-middle: documents cut in three and written out in another order.

The tokenizers library's ``Split`` pre-tokenizer, with isolated matches of a pattern that covers
every text, gives the code-point offsets of the units; nothing is trained.  The number of offsets is n, and
the offsets at two ranks are the cuts.  Ranks and forms follow from a hash of the document's id, so a
lost task cuts the same places again, and no row needs another: the plan has no exchange.

Long texts go through the pre-tokenizer in slices of about ``SLICE`` code points that end where a
unit ends, so what a task holds beyond the text and its output is one slice's offsets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.types import LongType as Long
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .common import bound_batches, tidy

SEED = 42
#: Percentages: of documents that are reordered at all, and of those the ones whose suffix comes first.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit is a word with the white space before it, or white space at the end.  Possessive: no tracking back over long runs.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
SLICE = 1 << 15
_UNIT_END = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
_MARKER = re.compile("<[PSM]>")
ADDED = StructType(
    [StructField("n", Long()), StructField("form", StringType()), StructField("prefix_chars", Long()), StructField("middle_chars", Long()), StructField("output", StringType())]
)


def slices(text: str) -> Iterator[tuple[int, str]]:
    """(place, slice) of a text: slices end where a unit ends."""
    at = 0
    while len(text) - at > SLICE:
        end = _UNIT_END.search(text, at + SLICE - 1)
        if end is None:
            break
        yield at, text[at : end.end()]
        at = end.end()
    if at < len(text):
        yield at, text[at:]


def unit_ends(text: str, split: Split, ranks: tuple[int, ...] = ()) -> tuple[int, list[int]]:
    """Number of units, and where the units of the given rising ranks (from 1; 0 is the start of the text) end."""
    n, found = 0, [0 for r in ranks if r == 0]
    for at, piece in slices(text):
        offsets = split.pre_tokenize_str(piece)
        found += [at + offsets[r - n - 1][1][1] for r in ranks if n < r <= n + len(offsets)]
        n += len(offsets)
    return n, found


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 for an id; a null id is the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def _reordered(seed: int, rate: int, spm_rate: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Split(Regex(UNIT), behavior="isolated")
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for doc_id, cell in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = cell.as_py() or ""
                h1, h2, h3, h4 = draws(seed, doc_id)
                n, _ = unit_ends(text, split)
                row: tuple = (n, "plain", None, None, text)
                if text and h3 % 100 < rate and not _MARKER.search(text):
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    _, (i, j) = unit_ends(text, split, (a, b))
                    prefix, middle, suffix = text[:i], text[i:j], text[j:]
                    if h4 % 100 < spm_rate:
                        row = (n, "spm", i, j - i, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
                    else:
                        row = (n, "psm", i, j - i, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")
                for values, value in zip(columns, row, strict=True):
                    values.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            arrays = [batch.column(c) for c in names] + [pa.array(v, k) for v, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *ADDED.names])

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """All columns of ``docs`` (``doc_id``, an integer, ``text`` and any others) with ``n``, the units of the text, ``form``
    (``plain``, ``psm`` or ``spm``), ``prefix_chars`` and ``middle_chars`` (code points; null in plain rows) and ``output``.
    Columns of these names are replaced.

    A null text counts as empty, and empty texts and texts that hold a marker stay plain; a null id draws as the
    empty text does; rows that repeat an id draw alike, and rows that repeat altogether give equal rows;
    an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    rows = docs.drop(*ADDED.names)
    schema = StructType(rows.schema.fields + ADDED.fields)
    return rows.mapInArrow(tidy(_reordered(seed, rate, spm_rate, rows.columns)), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its parts, found by the markers, in their old order."""
    part = F.split(output, "<[PSM]>", 4)
    back = F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(back)


def op11_fill_in_middle(docs: DataFrame) -> DataFrame:
    rows = fill_in_middle(docs.select("doc_id", "text")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
with u as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u from documents),
d as (
  select *, cast(len(u) as bigint) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from u),
f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form from d),
p as (
  select *, coalesce(array_to_string(u[1:a], ''), '') as prefix, coalesce(array_to_string(u[a + 1:b], ''), '') as middle,
    coalesce(array_to_string(u[b + 1:], ''), '') as suffix from f)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
  case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(case form when 'plain' then t else prefix || middle || suffix end) as restored_sha256
from p
"""
