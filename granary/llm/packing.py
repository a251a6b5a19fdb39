"""Token ids packed into rows of fixed length by best-fit decreasing, written as id matrices.

Documents are encoded, and documents longer than a row are split, without loss, into pieces of
at most a row.  Pieces are taken from long to short, and each goes to the row whose free
space is the least that suffices, found in a segment tree over free capacities.  A task
packs buffers of at most ``buffer_rows`` rows' worth of ids, as they come: nothing is shuffled,
no task holds more than a buffer, and a lost task packs the same rows again.  Best fit thus sees
a buffer, and the last buffer of a task is packed for itself: which pieces share a row follows
from the file layout, and many small partitions leave more rows that aren't full.

``PackedMatrix`` writes the rows as binary files: the padded id matrix, the cumulative segment
lengths, and the positions at which segments begin anew.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .common import bound_batches, tidy

ROW, BUFFER_ROWS = 2_048, 1_024
#: A run of white space longer than this is no matter for the pattern's engine, which tracks back over it.
LONG_SPACE = 256
_SPACE = re.compile(rf"\s{{{LONG_SPACE},}}")

SCHEMA = (
    "row_sha256 string, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<long>, piece_starts array<int>"
)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Texts to ids with the tiktoken library.

    ``separator``: the id after the last of the vocabulary.  ``kind``: the narrowest unsigned type
    that holds it, 16 or 32 bits.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.code = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.separator = max(ranks.values()) + 1
        self.kind = np.dtype("<u2" if self.separator < 1 << 16 else "<u4")

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, without a separator.

        The pattern takes a run of white space but for its last character as one pre-token, if
        something follows; so the text may be cut there, and such a run is merged as it is.
        """
        parts, at = [], 0
        for m in _SPACE.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            parts += [self.code.encode_to_numpy(text[at : m.start()], disallowed_special=()), self.code._encode_single_piece(text[m.start() : end])]
            at = end
        parts.append(self.code.encode_to_numpy(text[at:], disallowed_special=()))
        return np.concatenate(parts).astype(self.kind)


@cache
def encoder(path: str) -> Encoder:
    """One for each vocabulary and worker process."""
    return Encoder(path)


def encoding(path: str):
    return encoder(path).code


def __getattr__(name: str):
    if name == "SEPARATOR":
        return encoder(default_ranks()).separator
    raise AttributeError(name)


class CapacityTree:
    """Segment tree over capacities 0 .. most: how many rows have each free space."""

    def __init__(self, most: int):
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def put(self, row: int, free: int) -> None:
        self.rows.setdefault(free, []).append(row)
        k = free + self.leaves
        while k:
            self.count[k] += 1
            k //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """Take out a row with the least free space that is at least ``need``."""
        k = need + self.leaves
        if not self.count[k]:
            while k > 1 and (k % 2 or not self.count[k + 1]):
                k //= 2
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        free = k - self.leaves
        while k:
            self.count[k] -= 1
            k //= 2
        return self.rows[free].pop(), free


def best_fit_decreasing(sizes: np.ndarray, row: int) -> list[list[int]]:
    """Indices of the pieces in each row, every piece once, each row's in input order."""
    tree, rows = CapacityTree(row), []
    for i in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        size = int(sizes[i])
        if (got := tree.take(size)) is None:
            got = len(rows), row
            rows.append([])
        rows[got[0]].append(i)
        tree.put(got[0], got[1] - size)
    return [sorted(r) for r in rows]


def pack_buffer(docs: list[tuple[int | None, int, np.ndarray]], row: int) -> Iterator[tuple]:
    """Rows of SCHEMA from (doc_id, token at which the ids start, ids)."""
    pieces = [(d, at + s, ids[s : s + row]) for d, at, ids in docs for s in range(0, len(ids), row)]
    for members in best_fit_decreasing(np.array([len(p[2]) for p in pieces], dtype=np.int64), row):
        ids = np.concatenate([pieces[i][2] for i in members])
        sizes = np.array([len(pieces[i][2]) for i in members])
        cu = np.r_[0, np.cumsum(sizes)]
        position = (np.arange(len(ids)) - np.repeat(cu[:-1], sizes)).astype("<u2")
        yield (
            hashlib.sha256(ids.tobytes()).hexdigest(), len(ids), ids.tobytes(), cu.astype(np.int32), position.tobytes(),
            [pieces[i][0] for i in members], [pieces[i][1] for i in members],
        )


def pack(docs: DataFrame, ranks: str | None = None, row: int = ROW, buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """Packed rows of the token ids of every text.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Every document's ids end
    with the separator.  ``ids`` are unsigned little-endian, of 16 bits if the vocabulary and its
    separator fit and else of 32; ``position_ids``, of 16 bits, restart at 0 with each piece;
    ``cu_seqlens`` are the pieces' limits; the i-th piece is from ``doc_ids[i]`` and starts at its token
    ``piece_starts[i]``.  A null or empty text is its separator alone; a null id stays null; rows
    that repeat are packed each; an empty table gives no rows.
    """
    if not 0 < row < 1 << 16:
        raise ValueError("row must be from 1 to 65535")
    bound_batches(docs.sparkSession)
    path = ranks or default_ranks()
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def out(held: list) -> Iterator[pa.RecordBatch]:
        rows = list(pack_buffer(held, row))
        for i in range(0, len(rows), 256):
            columns = zip(*rows[i : i + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, full = [], 0, row * buffer_rows
        code = encoder(path)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = np.append(code.encode(text.as_py() or ""), code.kind.type(code.separator))
                for s in range(0, len(ids), full):  # one text may fill more than a buffer
                    part = ids[s : s + full]
                    held.append((doc.as_py(), s, part))
                    n += len(part)
                    if n >= full:
                        yield from out(held)
                        held, n = [], 0
        if held:
            yield from out(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote."""

    name: str
    rows: int


class PackedMatrix(DataSource):
    """Sink of packed rows.  Options: ``path`` (a folder that executors write to, as pyarrow names file
    systems), ``row``, ``width`` (bytes of an id) and ``pad`` (the id after a row's end).

    Each task writes four files of its own name: ``.ids`` (rows by ``row`` ids), ``.cu`` (the limits of
    the segments, 32 bits, from 0 to the row's length for each row), ``.at`` (64 bits: where each row's
    limits begin in ``.cu``) and ``.reset`` (64 bits: the places in the matrix, counted in ids, at which
    position ids restart; each row's padding is the last).  ``index.json``, written at the end, names
    what tasks that succeeded wrote; files of others are left out of it and removed.
    """

    @classmethod
    def name(cls) -> str:
        return "packed_matrix"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _MatrixWriter(self.options["path"], int(self.options["row"]), int(self.options["width"]), int(self.options["pad"]))


class _MatrixWriter(DataSourceArrowWriter):
    def __init__(self, path: str, row: int, width: int, pad: int):
        self.path, self.row, self.width, self.pad = path, row, width, pad

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root)
        name, n, limits = f"part-{uuid.uuid4().hex}", 0, 0
        ends = ("ids", "cu", "at", "reset")
        files = {e: store.open_output_stream(f"{root}/{name}.{e}") for e in ends}
        for batch in batches:
            for ids, cu in zip(batch.column("ids"), batch.column("cu_seqlens"), strict=True):
                raw, cu = ids.as_py(), cu.values.to_numpy()
                have = len(raw) // self.width
                files["ids"].write(raw + self.pad.to_bytes(self.width, "little") * (self.row - have))
                files["cu"].write(cu.astype("<i4").tobytes())
                files["at"].write(np.int64(limits).tobytes())
                resets = cu if have < self.row else cu[:-1]
                files["reset"].write((n * self.row + resets.astype(np.int64)).astype("<i8").tobytes())
                n, limits = n + 1, limits + len(cu)
        for f in files.values():
            f.close()
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        done = {m.name: m.rows for m in messages if m is not None}
        for info in store.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith("part-") and info.base_name.split(".")[0] not in done:
                store.delete_file(info.path)
        said = {"row": self.row, "width": self.width, "pad": self.pad, "parts": done}
        with store.open_output_stream(f"{root}/index.json") as f:
            f.write(json.dumps(said).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for e in ("ids", "cu", "at", "reset") if m is not None else ():
                store.delete_file(f"{root}/{m.name}.{e}")


def write_packed(packed: DataFrame, path: str, ranks: str | None = None, row: int = ROW) -> None:
    """Packed rows, of at most ``row`` ids, as binary files below ``path`` (see PackedMatrix)."""
    code = encoder(ranks or default_ranks())
    packed.sparkSession.dataSource.register(PackedMatrix)
    options = {"path": path, "row": row, "width": code.kind.itemsize, "pad": code.separator}
    packed.write.format("packed_matrix").options(**options).mode("append").save()


def read_packed(path: str) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """(id matrix, limits of each row's segments, resets) of each part that was written."""
    store, root = fs.FileSystem.from_uri(path)
    load = lambda name: store.open_input_file(f"{root}/{name}").readall()
    said = json.loads(load("index.json"))
    for name, n in sorted(said["parts"].items()):
        ids = np.frombuffer(load(f"{name}.ids"), dtype=f"<u{said['width']}").reshape(n, said["row"])
        cu, at = np.frombuffer(load(f"{name}.cu"), "<i4"), np.frombuffer(load(f"{name}.at"), "<i8")
        yield ids, np.split(cu, at[1:]) if n else [], np.frombuffer(load(f"{name}.reset"), "<i8")


def op2_packing(docs: DataFrame) -> DataFrame:
    return pack(docs).select(
        "row_sha256",
        "n_tokens",
        "cu_seqlens",
        "doc_ids",
        "piece_starts",
        F.sha2("position_ids", 256).alias("positions_sha256"),
    )
