"""Entries inside entries: gzip and zlib members, MPEG program streams.

What is taken out becomes a file of its own in the shared folder, and a row that says where it lies.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.scratch import cut
from granary.sources import ranges

DEPTH, LEAST, MOST, MEMBERS = 3, 64, 512 << 20, 4_096
#: Packed bytes that are inflated at a time, and bytes of a stream that are looked through at a time.
PIECE = 1 << 20
#: What members begin with, by kind (fixed values of the public formats).
SIGNATURES = {"gz": [b"\x1f\x8b\x08"], "zlib": [b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda"]}
_PACKED = re.compile(rb"(?=\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda])")
PACK = b"\0\0\1\xba"
_SCHEMA = "entry long, path string, content binary"
DERIVED = f"parent long, at long, path string, size long, loc {ranges.LOC}"


def inflated(source: ranges.Source | ranges.Buffer, at: int, kind: str) -> Iterator[bytes | tuple[int, int]]:
    """Pieces of the member at a place, and at last (end, bytes in all); no such end if there is no whole member of less than MOST bytes."""
    if kind == "zlib" and int.from_bytes(source.read(at, 2), "big") % 31:
        return
    box, n, to = zlib.decompressobj(31 if kind == "gz" else 15), 0, at
    try:  # a piece at a time: most places aren't members, and fail soon
        while to < source.size and not box.eof and n < MOST:
            piece = source.read(to, min(PIECE, source.size - to))
            to += len(piece)
            while True:
                limit = min(4 * PIECE, MOST - n)
                out = box.decompress(piece, limit)
                piece, n = box.unconsumed_tail, n + len(out)
                if out:
                    yield out
                if box.eof or n >= MOST or (not piece and len(out) < limit):
                    break
        if box.eof and n < MOST:
            yield to - len(box.unused_data), n
    except zlib.error:
        return


def members(data: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    """(kind, start, end, bytes) of the gzip and zlib members in ``data``, in order, not overlapping.

    A member is taken if it inflates to between LEAST and MOST bytes; what lies inside a
    taken member is not searched.
    """
    covered, n, source = 0, 0, ranges.Buffer(data)
    for m in _PACKED.finditer(data):
        if m.start() < covered or n >= MEMBERS:
            continue
        kind = "gz" if data[m.start()] == 0x1F else "zlib"
        got = list(inflated(source, m.start(), kind))
        if got and isinstance(got[-1], tuple) and got[-1][1] >= LEAST:
            covered, n = got[-1][0], n + 1
            yield kind, m.start(), covered, b"".join(got[:-1])


def packets(source: ranges.Source | ranges.Buffer) -> Iterator[tuple[int, bytes]]:
    """(stream id, payload) of the audio packets (private 0xBD, and 0xC0 to 0xDF) of an MPEG program stream, and (0, b"") for each other packet.

    Nothing if it doesn't begin with a pack.  Codes under 0xBB, as of pictures and slices, have no length and
    are stepped over; after lost bytes the next start code within 2 KiB goes on.
    """
    at = 0
    while at + 6 <= source.size and (at or source.read(0, 4) == PACK):
        head = source.read(at, 16)
        if head[:3] != PACK[:3]:
            k = source.read(at, min(0x800, source.size - at)).find(PACK[:3])
            if k < 0:
                return
            at += k
            continue
        code = head[3]
        if code == 0xB9:
            return
        if code == 0xBA:
            at += 14 + (head[13] & 7) if head[4] >> 6 == 1 else 12
        elif code < 0xBB:
            at += 4
        else:
            size = int.from_bytes(head[4:6], "big")
            if code == 0xBD or 0xC0 <= code <= 0xDF:
                body = source.read(at + 6, max(0, min(size, source.size - at - 6)))
                yield code, body[_payload_at(body) :]
            else:
                yield 0, b""
            at += 6 + size


def demux(data: bytes) -> dict[int, bytes]:
    """Audio streams of an MPEG program stream by stream id.

    Empty if ``data`` doesn't begin with a pack or has fewer than two packets.  Private streams may carry a
    sub-header in each packet, as long as what comes before an ``SShd`` near the first one's begin.
    """
    streams: dict[int, list[bytes]] = {}
    n = 0
    for code, payload in packets(ranges.Buffer(data)):
        n += 1
        if payload:
            streams.setdefault(code, []).append(payload)
    inner = _inner(streams[0xBD][0]) if 0xBD in streams else 0
    parts = {c: b"".join(x[inner if c == 0xBD else 0 :] for x in p) for c, p in streams.items()} if n >= 2 else {}
    return {c: x for c, x in sorted(parts.items()) if x}


def _inner(first: bytes) -> int:
    """Bytes of the sub-header of private packets."""
    return max(first.find(b"SShd", 0, 19), 0)


def _payload_at(packet: bytes) -> int:
    """Where the payload of a packet begins, after its length field.

    ISO 13818-1: the bits 10, two bytes of flags in all, the length of the rest of the header.
    ISO 11172-1: stuffing bytes 0xFF; the bits 01 and a buffer size in two bytes, or nothing; then a
    presentation time (0010, five bytes), that and a decoding time (0011, ten), or one byte 0x0F.
    """
    first = packet[0] if packet else 0
    if first & 0xC0 == 0x80:
        return 3 + (packet[2] if len(packet) > 2 else 0)
    at = len(packet) - len(packet.lstrip(b"\xff"))
    if packet[at : at + 1] and packet[at] & 0xC0 == 0x40:
        at += 2
    times = {0x20: 5, 0x30: 10}
    return at + (times.get(packet[at] & 0xF0, 1) if at < len(packet) else 1)


def _derived(rows: list[tuple[int, int, str, int, str]]) -> pa.RecordBatch:
    parent, at, path, size, uri = zip(*rows, strict=True) if rows else ((),) * 5
    n = len(rows)
    loc = pa.StructArray.from_arrays(
        [pa.array(uri, pa.string()), pa.array([0] * n, pa.int64()), pa.array([ranges.SECTOR] * n, pa.int32()), pa.array([0] * n, pa.int32())], names=["uri", "at", "raw", "data"]
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(parent, pa.int64()), pa.array(at, pa.int64()), pa.array(path, pa.string()), pa.array(size, pa.int64()), loc],
        names=["parent", "at", "path", "size", "loc"],
    )


def streams_of(entries: DataFrame, folder: str) -> DataFrame:
    """DERIVED rows of the audio streams of entries (entry, path, size, loc) that are MPEG program streams; ``at`` is the stream id.

    A stream is read packet by packet and written as it comes: nothing holds it whole.  One task reads one
    program stream, as only its packets say where the next one is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ranges.Files()
        for batch in batches:
            out = []
            for r, source in ranges.each_source(batch, files):
                n, first = 0, {}
                for code, payload in packets(source):  # once over, for the ids and the number of packets
                    n += 1
                    if payload:
                        first.setdefault(code, payload)
                for code in sorted(first) if n >= 2 else ():
                    skip = _inner(first[code]) if code == 0xBD else 0
                    pieces = (p[skip:] for c, p in packets(source) if c == code and p)
                    uri, size = ranges.save(folder, f"{r['entry']}-stream-{code:02X}", pieces)
                    if size:
                        out.append((r["entry"], code, f"{r['path']} [audio {code:02X}]", size, uri))
            yield _derived(out)

    return entries.select("entry", "path", "size", "loc").mapInArrow(run, DERIVED)


def measured(marks: DataFrame) -> DataFrame:
    """(entry, offset, end, kind) of marks (entry, size, loc, offset, kind) at which there is a whole member of LEAST to MOST bytes.

    Every mark is tried for itself, so they can be dealt to any tasks; what is inflated isn't kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ranges.Files()
        for batch in batches:
            out = []
            for r, source in ranges.each_source(batch, files):
                last = None
                for last in inflated(source, r["offset"], r["kind"]):
                    pass
                if isinstance(last, tuple) and last[1] >= LEAST:
                    out.append((r["entry"], r["offset"], last[0], r["kind"]))
            columns = zip(*out, strict=True) if out else ((),) * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["entry", "offset", "end", "kind"])

    return marks.mapInArrow(run, "entry long, offset long, end long, kind string")


def unpacked(taken: DataFrame, folder: str) -> DataFrame:
    """DERIVED rows of members (entry, path, size, loc, offset, kind), each written as a file; ``at`` is the member's offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ranges.Files()
        for batch in batches:
            out = []
            for r, source in ranges.each_source(batch, files):
                pieces = (p for p in inflated(source, r["offset"], r["kind"]) if isinstance(p, bytes))
                uri, size = ranges.save(folder, f"{r['entry']}-{r['offset']:X}", pieces)
                out.append((r["entry"], r["offset"], f"{r['path']} [{r['kind']}@{r['offset']:X}]", size, uri))
            yield _derived(out)

    return taken.mapInArrow(run, DERIVED)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            data = r["content"] or b""
            found = [(f"{r['path']} [audio {c:02X}]", x) for c, x in demux(data).items()]
            found = found or [(f"{r['path']} [{kind}@{at:X}]", out) for kind, at, _, out in members(data)]
            for path, content in found:
                columns = [pa.array([r["entry"]], pa.int64()), pa.array([path]), pa.array([content], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["entry", "path", "content"])


def expand(entries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(entry, path, content) of ``entries`` and of what is inside them, at most ``depth`` levels down, whatever tracks cover.

    A derived row has its parent's path with the kind and the place in brackets, and the number
    of the outermost entry: two rows may have one number.  ``scan.scan_all`` opens what no track
    claims, and numbers every entry for itself.
    """
    level = entries.select("entry", "path", "content")
    out = level
    for _ in range(depth):
        level = cut(level.mapInArrow(_open, _SCHEMA), "members")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def original(entries: DataFrame) -> DataFrame:
    """Entries that aren't derived, by path."""
    return entries.filter(~F.contains(F.col("path"), F.lit(" [")))
