"""From signature hits to tracks: headers, formats to try, the first that gives tracks, what it claims, and what is inside the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from granary.functions.text import extension
from granary.operators.intervals import claim_greedy
from granary.operators.matching import short
from granary.operators.overlap import outside
from granary.operators.rounds import accepted, numbered_after
from granary.operators.search import range_hits
from granary.scratch import cut, drop, drop_path, scratch_path
from granary.sources import containers, files, ranges, wav

Parser = Callable[[ranges.Source | ranges.Buffer, int], list[dict]]


@dataclass(frozen=True)
class Format:
    """A format: its signatures and where they stand in a header, extensions that suffice to try it, and its parser.

    ``parse(source, header)`` gives the tracks at a header, none if it isn't the format's, each with fields of wav.TRACK but ``entry``:
    ``offset`` and ``label`` are a track's own, the greatest ``end`` is what the header claims.  An OSError that it raises
    is kept, and raised only if no earlier track covers the header.
    ``locate(source, hit)`` finds the header of a hit where it isn't ``magic_at`` bytes before it; None if there is none.
    """

    name: str
    signatures: tuple[bytes, ...]
    magic_at: int
    extensions: tuple[str, ...]
    parse: Parser
    locate: Callable[[ranges.Source | ranges.Buffer, int], int | None] | None = None


#: Formats by name, in the order in which they are tried.  Only those with public specifications.
REGISTRY: dict[str, Format] = {f.name: f for f in (Format("WAV", (b"RIFF",), 0, ("wav",), wav.parse),)}
#: What a header gave: rows of tracks, or one row with an error.
OUTCOME = wav.TRACK + ", header long, error string"


class ScanError(OSError):
    """A header that nothing covers couldn't be read."""


def register(format_: Format) -> None:
    REGISTRY[format_.name] = format_


def group_headers(hits: DataFrame, formats: DataFrame) -> DataFrame:
    """(entry, header, formats): the formats to try at each header, in the order of their hits.

    ``hits``: (entry, name, offset), ``formats``: (name, format, rank, magic_at), a short list.  A header is
    where a hit's signature says that it begins; headers before the entry's begin are dropped, and a format is listed once.
    """
    at = hits.join(short(formats), "name").withColumn("header", F.col("offset") - F.col("magic_at"))
    return _first_hits(at)


def _first_hits(at: DataFrame) -> DataFrame:
    first = at.filter("header >= 0").groupBy("entry", "header", "format").agg(F.min(F.struct("offset", "rank")).alias("_at"))
    return _in_order(first.select("entry", "header", "format", F.lit(0).alias("kind"), "_at.*"))


def locate_headers(hits: DataFrame, entries: DataFrame, formats: dict[str, Format]) -> DataFrame:
    """(entry, header, formats) like ``group_headers``, with headers found by the formats' own ``locate`` where they have one.

    Hits are joined with the places of their entries; only those of such formats read anything.
    """
    table = {f.name: (k, f) for k, f in enumerate(formats.values())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = ranges.Files()
        for batch in batches:
            out = []
            for r, source in ranges.each_source(batch, opened):
                rank, f = table[r["name"]]
                header = f.locate(source, r["offset"]) if f.locate else r["offset"] - f.magic_at
                if header is not None:
                    out.append({"entry": r["entry"], "header": header, "format": f.name, "offset": r["offset"], "rank": rank})
            yield wav.batch_of(out, "entry long, header long, format string, offset long, rank int")

    rows = hits.filter(F.col("name").isin(list(table))).join(entries.select("entry", "size", "loc"), "entry")
    return _first_hits(rows.mapInArrow(run, "entry long, header long, format string, offset long, rank int"))


def with_extensions(headers: DataFrame, entries: DataFrame, formats: DataFrame) -> DataFrame:
    """``headers`` and, at the begin of entries with such an extension, the formats known by it, after those with a signature there.

    ``formats``: (ext, format, rank), a short list.
    """
    named = entries.withColumn("ext", F.lower(extension(F.col("path")))).join(short(formats), "ext")
    named = named.select("entry", F.lit(0).cast("long").alias("header"), "format", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("offset"), "rank")
    old = headers.select("entry", "header", F.posexplode("formats").alias("rank", "format"))
    old = old.select("entry", "header", "format", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("offset"), "rank")
    both = old.unionByName(named).groupBy("entry", "header", "format").agg(F.min(F.struct("kind", "offset", "rank")).alias("_at"))
    return _in_order(both.select("entry", "header", "format", "_at.*"))


def _in_order(rows: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("kind", "offset", "rank", "format")))
    return rows.groupBy("entry", "header").agg(listed.alias("_l")).select("entry", "header", F.col("_l.format").alias("formats"))


def first_success(tries: DataFrame, key: list[str], rank: str, good: Column) -> DataFrame:
    """For each key the whole row of least rank that is ``good``; keys without one are left out."""
    row = F.struct(*tries.columns)
    return tries.filter(good).groupBy(*key).agg(F.min_by(row, rank).alias("_r")).select("_r.*")


def first_group(tries: DataFrame, key: list[str], rank: str, good: Column) -> DataFrame:
    """For each key all ``good`` rows of the least rank that has one: the outcome of a try is a group of rows, not one.

    Ranks are reduced first and joined back, so the rows of a key are never gathered.
    """
    rows = tries.filter(good)
    best = rows.groupBy(*key).agg(F.min(rank).alias("_best"))
    return rows.join(best, key).filter(F.col(rank) == F.col("_best")).select(*tries.columns)


def outcome(source: ranges.Source | ranges.Buffer, header: int, formats: list[str] | None, table: dict[str, Format]) -> list[dict]:
    """What the first of the formats that gives tracks gives, or the error that came before it; nothing if none does."""
    for name in formats or ():
        try:
            got = table[name].parse(source, header) if name in table else []
        except OSError as e:
            return [{"format": name, "header": header, "error": f"{name}: {e}"}]
        if got:
            return [{**t, "header": header} for t in got]
    return []


def parser(table: dict[str, Format]):
    """A table function parse(entry, loc, size, header, formats) that gives the OUTCOME rows of a header, for lateral joins."""
    names = [c.split()[0] for c in OUTCOME.split(", ")]

    class Parse:
        def __init__(self) -> None:
            self.files = ranges.Files()

        def eval(self, entry: int, loc, size: int, header: int, formats: list):
            for row in outcome(ranges.Source(self.files, loc, size), header, formats, table):
                yield tuple(entry if n == "entry" else row.get(n) for n in names)

    return udtf(Parse, returnType=", ".join(c if c.split()[0] != "entry" else "entry long" for c in OUTCOME.split(", ")))


@udtf(returnType=", ".join(c for c in OUTCOME.split(", ") if not c.startswith("entry")))
class ParseAt:
    """parse_at(content, offset, formats): the tracks that the first of the formats that gives some has at the offset; no row if none does."""

    def eval(self, content: bytes, offset: int, formats: list):
        for row in outcome(ranges.Buffer(content or b""), offset, formats, REGISTRY):
            yield tuple(row.get(c.split()[0]) for c in OUTCOME.split(", ") if not c.startswith("entry"))


def parse(entries: DataFrame, headers: DataFrame, table: dict[str, Format] | None = None) -> DataFrame:
    """OUTCOME rows of each header of entries (entry, size, loc): only places and headers are joined, and the table function reads."""
    rows = headers.join(entries.select("entry", "size", "loc"), "entry")
    found = parser(dict(REGISTRY if table is None else table))
    return rows.lateralJoin(found(*[F.col(c).outer() for c in ("entry", "loc", "size", "header", "formats")]).alias("t")).select("t.*")


def claimed(outcomes: DataFrame) -> DataFrame:
    """(entry, header, end): the headers that win, by rising place, each unless an earlier winner covers it."""
    spans = outcomes.filter("error is null").groupBy("entry", "header").agg(F.max("end").alias("end"))
    return claim_greedy(spans, "entry", "header", "end")


@dataclass
class Scanned:
    """``tracks`` (wav.TRACK and ``header``), ``entries`` (entry, path, size, loc, parent), the derived ones with numbers of their own and the number of
    the entry that they were in, and ``errors`` (entry, path, header, error), empty unless they were to be kept.
    ``close`` removes what was taken out of containers; tracks of derived entries can't be exported after that."""

    tracks: DataFrame
    entries: DataFrame
    errors: DataFrame
    folder: str

    def close(self) -> None:
        drop_path(self.entries.sparkSession, self.folder)


def scan_all(
    entries: DataFrame, chunk: int = files.CHUNK, depth: int = containers.DEPTH, formats: dict[str, Format] | None = None, keep_errors: bool = False
) -> Scanned:
    """Tracks of entries (``entry``, ``path``, ``size`` and ``loc`` or ``content``) and of what is inside them, in rounds.

    A round takes program streams apart, which replaces them, searches the rest for signatures of formats and of members, lets the first format that gives
    tracks at a header win, and drops headers that an earlier winner covers.  Members that begin where no track covers them, and no member before
    them, at most MEMBERS of an entry, are inflated.  Streams and members are the entries of the next round, with numbers after those of all
    entries before; entries ``depth`` levels down are searched but not opened.  Entries of under 16 bytes have no tracks.

    Tables of a round are written once and hold places and headers; contents are read range by range by the tasks that search,
    parse or inflate.  An error in reading a header that no track covers is raised after its round, or kept.
    """
    spark = entries.sparkSession
    table = dict(REGISTRY if formats is None else formats)
    folder = scratch_path(spark, "inside")
    known = ranges.located(entries).select("entry", "path", "size", "loc", F.lit(None).cast("long").alias("parent"))
    signatures = {f.name: list(f.signatures) for f in table.values()} | {f"\0{k}": p for k, p in containers.SIGNATURES.items()}
    by_ext = spark.createDataFrame([(e, f.name, k) for k, f in enumerate(table.values()) for e in f.extensions], "ext string, format string, rank int")
    tracks = spark.createDataFrame([], OUTCOME).drop("error")
    errors = spark.createDataFrame([], "entry long, path string, header long, error string")
    level = known
    while True:
        todo = cut(files.scannable(level), "todo")
        deep = F.size(F.split("path", r" \[")) - 1
        opened = todo.filter(deep < depth)
        streams = cut(containers.streams_of(_dealt(opened), folder), "streams")
        rest = todo.join(streams.select(F.col("parent").alias("entry")).distinct(), "entry", "left_anti")
        hits = cut(range_hits(rest, signatures, chunk), "hits")
        headers = with_extensions(locate_headers(hits, rest, table), rest, by_ext)
        outcomes = cut(parse(rest, headers, table), "outcomes")
        claims = cut(claimed(outcomes), "claims")
        bad = outside(outcomes.filter("error is not null").select("entry", "header", "error"), claims, "entry", "header", "header", "end")
        bad = cut(bad.join(todo.select("entry", "path"), "entry").select("entry", "path", "header", "error"), "errors")
        if not keep_errors and (first := bad.orderBy("entry", "header").first()):
            raise ScanError(f"{first['path']}: {first['error']}")
        won = outcomes.filter("error is null").join(claims.select("entry", "header"), ["entry", "header"], "left_semi")
        tracks, errors = tracks.unionByName(cut(won.drop("error"), "tracks")), errors.unionByName(bad)
        marks = hits.filter(F.startswith(F.col("name"), F.lit("\0"))).select("entry", "offset", F.substring("name", 2, 9).alias("kind"))
        marks = outside(marks.join(opened.select("entry"), "entry", "left_semi"), claims, "entry", "offset", "header", "end")
        places = rest.select("entry", "path", "size", "loc")
        whole = cut(containers.measured(marks.join(places.drop("path"), "entry").repartition("entry", "offset")), "measured")
        taken = accepted(whole, None, "entry", "offset", "end", containers.MEMBERS).select("entry", "offset", "kind").join(places, "entry")
        inside = cut(containers.unpacked(taken.repartition("entry", "offset"), folder), "inside")
        derived = streams.unionByName(inside)
        done = derived.isEmpty()
        if not done:
            level = cut(numbered_after(derived, known, ["parent", "at", "path"]).select("entry", "path", "size", "loc", "parent"), "level")
            known = known.unionByName(level)
        drop(hits, outcomes, claims, whole, streams, inside, todo)
        if done:
            return Scanned(tracks, known, errors, folder)


def _dealt(entries: DataFrame) -> DataFrame:
    """Entries dealt to tasks one by one: only their places are moved."""
    return entries.select("entry", "path", "size", "loc").repartition("entry")


def scan(entries: DataFrame, chunk: int = files.CHUNK) -> DataFrame:
    """The tracks of ``scan_all``."""
    return scan_all(entries, chunk).tracks
