"""Sources: folders, nested containers, disc images, WAVE files; and folder watching."""

import gzip
import struct
import zlib

import numpy as np
import pytest
from granary.operators import naming, scan, search
from granary.sources import containers, disc, files, opening, wav
from granary.streaming import watch
from pyspark.sql import functions as F


def sweep(n, channels=1):
    x = (np.sin(np.arange(n) ** 1.3 / 900) * 20_000).astype(np.int16)
    return np.stack([x] * channels, axis=1)


@pytest.fixture()
def shared(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_folder_of_waves(spark, tmp_path):
    (tmp_path / "b").mkdir()
    one = wav.encode(sweep(400, 2), 22_050, (100, 300))
    (tmp_path / "b/ONE.WAV").write_bytes(one)
    (tmp_path / "a.bin").write_bytes(b"\7" * 64 + wav.encode(sweep(50), 8_000))
    (tmp_path / "x.hd").write_bytes(b"h" * 20)
    (tmp_path / "X.BD").write_bytes(b"b" * 20)
    entries = files.entries(spark, str(tmp_path), content=True)
    assert [r.path for r in entries.orderBy("entry").collect()] == ["a.bin", "b/ONE.WAV", "X.BD", "x.hd"]
    assert sorted(r.path for r in files.scannable(entries).collect()) == ["a.bin", "b/ONE.WAV", "x.hd"]
    tracks = wav.tracks(entries)
    rows = {(r.entry, r.offset): r for r in tracks.collect()}
    assert set(rows) == {(0, 64), (1, 0)}
    assert (rows[1, 0].channels, rows[1, 0].rate, rows[1, 0].loop_start, rows[1, 0].loop_end) == (2, 22_050, 100, 300)
    out = {r.entry: r for r in wav.export(entries, tracks).collect()}
    assert out[1].status == "written" and out[1].wav == one


def test_loop_is_played_twice_and_fades():
    x = wav.twice(sweep(100), (20, 60), 4, fade_seconds=5)
    assert len(x) == 60 + 40 + 20
    assert np.array_equal(x[60:100], sweep(100)[20:60])
    assert np.array_equal(x[100:], (sweep(100)[20:40] * (1 - np.arange(20) / 20)[:, None]).astype(np.int16))


def test_nested_members_open_three_levels_deep(spark, shared):
    data = b"core " * 40
    for i in range(4):
        data = bytes(range(200)) + (gzip.compress(data) if i % 2 else zlib.compress(data)) + bytes(300)
    df = spark.createDataFrame([(5, "p", data), (6, "none", None), (7, "bad", b"\x78\x9c" + b"\xff" * 90)], "entry long, path string, content binary")
    rows = containers.expand(df).collect()
    assert {r.path.count(" [") for r in rows if r.entry == 5} == {0, 1, 2, 3}
    assert not any(r.content and r.content.startswith(b"core") for r in rows)
    assert len([r for r in rows if r.entry in (6, 7)]) == 2
    assert containers.original(containers.expand(df)).count() == 3


def pack(code, body):
    return b"\0\0\1" + bytes([code]) + struct.pack(">H", len(body)) + body


def test_program_stream_is_taken_apart():
    data = b"\0\0\1\xba" + b"\x44" + bytes(8) + b"\xf8"
    for body in (b"first", b"second"):
        data += pack(0xC0, b"\x80\0\0" + body) + pack(0xE0, b"video")
    data += pack(0xBD, b"\x80\0\x02zzalone")
    assert containers.demux(data) == {0xBD: b"alone", 0xC0: b"firstsecond"}
    assert containers.demux(b"x" + data) == {}


def test_program_stream_with_codes_that_have_no_length():
    """Picture and slice codes between packets, lost bytes, sub-headers, both forms of headers, and what is no stream."""
    mpeg1 = b"\0\0\1\xba" + b"\x21" + bytes(7)
    one = pack(0xC0, b"\xff\xff\x40\0\x21" + bytes(4) + b"abc")
    two = pack(0xC0, b"\x31" + bytes(9) + b"def")
    three = pack(0xC0, b"\x0fghi")
    private = b"".join(pack(0xBD, b"\x80\0\0" + b"\xa0\1\2\3" + x) for x in (b"SShd....", b"more"))
    data = mpeg1 + one + b"\0\0\1\0" + b"\0\0\1\xaf" + two + b"lost bytes" + three + private + pack(0xC1, b"\x0f") + b"\0\0\1\xb9" + three
    assert containers.demux(data) == {0xC0: b"abcdefghi", 0xBD: b"SShd....more"}
    assert containers.demux(mpeg1 + three) == {}
    assert containers.demux(mpeg1) == {}


def test_chunks_find_hits_over_their_borders(spark):
    """Every hit once, whatever the chunk, with signatures that begin alike."""
    rnd = np.random.default_rng(2)
    data = [bytes(rnd.choice(list(b"RIFx"), 400).astype(np.uint8)) + b"RIFFx" for _ in range(3)] + [b"", b"RIFF"]
    entries = spark.createDataFrame(list(enumerate(data)), "entry long, content binary")
    names = {"a": [b"RIFF", b"RIF"], "b": [b"RIF", b"FF"], "c": [b"xR"]}
    want = {(e, n, i) for e, d in enumerate(data) for n, ps in names.items() for p in ps for i in range(len(d)) if d.startswith(p, i)}
    for chunk in (1, 7, 64, 4096):
        got = search.chunk_hits(files.chunks(entries, chunk, 3), names, chunk).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_scan_finds_tracks_and_skips_what_they_cover(spark):
    inner = wav.encode(sweep(40), 8_000)
    outer = wav.encode(sweep(900), 22_050).replace(sweep(900)[100:200].tobytes(), inner.ljust(200, b"\0"), 1)
    data = [bytes(500) + outer + b"junk" + inner, b"RIFFbutnotone" + bytes(30), wav.encode(sweep(9), 11_025), b"RIFF"]
    rows = [(i, f"f{i}.bin", d, len(d)) for i, d in enumerate(data)]
    entries = spark.createDataFrame(rows, "entry long, path string, content binary, size long")
    got = {(r.entry, r.offset): r.samples for r in scan.scan(entries, chunk=64).collect()}
    assert got == {(0, 500): 900, (0, 504 + len(outer)): 40, (2, 0): 9}
    spark.udtf.register("parse_at", scan.ParseAt)
    entries.createOrReplaceTempView("some_entries")
    found = spark.sql("select e.entry, t.format, t.samples from some_entries e, lateral parse_at(e.content, 0, array('NONE', 'WAV')) t").collect()
    assert [tuple(r) for r in found] == [(2, "WAV", 9)]


def test_headers_list_signatures_before_extensions(spark):
    hits = spark.createDataFrame([(1, "m", 6), (1, "n", 9), (1, "n", 8), (1, "low", 3), (2, "m", 7)], "entry long, name string, offset long")
    formats = spark.createDataFrame([("m", "M", 0, 6), ("n", "N", 1, 8), ("low", "L", 2, 4)], "name string, format string, rank int, magic_at long")
    headers = scan.group_headers(hits, formats)
    assert {(r.entry, r.header): list(r.formats) for r in headers.collect()} == {(1, 0): ["M", "N"], (1, 1): ["N"], (2, 1): ["M"]}
    entries = spark.createDataFrame([(1, "a/x.RAW"), (2, "y"), (3, "z.raw")], "entry long, path string")
    by_ext = spark.createDataFrame([("raw", "R", 0), ("raw", "N", 1)], "ext string, format string, rank int")
    out = {(r.entry, r.header): list(r.formats) for r in scan.with_extensions(headers, entries, by_ext).collect()}
    assert out == {(1, 0): ["M", "N", "R"], (1, 1): ["N"], (2, 1): ["M"], (3, 0): ["R", "N"]}


def test_written_tracks_and_manifest(spark, shared, tmp_path):
    one, two = wav.encode(sweep(400, 2), 22_050, (100, 300)), wav.encode(sweep(60), 8_000)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/ONE, x.WAV").write_bytes(one)
    (tmp_path / "in/two.bin").write_bytes(b"\7" * 64 + two + two)
    entries = opening.open_source(spark, str(tmp_path / "in"), content=True)
    tracks = scan.scan(entries).withColumn("label", F.lit(None).cast("string"))
    named = naming.dense_ids(naming.track_paths(tracks, entries), ["entry", "offset"])
    named = named.join(entries.select("entry", F.col("path").alias("source")), "entry")
    done = wav.write(entries, named, f"file://{tmp_path}/out")
    assert sorted((r.out, r.status) for r in done.collect()) == [("ONE, x.wav", "written"), ("two.bin/001.wav", "written"), ("two.bin/002.wav", "written")]
    assert (tmp_path / "out/ONE, x.wav").read_bytes() == one and (tmp_path / "out/two.bin/002.wav").read_bytes() == two
    lines = [line for f in sorted((tmp_path / "out/tracks.csv").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == [
        "file,source,offset,format,channels,sample_rate,seconds,loop_start,loop_end,note",
        '"ONE, x.wav","ONE, x.WAV",0x0,WAV,2,22050,0.018,100,300,',
        "two.bin/001.wav,two.bin,0x40,WAV,1,8000,0.008,,,",
        f"two.bin/002.wav,two.bin,0x{64 + len(two):X},WAV,1,8000,0.008,,,",
    ]


def test_single_files_and_titles(spark, tmp_path):
    (tmp_path / "song.bin").write_bytes(b"0123456789")
    got = opening.open_source(spark, str(tmp_path / "song.bin"), content=True).collect()
    assert [tuple(r) for r in got] == [(0, "song.bin", 10, b"0123456789")]
    cnf = spark.createDataFrame([(0, "system.cnf", b"BOOT2 = cdrom0:\\SLES_123.45;1\r\n"), (1, "x", None)], "entry long, path string, content binary")
    assert tuple(opening.title_of(cnf, "My Game").first()) == ("My Game (SLES-12345)", "SLES-12345")
    assert tuple(opening.title_of(cnf, "my sles 12345").first()) == ("my sles 12345", "SLES-12345")
    assert tuple(opening.title_of(cnf.filter("entry = 1"), "None").first()) == ("None", None)


def test_windows_of_late_events(spark, tmp_path):
    """Counts and sums by hour, closed by the watermark."""
    from datetime import datetime

    rows = [(datetime(2024, 1, 1, h, m), "a", 1.5) for h, m in ((0, 5), (0, 50), (1, 10), (9, 0))]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = watch.watch_events(spark, f"{tmp_path}/in", df.schema)
    run = stream.writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r.start.hour, r.n, r.total) for r in spark.table("hours").collect())[:2] == [(0, 2, 3.0), (1, 1, 1.5)]


def record(name, start, size, folder=False):
    n = 33 + len(name) + (len(name) + 1) % 2
    r = bytes([n, 0]) + struct.pack("<I", start) + struct.pack(">I", start) + struct.pack("<I", size) + struct.pack(">I", size)
    r += bytes(7) + bytes([2 if folder else 0]) + bytes(6) + bytes([len(name)]) + name
    return r.ljust(n, b"\0")


@pytest.mark.parametrize("raw,at", disc.LAYOUTS)
def test_disc_image(spark, tmp_path, raw, at):
    """A folder that holds itself is read once; contents come back whole."""
    sectors = [bytes(2048) for _ in range(24)]
    sectors[16] = (b"\x01CD001" + bytes(150) + record(b"\0", 18, 2048, True)).ljust(2048, b"\0")
    sectors[18] = (record(b"\0", 18, 2048, True) + record(b"A.BIN;1", 20, 3000) + record(b"SUB", 19, 2048, True)).ljust(2048, b"\0")
    sectors[19] = (record(b"SUB", 19, 2048, True) + record(b"B.;1", 22, 5)).ljust(2048, b"\0")
    body = (np.arange(3000) % 251).astype(np.uint8).tobytes()
    sectors[20], sectors[21], sectors[22] = body[:2048], body[2048:].ljust(2048, b"\0"), b"hello".ljust(2048, b"\0")
    image = tmp_path / "image.iso"
    image.write_bytes(b"".join(bytes(at) + s + bytes(raw - at - 2048) for s in sectors))
    spark.dataSource.register(disc.DiscImage)
    found = spark.read.format("disc_image").option("path", str(image)).load()
    rows = {r.path: bytes(r.content) for r in disc.contents(spark, str(image), found).collect()}
    assert rows == {"A.BIN": body, "SUB/B": b"hello"}
    opened = opening.open_source(spark, str(image), content=True)
    assert [(r.entry, r.path, bytes(r.content)) for r in opened.orderBy("entry").collect()] == [(0, "A.BIN", body), (1, "SUB/B", b"hello")]


def test_watched_files_are_searched(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.bin").write_bytes(b"..RIFF..RIFF")
    stream = watch.watch_files(spark, str(folder), [b"RIFF", b"none"])
    run = stream.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r.offset for r in spark.table("hits").collect()) == [2, 8]
