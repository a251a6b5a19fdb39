"""Rounds of the scan, late-bound contents, the contract of parsers, ranges of bytes, patterns."""

import gzip
import struct
import zlib

import numpy as np
import pytest
from granary.operators import scan, search
from granary.operators.patterns import Patterns
from granary.sources import containers, disc, files, opening, ranges, wav
from pyspark.sql import functions as F

from .test_sources import pack, record, sweep


@pytest.fixture(autouse=True)
def shared(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def tone(n):
    """Samples that packed bytes don't show as they are."""
    return np.resize((np.arange(40) * 700 - 14_000).astype(np.int16), n).reshape(-1, 1)


def in_memory(spark, *data, name="f{}.bin"):
    rows = [(k, name.format(k), len(d), d) for k, d in enumerate(data)]
    return spark.createDataFrame(rows, "entry long, path string, size long, content binary")


def found(scanned):
    paths = {r.entry: r.path for r in scanned.entries.collect()}
    return sorted((paths[r.entry], r.offset, r.samples) for r in scanned.tracks.collect())


def test_members_of_one_file_keep_their_tracks(spark):
    """Two gzip members, a WAVE in each: both tracks are there, in entries of their own."""
    a, b = gzip.compress(wav.encode(tone(300), 8_000)), zlib.compress(wav.encode(tone(500), 8_000))
    out = scan.scan_all(in_memory(spark, b"\7" * 20 + a + b"--" + b, wav.encode(sweep(9), 8_000)), chunk=256)
    assert found(out) == [("f0.bin [gz@14]", 0, 300), (f"f0.bin [zlib@{22 + len(a):X}]", 0, 500), ("f1.bin", 0, 9)]
    rows = out.entries.orderBy("entry").collect()
    assert [(r.entry, r.parent) for r in rows] == [(0, None), (1, None), (2, 0), (3, 0)] and rows[2].size == len(wav.encode(tone(300), 8_000))
    wavs = {(r.entry, r.status): r.wav for r in wav.export(out.entries, out.tracks).collect()}
    assert wavs[2, "written"] == wav.encode(tone(300), 8_000) and wavs[3, "written"] == wav.encode(tone(500), 8_000)
    out.close()


def test_nothing_inside_a_track_is_opened(spark):
    """A member within the samples of a WAVE stays closed; one behind it is opened; one in that track's gap, too."""
    inner = gzip.compress(wav.encode(tone(200), 8_000))
    samples = np.frombuffer(inner.ljust(len(inner) + len(inner) % 2, b"\0"), "<i2").reshape(-1, 1)
    outer = wav.encode(np.concatenate([sweep(50), samples, sweep(50)]), 22_050)
    out = scan.scan_all(in_memory(spark, b"x" * 33 + outer + inner), chunk=100)
    n = 100 + len(samples)
    assert found(out) == [("f0.bin", 33, n), (f"f0.bin [gz@{33 + len(outer):X}]", 0, 200)]
    assert "gz" in {k for k, *_ in containers.members(outer)}
    out.close()


def test_members_within_a_member_are_left_to_it(spark):
    """What looks like a member inside the packed bytes of one that was taken isn't tried again as one."""
    inner = gzip.compress(b"core " * 60)
    stored = zlib.compress(inner + b"z" * 100, 0)  # stored: the inner member's bytes are visible
    out = scan.scan_all(in_memory(spark, stored))
    paths = [r.path for r in out.entries.orderBy("entry").collect()]
    assert paths == ["f0.bin", "f0.bin [zlib@0]", "f0.bin [zlib@0] [gz@0]"] and found(out) == []
    out.close()


def test_depth_is_bounded(spark):
    data = wav.encode(tone(70), 8_000)
    for i in range(5):
        data = bytes(range(200)) + (gzip.compress(data) if i % 2 else zlib.compress(data)) + bytes(100)
    out = scan.scan_all(in_memory(spark, data))
    assert sorted(r.path.count(" [") for r in out.entries.collect()) == [0, 1, 2, 3] and found(out) == []
    shallow = scan.scan_all(out.entries.filter("parent is not null").limit(1).drop("parent"))  # an entry one level down opens two more
    assert max(r.path.count(" [") for r in shallow.entries.collect()) == 3
    out.close()
    shallow.close()


def test_program_stream_is_replaced_by_its_streams(spark):
    track = wav.encode(sweep(400), 8_000)
    data = b"\0\0\1\xba" + b"\x44" + bytes(8) + b"\xf8"
    for k in range(0, len(track), 300):
        data += pack(0xC0, b"\x80\0\0" + track[k : k + 300]) + pack(0xE0, b"RIFFvideo")
    data += pack(0xE0, wav.encode(sweep(10), 8_000))  # in the picture's packets: not searched
    out = scan.scan_all(in_memory(spark, data, b"z" * 40 + data[:60]), chunk=128)
    assert found(out) == [("f0.bin [audio C0]", 0, 400)]
    assert [bytes(r.content) for r in ranges.bind(out.entries.filter("path like '%audio%'")).collect()] == [track]
    out.close()


class Bank:
    """BANK, count, then for each (offset, size, label): a format with several tracks at a header."""

    @staticmethod
    def parse(source, at):
        head = source.read(at, 8)
        n = int.from_bytes(head[4:8], "little")
        if head[:4] != b"BANK" or not 0 < n < 100:
            return []
        out = []
        for k in range(n):
            off, size, name = struct.unpack("<II8s", source.read(at + 8 + 16 * k, 16))
            if off == 0xFFFFFFFF:
                raise OSError("a body that can't be read")
            out.append({"offset": at + off, "end": at + off + size, "format": "BANK", "label": name.rstrip(b"\0").decode(), "channels": 1, "rate": 8_000, "samples": size})
        return out


def bank(*parts, junk=b""):
    at, head, body = 8 + 16 * len(parts), b"", b""
    for name, data in parts:
        head += struct.pack("<II8s", at + len(body), len(data), name)
        body += data
    return b"BANK" + struct.pack("<I", len(parts)) + head + body + junk


FORMATS = {
    "BANK": scan.Format("BANK", (b"BANK",), 0, ("bnk",), Bank.parse),
    "WAV": scan.REGISTRY["WAV"],
    # a signature behind the header, which is found by looking back for it
    "BACK": scan.Format("BACK", (b"!tail",), 0, (), lambda s, at: [{"offset": at, "end": at + 20, "format": "BACK", "samples": 1}] if s.read(at, 4) == b"back" else [],
                        lambda s, hit: next((k for k in range(hit, max(-1, hit - 16), -1) if s.read(k, 4) == b"back"), None)),
}


def test_a_header_may_give_several_tracks(spark):
    """All rows of the first format that gives some, with labels; the claim reaches to the last row's end."""
    inner = wav.encode(sweep(30), 8_000)
    data = b"pad." + bank((b"one", b"1" * 40), (b"two", inner), (b"three", b"3" * 7)) + wav.encode(sweep(60), 8_000)
    out = scan.scan_all(in_memory(spark, data, b"..back..!tail" + bytes(9), b"!tail" + bytes(20), b"nothing at all here"), formats=FORMATS, chunk=16)
    rows = sorted((r.entry, r.header, r.format, r.label, r.samples) for r in out.tracks.fillna("", "label").collect())
    end = len(data) - len(wav.encode(sweep(60), 8_000))
    assert rows == [(0, 4, "BANK", "one", 40), (0, 4, "BANK", "three", 7), (0, 4, "BANK", "two", len(inner)), (0, end, "WAV", "", 60), (1, 2, "BACK", "", 1)]
    out.close()


def test_errors_count_only_where_nothing_covers_them(spark):
    bad = b"BANK" + struct.pack("<III8s", 1, 0xFFFFFFFF, 4, b"bad")
    covered = bank((b"all", b"x" * 10 + bad + b"y" * 50))
    out = scan.scan_all(in_memory(spark, covered), formats=FORMATS)
    assert [r.label for r in out.tracks.collect()] == ["all"] and out.errors.count() == 0
    entries = in_memory(spark, covered, b"12345678" + bad + bytes(30))
    with pytest.raises(scan.ScanError, match="f1.bin: BANK: a body"):
        scan.scan_all(entries, formats=FORMATS)
    kept = scan.scan_all(entries, formats=FORMATS, keep_errors=True)
    assert [tuple(r)[:3] for r in kept.errors.collect()] == [(1, "f1.bin", 8)] and kept.tracks.count() == 1


def test_first_group_is_all_rows_of_the_first_rank(spark):
    rows = [(1, 0, "a", False), (1, 1, "b", True), (1, 1, "c", True), (1, 1, "d", False), (1, 2, "e", True), (2, 5, "f", True), (3, 1, "g", False)]
    df = spark.createDataFrame(rows, "k int, rank int, v string, ok boolean")
    assert sorted(r.v for r in scan.first_group(df, ["k"], "rank", F.col("ok")).collect()) == ["b", "c", "f"]


def test_plans_move_places_not_contents(spark, tmp_path, monkeypatch):
    """No exchange and no sort of any step carries contents."""
    (tmp_path / "one.wav").write_bytes(wav.encode(sweep(400), 8_000))
    (tmp_path / "two.bin").write_bytes(b"\7" * 64 + gzip.compress(wav.encode(tone(60), 8_000)))
    plans = []

    def seen(df, what, plain=scan.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, what)

    for module in (scan, ranges):
        monkeypatch.setattr(module, "cut", seen)
    entries = files.entries(spark, str(tmp_path), loc=True)
    out = scan.scan_all(entries)
    whole = files.entries(spark, str(tmp_path), content=True)
    assert {r.path: len(r.content) for r in whole.collect()} == {p.name: p.stat().st_size for p in tmp_path.iterdir()}
    exported = wav.export(out.entries, out.tracks)
    assert exported.filter("status = 'written'").count() == 2
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (whole, exported)]
    for plan in plans:
        for line in plan.splitlines():
            if "Exchange" in line or "Sort" in line:
                assert "content" not in line and "data#" not in line and "wav#" not in line
    out.close()


def test_a_file_over_two_gib_is_read_in_many_partitions(spark, tmp_path):
    """Sparse: holes are zeros; signatures beyond 2 GiB and over the border of two chunks are found."""
    big, size = tmp_path / "big.bin", 3 << 30
    small, chunk = wav.encode(sweep(50), 8_000), 64 << 20
    spots = [(1 << 31) + 12_345, 40 * chunk - 2, size - len(small)]
    with open(big, "wb") as f:
        for at in spots:
            f.seek(at)
            f.write(small)
    assert big.stat().st_size == size
    spark.dataSource.register(ranges.ByteRanges)
    rows = spark.read.format("byte_ranges").options(path=str(big), chunk=str(chunk), overlap="3", task=str(4 * chunk)).load()
    assert rows.rdd.getNumPartitions() == 12
    got = rows.select("start", "last", F.octet_length("data").alias("n"), F.locate("RIFF", F.col("data").cast("string")).alias("at")).filter("at > 0 or last").collect()
    assert sorted((r.start, r.start + r.at - 1) for r in got if r["at"]) == [(s // chunk * chunk, s) for s in sorted(spots)]
    assert [r.n for r in got if r["last"]] == [chunk]
    out = scan.scan_all(opening.open_source(spark, str(big), loc=True), chunk=chunk)
    assert found(out) == [("big.bin", s, 50) for s in sorted(spots)]
    out.close()


@pytest.mark.parametrize("raw,at", disc.LAYOUTS)
def test_ranges_of_an_image_skip_what_sectors_add(spark, tmp_path, raw, at):
    body = wav.encode(sweep(3_000), 8_000)
    n = -(-len(body) // 2048)
    sectors = [bytes(2048) for _ in range(24 + n)]
    sectors[16] = (b"\x01CD001" + bytes(150) + record(b"\0", 18, 2048, True)).ljust(2048, b"\0")
    sectors[18] = (record(b"\0", 18, 2048, True) + record(b"A.WAV;1", 20, len(body) + 9_000)).ljust(2048, b"\0")  # says more than the image has
    for k in range(n):
        sectors[20 + k] = body[2048 * k : 2048 * k + 2048].ljust(2048, b"\0")
    image = tmp_path / "image.iso"
    image.write_bytes(b"".join(b"\xee" * at + s + b"\xee" * (raw - at - 2048) for s in sectors))
    spark.dataSource.register(ranges.ByteRanges)
    for chunk in (1_000, 2_048, 5_000):
        rows = spark.read.format("byte_ranges").options(path=str(image), chunk=str(chunk), overlap="7", task="3000").load()
        got = {r.start: bytes(r["data"]) for r in rows.collect()}
        whole = body.ljust(len(body) + 9_000, b"\0")
        assert got == {s: whole[s : s + chunk + 7] for s in range(0, len(whole), chunk)}
    out = scan.scan_all(opening.open_source(spark, str(image), loc=True), chunk=1_000)
    assert found(out) == [("A.WAV", 0, 3_000)]
    assert wav.export(out.entries, out.tracks).first().wav == body


def test_reads_past_either_end_are_zeros(tmp_path):
    (tmp_path / "a b.bin").write_bytes(bytes(range(1, 101)))
    loc = {"uri": f"file:{tmp_path}/a b.bin", "at": 10, "raw": 2048, "data": 0}
    source = ranges.Source(ranges.Files(), loc, 120)
    whole = bytes(5) + bytes(range(11, 101)) + bytes(40)
    for start, n in ((0, 10), (85, 30), (-5, 20), (89, 1), (119, 5), (300, 4), (0, 0)):
        assert source.read(start, n) == (whole + bytes(500))[5 + start : 5 + start + n]
        assert ranges.Buffer(whole[5:125]).read(start, n) == source.read(start, n)


def brute_hits(data, patterns):
    return sorted((i, p) for p in patterns for i in range(len(data)) if data.startswith(p, i))


@pytest.mark.parametrize("block", [1, 5, 64, 1 << 18])
def test_patterns_of_any_length(monkeypatch, block):
    monkeypatch.setattr(Patterns, "BLOCK", block)
    rnd = np.random.default_rng(block)
    for _ in range(20):
        data = bytes(rnd.choice(list(b"abc\0"), int(rnd.integers(0, 300))).astype(np.uint8))
        patterns = {bytes(rnd.choice(list(b"abc\0"), int(rnd.integers(1, 6))).astype(np.uint8)) for _ in range(12)}
        machine = Patterns(patterns)
        at, which = machine.find(data)
        assert sorted((int(i), machine.patterns[k]) for i, k in zip(at, which)) == brute_hits(data, patterns)
        assert (np.diff(at) >= 0).all()


def test_many_signatures_over_all_chunk_sizes(spark):
    """132 signatures: the same hits whatever the chunk, in texts and in entries."""
    rnd = np.random.default_rng(3)
    patterns = sorted({bytes(rnd.integers(65, 69, int(rnd.integers(2, 7))).astype(np.uint8)) for _ in range(400)})[:132]
    assert len(patterns) == 132
    data = [bytes(rnd.integers(65, 69, n).astype(np.uint8)) for n in (0, 1, 700, 5_000)]
    entries = ranges.located(in_memory(spark, *data))
    want = {(e, p.decode(), i) for e, d in enumerate(data) for i, p in brute_hits(d, patterns)}
    for chunk in (1, 13, 4_096, 1 << 20):
        got = search.range_hits(entries, {p.decode(): [p] for p in patterns}, chunk).collect() if chunk > 1 else []
        assert chunk == 1 or ({tuple(r) for r in got} == want and len(got) == len(want))
    df = spark.createDataFrame([(k, d.decode()) for k, d in enumerate(data)] + [(9, None)], "k long, t string").coalesce(1)
    assert {tuple(r) for r in search.all_hits(df, "k", "t", [p.decode() for p in patterns]).collect()} == want


def numbered_tracks(spark, entries, tracks):
    from granary.operators import naming

    rows = naming.dense_ids(naming.track_paths(tracks.select("entry", "offset", "end", "format", "label", "channels", "rate", "samples", "loop_start", "loop_end", "data_at", "data_size", "bits"), entries), ["entry", "offset"])
    return rows.join(entries.select("entry", F.col("path").alias("source")), "entry")


def test_tracks_appear_all_at_once(spark, tmp_path):
    """Files and manifest by one commit; a track that can't be made has a line and no file; nothing else is left."""
    from granary.sources import export

    (tmp_path / "in").mkdir()
    one, two = wav.encode(sweep(400), 22_050), wav.encode(sweep(60), 8_000)
    (tmp_path / "in/a.wav").write_bytes(one)
    (tmp_path / "in/b.bin").write_bytes(b"\7" * 20 + two + two)
    entries = files.entries(spark, str(tmp_path / "in"), loc=True)
    tracks = numbered_tracks(spark, entries, scan.scan_all(entries).tracks)
    bad = tracks.withColumn("channels", F.when(F.col("track_id") == 1, 0).otherwise(F.col("channels")))
    assert export.write_tracks(entries, bad, f"file://{tmp_path}/out") == {"written": 2, "failed": 1}
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["a.wav", "b.bin/002.wav", "report.json", "tracks.csv"]
    assert (tmp_path / "out/a.wav").read_bytes() == one and (tmp_path / "out/b.bin/002.wav").read_bytes() == two
    lines = (tmp_path / "out/tracks.csv").read_text().splitlines()
    assert lines[0] == ",".join(export.FIELDS) and [x.split(",")[0] for x in lines[1:]] == ["a.wav", "b.bin/001.wav", "b.bin/002.wav"]


def test_a_task_that_dies_leaves_nothing(spark, tmp_path):
    """One task fails after it has written files: no file and no manifest appear, and the job's folder is gone."""
    from granary.sources import export
    from pyspark.errors import PySparkException

    spark.dataSource.register(export.TrackFolder)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in batch.column("id").to_pylist():
                if i == 7:
                    raise ValueError("lost")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i]), pa.array([f"x/{i}.wav"]), pa.array([f"x/{i}.wav,"]), pa.array(["written"]), pa.array([b"RIFF"], pa.binary())], names=["track_id", "out", "line", "status", "wav"]
                )

    folder = tmp_path / "out"
    with pytest.raises(PySparkException):
        spark.range(0, 8, 1, 4).mapInArrow(run, export.SCHEMA).write.format("track_folder").option("path", f"file://{folder}").mode("append").save()
    assert not [p for p in folder.rglob("*") if p.is_file()]
    spark.range(0, 7, 1, 3).mapInArrow(run, export.SCHEMA).write.format("track_folder").option("path", f"file://{folder}").mode("append").save()
    assert sorted(p.name for p in folder.rglob("*") if p.is_file()) == sorted([f"{i}.wav" for i in range(7)] + ["tracks.csv", "report.json"])
    assert (folder / "tracks.csv").read_text().splitlines()[1:] == [f"x/{i}.wav," for i in range(7)]


def test_a_task_that_ran_twice_counts_once(tmp_path):
    """Two attempts write; the one whose message is committed is seen, the other's files go."""
    import pyarrow as pa
    from granary.sources import export

    writer = export._Writer(f"file://{tmp_path}/out", "head")
    batch = lambda data: pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["a.wav"]), pa.array(["a.wav,"]), pa.array(["written"]), pa.array([data], pa.binary())], names=["track_id", "out", "line", "status", "wav"])
    lost, good = writer.write(iter([batch(b"lost")])), writer.write(iter([batch(b"good")]))
    writer.commit([good, None])
    assert (tmp_path / "out/a.wav").read_bytes() == b"good" and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.wav", "report.json", "tracks.csv"]
    assert lost.listed != good.listed
