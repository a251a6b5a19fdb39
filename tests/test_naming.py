"""Numbers and names."""

from granary.operators import naming
from pyspark.sql import functions as F


def test_dense_ids_of_many_rows(spark):
    """Every id once, in order, whatever the partitions; also for rows that tie."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 400_000
        rows = spark.range(n, numPartitions=16).select((F.xxhash64("id") % 90_000).alias("k"), "id", F.lit(1).alias("row"), F.lit(2).alias("p"))
        out = naming.dense_ids(rows, ["k"])
        assert out.columns == ["k", "id", "row", "p", "track_id"]
        got = out.agg(F.count("*"), F.countDistinct("track_id"), F.min("track_id"), F.max("track_id"), F.countDistinct("id")).first()
        assert tuple(got) == (n, n, 0, n - 1, n)
        by = out.selectExpr("k", "track_id", "lag(k) over (partition by floor(track_id / 1000) order by track_id) as b")
        assert by.filter("b > k").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert naming.dense_ids(rows.limit(0), ["k"]).count() == 0


def test_paths_that_meet_generated_ones(spark):
    """One after another, as a loop over all paths does it."""
    paths = ["b/t.wav", "B/T.wav", "b/t (VAG).wav", "b/t.WAV", "b/t.wav", "b/t (VAG 2).wav", "c.wav", "c.wav", "x.wav.wav", "x.wav.wav", "x (A-B).wav", "é.wav", "É.wav"]
    kinds = ["VAG", "VAG", "VAG", "ADS", "VAG", "ADS", "A/B", "A/B", "A/B", "A/B", "ADS", "Q", "Q"]
    rows = [(i, p, k) for i, (p, k) in enumerate(zip(paths, kinds))]
    used, want = set(), {}
    for i, p, k in rows:
        short, new, n = p, p, 1
        while short.endswith(".wav"):
            short = short[:-4]
        while new.lower() in used:
            new = f"{short} ({k.replace('/', '-')}).wav" if n == 1 else f"{short} ({k.replace('/', '-')} {n}).wav"
            n += 1
        used.add(new.lower())
        want[i] = new
    df = spark.createDataFrame(rows, "i long, path string, kind string")
    assert {r.i: r.unique_path for r in naming.unique_paths(df, "path", "kind", ["i"]).collect()} == want


def test_pairs_by_name(spark):
    """The first partner that exists decides; each track is in one pair at most."""
    from granary.operators import matching

    paths = ["a/xL.vag", "a/XR.VAG", "a/yl.wav", "a/yr.wav", "a/m.V0", "a/m.V1", "a/left.wav", "a/right.wav", "a/foo.L", "a/foo.R", "b/zL.wav", "b/zR.wav", "L.wav", "R.wav", "qL.L", "qR.L", "qL.R"]
    entries = spark.createDataFrame(list(enumerate(paths)), "entry long, path string")
    rows = [(100 + i, i, 5 if i not in (11,) else 6) for i in range(len(paths)) if i != 3]
    tracks = spark.createDataFrame(rows, "track long, entry long, size int")
    got = sorted(tuple(r) for r in matching.pair_by_name(tracks, entries, ["size"]).collect())
    # "left" and "L" alone are no names; y's right entry has no track; z differs in size; q's L.L takes R.L first
    assert got == [(100, 101), (104, 105), (108, 109), (114, 115)]


def test_names_of_one_entry_differ_by_their_numbers(spark):
    """More tracks than three digits number, labels that look like numbers: no name is looked for among the others."""
    tracks = spark.range(1_200).select(F.lit(1).alias("entry"), F.col("id").alias("offset"), F.get(F.array(F.lit("(2)"), F.lit("1 x"), F.lit(None), F.lit(" . ")), (F.col("id") % 4).cast("int")).alias("label"))
    out = naming.track_paths(tracks, spark.createDataFrame([(1, "a/b.bin")], "entry int, path string"))
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.select(F.lower("out")).distinct().count() == 1_200
