"""Queries of places: rounds, overlaps, pieces, runs of frames, checksums, and what headers say."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import checksums as sums
from granary.functions import numbers, text
from granary.operators import catalog, frames, intervals, matching, naming, offsets, overlap, pieces, rounds, scan
from granary.plans.registry import query, read


def _day() -> Column:
    return F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long")


_DAY = "date_diff('day', date '1970-01-01', cast(l_shipdate as date))"


def _greedy(name: str, table: str, at: str = "off") -> str:
    """CTE of the intervals of ``table`` (entry, off, e) that win."""
    return f"""{name}(entry, off, e) as (
  select entry, off, e from (select *, row_number() over (partition by entry order by off) as rn from {table}) where rn = 1
  union all
  select entry, off, e from (
    select t.entry, t.off, t.e, row_number() over (partition by t.entry order by t.off) as rn
    from {name} w join {table} t on t.entry = w.entry and t.off >= w.e) where rn = 1)"""


def _level(k: int) -> str:
    return f"""l{k} as (select (select max(entry) from l{k - 1}_) + row_number() over (order by parent, "at") as entry, parent, content, "at", {k} as depth from (
  select l{k - 1}.entry as parent, m.child as content, m.off as "at" from l{k - 1} join taken using (content) join m on m.entry = l{k - 1}.content and m.off = taken.off)),
l{k}_ as (select entry from l{k} union all select entry from l{k - 1}_)"""


@query(
    f"""with recursive t as materialized (select l_partkey as entry, {_DAY} as off, {_DAY} + 4 * max(cast(l_quantity as bigint)) as e from lineitem where l_returnflag <> 'R' group by 1, 2),
m as materialized (select l_partkey as entry, {_DAY} as off, {_DAY} + max(cast(l_quantity as bigint)) as e, min(l_suppkey) as child from lineitem where l_returnflag = 'R' group by 1, 2),
{_greedy("c", "t")},
free as materialized (select entry, off, e from m where not exists (select 1 from c where c.entry = m.entry and c.off <= m.off and m.off < c.e)),
{_greedy("won", "free")},
taken as materialized (select entry as content, off from won),
l0 as (select row_number() over (order by p_partkey) - 1 as entry, cast(null as bigint) as parent, p_partkey as content, cast(null as bigint) as "at", 0 as depth from part),
l0_ as (select entry from l0), {_level(1)}, {_level(2)}, {_level(3)}
select * from l0 union all select * from l1 union all select * from l2 union all select * from l3"""
)
def container_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers in containers, three levels down: what is returned opens what its supplier's number names, where no kept line claims the day."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entry"), _day().alias("off"), F.col("l_quantity").cast("long").alias("q"), "l_suppkey", "l_returnflag")
    tracks = lines.filter("l_returnflag <> 'R'").groupBy("entry", "off").agg((F.col("off") + 4 * F.max("q")).alias("end"))
    members = lines.filter("l_returnflag = 'R'").groupBy("entry", "off").agg((F.col("off") + F.max("q")).alias("end"), F.min("l_suppkey").alias("child"))
    inside = rounds.accepted(members, intervals.claim_greedy(tracks, "entry", "off", "end"), "entry", "off", "end")
    roots = naming.dense_ids(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("content")), ["content"], "entry")
    return rounds.grow(roots, inside.withColumnRenamed("entry", "content"), "content", "off", "child", 3)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entry"), _day().alias("off"), F.col("l_quantity").cast("long").alias("q"))
    return rows.groupBy("entry", "off").agg((F.col("off") + F.max("q")).alias("end"))


_IV = f"iv as materialized (select l_suppkey as entry, {_DAY} as off, {_DAY} + max(cast(l_quantity as bigint)) as e from lineitem group by 1, 2)"


@query(
    f"""with {_IV}, r as (select l_suppkey as entry, {_DAY} - l_linenumber as s, {_DAY} + 3 * l_linenumber as t from lineitem)
select iv.entry, off, count(*) as n, sum(least(e, t) - greatest(off, s))::bigint as days from iv join r on r.entry = iv.entry and s < e and off < t group by 1, 2"""
)
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of lines each claim of the supplier meets, and for how long."""
    spans = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entry"), (_day() - F.col("l_linenumber")).alias("s"), (_day() + 3 * F.col("l_linenumber")).alias("t"))
    pairs = overlap.overlapping(_claims(spark, sf_dir), spans, "entry", ("off", "end", "s", "t"))
    days = F.least("left.end", "right.t") - F.greatest("left.off", "right.s")
    return pairs.groupBy("left.entry", "left.off").agg(F.count("*").alias("n"), F.sum(days).alias("days"))


@query(
    f"""with recursive {_IV}, {_greedy("c", "iv")}
select l_orderkey, l_linenumber from lineitem a where not exists (select 1 from c where c.entry = a.l_suppkey and c.off <= {_DAY} + 10 and {_DAY} + 10 < c.e)"""
)
def unclaimed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose tenth day after shipping no winning claim of the supplier covers."""
    points = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("entry"), (_day() + 10).alias("at"))
    won = intervals.claim_greedy(_claims(spark, sf_dir), "entry", "off", "end")
    return overlap.outside(points, won, "entry", "at", "off", "end").select("l_orderkey", "l_linenumber")


@query(
    """with l as (select l_orderkey as s, l_linenumber as k, case when min(l_returnflag) <> 'R' then min(l_partkey) * 100 end as off, sum(cast(l_quantity as bigint))::bigint as n from lineitem group by 1, 2),
p as (select *, coalesce(sum(n) over (partition by s order by k rows between unbounded preceding and 1 preceding), 0)::bigint as b0 from l),
q as (select s, k, off, b0, b0 + n as e from p union all
  select o_orderkey, null, null, coalesce(max(b0 + n), 0), 1152921504606846976 from orders left join p on s = o_orderkey group by o_orderkey),
w as (select o_orderkey as s, 'a' as which, 10 as a, 10 + o_custkey % 50 as b from orders union all select o_orderkey, 'b', o_custkey % 80, o_custkey % 80 + 30 from orders)
select w.s as o_orderkey, which, k, greatest(a, b0) - a as "to", off + greatest(a, b0) - b0 as off, least(b, e) - greatest(a, b0) as size
from w join q on q.s = w.s and a < e and b0 < b where a < b and b0 < e"""
)
def piece_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logical ranges of every order's stream of lines, cut into physical pieces; returned lines are zeros, and so is what lies behind."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag", "l_partkey", "l_quantity")
    # dealt by order once: lines are added up and laid out where they lie
    lines = lines.repartition("o_orderkey").groupBy("o_orderkey", "l_linenumber").agg(
        F.when(F.min("l_returnflag") != "R", F.min("l_partkey") * 100).alias("off"), F.sum(F.col("l_quantity").cast("long")).alias("size")
    )
    orders, c = read(spark, sf_dir, "orders"), F.col("o_custkey")
    first = orders.select("o_orderkey", F.lit("a").alias("which"), F.lit(10).cast("long").alias("a"), (10 + c % 50).alias("b"))
    wanted = first.unionByName(orders.select("o_orderkey", F.lit("b").alias("which"), (c % 80).alias("a"), (c % 80 + 30).alias("b")))
    return pieces.slices(lines, wanted, "o_orderkey", "l_linenumber", "off", "size", "a", "b").select("o_orderkey", "which", "k", "to", "off", "size")


def _plain_letters(rows: np.ndarray) -> np.ndarray:
    """Frames of lower-case letters and spaces."""
    return ((rows == 0x20) | ((rows >= 0x61) & (rows <= 0x7A))).all(axis=1)


@query(
    """with h as (select doc_id, hex(encode(text)) as h from documents where text is not null),
f as (select doc_id, i, regexp_full_match(substr(h, 32 * i + 1, 32), '(20|6[1-9A-F]|7[0-9A])*') as ok from (select doc_id, h, unnest(range(0, length(h) // 32)) as i from h)),
g as (select doc_id, i, i - row_number() over (partition by doc_id order by i) as g from f where ok)
select doc_id, min(i) as first, count(*) as n from g group by doc_id, g having count(*) >= 4"""
)
def frame_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four and more 16-byte frames of plain letters in texts, found chunk by chunk and joined over the borders."""
    return frames.value_runs(read(spark, sf_dir, "documents"), "doc_id", "text", 16, _plain_letters, 4, chunk=1_024)


@query(
    """select l_orderkey, l_linenumber, coalesce((select arg_min(b.l_partkey, b.l_linenumber::bigint * 1000000000 + b.l_partkey) from lineitem b
  where b.l_orderkey = a.l_orderkey and b.l_linenumber >= a.l_linenumber and b.l_partkey > a.l_partkey), 1000000) as next from lineitem a"""
)
def first_larger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first later line of the order with a larger part number; lines of one number are in the order of their parts."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(1_000_000).cast("long").alias("end"))
    return offsets.first_larger(rows, "l_orderkey", ["l_linenumber", "l_partkey"], "l_partkey", "end").select("l_orderkey", "l_linenumber", "next")


@query(
    """with recursive bits as (select i::bigint as b, i::bigint * 16777216 as c, 0 as k from range(256) r(i)
  union all select b, case when c >= 2147483648 then xor((c % 2147483648) * 2, 79764919) else c * 2 end, k + 1 from bits where k < 8),
t as (select list(c order by b) as t from bits where k = 8),
d as (select doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint) as l from documents where text is not null)
select doc_id, len(l)::bigint as n, list_reduce(list_prepend(0::bigint, l), lambda c, b: xor((c % 16777216) * 256, t[xor(c // 16777216, b) + 1])) as checksum from d, t"""
)
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of texts from those of chunks of 1,000 bytes."""
    return sums.checksum(sums.chunked(read(spark, sf_dir, "documents"), "doc_id", "text", 1_000), ["doc_id"], sums.OGG)


@query(
    """select l_partkey, l_orderkey, l_linenumber from (select *, rank() over (partition by l_partkey order by l_linenumber) as r from lineitem where l_quantity > 25) where r = 1"""
)
def first_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part all good lines of the least line number that has one: a try gives several rows."""
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return scan.first_group(rows, ["l_partkey"], "l_linenumber", F.col("l_quantity") > 25).select("l_partkey", "l_orderkey", "l_linenumber")


@query(
    r"""select doc_id, n_chars * 10 as rate, trim(left(text, 40)) as label from documents
where n_chars * 10 between 4000 and 96000 and regexp_full_match(trim(left(text, 40)), '[\x20-\x7e]+')"""
)
def plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with a sane rate and a label that can be shown."""
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 10).alias("rate"), text.printable(F.left("text", F.lit(40))).alias("label"))
    return rows.filter(numbers.sane_rate(F.col("rate")) & F.col("label").isNotNull())


@query(
    """with h as (select doc_id, hex(encode(left(text, 4))) as h from documents where text is not null and strlen(left(text, 4)) >= 4)
select doc_id, ('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::bigint > ('0x' || h[1:8])::bigint as big from h"""
)
def byte_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which way round a field of four bytes is read."""
    data = F.encode(F.left("text", F.lit(4)), "UTF-8")
    return read(spark, sf_dir, "documents").filter(F.octet_length(data) >= 4).select("doc_id", numbers.likely_big(data, 0, 4).alias("big"))


@query("select o_orderkey, to_json({'id': o_orderkey, 'status': o_orderstatus, 'priority': o_orderpriority, 'cents': cast(round(o_totalprice * 100) as bigint)})::varchar as payload from orders")
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as the JSON that a viewer gets."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), cents)
    return rows.select("o_orderkey", catalog.payload(["id", "status", "priority", "cents"]).alias("payload"))


@query("select page_id, case when page_id % 4 <> 0 then page_id * 3 end as id from pages")
def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that a request asks for, if it names one."""
    asked = F.concat(F.lit("track://host/preview?x=1"), F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("&id="), (F.col("page_id") * 3).cast("string"))).otherwise("&idle=7"))
    return read(spark, sf_dir, "pages").select("page_id", catalog.request_id(asked).alias("id"))


@query(
    """select o_orderkey, rpad(o_orderstatus, 6, ' ') || ' ' || lpad(cast(o_custkey as varchar), 9, ' ') || '  ' || o_orderpriority as line from orders"""
)
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as lines of fixed columns."""
    line = catalog.listed([("o_orderstatus", -6), ("o_custkey", 9)], "o_orderpriority")
    return read(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


@query("select o_orderstatus as format, count(*) as n, sum(cast(round(o_totalprice) as bigint) * 1000 // (o_custkey % 900))::bigint as ms from orders where o_custkey % 900 > 0 group by 1")
def track_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks and their whole duration in milliseconds, from samples and rates; rates of zero are left out."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("format"), F.round("o_totalprice").cast("long").alias("samples"), (F.col("o_custkey") % 900).alias("rate"))
    return catalog.durations(rows.filter("rate > 0"), "format", "samples", "rate")


@query(
    """with p as (select *, (p_partkey + 1) // 2 as pair, p_partkey % 2 = 1 as l from part),
d as (select a.p_partkey as a, b.p_partkey as b from p a join p b on a.pair = b.pair and a.l and not b.l where a.p_size // 10 = b.p_size // 10)
select p_partkey as track, d.b as right_track, case when d.b is null then 1 else 2 end as channels from part left join d on a = p_partkey where p_partkey not in (select b from d)"""
)
def stereo_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mono tracks whose names pair them made one of two channels."""
    pair = F.floor((F.col("p_partkey") + 1) / 2)
    path = F.concat(F.lit("d/"), pair.cast("string"), F.lit("_"), F.when(F.col("p_partkey") % 2 == 1, "L.wav").otherwise("R.wav"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry"), path.alias("path"), F.floor(F.col("p_size") / 10).alias("size"))
    tracks = part.select(F.col("entry").alias("track"), "entry", "size")
    pairs = matching.pair_by_name(tracks, part.select("entry", "path"), ["size"])
    return matching.merged_pairs(tracks, pairs).select("track", "right_track", "channels")
