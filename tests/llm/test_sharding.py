from collections import Counter

import pytest
from granary.llm import sharding as sh


def test_table_is_filled_in_turns():
    names = tuple("abcde")
    table = sh.lookup_table(names, 101)
    free, orders = set(range(101)), []
    for s in names:
        at, skip = sh._number(f"{s}/offset") % 101, sh._number(f"{s}/skip") % 100 + 1
        orders.append(iter([(at + j * skip) % 101 for j in range(101)]))
    want, i = {}, 0
    while free:
        slot = next(s for s in orders[i % 5] if s in free)
        free.remove(slot)
        want[slot], i = i % 5, i + 1
    assert table == tuple(want[s] for s in range(101))


def test_balance_and_disruption():
    names = tuple(f"s{i}" for i in range(20))
    full, less = sh.lookup_table(names, 4099), sh.lookup_table(names[:-1], 4099)
    count = Counter(full)
    assert max(count.values()) - min(count.values()) <= 1
    moved = sum(a != b for a, b in zip(full, less) if a != 19)
    assert moved < 0.05 * 4099
    with pytest.raises(ValueError):
        sh.lookup_table(names, 4098)


def test_placement(spark, awkward, empty, tmp_path):
    out = sh.place(awkward)
    assert out.columns == [c for c in awkward.columns if c not in ("slot", "shard")] + ["slot", "shard"]
    assert out.count() == awkward.count() and sh.op8_sharding(empty).count() == 0
    assert all(n == 1 for n in Counter(r.doc_id for r in out.select("doc_id", "shard").distinct().collect()).values())
    sh.write_shards(awkward.select("doc_id"), f"file://{tmp_path}/shards")
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == awkward.count()
    assert "Broadcast" in out._jdf.queryExecution().toString()
