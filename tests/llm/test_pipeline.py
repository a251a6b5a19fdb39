import corpus_pipeline as cp
from pyspark.sql import functions as F

from .test_decontaminate import brute as contaminated
from .test_jaccard_join import brute as components
from .test_line_dedup import brute as lines

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    seen = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"file://{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"file://{tmp_path}/{k}"))
    assert all(s.columns == docs.columns for s in seen[:-1])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    gone = docs.join(seen[1], "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.filter("quality = 1").count() == 0 and seen[1].join(labels, "doc_id").filter("quality = 0").count() <= 1
    assert sorted((i, t) for i, _, _, t in lines(pairs(seen[1]), 1)) == sorted(pairs(seen[2]))
    assert seen[2].filter("n_chars <> length(text)").count() == 0
    kept = {i for i, _, c in components(pairs(seen[2])) if i == c}
    assert {i for i, _ in pairs(seen[3])} == kept
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {i for i, _ in pairs(seen[4])} == {i for i, _, n, _ in contaminated(pairs(seen[3]), items) if n == 0}
    assert seen[5].count() == seen[4].count() and set(seen[5].columns) >= {"doc_id", "n_tokens", "ids_sha256"}
    assert cp.run(spark, SF).agg(F.sum("n_tokens")).first() == seen[5].agg(F.sum("n_tokens")).first()


def test_awkward_rows(spark, awkward, empty, tmp_path):
    docs = awkward.select(*cp.COLUMNS)
    for table in (docs, empty.select(*cp.COLUMNS)):
        for _, stage in cp.STAGES:
            assert stage(spark, table, SF).count() <= table.count()
