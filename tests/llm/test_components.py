import random

from granary.llm.components import connected_components


def test_random_graphs(spark):
    for seed, n, m in [(1, 60, 40), (2, 60, 70), (3, 400, 380)]:
        rnd = random.Random(seed)
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(1_000 + i, 1_001 + i) for i in range(40)] + [(5, None), (7, 7)]
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if b is not None and a != b:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
        df = spark.createDataFrame(edges, "a long, b long")
        assert sorted(tuple(r) for r in connected_components(df).collect()) == sorted((i, find(i)) for i in list(parent))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
