"""A leaf of thousands of copies and a leaf that every query visits, against all products."""

import random

import pytest

from covenant.llm import kmtree


@pytest.mark.parametrize("sizes", [(2048, 512, 16), (100, 16, 2), (7, 3, 1)])
def test_every_block_of_a_leaf_meets_every_query(spark, monkeypatch, sizes):
    for name, n in zip(("VECTORS", "QUERIES", "SHELF"), sizes):
        monkeypatch.setattr(kmtree, name, n)
    monkeypatch.setattr(kmtree, "calibrate", lambda tree, x, k: tree.n_leaves)      # every leaf is visited
    rng = random.Random(6)
    rows = {i: [float(rng.randint(-3, 3)) for _ in range(5)] + [1.0] for i in range(400)}
    rows |= {i: [2.0, 1.0, 0.0, 0.0, 1.0, 1.0] for i in range(400, 2400)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = [tuple(r) for r in kmtree.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 2400, 20):
        scored = sorted((-sum(a * b for a, b in zip(v, rows[q])), i) for i, v in rows.items() if i != q)[:20]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    assert got == want
