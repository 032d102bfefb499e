"""Suffix-array dedup: removed bytes, spans and kept text against a table of all 200-byte strings."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from covenant.llm import suffixlevels as S


def brute_force(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) from a count of every window."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[s:s + S.LENGTH] for _, d in data for s in range(len(d) - S.LENGTH + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - S.LENGTH + 1):
            if seen[d[s:s + S.LENGTH]] > 1:
                gone[s:s + S.LENGTH] = True
        runs = int(np.sum(gone & ~np.append(False, gone[:-1]))) if len(d) else 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((i, len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words(rng, n, of=400):
    return " ".join(f"{rng.randrange(of):x}ü{rng.randrange(of)}" for _ in range(n))


def corpus(seed):
    """Copies, near copies, passages at and around the limit, runs of one byte, short and empty texts."""
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (25, 40, 90)] + ["x" * 199, "y" * 200, "z" * 201]
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 5_000), (4, "ab" * 700 + "c"), (5, " " * 450), (6, "é" * 99), (7, "é" * 150)]
    for i in range(10, 70):
        parts = [words(rng, rng.randrange(2, 120)) for _ in range(rng.randrange(1, 4))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        if i % 7 == 0:
            parts.append(parts[0])                      # a repeat inside one text
        rows.append((i, rng.choice([" ", "", "\n"]).join(parts)))
    for i in range(70, 90):                             # near copies: one character changes, goes or comes
        t = rows[rng.randrange(20, 60)][1]
        p = rng.randrange(len(t))
        rows.append((i, t[:p] + rng.choice(["", "Q", t[p] + "R"]) + t[p + rng.randrange(2):]))
    rows += [(90, rows[30][1]), (30, rows[30][1]), (None, rows[31][1]), (None, rows[32][1] + "tail")]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_table_of_all_windows(spark, docs, seed):
    rows = corpus(seed)
    assert sorted((tuple(r) for r in S.dedup(docs(rows)).collect()), key=str) == brute_force(rows)


def test_hot_prefixes_are_counted_by_digest(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    rows = corpus(4)
    assert sorted((tuple(r) for r in S.dedup(docs(rows)).collect()), key=str) == brute_force(rows)


def test_anchors_are_window_minima_whatever_the_piece(monkeypatch):
    rng = random.Random(5)
    text = (words(rng, 2_000) + "q" * 900).encode()
    whole = S.anchors(text).tolist()
    monkeypatch.setattr(S, "PIECE", 777)
    assert S.anchors(text).tolist() == whole
    steps = np.diff(np.array(whole))
    assert steps.max() <= S.SPREAD and len(whole) < len(text) / 20 + 900


def test_levels_merge_geometrically(spark):
    family = S.LevelFamily(4)
    orders = []
    for i in range(6):
        found = family.add(spark.createDataFrame([(i, 1), (100, 1), (200 + i // 2, 2 - i % 2)], "g long, n long"))
        orders.append([o for o, _ in family.levels])
        seen = {r.g for f in found for r in f.collect()}
        assert seen == ({100} if i else set()) | {200 + i // 2}
    assert orders == [[0], [1], [1, 0], [2], [2, 0], [2, 1]]
    total = {r.g: r.n for _, level in family.levels for r in level.where("g = 100").collect()}
    assert total[100] in (2, 4)


def test_empty_table_and_clashing_columns(spark, docs):
    assert S.dedup(docs([])).collect() == []
    rows = [(1, "w " * 300), (2, "other " * 50 + "tail")]
    odd = docs(rows).withColumns({"g": F.lit(1), "T": F.lit("x"), "marks": F.lit(2), "n_removed": F.lit(3)})
    assert sorted((tuple(r) for r in S.dedup(odd).collect()), key=str) == brute_force(rows)
