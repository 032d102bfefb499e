"""Prefix trie against a trie of Python tuples."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from covenant.llm import prefixtrie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_force(rows):
    def turn(role, text):
        role, text = role or "", text or ""
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text

    convs = {}
    for c, n, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((n is not None, n or 0, *turn(role, text)))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + ((len(members) - 1) * len(p[-1][1]) if p else 0)
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
                   for p, m in nodes.items()), key=str)


def conversations(seed, ids):
    rng = random.Random(seed)
    shared = [[("user" if k % 2 == 0 else "assistant", f"text {j} {k} " * rng.randrange(4)) for k in range(23)] for j in range(4)]
    rows = []
    for c in ids:
        path = list(rng.choice(shared)[:rng.randrange(0, 23)])
        path += [(rng.choice(["user", "assistant", None, ""]), rng.choice([None, "", "ja", f"own {c}", "né"]))
                 for _ in range(rng.randrange(0, 4))]
        path = path or [("user", "only")]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(path)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_trie_of_tuples(spark, seed):
    rows = conversations(seed, [*range(0, 40), *range(100, 130), *range(205, 240), -7, -105, -250])
    random.Random(seed).shuffle(rows)
    got = P.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_force(rows)


def test_copies_ties_nulls_and_long_conversations(spark):
    rows = conversations(4, range(300, 320))
    rows += [(c, k, "user", f"same {k}") for c in range(400, 460) for k in range(9)]        # many copies
    rows += [(500, k, "user", f"long {k // 2}") for k in range(120)] + [(501, k, "user", f"long {k // 2}") for k in range(0, 120)]
    rows += [(601, None, "user", "b"), (601, None, "user", "a"), (601, 2, None, None), (601, 2, None, None)]
    rows += [(None, 1, "user", "no conversation"), (705, 0, "user", "grafted away"), (801, 3, "a:", "b"), (802, 3, "a", ":b")]
    got = P.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_force(rows)


def test_small_supers_chunks_and_blocks_change_nothing(spark, monkeypatch):
    rows = conversations(5, range(60)) + [(c, k, "user", "run") for c in range(60, 64) for k in range(50)]
    for name, value in (("BLOCK", 2), ("SUPER", 3), ("IDS_PER_CHUNK", 5)):
        monkeypatch.setattr(P, name, value)
    got = P.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_force(rows)


def test_empty_table_and_clashing_columns(spark):
    assert P.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = conversations(6, range(12))
    odd = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit(1), "T": F.lit("x"), "conv": F.lit(2), "rank": F.lit(3)})
    assert sorted((tuple(r) for r in P.trie(odd).collect()), key=str) == brute_force(rows)
