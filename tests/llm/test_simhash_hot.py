"""SimHash near-duplicates against an independent fingerprint and a plain comparison of all pairs, with hot fingerprints."""

import random

import pytest
import xxhash

from covenant.llm import simhash


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode("utf-8"), seed=42).intdigest() for s in shingles]
    out = 0
    for bit in range(64):
        if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes):
            out |= 1 << bit
    return out


def classes(rows):
    prints = {i: fingerprint(t) for i, t in rows}
    root = {f: f for f in prints.values()}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in list(root):
        for b in list(root):
            if (a ^ b).bit_count() <= 4:
                root[top(a)] = top(b)
    least = {}
    for i, f in prints.items():
        least[top(f)] = min(i, least.get(top(f), i))
    return sorted((i, f"{f:016x}", least[top(f)]) for i, f in prints.items())


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Über", "ÄRA", "nbsp inside", "Case"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(120)]
    near = [t + " tail" for t in texts[:40]]
    blank = [None, "", " \t\n\x0b\x0c\r "] * 60
    return list(enumerate(texts + near + [texts[7]] * 150 + [texts[8]] * 3 + blank + ["A b\tC  d\ne", "a B c D e"], 100))


@pytest.mark.parametrize("hot_rows", [64, 1, 10_000])
def test_equals_all_pairs(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot_rows)      # the hot way, the dealt way and both
    rows = corpus()
    random.Random(1).shuffle(rows)
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in out.select("doc_id", "fingerprint", "component_id").collect()) == classes(rows)


def test_fingerprint_is_independent_of_batches():
    for _, text in corpus():
        assert simhash.simhash(text) == fingerprint(text)
    long = " ".join(f"x{i % 977}" for i in range(70_000))
    assert simhash.simhash(long) == fingerprint(long)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_document_of_each_class_stays(spark):
    rows = corpus() + [(105, "another text under a used id"), (None, "no id"), (None, None)]
    random.Random(2).shuffle(rows)
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    named = [(i, t) for i, t in rows if i is not None]
    top = {}
    prints = {fingerprint(t) for _, t in named}
    root = {f: f for f in prints}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4:
                old, new = root[a], root[b]
                root = {f: new if r == old else r for f, r in root.items()}
    for i, t in named:
        top[root[fingerprint(t)]] = min(i, top.get(root[fingerprint(t)], i))
    want = {(i, fingerprint(t)) for i, t in named if top[root[fingerprint(t)]] == i}
    kept = out.collect()
    assert sorted((r["doc_id"], fingerprint(r["text"])) for r in kept if r["doc_id"] is not None) == sorted(want)
    assert sum(r["doc_id"] is None for r in kept) == 2


@pytest.mark.parametrize("block", [1 << 18, 50])
@pytest.mark.parametrize("max_bits", [0, 1, 4, 9, 70])
def test_links_connect_what_all_pairs_connect(spark, block, max_bits):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(60)] + [0, 1, (1 << 64) - 1, 1 << 63]
    fps = set(seeds)
    for f in seeds:
        for bits in (1, 2, 4, 4, 5, 9, 10):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), bits)))
    low = rng.getrandbits(40) << 24
    fps |= {low | rng.getrandbits(24) for _ in range(150)}      # one node of the top level holds them all
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = [(u % (1 << 64), v % (1 << 64)) for u, v in
             simhash.trie_links(spark.createDataFrame(signed, "fp long"), max_bits, block).collect()]

    def classes_of(pairs):
        root = {f: f for f in fps}

        def top(f):
            while root[f] != f:
                f = root[f]
            return f

        for u, v in pairs:
            root[top(u)] = top(v)
        groups = {}
        for f in fps:
            groups.setdefault(top(f), set()).add(f)
        return sorted(map(sorted, groups.values()))

    every = [(u, v) for u in fps for v in fps if u < v and (u ^ v).bit_count() <= max_bits]
    assert classes_of(links) == classes_of(every)
