"""Fill-in-the-middle: cuts by chunk counts against plain slicing, exact round trips, edge texts."""
import hashlib

import numpy as np
import pytest

from covenant.llm import fillmiddle as M

TEXTS = [None, "", "a", "é", "<P> inside", "plain <S>", "x" * 200_000, "日本語" * 30_000, "😀é a\n" * 5_000, " \t\r\n", "\x00\x00b",
         "one two three " * 3_000, "<", "<P", "a<"]


def plain_transform(doc_id, text):
    """The contract word by word, over the code points of a Python string."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_every_form_equals_plain_slicing(spark, docs):
    rows = [(i * 37 + k, t) for i, t in enumerate(TEXTS) for k in range(12)] + [(None, "no id at all"), (5, "again"), (5, "again")]
    got = M.fill_in_middle(docs(rows)).collect()
    want = sorted(((i, *plain_transform(i, t)) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_round_trip_is_exact(spark, docs):
    rows = [(i * 37 + k, t) for i, t in enumerate(TEXTS) for k in range(12)]
    text = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows}
    for r in M.digest(M.fill_in_middle(docs(rows))).collect():
        assert r.restored_sha256 == text[r.doc_id]


def test_chunks_are_content_defined_and_bounded():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 256, 20_000, dtype=np.uint8)
    ends = []
    for before in (0, 333, 7_001):
        data = np.concatenate([rng.integers(0, 256, before, dtype=np.uint8), passage])
        e = M.chunk_ends(data)
        assert e[-1] == len(data) and np.diff(np.append([0], e)).min() > 0
        ends.append({int(x) - before for x in e if x - before > M.REACH})
    assert ends[0] == ends[1] == ends[2]
    assert np.diff(np.append([0], M.chunk_ends(np.full(1_000_000, 65, np.uint8)))).max() <= M.MAX_CHUNK


def test_shared_chunks_are_counted_once_and_the_cache_is_bounded():
    cache = M.ChunkCache(limit=100_000)
    text = "".join(f"zeile {i} äöü " for i in range(3_000))
    first = M.Cutter(text.encode(), cache)
    assert (first.n, cache.hits) == (len(text), 0)
    for units in (0, 1, 777, len(text) - 1, len(text)):
        assert first.data[:first.offset(units)].decode() == text[:units]
    M.Cutter(text.encode(), cache)
    assert cache.hits == len(first.ends)
    for i in range(50):
        M.Cutter(np.random.default_rng(i).bytes(20_000), cache)
        assert cache.held <= cache.limit


def test_empty_table_and_clashing_columns(spark, docs):
    from pyspark.sql import functions as F
    assert M.digest(M.fill_in_middle(docs([]))).collect() == []
    odd = docs([(1, "some words here")]).withColumns({"output": F.lit(1), "form": F.lit("x"), "N": F.lit(2)})
    assert [r.asDict() for r in M.fill_in_middle(odd).collect()] == [
        dict(zip(("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"), (1, *plain_transform(1, "some words here"))))]


@pytest.mark.parametrize("size", [5_000_000])
def test_a_very_long_text(size):
    text = "wörter und zeichen " * (size // 19)
    assert M.transform(3, text, M.ChunkCache())[4].decode() == plain_transform(3, text)[4]
