"""Long and malformed inputs: bounded time and memory, exact results."""
import random
import time
import tracemalloc

import pytest

from covenant.llm import htmltext, langcrf, mixing, tokencount

SPACES = [" ", "\n", "\t", "\r\n", " ", " ", "\x85", " \n"]


@pytest.fixture(scope="module")
def encoders():
    with open(tokencount.VOCABULARY, "rb") as f:
        return tokencount.encoders(f.read())


@pytest.mark.parametrize("run", [999, 1_000, 1_001, 3_000])
@pytest.mark.parametrize("space", SPACES)
def test_runs_of_space_count_as_the_pattern_counts_them(encoders, run, space):
    enc, _ = encoders
    rng = random.Random(run)
    for text in (space * run, "a" + space * run, space * run + "b", f"one {space * run}two{space * (run // 2)}, 3{space * run}",
                 "".join(rng.choice(SPACES) for _ in range(run)) + "'s end", space * run + " " + "x\x1c\x1d" + space * run):
        assert tokencount.count_tokens(text, *encoders) == len(enc.encode_ordinary(text))


@pytest.mark.parametrize("unit", [" ", "\n", "a", "-", "ab ", "é", "7"])
def test_runs_of_five_million_characters(encoders, unit):
    n = tokencount.count_tokens(unit * (5_000_000 // len(unit)) + "end", *encoders)
    assert 5_000_000 / 128 / len(unit) < n <= 10_000_001


def test_budget_fit_with_very_long_documents():
    rng = random.Random(1)
    lengths = sorted({*rng.sample(range(1, 4_000), 2_000), 200_000, 2_000_000, 5_000_000})
    counts = [rng.randrange(1, 50) for _ in lengths]
    total = sum(n * c for n, c in zip(lengths, counts))
    tracemalloc.start()
    for share in (0.03, 0.5, 0.97):
        t, budget = time.time(), int(total * share)
        take = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(take, counts))
        assert sum(n * k for n, k in zip(lengths, take)) == budget and time.time() - t < 4
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("seed", range(40))
def test_budget_fit_equals_the_reachable_sums(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, rng.choice([12, 300, 5_000])), rng.randrange(1, 10)))
    counts = [rng.randrange(1, 6) for _ in lengths]
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + n * k for s in sums for k in range(c + 1)}
    for budget in {rng.randrange(max(sums) + 5) for _ in range(5)}:
        got = sum(n * k for n, k in zip(lengths, mixing.fit_budget(lengths, counts, budget)))
        assert got == max(s for s in sums if s <= budget)


PAGES = {
    "open tags": "<a " * 35_000, "open quotes": "<a href=\"" * 12_001, "open quotes, other": "<a href='x \"" * 9_001,
    "nested articles": "<article>" * 10_000 + "text", "nested comments": "<div class=comment-x>" * 5_000 + "text",
    "unknown ends": "<div>" * 10_000 + "</x>" * 10_000, "items": "<ul><li><ul>" + "<div>" * 8_000 + "<li></li>" * 8_000,
    "open comments": "<!--" * 25_000, "ends": "</" * 50_000, "cells": "<div>" * 8_000 + "<td><b>" * 8_000, "signs": "<" * 100_000,
    "scripts": "<script>" * 12_000, "headers": "<article>" + "<header><div>" * 7_000 + "text", "entities": "&#" * 50_000,
    "bold": "<b><p>" * 16_000,
}


@pytest.mark.parametrize("name", PAGES)
def test_malformed_and_deep_pages_take_linear_time(name):
    t = time.time()
    htmltext.main_text(PAGES[name])
    assert time.time() - t < 2, name


def test_many_labels_and_a_very_long_text():
    import numpy as np
    rng = np.random.default_rng(3)
    k = 50
    emits, trans, start = [rng.normal(size=(300_000, k)).astype(np.float64)], rng.normal(size=(k, k)), rng.normal(size=k)
    tracemalloc.start()
    p = langcrf.label_shares(emits[0], trans, start)
    assert p.shape == (k,) and abs(p.sum() - 1) < 1e-9
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    short = emits[0][:3_000]
    assert np.allclose(langcrf.label_shares(short, trans, start), langcrf.marginals([short], trans, start)[0].mean(axis=0))


def test_number_signs_are_no_words(spark, docs):
    rows = [(i, "the cat sat on the mat " * 5, "en") for i in range(10)] + [(i, "le chat noir est ici " * 5, "fr") for i in range(10, 20)]
    rows += [(100, "½ ² Ⅷ ③ ¼"), (101, "12 34"), (102, "½ chat ½ noir")]
    got = {r.doc_id: r.lang_pred for r in langcrf.identify(docs(rows)).collect()}
    assert (got[100], got[101]) == ("und", "und") and got[102] != "und"
