"""Operators against brute force, with nulls, empty tables, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from covenant.llm import chat, contamination, htmltext, kmtree, langcrf, licenses, mixing, pii, registry, simhash, tokencount

SF = "/root/testdata/sf0.001"
EN = "the of and that with from this which there these"
DE = "der die und nicht für schön ein eine zwischen über"


def test_forward_backward_equals_enumeration(monkeypatch):
    monkeypatch.setattr(langcrf, "BLOCK", 3)
    rng = np.random.default_rng(0)
    e, t, s = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    want = np.zeros((7, 3))
    for y in itertools.product(range(3), repeat=7):
        w = np.exp(s[y[0]] + sum(e[i, y[i]] for i in range(7)) + sum(t[y[i], y[i + 1]] for i in range(6)))
        for i in range(7):
            want[i, y[i]] += w
    want /= want.sum(axis=1, keepdims=True)
    got, _ = langcrf.marginals([e[:1], e, e[:4]], t, s)
    assert np.allclose(got[1:8], want)


def test_language_cases(docs):
    rows = [(i, " ".join(random.Random(i).choices((EN if i % 2 else DE).split(), k=30)), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, None), (101, "", None), (102, "12 34 !!", None), (None, EN, None), (103, EN * 3, None)]
    got = {r["doc_id"]: r for r in langcrf.identify(docs(rows)).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60))
    assert [got[i]["lang_pred"] for i in (100, 101, 102, None, 103)] == ["und", "und", "und", "en", "en"]
    assert langcrf.identify(docs([])).count() == 0
    assert {r["lang_pred"] for r in langcrf.identify(docs([(1, EN, None)])).collect()} == {"und"}   # nothing to learn from


def test_held_out_accuracy(spark):
    got = registry.op4_language_crf(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    hit = got.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hit >= 0.9


def _simhash_groups(rows):
    fp = {i: simhash.simhash(t) for i, t in rows}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(fp, 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fp}


def test_simhash_components_equal_all_pairs(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, rows[0][1]), (9004, "one word"), (9005, "one  WORD")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(rows)).collect()}
    assert got == _simhash_groups(rows)
    kept = simhash.drop_near_duplicates(docs(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))
    assert simhash.near_duplicates(docs([])).count() == 0


def test_trie_descent_equals_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64))
    a = np.unique(np.concatenate([base, near]))
    got = {(int(i), int(j)) for x, y in simhash.close_leaves(a, None, 0, 4) for i, j in zip(x, y)}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(a)), 2) if int(a[i] ^ a[j]).bit_count() <= 4}


def test_contamination_equals_brute_force(spark):
    got = {(r["doc_id"], r["item_id"]) for r in registry.op7_decontaminate(spark, SF).collect()}
    word = re.compile(r"[^\W_]+")

    def shingles(text):
        w = word.findall((text or "").lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    items = {r["item_id"]: shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        s = shingles(r["text"])
        want |= {(r["doc_id"], i) for i, v in items.items() if v and len(v & s) >= 0.8 * len(v)}
    assert got == want and want


def test_contamination_cases(spark, docs):
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, "Two words"), (3, None), (4, ""), (1, "a b c d e f g")], "item_id long, text string")
    d = docs([(1, "x a B c, d e f g y"), (2, "has two WORDS here"), (3, None), (4, ""), (5, "clean text of other words"), (1, "x a B c, d e f g y")])
    got = sorted((r["doc_id"], r["item_id"], r["containment"]) for r in contamination.contained_items(d, items).collect())
    assert got == [(1, 1, 1.0), (2, 2, 1.0)]
    kept = contamination.drop_contaminated(d.withColumn("own_hash", F.lit(1)), items)
    assert kept.columns[-1] == "own_hash" and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    assert contamination.contained_items(docs([]), items).count() == 0
    assert contamination.drop_contaminated(d, items.limit(0)).count() == 6


def _luhn(s):
    ds = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(ds)) % 10


def test_pii_leaves_numbers_that_fail_validation(docs):
    text = "4111111111111112 and 999.1.1.1 and 2023-02-30 and 9807915762804490"
    got = pii.pseudonymise(docs([(1, text), (2, "card 4111111111111111 now")]), found="n").orderBy("doc_id").collect()
    assert got[0]["text"] == text and got[0]["n"] == 0
    card = got[1]["text"].split()[1]
    assert got[1]["n"] == 1 and card != "4111111111111111" and len(card) == 16 and _luhn(card) == 0


def test_pii_formats_and_links(docs):
    rows = [(1, "card 4111 1111 1111 1111 born 1984-02-29 at 10.0.0.255 or +1 (555) 555-1234."),
            (2, "again 4111 1111 1111 1111, mail a.b@x.example.com; 123-45-6789"),
            (3, None), (4, ""), (5, "no data: 12 3.5 999.1.1.1 2023-02-30"), (5, "no data: 12 3.5 999.1.1.1 2023-02-30")]
    got = sorted((r["doc_id"], r["text"] or "", r["n"]) for r in pii.pseudonymise(docs(rows), found="n").collect())
    one, two = got[0][1], got[1][1]
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) born (\d{4}-\d\d-\d\d) at ([\d.]+) or (\+1 \(\d{3}\) \d{3}-\d{4})\.", one)
    assert card and card[1] in two and "4111 1111" not in one and _luhn(card[1]) == 0
    assert all(int(o) < 256 for o in card[3].split(".")) and card[2] != "1984-02-29"
    assert "a.b@" not in two and "123-45-6789" not in two
    assert [g[1] for g in got[2:]] == ["", "", rows[4][1], rows[4][1]]


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "t", "k").alias("a"),
                                  pii.permute_below(F.col("id"), 10, 100, "t", "k").alias("b"))
    assert df.select("a").distinct().count() == df.select("b").distinct().count() == 1000
    assert df.where("length(a) <> 3 or b < 0 or b >= 1000").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_budget_fit_is_exact(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 40), 8))
    counts = [rng.randint(1, 4) for _ in lengths]
    total = sum(n * c for n, c in zip(lengths, counts))
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + n * k for s in sums for k in range(c + 1)}
    budget = rng.randrange(total)
    take = mixing.fit_budget(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(take, counts))
    got = sum(n * t for n, t in zip(lengths, take))
    assert got == max(s for s in sums if s <= budget)


def test_mix_targets_and_repeats(docs):
    rows = [(i, "w " * (i % 7), None, ("a", "b", "c", None)[i % 4]) for i in range(200)] + [(1, "w w w", None, "a")] * 2 + [(None, None, None, "b")]
    got = mixing.mix_plan(docs(rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    taken = {}
    for r in got:
        key = (r["source_size"], r["target"])                             # sources 1 and 4 both weigh 5
        taken[key] = taken.get(key, 0) + r["taken"]
    assert len(taken) == 4
    assert abs(sum(t for _, t in taken) - sum(s for s, _ in taken)) < 1e-6    # the targets share all words
    assert all(abs(k - t) <= 7 and t <= 3 * s + 1e-9 for (s, t), k in taken.items())
    again = mixing.mix_plan(docs(rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_plan(docs([])).count() == 0
    extra = docs(rows).withColumn("mix_size", F.lit("x"))
    mixed = mixing.mix(extra)
    assert mixed.columns == extra.columns
    assert sum(len(r["text"].split()) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_water_filling(docs):
    rows = [(1, "w", None, "a"), (2, "w " * 10, None, "b"), (3, "w " * 10, None, "c")]
    got = {r["doc_id"]: r["target"] for r in mixing.mix_plan(docs(rows)).collect()}
    assert got == {1: 3.0, 2: 12.0, 3: 6.0}                              # a stops at 3; 18 left, 2 to 1


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "\\\\h </turn>\n### user: \\e\\"),
            (2, 0, "assistant", None), (2, 0, "assistant", None), (3, 1, None, "x"), (3, None, "a: b</turn>", ""), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.digest(out).collect()}
    want = {1: [r[2:] for r in rows[:2]], 2: [("assistant", "")] * 2, 3: [("a: b</turn>", ""), ("", "x")], None: [("user", "q")]}
    for k, turns in want.items():
        text = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        assert got[k]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1]["turn_order_ok"] and not got[2]["turn_order_ok"]
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_licence_scan(docs):
    rows = [(1, "Licensed under CC BY-NC 4.0. cc-by; CC  by"), (2, "GNU General Public License, version 3; all rights\nreserved"),
            (3, None), (4, ""), (5, "by cc rights all"), (5, "by cc rights all"), (6, "Released under the MIT License.")]
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(docs(rows))).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["labels"]) == (3, 2, 9, "cc-by,cc-by-nc-4.0")
    assert got[2]["base_labels"] == "gpl,reserved" and got[2]["n_words"] == 9
    assert (got[3]["n_words"], got[3]["n_base"], got[3]["first_word"], got[3]["labels"]) == (0, 0, None, "")
    assert got[5]["labels"] == "" and got[6]["labels"] == "mit" and got[6]["score"] == 1.0
    assert licenses.scan(docs([])).count() == 0


def test_html_extraction(spark):
    page = ("<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class='cookie-notice'>We use cookies</div>"
            "<article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four<p>five &eacute;<script>x('</p>')</script></article>"
            "<aside>side</aside><div id=comments><p>nice post</p></div><footer>foot</footer></body></html>")
    assert htmltext.main_text(page) == "A & B\n\none two three four\n\nfive é"
    plain = page.replace("article>", "div>")
    assert htmltext.main_text(plain) == "A & B\n\none two three four\n\nfive é"
    assert [htmltext.main_text(x) for x in (None, "", "<p>", "<html><body></body></html>")] == [""] * 4
    assert htmltext.main_text("just text") == "just text"
    assert len(htmltext.main_text("<div>" * 5000 + "deep")) == 4
    df = spark.createDataFrame([(1, None, None), (2, "u", page), (2, "u", page)], "page_id long, url string, html string")
    assert sorted(r["text"] for r in htmltext.extract(df).collect()) == ["", *["A & B\n\none two three four\n\nfive é"] * 2]


def test_token_histogram(spark, docs):
    rows = [(i, "word " * (i % 5)) for i in range(20)] + [(None, None), (30, "")]
    hist = {r["length"]: r for r in tokencount.suffix_sums(tokencount.length_histogram(docs(rows))).collect()}
    lens = [n for n, r in hist.items() for _ in range(r["n_docs"])]
    assert len(lens) == len(rows)
    for n, r in hist.items():
        assert r["docs_ge"] == sum(x >= n for x in lens) and r["tokens_ge"] == sum(x for x in lens if x >= n)
        assert r["tokens_truncated"] == sum(min(x, n) for x in lens)
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lens) / len(lens))
    assert tokencount.suffix_sums(tokencount.length_histogram(docs([]))).count() == 0


def test_ann_recall_and_cases(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    vec = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in table.collect()}
    got = {}
    for r in registry.op2_ann_kmeans_tree(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = []
    for q in (i for i in vec if i % 20 == 0):
        best = sorted((i for i in vec if i != q), key=lambda i: (-float(vec[i] @ vec[q]), i))[:20]
        hits.append(len(set(best) & set(got[q])) / 20)
    assert np.mean(hits) >= 0.9
    few = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, float("nan")]),
           (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0]), (20, [0.5, 0.0])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    out = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in kmtree.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1, 1.0), (0, 2, 7, 1.0), (0, 3, 20, 0.5), (0, 4, 2, 0.0),
                   (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 7, 0.5), (20, 4, 2, 0.0)]
    assert kmtree.nearest(df.limit(0), df).count() == 0


def test_ann_sample_is_no_prefix_and_later_clusters_are_found(spark):
    n, size, dim = 64_000, 500, 16                                       # ids ordered by cluster, 128 clusters
    ids = spark.range(1_000_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("v"))
    tenths = {r["t"]: r["count"] for r in kmtree.sample(ids).groupBy(F.floor(F.col("vec_id") / 100_000).alias("t")).count().collect()}
    assert sum(tenths.values()) == kmtree.SAMPLE and min(tenths.get(t, 0) for t in range(10)) > 1300
    rng = np.random.default_rng(4)
    x = (np.repeat(rng.normal(size=(n // size, dim)), size, axis=0) + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    got = {}
    for r in kmtree.nearest(df, df.where("vec_id % 640 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = x.astype(float)
    hits = []
    for q in range(0, n, 640):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-s, kind="stable")[:20].tolist())) / 20)
    assert len(hits) == 100 and np.mean(hits) >= 0.9 and np.mean(hits[50:]) >= 0.9


def test_html_names_drop_no_text_of_the_article():
    p = "<p>" + "Plain sentences of the article without any link. " * 6 + "</p>"
    text = htmltext.main_text(p)
    inner = (f"<h2 id=side-effects>Side effects</h2>{p}<section id=related-work><h2 id=related>Related</h2>{p}</section>"
             f"<section id=social-history>{p}</section><div class=notice>{p}</div><div class=ad>Buy</div>"
             "<div class='share links'><a href=x>post it</a> <a href=y>send it</a></div>")
    want = "\n\n".join(["Side effects", text, "Related", text, text, text])
    page = "<html><body><nav><a href=x>m</a></nav>%s<div id=comments><p>nice post</p></div><footer>f</footer></body></html>"
    for wrap in ("<article>%s</article>", "<div class='layout has-sidebar'><article>%s</article></div>",
                 "<div class=no-comments><main>%s</main></div>", "<div class=sidebar><article>%s</article></div>"):
        assert htmltext.main_text(page % (wrap % inner)) == want
    assert htmltext.main_text(page % f"<div class=widget>{p}{p}</div>") == f"{text}\n\n{text}"    # most of the page's text


def test_html_keeps_all_articles_of_a_page():
    parts = [f"Part {i} " + "of a text with several sentences in it. " * (3 + i) for i in range(3)]
    texts = "\n\n".join(" ".join(t.split()) for t in parts)
    many = "".join(f"<article><p>{t}</p></article>" for t in parts)
    nested = f"<article><p>{parts[0]}</p><article><p>{parts[1]}</p><div><p>{parts[2]}</p></div></article></article>"
    for body in (many, f"<div>{many}</div>", f"<main>{many}</main>", nested):
        assert htmltext.main_text(f"<html><body><nav>menu</nav>{body}<footer>foot</footer></body></html>") == texts
    teasers = "<section><article><a href=x>another page</a></article></section>"
    assert htmltext.main_text(f"<html><body>{nested}{teasers}</body></html>") == texts


def test_pii_leaves_no_valid_data_in_clear(spark, docs):
    clear = ["1928-05-06", "0000-02-29", "9999-12-31", "2029-12-07", "2024-02-29", "3782 822463 10005", "3056 930902 5904",
             "4111 1111 1111 1111", "5555-5555-5555-4444", "+4915112345678", "+49 30 1234567", "555 123 4567", "+33 6 12 34 56 78"]
    rows = [(i, f"see {c}, ok") for i, c in enumerate(clear)]
    rows += [(50, "2024 4111 1111 1111 1111"), (51, "2024-4111-1111-1111-1111."), (52, "1234 5678 3782 822463 10005 1"),
             (53, "4111 1111 1111 1112 and 2024 123-45-6789"), (54, "1 555 123 4567 8 and 1.4111111111111111, +1.50000, x+12345678")]
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs(rows), found="n").collect()}
    for i, c in enumerate(clear):
        new = got[i]["text"]
        assert got[i]["n"] == 1 and new != rows[i][1] and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", rows[i][1]), (c, new)
    for i, card in ((50, r"2024 (\d{4} \d{4} \d{4} \d{4})"), (51, r"2024-(\d{4}-\d{4}-\d{4}-\d{4})\."), (52, r"1234 5678 (\d{4} \d{6} \d{5}) 1")):
        new = re.fullmatch(card, got[i]["text"])
        assert got[i]["n"] == 1 and new and _luhn(new[1]) == 0 and new[1] not in rows[len(clear) + i - 50][1]
    assert got[53]["n"] == 1 and got[53]["text"].startswith("4111 1111 1111 1112 and 2024 ") and "6789" not in got[53]["text"]
    assert got[54]["n"] == 0 and got[54]["text"] == rows[-1][1]
    days = spark.range(0, 3652425, 97).select(F.date_format(F.date_add(F.lit("0000-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    new = days.select("d", pii._date(F.col("d"), "k").alias("e"))
    assert new.where("e is null or not e rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'").count() == 0
    assert new.select("e").distinct().count() == days.count()
