"""The positional index against a plain search of every phrase at every word."""
import random
import re

import pytest
from pyspark.sql import functions as F

from covenant.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_force(rows, templates=L.TEMPLATES, least=L.LEAST):
    """Every place of every template, tried at every word of every text."""
    import math
    split = [words(t) for _, t in rows]
    vocabulary = {w for t in templates for w in t.words}
    df = {w: sum(w in set(ws) for ws in split) for w in vocabulary}
    idf = {w: math.log((len(rows) + 1) / (df[w] + 1)) + 1 for w in vocabulary}
    out = []
    for (i, _), ws in zip(rows, split):
        found = []
        for t in templates:
            total = sum(idf[w] for w in t.words)
            must = range(len(t.words)) if t.base else t.key_places()
            for start in range(-len(t.words) + 1, len(ws)):
                same = [0 <= start + k < len(ws) and ws[start + k] == w for k, w in enumerate(t.words)]
                if all(same[k] for k in must):
                    share = sum(idf[w] for w, x in zip(t.words, same) if x) / total
                    if share >= least:
                        found.append((t.label, t.base, max(start, 0), len(t.words), round(share, 6)))
        out.append((i, len(ws), sorted(found)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    filler = "the of and to by version software license use copy all rights public 2 0 free any person cc notice zeile été".split()
    rows = [(0, None), (1, ""), (2, "CC BY"), (3, "by cc by CC"), (4, "free of charge to any person")]
    for i in range(5, 60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(" ".join(rng.choice(filler) for _ in range(rng.randrange(0, 30))))
            t = rng.choice(L.TEMPLATES)
            ws = list(t.words)
            for _ in range(rng.choice([0, 0, 1, 3, len(ws) // 3])):         # changed words
                ws[rng.randrange(len(ws))] = rng.choice(filler)
            if rng.random() < 0.2:
                ws = ws[rng.randrange(len(ws)):]                            # the beginning is missing
            parts.append(rng.choice([" ", ", ", "\n"]).join(w.capitalize() if rng.random() < 0.3 else w for w in ws))
        rows.append((i, rng.choice([" ", ". ", "\n\n"]).join(parts)))
    return rows + [(59, rows[30][1]), (None, rows[31][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_search_at_every_word(docs, seed):
    rows = corpus(seed)
    got = sorted(((r["doc_id"], r["n_words"], sorted((m["label"], m["base"], m["start"], m["n"], round(m["share"], 6)) for m in r["matches"]))
                  for r in L.scan(docs(rows)).collect()), key=str)
    assert got == brute_force(rows)
    assert any(m[3] > 100 for _, _, ms in got for m in ms)


def test_full_texts_with_a_changed_word(docs):
    mit = next(t for t in L.TEMPLATES if t.label == "mit" and len(t.words) > 100)
    text = "Copyright (c) 2020 Somebody.\n\n" + mit.text.replace("sublicense", "relicense").upper() + "\nthe end"
    row = L.digest(L.scan(docs([(1, text), (2, "nothing here")]))).where("doc_id = 1").first()
    assert row["labels"] == "mit" and 0.9 < row["score"] <= 1.0 and row["n_base"] == 0


def test_common_words_are_not_looked_up_and_many_places_are_found(docs):
    rows = [(i, "the software is provided by the authors and all of the rights " * 30) for i in range(40)]
    rows += [(100, "cc by " * 3_000), (101, "all rights reserved " * 1_000)]
    got = {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"]) for r in L.digest(L.scan(docs(rows))).collect()}
    assert got[100] == (3_000, 0, 5_998) and got[101] == (1_000, 0, 2_997) and got[3] == (0, None, None)


def test_empty_table_and_clashing_columns(docs):
    assert L.scan(docs([])).count() == 0
    odd = docs([(1, "CC BY")]).withColumns({"ws": F.lit(1), "votes": F.lit("x"), "Hits": F.lit(2)})
    assert L.digest(L.scan(odd)).first()["base_labels"] == "cc-by"
