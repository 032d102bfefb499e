"""License scans by a positional rare-token index. DataFrame functions only.

1. Document frequencies of the licence words are counted over all documents (one row per licence word).
2. Postings: word -> (template, position) for every word of every template.
3. Of every file, its ``RARE`` licence words of highest IDF are looked up, and with them the ``INDEXED`` rarest words of each
   template's mandatory phrases. Every occurrence votes for (template, start) by its relative position; votes are
   intersected: a place needs as many different words as the template has indexed ones.
4. Places are verified: the mandatory phrases stand whole, and the template's words that stand at their positions weigh at
   least ``LEAST`` of its IDF. As the indexed words are part of mandatory phrases, no such place is lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST = 0.8     # IDF-weighted share of a template's words that stand at their places
RARE = 6        # highest-IDF licence words of a file that are looked up,
RARE_SHARE = 0.05   # of those that at most this share of all files hold
INDEXED = 2     # words of a template's mandatory phrases that are always looked up


@dataclass(frozen=True)
class Template:
    label: str
    text: str                    # words, single-spaced, lower case
    keys: tuple[str, ...]        # mandatory phrases of it
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def key_places(self) -> list[int]:
        """Places (in the template) of the words of its key phrases."""
        out = set()
        for key in self.keys:
            k = key.split()
            at = next(i for i in range(len(self.words)) if self.words[i:i + len(k)] == k)
            out.update(range(at, at + len(k)))
        return sorted(out)


# The base phrases with their labels, and common licence notices.
TEMPLATES = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy",
             ("permission is hereby granted free of charge",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files the software to deal in the software without restriction including without limitation the rights "
             "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
             "the software is furnished to do so subject to the following conditions the above copyright notice and this permission "
             "notice shall be included in all copies or substantial portions of the software the software is provided as is without "
             "warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
             "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim "
             "damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
             "the software or the use or other dealings in the software",
             ("permission is hereby granted free of charge", "the software is provided as is")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
             "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is "
             "and the author disclaims all warranties with regard to this software including all implied warranties of merchantability "
             "and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any "
             "damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
             "tortious action arising out of or in connection with the use or performance of this software",
             ("permission to use copy modify and or distribute this software",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
             "following conditions are met 1 redistributions of source code must retain the above copyright notice this list of "
             "conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this "
             "list of conditions and the following disclaimer in the documentation and or other materials provided with the "
             "distribution", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
             "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
             "purpose including commercial applications and to alter it and redistribute it freely subject to the following "
             "restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original "
             "software 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original "
             "software 3 this notice may not be removed or altered from any source distribution",
             ("altered source versions must be plainly marked as such",)),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
             "the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
             "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
             "warranties or conditions of any kind either express or implied see the license for the specific language governing "
             "permissions and limitations under the license", ("apache license version 2 0", "distributed on an as is basis")),
    Template("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
             "license as published by the free software foundation either version 3 of the license or at your option any later version "
             "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
             "of merchantability or fitness for a particular purpose see the gnu general public license for more details",
             ("gnu general public license as published by the free software foundation either version 3",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
             "compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial "
             "or non commercial and by any means", ("free and unencumbered software released into the public domain",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)


def words(text: Column) -> Column:
    """A-Z lower-cased only; other letters stay as they are."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def licence_idf(split: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """IDF of every licence word over all rows of ``split`` (ws): at most one row per licence word is collected."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_intersect("ws", F.array(*[F.lit(w) for w in vocabulary]))
    # the empty string counts the rows
    rows = split.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("df")).collect()
    df = {r["w"]: r["df"] for r in rows}
    return {w: math.log((df.get("", 0) + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}


@dataclass(frozen=True)
class Index:
    """What a scan looks up: words by IDF, the postings of every word and the words that each template always looks up."""

    idf: dict[str, float]
    postings: dict[str, list[tuple[int, int]]]      # word -> (template, position)
    indexed: list[list[str]]                        # per template


def build_index(idf: dict[str, float], templates: tuple[Template, ...] = TEMPLATES) -> Index:
    postings: dict[str, list[tuple[int, int]]] = {}
    indexed = []
    for n, t in enumerate(templates):
        for at, w in enumerate(t.words):
            postings.setdefault(w, []).append((n, at))
        keys = dict.fromkeys(t.words[at] for at in t.key_places())
        indexed.append(sorted(keys, key=lambda w: (-idf[w], w))[:INDEXED])
    return Index(idf, postings, indexed)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, n_words, matches, score): one row per row of ``docs``; ``matches`` holds (label, base, start, n, share) of
    every place where a template stands, words counted from 0; ``score`` is the best share found at any place voted for.

    A null or empty text has no words and score 0; repeated rows are scanned alike; an empty table gives no rows.
    """
    split = docs.select("doc_id", words(F.col("text")).alias("ws"))
    index = build_index(licence_idf(split, templates), templates)
    vocabulary = sorted(index.postings)
    always = sorted({w for ws in index.indexed for w in ws})

    def lit_map(of: dict, value) -> Column:
        return F.create_map(*[x for w in vocabulary for x in (F.lit(w), value(of[w]))])

    idf = lit_map(index.idf, F.lit)
    postings = lit_map(index.postings, lambda ps: F.array(*[F.struct(F.lit(n).alias("t"), F.lit(at).alias("at")) for n, at in ps]))
    # the file's licence words by IDF, the highest first
    held = F.array_intersect("ws", F.array(*[F.lit(w) for w in vocabulary]))
    seldom = [w for w in vocabulary if index.idf[w] >= 1 - math.log(RARE_SHARE)]
    by_idf = F.sort_array(F.transform(F.array_intersect(held, F.array(*[F.lit(w) for w in seldom]).cast("array<string>")),
                                      lambda w: F.struct(F.element_at(idf, w).alias("idf"), w.alias("w"))), asc=False)
    rare = F.transform(F.slice(by_idf, 1, RARE), lambda x: x["w"])
    looked = split.withColumn("look", F.array_union(F.array_intersect(held, F.array(*[F.lit(w) for w in always])), rare))
    hits = F.filter(F.transform("ws", lambda w, i: F.when(F.array_contains("look", w), F.struct(w.alias("w"), i.alias("i")))),
                    lambda h: h.isNotNull())
    votes = F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(postings, h["w"]), lambda q: F.struct(
        q["t"].alias("t"), (h["i"] - q["at"]).alias("start")))))
    looked = looked.withColumn("hits", F.when(F.size("look") > 0, hits).otherwise(F.array().cast("array<struct<w:string,i:int>>")))
    looked = looked.withColumn("votes", F.array_sort(votes))
    # equal votes are neighbours now: a place has enough of them if the vote so many places on is the same
    need = F.array(*[F.lit(len(ws)) for ws in index.indexed])
    places = F.filter(F.transform("votes", lambda v, i: F.when(
        (F.get("votes", i + F.element_at(need, v["t"] + 1) - 1) == v) & ((i == 0) | ~F.coalesce(F.get("votes", i - 1) == v, F.lit(False))), v)),
        lambda v: v.isNotNull())
    looked = looked.withColumn("places", places)

    def verified(n: int, t: Template) -> Column:
        total = sum(index.idf[w] for w in t.words)

        def place(v: Column) -> Column:
            start = v["start"]
            # the words that stand at their places, as one pass over the template
            at = F.sequence(F.lit(0), F.lit(len(t.words) - 1))
            own, weight = F.array(*[F.lit(w) for w in t.words]), F.array(*[F.lit(index.idf[w]) for w in t.words])
            must = F.array(*[F.lit(k) for k in (range(len(t.words)) if t.base else t.key_places())])
            here = lambda k: (start + k >= 0) & F.coalesce(F.get("ws", F.greatest(start + k, F.lit(0))) == F.get(own, k), F.lit(False))
            share = F.aggregate(at, F.lit(0.0), lambda s, k: s + F.when(here(k), F.get(weight, k)).otherwise(0.0)) / total
            return F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.greatest(start, F.lit(0)).cast("long").alias("start"),
                            F.lit(len(t.words)).alias("n"), F.least(F.round(share, 9), F.lit(1.0)).alias("share"),
                            F.forall(must, here).alias("whole"))

        return F.transform(F.filter("places", lambda v: v["t"] == n), place)

    looked = looked.withColumn("looked", F.when(F.size("places") > 0, F.concat(*[verified(n, t) for n, t in enumerate(templates)])))
    ok = F.filter("looked", lambda m: m["whole"] & (m["share"] >= least))
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,n:int,share:double,whole:boolean>>")
    best = F.coalesce(F.array_max(F.transform("looked", lambda m: m["share"])), F.lit(0.0))
    return looked.select("doc_id", F.size("ws").cast("long").alias("n_words"), F.coalesce(ok, none).alias("matches"), best.alias("score"))


def digest(scanned: DataFrame) -> DataFrame:
    """The scan's places as counts and label lists."""
    base = F.filter("matches", lambda m: m["base"])

    def labels(ms: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")

    starts = F.transform(base, lambda m: m["start"])
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                          F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"),
                          labels(F.col("matches")).alias("labels"), "score")
