"""Language identification by a linear-chain conditional random field over words.

Every word is scored for each language by affix, character n-gram and lexicon features; learned transitions tie
neighbouring words, and forward-backward gives each word its label marginals, so code-switched text is labelled word
by word. A document's language is the one with the greatest sum of marginals.

Training uses a bounded sample of labelled rows (``TRAIN_DOCS`` per language, those of least seeded hash, at most
``TRAIN_WORDS`` words of each): documented parameters. Prediction reads every word of every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.llm.tables import free_name

TRAIN_DOCS = 120     # labelled documents per language in the training sample
TRAIN_WORDS = 100    # words of each of them
TRAIN_CHARS = 2_000  # and characters that they are looked for in
DIMS = 1 << 15       # hashed features
STEPS = 60           # gradient steps
RIDGE = 1e-3
SEED = 7
BLOCK = 32           # positions of a text walked at once in forward-backward
AT_ONCE = 640_000    # words times labels squared in one forward-backward over several texts
LONG = 4_000_000     # the same of one text above which it is walked word by word, in pieces of bounded memory
CACHE = 200_000      # words whose scores a task keeps
WORD = regex.compile(r"\p{L}+")


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column) of the hashed features of lower-cased words, and the weight of each word's features: the lexicon
    entry, character 2- and 3-grams with word borders (so affixes of 1 and 2 letters too), affixes of 3 letters."""
    framed = [f"^{w}$" for w in words]
    code = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, framed), np.int64, len(framed))
    ends = np.cumsum(lens)
    word_of = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(code)) - np.repeat(ends - lens, lens)
    rows = [np.arange(len(words))]
    cols = [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))]
    h = code.copy()
    for n in (2, 3, 4):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1:]       # wraps
        left = lens[word_of[:len(h)]] - place[:len(h)]                  # letters from here to the word's end
        keep = left >= n
        if n == 4:
            keep &= (place[:len(h)] == 0) | (left == n)
        rows.append(word_of[:len(h)][keep])
        cols.append((h[keep] ^ (h[keep] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20))
    rows = np.concatenate(rows)
    return rows, (np.concatenate(cols) % np.uint64(DIMS)).astype(np.int64), 1 / np.sqrt(np.bincount(rows, minlength=len(words)))


def word_scores(feats: tuple[np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray) -> np.ndarray:
    rows, cols, scale = feats
    return np.stack([np.bincount(rows, weights[cols, j], len(scale)) * scale for j in range(weights.shape[1])], axis=1)


class Model:
    """Labels, feature weights (DIMS x K), transition scores (K x K) and start scores (K)."""

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.labels, self.weights, self.trans, self.start = labels, weights, trans, start


def marginals(emits: list[np.ndarray], trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals of the words of all sequences (one below the other) and the K x K expected transitions.

    Exact forward-backward over each (n, K) array of word scores, scaled. Sequences are cut into blocks, all blocks
    are reduced to K x K transfer matrices at once, a scan carries the state from block to block, and the words inside
    all blocks are then walked at once: the Python loops are over block lengths and blocks, not over words.
    """
    k = len(start)
    lens = np.array([len(e) for e in emits])
    nb = -(-lens // BLOCK)
    firstb = np.concatenate([[0], np.cumsum(nb)])[:-1]
    m = int(nb.sum())
    emit = np.concatenate(emits)
    psi = np.exp(emit - emit.max(axis=1, keepdims=True))
    a = np.exp(trans - trans.max())
    begin = np.cumsum(lens) - lens
    slot = np.arange(len(emit)) + np.repeat(firstb * BLOCK - begin, lens)   # a word's place among the padded blocks
    step = np.empty((m * BLOCK, k, k))
    step[:] = np.eye(k)                                                     # padding passes everything on
    step[slot] = a[None] * psi[:, None, :]
    step[firstb * BLOCK] = np.eye(k)[None] * psi[begin][:, None, :]         # the first word has no label before it
    step = np.ascontiguousarray(step.reshape(m, BLOCK, k, k).transpose(1, 0, 2, 3))
    whole = step[0]
    for t in range(1, BLOCK):
        whole = whole @ step[t]
        whole /= whole.max(axis=(1, 2), keepdims=True)
    into, outof = np.empty((m, k)), np.ones((m, k))
    into[firstb] = np.exp(start - start.max())
    heads = set(firstb.tolist())
    for b in range(1, m):
        if b not in heads:
            v = into[b - 1] @ whole[b - 1]
            into[b] = v / v.sum()
    for b in range(m - 2, -1, -1):
        if b + 1 not in heads:
            v = whole[b + 1] @ outof[b + 1]
            outof[b] = v / v.sum()
    alpha, beta = np.empty((m, BLOCK, k)), np.empty((m, BLOCK, k))
    v = into[:, None, :]
    for t in range(BLOCK):
        v = v @ step[t]
        v = v / v.sum(axis=2, keepdims=True)
        alpha[:, t] = v[:, 0]
    v = outof[:, :, None]
    for t in range(BLOCK - 1, -1, -1):
        beta[:, t] = v[:, :, 0]
        v = step[t] @ v
        v = v / v.sum(axis=1, keepdims=True)
    alpha, beta = alpha.reshape(-1, k)[slot], beta.reshape(-1, k)[slot]
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    inner = np.ones(len(emit), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    e = alpha[at - 1][:, :, None] * a[None] * (psi[at] * beta[at])[:, None, :]
    return p, (e / e.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


class Scores:
    """The word scores of a long text, looked up slice by slice."""

    def __init__(self, table: np.ndarray, ids: np.ndarray):
        self.table, self.ids = table, ids

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, part: slice) -> np.ndarray:
        return self.table[self.ids[part]]


def label_shares(emit: Scores | np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Mean label marginals of one sequence, by a forward-backward that keeps a piece of the words at a time: the forward
    state is kept at the pieces' starts only and walked again when the backward state comes by."""
    k, n = len(start), len(emit)
    size = max(1, LONG // (8 * k))
    a = np.exp(trans - trans.max())

    def weights(at: int) -> np.ndarray:
        e = emit[at:at + size]
        return np.exp(e - e.max(axis=1, keepdims=True))

    def forward(v: np.ndarray, psi: np.ndarray, first: bool) -> np.ndarray:
        out = np.empty_like(psi)
        for i, w in enumerate(psi):
            v = (v if first and i == 0 else v @ a) * w
            v /= v.sum()
            out[i] = v
        return out

    begins = [np.exp(start - start.max())]
    for at in range(0, n, size):
        begins.append(forward(begins[-1], weights(at), at == 0)[-1])
    shares, after = np.zeros(k), np.ones(k)
    for at in reversed(range(0, n, size)):
        psi = weights(at)
        alpha, beta = forward(begins[at // size], psi, at == 0), np.empty_like(psi)
        for i in range(len(psi) - 1, -1, -1):
            beta[i] = after
            after = a @ (psi[i] * after)
            after /= after.sum()
        p = alpha * beta
        shares += (p / p.sum(axis=1, keepdims=True)).sum(axis=0)
    return shares / n


def fit(sample: list[tuple[str, str]]) -> Model:
    """The CRF of maximum penalised likelihood (Adagrad) on (text, language) rows, whose words all carry the language."""
    labels = sorted({lang for _, lang in sample})
    k = len(labels)
    seqs = [([w.lower() for w in WORD.findall(text)][:TRAIN_WORDS], labels.index(lang)) for text, lang in sample]
    seqs = [(ws, y) for ws, y in seqs if ws]
    types = sorted({w for ws, _ in seqs for w in ws})
    at = {w: i for i, w in enumerate(types)}
    feats = features(types)
    rows, cols, scale = feats
    ids = [(np.array([at[w] for w in ws]), y) for ws, y in seqs]
    weights, trans, start = np.zeros((DIMS, k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.full(x.shape, 1e-6) for x in (weights, trans, start)]
    gold_e, gold_t, gold_s = np.zeros((len(types), k)), np.zeros((k, k)), np.zeros(k)
    for x, y in ids:
        np.add.at(gold_e[:, y], x, 1)
        gold_t[y, y] += len(x) - 1
        gold_s[y] += 1
    n = max(1, sum(len(x) for x, _ in ids))
    places = np.concatenate([x for x, _ in ids]) if ids else None
    for _ in range(STEPS if k > 1 else 0):
        emit = word_scores(feats, weights)
        got_e, got_t, got_s = np.zeros_like(gold_e), np.zeros_like(gold_t), np.zeros_like(gold_s)
        if ids:
            p, got_t = marginals([emit[x] for x, _ in ids], trans, start)
            got_e = np.stack([np.bincount(places, p[:, j], len(types)) for j in range(k)], axis=1)
            got_s = p[np.cumsum([0, *(len(x) for x, _ in ids)])[:-1]].sum(axis=0)
        ge = (gold_e - got_e) / n
        gw = np.stack([np.bincount(cols, (scale * ge[:, j])[rows], DIMS) for j in range(k)], axis=1)
        for par, grad, s in ((weights, gw, sums[0]), (trans, (gold_t - got_t) / n, sums[1]), (start, (gold_s - got_s) / n, sums[2])):
            g = grad - RIDGE * par / n
            s += g * g
            par += 0.3 * g / np.sqrt(s)
    # all of a training row's words carry one label: keep a floor under switches, or none would ever be seen
    return Model(labels, weights, np.maximum(trans, trans.max() - 6.0), start)


def train(docs: DataFrame) -> Model | None:
    """A model of the labelled rows of ``docs`` (text, lang), or None if there is no labelled text with a letter."""
    rows = docs.where("lang is not null and text rlike '\\\\p{L}'").select(
        "lang", F.substring("text", 1, TRAIN_CHARS).alias("text"), F.xxhash64(F.lit(SEED), "text").alias("h"))
    # bounded per language while aggregating: no task holds a language's rows
    least = rows.groupBy("lang", F.pmod("h", F.lit(TRAIN_DOCS)).alias("slot")).agg(F.min_by("text", "h").alias("text"))
    sample = sorted((r["text"], r["lang"]) for r in least.select("text", "lang").collect())
    return fit(sample) if sample else None


def predict(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` and columns ``lang`` and ``score``: the language of the whole text and its share of the words.

    A null text, one without a letter, or no model: ``und`` with score 0. Other columns pass through unchanged.
    """
    at = docs.columns.index("text")
    out = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)   # DIMS x K numbers

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache: dict[str, int] = {}
        table = np.zeros((0, len(m.labels) if m else 1))

        def flush(todo: list[tuple[int, list[str]]], langs: list, scores: list) -> None:
            nonlocal table
            if len(cache) > CACHE:
                cache.clear()
                table = table[:0]
            new = list({w for _, words in todo for w in words if w not in cache})
            if new:
                cache.update(zip(new, range(len(cache), len(cache) + len(new))))
                table = np.concatenate([table, word_scores(features(new), m.weights)])
            ids = [np.fromiter((cache[w] for w in words), np.int64, len(words)) for _, words in todo]
            if len(todo) == 1 and len(ids[0]) * len(m.labels) ** 2 > LONG:
                shares = [label_shares(Scores(table, ids[0]), m.trans, m.start)]
            else:
                p, _ = marginals([table[x] for x in ids], m.trans, m.start)
                ends = np.cumsum([len(x) for x in ids])
                shares = [p[end - len(x):end].mean(axis=0) for x, end in zip(ids, ends)]
            for (row, _), share in zip(todo, shares):
                best = int(share.argmax())
                langs[row], scores[row] = m.labels[best], min(1.0, float(share[best]))

        for b in it:
            langs, scores, todo, n = ["und"] * b.num_rows, [0.0] * b.num_rows, [], 0
            for row, text in enumerate(b.column(at)):
                words = WORD.findall((text.as_py() or "").lower()) if m else []
                if todo and (n + len(words)) * len(m.labels) ** 2 > AT_ONCE:
                    flush(todo, langs, scores)
                    todo, n = [], 0
                if words:
                    todo.append((row, words))
                    n += len(words)
            if todo:
                flush(todo, langs, scores)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*b.schema.names, lang, score])

    return docs.mapInArrow(batches, out)


def held_out():
    """Rows whose crc32(doc_id as text) mod 5 is 0: never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of ``docs``, learned from the rows that are not held out.

    A null doc_id is not held out; repeated rows are predicted alike; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", "lang")
    model = train(rows.where(~held_out()))
    return predict(rows.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a language, however its words are shared among languages; ``und`` rows (null or
    letterless texts; all, if there are no labelled rows to learn from) go."""
    model = train(docs.where(~held_out()))
    lang, score = free_name(docs, "crf_lang"), free_name(docs, "crf_score")
    return predict(docs, model, lang, score).where(F.col(lang) != "und").select(docs.columns)
