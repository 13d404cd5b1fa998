"""Language identification by a linear-chain conditional random field over words.

Every word has hashed features: the word itself, its prefixes and suffixes of one
to three letters, its letter bigrams and trigrams, and the languages in
whose learned lexicon it stands.  Feature weights and the transitions between labels
are learned together by maximising the log-likelihood (L2-regularised, Adam) on spans of
labelled texts; half of the training sequences join spans of two languages, so the
transitions know code-switched text.  Words are labelled by forward-backward over the
whole text.  The text's language is the label with the largest sum of word marginals, its
score the mean marginal of that label.

Training reads a bounded sample: ``DOCS_PER_LANG`` rows for each of the ``MAX_LABELS`` most frequent languages (ties by
code point; rows of rarer ones are not learned from) and
``SPANS`` spans of ``SPAN_WORDS`` words from places over the whole text of each.
Prediction uses the text alone and covers every word of every text.

``accepted`` drops texts without a letter and texts whose words are no evidence of any learned language: a word's
evidence is the share of its letter trigrams, ends included, that stand in the training words of some language, and a text goes if
the mean of its words is below ``MIN_EVIDENCE``.  A text that is divided evenly among languages stays.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with no
labelled row to learn from, every text is ``und`` and ``accepted`` keeps all that have a letter.  Ties go to the first
label by code point.  Only doc_id, text and lang are read to learn, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glean.llm.common import id_crc

DOCS_PER_LANG, SPANS, SPAN_WORDS = 200, 8, 24
HELD_OUT_MOD, HELD_OUT = 4, 2
UNKNOWN = "und"
MAX_LABELS = 64
#: A text is rejected if a smaller share of its words' trigrams is known.
MIN_EVIDENCE = 0.3

BUCKETS = 1 << 16
LEXICON_WORDS = 400
ROUNDS, STEP, L2 = 40, 0.15, 1e-4
CACHED_WORDS = 300_000  # a worker's memo of word weights; it is emptied when full
CELLS = 300_000  # words that are labelled together

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


class _Buckets(dict):
    """Memo of hashed features; emptied when full."""

    def __missing__(self, feature: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[feature] = zlib.crc32(feature.encode()) % BUCKETS
        return h


_BUCKET = _Buckets()


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed features of a word."""
    w, n, get = f"^{word}$", len(word) + 2, _BUCKET.__getitem__
    out = [zlib.crc32(word.encode()) % BUCKETS, get(f"lexicon {lexicon.get(word, 0)}"), get(f"affix {w[:4]}"), get(f"affix {w[-4:]}")]
    out += [get(w[i : i + 2]) for i in range(n - 1)]  # the first and last ones are the shorter affixes
    out += [get(w[i : i + 3]) for i in range(n - 2)]
    return out


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    trans: np.ndarray  # labels x labels, log scale
    lexicon: dict[str, int]  # word -> bits of the languages whose lexicon has it
    grams: frozenset[str] = frozenset()  # letter trigrams of the training words

    def potentials(self, ws: list[str]) -> np.ndarray:
        """Word potentials, exp scale, the largest of each word 1."""
        feats = [features(w, self.lexicon) for w in ws]
        size = np.fromiter(map(len, feats), np.int64, len(feats))
        flat = np.fromiter(chain.from_iterable(feats), np.int64, int(size.sum()))
        begin = np.cumsum(size) - size
        e = np.add.reduceat(self.weights[flat], begin, axis=0) / np.sqrt(size)[:, None]
        return np.exp(np.clip(e - e.max(axis=1, keepdims=True), -30, 0))


def marginals(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over sequences side by side, longest first.

    ``e``: time x sequence x label potentials, exp scale.  Returns word marginals (0 past the end), the
    expected transition counts and the log-likelihood's normaliser of each sequence.
    """
    steps, n, k = e.shape
    m = np.exp(trans)
    active = (lengths[None, :] > np.arange(steps)[:, None]).sum(axis=1)
    alpha, scale = np.zeros_like(e), np.ones((steps, n), e.dtype)
    a = e[0] / k
    for t in range(steps):
        c = active[t]
        if t:
            a = (a[:c] @ m) * e[t, :c]
        s = a.sum(axis=1)
        a = a / s[:, None]
        alpha[t, :c], scale[t, :c] = a, s
    pairs = np.zeros((k, k))
    post = np.zeros_like(e)
    b = np.ones((n, k), e.dtype)
    for t in range(steps - 1, -1, -1):
        c = active[t]
        if t + 1 < steps and active[t + 1]:
            d = active[t + 1]
            r = e[t + 1, :d] * b[:d] / scale[t + 1, :d, None]
            pairs += (alpha[t, :d].T @ r) * m
            b[:d] = r @ m.T
        post[t, :c] = alpha[t, :c] * b[:c]
    return post, pairs, np.log(scale).sum(axis=0)


def train(spans: list[tuple[str, list[str]]]) -> Crf:
    """Fit the model to (language, words) spans."""
    spans = [(la, ws) for la, ws in spans if ws]
    labels = sorted({la for la, _ in spans})
    k = len(labels)
    counts = {la: Counter() for la in labels}
    for la, ws in spans:
        counts[la].update(ws)
    lexicon: dict[str, int] = {}
    for i, la in enumerate(labels):
        for w, n in sorted(counts[la].items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]:
            if n > 1:
                lexicon[w] = lexicon.get(w, 0) | 1 << i
    grams = frozenset(g for own in counts.values() for w in own for g in _trigrams(w))
    model = Crf(labels, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), lexicon, grams)
    if k < 2:
        return model
    # Every span alone, and joined with a span of another language.
    rng = np.random.default_rng(11)
    order = rng.permutation(len(spans))
    seqs = [([la] * len(ws), ws) for la, ws in spans]
    for i, j in zip(order, np.roll(order, 1)):
        (x, u), (y, v) = spans[i], spans[j]
        if x != y:
            seqs.append(([x] * len(u) + [y] * len(v), u + v))
    seqs.sort(key=lambda s: -len(s[1]))
    vocab = {w: i for i, w in enumerate(sorted({w for _, ws in seqs for w in ws}))}
    number = {la: i for i, la in enumerate(labels)}
    feats = [features(w, lexicon) for w in vocab]
    size = np.array([len(f) for f in feats])
    owner, flat = np.repeat(np.arange(len(feats)), size), np.concatenate(feats)
    begin, norm = np.concatenate(([0], np.cumsum(size)[:-1])), 1 / np.sqrt(size)
    lengths = np.array([len(ws) for _, ws in seqs])
    ids = np.zeros((lengths[0], len(seqs)), np.int64)
    gold = np.zeros((lengths[0], len(seqs)), np.int64)
    for j, (ls, ws) in enumerate(seqs):
        ids[: len(ws), j] = [vocab[w] for w in ws]
        gold[: len(ws), j] = [number[la] for la in ls]
    inside = np.arange(lengths[0])[:, None] < lengths[None, :]
    truth = np.zeros((len(vocab), k))
    np.add.at(truth, (ids[inside], gold[inside]), 1)
    seen = np.zeros((k, k))
    both = inside[1:]
    np.add.at(seen, (gold[:-1][both], gold[1:][both]), 1)
    total = int(inside.sum())
    w, trans = np.zeros((BUCKETS, k)), np.zeros((k, k))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, trans)]
    for r in range(1, ROUNDS + 1):
        emit = np.add.reduceat(w[flat], begin, axis=0) * norm[:, None]
        emit -= emit.max(axis=1, keepdims=True)
        post, pairs, _ = marginals(np.exp(np.clip(emit, -30, 0))[ids], lengths, trans)
        expect = np.stack([np.bincount(ids[inside], post[..., c][inside], len(vocab)) for c in range(k)], axis=1)
        miss = (truth - expect) * norm[:, None] / total
        grad_w = np.stack([np.bincount(flat, miss[owner, c], BUCKETS) for c in range(k)], axis=1) - L2 / total * w
        grad_t = (seen - pairs) / total - L2 / total * trans
        for p, g, (m1, m2) in zip((w, trans), (grad_w, grad_t), moments):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p += STEP * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
    model.weights, model.trans = w.astype(np.float32), trans
    return model


class Labeller:
    """Predicts texts with a model; keeps the weights of words it has met."""

    def __init__(self, model: Crf):
        self.model = model
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.labels)), np.float32)
        self.known = np.zeros(1024, np.float32)

    def _ids(self, ws: list[str]) -> np.ndarray:
        rows = self.rows
        new = sorted(set(ws).difference(rows))
        if new:
            have = len(rows)
            while have + len(new) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
                self.known = np.concatenate((self.known, np.zeros_like(self.known)))
            self.table[have : have + len(new)] = self.model.potentials(new)
            self.known[have : have + len(new)] = [sum(g in self.model.grams for g in gs) / len(gs) for gs in map(_trigrams, new)]
            rows.update(zip(new, range(have, have + len(new))))
        return np.fromiter(map(rows.__getitem__, ws), np.int32, len(ws))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, mean evidence of the words) of every text."""
        out: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        if not self.model.labels:
            return out
        waiting: list[tuple[int, np.ndarray]] = []
        for i, text in enumerate(texts):
            ws = words(text)
            if ws:
                waiting.append((i, self._ids(ws)))
            if len(self.rows) > CACHED_WORDS or i + 1 == len(texts):
                self._label(waiting, out)
                waiting = []
                if len(self.rows) > CACHED_WORDS:
                    self.rows, self.table = {}, np.zeros((1024, len(self.model.labels)), np.float32)
                    self.known = np.zeros(1024, np.float32)
        return out

    def _label(self, waiting: list[tuple[int, np.ndarray]], out: list[tuple[str, float, float]]) -> None:
        waiting = sorted(waiting, key=lambda x: -len(x[1]))
        at = 0
        while at < len(waiting):
            longest = len(waiting[at][1])
            group = waiting[at : at + max(1, CELLS // longest)]
            at += len(group)
            lengths = np.array([len(ids) for _, ids in group])
            ids = np.zeros((longest, len(group)), np.int32)
            for j, (_, own) in enumerate(group):
                ids[: len(own), j] = own
            post, _, _ = marginals(self.table[ids], lengths, self.model.trans.astype(np.float32))
            share = post.sum(axis=0, dtype=np.float64) / lengths[:, None]
            for (i, own), s in zip(group, share / share.sum(axis=1, keepdims=True)):
                best = int(s.argmax())
                out[i] = (self.model.labels[best], float(min(1.0, s[best])), float(self.known[own].mean(dtype=np.float64)))


def fit(docs: DataFrame) -> Crf:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that are not held out and have a language."""
    own = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (id_crc() % HELD_OUT_MOD != HELD_OUT))
    frequent = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LABELS)
    labels = [r["lang"] for r in frequent.collect()]
    rows = own.filter(F.col("text").isNotNull() & F.col("lang").isin(labels))
    # The rank limit is applied within each task first, so a frequent language is never gathered.
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(7), F.col("doc_id")), F.col("doc_id"))
    picked = rows.select("doc_id", "lang", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= DOCS_PER_LANG).drop("rank")
    picked = picked.distinct().withColumnsRenamed({"doc_id": "d", "lang": "la"})
    chosen = rows.join(F.broadcast(picked), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("lang") == F.col("la")))

    @F.pandas_udf("array<array<string>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([_spans(words(t)) for t in texts], dtype=object)

    # One text of an id that repeats, so that no more rows are collected than were picked.
    found = chosen.select("doc_id", "lang", spans("text").alias("s")).groupBy("doc_id", "lang").agg(F.min("s").alias("s")).collect()
    found.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"]))
    return train([(r["lang"], s) for r in found for s in r["s"]])


def _spans(ws: list[str]) -> list[list[str]]:
    """Up to ``SPANS`` spans at even distances over the whole text."""
    last = max(len(ws) - SPAN_WORDS, 0)
    begins = sorted({last * i // max(SPANS - 1, 1) for i in range(SPANS)}) if ws else []
    return [ws[b : b + SPAN_WORDS] for b in begins]


def predict(text: Column, model: Crf, like: DataFrame) -> Column:
    """struct<lang_pred:string,score:double,evidence:double> of each text."""
    shared = like.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights a language

    @F.pandas_udf("struct<lang_pred:string,score:double,evidence:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for texts in batches:
            yield pd.DataFrame(labeller.predict(list(texts)), columns=["lang_pred", "score", "evidence"])

    return run(text)


def identify(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    model = model or fit(docs)
    found = docs.select("doc_id", (id_crc() % HELD_OUT_MOD == HELD_OUT).alias("held_out"), predict(F.col("text"), model, docs).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def accepted(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose words are evidence of a learned language; all with a letter
    if there is none to learn."""
    model = model or fit(docs)
    if not model.labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    p = predict(F.col("text"), model, docs)
    return docs.filter((p["lang_pred"] != UNKNOWN) & (p["evidence"] >= MIN_EVIDENCE))
