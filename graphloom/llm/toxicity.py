"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features of a text, all from its bytes: density and greatest weight of a lexicon of words and of word beginnings, how
near lexicon words stand to second-person words, share of capitals, punctuation, exclamation marks, symbols within or
after words (obfuscation), digits, and the length. The lexicon is learned: words and beginnings (4 to 7 bytes) whose
documents are mostly labelled toxic, weighed by log odds. So that the trees don't see a lexicon that knows their own
row, training rows get features from lexicons learned without their fold. The trees are fitted by Newton steps on
histograms; out-of-fold scores are calibrated by pooled adjacent violators and interpolated.

Fitting uses a bounded sample of labelled rows (MAX_ROWS and MAX_BYTES of text, those of the smallest hash), which are
parameters; features and scores cover all rows and whole texts, in one pass without a shuffle. A lexicon word must stand
in 3 toxic rows of the sample, in 2 where fewer than 200 are toxic.

Defined results: null and empty texts get the score of their features (all zero); labels that are null aren't learned
from; rows of equal id, text and label count once in the sample; with fewer than 10 labelled rows, or without labels of
both kinds, nothing can be learned: every score is the share of label 1 (0 without labels), and drop_toxic keeps every
document rather than judge by it; drop_toxic keeps null and empty texts; equal texts get equal scores; an empty table
gives an empty one. Other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import slices, text_bytes, trimmed

#: Labelled rows to fit on, and bytes of their texts: what one task holds.
MAX_ROWS, MAX_BYTES = 8_000, 64 << 20
FOLDS = 5
#: Second-person words of the languages that the tables hold.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "usted", "ustedes", "tú", "ti", "vosotros")
#: Lexicon that any training starts from: common insults.
SEED_LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "imbecile", "garbage", "filth", "vermin", "degenerate", "bastard", "bitch", "asshole", "retard", "cretin")
FEATURES = ("word_density", "word_top", "start_density", "start_top", "hits", "second_person", "capitals", "punctuation", "exclamation", "symbols", "digits", "length", "both_top")
_OUTSIDE = np.ones(256, bool)  # words here are runs of letters, digits and bytes from 0x80 on
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LENGTHS = (4, 5, 6, 7)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CAPITAL = _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_PUNCT = _class(b".,;:?!'\"-()")
_SYMBOL = _class(b"#$%&*@^~+=|<>_\\/{}[]")
_DIGIT = _class(b"0123456789")


def _hash_words(words: tuple[str, ...]) -> np.ndarray:
    raw = np.frombuffer(b" ".join(w.encode() for w in words), np.uint8)
    return np.unique(tokens.words(raw, np.array([0, len(raw)]), _OUTSIDE)[0])


def word_keys(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hashes of the words, of their beginnings of each length (0 where the word is no longer), and text numbers."""
    hashes, text, start, length = tokens.words(raw, offsets, _OUTSIDE)
    begins = []
    lower = tokens._LOWER[raw] if len(raw) else np.zeros(0, np.uint64)
    for n in _LENGTHS:
        at = np.where(length > n, start, -1)
        key = np.zeros(len(at), np.uint64)
        for k in range(n):
            key = (key + lower[np.minimum(start + k, max(len(raw) - 1, 0))]) * np.uint64(0x9E3779B97F4A7C15)
        begins.append(np.where(at >= 0, tokens.mix(key + np.uint64(n)) | np.uint64(1), np.uint64(0)))
    return hashes, begins, text


@dataclass
class Lexicon:
    """Sorted hashes with weights, of words and of beginnings."""

    words: np.ndarray
    word_weights: np.ndarray
    starts: np.ndarray
    start_weights: np.ndarray


def _weigh(keys: np.ndarray, rows: np.ndarray, toxic: np.ndarray, least: int, odds: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys that stand in `least` toxic rows or more with log odds of at least `odds`, by rows that hold them."""
    order = np.argsort(keys, kind="stable")  # rows rise, and so they do within a key
    keys, rows = keys[order], rows[order]
    del order
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    keys, rows = keys[first], rows[first]
    kinds, at = np.unique(keys, return_inverse=True)
    bad = np.bincount(at, toxic[rows], len(kinds))
    good = np.bincount(at, minlength=len(kinds)) - bad
    n_bad, n_good = max(toxic.sum(), 1), max(len(toxic) - toxic.sum(), 1)
    weight = np.log((bad + 0.1) / n_bad) - np.log((good + 0.1) / n_good)
    pick = (bad >= least) & (weight >= odds)
    return kinds[pick], weight[pick]


def learn_lexicon(words: np.ndarray, starts: Iterable[np.ndarray], text: np.ndarray, toxic: np.ndarray, seed: np.ndarray) -> Lexicon:
    least = 2 if toxic.sum() < 200 else 3
    w, ww = _weigh(words, text, toxic, least, 2.0)
    new = np.setdiff1d(seed, w)
    w, ww = np.concatenate([w, new]), np.concatenate([ww, np.full(len(new), 3.0)])
    order = np.argsort(w)
    got = [_weigh(k[k > 0], text[k > 0], toxic, max(least, int(0.01 * toxic.sum())), 2.5) for k in starts]  # one length at a time
    s, sw = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, kind) for i, kind in ((0, np.uint64), (1, float)))
    rising = np.argsort(s)
    return Lexicon(w[order], ww[order], s[rising], sw[rising])


def _weights(keys: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, weights[at], 0.0)


def features(raw: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, keys=None) -> np.ndarray:
    """One row of FEATURES for each text."""
    rows = len(offsets) - 1
    words, starts, text = keys or word_keys(raw, offsets)
    own = _weights(words, lexicon.words, lexicon.word_weights)
    begin = np.zeros(len(words))
    for s in starts:
        begin = np.maximum(begin, _weights(s, lexicon.starts, lexicon.start_weights))
    total = np.maximum(np.bincount(text, minlength=rows), 1)
    out = np.zeros((rows, len(FEATURES)))

    def top(values: np.ndarray) -> np.ndarray:
        best = np.zeros(rows)
        np.maximum.at(best, text[values > 0], values[values > 0])
        return best

    hit = (own > 0) | (begin > 0)
    out[:, 0] = np.bincount(text, own, rows) / total
    out[:, 1] = top(own)
    out[:, 2] = np.bincount(text, begin, rows) / total
    out[:, 3] = top(begin)
    out[:, 4] = np.bincount(text, hit, rows)
    out[:, 12] = top(np.where((own > 0) & (begin > 0), own + begin, 0.0))
    second = np.flatnonzero(np.isin(words, _hash_words(SECOND_PERSON)))
    at = np.flatnonzero(hit)
    if len(second) and len(at):
        near = np.zeros(len(at))
        for shift in (-1, 0):
            k = np.clip(np.searchsorted(second, at) + shift, 0, len(second) - 1)
            gap = np.abs(second[k] - at)
            near = np.maximum(near, np.where(text[second[k]] == text[at], 1.0 / (1.0 + gap), 0.0))
        out[:, 5] = np.bincount(text[at], near, rows)
    size = np.maximum(np.diff(offsets), 1)

    def share(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    for column, kind in ((6, _CAPITAL), (7, _PUNCT), (8, _class(b"!")), (9, _SYMBOL), (10, _DIGIT)):
        out[:, column] = share(kind)
    out[:, 11] = np.log1p(np.diff(offsets))
    return out


@dataclass
class Trees:
    """Boosted trees of one depth, each as its nodes' features and cuts in level order, and its leaves' values."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, penalty: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss, with cuts at quantiles."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], 1)
    score = np.full(len(y), model.base)
    width = bins + 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        inner = 2**depth - 1
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            if len(rows) >= 8:
                best = 1e-6
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for j in range(x.shape[1]):
                    left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], width))[: len(edges[j])]
                    left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], width))[: len(edges[j])]
                    gain = left_g**2 / (left_h + penalty) + (total_g - left_g) ** 2 / (total_h - left_h + penalty) - total_g**2 / (total_h + penalty)
                    if len(gain) and gain.max() > best:
                        at = int(gain.argmax())
                        best, feature[k], cut[k] = float(gain[at]), j, edges[j][at]
            node[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
        leaf = node - inner
        size = 2**depth
        value = -rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + penalty)
        model.trees.append((feature, cut, value))
        score += value[leaf]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: rising knots (score, share of label 1), to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, n1, _, hi = blocks.pop()
            v0, n0, lo, _ = blocks[-1]
            blocks[-1] = [(v0 * n0 + v1 * n1) / (n0 + n1), n0 + n1, lo, hi]
    knots = [(x, b[0]) for b in blocks for x in dict.fromkeys((b[2], b[3]))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray] | None

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(offsets) - 1, self.trees.base)
        margin = self.trees.raw(features(raw, offsets, self.lexicon))
        return np.clip(0.98 * np.interp(margin, *self.knots) + 0.02 / (1 + np.exp(-margin)), 0, 1)


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """A model from labelled texts; see the module's text."""
    y = np.array(labels, float)
    none = np.zeros(0, np.uint64)
    empty = Lexicon(none, np.zeros(0), none, np.zeros(0))
    if len(y) < 10 or y.min() == y.max():
        return Model(empty, Trees(float(y.mean()) if len(y) else 0.0), None)
    parts, number = [], 0  # slices of the texts, so that nothing is held for all bytes at once
    for batch in slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])]), "text"):
        raw, offsets = text_bytes(batch.column(0))
        own = word_keys(raw, offsets)
        parts.append((raw, offsets, own, number))
        number += batch.num_rows
    words = np.concatenate([p[2][0] for p in parts])
    starts = [np.concatenate([p[2][1][i] for p in parts]) for i in range(len(_LENGTHS))]
    text = np.concatenate([(p[2][2] + p[3]).astype(np.int32) for p in parts])
    ends = np.cumsum([0, *(len(p[2][0]) for p in parts)])
    parts = [(raw, offsets, slice(ends[i], ends[i + 1]), number) for i, (raw, offsets, _, number) in enumerate(parts)]
    seed = _hash_words(SEED_LEXICON)
    fold = np.arange(len(y)) % FOLDS
    x = np.zeros((len(y), len(FEATURES)))

    def learned(rows: np.ndarray) -> Lexicon:
        keep = rows[text]
        numbers = (np.cumsum(rows) - 1).astype(np.int32)[text[keep]]
        return learn_lexicon(words[keep], (s[keep] for s in starts), numbers, y[rows], seed)

    for f in range(FOLDS):
        lexicon = learned(fold != f)
        x[fold == f] = np.concatenate([features(raw, offsets, lexicon, (words[at], [s[at] for s in starts], text[at] - number)) for raw, offsets, at, number in parts])[fold == f]
    out = np.zeros(len(y))
    for f in range(FOLDS):
        out[fold == f] = fit_trees(x[fold != f], y[fold != f]).raw(x[fold == f])
    return Model(learned(np.ones(len(y), bool)), fit_trees(x, y), isotonic(out, y))


def held_out(doc_id: Column, of: int = 5) -> Column:
    """crc32 of the id as text is divisible by `of`; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on labelled rows that aren't held out: in order of a hash of their id, as many as the two bounds allow.

    One task of an executor fits; the driver gets only the model."""
    marks = labels.select(F.col(label_id).alias("_i"), F.col(label_col).cast("int").alias("_y")).where(F.col("_i").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_i"))).distinct()
    marks = marks.orderBy(F.xxhash64("_i"), "_i", "_y").limit(max_rows)
    met = docs.join(F.broadcast(marks), docs[id_col] == marks["_i"])  # at most max_rows labels
    rows = met.select(marks["_i"].alias("i"), docs[text_col].alias("t"), marks["_y"].alias("y")).withColumn("k", F.md5(F.coalesce("t", F.lit(""))))
    sizes = rows.groupBy("i", "k", "y").agg(F.max(F.coalesce(F.octet_length("t"), F.lit(0))).alias("b")).orderBy(F.xxhash64("i"), "i", "k", "y").limit(max_rows)
    before = Window.orderBy(F.xxhash64("i"), "i", "k", "y").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of max_rows rows at most
    wanted = sizes.withColumn("sum", F.sum("b").over(before)).where(F.col("sum") <= max_bytes).select("i", "k", "y")
    got = rows.join(F.broadcast(wanted), ["i", "k", "y"]).dropDuplicates(["i", "k", "y"]).select("i", "t", "y").repartition(1).mapInArrow(trimmed(_fit_rows), "model binary").first()
    return pickle.loads(got["model"]) if got else fit([], [])


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All (i, t, y), in one order however they arrive, to one pickled model."""
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[0], r[1] or "", r[2]))
    texts, marked = [r[1] for r in rows], [r[2] for r in rows]
    del rows
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, marked))], pa.binary())], names=["model"])


def scorer(model: Model):
    """mapInArrow function: (doc_id, text) to (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = model.score(*text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = train(docs, labels, id_col, text_col, **options)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    got = base.mapInArrow(trimmed(scorer(model)), "doc_id bigint, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The documents whose score is under the threshold, and those without text, with all their columns; all documents
    if the labels don't allow a model."""
    model = train(docs, labels, id_col, text_col, **options)
    if model.knots is None:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            column = batch.column(batch.schema.get_field_index(text_col))
            raw, offsets = text_bytes(column)
            yield batch.filter(pa.array((model.score(raw, offsets) < threshold) | (np.diff(offsets) == 0)))

    return docs.mapInArrow(trimmed(keep), docs.schema)
