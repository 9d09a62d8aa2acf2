"""Quality: random-indexing word vectors pooled per document, a two-layer numpy network, temperature-calibrated.

Each token has a fixed sparse index vector drawn from its hash. A word's vector is the sum of the index vectors around
it in the sample, so unseen words fall back on their own index vector. Tokens are words and runs of other signs, and
each also counts by its shape (letters, capitals, digits, signs), so that vectors of shapes tell what unseen words
look like. A document is the mean of its words' and of its shapes' vectors, with the logarithm of its length.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from strail.llm.common import sample_labelled
from strail.llm.toxicity import scored, sigmoid

DIM, NONZERO, NEAR = 48, 6, 2
WORDS = 20_000  # words with a context vector
HIDDEN = 24
PER_CLASS = 2000  # labelled documents of each class that are learned from, at most
EPOCHS, BATCH = 60, 64
REMEMBERED = 120_000
GROUP = 200  # documents whose new words are looked up together

_tokens = re.compile(r"\w+|[^\w\s]+").findall
_shape = str.maketrans({**{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "0" for c in "0123456789"}})
_runs = re.compile(r"(.)\1+")


def shape(token: str) -> str:
    """Letters as a or A, digits as 0, runs of one sign as two: `Hello` is `Aaa`, `!!!!` is `!!`; of the whole token."""
    s = token.translate(_shape) if token.isascii() else "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token)
    return _runs.sub(r"\1\1", s)


def index_vectors(tokens: list[str]) -> np.ndarray:
    """The sparse ternary vectors of tokens, from their hashes alone."""
    v = np.zeros((len(tokens), DIM), np.float32)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    rows = np.arange(len(tokens))
    for _ in range(NONZERO):
        sign = np.where(h >> np.uint64(32) & np.uint64(1), np.float32(1), np.float32(-1))
        v[rows, (h % np.uint64(DIM)).astype(np.int64)] += sign
        h = h * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
        h ^= h >> np.uint64(29)
    return v / np.float32(np.sqrt(NONZERO))


class Model:
    def __init__(self):
        self.words: dict[str, np.ndarray] = {}
        self.mean, self.spread = np.zeros(2 * DIM + 2, np.float32), np.ones(2 * DIM + 2, np.float32)
        self.w1, self.b1 = np.zeros((2 * DIM + 2, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32)
        self.w2, self.b2, self.temperature = np.zeros(HIDDEN, np.float32), 0.0, 1.0

    def vectors(self, tokens: list[str]) -> np.ndarray:
        """Word part and shape part of each token."""
        out = np.empty((len(tokens), 2 * DIM), np.float32)
        out[:, :DIM] = index_vectors(tokens)
        for i, t in enumerate(tokens):
            if (got := self.words.get(t)) is not None:
                out[i, :DIM] = got
        shapes = [shape(t) for t in tokens]
        own = sorted(set(shapes))
        place = dict(zip(own, range(len(own)), strict=True))
        out[:, DIM:] = index_vectors(["\0" + x for x in own])[[place[x] for x in shapes]]
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.spread
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray, seed: int = 3) -> Model:
        """Train on whole texts; with one class only the score is that class's, with none 1 (nothing is rejected)."""
        model, rng, y = cls(), np.random.default_rng(seed), np.asarray(y)
        if len(set(y.tolist())) < 2:
            model.b2 = -4.0 if len(y) and y[0] == 0 else 4.0
            return model
        count: Counter = Counter()
        for t in texts:
            count.update(_tokens(t))
        known = [w for w, n in sorted(count.items(), key=lambda x: (-x[1], x[0])) if n > 1][:WORDS]
        place = {w: i for i, w in enumerate(known)}
        base = index_vectors(known)
        padded = np.vstack([base, np.zeros((1, DIM), np.float32)])
        total = np.zeros_like(padded)
        for t in texts:
            ids = np.array([place.get(w, len(known)) for w in _tokens(t)], np.int64)
            for k in range(1, NEAR + 1):
                np.add.at(total, ids[k:], padded[ids[:-k]])
                np.add.at(total, ids[:-k], padded[ids[k:]])
        norm = np.linalg.norm(total[:-1], axis=1, keepdims=True)
        context = np.where(norm > 0, total[:-1] / np.maximum(norm, 1e-9), 0)
        model.words = dict(zip(known, (0.5 * context + base).astype(np.float32), strict=True))
        scorer = Scorer(model)
        x = scorer.features(texts)
        model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        check = rng.random(len(y)) < 0.2  # held back from the weights for the temperature
        weights = {"w1": (rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1])).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32), "w2": (rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32), "b2": np.zeros(1, np.float32)}
        z, target, moment, step = (x - model.mean) / model.spread, y.astype(np.float32), {k: [0.0, 0.0] for k in weights}, 0
        train = np.flatnonzero(~check)
        share = np.where(y == 1, 0.5 / max((y[train] == 1).mean(), 1e-9), 0.5 / max((y[train] == 0).mean(), 1e-9)).astype(np.float32)
        share = np.sqrt(share)  # halfway to balanced classes
        for _ in range(EPOCHS):
            for i in range(0, len(train), BATCH):
                own = rng.permutation(train)[:BATCH] if i == 0 else train[rng.integers(0, len(train), BATCH)]
                a = z[own] @ weights["w1"] + weights["b1"]
                h = np.maximum(a, 0)
                d = (sigmoid(h @ weights["w2"] + weights["b2"][0]) - target[own]) * share[own] / len(own)
                da = d[:, None] * weights["w2"] * (a > 0)
                g = {"w1": z[own].T @ da + 1e-4 * weights["w1"], "b1": da.sum(axis=0), "w2": h.T @ d + 1e-4 * weights["w2"], "b2": d.sum(keepdims=True)}
                step += 1
                for k, v in g.items():
                    m = moment[k]
                    m[0], m[1] = m[0] + 0.1 * (v - m[0]), m[1] + 0.01 * (v * v - m[1])
                    weights[k] -= (0.003 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        model.w1, model.b1, model.w2, model.b2 = weights["w1"], weights["b1"], weights["w2"], float(weights["b2"][0])
        if check.any():
            logit, t = model.logits(x[check]).astype(np.float64), target[check]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [np.mean(np.logaddexp(0, np.where(t == 1, -1, 1) * logit / k)) for k in grid]
            model.temperature = float(grid[int(np.argmin(loss))])
        return model


class Scorer:
    def __init__(self, model: Model):
        self.model, self.place, self.table = model, {}, np.zeros((0, 2 * DIM), np.float32)

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 2 * DIM + 2), np.float32)
        for i in range(0, len(texts), GROUP):
            group = [Counter(_tokens(t)) for t in texts[i : i + GROUP]]
            new = list(dict.fromkeys(w for c in group for w in c if w not in self.place))
            if len(self.place) + len(new) > REMEMBERED:
                self.place, new = {}, list(dict.fromkeys(w for c in group for w in c))
            if new:
                have = len(self.place)
                if have + len(new) > len(self.table):  # once, but for a group of more words than are remembered
                    table = np.empty((max(REMEMBERED, have + len(new)), 2 * DIM), np.float32)
                    table[:have] = self.table[:have]
                    self.table = table
                for k in range(0, len(new), 20_000):
                    part = self.model.vectors(new[k : k + 20_000])
                    self.table[have + k : have + k + len(part)] = part
                self.place.update(zip(new, range(have, have + len(new)), strict=True))
            for k, count in enumerate(group, i):
                if count:
                    ids = np.fromiter(map(self.place.__getitem__, count), np.int64, len(count))
                    n = np.fromiter(count.values(), np.float32, len(count))
                    total = float(n.sum())
                    out[k, : 2 * DIM] = (n / total) @ self.table[ids]
                    out[k, -2:] = np.log1p(total), len(count) / total
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """Probabilities of label 1; a text without a token has the features zero and no content, and scores 0."""
        p = sigmoid(self.model.logits(self.features(texts)).astype(np.float64) / self.model.temperature)
        return np.clip(np.where([bool(t.strip()) for t in texts], p, 0.0), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, mod: int = 5) -> Model:
    """Learn from at most per_class labelled documents of each class whose fold isn't 0."""
    texts, y, _ = sample_labelled(docs.sparkSession, docs, labels, "quality", mod, per_class)
    return Model.fit(texts, y)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False, out_col: str = "score") -> DataFrame:
    """docs with out_col (0 to 1; null and empty texts 0), without the text unless it is to be kept."""
    return scored(docs, model, Scorer, text_col, keep_text, out_col)
