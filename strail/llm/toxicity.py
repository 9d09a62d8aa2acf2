"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A token's input joins its word vector and the mean vector of all its character n-grams; runs of over 32 word characters
(text without white space) are cut into tokens that overlap by half. Windows of 32 tokens that overlap
by half cover the whole text; a document's logit is the largest of its windows', set to a probability on the training
documents. Training picks, in each round, the windows that stand for their document now: the worst one of each, and a
random one of the clean documents. A window with two directions of 8 units takes a few thousand multiplications a
token, so whole texts are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strail.llm.common import sample_labelled

WINDOW, STRIDE = 32, 16
UNITS, WORD_DIM, CHAR_DIM = 8, 8, 8
LONGEST, STEP = 32, 16  # characters of a token at most; longer ones are cut into tokens that start each STEP characters
WORDS, BUCKETS, GRAMS = 4000, 2048, 2 * LONGEST  # known words; places for character n-grams; n-grams of a longest token
PER_CLASS = 700  # labelled documents of each class that are learned from, at most
ROUNDS, BATCH, DRAWS = 8, 96, 1200  # DRAWS: windows of each class in a round
REMEMBERED = 150_000  # words whose inputs a worker remembers
CHUNK = 4096  # windows scored at once

_tokens = re.compile(r"\w+").findall


def tokens(text: str) -> list[str]:
    found = _tokens(text.lower())
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[a : a + LONGEST] for w in found for a in range(0, max(1, len(w) - LONGEST + STEP), STEP)]


class _Places(dict):
    """Places of character n-grams, from 1 on; a pure function of the n-gram, kept as n-grams are few."""

    def __missing__(self, gram: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[gram] = got = 1 + xxhash.xxh32_intdigest(gram) % (BUCKETS - 1)
        return got


_places = _Places()


def char_ids(word: str) -> list[int]:
    """Places of all the word's character n-grams (3 characters, with its borders, and 1)."""
    w = f"<{word}>"
    return [*map(_places.__getitem__, map("".join, zip(w, word, w[2:]))), *map(_places.__getitem__, word)]


def padded(chars: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The n-grams of the words at rows, one more axis as wide as the longest of them; 0 pads."""
    n = counts[rows][..., None]
    at = np.arange(n.max())
    first = (np.cumsum(counts) - counts)[rows][..., None]
    return np.where(at < n, chars[np.minimum(first + at, len(chars) - 1)], 0)


def window_starts(n: int) -> np.ndarray:
    """Starts of overlapping windows that cover n tokens."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else np.zeros(0, np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights p: word and char vectors; W, U, b for both directions; attention A, v; output o, c."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, UNITS
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"word": 0.1 * rng.standard_normal((WORDS + 1, WORD_DIM)).astype(np.float32), "char": 0.3 * rng.standard_normal((BUCKETS, CHAR_DIM)).astype(np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": normal(d, 3 * h), f"U{side}": normal(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": normal(2 * h, h), "v": normal(h), "o": normal(2 * h), "c": np.zeros(1, np.float32)}
        self.p["word"][0] = 0
        self.p["char"][0] = 0
        self.vocabulary: dict[str, int] = {}
        self.scale = np.array([1.0, 0.0])  # logit -> scale[0] * logit + scale[1]

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids, the n-grams of all words in one row, and how many each word has (one at least)."""
        ids = [char_ids(w) for w in words]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.array([self.vocabulary.get(w, 0) for w in words], np.int32), np.fromiter(chain.from_iterable(ids), np.int32, counts.sum()), counts

    def vectors(self, word: np.ndarray, chars: np.ndarray) -> np.ndarray:
        n = np.maximum((chars > 0).sum(axis=-1, keepdims=True), 1).astype(np.float32)
        return np.concatenate([self.p["word"][word], self.p["char"][chars].sum(axis=-2) / n], axis=-1)

    def states(self, proj: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """proj: windows x steps x 3h inputs of the gates. States of one direction, in text order."""
        n, steps, _ = proj.shape
        h, u = np.zeros((n, UNITS), np.float32), self.p[f"U{side}"]
        out = np.empty((n, steps, UNITS), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g = h @ u
            zr = sigmoid(proj[:, t, : 2 * UNITS] + g[:, : 2 * UNITS])
            z, r = zr[:, :UNITS], zr[:, UNITS:]
            new = np.tanh(proj[:, t, 2 * UNITS :] + r * g[:, 2 * UNITS :])
            m = mask[:, t, None]
            nxt = np.where(m, new + z * (h - new), h)
            if keep is not None:
                keep.append((t, h, z, r, new, g[:, 2 * UNITS :], m))
            h = out[:, t] = nxt
        return out

    def pool(self, hs: np.ndarray, mask: np.ndarray) -> tuple:
        a = np.tanh(hs @ self.p["A"])
        s = np.where(mask, a @ self.p["v"], -1e9)
        w = np.exp(s - s.max(axis=1, keepdims=True)) * mask
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
        pooled = (w[:, :, None] * hs).sum(axis=1)
        return a, w, pooled, pooled @ self.p["o"] + self.p["c"][0]

    def logits(self, projected: np.ndarray, index: np.ndarray) -> np.ndarray:
        """projected: one row of gate inputs (both directions) for each distinct token; index: windows x steps, -1 pads."""
        out = np.empty(len(index), np.float32)
        for i in range(0, len(index), CHUNK):
            part = index[i : i + CHUNK]
            mask = part >= 0
            x = projected[part]
            hs = np.concatenate([self.states(x[:, :, : 3 * UNITS], mask, "f"), self.states(x[:, :, 3 * UNITS :], mask, "b")], axis=2)
            out[i : i + CHUNK] = self.pool(hs, mask)[3]
        return out

    def project(self, word: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(self.p["char"][chars], np.cumsum(counts) - counts, axis=0) / counts[:, None].astype(np.float32)
        x = np.concatenate([self.p["word"][word], mean], axis=-1)
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], axis=1)

    def gradients(self, word: np.ndarray, chars: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of one batch of windows (windows x steps of word ids and char ids)."""
        p, h = self.p, UNITS
        x = self.vectors(word, chars)
        kept: dict[str, list] = {"f": [], "b": []}
        hs = np.concatenate([self.states(x @ p[f"W{s}"] + p[f"b{s}"], mask, s, kept[s]) for s in "fb"], axis=2)
        a, w, pooled, logit = self.pool(hs, mask)
        prob = sigmoid(logit)
        loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
        d_logit = ((prob - y) / len(y)).astype(np.float32)
        g = {"o": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["o"]
        d_hs = w[:, :, None] * d_pooled[:, None, :]
        d_w = (hs * d_pooled[:, None, :]).sum(axis=2)
        d_s = w * (d_w - (w * d_w).sum(axis=1, keepdims=True))
        d_a = d_s[:, :, None] * p["v"] * (1 - a * a)
        g["v"] = (d_s[:, :, None] * a).sum(axis=(0, 1))
        g["A"] = np.tensordot(hs, d_a, ((0, 1), (0, 1)))
        d_hs = d_hs + d_a @ p["A"].T
        d_x = np.zeros_like(x)
        for side, own in (("f", d_hs[:, :, :h]), ("b", d_hs[:, :, h:])):
            u = p[f"U{side}"]
            d_proj = np.zeros((*x.shape[:2], 3 * h), np.float32)
            d_u, carry = np.zeros_like(u), np.zeros((len(x), h), np.float32)
            for t, before, z, r, new, gn, m in reversed(kept[side]):
                total = own[:, t] + carry
                d = np.where(m, total, 0)
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (before - new) * z * (1 - z)
                d_r = d_new * gn * r * (1 - r)
                d_proj[:, t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_g = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_u += before.T @ d_g
                carry = np.where(m, d * z, total) + d_g @ u.T
            g[f"U{side}"], g[f"b{side}"] = d_u, d_proj.sum(axis=(0, 1))
            g[f"W{side}"] = np.tensordot(x, d_proj, ((0, 1), (0, 1)))
            d_x += d_proj @ p[f"W{side}"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], word.ravel(), d_x[:, :, :WORD_DIM].reshape(-1, WORD_DIM))
        g["word"][0] = 0
        n = np.maximum((chars > 0).sum(axis=-1), 1)
        each = (d_x[:, :, WORD_DIM:] / n[:, :, None]).reshape(-1, CHAR_DIM)
        g["char"] = np.stack([np.bincount(chars.ravel(), np.repeat(each[:, j], chars.shape[-1]), BUCKETS) for j in range(CHAR_DIM)], axis=1).astype(np.float32)
        g["char"][0] = 0
        return loss, g

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray, seed: int = 5) -> Network:
        """Train on whole texts with labels 0 and 1. With one class only, or none, the score is that class's, or 0."""
        net, rng = cls(seed), np.random.default_rng(seed)
        docs = [tokens(t) for t in texts]
        used = [i for i, d in enumerate(docs) if d]
        docs, y = [docs[i] for i in used], np.asarray(y)[used] if len(used) else np.zeros(0, np.int64)
        if len(set(y.tolist())) < 2:
            net.p["o"][:] = 0
            net.scale = np.array([0.0, 3.0 if len(y) and y[0] == 1 else -3.0])
            return net
        count: Counter = Counter()
        for d in docs:
            count.update(set(d))
        known = sorted(((w, n) for w, n in count.items() if n > 1), key=lambda x: (-x[1], x[0]))[:WORDS]
        net.vocabulary = {w: i + 1 for i, (w, _) in enumerate(known)}
        # The first place of a word's vector starts at how much likelier toxic documents hold the word, shrunk if it is rare.
        toxic: Counter = Counter()
        for d, label in zip(docs, y, strict=True):
            if label:
                toxic.update(set(d))
        a, b = (y == 1).sum(), (y == 0).sum()
        odds = [np.log((toxic[w] + 0.5) / (a + 1)) - np.log((n - toxic[w] + 0.5) / (b + 1)) for w, n in known]
        net.p["word"][1 : len(known) + 1, 0] = np.clip(odds, -3, 3) * np.minimum(1, np.array([n for _, n in known]) / 8)
        names = sorted(count)
        place = {w: i for i, w in enumerate(names)}
        word, chars, counts = net.inputs(names)
        starts = [window_starts(len(d)) for d in docs]
        first = np.r_[0, np.cumsum([len(s) for s in starts])]
        index = np.full((first[-1], WINDOW), -1, np.int32)
        for k, (d, s) in enumerate(zip(docs, starts, strict=True)):
            ids = np.array([place[w] for w in d], np.int32)
            for j, a in enumerate(s):
                part = ids[a : a + WINDOW]
                index[first[k] + j, : len(part)] = part
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
        step = 0
        for turn in range(ROUNDS):
            scores = net.logits(net.project(word, chars, counts), index) if turn else rng.standard_normal(len(index))
            worst = first[:-1] + np.array([int(np.argmax(scores[a:b])) for a, b in zip(first, first[1:], strict=False)])
            drawn = first[:-1] + (rng.random(len(docs)) * np.diff(first)).astype(np.int64)
            pos, neg = worst[y == 1], np.r_[worst[y == 0], drawn[y == 0]]
            if turn < 2:  # before the windows are told apart, any window of a toxic document may show why
                pos = np.r_[pos, drawn[y == 1]]
            chosen = np.r_[rng.choice(pos, DRAWS), rng.choice(neg, DRAWS)]
            target = np.repeat(np.array([1, 0], np.float32), DRAWS)
            order = rng.permutation(len(chosen))
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                part = index[chosen[own]]
                mask = part >= 0
                safe = np.maximum(part, 0)
                _, g = net.gradients(word[safe] * mask, padded(chars, counts, safe) * mask[:, :, None], mask, target[own])
                step += 1
                for k, v in g.items():
                    if k in ("word", "char"):
                        v = v + 2e-4 * net.p[k]  # noqa: PLW2901
                    m1, m2 = moment[k]
                    m1 += 0.1 * (v - m1)
                    m2 += 0.005 * (v * v - m2)
                    net.p[k] -= (0.01 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.995**step)) + 1e-6)).astype(np.float32)
        scores = net.logits(net.project(word, chars, counts), index)
        top = np.array([scores[a:b].max() for a, b in zip(first, first[1:], strict=False)], np.float64)
        net.scale = platt(top, y)
        return net


def platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """a, b of sigmoid(a x + b), by damped Newton steps on smoothed targets; a is kept positive."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(40):
        q = sigmoid(design @ w)
        hess = (design * (q * (1 - q))[:, None]).T @ design + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, design.T @ (q - t)), -2, 2)
    return np.array([max(w[0], 1e-3), w[1]])


class Scorer:
    """Scores texts with a network; remembers the gate inputs of a bounded number of words."""

    def __init__(self, net: Network):
        self.net, self.place, self.table = net, {}, np.zeros((0, 6 * UNITS), np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        """Probabilities; a text without a token says nothing toxic and scores 0."""
        docs = [tokens(t) for t in texts]
        new = sorted({w for d in docs for w in d if w not in self.place})
        if len(self.place) + len(new) > REMEMBERED:
            self.place, self.table = {}, self.table[:0]
            new = sorted({w for d in docs for w in d})
        if new:
            made = [self.net.project(*self.net.inputs(new[i : i + 20_000])) for i in range(0, len(new), 20_000)]
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.table = np.concatenate([self.table, *made])
        place, out = self.place, np.zeros(len(docs))
        counts = np.array([len(window_starts(len(d))) for d in docs], np.int64)
        lengths = np.array([len(d) for d in docs], np.int64)
        begin = np.r_[0, np.cumsum(lengths)]
        ids = np.fromiter((place[w] for d in docs for w in d), np.int32, begin[-1])
        of = np.repeat(np.arange(len(docs)), counts)
        no = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        top = np.full(len(docs), -np.inf)
        for i in range(0, len(of), CHUNK):
            d = of[i : i + CHUNK]
            at = (no[i : i + CHUNK] * STRIDE)[:, None] + np.arange(WINDOW)
            inside = at < lengths[d][:, None]
            index = np.where(inside, ids[np.minimum(begin[d][:, None] + at, max(len(ids) - 1, 0))], -1)
            np.maximum.at(top, d, self.net.logits(self.table, index).astype(np.float64))
        has = counts > 0
        out[has] = sigmoid(self.net.scale[0] * top[has] + self.net.scale[1])
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, mod: int = 5) -> Network:
    """Learn from at most per_class labelled documents of each class whose fold isn't 0."""
    texts, y, _ = sample_labelled(docs.sparkSession, docs, labels, "toxic", mod, per_class)
    return Network.fit(texts, y)


SLICE_CHARS = 2_000_000


def score(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs without the text, with `score` (0 to 1; null and empty texts 0). A column of that name is replaced."""
    return scored(docs, net, Scorer, text_col)


_scorers: dict[str, tuple] = {}


def scored(docs: DataFrame, model, scorer, text_col: str, keep_text: bool = False, out_col: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != out_col and (keep_text or c != text_col)]
    sent = rest if text_col in rest else [*rest, text_col]  # each text goes to Python once
    at = sent.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, value = scorer.__module__, shared.value
        if name not in _scorers or _scorers[name][0] is not value:
            _scorers[name] = (value, scorer(value))
        own = _scorers[name][1]
        for b in batches:
            start, size, texts = 0, 0, []
            for i, t in enumerate(b.column(at)):
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size > SLICE_CHARS or i + 1 == b.num_rows:
                    part = b.slice(start, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(own.score(texts), pa.float64())], names=[*rest, out_col])
                    start, size, texts = i + 1, 0, []

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest] + [f"`{out_col}` double"])
    return docs.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, schema)
