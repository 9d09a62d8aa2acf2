"""Plain versions that the operators are compared with: loops over whole texts, without blocks, caches or transforms."""

import math
import re
from collections import Counter

import numpy as np

from strail.llm import quality


def edits_in(pattern, text):
    """The least edit distance of the pattern to any part of text, a row of the table at a time."""
    codes, row = np.array([ord(c) for c in text], np.int64), np.zeros(len(text) + 1, np.int64)
    at = np.arange(len(text) + 1)
    for p in pattern:
        new = np.r_[row[0] + 1, np.minimum(row[1:] + 1, row[:-1] + (codes != ord(p)))]
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def cut_repeats(texts, length):
    """Each text without the characters that a byte string of `length` covers which starts twice among all."""
    data = {k: t.encode() for k, t in texts.items()}
    seen = Counter(b[i : i + length] for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in data.items():
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        keep, at, text = np.cumsum(gone)[: len(b)] == 0, 0, []
        for c in texts[k]:
            n = len(c.encode())
            if keep[at : at + n].all():
                text.append(c)
            at += n
        out[k] = "".join(text)
    return out


def quality_score(model, text):
    """The quality network's forward pass, token by token, in double precision."""
    if not text.strip():
        return 0.0
    tokens, d = re.findall(r"\w+|[^\w\s]+", text), quality.DIM
    total = np.zeros(2 * d)
    for t, n in Counter(tokens).items():
        own = model.words[t] if t in model.words else quality.index_vectors([t])[0]
        total[:d] += n * own.astype(float)
        total[d:] += n * quality.index_vectors(["\0" + quality.shape(t)])[0].astype(float)
    x = np.r_[total / len(tokens), math.log1p(len(tokens)), len(set(tokens)) / len(tokens)]
    x = (x - model.mean) / model.spread
    hidden = [max(0.0, float(x @ model.w1[:, j].astype(float)) + float(model.b1[j])) for j in range(len(model.b1))]
    logit = sum(h * float(w) for h, w in zip(hidden, model.w2, strict=True)) + model.b2
    return 1 / (1 + math.exp(-logit / model.temperature))


def toxicity_logit(net, tokens, window, stride):
    """The largest logit of the windows of a text, one step and one unit at a time."""
    from strail.llm import toxicity

    p, h = {k: v.astype(float) for k, v in net.p.items()}, toxicity.UNITS
    sig = lambda v: 1 / (1 + np.exp(-v))

    def vector(w):
        grams = [toxicity._places[g] for g in [f"<{w}>"[i : i + 3] for i in range(len(w))] + list(w)]
        return np.r_[p["word"][net.vocabulary.get(w, 0)], sum(p["char"][g] for g in grams) / len(grams)]

    best = -math.inf
    start = 0
    while True:
        xs = [vector(w) for w in tokens[start : start + window]]
        sides = []
        for side in "fb":
            state, out = np.zeros(h), []
            for x in xs if side == "f" else xs[::-1]:
                a, g = x @ p[f"W{side}"] + p[f"b{side}"], state @ p[f"U{side}"]
                z, r = sig(a[:h] + g[:h]), sig(a[h : 2 * h] + g[h : 2 * h])
                new = np.tanh(a[2 * h :] + r * g[2 * h :])
                state = (1 - z) * new + z * state
                out.append(state)
            sides.append(out if side == "f" else out[::-1])
        hs = [np.r_[f, b] for f, b in zip(*sides, strict=True)]
        s = np.array([np.tanh(v @ p["A"]) @ p["v"] for v in hs])
        weight = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        best = max(best, float(sum(w * v for w, v in zip(weight, hs, strict=True)) @ p["o"] + p["c"][0]))
        if start + window >= len(tokens):
            return best
        start += stride


def language(model, text, profile, top):
    """Distance of each language, from all n-grams of the text's words, and the cut of the document's own profile."""
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    count = Counter(g for w in words for n in (1, 2, 3) for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) != " ")
    if not count:
        return None
    known = sorted(model.place)
    place = {g: i for i, g in enumerate(known)}
    own = sorted(count, key=lambda g: (-count[g], place.get(g, len(known)), g))[:top]
    away = {}
    for lang, ranks in zip(model.langs, model.ranks, strict=True):
        own_rank = {g: int(ranks[model.place[g]]) for g in known if ranks[model.place[g]] >= 0}
        away[lang] = sum(abs(own_rank[g] - i) if g in own_rank else profile for i, g in enumerate(own))
    return away
