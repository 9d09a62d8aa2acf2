"""Trees by insertion: the splits on arrays against a plain version, and how much work an entry is."""

import cProfile
import pstats

import numpy as np
import pytest

from strail.operators import insertion as N


def _plain_split(lows, highs, labels, beta, least):
    """Entry by entry, with dictionaries."""
    n, totals = len(lows), np.array([sum(x.values()) for x in labels], float)
    size = N.volumes(lows, highs)
    waste = np.maximum(N.volumes(np.minimum(lows[:, None], lows[None]), np.maximum(highs[:, None], highs[None])) - size[:, None] - size[None], 0)
    waste = waste * N.inverse(float(waste[np.triu_indices(n, 1)].max(initial=0)))
    best = None
    for i in range(n):
        for j in range(i + 1, n):
            share = max([(labels[i][k] + labels[j][k]) / (totals[i] + totals[j]) for k in labels[i] if k in labels[j]], default=0)
            cost = beta * waste[i, j] + (1 - beta) * (1 - share)
            if best is None or cost > best[0]:
                best = (cost, i, j)
    seeds = best[1:]
    halves, seen = [[i] for i in seeds], [dict(labels[i]) for i in seeds]
    rest = [i for i in range(n) if i not in seeds]
    while rest:
        full = next((s for s in (0, 1) if len(halves[s]) >= n - least), None)
        if full is not None:
            halves[1 - full] += rest
            break
        box = [(lows[h].min(axis=0), highs[h].max(axis=0)) for h in halves]
        costs = []
        for i in rest:
            grown = np.array([N.volumes(np.minimum(a, lows[i]), np.maximum(b, highs[i])) - N.volumes(a, b) for a, b in box])
            textual = N.textual_costs(labels[i], seen, np.array([sum(x.values()) for x in seen], float))
            costs.append(beta * grown * N.inverse(float(grown.max())) + (1 - beta) * textual)
        pick = max(range(len(rest)), key=lambda k: (abs(costs[k][0] - costs[k][1]), -k))
        s = 0 if costs[pick][0] < costs[pick][1] else 1
        i = rest.pop(pick)
        halves[s].append(i)
        for k, v in labels[i].items():
            seen[s][k] = seen[s].get(k, 0) + v
    out = np.zeros(n, bool)
    out[halves[1]] = True
    return out


@pytest.mark.parametrize("most", [1, 4])
def test_split_equals_a_plain_one(most):
    """Entries of one label each, as in leaves, and of several, as above them; with many ties."""
    rng = np.random.default_rng(3)
    for case in range(60):
        n = int(rng.integers(3, 30))
        low = rng.integers(0, 5, (n, 3)).astype(float) if case % 2 else rng.random((n, 3)) * 100
        high = low + (rng.integers(0, 3, (n, 3)) if case % 2 else rng.random((n, 3)) * 5)
        labels = [{int(k): int(rng.integers(1, 4)) if most > 1 else 1 for k in rng.choice(6, rng.integers(1, most + 1), replace=False)} for _ in range(n)]
        beta, least = (0.0, 0.5, 1.0)[case % 3], max(1, n // 3)
        assert (N.split(low, high, labels, beta, least) == _plain_split(low, high, labels, beta, least)).all()


def test_an_entry_is_a_bounded_number_of_calls():
    """Not one for each pair of entries of a node that is split, nor for each child of a node on the way."""
    rng, n = np.random.default_rng(1), 2000
    low = rng.random((n, 3)) * 100
    high, label, tree, profile = low + rng.random((n, 3)), rng.integers(1, 6, n), N.Tree(113, 127), cProfile.Profile()
    profile.enable()
    for i in range(n):
        tree.insert(i, low[i], high[i], {int(label[i]): 1})
    profile.disable()
    assert pstats.Stats(profile).total_calls < 300 * n and (tree.leaf_numbers(n) >= 0).all()
