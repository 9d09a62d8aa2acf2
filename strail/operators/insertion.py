"""A small spatio-textual R-tree in numpy: cost-driven insertion and quadratic split, for the bodies of grouped tasks.

An entry is a box with label counts. The cost of a child is beta * (its enlargement over the largest enlargement)
+ (1 - beta) * (1 - the largest share that one of the entry's labels would have in it); ties go to the smaller box, then
to the first child.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from strail.schema import IndexConfig

TINY = 2.220446049250313e-16 / 2


def inverse(v: float) -> float:
    return 0.0 if v <= TINY else 1.0 / v


def volumes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.prod(np.maximum(high - low, 0), axis=-1)


def textual_costs(own: dict[int, int], children: list[dict[int, int]], totals: np.ndarray) -> np.ndarray:
    """1 - the largest relative frequency, after insertion, of one of the entry's labels that any child has."""
    total = sum(own.values())
    out = np.ones(len(children))
    for label, n in own.items():
        counts = np.array([c.get(label, 0) for c in children], np.float64)
        if counts.any():
            out = np.minimum(out, 1 - (counts + n) / (totals + total))
    return out


def spatial_costs(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    grown = volumes(np.minimum(lows, low), np.maximum(highs, high)) - volumes(lows, highs)
    return grown * inverse(float(grown.max(initial=0)))


def choose(cost: np.ndarray, size: np.ndarray) -> int:
    """Least cost, then least size, then first."""
    return int(np.lexsort((np.arange(len(cost)), size, cost))[0])


def _planes(corners: np.ndarray) -> np.ndarray:
    """Rows of corners as three contiguous planes, on which single operations are fast."""
    return np.ascontiguousarray(np.asarray(corners, np.float64).T)


def _volume(d: np.ndarray) -> np.ndarray:
    return d[0] * d[1] * d[2]


def _shares(labels: list[dict[int, int]], totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Counts (labels x entries), the largest common share of each pair, and each entry's label where it has one only."""
    n = len(labels)
    column = {k: j for j, k in enumerate(sorted({k for x in labels for k in x}))}
    if all(len(x) == 1 for x in labels):
        code = np.array([column[next(iter(x))] for x in labels])
        return np.zeros((len(column), 0)), np.where(code[:, None] == code[None], (totals[:, None] + totals[None]) / (totals[:, None] + totals[None]), 0), code
    count = np.zeros((len(column), n))
    for i, x in enumerate(labels):
        for k, v in x.items():
            count[column[k], i] = v
    share = np.zeros((n, n))
    for c in count:
        own = np.flatnonzero(c)
        at = np.ix_(own, own)
        share[at] = np.maximum(share[at], (c[own, None] + c[None, own]) / (totals[own, None] + totals[None, own]))
    return count, share, None


def split(lows: np.ndarray, highs: np.ndarray, labels: list[dict[int, int]], beta: float, least: int) -> np.ndarray:
    """Quadratic split of the entries of an overflowing node: True for those of the right half.

    The costs of all entries for both halves are arrays; an entry that goes to a half changes that half's enlargements and
    the textual costs, so a step is a fixed number of array operations.
    """
    n = len(lows)
    low, high = _planes(lows), _planes(highs)
    size = _volume(np.maximum(high - low, 0))
    d = [np.maximum(np.maximum(h[:, None], h[None]) - np.minimum(w[:, None], w[None]), 0) for w, h in zip(low, high, strict=True)]
    waste = np.maximum(d[0] * d[1] * d[2] - size[:, None] - size[None], 0)
    upper = np.triu(np.ones((n, n), bool), 1)
    waste = waste * inverse(float(waste[upper].max(initial=0)))
    totals = np.array([sum(x.values()) for x in labels], np.float64)
    count, share, code = _shares(labels, totals)
    cost = np.where(upper, beta * waste + (1 - beta) * (1 - share), -np.inf)
    a, b = np.unravel_index(int(np.argmax(cost)), cost.shape)  # of equals the first pair
    side = np.full(n, -1)
    side[a], side[b] = 0, 1
    box_low, box_high = [low[:, a], low[:, b]], [high[:, a], high[:, b]]
    seen, weight, held = np.zeros((2, len(count))), np.array([[totals[a]], [totals[b]]]), [1, 1]
    for s, i in enumerate((a, b)):
        if code is not None:
            seen[s, code[i]] = totals[i]
        else:
            seen[s] = count[:, i]
    grown, rest = np.empty((2, n)), n - 2
    absent = count == 0

    def enlarge(s: int) -> None:
        lo, hi = box_low[s][:, None], box_high[s][:, None]
        grown[s] = _volume(np.maximum(np.maximum(high, hi) - np.minimum(low, lo), 0)) - _volume(np.maximum(hi - lo, 0))

    enlarge(0)
    enlarge(1)
    while rest:
        full = next((s for s in (0, 1) if held[s] >= n - least), None)
        if full is not None:
            side[side < 0] = 1 - full
            break
        top = np.maximum(grown[0], grown[1])
        spatial = grown * np.divide(1.0, top, out=np.zeros(n), where=top > TINY)
        if code is not None:  # an entry has one label: its cost is 1 as long as no half has the label
            textual = np.where((seen.any(axis=0))[code], 1 - (seen[:, code] + totals) / (weight + totals), 1.0)
        else:
            each = 1 - (seen[:, :, None] + count) / (weight + totals)[:, None]
            each[:, absent | ~seen.any(axis=0)[:, None]] = 1.0
            textual = np.minimum(each.min(axis=1), 1.0)
        total = beta * spatial + (1 - beta) * textual
        apart = np.abs(total[0] - total[1])
        apart[side >= 0] = -1
        i = int(np.argmax(apart))
        s = 0 if total[0, i] < total[1, i] else 1
        side[i] = s
        rest -= 1
        held[s] += 1
        weight[s] += totals[i]
        box_low[s], box_high[s] = np.minimum(box_low[s], low[:, i]), np.maximum(box_high[s], high[:, i])
        enlarge(s)
        if code is not None:
            seen[s, code[i]] += totals[i]
        else:
            seen[s] += count[:, i]
    return side == 1


class Node:
    """Boxes of entries as planes of columns, one an entry. A leaf keeps its entries' labels as they are; a node above
    counts them by label (a row) and child (a column), with each child's total and volume."""

    def __init__(self, leaf: bool, room: int):
        self.leaf, self.size = leaf, 0
        self.low, self.high = np.zeros((3, room + 1)), np.zeros((3, room + 1))
        self.items: list = []  # entry numbers, or Nodes
        self.labels: list[dict[int, int]] = []  # of a leaf
        if not leaf:
            self.row: dict[int, int] = {}
            self.count, self.total, self.volume = np.zeros((4, room + 1)), np.zeros(room + 1), np.zeros(room + 1)

    def box(self) -> tuple[np.ndarray, np.ndarray]:
        return self.low[:, : self.size].min(axis=1), self.high[:, : self.size].max(axis=1)

    def histogram(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for x in self.histograms():
            for k, v in x.items():
                out[k] = out.get(k, 0) + v
        return out

    def histograms(self) -> list[dict[int, int]]:
        """The labels of each entry."""
        if self.leaf:
            return self.labels
        return [{k: int(c) for k, r in self.row.items() if (c := self.count[r, i])} for i in range(self.size)]

    def row_of(self, label: int) -> int:
        r = self.row.setdefault(label, len(self.row))
        if r == len(self.count):
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        return r

    def put(self, at: int, low: np.ndarray, high: np.ndarray, labels: dict[int, int]) -> None:
        """Box and labels of entry `at`, which may be a new one."""
        self.low[:, at], self.high[:, at] = low, high
        if self.leaf:
            self.labels.append(labels)  # entries of a leaf never change
            return
        self.volume[at] = _volume(np.maximum(high - low, 0))
        self.count[:, at] = 0
        for k, v in labels.items():
            r = self.row_of(k)  # first: it may make room
            self.count[r, at] = v
        self.total[at] = sum(labels.values())

    def add(self, low: np.ndarray, high: np.ndarray, labels: dict[int, int], item) -> None:
        self.put(self.size, low, high, labels)
        self.items.append(item)
        self.size += 1

    def cheapest(self, low: np.ndarray, high: np.ndarray, labels: dict[int, int], beta: float) -> int:
        """The child of least cost, grown by the entry: textual_costs(), spatial_costs() and choose() over the kept columns."""
        n = self.size
        lo, hi = np.minimum(self.low[:, :n], low[:, None]), np.maximum(self.high[:, :n], high[:, None])
        size, total, volume = self.volume[:n], self.total[:n], _volume(np.maximum(hi - lo, 0))
        grown = volume - size
        textual, weight = 1.0, sum(labels.values())
        for k, v in labels.items():
            r = self.row.get(k)
            if r is not None and (c := self.count[r, :n]).any():
                textual = np.minimum(textual, 1 - (c + v) / (total + weight))
        cost = beta * (grown * inverse(float(grown.max(initial=0)))) + (1 - beta) * textual
        best = np.flatnonzero(cost == cost.min())
        at = int(best[0] if len(best) == 1 else best[np.argmin(size[best])])
        self.low[:, at], self.high[:, at], self.volume[at] = lo[:, at], hi[:, at], volume[at]
        for k, v in labels.items():
            r = self.row_of(k)
            self.count[r, at] += v
        self.total[at] += weight
        return at


@dataclass
class Router:
    """The leaves of a tree, without their entries: units go to the leaf of least cost."""

    lows: np.ndarray
    highs: np.ndarray
    labels: list[dict[int, int]]
    totals: np.ndarray
    beta: float

    def route(self, low: np.ndarray, high: np.ndarray, label: np.ndarray) -> np.ndarray:
        if not len(self.lows):
            return np.zeros(len(low), np.int64)
        out = np.empty(len(low), np.int64)
        size = volumes(self.lows, self.highs)
        for i in range(0, len(low), 2000):
            lo, hi = low[i : i + 2000, None], high[i : i + 2000, None]
            grown = volumes(np.minimum(self.lows[None], lo), np.maximum(self.highs[None], hi)) - size[None]
            top = grown.max(axis=1, keepdims=True)
            cost = self.beta * np.where(top > TINY, grown / np.maximum(top, TINY), 0)
            for value in np.unique(label[i : i + 2000]):
                own = label[i : i + 2000] == value
                cost[own] += (1 - self.beta) * textual_costs({int(value): 1}, self.labels, self.totals)[None]
            out[i : i + 2000] = np.argmin(cost, axis=1)
        return out


class Levels:
    """The upper levels of an index as arrays, from the root's children down: what `route` needs to take units to the lowest of them.

    Each level: (nodes, counts, beta). nodes has node_id, parent_id, the box and total; counts has node_id, label_id and unit_count.
    """

    def __init__(self, levels: list[tuple]):
        self.levels = []
        for nodes, counts, beta in levels:
            corners = {c: nodes[c].to_numpy() for c in ("xmin", "ymin", "tmin", "xmax", "ymax", "tmax")}
            size = _volume([(corners[f"{a}max"] - corners[f"{a}min"]).astype(np.float64) for a in "xyt"])
            order = np.lexsort((nodes["node_id"], size, nodes["parent_id"]))  # of equal costs the first child is the one
            ids, parents = nodes["node_id"].to_numpy()[order], nodes["parent_id"].to_numpy()[order]
            labels = np.unique(counts["label_id"].to_numpy())
            by_id = np.argsort(ids)
            place = by_id[np.searchsorted(ids[by_id], counts["node_id"].to_numpy())]
            key = place * len(labels) + np.searchsorted(labels, counts["label_id"].to_numpy())
            sort = np.argsort(key)
            known, first = np.unique(parents, return_index=True)
            self.levels.append((ids, {k: v[order] for k, v in corners.items()}, size[order], nodes["total"].to_numpy(np.float64)[order], labels, key[sort], counts["unit_count"].to_numpy(np.float64)[sort], known, np.append(first, len(ids)), beta))

    def route(self, box: dict[str, np.ndarray], label: np.ndarray, known_label: np.ndarray) -> np.ndarray:
        """The node of the lowest level that each unit comes to, by the least cost on each level."""
        at = np.zeros(len(label), np.int64)
        for ids, corners, size, total, labels, keys, counts, parents, first, beta in self.levels:
            own = np.searchsorted(parents, at)
            begin, end = first[own], first[own + 1]
            child = begin[:, None] + np.arange(int((end - begin).max(initial=1)))
            there = child < end[:, None]
            child = np.where(there, child, begin[:, None])
            sides = [np.maximum(corners[f"{a}max"][child], box[f"{a}max"][:, None]) - np.minimum(corners[f"{a}min"][child], box[f"{a}min"][:, None]) for a in "xyt"]
            grown = _volume([d.astype(np.float64) for d in sides]) - size[child]
            top = grown.max(axis=1)
            share = np.divide(1.0, top, out=np.zeros(len(top)), where=~(top <= TINY))
            textual = np.ones(child.shape)
            code = np.minimum(np.searchsorted(labels, label), len(labels) - 1)
            rows = np.flatnonzero(known_label & (labels[code] == label))
            wanted = child[rows] * len(labels) + code[rows, None]
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            textual[rows] = np.where(keys[found] == wanted, 1 - (1 + counts[found]) / (1 + total[child[rows]]), 1.0)
            cost = np.where(there, beta * grown * share[:, None] + (1 - beta) * textual, np.inf)
            at = ids[child[np.arange(len(at)), np.argmin(cost, axis=1)]]
        return at


class Tree:
    def __init__(self, leaf: int, internal: int, beta: float = 0.5, mode: str = "normal"):
        self.leaf, self.internal, self.beta, self.root = leaf, internal, beta, Node(True, leaf)
        self.config, self.levels = IndexConfig(beta=beta, beta_mode=mode), 1

    def weight(self, level: int) -> float:
        """Weight of the spatial cost at a depth below the root (0)."""
        return self.config.beta_at(self.levels, level)

    def insert(self, item: int, low: np.ndarray, high: np.ndarray, labels: dict[int, int]) -> None:
        path, node = [], self.root
        while not node.leaf:
            at = node.cheapest(low, high, labels, self.weight(len(path)))
            path.append((node, at))
            node = node.items[at]
        node.add(low, high, dict(labels), item)
        while node.size > (self.leaf if node.leaf else self.internal):
            new = self._split(node, len(path))
            if not path:
                self.root, self.levels = Node(False, self.internal), self.levels + 1
                for child in (node, new):
                    self.root.add(*child.box(), child.histogram(), child)
                break
            parent, at = path.pop()
            parent.put(at, *node.box(), node.histogram())
            parent.add(*new.box(), new.histogram(), new)
            node = parent

    def _split(self, node: Node, level: int) -> Node:
        most = self.leaf if node.leaf else self.internal
        low, high, labels, items = node.low[:, : node.size].T.copy(), node.high[:, : node.size].T.copy(), node.histograms(), node.items
        right = split(low, high, labels, self.weight(level), -(-most // 3))
        halves = Node(node.leaf, most), Node(node.leaf, most)
        for i, r in enumerate(right.tolist()):
            halves[r].add(low[i], high[i], labels[i], items[i])
        node.__dict__.update(halves[0].__dict__)  # the parent's entry stays this node
        return halves[1]

    def leaves(self) -> list[Node]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if node.leaf:
                out.append(node)
            else:
                todo += node.items[::-1]
        return out

    def height(self) -> int:
        h, node = 1, self.root
        while not node.leaf:
            h, node = h + 1, node.items[0]
        return h

    def leaf_numbers(self, n: int) -> np.ndarray:
        out = np.full(n, -1, np.int64)
        for number, leaf in enumerate(self.leaves()):
            out[leaf.items] = number
        return out

    def router(self) -> Router:
        leaves = [x for x in self.leaves() if x.items]
        if not leaves:
            return Router(np.zeros((0, 3)), np.zeros((0, 3)), [], np.zeros(0), self.beta)
        boxes = [x.box() for x in leaves]
        histograms = [x.histogram() for x in leaves]
        return Router(np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]), histograms, np.array([sum(h.values()) for h in histograms], np.float64), self.beta)
