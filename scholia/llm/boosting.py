"""Gradient-boosted trees of depth two on a bounded sample, written out as SQL expressions."""

from __future__ import annotations

import numpy as np


class Node:
    """A split of feature ``f`` at ``cut`` (left: at most), or a leaf with a value."""

    def __init__(self, value: float = 0.0, f: int = -1, cut: float = 0.0, left=None, right=None):
        self.value, self.f, self.cut, self.left, self.right = value, f, cut, left, right

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.f < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.f] <= self.cut, self.left.predict(x), self.right.predict(x))

    def sql(self, names: list[str]) -> str:
        if self.f < 0:
            return f"{self.value!r}D"
        return f"if({names[self.f]} <= {self.cut!r}D, {self.left.sql(names)}, {self.right.sql(names)})"


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, penalty: float = 1.0) -> Node:
    """The tree of best second-order gain on gradients g and curvatures h."""
    leaf = Node(float(round(-g.sum() / (h.sum() + penalty), 9)))
    if depth == 0 or len(x) < 2:
        return leaf
    best, choice = 1e-6, None
    own = g.sum() ** 2 / (h.sum() + penalty)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if len(at):
            gain = gs[at] ** 2 / (hs[at] + penalty) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + penalty) - own
            i = int(gain.argmax())
            if gain[i] > best:
                best, choice = float(gain[i]), (f, float((v[at[i]] + v[at[i] + 1]) / 2))
    if choice is None:
        return leaf
    f, cut = choice
    low = x[:, f] <= cut
    return Node(0.0, f, cut, grow(x[low], g[low], h[low], depth - 1, penalty), grow(x[~low], g[~low], h[~low], depth - 1, penalty))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 12, rate: float = 0.4, depth: int = 2) -> tuple[float, list[Node]]:
    """The log odds to start from, and trees to add (their values already scaled by ``rate``)."""
    p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    score, trees = np.full(len(x), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, p - y, p * (1 - p), depth)

        def scale(node: Node) -> None:
            if node.f < 0:
                node.value = float(round(node.value * rate, 9))
            else:
                scale(node.left), scale(node.right)

        scale(tree)
        score += tree.predict(x)
        trees.append(tree)
    return start, trees


def predict(model: tuple[float, list[Node]], x: np.ndarray) -> np.ndarray:
    return model[0] + sum((t.predict(x) for t in model[1]), np.zeros(len(x)))


def sql(model: tuple[float, list[Node]], names: list[str]) -> str:
    return " + ".join([f"{model[0]!r}D", *[t.sql(names) for t in model[1]]])
