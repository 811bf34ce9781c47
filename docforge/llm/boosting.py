"""Small boosted trees: fitted with numpy on a bounded table, applied as SQL expressions."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, least: int) -> tuple[int, float] | None:
    """The feature and threshold (left: value <= threshold) with the largest gain."""
    best, found = 1e-9, None
    total = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= t
            if least <= left.sum() <= len(x) - least:
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - total
                if gain > best:
                    best, found = gain, (f, float(t))
    return found


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: int):
    found = _split(x, g, h, least) if depth else None
    if not found:
        return float(rate * g.sum() / (h.sum() + 1))
    left = x[:, found[0]] <= found[1]
    return (*found, _tree(x[left], g[left], h[left], depth - 1, rate, least), _tree(x[~left], g[~left], h[~left], depth - 1, rate, least))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, left, right = tree
    return np.where(x[:, f] <= t, _value(left, x), _value(right, x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, rate: float = 0.3, least: int = 10) -> list:
    """Trees whose summed values are the log-odds of y, by Newton steps of the logistic loss."""
    z, out = np.zeros(len(x)), []
    for _ in range(trees):
        p = sigmoid(z)
        out.append(_tree(x, y - p, p * (1 - p), depth, rate, least))
        z += _value(out[-1], x)
    return out


def value(trees: list, x: np.ndarray) -> np.ndarray:
    return sum((_value(t, x) for t in trees), np.zeros(len(x)))


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and intercept that make sigmoid(slope * z + intercept) a probability, by Newton's method on rows that weren't fitted."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        g = np.array([((y - p) * z).sum() - 0.01 * a, (y - p).sum()])
        w = p * (1 - p)
        m = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def as_sql(tree, names: list[str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D" if "e" not in repr(tree) else f"CAST({tree!r} AS DOUBLE)"
    f, t, left, right = tree
    return f"CASE WHEN {names[f]} <= {t!r}D THEN {as_sql(left, names)} ELSE {as_sql(right, names)} END"
