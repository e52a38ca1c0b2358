"""Non-negative least squares (active set), and plans that fill windows with lengths."""

from __future__ import annotations

from collections import Counter

import numpy as np


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 3000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: columns enter by gradient, leave when they turn negative."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    scale = float(np.abs(b).max()) or 1.0
    for _ in range(steps):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        j = int(gradient.argmax()) if n else 0
        if not n or gradient[j] <= 1e-9 * scale:
            break
        active[j] = True
        while True:
            z = np.zeros(n)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (z <= 1e-12 * scale)
            if not low.any():
                x = z
                break
            if low[j] and x[j] == 0 and low.sum() == 1:
                active[j] = False  # it cannot grow: the other columns stay as they were
                return x
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.min(np.where(low, x / (x - z), np.inf))
            x = x + min(max(step, 0.0), 1.0) * (z - x)
            active &= x > 1e-12 * scale
            x[~active] = 0
            if not active.any():
                break
    return x


def combinations(window: int, depth: int, least: int = 1) -> list[tuple[int, ...]]:
    """Non-increasing tuples of 2..depth lengths below ``window`` that fill it exactly."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, taken: tuple[int, ...]) -> None:
        if left == 0:
            out.append(taken)
        elif len(taken) < depth:
            for x in range(min(left, most), least - 1, -1):
                if x * (depth - len(taken)) < left:
                    break
                grow(left - x, x, (*taken, x))

    grow(window, window - 1, ())
    return out


def exact_plan(counts: dict[int, int], window: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) by least squares against ``counts``, rounded down, never more than there is."""
    have = [x for x, n in counts.items() if n > 0 and x < window]
    combos = [c for c in combinations(window, depth) if all(counts.get(x, 0) for x in c)]
    if not combos:
        return []
    row = {x: i for i, x in enumerate(sorted(have))}
    a = np.zeros((len(row), len(combos)))
    for j, c in enumerate(combos):
        for x in c:
            a[row[x], j] += 1
    b = np.array([counts[x] for x in sorted(have)], float)
    repeats = nnls(a, b)
    left, plan = Counter(counts), []
    for j in np.argsort(-repeats):
        need = Counter(combos[j])
        n = min(int(repeats[j] + 1e-6), *(left[x] // m for x, m in need.items()))
        if n > 0:
            plan.append((combos[j], n))
            for x, m in need.items():
                left[x] -= m * n
    return plan


def greedy_plan(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, then always the longest that fits; equal fillings are made in bulk."""
    left, plan = Counter({x: n for x, n in counts.items() if n > 0}), []
    while left:
        room, taken, spare = window, [], Counter(left)
        while room > 0:
            x = max((y for y in spare if y <= room), default=0)
            if not x:
                break
            n = min(spare[x], room // x)
            taken += [x] * n
            room -= n * x
            spare[x] -= n
            if not spare[x]:
                del spare[x]
        need = Counter(taken)
        n = min(left[x] // m for x, m in need.items())
        plan.append((tuple(taken), n))
        for x, m in need.items():
            left[x] -= m * n
            if not left[x]:
                del left[x]
    return plan
