"""DartMinHash signatures of weighted sets, many sets at a time, in numpy.

Each element owns a strip of the plane weight x rank, cut into unit squares. A hash of
(element, square) says how many darts land there (Poisson, mean 1) and, per dart, its
rank, weight position and coordinate: the same darts for every set. A set keeps the darts
below its weight and below a rank limit under which about k (ln k + 2.5) darts fall, and
per coordinate the one of least rank. Two sets agree in a coordinate with probability
equal to their weighted Jaccard similarity. A set with an empty coordinate throws again
with twice the limit.
"""

from __future__ import annotations

import math

import numpy as np

from ledgerwatch.llm.words import mix

EMPTY = np.uint64(2**64 - 1)
_FRACTION = np.uint64(28)  # bits of a rank below one
_RANK = np.uint64(40)  # bits of a rank in squares below DEEP
_DEEP = 1 << 12
_STEP, _LANE, _NEXT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
# number of darts in a square: Poisson of mean 1 by its distribution function
_POISSON = (np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)]) * 2.0**64).astype(np.float64)
_CDF = np.array([min(int(x), 2**64 - 1) for x in _POISSON], np.uint64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the owner, and running number inside it, of ``counts`` items each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _throw(rows: np.ndarray, keys: np.ndarray, weights: np.ndarray, limit: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """Signatures for rank limits per row."""
    high = np.ceil(limit).astype(np.int64)[rows]
    deep = np.ceil(weights).astype(np.int64)
    owner, square = _spread(high * deep)
    lane, j = (square // high[owner], square % high[owner]) if (deep > 1).any() else (None, square)
    u = keys[owner] + j.astype(np.uint64) * _STEP
    if lane is not None:
        u = u + lane.astype(np.uint64) * _LANE
    u = mix(u)
    of, nth = _spread(np.searchsorted(_CDF, u, "right"))
    v = mix(u[of] + (nth.astype(np.uint64) + np.uint64(1)) * _NEXT)
    owner = owner[of]
    rank = (j[of].astype(np.uint64) << _FRACTION) | (v & np.uint64((1 << 28) - 1))
    row = rows[owner]
    hit = rank < (limit * 2.0**28)[row]
    if lane is not None or (weights < 1).any():
        position = (v >> np.uint64(48)).astype(np.float64) / 65536 + (0 if lane is None else lane[of])
        hit &= position < weights[owner]
    coordinate = (((v >> _FRACTION) & np.uint64(0xFFFFF)) * np.uint64(k)) >> np.uint64(20)
    place, rank = (row.astype(np.uint64) * np.uint64(k) + coordinate)[hit], rank[hit]
    if len(high) and high.max() > _DEEP:  # a small set: ranks do not fit beside the slot
        order = np.lexsort((rank, place))
        place, rank = place[order], rank[order]
    else:
        both = np.sort((place << _RANK) | rank)
        place, rank = both >> _RANK, both & np.uint64((1 << 40) - 1)
    slot = place.astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    out = np.full(n_rows * k, EMPTY, np.uint64)
    out[slot[first]] = rank[first]
    return out.reshape(n_rows, k)


def signatures(rows: np.ndarray, keys: np.ndarray, weights: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """``n_rows`` x ``k`` ranks; EMPTY throughout for a row without elements of positive weight.

    ``rows`` is sorted; an element is listed once per row.
    """
    good = weights > 0
    rows, keys, weights = rows[good], mix(keys[good]), weights[good].astype(np.float64)
    total = np.bincount(rows, weights, minlength=n_rows)
    limit = np.zeros(n_rows)
    limit[total > 0] = k * (math.log(k) + 2.5) / total[total > 0]
    out = np.full((n_rows, k), EMPTY, np.uint64)
    todo = np.flatnonzero(total > 0)
    number = np.full(n_rows, -1)
    while len(todo):
        number[:] = -1
        number[todo] = np.arange(len(todo))
        mine = number[rows] >= 0
        # as many rows at a time as make about a million squares
        cost = np.cumsum(np.maximum(total[todo] * np.maximum(limit[todo], 1), 1))
        part = (cost // 1_000_000).astype(np.int64)[number[rows[mine]]]
        r, x, w = rows[mine], keys[mine], weights[mine]
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(r)], strict=True):
            here = np.unique(r[a:b])
            local = np.searchsorted(here, r[a:b])
            out[here] = _throw(local, x[a:b], w[a:b], limit[here], len(here), k)
        todo = todo[(out[todo] == EMPTY).any(axis=1)]
        limit[todo] *= 2
    return out
