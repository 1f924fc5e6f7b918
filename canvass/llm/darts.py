"""DartMinHash signatures of weighted sets.

Each element owns a region as wide as its weight.  Darts fall into it one after the other, at
times and places that hashes of the element fix; each dart belongs to one of ``many``
coordinates.  A signature keeps, for each coordinate, the earliest dart of the whole set, so two
sets agree in a coordinate with the probability of their weighted Jaccard similarity.  Throwing
stops at a time by which about ``many * ln(many) + 2 * many`` darts have fallen, whatever the
number of elements; sets that miss a coordinate by then are thrown at for longer.
"""

from __future__ import annotations

import numpy as np

from canvass.llm.windows import U, mix, paired

NEVER = np.inf


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from hashes."""
    return ((x >> U(11)).astype(float) + 1) * 2.0**-53


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, many: int, weights: np.ndarray | None = None) -> np.ndarray:
    """(sets, many) hashes of the earliest darts; 0 everywhere for a set without weight.

    ``elements`` are hashes, ``owner`` the number of the set each belongs to.  Without
    ``weights`` each weighs 1, and an element listed twice counts once.
    """
    weights = np.ones(len(elements)) if weights is None else weights
    total = np.bincount(owner, weights, sets)
    out = np.zeros((sets, many), U)
    wanted = many * np.log(many) + 2 * many
    until = np.divide(wanted, total, out=np.zeros(sets), where=total > 0)
    open_ = total > 0
    while open_.any():
        mine = open_[owner]
        out[open_], filled = _thrown(elements[mine], owner[mine], weights[mine], until, sets, many, open_)
        open_[np.flatnonzero(open_)[filled]] = False
        until *= 2
    return out


def _thrown(elements, owner, weights, until, sets, many, open_):
    when, hashes, cells = [], [], []
    # layers of a region: [0, 1), [1, 2), [2, 4), ...; darts beyond the weight miss
    layer, low, width = 0, 0.0, 1.0
    while len(elements):
        time = np.zeros(len(elements))
        e, o, w, k = elements, owner, weights, 0
        while len(e):
            dart = paired(e, np.full(len(e), (layer << 32) + k, U))
            time = time - np.log(unit(mix(dart + U(1)))) / width
            alive = time < until[o]
            e, o, w, time, dart = e[alive], o[alive], w[alive], time[alive], dart[alive]
            inside = low + unit(mix(dart + U(2))) * width <= w
            when.append(time[inside])
            hashes.append(dart[inside])
            cells.append(o[inside] * many + (mix(dart[inside] + U(3)) % U(many)).astype(np.int64))
            k += 1
        low, width, layer = low + width, low + width, layer + 1
        more = weights > low
        elements, owner, weights = elements[more], owner[more], weights[more]
    when, hashes, cells = (np.concatenate(x) for x in (when, hashes, cells))
    first = np.full(sets * many, NEVER)
    np.minimum.at(first, cells, when)
    out = np.zeros(sets * many, U)
    wins = when == first[cells]
    out[cells[wins]] = hashes[wins]
    first = first.reshape(sets, many)[open_]
    return out.reshape(sets, many)[open_], (first < NEVER).all(axis=1)
