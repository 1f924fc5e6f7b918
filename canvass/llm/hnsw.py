"""A hierarchical navigable small-world graph over unit vectors, built and searched in lots."""

from __future__ import annotations

import numpy as np

#: Links of a node in upper layers (twice as many at the bottom), neighbours considered for them.
LINKS, CONSIDERED = 16, 48
LOT = 512


def draws(ids: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each id, the same on every run."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(11)).astype(float) + 1) / (2.0**53 + 1)


class Hnsw:
    """``layers[k]`` has the nodes of layer k and, for each, its links as local numbers (-1: none)."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray) -> Hnsw:
        vectors = np.ascontiguousarray(vectors, np.float32)
        level = np.floor(-np.log(draws(ids)) / np.log(LINKS)).astype(int)
        layers, k, nodes = [], 0, np.arange(len(vectors))
        while len(nodes) and (k == 0 or len(nodes) > 1):
            layers.append((nodes, linked(vectors[nodes], 2 * LINKS if k == 0 else LINKS)))
            k += 1
            nodes = np.flatnonzero(level >= k)
        return cls(vectors, layers)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nodes (-1: none) and cosines of its final beam, closest first."""
        queries = np.ascontiguousarray(queries, np.float32)
        entry = np.zeros(len(queries), np.int64)
        for k in range(len(self.layers) - 1, -1, -1):
            nodes, links = self.layers[k]
            found, near = beamed(self.vectors[nodes] if k else self.vectors, links, queries, entry, beam if k == 0 else 4)
            if k:  # go down at the closest node
                below = self.layers[k - 1][0]
                entry = np.searchsorted(below, nodes[found[:, 0]])
        return found, near


def linked(vectors: np.ndarray, most: int) -> np.ndarray:
    """Links to near nodes that are closer to the node than to a node linked before, both ways."""
    n = len(vectors)
    many = min(CONSIDERED, n - 1)
    if many < 1:
        return np.full((n, 1), -1, np.int32)
    half = max(1, most // 2)
    chosen = np.full((n, half), -1, np.int32)
    for a in range(0, n, 256):
        rows = np.arange(a, min(n, a + 256))
        near = vectors[rows] @ vectors.T
        near[np.arange(len(rows)), rows] = -2
        top = largest(near, many)
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
        chosen[rows] = diverse(vectors, top, np.take_along_axis(near, top, 1), half)
    # links back, where the other node has room
    source = np.repeat(np.arange(n), half)
    target = chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    links = np.full((n, most), -1, np.int32)
    links[:, :half] = chosen
    room = rank < most - half
    links[target[room], half + rank[room]] = source[room]
    return links


def largest(values: np.ndarray, many: int, size: int = 32) -> np.ndarray:
    """Columns of the ``many`` largest values of each row, in any order.

    They lie in the ``many`` blocks of columns with the largest maxima.
    """
    rows, n = values.shape
    cut = n - n % size
    if cut // size <= many:
        return np.argpartition(-values, many - 1, axis=1)[:, :many]
    best = values[:, :cut].reshape(rows, -1, size).max(axis=2)
    blocks = np.argpartition(-best, many - 1, axis=1)[:, :many]
    columns = (blocks[:, :, None] * size + np.arange(size)).reshape(rows, -1)
    columns = np.concatenate([columns, np.broadcast_to(np.arange(cut, n), (rows, n - cut))], axis=1)
    chosen = np.take_along_axis(values, columns, 1)
    return np.take_along_axis(columns, np.argpartition(-chosen, many - 1, axis=1)[:, :many], 1)


def diverse(vectors: np.ndarray, top: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    rows, many = top.shape
    out = np.full((rows, most), -1, np.int32)
    count = np.zeros(rows, int)
    kept = np.zeros((rows, most, vectors.shape[1]), np.float32)
    for j in range(many):
        candidate = vectors[top[:, j]]
        closest = np.einsum("rmd,rd->rm", kept, candidate)
        closest[np.arange(most) >= count[:, None]] = -2
        take = np.flatnonzero((closest.max(axis=1) < near[:, j]) & (count < most))
        out[take, count[take]] = top[take, j]
        kept[take, count[take]] = candidate[take]
        count[take] += 1
    for j in range(many):  # fill the rest with the closest ones passed over
        take = np.flatnonzero((count < most) & ~(out == top[:, j:j + 1]).any(axis=1))
        out[take, count[take]] = top[take, j]
        count[take] += 1
    return out


def beamed(vectors, links, queries, entry, beam, at_once: int = 4):
    """Best-first search of all queries in step; ``at_once`` nodes are opened in each."""
    n, many = len(vectors), len(queries)
    beam = min(beam, n)
    seen = np.zeros((many, n + 1), bool)
    seen[:, n] = True  # stands for no link
    row = np.arange(many)
    found = np.full((many, beam), n, np.int64)
    near = np.full((many, beam), -2.0, np.float32)
    opened = np.ones((many, beam), bool)
    found[:, 0], near[:, 0], opened[:, 0] = entry, np.einsum("qd,qd->q", queries, vectors[entry]), False
    seen[row, entry] = True
    active = row
    while len(active):
        score = np.where(opened[active], -3.0, near[active])
        pick = np.argsort(-score, axis=1)[:, :at_once]
        good = np.take_along_axis(score, pick, 1) > -2.5
        going = good.any(axis=1)
        active, pick, good = active[going], pick[going], good[going]
        if not len(active):
            break
        opened[active[:, None], pick] |= good
        around = links[found[active[:, None], pick] % n].astype(np.int64)
        around[~good] = -1
        around = np.where(around < 0, n, around).reshape(len(active), -1)
        around = np.sort(around, axis=1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = n
        around[seen[active[:, None], around]] = n
        seen[active[:, None], around] = True
        close = np.einsum("qd,qmd->qm", queries[active], vectors[around % n])
        close[around == n] = -2
        all_near = np.concatenate([near[active], close], axis=1)
        all_found = np.concatenate([found[active], around], axis=1)
        all_opened = np.concatenate([opened[active], around == n], axis=1)
        top = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        near[active] = np.take_along_axis(all_near, top, 1)
        found[active] = np.take_along_axis(all_found, top, 1)
        opened[active] = np.take_along_axis(all_opened, top, 1)
    return np.where(near > -2, found, -1), near
