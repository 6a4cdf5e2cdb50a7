"""A robust-pruned directed graph over vectors, built and searched in batches with numpy.

Vectors are inserted in batches that grow with the graph. A greedy search of the graph so far proposes neighbours for
each new vector; robust pruning keeps the nearest and drops what lies, up to the factor ``ALPHA``, nearer to a kept one
than to the vector, so edges point in diverse directions. Every edge is entered in reverse too, and a list that grows
over ``DEGREE`` is pruned again. Searches start from the best of ``ENTRIES`` nodes drawn at random, as a large group of
near copies would hold a search that starts in its midst. Largest inner product becomes nearest neighbour by one more dimension that brings all
vectors to one length.
"""

from __future__ import annotations

import numpy as np

DEGREE = 32
BEAM = 64
ALPHA = 1.2
WIDTH = 4
ENTRIES = 256
_BATCH = 512


def lengthened(x: np.ndarray) -> np.ndarray:
    """Vectors of one length whose squared distance falls as the inner product rises."""
    squares = (x.astype(np.float64) ** 2).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(squares.max() - squares, 0.0))[:, None]], axis=1).astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int):
    """For each query the ``beam`` best nodes met and their scores (larger is nearer), unordered, and the nodes whose
    edges were followed. Missing places are -1."""
    m, n = len(queries), len(points)
    seen = np.zeros((m, n), np.bool_)
    rows = np.arange(m)
    start = points[entries] @ queries.T
    first = np.argsort(-start, axis=0, kind="stable")[:beam].T
    ids = np.full((m, beam), -1, np.int64)
    score = np.full((m, beam), -np.inf, np.float32)
    ids[:, :first.shape[1]] = entries[first]
    score[:, :first.shape[1]] = np.take_along_axis(start.T, first, axis=1)
    seen[:, entries] = True
    done = ids < 0
    followed: list[np.ndarray] = []
    live = rows
    while len(live):
        open_ = np.where(done[live], -np.inf, score[live])
        pick = np.argpartition(-open_, min(WIDTH, beam - 1), axis=1)[:, :WIDTH]
        good = np.take_along_axis(open_, pick, axis=1) > -np.inf
        node = np.where(good, ids[live[:, None], pick], -1)
        at = np.zeros_like(done[live])
        np.put_along_axis(at, pick, good, axis=1)
        done[live] |= at
        step = np.full((m, pick.shape[1]), -1, np.int64)
        step[live] = node
        followed.append(step)
        near = np.where(node[:, :, None] >= 0, edges[node], -1).reshape(len(live), -1)
        fresh = (near >= 0) & ~seen[live[:, None], near]
        near = np.where(fresh, near, -1)
        order = np.sort(near, axis=1)  # two nodes may share a neighbour
        near = np.where(np.concatenate([order[:, 1:] == order[:, :-1], np.zeros((len(live), 1), np.bool_)], axis=1), -1, order)
        fresh = near >= 0
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        new = np.full(near.shape, -np.inf, np.float32)
        new[r, c] = np.einsum("ij,ij->i", points[near[r, c]], queries[live[r]])
        ids_all = np.concatenate([ids[live], near], axis=1)
        score_all = np.concatenate([score[live], new], axis=1)
        done_all = np.concatenate([done[live], ~fresh], axis=1)
        best = np.argpartition(-score_all, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(ids_all, best, axis=1)
        score[live] = np.take_along_axis(score_all, best, axis=1)
        done[live] = np.take_along_axis(done_all, best, axis=1)
        live = live[~done[live].all(axis=1)]
    return ids, score, (np.concatenate(followed, axis=1) if followed else np.full((m, 0), -1, np.int64))


def robust_prune(points: np.ndarray, own: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` neighbours for each of ``own`` out of its row of ``proposed`` (-1 for none), -1 padded."""
    m = len(own)
    ids = np.sort(proposed, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    ids[ids == own[:, None]] = -1
    vec = points[ids]
    far = ((vec - points[own][:, None, :]) ** 2).sum(axis=2)
    far[ids < 0] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)
    vec = np.take_along_axis(vec, order[:, :, None], axis=1)
    squares = (vec ** 2).sum(axis=2)
    between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(vec, vec.transpose(0, 2, 1))
    alive = ids >= 0
    out = np.full((m, degree), -1, np.int64)
    rows = np.arange(m)
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = ids[rows, first][some]
        alive &= alpha * alpha * between[rows, first] > far
        alive[rows, first] = False
    return out


def _enter_reverse(points, edges, own, kept, degree, alpha) -> None:
    """Adds own -> kept the other way round, pruning lists that overflow; in rounds of at most ``degree`` each."""
    source = np.repeat(own, kept.shape[1])
    target = kept.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    first = np.r_[0, np.flatnonzero(np.diff(target)) + 1]
    place = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
    for turn in range(int(place.max(initial=-1)) // degree + 1):
        now = place // degree == turn
        nodes, back = np.unique(target[now], return_inverse=True)
        coming = np.full((len(nodes), degree), -1, np.int64)
        coming[back, place[now] % degree] = source[now]
        for at in range(0, len(nodes), _BATCH):
            some = nodes[at:at + _BATCH]
            both = np.concatenate([edges[some], coming[at:at + _BATCH]], axis=1)
            room = (both >= 0).sum(axis=1) <= degree
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
            edges[some[room]] = packed[room][:, :degree]
            if not room.all():
                edges[some[~room]] = robust_prune(points, some[~room], both[~room], degree, alpha)


def _unreached(edges: np.ndarray, entries: list[int]) -> list[int]:
    """``entries`` with one more for every part of the graph that cannot be reached from those before."""
    met = np.zeros(len(edges), np.bool_)
    queue = np.array(entries)
    met[queue] = True
    while True:
        while len(queue):
            queue = np.unique(edges[queue])
            queue = queue[(queue >= 0) & ~met[queue]]
            met[queue] = True
        if met.all():
            return entries
        entries = [*entries, int(np.argmin(met))]
        queue = np.array(entries[-1:])
        met[queue] = True


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 0):
    """(edges, entries) over the rows of ``vectors``; edges are node numbers, -1 padded."""
    points = lengthened(vectors)
    n = len(points)
    middle = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[middle], order[order != middle]])
    edges = np.full((n, degree), -1, np.int64)
    done = 1
    while done < n:
        # all points have one length, so the larger inner product is the smaller distance
        own = order[done:done + min(_BATCH, max(1, done))]
        met, _, followed = beam_search(points, edges, order[:min(done, ENTRIES)], points[own], beam)
        kept = robust_prune(points, own, np.concatenate([met, followed], axis=1), degree, alpha)
        edges[own] = kept
        _enter_reverse(points, edges, own, kept, degree, alpha)
        done += len(own)
    return edges, np.array(_unreached(edges, order[:ENTRIES].tolist()))


def search(vectors: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The ``beam`` nodes of largest inner product found for each query, unordered, -1 padded."""
    return beam_search(vectors, edges, entries, queries, beam)[0]
