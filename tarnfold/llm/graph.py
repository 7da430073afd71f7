"""A robust-pruned directed graph over the vectors of one shard, in numpy.

Points are inserted in batches of doubling size. A greedy search over the
graph so far proposes neighbours for each new point; relaxed distance pruning
keeps those not shadowed by a nearer one (``alpha`` times nearer to it than to
the point), which leaves a few long, diverse edges. Edges are then mirrored
and overfull lists pruned again. Beam search answers queries.

A search computes the similarities of the points it visits and of no others;
so the work for a vector hardly depends on the size of the shard. All steps
run over a batch of queries at once.
"""

from __future__ import annotations

import numpy as np

DEGREE = 32
BEAM = 32
ALPHA = 1.2
EXPAND = 4
CANDIDATES = 48
#: Entry points of a shard, those that a search starts from, and those offered to pruning as far neighbours.
ENTRIES, STARTS, FAR = 128, 4, 8
BATCH = 512
#: Pairs compared at once: their rows stay in the cache.
CHUNK = 512


def _dots(a: np.ndarray, rows: np.ndarray, b: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of ``a[rows]`` with ``b[points]``."""
    out = np.empty(len(rows), np.float32)
    for c in range(0, len(rows), CHUNK):
        part = slice(c, c + CHUNK)
        np.einsum("ij,ij->i", a[rows[part]], b[points[part]], out=out[part])
    return out


def beam_search(edges: np.ndarray, z: np.ndarray, queries: np.ndarray, first: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, int]:
    """Best points of each query that a beam search over ``edges`` meets.

    ``z``: (points, dimension); ``queries``: (queries, dimension); ``first``:
    (queries, s) points to start from, -1 for none. Returns ids (-1 where fewer),
    similarities, best first, and the number of comparisons made. ``EXPAND``
    points of the beam are expanded in each step.
    """
    n, points = len(queries), len(z)
    seen = np.zeros((n, points + 1), bool)
    seen[:, points] = True
    ids = np.full((n, beam), points, np.int32)
    best = np.full((n, beam), -9.0, np.float32)
    fresh = np.zeros((n, beam), bool)
    new = np.where(first < 0, points, first).astype(np.int32)
    live, compared = np.arange(n), 0
    while True:
        r = live[:, None]
        new[seen[r, new]] = points
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = points
        row, place = np.nonzero(new < points)
        at = new[row, place]
        seen[live[row], at] = True
        s = np.full(new.shape, -9.0, np.float32)
        s[row, place] = _dots(queries, live[row], z, at)
        compared += len(at)
        all_ids = np.concatenate([ids[live], new], 1)
        all_best = np.concatenate([best[live], s], 1)
        all_fresh = np.concatenate([fresh[live], new != points], 1)
        keep = np.argpartition(-all_best, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(all_ids, keep, 1)
        best[live] = now = np.take_along_axis(all_best, keep, 1)
        waiting = np.take_along_axis(all_fresh, keep, 1)
        score = np.where(waiting, now, np.float32(-9))
        pick = np.argpartition(-score, EXPAND - 1, axis=1)[:, :EXPAND]
        usable = np.take_along_axis(score, pick, 1) > -9
        np.put_along_axis(waiting, pick, False, 1)
        fresh[live] = waiting
        going = usable.any(1)
        chosen = np.where(usable, np.take_along_axis(ids[live], pick, 1), -1)[going]
        live = live[going]
        if not len(live):
            break
        new = np.where(chosen[:, :, None] >= 0, edges[chosen], points).reshape(len(live), -1)
        new[new < 0] = points
    order = np.argsort(-best, axis=1, kind="stable")
    ids = np.take_along_axis(ids, order, 1)
    return np.where(ids == points, -1, ids), np.take_along_axis(best, order, 1), compared


def prune(cand: np.ndarray, near: np.ndarray, z: np.ndarray, own: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Relaxed distance pruning of candidate lists (rows, -1 padded).

    ``near``: inner product of each candidate with its row's point, whose squared
    length is ``own``. Distances are squared.
    """
    rows, width = cand.shape
    out = np.full((rows, degree), -1, np.int32)
    filled = np.zeros(rows, np.int64)
    order = np.argsort(-near, axis=1, kind="stable")
    cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
    v = z[np.maximum(cand, 0)]
    size = np.einsum("ijk,ijk->ij", v, v)
    far = own[:, None] + size - 2 * near
    among = size[:, :, None] + size[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    dead = cand < 0
    for j in range(width):
        which = np.flatnonzero(~dead[:, j] & (filled < degree))
        if len(which):
            out[which, filled[which]] = cand[which, j]
            filled[which] += 1
            dead[which] |= alpha * alpha * among[which, j] <= far[which]
    return out


def starts(z: np.ndarray, queries: np.ndarray, entries: np.ndarray, most: int = STARTS) -> np.ndarray:
    """For each query the nearest of the entry points, ``most`` at most."""
    near = queries @ z[entries].T
    most = min(most, len(entries))
    return entries[np.argpartition(-near, most - 1, axis=1)[:, :most]].astype(np.int32)


def build(z: np.ndarray, seed: int = 0, degree: int = DEGREE, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray, int]:
    """Edges (points, degree), -1 padded, the entry points of a shard of vectors ``z``, and the comparisons made."""
    n, compared = len(z), 0
    edges = np.full((n, degree), -1, np.int32)
    if n == 1:
        return edges, np.zeros(1, np.int32), 0
    order = np.random.RandomState(seed).permutation(n)
    size = np.einsum("ij,ij->i", z, z)
    first = order[: min(n, degree + 1)]
    edges[first, : len(first) - 1] = np.stack([first[first != p] for p in first])
    done = len(first)
    while done < n:
        batch = order[done : done + min(done, n - done)]
        for a in range(0, len(batch), BATCH):
            part = batch[a : a + BATCH]
            entries = order[: min(done, ENTRIES)]
            ids, near, m = beam_search(edges, z, z[part], starts(z, z[part], entries))
            far = np.broadcast_to(entries[:FAR], (len(part), min(FAR, len(entries))))
            ids, near = np.concatenate([ids, far], 1), np.concatenate([near, z[part] @ z[entries[:FAR]].T], 1)
            edges[part] = prune(ids, near, z, size[part], degree, alpha)
            compared += m + len(part) * (len(entries) + ids.shape[1] ** 2 // 2)
        compared += _mirror(edges, batch, z, size, degree, alpha)
        done += len(batch)
    return edges, order[:ENTRIES].astype(np.int32), compared


def _mirror(edges: np.ndarray, batch: np.ndarray, z: np.ndarray, size: np.ndarray, degree: int, alpha: float) -> int:
    """Adds the reverse of the batch's edges, pruning lists that grow beyond ``degree``."""
    n = len(z)
    source = np.repeat(batch, degree)
    target = edges[batch].ravel()
    ok = target >= 0
    source, target = source[ok], target[ok]
    touched = np.unique(target)
    old = edges[touched]
    held = old >= 0
    owner = np.concatenate([np.repeat(touched, held.sum(1)), target])
    other = np.concatenate([old[held], source])
    key = np.unique(owner.astype(np.int64) * n + other)
    owner, other = key // n, key % n
    near = _dots(z, owner, z, other)
    rank = np.lexsort((-near, owner))
    owner, other, near = owner[rank], other[rank], near[rank]
    begin = np.searchsorted(owner, touched)
    place = np.arange(len(owner)) - begin[np.searchsorted(touched, owner)]
    fit = place < CANDIDATES
    cand = np.full((len(touched), CANDIDATES), -1, np.int32)
    sim = np.full((len(touched), CANDIDATES), -9, np.float32)
    row = np.searchsorted(touched, owner[fit])
    cand[row, place[fit]] = other[fit]
    sim[row, place[fit]] = near[fit]
    over = cand[:, degree] >= 0
    edges[touched[~over]] = cand[~over, :degree]
    which = np.flatnonzero(over)
    for a in range(0, len(which), BATCH):
        w = which[a : a + BATCH]
        edges[touched[w]] = prune(cand[w], sim[w], z, size[touched[w]], degree, alpha)
    return len(owner) + len(which) * CANDIDATES**2 // 2
