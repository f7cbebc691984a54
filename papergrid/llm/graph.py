"""Robust-pruned directed proximity graph over unit vectors, in batched numpy.

The graph is built by prefix-doubling insertion: each batch of points runs a greedy beam
search over the graph built so far, its candidates are pruned with the relaxed distance
rule (a candidate is dropped when a kept neighbour is ``alpha`` times closer to it than the
point itself is), and the reverse edges are added and pruned again.  All steps work on whole
batches of points, so the Python interpreter sees a few calls per batch and not per vector.
"""

from __future__ import annotations

import numpy as np

#: Most neighbours of a node, beam width of the build and relaxation of the pruning rule.
DEGREE, BEAM, ALPHA = 20, 40, 1.2
_BATCH = 256
_WIDTH = 4


def _beam(vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines (B, beam) of the best nodes met by each query, best first; -1 and -inf pad."""
    b, n = len(queries), len(vectors)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n), bool)
    stamp = np.zeros((b, n), np.int16)
    seen[:, entries] = True
    start = queries @ vectors[entries].T
    ids = np.full((b, beam), -1, np.int32)
    sims = np.full((b, beam), -np.inf, np.float32)
    done = np.ones((b, beam), bool)
    k = min(beam, len(entries))
    order = np.argsort(-start, axis=1)[:, :k]
    ids[:, :k], sims[:, :k], done[:, :k] = entries[order], np.take_along_axis(start, order, 1), False
    live = np.arange(b)
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        pick = np.argpartition(-open_sims, min(_WIDTH, beam) - 1, axis=1)[:, :_WIDTH]
        usable = np.isfinite(np.take_along_axis(open_sims, pick, 1))
        keep = usable.any(1)
        live, pick, usable = live[keep], pick[keep], usable[keep]
        if not len(live):
            break
        done[live[:, None], pick] |= usable
        near = np.where(usable[:, :, None], graph[ids[live[:, None], pick]], -1).reshape(len(live), -1)
        r = np.broadcast_to(live[:, None], near.shape)
        col = np.broadcast_to(np.arange(near.shape[1], dtype=np.int16), near.shape)
        ok = near >= 0
        ok &= ~seen[r, near]
        stamp[r[ok], near[ok]] = col[ok]
        ok &= stamp[r, near] == col
        rf, nf = r[ok], near[ok]
        seen[rf, nf] = True
        found = np.full(near.shape, -np.inf, np.float32)
        found[ok] = np.einsum("ij,ij->i", queries[rf], vectors[nf])
        all_sims = np.concatenate([sims[live], found], 1)
        all_ids = np.concatenate([ids[live], near], 1)
        all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live], sims[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    sims = np.take_along_axis(sims, order, 1)
    return np.where(np.isfinite(sims), np.take_along_axis(ids, order, 1), -1), sims


def _prune(vectors: np.ndarray, points: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Relaxed-distance pruning of the candidates ids (B, C) of each point down to degree, -1 padded."""
    own = vectors[points]
    cand = vectors[np.maximum(ids, 0)]
    dist = 2 - 2 * np.einsum("bd,bcd->bc", own, cand)
    bad = (ids < 0) | (ids == points[:, None])
    order = np.argsort(np.where(bad, np.inf, dist), axis=1, kind="stable")
    ids, dist, bad = (np.take_along_axis(x, order, 1) for x in (ids, dist, bad))
    bad[:, 1:] |= ids[:, 1:] == ids[:, :-1]
    cand = np.take_along_axis(cand, order[:, :, None], 1)
    among = 2 - 2 * np.matmul(cand, cand.transpose(0, 2, 1))
    left = ~bad
    out = np.full((len(points), degree), -1, np.int32)
    rows = np.arange(len(points))
    for slot in range(degree):
        first = left.argmax(1)
        has = left[rows, first]
        if not has.any():
            break
        out[:, slot] = np.where(has, ids[rows, first], -1)
        left &= ~(alpha * among[rows, first] <= dist) | ~has[:, None]
        left[rows, first] = False
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Graph (n, degree) of neighbour places, -1 padded, and the entry places for searches.

    vectors: unit rows, float32. One row or none gives an empty graph."""
    n = len(vectors)
    graph = np.full((n, degree), -1, np.int32)
    if n == 0:
        return graph, np.zeros(0, np.int32)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    entries = order[: min(n, 16)]
    inserted = len(entries)
    if inserted > 1:
        ring = np.stack([np.concatenate([entries[entries != p], np.full(1, -1, np.int32)])[: inserted - 1] for p in entries])
        graph[entries] = _prune(vectors, entries, ring, degree, alpha)
    while inserted < n:
        batch = order[inserted : inserted + min(_BATCH, max(16, inserted))]
        ids, _ = _beam(vectors, graph, vectors[batch], entries, beam)
        graph[batch] = _prune(vectors, batch, ids, degree, alpha)
        src = np.repeat(batch, degree)
        dst = graph[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        target, start, count = np.unique(dst, return_index=True, return_counts=True)
        extra = np.full((len(target), int(count.max(initial=0))), -1, np.int32)
        extra[np.repeat(np.arange(len(target)), count), np.arange(len(dst)) - np.repeat(start, count)] = src
        free = (graph[target] < 0).sum(1)
        full = count > free
        for t in np.flatnonzero(~full):
            node = target[t]
            at = degree - free[t]
            graph[node, at : at + count[t]] = extra[t, : count[t]]
        if full.any():
            hot = target[full]
            for part in range(0, len(hot), _BATCH):
                h = hot[part : part + _BATCH]
                graph[h] = _prune(vectors, h, np.concatenate([graph[h], extra[full][part : part + _BATCH]], 1), degree, alpha)
        inserted += len(batch)
    return graph, entries


def search(vectors: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of unit queries: places (Q, beam) and cosines, best first, -1 padded."""
    if not len(vectors) or not len(queries):
        return np.full((len(queries), beam), -1, np.int32), np.full((len(queries), beam), -np.inf, np.float32)
    parts = [_beam(vectors, graph, queries[i : i + _BATCH], entries, beam) for i in range(0, len(queries), _BATCH)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
