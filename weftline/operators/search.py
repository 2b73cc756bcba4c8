"""Sequential heuristics and scores of one graph, kernels for ``local.per_graph``.

Every kernel takes (node ids, src index, dst index, weight) and gives rows; ties go to the smallest node.
"""

from __future__ import annotations

import heapq

import numpy as np

from weftline.operators.bfs import all_distance_sums, sorted_links
from weftline.operators.local import neighbours


def two_core(ids, src, dst, weight):
    """Nodes left after peeling those of degree below two."""
    near = neighbours(len(ids), src, dst)
    todo = [k for k, x in enumerate(near) if len(x) < 2]
    gone = set(todo)
    while todo:
        x = todo.pop()
        for y in near[x]:
            near[y].discard(x)
            if y not in gone and len(near[y]) < 2:
                gone.add(y)
                todo.append(y)
    for k in range(len(ids)):
        if k not in gone:
            yield (int(ids[k]),)


def independent_set(ids, src, dst, weight):
    """An independent set by smallest remaining degree, in order of choice."""
    near = neighbours(len(ids), src, dst)
    heap = [(len(x), k) for k, x in enumerate(near)]
    heapq.heapify(heap)
    live, step = set(range(len(ids))), 0
    while heap:
        degree, x = heapq.heappop(heap)
        if x not in live or degree != len(near[x]):
            continue
        yield step, int(ids[x])
        step += 1
        out = {x, *near[x]}
        live -= out
        for y in out:
            for z in near[y]:
                if z in live:
                    near[z].discard(y)
                    heapq.heappush(heap, (len(near[z]), z))


def colouring(ids, src, dst, weight):
    """Colours by most distinctly coloured neighbours, then degree; the smallest free colour each time."""
    near = neighbours(len(ids), src, dst)
    seen: list[set[int]] = [set() for _ in near]
    colour = [-1] * len(near)
    heap = [(0, -len(x), k) for k, x in enumerate(near)]
    heapq.heapify(heap)
    while heap:
        saturation, _, x = heapq.heappop(heap)
        if colour[x] >= 0 or -saturation != len(seen[x]):
            continue
        colour[x] = next(c for c in range(len(near) + 1) if c not in seen[x])
        for y in near[x]:
            if colour[y] < 0 and colour[x] not in seen[y]:
                seen[y].add(colour[x])
                heapq.heappush(heap, (-len(seen[y]), -len(near[y]), y))
    for k, c in enumerate(colour):
        yield int(ids[k]), c


def local_cut(ids, src, dst, weight):
    """A cut that no single move betters, from all nodes on one side; the value and the moves made."""
    n = len(ids)
    off = src != dst
    src, dst, weight = src[off], dst[off], np.asarray(weight, float)[off]
    side = np.ones(n)
    order = np.argsort(np.concatenate([src, dst]), kind="stable")
    ends, w = np.concatenate([dst, src])[order], np.concatenate([weight, weight])[order]
    at = np.searchsorted(np.concatenate([src, dst])[order], np.arange(n + 1))
    gain = np.bincount(np.concatenate([src, dst]), np.concatenate([weight, weight]), minlength=n)
    moves = 0
    while n and gain.max() > 1e-9:
        x = int(np.argmax(gain))
        mine = slice(at[x], at[x + 1])
        np.add.at(gain, ends[mine], -2 * w[mine] * side[x] * side[ends[mine]])
        gain[x] = -gain[x]
        side[x] = -side[x]
        moves += 1
    yield n, float(weight[side[src] != side[dst]].sum()), moves


def pagerank(ids, src, dst, weight, damping: float = 0.85, rounds: int = 50):
    """Unweighted PageRank; what nodes without neighbours hold is spread over all."""
    n = len(ids)
    off = src != dst
    a, b = np.concatenate([src[off], dst[off]]), np.concatenate([dst[off], src[off]])
    degree = np.bincount(a, minlength=n)
    rank = np.full(n, 1 / max(n, 1))
    for _ in range(rounds):
        share = rank / np.maximum(degree, 1)
        loose = rank[degree == 0].sum()
        rank = (1 - damping) / n + damping * (np.bincount(b, share[a], minlength=n) + loose / n)
    for k in range(n):
        yield int(ids[k]), float(rank[k])


def closeness(ids, src, dst, weight):
    """Reached nodes squared over (n - 1) times the sum of distances; 0 for isolated nodes."""
    reached, total = all_distance_sums(*sorted_links(len(ids), src, dst))
    for x, r, t in zip(ids.tolist(), reached.tolist(), total.tolist(), strict=True):
        yield int(x), float(r**2 / (t * (len(ids) - 1))) if t else 0.0
