"""Sequential algorithms of one graph, run per graph by ``applyInPandas``.

For batches of graphs that each fit in a task; a single large graph takes the
iterative forms in ``graph``. Nodes and edges of a graph travel together, so
isolated nodes stay. Ties always go to the smallest node.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.bfs import dependencies, sorted_links


def per_graph(nodes: DataFrame, edges: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterable[tuple]], schema: str) -> DataFrame:
    """``kernel(node ids, src index, dst index, weight)`` per graph; rows without graph_id, which comes first in ``schema``."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(n["node_id"].unique())
        rows = list(kernel(ids, np.searchsorted(ids, e["src"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy()), e["weight"].to_numpy(float)))
        out = pd.DataFrame(rows, columns=names[1:])
        out.insert(0, names[0], key[0])
        return out

    own = nodes.select(F.col("graph_id").alias("graph_id"), F.col("node_id").alias("node_id"))  # new names, as nodes may be made from edges
    return own.groupBy("graph_id").cogroup(edges.select("graph_id", "src", "dst", "weight").groupBy("graph_id")).applyInPandas(run, schema)


class Union:
    """Disjoint sets with sizes, the largest size and the number of connected pairs."""

    def __init__(self, n: int):
        self.up, self.size, self.largest, self.pairs = list(range(n)), [1] * n, 0, 0

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.pairs += self.size[a] * self.size[b]
            self.up[b] = a
            self.size[a] += self.size[b]
            self.largest = max(self.largest, self.size[a])


def neighbours(n: int, src: np.ndarray, dst: np.ndarray) -> list[set[int]]:
    out: list[set[int]] = [set() for _ in range(n)]
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def dismantling_curve(order: list[int], near: list[set[int]]) -> list[tuple[int, int]]:
    """(largest component, connected pairs) after removing the first k of ``order``, k from 0, by adding back in reverse."""
    u, present, out = Union(len(near)), set(), []
    out.append((0, 0))
    for x in reversed(order):
        present.add(x)
        u.largest = max(u.largest, 1)
        for y in near[x]:
            if y in present:
                u.join(x, y)
        out.append((u.largest, u.pairs))
    return out[::-1]


def degree_removals(near: list[set[int]]) -> list[int]:
    """Nodes by repeatedly removing the one of largest remaining degree, until no edge is left. A heap holds a node's degrees, the last of which counts."""
    degree, gone, order = [len(x) for x in near], set(), []
    heap = [(-k, x) for x, k in enumerate(degree) if k]
    heapq.heapify(heap)
    while heap:
        k, x = heapq.heappop(heap)
        if x in gone or -k != degree[x]:
            continue
        gone.add(x)
        order.append(x)
        for y in near[x]:
            if y not in gone:
                degree[y] -= 1
                if degree[y]:
                    heapq.heappush(heap, (-degree[y], y))
    return order


def adaptive_degree_order(near: list[set[int]]) -> list[int]:
    """All nodes by ``degree_removals``; those that stay follow by id."""
    order = degree_removals(near)
    done = set(order)
    return order + [x for x in range(len(near)) if x not in done]


def robustness(ids, src, dst, weight):
    """Node- and pair-connectivity robustness of the adaptive degree order: sums over k = 1..n-1 of the curve, over n * n and n * pairs."""
    near = neighbours(len(ids), src, dst)
    curve = dismantling_curve(adaptive_degree_order(near), near)
    n = len(ids)
    norm = n * (n - 1) / 2 or 1
    yield n, sum(c[0] for c in curve[1:n]) / n**2, sum(c[1] for c in curve[1:n]) / norm / n


def greedy_cover(ids, src, dst, weight):
    """A vertex cover by largest number of uncovered edges, in order of choice."""
    for step, x in enumerate(degree_removals(neighbours(len(ids), src, dst))):
        yield step, int(ids[x])


def reinsert(near: list[set[int]], removed: list[int], strategy: str = "rank", step: int = 1, cost=None) -> list[int]:
    """New removal order of ``removed``: the nodes of the smallest score come back first, so they are removed last.

    The score is the number of components joined ("count"), one plus their sizes ("rank"), or the product
    ("multiple"), times the node's cost.

    Of the components next to a removed node, one is its main one. Nodes of one main component and one factor wait in a
    heap by the size of their other components, so a component's growth moves all of them at once. Factors are exact and
    sizes only grow, so what waits is never above a node's score, and is scored again as it comes up. When components meet, the nodes
    next to the one with fewer of them are scored again, which a node sees a logarithmic number of times.
    """
    gone, up, size = set(removed), list(range(len(near))), [1] * len(near)
    beside: dict[int, set[int]] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(a: int, b: int) -> set[int]:
        """Joins two components; the nodes next to the one that has fewer."""
        a, b = root(a), root(b)
        if a == b:
            return set()
        if len(beside[a]) < len(beside[b]):
            a, b = b, a
        up[b] = a
        size[a] += size[b]
        few = beside.pop(b)
        beside[a] |= few
        return few

    for x in range(len(near)):
        if x not in gone:
            beside[x] = near[x] & gone
    for x in range(len(near)):
        if x not in gone:
            for y in near[x]:
                if y < x and y not in gone:
                    join(x, y)

    def state(x: int) -> tuple:
        """Score, main component, factor and the size of the others."""
        roots = {root(y) for y in near[x] if y not in gone}
        sizes = sum(size[r] for r in roots)
        main = max(roots, key=lambda r: (size[r], -r)) if roots else -1
        factor = 1 if strategy == "rank" else len(roots)
        own = 1 if cost is None else float(cost[x])
        value = factor if strategy == "count" else (1 + sizes) * factor
        key = (main, factor, own)
        return value * own, key, 0 if strategy == "count" else sizes - (size[main] if roots else 0)

    waits: dict[tuple, list[tuple[int, int]]] = {}
    place: dict[int, tuple] = {}
    heads: list[tuple] = []
    shown: dict[tuple, tuple] = {}

    def head(key: tuple) -> None:
        """The first node of a heap stands for it, with the least score that it may have."""
        heap = waits[key]
        while heap and place.get(heap[0][1]) != (key, heap[0][0]):
            heapq.heappop(heap)
        if not heap:
            del waits[key]
            shown.pop(key, None)
            return
        rest, x = heap[0]
        main, factor, own = key
        sizes = rest + (size[main] if main >= 0 else 0)
        entry = ((factor if strategy == "count" else (1 + sizes) * factor) * own, x)
        if shown.get(key) != entry:
            shown[key] = entry
            heapq.heappush(heads, (*entry, key))

    def put(x: int) -> None:
        _, key, rest = state(x)
        if place.get(x) == (key, rest):
            return
        place[x] = (key, rest)
        heap = waits.setdefault(key, [])
        heapq.heappush(heap, (rest, x))
        if heap[0] == (rest, x):
            head(key)

    for x in gone:
        put(x)
    back: list[int] = []
    while gone:
        some: list[int] = []
        while heads and len(some) < step:
            value, x, key = heapq.heappop(heads)
            if shown.get(key) != (value, x):
                continue
            del shown[key]
            if waits[key][0][1] == x and place.get(x) == (key, waits[key][0][0]):
                now, new, _ = state(x)
                if now == value and new == key:
                    some.append(x)
                    del place[x]
                else:
                    put(x)
            if key in waits:
                head(key)
        for x in some:
            gone.discard(x)
            back.append(x)
            beside[x] = near[x] & gone
            touched = set(beside[x])
            for y in near[x]:
                if y not in gone:
                    few = join(x, y)
                    touched |= few
            for y in touched:
                if y in place:
                    put(y)
    return back[::-1]


def reinsertion(ids, src, dst, weight):
    """Removal order of a degree attack, improved: removed nodes come back one by one, the one that joins the smallest set first."""
    near = neighbours(len(ids), src, dst)
    for k, x in enumerate(reinsert(near, degree_removals(near))):
        yield k, int(ids[x])


def betweenness(ids, src, dst, weight):
    """Brandes' shortest-path betweenness, unweighted, each pair once."""
    total = dependencies(*sorted_links(len(ids), src, dst), np.arange(len(ids)))
    for k, x in enumerate(ids):
        yield int(x), float(total[k] / 2)


def best_cut(ids, src, dst, weight):
    """Maximum cut by trying all sides; for graphs of at most 16 nodes."""
    n = len(ids)
    if n > 16:
        raise ValueError(f"{n} nodes are too many to try all sides")
    codes = np.arange(1 << max(n - 1, 0))[:, None] >> np.arange(n) & 1
    yield n, float(((codes[:, src] != codes[:, dst]) * weight).sum(1).max(initial=0))
