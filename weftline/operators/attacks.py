"""Node removal orders of one graph and what they are worth, kernels for ``local.per_graph``.

An attack removes the node of the highest score among those that still have neighbours, until no edge is left;
remaining nodes follow by id. Ties go to the smallest node. Robustness weighs each step by the removed node's cost.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.bfs import all_distance_sums, dependencies, distance_sums, sorted_links
from weftline.operators.local import Union, dismantling_curve, neighbours, reinsert
from weftline.operators.solvers import _labels as labels
from weftline.scratch import Rounds


def distances(near: list[set[int]], start: int) -> dict[int, int]:
    """Breadth-first distance of every node that ``start`` reaches."""
    found, front = {start: 0}, [start]
    for x in front:
        for y in near[x]:
            if y not in found:
                found[y] = found[x] + 1
                front.append(y)
    return found


def degree_score(near):
    return np.array([len(x) for x in near], float)


def closeness_score(near):
    out = np.zeros(len(near))
    for k in range(len(near)):
        d = distances(near, k)
        if len(d) > 1:
            out[k] = (len(d) - 1) ** 2 / sum(d.values())
    return out


def pagerank_score(near, damping: float = 0.85, rounds: int = 60):
    n = len(near)
    degree = degree_score(near)
    a = np.repeat(np.arange(n), degree.astype(int))
    b = np.fromiter((y for x in near for y in sorted(x)), int, len(a))
    return _ranks(n, a, b, degree, damping, rounds)


def _ranks(n: int, a: np.ndarray, b: np.ndarray, degree: np.ndarray, damping: float = 0.85, rounds: int = 60) -> np.ndarray:
    """Rounds over the links from ``a`` to ``b``, sorted by both."""
    rank = np.full(n, 1 / max(n, 1))
    for _ in range(rounds):
        rank = (1 - damping) / n + damping * (np.bincount(b, (rank / np.maximum(degree, 1))[a], minlength=n) + rank[degree == 0].sum() / n)
    return rank


def betweenness_score(near):
    """Shortest-path betweenness over (n - 1)(n - 2), both directions."""
    n = len(near)
    total = np.zeros(n)
    for s in range(n):
        dist = distances(near, s)
        paths = dict.fromkeys(dist, 0.0)
        paths[s] = 1.0
        for x in dist:
            for y in near[x]:
                if dist[y] == dist[x] + 1:
                    paths[y] += paths[x]
        share = dict.fromkeys(dist, 0.0)
        for y in reversed(list(dist)):
            for x in near[y]:
                if dist[x] == dist[y] - 1:
                    share[x] += paths[x] / paths[y] * (1 + share[y])
            if y != s:
                total[y] += share[y]
    return total / max((n - 1) * (n - 2), 1)


def core_score(near):
    """Degree, and nodes of the 2-core before all others."""
    live = [set(x) for x in near]
    todo = [k for k, x in enumerate(live) if len(x) < 2]
    gone = set(todo)
    for x in todo:
        for y in live[x]:
            live[y].discard(x)
            if y not in gone and len(live[y]) < 2:
                gone.add(y)
                todo.append(y)
    degree = degree_score(near)
    return degree + np.array([k not in gone for k in range(len(near))]) * (len(near) + 1)


def influence_score(near, walks: int = 1):
    """Collective influence: (k - 1) times the sum of (k - 1) at the ends of walks of that length."""
    rest = np.maximum(degree_score(near) - 1, 0)
    f = rest
    for _ in range(walks):
        f = np.array([sum(f[y] for y in x) for x in near])
    return rest * f


SCORES: dict[str, Callable] = {
    "degree": degree_score,
    "closeness": closeness_score,
    "pagerank": pagerank_score,
    "betweenness": betweenness_score,
    "corehd": core_score,
    "collective_influence": influence_score,
    "collective_influence_l2": lambda near: influence_score(near, 2),
}


class Degrees:
    """Scores kept while nodes go: ``remove`` gives the nodes whose score may have changed. Here ``degree_score``."""

    def __init__(self, near: list[set[int]]):
        self.near = near

    def value(self, x: int) -> int:
        return len(self.near[x])

    def remove(self, x: int) -> set[int]:
        out, self.near[x] = self.near[x], set()
        for y in out:
            self.near[y].discard(x)
        return out


class Cores(Degrees):
    """``core_score``: nodes leave the 2-core one by one and never come back."""

    def __init__(self, near: list[set[int]]):
        super().__init__(near)
        self.inner = [len(x) for x in near]  # neighbours in the core
        self.core = [True] * len(near)
        self._peel([k for k, d in enumerate(self.inner) if d < 2])

    def _peel(self, todo: list[int]) -> set[int]:
        gone = set(todo)
        for x in gone:
            self.core[x] = False
        for x in todo:
            for y in self.near[x]:
                if self.core[y]:
                    self.inner[y] -= 1
                    if self.inner[y] < 2:
                        self.core[y] = False
                        gone.add(y)
                        todo.append(y)
        return gone

    def value(self, x: int) -> int:
        return len(self.near[x]) + self.core[x] * (len(self.near) + 1)

    def remove(self, x: int) -> set[int]:
        gone = self._peel([x]) if self.core[x] else set()
        return super().remove(x) | gone


class Influences(Degrees):
    """``influence_score``: what a removal changes is at most one step more than a walk away."""

    def __init__(self, near: list[set[int]], walks: int = 1):
        super().__init__(near)
        self.sums = [[max(len(x) - 1, 0) for x in near]]
        for _ in range(walks):
            last = self.sums[-1]
            self.sums.append([sum(last[y] for y in x) for x in near])

    def value(self, x: int) -> int:
        return self.sums[0][x] * self.sums[-1][x]

    def remove(self, x: int) -> set[int]:
        ends = super().remove(x)
        lost, moved = [sums[x] for sums in self.sums], {x: -self.sums[0][x]}
        self.sums[0][x] = 0
        for y in ends:
            if self.near[y]:
                moved[y] = -1
                self.sums[0][y] -= 1
        reach = ends | {x}
        for last, sums, gone in zip(self.sums, self.sums[1:], lost):
            # what the neighbours' sums of before lose, and the links between ``x`` and its neighbours
            new: dict[int, int] = dict.fromkeys(ends, -gone)
            for z, d in moved.items():
                for y in self.near[z]:
                    new[y] = new.get(y, 0) + d
            new[x] = -sums[x]
            for y, d in new.items():
                sums[y] += d
            moved = new
            reach |= new.keys()
        return reach


KEPT: dict[Callable, Callable] = {
    degree_score: Degrees,
    core_score: Cores,
    influence_score: Influences,
    SCORES["collective_influence_l2"]: lambda near: Influences(near, 2),
}


def _kept_order(kept, batch: int, scores: list | None = None) -> list[int]:
    """Removals by a heap of scores, of which none rises; ``scores`` takes those of the removed."""
    near, order = kept.near, []
    heap = [(-kept.value(x), x) for x in range(len(near)) if near[x]]
    heapq.heapify(heap)
    while heap:
        some: list[int] = []
        while heap and len(some) < batch:
            value, x = heapq.heappop(heap)
            if near[x]:
                now = kept.value(x)
                if now == -value:
                    some.append(x)
                else:  # scores only fall, so a node is scored again as it comes up
                    heapq.heappush(heap, (-now, x))
        for x in some:
            if near[x]:
                order.append(x)
                if scores is not None:
                    scores.append(float(kept.value(x)))
                kept.remove(x)
    return order


def _closeness_removals(near: list[set[int]], scores: list | None = None) -> list[int]:
    """Removals by ``closeness_score``, of which the nodes that may be the highest are computed anew.

    A removal lengthens paths, and what it cuts off was as far as its way through the removed node says. So the sums of distances less
    what is gone are bounds, and a node is searched from again only when no node known for sure is above its bound.
    """
    n, order = len(near), []
    a = np.fromiter((x for x, out in enumerate(near) for _ in out), int)
    b = np.fromiter((y for out in near for y in out), int, len(a))
    reached, total = all_distance_sums(*sorted_links(n, a, b))
    sure, label = np.ones(n, bool), np.zeros(n, int)
    seen, pieces = set(), 0
    for x in range(n):
        if x not in seen:
            part = distances(near, x)
            seen |= part.keys()
            label[list(part)] = pieces = pieces + 1
    score = np.where(reached > 0, reached**2 / np.maximum(total, 1), -np.inf)
    while len(a):
        x = int(np.argmax(score))
        if not sure[x]:
            mine = np.flatnonzero(label == label[x])
            doubt = mine[~sure[mine]]
            if len(doubt) > 64:
                doubt = doubt[np.argpartition(-score[doubt], 63)[:64]]
            place = np.zeros(n, int)
            place[mine] = np.arange(len(mine))
            on = label[a] == label[x]
            start = np.searchsorted(place[a[on]], np.arange(len(mine) + 1))  # links stay sorted by ``a``
            total[doubt] = distance_sums(start, place[b[on]], place[doubt])
            score[doubt] = reached[doubt] ** 2 / total[doubt]
            sure[doubt] = True
            continue
        order.append(x)
        if scores is not None:
            scores.append(float(score[x]))
        far = distances(near, x)
        out, near[x] = near[x], set()
        for y in out:
            near[y].discard(x)
        on = (a != x) & (b != x)
        a, b = a[on], b[on]
        score[x] = -np.inf
        whole, seen = sum(far.values()), set()
        for y in out:
            if y in seen:
                continue
            part = distances(near, y)
            seen |= part.keys()
            mine = np.fromiter(part, int, len(part))
            depth = np.fromiter((far[z] for z in part), int, len(part))
            degree = np.fromiter((len(near[z]) for z in part), int, len(part))
            label[mine] = pieces = pieces + 1
            reached[mine] = len(part) - 1
            least = total[mine] - depth * (len(far) - len(part)) - (whole - depth.sum())
            total[mine] = np.maximum(least, 2 * (len(part) - 1) - degree)
            sure[mine] = len(part) == 1
            score[mine] = (len(part) - 1) ** 2 / np.maximum(total[mine], 1) if len(part) > 1 else -np.inf
    return order


def _pagerank_removals(near: list[set[int]]) -> list[int]:
    """Removals by ``pagerank_score`` one by one; the sorted links are kept, of which a removal takes some out."""
    n, order = len(near), []
    degree = degree_score(near)
    a = np.repeat(np.arange(n), degree.astype(int))
    b = np.fromiter((y for x in near for y in sorted(x)), int, len(a))
    while len(a):
        x = int(np.argmax(np.where(degree > 0, _ranks(n, a, b, degree), -np.inf)))
        order.append(x)
        on = (a != x) & (b != x)
        degree[b[a == x]] -= 1
        degree[x] = 0
        a, b = a[on], b[on]
    return order


def _folded(near: list[list[int]], size: np.ndarray) -> np.ndarray:
    """``dependencies`` of all nodes, of which ``size`` says how many are in the piece of each: trees that hang from a node are folded into it, as paths within and out of them are known, and only what is left is searched."""
    n = len(near)
    degree, weight, square, live = [len(x) for x in near], [1] * n, [0] * n, [True] * n
    todo = [x for x in range(n) if degree[x] == 1]
    for x in todo:
        if degree[x] == 1:  # not the last of a tree
            live[x] = False
            for y in near[x]:
                if live[y]:
                    weight[y] += weight[x]
                    square[y] += weight[x] ** 2
                    degree[y] -= 1
                    if degree[y] == 1:
                        todo.append(y)
    w, on = np.array(weight), np.array(live)
    # pairs of two branches, and those of a branch with what lies beyond the node
    total = ((w - 1.0) ** 2 - np.array(square) + 2.0 * (w - 1) * (size - w)).astype(float)
    core = [x for x in range(n) if live[x] and degree[x]]
    if core:
        place = np.full(n, -1)
        place[core] = np.arange(len(core))
        start = np.cumsum([0, *(degree[x] for x in core)])
        far = np.fromiter((place[y] for x in core for y in near[x] if live[y]), int, int(start[-1]))
        total[on & (place >= 0)] += dependencies(start, far, np.arange(len(core)), 1 << 15, w[core].astype(float))
    return total


def _betweenness_removals(near: list[set[int]], scores: list | None = None) -> list[int]:
    """Removals by ``betweenness_score``. Pieces have no paths in common, so a removal changes the scores of its own piece only, which are computed anew; scores equal to ten digits count as equal."""
    order: list[int] = []
    heap: list[tuple[float, int, list[int]]] = []

    def score(whole: list[int]) -> None:
        """Finds the pieces that nodes, sorted, fall into, and the highest node of each."""
        label: dict[int, int] = {}
        pieces = []
        for x in whole:
            if x not in label and near[x]:
                piece = sorted(distances(near, x))
                label |= dict.fromkeys(piece, len(pieces))
                pieces.append(piece)
        if any(len(piece) > 2 for piece in pieces):
            inner = sorted(x for x, k in label.items() if len(pieces[k]) > 2)
            place = {x: k for k, x in enumerate(inner)}
            total = _folded([[place[y] for y in near[x]] for x in inner], np.array([len(pieces[label[x]]) for x in inner]))
        for piece in pieces:
            top, x = 0.0, piece[0]
            if len(piece) > 2:
                own = total[[place[y] for y in piece]]
                top = own.max()
                x = piece[int(np.argmax(own >= top * (1 - 1e-10)))]
            heapq.heappush(heap, (-float(f"{top:.9e}"), x, piece))

    score(list(range(len(near))))
    while heap:
        top, x, piece = heapq.heappop(heap)
        order.append(x)
        if scores is not None:
            scores.append(-top)
        out, near[x] = near[x], set()
        for y in out:
            near[y].discard(x)
        score([y for y in piece if y != x])
    return order


def attack_order(near: list[set[int]], score: Callable, batch: int = 1) -> list[int]:
    """All nodes in order of removal, ``batch`` nodes between two computations of the score. Scores in ``KEPT`` change near a removed node only and are kept, the others computed anew."""
    near, order = [set(x) for x in near], []
    if score in KEPT:
        order = _kept_order(KEPT[score](near), batch)
    elif score is closeness_score and batch == 1:
        order = _closeness_removals(near)
    elif score is pagerank_score and batch == 1:
        order = _pagerank_removals(near)
    elif score is betweenness_score and batch == 1:
        order = _betweenness_removals(near)
    else:
        left = sum(map(len, near)) // 2
        while left:
            value = np.where([bool(x) for x in near], score(near), -np.inf)
            for x in np.argsort(-value, kind="stable")[:batch].tolist():
                if near[x]:
                    left -= len(near[x])
                    for y in near[x]:
                        near[y].discard(x)
                    near[x] = set()
                    order.append(x)
    done = set(order)
    return order + [k for k in range(len(near)) if k not in done]


#: Attacks whose scores a removal changes in its own piece only, and how a piece's removals and their scores are found.
LOCAL: dict[str, Callable] = {
    "closeness": _closeness_removals,
    "betweenness": _betweenness_removals,
    **{kind: lambda near, scores, kept=KEPT[SCORES[kind]]: _kept_order(kept(near), 1, scores) for kind in ("collective_influence", "collective_influence_l2")},
}


def pieces(n: int, src: np.ndarray, dst: np.ndarray, most: int = 500_000) -> np.ndarray:
    """Of every link the part of the graph that it is in: whole pieces, with others up to ``most`` nodes times links in all."""
    label = labels(n, np.concatenate([src, dst]), np.concatenate([dst, src]))
    links = np.bincount(label[src], minlength=n)
    work = np.cumsum(np.bincount(label, minlength=n) * links)
    return (work // most)[label[src]]


def attack_in_parts(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """graph_id and what ``attack(kind)`` gives, for a kind in ``LOCAL``. Parts of a graph are attacked in tasks of their own; the graph's order is theirs merged by score, then node, as a
    part's next removal does not depend on other parts."""
    graph = dict(edges.dtypes)["graph_id"]

    def part(t: pd.DataFrame) -> pd.DataFrame:
        t = t[t["src"] != t["dst"]]
        ids, at = np.unique(t[["src", "dst"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        return t.assign(part=pieces(len(ids), at[:, 0], at[:, 1]))

    def attacked(key, t: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(t[["src", "dst"]].to_numpy(), return_inverse=True)
        at, scores = at.reshape(-1, 2), []
        order = LOCAL[kind](neighbours(len(ids), at[:, 0], at[:, 1]), scores)
        return pd.DataFrame({"graph_id": key[0], "part": key[1], "place": np.arange(len(order)), "src": ids[order], "dst": ids[order], "score": np.array(scores, float)})

    def merged(key, n: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(n["node_id"].unique())
        removal = t["place"] >= 0
        links, gone = t[~removal], t[removal].sort_values(["part", "place"])
        near = neighbours(len(ids), *(np.searchsorted(ids, links[end].to_numpy()) for end in ("src", "dst")))
        node, score = np.searchsorted(ids, gone["src"].to_numpy()).tolist(), gone["score"].tolist()
        bound = [*np.flatnonzero(np.diff(gone["part"].to_numpy(), prepend=-1)).tolist(), len(node)]
        heads = [(-score[a], node[a], a, b) for a, b in zip(bound, bound[1:])]
        heapq.heapify(heads)
        order: list[int] = []
        while heads:
            _, x, a, b = heads[0]
            order.append(x)
            if a + 1 < b:
                heapq.heapreplace(heads, (-score[a + 1], node[a + 1], a + 1, b))
            else:
                heapq.heappop(heads)
        rest = np.ones(len(ids), bool)
        rest[order] = False
        used, order = len(order), order + np.flatnonzero(rest).tolist()
        return pd.DataFrame([(key[0], len(ids), used, *robustness(near, order), *robustness(near, order, degree_cost(near)))], columns=FOUR)

    spark = edges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rounds = Rounds(spark, "attack")
    ends = edges.select("graph_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    parted = rounds.put(ends.groupBy("graph_id").applyInPandas(part, f"graph_id {graph}, src long, dst long, part long"))
    # a fixed number of tasks, as small tables would be put into few
    found = parted.repartition(tasks, "graph_id", "part").groupBy("graph_id", "part").applyInPandas(attacked, f"graph_id {graph}, part long, place long, src long, dst long, score double")
    both = parted.select("graph_id", "part", F.lit(-1).cast("long").alias("place"), "src", "dst", F.lit(0.0).alias("score")).unionByName(rounds.put(found))
    own = nodes.select("graph_id", F.col("node_id").cast("long").alias("node_id"))
    return own.groupBy("graph_id").cogroup(both.groupBy("graph_id")).applyInPandas(merged, f"graph_id {graph}, n long, removed long, nd double, cn double, nd_cost double, cn_cost double")


FOUR = ["graph_id", "n", "removed", "nd", "cn", "nd_cost", "cn_cost"]


def removals(near: list[set[int]], order: list[int]) -> int:
    """How many nodes of ``order`` go until no edge is left."""
    left, used = sum(map(len, near)) // 2, 0
    seen: set[int] = set()
    while left:
        x = order[used]
        left -= sum(y not in seen for y in near[x])
        seen.add(x)
        used += 1
    return used


def robustness(near, order, cost=None) -> tuple[float, float]:
    """Mean largest component and mean connected pairs of the residual graph, weighted by the share of removed cost."""
    n = len(near)
    if n < 2:
        return 0.0, 0.0
    share = np.full(n, 1 / n) if cost is None else np.asarray(cost, float) / max(np.sum(cost), 1e-300)
    curve = dismantling_curve(order, near)[1:n]
    step = share[order[: n - 1]]
    return float(sum(s * c[0] / n for s, c in zip(step, curve, strict=True))), float(sum(s * c[1] / (n * (n - 1) / 2) for s, c in zip(step, curve, strict=True)))


def degree_cost(near) -> np.ndarray:
    """Degree over the highest degree, at least that of one edge."""
    degree = np.maximum(degree_score(near), 1)
    return degree / degree.max(initial=1)


def attack(kind: str, batch_share: float = 0.0):
    """Kernel: n, removals until edgeless, the four robustness values of the attack ``kind``."""

    def run(ids, src, dst, weight):
        near = neighbours(len(ids), src, dst)
        order = attack_order(near, SCORES[kind], max(1, int(batch_share * len(ids))))
        yield (len(ids), removals(near, order), *robustness(near, order), *robustness(near, order, degree_cost(near)))

    return run


def reinserted(strategy: str, weighted: bool = False):
    """Kernel: node connectivity of the degree attack before and after re-insertion by ``strategy``."""

    def run(ids, src, dst, weight):
        near = neighbours(len(ids), src, dst)
        order = attack_order(near, degree_score)
        used = removals(near, order)
        cut, rest = order[:used], order[used:]
        cost = degree_cost(near) if weighted else None
        better = reinsert(near, cut, strategy, cost=cost)
        yield len(ids), len(cut), robustness(near, order, cost)[0], robustness(near, better + rest, cost)[0]

    return run


def _moved(order: np.ndarray, kind: str, reach: int, rng) -> tuple[np.ndarray, int, int]:
    """The order and the first and last place that changed."""
    i, j = np.sort(rng.choice(reach, 2, replace=False))
    out = order.copy()
    if kind == "swap":
        out[i], out[j] = out[j], out[i]
    elif kind == "shift":
        out = np.insert(np.delete(out, j), i, order[j])
    else:
        out[i : j + 1] = order[i : j + 1][::-1]
    return out, int(i), int(j)


MOVES = ("swap", "shift", "reverse")


class Curve:
    """Largest components after the first k of an order are gone, k from 1 to n - 1, and their ``total``. Where places i to j of the order change only those from i + 1 to j may: sets of the nodes that
    are left are kept at some places, and joined on from the next one."""

    def __init__(self, near: list[set[int]], order: np.ndarray, kept: int = 16):
        self.near, self.order, n = near, order, len(near)
        self.gap = max(1, n // kept)
        self.kept: dict[int, tuple[list[int], list[int], int]] = {n: (list(range(n)), [1] * n, 0)}
        self.values = np.zeros(n + 1, np.int64)
        self.values[: n + 1] = self._run(order, 0, n, True)
        self.total = int(self.values[1:n].sum())

    def _run(self, order: np.ndarray, low: int, high: int, keep: bool) -> np.ndarray:
        """Values from ``low`` to ``high``, which is a place kept."""
        up, size, largest = self.kept[high]
        up, size, near, out = up.copy(), size.copy(), self.near, [largest]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        place, nodes = place.tolist(), order[low:high].tolist()
        for k in range(high - 1, low - 1, -1):
            x = a = nodes[k - low]
            for y in near[x]:
                if place[y] > k:
                    while up[y] != y:
                        up[y] = up[up[y]]
                        y = up[y]
                    if y != a:
                        if size[a] < size[y]:
                            a, y = y, a
                        up[y] = a
                        size[a] += size[y]
            largest = max(largest, size[a])
            out.append(largest)
            if keep and k and k % self.gap == 0:
                self.kept[k] = up.copy(), size.copy(), largest
        return np.array(out[::-1], np.int64)

    def _from(self, j: int) -> int:
        return min(len(self.order), -(-(j + 1) // self.gap) * self.gap)

    def trial(self, order: np.ndarray, i: int, j: int) -> int:
        """The total of ``order``, which is the present one but for places i to j."""
        new = self._run(order, i + 1, self._from(j), False)
        return self.total + int(new[: j - i].sum() - self.values[i + 1 : j + 1].sum())

    def take(self, order: np.ndarray, i: int, j: int) -> None:
        high = self._from(j)
        self.values[i + 1 : high + 1] = self._run(order, i + 1, high, True)
        self.order, self.total = order, int(self.values[1 : len(order)].sum())


def searched_order(near, rounds: int = 400, seed: int = 0, learn: bool = False, rate: float = 0.5, discount: float = 0.9, explore: tuple[float, float] = (0.9, 0.05)) -> list[int]:
    """A removal order bettered by moves, from decreasing degree.

    The move is drawn by its smoothed success rate, or, with ``learn``, by a table of values over the
    state "how many of the last three moves bettered it".
    """
    rng = np.random.default_rng([seed, len(near)])
    order = np.array(sorted(range(len(near)), key=lambda k: (-len(near[k]), k)), int)
    if len(order) < 3:
        return order.tolist()
    curve, square = Curve(near, order), len(near) ** 2
    best = curve.total / square
    won, tried = np.ones(3), np.full(3, 2.0)
    table, state, recent = np.zeros((4, 3)), 0, []
    for t in range(rounds):
        if learn:
            eps = explore[0] + (explore[1] - explore[0]) * t / max(rounds - 1, 1)
            kind = int(rng.integers(3)) if rng.random() < eps else int(np.argmax(table[state]))
        else:
            kind = int(rng.choice(3, p=won / tried / (won / tried).sum()))
        trial, i, j = _moved(order, MOVES[kind], len(order), rng)
        value = curve.trial(trial, i, j) / square
        better = value < best - 1e-12
        tried[kind] += 1
        won[kind] += better
        if learn:
            recent = [*recent, better][-3:]
            after = sum(recent)
            table[state, kind] += rate * ((best - value if better else 0.0) + discount * table[after].max() - table[state, kind])
            state = after
        if better:
            curve.take(trial, i, j)
            order, best = trial, value
    return order.tolist()


def searched(learn: bool = False, rounds: int = 400):
    """Kernel: node connectivity by decreasing degree, and by the order found from it."""

    def run(ids, src, dst, weight):
        near = neighbours(len(ids), src, dst)
        plain = sorted(range(len(near)), key=lambda k: (-len(near[k]), k))
        yield len(ids), robustness(near, plain)[0], robustness(near, searched_order(near, rounds, learn=learn))[0]

    return run


def edge_attack(pairs: bool = True):
    """Kernel: edges removed by the product of end degrees; mean connectivity of what stays, in pairs or in squared edges of components."""

    def run(ids, src, dst, weight):
        n, m = len(ids), len(src)
        degree = np.bincount(src, minlength=n) + np.bincount(dst, minlength=n)
        order = np.argsort(-(degree[src] * degree[dst]), kind="stable")
        u, inner, total, out = Union(n), np.zeros(n), 0.0, []
        for e in order[::-1].tolist():
            a, b = u.root(int(src[e])), u.root(int(dst[e]))
            held = inner[a] + (inner[b] if a != b else 0)
            total += (held + 1) ** 2 - inner[a] ** 2 - (inner[b] ** 2 if a != b else 0)
            u.join(a, b)
            inner[u.root(a)] = held + 1
            out.append(u.pairs if pairs else total)
        yield n, m, float(sum(out[:-1]) / (n * n) / m) if m else 0.0

    return run
