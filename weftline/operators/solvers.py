"""Heuristics and exact solvers of cuts, covers, sets, quadratic forms and communities; kernels for ``local.per_graph``.

Searches draw from a generator seeded by the graph's size, so reruns agree; ties go to the smallest node.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.local import neighbours


def matrix(n: int, src, dst, weight) -> np.ndarray:
    """Symmetric weights, loops left out."""
    out, off = np.zeros((n, n)), np.asarray(src) != np.asarray(dst)
    np.add.at(out, (src[off], dst[off]), np.asarray(weight, float)[off])
    return out + out.T


def links(n: int, src, dst, weight) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is not zero in ``matrix``: where a node's links start, their near ends, far ends and weights."""
    src, dst = np.asarray(src), np.asarray(dst)
    off = src != dst
    src, dst, weight = src[off], dst[off], np.asarray(weight, float)[off]
    key, at = np.unique(np.concatenate([src * n + dst, dst * n + src]), return_inverse=True)
    near, far = key // max(n, 1), key % max(n, 1)
    return np.searchsorted(near, np.arange(n + 1)), near, far, np.bincount(at, np.concatenate([weight, weight]), minlength=len(key))


def _lists(start: np.ndarray, far: np.ndarray, weight: np.ndarray) -> list[list[tuple[int, float]]]:
    pairs = list(zip(far.tolist(), weight.tolist(), strict=True))
    return [pairs[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def annealed_cut(ids, src, dst, weight, sweeps: int = 50, seed: int = 0):
    """Maximum cut by Metropolis sweeps of geometric cooling: n, value after the best sweep."""
    n = len(ids)
    rng = np.random.default_rng([seed, n, len(src)])
    start, a, b, w = links(n, src, dst, weight)
    near = _lists(start, b, w)
    side = rng.choice([-1.0, 1.0], n)
    cut_of = lambda side: float(w[side[a] != side[b]].sum() / 2)
    field, best = np.bincount(a, w * side[b], minlength=n), cut_of(side)
    heat = max(float(np.abs(side * field).mean()) if n else 0.0, 1e-9)
    side, field = side.tolist(), field.tolist()
    for t in range(sweeps):
        now = heat * 0.01 ** (t / max(sweeps - 1, 1))
        for x in rng.permutation(n).tolist():
            gain = side[x] * field[x]
            if gain >= 0 or rng.random() < math.exp(gain / now):
                twice = 2 * side[x]
                for y, c in near[x]:
                    field[y] -= twice * c
                side[x] = -side[x]
        best = max(best, cut_of(np.array(side)))
    yield n, best


def _weights(near, kind: str) -> np.ndarray:
    degree = np.array([len(x) for x in near], float)
    return {"unit": np.ones(len(near)), "degree": degree + 1, "inverse": 1 / (degree + 1)}[kind]


def annealed_set(ids, src, dst, weight, kind: str = "unit", sweeps: int = 50, seed: int = 0):
    """A heavy independent set by moves that add a node and evict its neighbours, or drop one: n, nodes, weight of the best."""
    near, n = neighbours(len(ids), src, dst), len(ids)
    w, rng, held = _weights(near, kind), np.random.default_rng([seed, n]), set()
    heat, total, best = float(w.mean()) if n else 1.0, 0.0, (0.0, 0)
    for t in range(sweeps):
        now = max(heat * 0.01 ** (t / max(sweeps - 1, 1)), 1e-9)
        for x in rng.permutation(n).tolist():
            out = {x} if x in held else near[x] & held
            gain = -w[x] if x in held else w[x] - sum(w[y] for y in out)
            if gain >= 0 or rng.random() < math.exp(gain / now):
                alone = x in held
                held -= out
                if not alone:
                    held.add(x)
                total += gain
        best = max(best, (total, len(held)))
    yield n, best[1], float(best[0])


def weighted_set(ids, src, dst, weight, kind: str = "degree"):
    """An independent set by (degree + 1) over (1 + live degree): step, node."""
    near = neighbours(len(ids), src, dst)
    first, degree, live, step = [len(x) + 1 for x in near], [len(x) for x in near], [True] * len(near), 0
    heap = [(-first[x] / (1 + degree[x]), x) for x in range(len(near))]
    heapq.heapify(heap)
    while heap:
        value, x = heapq.heappop(heap)
        if not live[x] or -value != first[x] / (1 + degree[x]):
            continue
        out = [x, *(y for y in near[x] if live[y])]
        for y in out:
            live[y] = False
        for y in out:
            for z in near[y]:
                if live[z]:
                    degree[z] -= 1
                    heapq.heappush(heap, (-first[z] / (1 + degree[z]), z))
        yield step, int(ids[x])
        step += 1


def dominating_set(ids, src, dst, weight):
    """A dominating set by newly dominated nodes, itself included: step, node."""
    near = neighbours(len(ids), src, dst)
    open_, new, step = [True] * len(near), [len(x) + 1 for x in near], 0
    heap = [(-c, x) for x, c in enumerate(new)]
    heapq.heapify(heap)
    while heap:
        c, x = heapq.heappop(heap)
        if -c != new[x]:  # counts only fall, so a node is counted again as it comes up
            if new[x]:
                heapq.heappush(heap, (-new[x], x))
            continue
        for y in (x, *near[x]):
            if open_[y]:
                open_[y] = False
                new[y] -= 1
                for z in near[y]:
                    new[z] -= 1
        yield step, int(ids[x])
        step += 1


def clique(ids, src, dst, weight):
    """A clique by most links to other candidates: step, node."""
    near = neighbours(len(ids), src, dst)
    left, step = set(range(len(near))), 0
    while left:
        x = max(left, key=lambda k: (len(near[k] & left), -k))
        left &= near[x]
        yield step, int(ids[x])
        step += 1


def edge_cover_nodes(ids, src, dst, weight):
    """A vertex cover of at most twice the least size: both ends of a maximal matching, edges by (src, dst)."""
    taken: set[int] = set()
    for e in np.lexsort((dst, src)).tolist():
        if src[e] != dst[e] and src[e] not in taken and dst[e] not in taken:
            taken |= {int(src[e]), int(dst[e])}
            yield int(ids[src[e]]), True
            yield int(ids[dst[e]]), False


def _rows(start: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Positions of the rows of ``some`` in a table sorted by key, of which ``start`` says where each begins."""
    length = start[some + 1] - start[some]
    return np.repeat(start[some] - np.cumsum(length) + length, length) + np.arange(length.sum())


def set_cover(ids, src, dst, weight):
    """Sets (``src``) chosen by elements (``dst``) not covered yet: step, set, newly covered."""
    n = len(ids)
    key = np.unique(np.asarray(src) * n + np.asarray(dst))
    sets, members = key // max(n, 1), key % max(n, 1)
    for step, (s, covers) in enumerate(_chosen(np.searchsorted(sets, np.arange(n + 1)), members, n)):
        yield step, int(ids[s]), covers


def _chosen(at: np.ndarray, members: np.ndarray, n: int):
    """Sets in order of choice and what they newly cover; ``at`` says where a set's ``members``, of ``n`` elements, begin."""
    order = np.argsort(members, kind="stable")
    holders = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))[order]
    del order
    of = np.concatenate([[0], np.cumsum(np.bincount(members, minlength=n))])
    new, left = np.diff(at), np.zeros(n, bool)
    left[members] = True
    heap = [(-c, s) for s, c in enumerate(new.tolist()) if c]
    heapq.heapify(heap)
    while heap:
        c, s = heapq.heappop(heap)
        if -c != new[s]:  # counts only fall, so a set is counted again as it comes up
            if new[s]:
                heapq.heappush(heap, (-int(new[s]), s))
            continue
        mine = members[at[s] : at[s + 1]]
        mine = mine[left[mine]]
        left[mine] = False
        np.subtract.at(new, holders[_rows(of, mine)], 1)
        yield s, len(mine)


def set_covers(rows: DataFrame) -> DataFrame:
    """graph_id, step, set_id, covers: ``set_cover`` of every graph of (graph_id, src, dst). A graph comes to its task in sorted batches and is held in a few tables of as many numbers, not as a frame."""
    kind = dict(rows.dtypes)["graph_id"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cover(graph, sets: list[np.ndarray], elements: list[np.ndarray]):
        near, far = np.concatenate(sets), np.concatenate(elements)
        sets.clear()
        elements.clear()
        again = (near[1:] == near[:-1]) & (far[1:] == far[:-1])
        if again.any():
            near, far = near[np.append(True, ~again)], far[np.append(True, ~again)]
        first = np.flatnonzero(np.diff(near, prepend=near[0] - 1))
        ids, at = near[first], np.append(first, len(near))
        del near, again
        every = np.sort(far)
        every = every[np.diff(every, prepend=every[0] - 1) > 0]
        members = np.searchsorted(every, far).astype(np.int32)
        del far
        found = list(_chosen(at, members, len(every)))
        chosen, covers = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array([graph] * len(found), names[0]), pa.array(np.arange(len(found))), pa.array(ids[chosen]), pa.array(covers)], ["graph_id", "step", "set_id", "covers"])

    names = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]]

    def run(batches):
        graph, sets, elements = None, [], []
        for batch in batches:
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            bound = np.flatnonzero(np.diff(keys.indices.to_numpy(), prepend=-1)).tolist()
            src, dst = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a, b in zip(bound, [*bound[1:], len(src)]):
                now = keys.dictionary[keys.indices[a].as_py()].as_py()
                if sets and now != graph:
                    yield cover(graph, sets, elements)
                    sets, elements = [], []
                graph = now
                sets.append(src[a:b].copy())
                elements.append(dst[a:b].copy())
        if sets:
            yield cover(graph, sets, elements)

    own = rows.where("src is not null and dst is not null").select("graph_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    dealt = own.repartition(tasks, "graph_id").sortWithinPartitions("graph_id", "src", "dst")
    return dealt.mapInArrow(run, f"graph_id {kind}, step long, set_id long, covers long")


def form(n: int, src, dst, weight, bias) -> tuple[np.ndarray, np.ndarray]:
    """Bias and couplings of sum b x + sum c x x over edges."""
    return np.asarray(bias, float), matrix(n, src, dst, weight)


def node_bias(ids) -> np.ndarray:
    """Fixed values of the registered queries: -3..3 by node id."""
    return (np.asarray(ids) % 7 - 3).astype(float)


def least_form(ids, src, dst, weight):
    """Least value of the quadratic form over all 0/1 assignments, for at most 18 nodes: n, energy."""
    n = len(ids)
    if n > 18:
        raise ValueError(f"{n} nodes are too many to try all assignments")
    b, c = form(n, src, dst, weight, node_bias(ids))
    best = 0.0
    for lo in range(0, 1 << n, 1 << 14):
        x = (np.arange(lo, min(lo + (1 << 14), 1 << n))[:, None] >> np.arange(n) & 1).astype(float)
        best = min(best, float((x @ b + ((x @ c) * x).sum(1) / 2).min()))
    yield n, best


def descended_form(ids, src, dst, weight):
    """The quadratic form by steepest single flips from all zeros: n, energy, flips."""
    n = len(ids)
    bias, flips = node_bias(ids), 0
    start, near, far, w = links(n, src, dst, weight)
    to = _lists(start, far, w)
    x, slope = [0] * n, bias.tolist()
    heap = [(g, k) for k, g in enumerate(slope) if g <= -1e-9]
    heapq.heapify(heap)
    while heap:
        gain, k = heapq.heappop(heap)
        if gain != (1 - 2 * x[k]) * slope[k]:
            continue
        way = 1 - 2 * x[k]
        x[k], flips = 1 - x[k], flips + 1
        for y, c in to[k]:
            slope[y] += way * c
        for y in (k, *(y for y, _ in to[k])):
            gain = (1 - 2 * x[y]) * slope[y]
            if gain <= -1e-9:
                heapq.heappush(heap, (gain, y))
    x = np.array(x, float)
    yield n, float(x @ bias + (w * x[near] * x[far]).sum() / 2), flips


def modularity(a: np.ndarray, side: np.ndarray) -> float:
    k = a.sum(1)
    two = k.sum()
    return float((side @ a @ side - (k @ side) ** 2 / two) / (2 * two)) if two else 0.0


def climbed_modularity(ids, src, dst, weight, restarts: int = 10, seed: int = 0):
    """Two communities by best single moves from seeded starts: n, q."""
    n, rng = len(ids), np.random.default_rng([seed, len(ids)])
    start, near, far, w = links(n, src, dst, weight)
    to, strength = _lists(start, far, w), np.bincount(near, w, minlength=n)
    two, best = float(strength.sum()), 0.0
    k = strength.tolist()
    for _ in range(restarts if two else 0):
        first = rng.choice([-1.0, 1.0], n)
        side, whole = first.tolist(), float(strength @ first)
        field = np.bincount(near, w * first[far], minlength=n).tolist()
        # a move's gain times ``two`` is -side field two + side k whole - k k: nodes of one side and strength wait in a heap by side times field
        heaps: dict[tuple[float, float], list[tuple[float, int]]] = {}
        for x in range(n):
            heaps.setdefault((side[x], k[x]), []).append((side[x] * field[x], x))
        for heap in heaps.values():
            heapq.heapify(heap)
        while True:
            most, x = 1e-9 * two, -1
            for (s, c), heap in heaps.items():
                while heap and (side[heap[0][1]] != s or s * field[heap[0][1]] != heap[0][0]):
                    heapq.heappop(heap)
                if heap:
                    gain = s * c * whole - c * c - heap[0][0] * two
                    if gain > most or gain == most and heap[0][1] < x:
                        most, x = gain, heap[0][1]
            if x < 0:
                break
            side[x] = -side[x]
            whole += 2 * side[x] * k[x]
            for y, c in to[x]:
                field[y] += 2 * side[x] * c
                heapq.heappush(heaps.setdefault((side[y], k[y]), []), (side[y] * field[y], y))
            heapq.heappush(heaps.setdefault((side[x], k[x]), []), (side[x] * field[x], x))
        last = np.array(side)
        best = max(best, float(((w * last[near] * last[far]).sum() - (strength @ last) ** 2 / two) / (2 * two)))
    yield n, best


def spectral_modularity(ids, src, dst, weight, most: int | None = 600):
    """Two communities by the sign of the modularity matrix's leading eigenvector: n, q (null beyond ``most`` nodes; None is any size).

    The eigenvector comes of ``leading`` at every size, without a dense table; its first entry that is not zero counts as positive.
    """
    n = len(ids)
    if most is not None and n > most:
        yield n, None
        return
    start, near, far, w = links(n, src, dst, weight)
    k = np.bincount(near, w, minlength=n)
    two = float(k.sum())
    if not two:
        yield n, 0.0
        return
    top = float(np.abs(k).max())

    def multiply(x: np.ndarray) -> np.ndarray:
        return (np.bincount(near, w * x[far], minlength=n) - k * ((k @ x) / two)) / top

    lead = leading(multiply, np.zeros((n, 0)), 1, np.diff(start) > 0, tolerance=1e-11)[:, 0]
    if lead @ multiply(lead) < 1e-9:  # the vector of ones leads, with eigenvalue 0, maybe among others: no division
        yield n, 0.0
        return
    clear = np.abs(lead) > 1e-9 * np.abs(lead).max()
    lead = np.where(clear, lead, 0.0) * np.sign(lead[np.argmax(clear)])
    side = np.where(lead >= 0, 1.0, -1.0)
    yield n, float(((w * side[near] * side[far]).sum() - (k @ side) ** 2 / two) / (2 * two))


def laplacian_coordinates(ids, src, dst, weight, k: int = 4, dense: int = 1500):
    """Node and the magnitudes of the ``k`` smallest non-trivial eigenvectors of the normalised Laplacian, zero-padded.

    Graphs of more than ``dense`` nodes are taken without a dense table. Eigenvectors of eigenvalue 0 are then known: a component's roots
    of degrees, here in order of the smallest node, the first being the trivial one; those that follow come of ``leading``.
    """
    n = len(ids)
    if n <= dense:
        a = (matrix(n, src, dst, np.ones(len(src))) > 0).astype(float)
        s = 1 / np.sqrt(np.maximum(a.sum(1), 1))
        vectors = np.abs(np.linalg.eigh(np.eye(n) - a * np.outer(s, s))[1][:, 1 : k + 1]) if n else np.zeros((0, 0))
    else:
        start, near, far, _ = links(n, src, dst, np.ones(len(src)))
        degree = np.diff(start)
        label = _labels(n, near, far)
        live = degree > 0
        roots = np.unique(label[live])
        null = np.zeros((n, min(len(roots), k + 1)))
        for i, r in enumerate(roots[: k + 1].tolist()):
            mine = live & (label == r)
            null[mine, i] = np.sqrt(degree[mine] / degree[mine].sum())
        vectors = null[:, 1:]
        if len(roots) <= k:
            s = 1 / np.sqrt(np.maximum(degree, 1))
            c = s[near] * s[far]
            more = leading(lambda x: np.bincount(near, c * x[far], minlength=n), null, k + 1 - len(roots), live)
            vectors = np.abs(np.hstack([vectors, more]) if len(roots) else more)
    for i, row in zip(ids, vectors, strict=True):
        yield int(i), [*map(float, row), *[0.0] * (k - len(row))]


def _labels(n: int, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The smallest node that each node is connected with: labels are lowered along links, then followed to their ends."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[near], label[far])
        new = label.copy()
        np.minimum.at(new, label[near], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def leading(multiply, known: np.ndarray, k: int, live: np.ndarray, most: int = 60, tolerance: float = 1e-8, restarts: int = 500) -> np.ndarray:
    """The ``k`` eigenvectors of the largest eigenvalues of a symmetric ``multiply`` beside those ``known``, by a Krylov space of at most ``most`` vectors that restarts from the best half of them."""
    n, rng = len(known), np.random.default_rng(0)
    k = min(k, int(live.sum()) - known.shape[1])
    if k <= 0:
        return np.zeros((n, 0))
    most = min(max(most, 4 * k), int(live.sum()) - known.shape[1])

    def clean(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - known @ (known.T @ x)
            x = x - basis @ (basis.T @ x)
        return x

    basis, image = np.zeros((n, most)), np.zeros((n, most))
    new, size = clean(rng.normal(size=n) * live, basis[:, :0]), 0
    for _ in range(restarts):
        while size < most:
            norm = np.linalg.norm(new)
            if norm < 1e-12:  # the space is closed: go on from elsewhere
                new = clean(rng.normal(size=n) * live, basis[:, :size])
                norm = np.linalg.norm(new)
            basis[:, size] = new / norm
            image[:, size] = multiply(basis[:, size])
            size += 1
            new = clean(image[:, size - 1], basis[:, :size])
        small = basis.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        turn, value = turn[:, ::-1], value[::-1]
        found = basis @ turn[:, :k]
        rest = image @ turn[:, :k] - found * value[:k]
        if np.linalg.norm(rest, axis=0).max() < tolerance or most == int(live.sum()) - known.shape[1]:
            return found
        keep = max(most // 2, k)
        basis[:, :keep], image[:, :keep] = basis @ turn[:, :keep], image @ turn[:, :keep]
        size = keep
        new = clean(new, basis[:, :size])
    raise RuntimeError(f"not settled after {restarts} restarts")


def largest_independent(near: list[set[int]], w: np.ndarray) -> tuple[float, set[int]]:
    """A heaviest independent set by branch and bound on the node of most live neighbours."""
    best: tuple[float, set[int]] = (0.0, set())
    stack = [(0.0, frozenset(), frozenset(range(len(near))))]
    while stack:
        value, held, live = stack.pop()
        free = {x for x in live if not near[x] & live}
        value, held, live = value + sum(w[x] for x in free), held | free, live - free
        if not live:
            if value > best[0]:
                best = (value, set(held))
            continue
        if value + sum(w[x] for x in live) <= best[0] + 1e-12:
            continue
        x = max(live, key=lambda k: (len(near[k] & live), w[k], -k))
        stack.append((value, held, live - {x}))
        stack.append((value + w[x], held | {x}, live - near[x] - {x}))
    return best


def exact_sets(ids, src, dst, weight, most: int = 40):
    """Sizes of a largest independent set and a least vertex cover, and the heaviest set by degree + 1; null beyond ``most`` nodes."""
    n, near = len(ids), neighbours(len(ids), src, dst)
    if n > most:
        yield n, None, None, None
        return
    size = round(largest_independent(near, np.ones(n))[0])
    yield n, size, n - size, float(largest_independent(near, _weights(near, "degree"))[0])
