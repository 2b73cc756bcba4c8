"""Breadth-first searches of one graph from many nodes at once, 64 a word. Graphs come as sorted links: where a node's begin and their far ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def sorted_links(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both directions of every link, once; loops left out."""
    off = src != dst
    a, b = src[off], dst[off]
    key = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.searchsorted(key, np.arange(n + 1) * n), key % max(n, 1)


def levels(start: np.ndarray, far: np.ndarray, sources: np.ndarray, at: np.ndarray | None = None, words: int = 0) -> Iterator[np.ndarray]:
    """By depth from 1 on, the searches that reach each node first at that depth: bit ``at[i]`` of a node's ``words``, bit i unless given, is the search from ``sources[i]``."""
    n, some, at = len(start) - 1, np.flatnonzero(np.diff(start)), np.arange(len(sources)) if at is None else at
    front = np.zeros((n, words or -(-len(sources) // 64)), np.uint64)
    front[sources, at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
    todo = ~front
    while len(some):
        new = np.zeros_like(front)
        new[some] = np.bitwise_or.reduceat(front[far], start[some], axis=0)
        new &= todo
        if not new.any():
            return
        yield new
        todo &= ~new
        front = new


def all_distance_sums(start: np.ndarray, far: np.ndarray, words: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of every node the number of nodes that it reaches, itself left out, and the sum of distances to them. Searches of different pieces never meet, so one of each shares a bit, and a graph takes as many passes as its largest piece has nodes."""
    n = len(start) - 1
    reached, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    near = np.repeat(np.arange(n), np.diff(start))
    label = _pieces(n, near, far)
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.diff(label[order], prepend=-1))
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n) - np.repeat(first, size)
    many = np.zeros(n, np.int64)
    many[order] = np.repeat(size, size)
    for lo in range(0, int(size.max(initial=0)), 64 * words):
        mine = np.flatnonzero(many > max(lo, 1))  # nodes of pieces that still have searches
        if not len(mine):
            break
        place = np.zeros(n, np.int64)
        place[mine] = np.arange(len(mine))
        on = many[near] > lo
        begin = np.searchsorted(place[near[on]], np.arange(len(mine) + 1))
        own = np.flatnonzero((rank[mine] >= lo) & (rank[mine] < lo + 64 * words))
        for depth, new in enumerate(levels(begin, place[far[on]], own, rank[mine[own]] - lo, words), 1):
            found = np.bitwise_count(new).sum(1, dtype=np.int64)  # a node is as far from a source as the source from it
            reached[mine] += found
            total[mine] += depth * found
    return reached, total


def _pieces(n: int, near: np.ndarray, far: np.ndarray) -> np.ndarray:
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


def distance_sums(start: np.ndarray, far: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Of every source the sum of distances to the nodes that it reaches."""
    total = np.zeros(len(sources), np.int64)
    for depth, new in enumerate(levels(start, far, sources), 1):
        bits = np.unpackbits(new.view(np.uint8), axis=1, bitorder="little", count=len(sources))
        total += depth * bits.sum(0, dtype=np.int64)
    return total


def dependencies(start: np.ndarray, far: np.ndarray, sources: np.ndarray, at_once: int = 1 << 21, weight: np.ndarray | None = None) -> np.ndarray:
    """Of every node the sum over ``sources`` of the shares of their shortest paths that pass it, ends left out (Brandes); a node of ``weight`` stands for as many ends. Tables hold about ``at_once`` links of searches side by side."""
    n = len(start) - 1
    total, weight = np.zeros(n), np.ones(n) if weight is None else weight
    side = max(1, at_once // max(n, len(far)))
    for lo in range(0, len(sources), side):
        total += _passed(start, far, sources[lo : lo + side], weight)
    return total


def by_piece(start: np.ndarray, far: np.ndarray, sources: np.ndarray, group: int = 1000, at_once: int = 1 << 17) -> np.ndarray:
    """``dependencies``, pieces by themselves, small ones up to ``group`` nodes together, so that tables are as long as a piece and not as the graph."""
    n = len(start) - 1
    label = _pieces(n, np.repeat(np.arange(n), np.diff(start)), far)
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.diff(label[order], prepend=-1))
    size = np.diff(np.append(first, n))
    of = np.empty(n, np.int64)  # groups, each of whole pieces
    of[order] = np.repeat(np.cumsum(size) // group, size)
    order = np.argsort(of, kind="stable")
    place, many = np.empty(n, np.int64), np.diff(start)[order]
    place[order] = np.arange(n)
    bound = np.append(0, np.cumsum(many))
    link = np.repeat(start[order] - bound[:-1], many) + np.arange(len(far))
    to, mine, total = place[far[link]], np.sort(place[sources]), np.zeros(n)
    cut = np.append(np.flatnonzero(np.diff(of[order], prepend=-1)), n)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = mine[slice(*np.searchsorted(mine, [lo, hi]))] - lo
        links = to[bound[lo] : bound[hi]] - lo
        side = 1 << 21 if hi - lo > 20_000 else at_once
        total[order[lo:hi]] = dependencies(bound[lo : hi + 1] - bound[lo], links, own, side)
    return total


def _passed(start: np.ndarray, far: np.ndarray, sources: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``dependencies`` of searches side by side: node x of search i is i * n + x. Levels forward with their links, then back."""
    n, degree = len(start) - 1, np.diff(start)
    seen, place = np.zeros(n * len(sources), bool), np.empty(n * len(sources), np.int64)
    front, paths, found = np.arange(len(sources)) * n + sources, np.ones(len(sources)), []
    while True:
        seen[front] = True
        x = front % n
        many = degree[x]
        tail = np.repeat(np.arange(len(front)), many)
        at = np.arange(len(tail)) + (start[x] - np.cumsum(many) + many)[tail]
        to = far[at] + (front - x)[tail]
        new = np.flatnonzero(~seen[to])
        if not len(new):
            break
        tail, to = tail[new], to[new]
        place[to] = np.arange(len(to))
        first = to[place[to] == np.arange(len(to))]
        place[first] = np.arange(len(first))
        head = place[to]
        found.append((front, paths, tail, head))
        front, paths = first, np.bincount(head, paths[tail], minlength=len(first))
    total, share = np.zeros(n), np.zeros(len(front))
    for before, ways, tail, head in reversed(found):
        total += np.bincount(front % n, share * weight[sources[front // n]], minlength=n)
        share = ways * np.bincount(tail, ((weight[front % n] + share) / paths)[head], minlength=len(before))
        front, paths = before, ways
    return total
