"""Message-passing encoders of a graph's nodes, by name, in numpy per graph.

A layer gathers along edges, transforms, reduces by target and updates. Weights come from ``Weights``: drawn
from a seed by name and shape, or given as a dict of arrays (a trained model). ``encode`` runs an encoder over
batches of graphs; parameter-free propagation of one large graph is in ``graph`` as joins.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIVATIONS: dict[str, Callable] = {
    "relu": lambda x: np.maximum(x, 0),
    "elu": lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))),
    "gelu": lambda x: 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3))),
    "leaky_relu": lambda x: np.where(x > 0, x, 0.2 * x),
    "tanh": np.tanh,
    "identity": lambda x: x,
    "silu": lambda x: x * sigmoid(x),
    "sigmoid": lambda x: sigmoid(x),
}
relu, leaky = ACTIVATIONS["relu"], ACTIVATIONS["leaky_relu"]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def normalised(x, kind: str = "l2"):
    if kind == "l2":
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    if kind == "layer":
        return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)
    if kind == "batch":
        return (x - x.mean(0)) / np.sqrt(x.var(0) + 1e-5) if len(x) else x
    return x


class Weights:
    """Matrices by name: those of ``given``, else drawn from the seed, the name and the shape."""

    def __init__(self, seed: int = 0, given: dict[str, np.ndarray] | None = None):
        self.seed, self.given, self.known = seed, given or {}, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        if name in self.given:
            return np.asarray(self.given[name], float).reshape(shape)
        if name not in self.known:
            rng = np.random.default_rng([self.seed, zlib.crc32(name.encode()), *shape])
            self.known[name] = rng.normal(size=shape) / np.sqrt(shape[0] if len(shape) > 1 else 1 + shape[0])
        return self.known[name]


#: Edges whose messages are held at a time.
AT_ONCE = 1 << 15


@dataclass
class Graph:
    """Both directions of every edge; weights and kinds of edges, kinds of nodes, and incidence of hyperedges."""

    n: int
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray
    kind: np.ndarray
    node_kind: np.ndarray
    member: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    hyperedge: np.ndarray = field(default_factory=lambda: np.zeros(0, int))

    def total(self, rows, at=None, size=None):
        out = np.zeros((self.n if size is None else size, *rows.shape[1:]))
        np.add.at(out, self.dst if at is None else at, rows)
        return out

    def sent(self, h, factor=None, src=None, at=None, size=None):
        """``total`` of ``h`` at the sources, times a factor of each edge if given; some edges at a time, so that no table has edges times width."""
        src, at = self.src if src is None else src, self.dst if at is None else at
        out = np.zeros((self.n if size is None else size, *h.shape[1:]))
        for lo in range(0, len(src), AT_ONCE):
            on = slice(lo, lo + AT_ONCE)
            np.add.at(out, at[on], h[src[on]] if factor is None else h[src[on]] * factor[on])
        return out

    def most(self, rows):
        out = np.full((self.n, *rows.shape[1:]), -np.inf)
        np.maximum.at(out, self.dst, rows)
        return np.where(np.isfinite(out), out, 0.0)

    @property
    def degree(self):
        return np.bincount(self.dst, minlength=self.n).astype(float)

    def mean(self, rows):
        return self.total(rows) / np.maximum(self.degree, 1)[:, None]

    def smooth(self, h):
        """The symmetric normalised adjacency with self loops, times ``h``."""
        c = 1 / np.sqrt(self.degree + 1)
        return self.sent(h, (c[self.src] * c[self.dst])[:, None]) + h * (c * c)[:, None]

    def share(self, score, at=None, size=None):
        """Softmax of edge scores over the edges of one target."""
        at, size = self.dst if at is None else at, self.n if size is None else size
        top = np.full((size, *score.shape[1:]), -np.inf)
        np.maximum.at(top, at, score)
        e = np.exp(score - top[at])
        return e / (self.total(e, at, size)[at] + 1e-16)

    def of_kind(self, k: int) -> Graph:
        on = self.kind == k
        return Graph(self.n, self.src[on], self.dst[on], self.weight[on], self.kind[on], self.node_kind)


ENCODERS: dict[str, Callable[[Graph, np.ndarray, Weights, int, int], np.ndarray]] = {}


def encoder(*names: str, start: bool = True):
    """Registers ``step(graph, h, weights, width, layer, first)`` as layers over a dense start, or a whole encoder."""

    def put(f):
        def run(g: Graph, x: np.ndarray, w: Weights, width: int = 16, layers: int = 3) -> np.ndarray:
            if not start:
                return f(g, x, w, width, layers)
            h = first = relu(x @ w("in", x.shape[1], width))
            for k in range(layers):
                h = normalised(f(g, h, w, width, k, first))
            return h

        run.__doc__ = f.__doc__
        ENCODERS.update(dict.fromkeys(names, run))
        return run

    return put


def mlp(x, w: Weights, name: str, *widths: int, act: str = "relu"):
    for k, width in enumerate(widths):
        x = x @ w(f"{name}.{k}", x.shape[-1], width)
        x = ACTIVATIONS[act](x) if k + 1 < len(widths) else x
    return x


@encoder("gcn")
def gcn(g, h, w, d, k, first):
    return relu(g.smooth(h) @ w(f"gcn{k}", d, d)) + h


@encoder("graphsage", "sage")
def sage(g, h, w, d, k, first):
    return relu(np.concatenate([h, g.mean(h[g.src])], 1) @ w(f"sage{k}", 2 * d, d))


@encoder("gin")
def gin(g, h, w, d, k, first):
    return mlp(h + g.total(h[g.src]), w, f"gin{k}", d, d)


@encoder("gine")
def gine(g, h, w, d, k, first):
    return mlp(h + g.total(relu(h[g.src] + g.weight[:, None] * w(f"e{k}", 1, d))), w, f"gine{k}", d, d)


def _heads(x, heads):
    return x.reshape(len(x), heads, x.shape[1] // heads)


@encoder("gat")
def gat(g, h, w, d, k, first, heads: int = 4):
    """Attention by a sum of a source and a target term."""
    z = _heads(h @ w(f"gat{k}", d, d), heads)
    score = (z * w(f"a{k}", heads, d // heads)).sum(2)[g.src] + (z * w(f"b{k}", heads, d // heads)).sum(2)[g.dst]
    return ACTIVATIONS["elu"](g.sent(z, g.share(leaky(score))[:, :, None]).reshape(g.n, d)) + h


@encoder("gatv2")
def gatv2(g, h, w, d, k, first, heads: int = 4):
    """Attention after the non-linearity, so that the ranking depends on the target."""
    s, t = _heads(h @ w(f"s{k}", d, d), heads), _heads(h @ w(f"t{k}", d, d), heads)
    score = (leaky(s[g.src] + t[g.dst]) * w(f"a{k}", heads, d // heads)).sum(2)
    return ACTIVATIONS["elu"](g.sent(s, g.share(score)[:, :, None]).reshape(g.n, d)) + h


@encoder("s2v", "dirac_s2v", start=False)
def s2v(g, x, w, d, layers):
    """Node and edge states in turn, weights tied over rounds."""
    h, e = normalised(relu(x @ w("in", x.shape[1], d))), normalised(relu(g.weight[:, None] * w("edge", 1, d)))
    for _ in range(layers):
        e = normalised(relu(h[g.src] @ w("ne", d, d) + e @ w("ee", d, d)))
        h = normalised(relu(g.total(e) @ w("en", d, d) + h @ w("nn", d, d)))
    return h


@encoder("gatedgcn")
def gatedgcn(g, h, w, d, k, first):
    gate = sigmoid(h[g.src] @ w(f"d{k}", d, d) + h[g.dst] @ w(f"e{k}", d, d) + g.weight[:, None] * w(f"c{k}", 1, d))
    return relu(h @ w(f"a{k}", d, d) + g.total(gate * (h @ w(f"b{k}", d, d))[g.src]) / (g.total(gate) + 1e-6)) + h


@encoder("pna")
def pna(g, h, w, d, k, first, delta: float = 1.0):
    m, sq = g.mean(h[g.src]), g.mean(h[g.src] ** 2)
    stats = np.concatenate([m, g.most(h[g.src]), -g.most(-h[g.src]), np.sqrt(np.maximum(sq - m * m, 0) + 1e-5)], 1)
    scale = (np.log(g.degree + 1) / delta)[:, None]
    return relu(np.concatenate([h, stats, stats * scale, stats / np.maximum(scale, 1e-6) * (scale > 0)], 1) @ w(f"pna{k}", 13 * d, d)) + h


def gru(h, m, w, name, d):
    z, r = sigmoid(m @ w(name + "z", d, d) + h @ w(name + "y", d, d)), sigmoid(m @ w(name + "r", d, d) + h @ w(name + "q", d, d))
    return (1 - z) * h + z * np.tanh(m @ w(name + "n", d, d) + (r * h) @ w(name + "m", d, d))


@encoder("mpnn")
def mpnn(g, h, w, d, k, first):
    return gru(h, g.total(mlp(np.concatenate([h[g.src], h[g.dst], g.weight[:, None]], 1), w, f"msg{k}", d, d)), w, f"gru{k}", d)


@encoder("nnconv")
def nnconv(g, h, w, d, k, first):
    """A matrix per edge, from its weight."""
    bend = relu(g.weight[:, None] * w(f"f{k}", 1, 4))
    return relu(h @ w(f"root{k}", d, d) + g.mean(np.einsum("ei,ek,kij->ej", h[g.src], bend, w(f"m{k}", 4, d, d))))


def attend(g, h, w, d, name, heads=4, bias=0.0):
    q, key, v = (_heads(h @ w(name + c, d, d), heads) for c in "qkv")
    score = (q[g.dst] * key[g.src]).sum(2) / np.sqrt(d // heads) + bias
    return g.total(g.share(score)[:, :, None] * v[g.src]).reshape(g.n, d) @ w(name + "o", d, d)


@encoder("graph_transformer", "transformer", start=False)
def graph_transformer(g, x, w, d, layers, most_degree: int = 64):
    h = x @ w("in", x.shape[1], d) + w("degree", most_degree + 1, d)[np.minimum(g.degree, most_degree).astype(int)]
    for k in range(layers):
        h = h + attend(g, normalised(h, "layer"), w, d, f"t{k}", bias=g.weight[:, None] * w(f"b{k}", 1, 4))
        h = h + mlp(normalised(h, "layer"), w, f"ffn{k}", 2 * d, d)
    return h


@encoder("edgeconv")
def edgeconv(g, h, w, d, k, first):
    return g.most(mlp(np.concatenate([h[g.dst], h[g.src] - h[g.dst]], 1), w, f"ec{k}", d, d)) + h


@encoder("gcnii")
def gcnii(g, h, w, d, k, first, alpha: float = 0.1, lam: float = 0.5):
    s, beta = (1 - alpha) * g.smooth(h) + alpha * first, np.log(lam / (k + 1) + 1)
    return relu((1 - beta) * s + beta * s @ w(f"g{k}", d, d))


@encoder("appnp", start=False)
def appnp(g, x, w, d, layers, alpha: float = 0.1):
    h = first = relu(x @ w("in", x.shape[1], d))
    for _ in range(layers):
        h = (1 - alpha) * g.smooth(h) + alpha * first
    return h


@encoder("sgc", start=False)
def sgc(g, x, w, d, layers):
    for _ in range(layers):
        x = g.smooth(x)
    return x @ w("in", x.shape[1], d)


@encoder("chebnet")
def chebnet(g, h, w, d, k, first, order: int = 3):
    """Chebyshev terms of minus the normalised adjacency."""
    terms = [h, -g.smooth(h)]
    while len(terms) < order:
        terms.append(-2 * g.smooth(terms[-1]) - terms[-2])
    return relu(sum(t @ w(f"c{k}.{j}", d, d) for j, t in enumerate(terms[:order])))


@encoder("arma")
def arma(g, h, w, d, k, first, stacks: int = 2):
    return sum(relu(g.smooth(h) @ w(f"w{k}.{j}", d, d) + first @ w(f"v{k}.{j}", d, d)) for j in range(stacks)) / stacks


@encoder("tagcn")
def tagcn(g, h, w, d, k, first, order: int = 2):
    out, t = h @ w(f"t{k}.0", d, d), h
    for j in range(order):
        t = g.smooth(t)
        out = out + t @ w(f"t{k}.{j + 1}", d, d)
    return relu(out)


def kinds(values) -> list[int]:
    return np.unique(values).astype(int).tolist()


@encoder("rgcn")
def rgcn(g, h, w, d, k, first, bases: int = 4):
    """Matrices of edge kinds as mixtures of shared ones; each kind's messages averaged."""
    out = h @ w(f"self{k}", d, d)
    for r in kinds(g.kind):
        of = g.of_kind(r)
        out = out + of.mean(h[of.src]) @ np.tensordot(w(f"mix{k}.{r}", bases), w(f"base{k}", bases, d, d), 1)
    return relu(out)


@encoder("hgt")
def hgt(g, h, w, d, k, first):
    """Attention with projections by node kind and a prior by edge kind."""
    typed = np.zeros_like(h)
    for t in kinds(g.node_kind):
        typed[g.node_kind == t] = h[g.node_kind == t] @ w(f"n{k}.{t}", d, d)
    prior = np.zeros((len(g.kind), 4))
    for r in kinds(g.kind):
        prior[g.kind == r] = w(f"p{k}.{r}", 4)
    return ACTIVATIONS["gelu"](attend(g, typed, w, d, f"h{k}", bias=prior)) + h


def fused(parts, w, name, d):
    """Parts weighed by a softmax of one score each."""
    score = np.array([np.tanh(p @ w(name + "f", d, d)).mean(0) @ w(name + "g", d) if len(p) else 0.0 for p in parts])
    a = np.exp(score - score.max())
    return sum(x * p for x, p in zip(a / a.sum(), parts, strict=True))


@encoder("han")
def han(g, h, w, d, k, first):
    parts = []
    for r in kinds(g.kind):
        of, loop = g.of_kind(r), np.arange(g.n)
        of = Graph(g.n, np.r_[of.src, loop], np.r_[of.dst, loop], np.r_[of.weight, np.ones(g.n)], np.r_[of.kind, np.full(g.n, r)], g.node_kind)
        parts.append(gat_step(of, h, w, d, f"{k}.{r}"))
    return fused(parts, w, f"han{k}", d) if parts else h


def gat_step(g, h, w, d, name):
    z = h @ w("gat" + name, d, d)
    score = leaky((z @ w("a" + name, d))[g.src] + (z @ w("b" + name, d))[g.dst])
    return ACTIVATIONS["elu"](g.total(g.share(score)[:, None] * z[g.src]))


@encoder("typed_mpnn")
def typed_mpnn(g, h, w, d, k, first):
    got = np.zeros_like(h)
    for r in kinds(g.kind):
        of = g.of_kind(r)
        got += of.mean(h[of.src] @ w(f"m{k}.{r}", d, d))
    out = np.zeros_like(h)
    for t in kinds(g.node_kind):
        on = g.node_kind == t
        out[on] = relu(np.concatenate([h[on], got[on]], 1) @ w(f"u{k}.{t}", 2 * d, d))
    return out


@encoder("multiplex_gcn")
def multiplex_gcn(g, h, w, d, k, first):
    parts = [relu(g.of_kind(r).smooth(h) @ w(f"l{k}.{r}", d, d)) for r in kinds(g.kind)]
    return fused(parts, w, f"mux{k}", d) if parts else h


def _hyper(g):
    m = int(g.hyperedge.max(initial=-1)) + 1
    return m, np.maximum(np.bincount(g.hyperedge, minlength=m), 1), np.maximum(np.bincount(g.member, minlength=g.n), 1)


@encoder("hgnn", "hypergraph_conv")
def hgnn(g, h, w, d, k, first):
    """Means over hyperedges, then sums at nodes over the root of their number; plain convolution without incidence."""
    z = h @ w(f"h{k}", d, d)
    if not len(g.member):
        return relu(g.smooth(z))
    m, size, at = _hyper(g)
    f = g.sent(z, None, g.member, g.hyperedge, m) / size[:, None]
    return relu(g.sent(f, None, g.hyperedge, g.member) / np.sqrt(at)[:, None])


@encoder("hypergcn")
def hypergcn(g, h, w, d, k, first):
    """Each hyperedge becomes its two most distant members by a projection, tied to all others (mediators)."""
    if not len(g.member):
        return relu(g.smooth(h @ w(f"y{k}", d, d)))
    along, src, dst, weight = h @ w(f"p{k}", d), [], [], []
    order = np.lexsort((g.member, g.hyperedge))
    for at in np.split(order, np.nonzero(np.diff(g.hyperedge[order]))[0] + 1):
        v = g.member[at]
        if len(v) < 2:
            continue
        far, near = max(v, key=lambda x: (along[x], x)), min(v, key=lambda x: (along[x], -x))
        if far == near:
            continue
        links = [(far, near), *[(e, x) for x in v for e in (far, near) if x not in (far, near)]]
        for a, b in links:
            src += [a, b]
            dst += [b, a]
        weight += [1 / (2 * len(v) - 3)] * (2 * len(links))
    src, dst, weight = np.array(src, int), np.array(dst, int), np.array(weight)
    c = 1 / np.sqrt(np.bincount(dst, weight, minlength=g.n) + 1)
    out = h * (c * c)[:, None] + g.total(h[src] * (weight * c[src] * c[dst])[:, None], dst)
    return relu(out @ w(f"y{k}", d, d))


@encoder("hnhn")
def hnhn(g, h, w, d, k, first, alpha: float = -0.5, beta: float = -0.5):
    """Averages at hyperedges weighed by node degree, then at nodes weighed by hyperedge size."""
    if not len(g.member):
        return relu(g.smooth(h @ w(f"n{k}", d, d)))
    m, size, at = _hyper(g)
    a, b = (at**alpha)[g.member], (size**beta)[g.hyperedge]
    f = relu(g.total(h[g.member] * a[:, None], g.hyperedge, m) / np.maximum(np.bincount(g.hyperedge, a, minlength=m), 1e-12)[:, None] @ w(f"e{k}", d, d))
    return relu(g.total(f[g.hyperedge] * b[:, None], g.member) / np.maximum(np.bincount(g.member, b, minlength=g.n), 1e-12)[:, None] @ w(f"n{k}", d, d))


@encoder("mind", start=False)
def mind(g, x, w, d, layers):
    """Gated means, a node linked to all, and all layers kept."""
    h, kept = relu(x @ w("in", x.shape[1], d)), []
    for k in range(layers):
        gate = sigmoid((h @ w(f"s{k}", d, 1))[g.src] + (h @ w(f"t{k}", d, 1))[g.dst])
        near = g.total(gate * h[g.src]) / (g.total(gate) + 1e-6)
        every = h.mean(0, keepdims=True) if len(h) else np.zeros((1, d))
        h = normalised(relu(h @ w(f"h{k}", d, d) + near @ w(f"n{k}", d, d) + every @ w(f"o{k}", d, d)))
        kept.append(h)
    return np.concatenate(kept, 1) @ w("jump", layers * d, d)


@encoder("vns", "vital_node_searcher", start=False)
def vns(g, x, w, d, layers):
    """Rounds of node states, read by a recurrent cell."""
    h, state = normalised(relu(x @ w("in", x.shape[1], d))), np.zeros((g.n, d))
    for _ in range(layers):
        h = normalised(relu(g.total(h[g.src]) @ w("near", d, d) + x @ w("own", x.shape[1], d)))
        state = gru(state, h, w, "cell", d)
    return state


@encoder("pe", "pe_wrapper", start=False)
def pe(g, x, w, d, layers, inner: str = "gcn"):
    """Structural features beside ``x``, then another encoder."""
    deg = g.degree
    near = g.mean(deg[g.src][:, None])[:, 0], g.most(deg[g.src][:, None])[:, 0], g.total(deg[g.src][:, None])[:, 0]
    return ENCODERS[inner](g, np.c_[x, np.log1p(deg), *map(np.log1p, near)], w, d, layers)


@encoder("sentinel_encoder", "dynamics_transformer", start=False)
def sentinel_encoder(g, x, w, d, layers):
    """``x`` as a series of each node: attention over its steps, pooled, then mean aggregation over the graph."""
    t = x.shape[1]
    z = x[:, :, None] * w("value", 1, d) + w("step", t, d)
    for k in range(2):
        a = np.einsum("ntd,nsd->nts", z @ w(f"q{k}", d, d), z @ w(f"k{k}", d, d)) / np.sqrt(d)
        a = np.exp(a - a.max(2, keepdims=True)) if t else a
        z = normalised(z + (a / a.sum(2, keepdims=True)) @ (z @ w(f"v{k}", d, d)), "layer")
    return ENCODERS["graphsage"](g, z.mean(1), w, d, layers)


def encode(nodes: DataFrame, edges: DataFrame, kind: str, width: int = 16, layers: int = 3, seed: int = 0, given: dict | None = None, incidence: DataFrame | None = None) -> DataFrame:
    """graph_id, node_id, h: nodes have ``x`` (array of doubles) and may have ``kind``; edges have weight and may have ``kind``.

    ``incidence`` (graph_id, node_id, o) is read by the encoders of hypergraphs. One graph is one task.
    """
    if kind not in ENCODERS:
        raise ValueError(f"no encoder {kind}: {', '.join(sorted(ENCODERS))}")
    kind_of = lambda t: F.col("kind").cast("long") if "kind" in t.columns else F.lit(0).cast("long")
    own = nodes.select(F.col("graph_id").alias("graph_id"), F.col("node_id").cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0.0).alias("weight"), kind_of(nodes).alias("kind"), F.col("x").alias("x"))
    none = F.lit(None).cast("array<double>").alias("x")
    links = edges.select("graph_id", F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.col("weight").cast("double").alias("weight"), kind_of(edges).alias("kind"), none)
    rows = own.unionByName(links)
    if incidence is not None:
        rows = rows.unionByName(incidence.select("graph_id", F.col("node_id").cast("long").alias("a"), F.lit(-2).cast("long").alias("b"), F.lit(0.0).alias("weight"), F.col("o").cast("long").alias("kind"), none))

    def run(key, t: pd.DataFrame) -> pd.DataFrame:
        mine, inc = t[t.b == -1].sort_values("a"), t[t.b == -2]
        e = t[t.b >= 0].sort_values(["a", "b", "kind"])
        ids = mine.a.to_numpy()
        if not len(ids):
            return pd.DataFrame({"graph_id": [], "node_id": [], "h": []})
        a, b = np.searchsorted(ids, e.a.to_numpy()), np.searchsorted(ids, e.b.to_numpy())
        twice = lambda v: np.concatenate([v, v])
        g = Graph(len(ids), np.r_[a, b], np.r_[b, a], twice(e.weight.to_numpy()), twice(e.kind.to_numpy()), mine.kind.to_numpy(), np.searchsorted(ids, inc.a.to_numpy()), np.unique(inc.kind.to_numpy(), return_inverse=True)[1])
        h = ENCODERS[kind](g, np.array(mine.x.tolist(), float).reshape(len(ids), -1), Weights(seed, given), width, layers)
        return pd.DataFrame({"graph_id": key[0], "node_id": ids, "h": list(h)})

    return rows.groupBy("graph_id").applyInPandas(run, f"graph_id {dict(nodes.dtypes)['graph_id']}, node_id long, h array<double>")
