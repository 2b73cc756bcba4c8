"""Readouts of node states: scores, advantages, distributions, values; numpy over one graph's nodes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from weftline.operators.encoders import Weights, mlp, normalised, relu

HEADS: dict[str, Callable] = {}


def head(*names: str):
    def put(f):
        HEADS.update(dict.fromkeys(names, f))
        return f

    return put


def with_graph(h, pool: str = "sum", aux=()):
    """Node states beside the pooled graph state and ``aux``."""
    whole = {"sum": h.sum(0), "mean": h.mean(0) if len(h) else h.sum(0), "max": h.max(0, initial=0.0)}[pool]
    return np.concatenate([h, np.tile(np.r_[whole, list(aux)], (len(h), 1))], 1)


def scores(h, w: Weights, name: str, out: int = 1, pool: str = "sum", aux=()):
    return mlp(with_graph(h, pool, aux), w, name, h.shape[1], out)


def log_soft(x):
    x = x - x.max(-1, keepdims=True, initial=-np.inf)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


@head("q_node", "actor")
def q_node(h, w, legal=None, aux=()):
    return scores(h, w, "q", aux=aux)[:, 0]


@head("dueling_q")
def dueling_q(h, w, legal=None, aux=()):
    """Value plus advantage less the mean advantage of legal nodes."""
    legal = np.ones(len(h), bool) if legal is None else legal
    a = scores(h, w, "adv", aux=aux)[:, 0]
    return critic(h, w, pool="sum", aux=aux) + a - (a[legal].mean() if legal.any() else 0.0)


@head("distributional_q")
def distributional_q(h, w, legal=None, aux=(), atoms: int = 51):
    """Log probabilities of the atoms."""
    return log_soft(scores(h, w, "c51", atoms, aux=aux))


@head("quantile_q")
def quantile_q(h, w, legal=None, aux=(), quantiles: int = 51):
    return scores(h, w, "qr", quantiles, aux=aux)


@head("q_label")
def q_label(h, w, legal=None, aux=(), labels: int = 3):
    return scores(h, w, "label", labels, aux=aux)


@head("critic")
def critic(h, w, legal=None, aux=(), pool: str = "mean"):
    """One value of the graph."""
    whole = with_graph(np.vstack([h, np.zeros((1, h.shape[1]))]), pool)[0, h.shape[1] :] if not len(h) else with_graph(h, pool, aux)[0, h.shape[1] :]
    return float(mlp(np.r_[whole][None], w, "value", h.shape[1], 1)[0, 0])


@head("noisy_q")
def noisy_q(h, w, legal=None, aux=(), spread: float = 0.5, seed: int = 0):
    """Scores by layers with factorised Gaussian noise on their weights, drawn from the seed."""
    rng, x = np.random.default_rng(seed), with_graph(h, aux=aux)
    squash = lambda v: np.sign(v) * np.sqrt(np.abs(v))
    for k, out in enumerate((h.shape[1], 1)):
        a, b = squash(rng.normal(size=x.shape[1])), squash(rng.normal(size=out))
        x = x @ (w(f"mu{k}", x.shape[1], out) + spread / np.sqrt(x.shape[1]) * np.outer(a, b)) + spread / np.sqrt(x.shape[1]) * b
        x = relu(x) if k == 0 else x
    return x[:, 0]


@head("implicit_quantile", "iqn")
def implicit_quantile(h, w, legal=None, aux=(), tau=(0.25, 0.5, 0.75), cosines: int = 64):
    """Quantile values at ``tau``, by a cosine embedding of each."""
    x = with_graph(h, aux=aux)
    bend = relu(np.cos(np.pi * np.outer(tau, np.arange(cosines))) @ w("cos", cosines, x.shape[1]))
    return np.stack([mlp(x * b, w, "iqn", h.shape[1], 1)[:, 0] for b in bend], 1)


@head("crossed_q")
def crossed_q(h, w, legal=None, aux=(0, 0, 0, 1)):
    """Node and graph states multiplied through one vector, then scored beside ``aux``."""
    legal = np.ones(len(h), bool) if legal is None else legal
    whole = normalised(h[legal].sum(0)[None])[0]
    x = h * (whole @ w("cross", h.shape[1]))
    hidden = relu(x @ w("f0", h.shape[1], h.shape[1]))
    return np.concatenate([hidden, np.tile(np.asarray(aux, float), (len(h), 1))], 1) @ w("f1", h.shape[1] + len(aux), 1)[:, 0]


def recon_loss(h, src, dst) -> float:
    """Mean squared distance of linked nodes."""
    return float(((h[src] - h[dst]) ** 2).sum() / max(len(src), 1))
