"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the whole text in numpy. The trees are fitted on the
driver from at most ``sample_rows`` labelled rows (those with the smallest hash
of the id, so the sample doesn't depend on partitions), flattened into arrays of
complete binary trees, broadcast (a few hundred kB whatever the input) and
traversed for all rows of a batch at once.

Defined results: null and empty texts have all-zero statistics and get a score
like any other; null ids are scored, never learnt from; labels that are null or
without a document are ignored; repeated rows are scored alike. Without labels of
both kinds every score is the share of label 1, or 0.5 without any label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textkit as tk

U64 = np.uint64

#: Kinds of bytes, each with the characters it holds; what none holds is "other".
KINDS = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "space": " \t\x0b\x0c\r",
    "line": "\n",
    "stop": ".",
    "comma": ",;:",
    "shout": "!?",
    "bar": "|",
    "mark": "#$%&*",
    "quote": "\"'()[]{}<>",
    "join": "-_/\\=+@~^`",
}
_KIND = np.full(256, len(KINDS), np.uint8)
for _k, _chars in enumerate(KINDS.values()):
    _KIND[np.frombuffer(_chars.encode(), np.uint8)] = _k
_KIND[0x80:] = len(KINDS) + 1
NAMES = [*(f"share_{k}" for k in KINDS), "share_other", "share_wide", "log_bytes", "log_words", "word_mean", "word_sd", "word_max", "short_words", "distinct_words", "distinct_pairs", "distinct_fives", "top_word", "log_lines", "line_mean", "distinct_lines", "odd_words", "capital_words"]


def _share_distinct(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = np.diff(at)
    _, to = tk.distinct(values, at)
    return np.diff(to) / np.maximum(n, 1)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows x NAMES of one chunk."""
    rows = len(at) - 1
    size = np.diff(at)
    kinds = len(KINDS) + 2
    row = np.repeat(np.arange(rows), size)
    kind = _KIND[data]
    share = np.bincount(row * kinds + kind, minlength=rows * kinds).reshape(rows, kinds) / np.maximum(size, 1)[:, None]
    words = tk.Words(data, at, tk.SPACED)
    n = words.counts
    some = np.maximum(n, 1)
    length = (words.ends - words.starts).astype(np.float64)
    wrow = np.repeat(np.arange(rows), n)
    total = np.bincount(wrow, length, rows)
    mean = total / some
    sd = np.sqrt(np.maximum(np.bincount(wrow, length**2, rows) / some - mean**2, 0))
    full = np.flatnonzero(n)
    longest = np.zeros(rows)
    if len(full):
        longest[full] = np.maximum.reduceat(length, words.at[:-1][full])
    ordered, to = words.hashes.copy(), words.at
    for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True):
        ordered[a:b].sort()
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    new[to[:-1][full]] = True
    heads = np.flatnonzero(new)
    run = np.diff(np.append(heads, len(ordered)))
    top = np.zeros(rows)
    if len(heads):
        np.maximum.at(top, wrow[heads], run)
    distinct_words = np.bincount(wrow[heads], minlength=rows) / some
    last = kind[words.ends - 1] if len(length) else np.zeros(0, np.uint8)
    first = kind[words.starts] if len(length) else np.zeros(0, np.uint8)
    names = list(KINDS)
    odd = np.isin(last, [names.index(k) for k in ("shout", "bar", "mark")])
    capital = (first == names.index("upper")) & (np.isin(kind[np.minimum(words.starts + 1, len(kind) - 1)] if len(length) else first, [names.index("upper")]))
    lines = _lines(data, at)
    return np.column_stack([
        share, np.log1p(size), np.log1p(n), mean, sd, longest, np.bincount(wrow, length <= 3, rows) / some, distinct_words,
        _share_distinct(*tk.runs(words, 2)), _share_distinct(*tk.runs(words, 5)), top / some,
        np.log1p(np.diff(lines[1])), size / np.maximum(np.diff(lines[1]), 1), _share_distinct(*lines),
        np.bincount(wrow, odd, rows) / some, np.bincount(wrow, capital, rows) / some,
    ]).astype(np.float32)


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of non-empty lines of each row."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    inside = np.ones(256, bool)
    inside[10] = False
    words = tk.Words(data, at, inside)
    return words.hashes, words.at


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and f, the statistics of the whole text, one row per row of ``docs``."""

    def per_batch(batches):
        for batch in batches:
            for lo, hi, data, at in tk.chunks(tk.text_column(batch.column(1))):
                f = statistics(data, at)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * f.shape[1]), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), flat], ["doc_id", "f"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(per_batch, "doc_id long, f array<float>")


@dataclass(frozen=True)
class Boosting:
    trees: int = 150
    depth: int = 4
    rate: float = 0.2
    bins: int = 48
    least: float = 1.0
    ridge: float = 2.0
    sample_rows: int = 40_000


@dataclass
class Trees:
    """Complete binary trees: split feature and threshold by node in level order, values of the leaves."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, cfg: Boosting = Boosting()) -> Trees:
    """Trees that lower the logistic loss; splits are sought on histograms of ``bins`` quantile bins."""
    inner, leaves = 2**cfg.depth - 1, 2**cfg.depth
    none = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    if not len(y):
        return none
    p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    none.start = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return none
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cfg.bins + 1)[1:-1], method="lower")).astype(np.float32) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    flat = binned + np.arange(width) * cfg.bins
    f, t, v = [], [], []
    margin = np.full(len(y), none.start)
    for _ in range(cfg.trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = q - y, q * (1 - q)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(cfg.depth):
            first, many = 2**level - 1, 2**level
            local = node - first
            cell = (local[:, None] * (width * cfg.bins) + flat).ravel()
            shape = (many, width, cfg.bins)
            g = np.bincount(cell, np.repeat(grad, width), many * width * cfg.bins).reshape(shape).cumsum(2)
            h = np.bincount(cell, np.repeat(hess, width), many * width * cfg.bins).reshape(shape).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + cfg.ridge) + (gt - g) ** 2 / (ht - h + cfg.ridge) - gt**2 / (ht + cfg.ridge)
            gain[(h < cfg.least) | (ht - h < cfg.least)] = -1
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                if gain.reshape(many, -1)[k, best[k]] > 1e-9:
                    j, b = divmod(int(best[k]), cfg.bins)
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value = -cfg.rate * g / (h + cfg.ridge)
        margin += value[leaf]
        f.append(feature)
        t.append(threshold)
        v.append(value)
    return Trees(none.start, np.array(f), np.array(t), np.array(v))


def held_out(id_col: str, fold: int = 0, folds: int = 5):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fold: int = 0, folds: int = 5, cfg: Boosting = Boosting()) -> Trees:
    """Trees from labelled documents outside the held-out fold, at most ``sample_rows`` of them, by a hash of the id; statistics are taken of these alone."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(~held_out("doc_id", fold, folds))
    here = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    one = marked.groupBy("doc_id").agg(F.max("y").alias("y")).join(here, "doc_id", "left_semi").orderBy(*order).limit(cfg.sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(one), "doc_id")
    found = features(texts, "doc_id", "text").join(F.broadcast(one), "doc_id")
    rows = found.orderBy(*order, "f").limit(cfg.sample_rows).select("f", "y").toArrow()
    x = np.array(rows.column("f").combine_chunks().flatten()).reshape(len(rows), len(NAMES)) if len(rows) else np.zeros((0, len(NAMES)), np.float32)
    return fit(x, rows.column("y").to_numpy().astype(float) if len(rows) else np.zeros(0), cfg)


def _chunks(column) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, statistics) over chunks of a batch's texts."""
    for lo, hi, data, at in tk.chunks(tk.text_column(column)):
        yield lo, hi, statistics(data, at)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, cfg: Boosting = Boosting()) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= ``cut``), one row per row of ``docs``, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, cfg=cfg))

    def per_batch(batches):
        for batch in batches:
            for lo, hi, x in _chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.score(x))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(per_batch, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, cfg: Boosting = Boosting()) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more; no row is moved."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, cfg=cfg))
    place = docs.columns.index(text_col)

    def per_batch(batches):
        for batch in batches:
            for lo, hi, x in _chunks(batch.column(place)):
                yield batch.slice(lo, hi - lo).filter(pa.array(shared.value.score(x) >= cut))

    return docs.mapInArrow(per_batch, docs.schema)
