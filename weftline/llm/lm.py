"""N-gram scoring from a log-frequency Bloom filter.

Words and word pairs of the training documents are counted over all of them.
Counts are quantised on a log scale; an n-gram of level q enters the filter as
the q items (n-gram, 1) .. (n-gram, q), so a count is read back by probing
levels until one is missing. Every pair enters, those seen once too (``min_pair``). The filter
is split into segments by the n-gram's hash, each built in one task. They are sent
to the workers if all together stay under ``most_broadcast`` bytes; beyond that the
probes go to the segments (``lm_segments``), with the same levels and scores.

Probabilities interpolate pair and word estimates. The weight depends on the
level of the left word and is fitted by expectation maximisation on leave-one-out
ratios of every training token, gathered as a small histogram. One pass over the
texts gathers it and keeps each token's level and binned ratio (two bytes), from
which the scores follow.

The exact base score needs exact counts: a table of the most frequent words, of
at most ``frequent_limit`` entries, is broadcast; all rarer words are joined.

Defined results: a null or empty text is one end token; a null id is in training;
repeated rows count and are scored each time; without training documents N and V
are 0, every token is unknown and scores log10(0.5 / 0.5) = 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textkit as tk
from weftline.llm.scratch import Scratch

U64 = np.uint64
END, START = U64(tk.mix_int(77, 1)), U64(tk.mix_int(77, 2))
RATIOS = np.linspace(-3, 9, 241)  # log10 edges of pair estimate to word estimate
CELLS = len(RATIOS) + 1
CHUNK = 1 << 20
LEVELS = 64
LOW = U64(40)


@dataclass(frozen=True)
class LogBloom:
    """Log base of the quantiser, bits and probes an item, least count of a pair, tokens a segment, bounds of what is broadcast, tokens whose probes travel together."""

    base: float = 1.6
    bits: int = 12
    probes: int = 6
    min_pair: int = 1
    segment_tokens: int = 4_000_000
    most_broadcast: int = 128 << 20
    frequent_limit: int = 1_000_000
    group_tokens: int = 1 << 20

    def level(self, count: np.ndarray) -> np.ndarray:
        """Level of counts of at least 1."""
        return np.minimum(1 + np.floor(np.log(count) / np.log(self.base) + 1e-9), LEVELS - 1).astype(np.int64)

    def decoded(self) -> np.ndarray:
        """Count by level: the middle of what it holds, 0 for level 0."""
        q = np.arange(LEVELS)
        low = np.ceil(self.base ** (q - 1.0) - 1e-9)
        high = np.maximum(low, np.ceil(self.base**q - 1e-9) - 1)
        return np.where(q > 0, (low + high) / 2, 0)


class Filter:
    """Segments of bits, joined in one array of bytes."""

    def __init__(self, cfg: LogBloom, bits: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.cfg, self.bits, self.begin, self.size = cfg, bits, begin, size  # begin and size in bits, by segment

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        if not len(keys) or not len(self.bits):
            return out
        segment = segment_of(keys, len(self.size))
        live = np.flatnonzero(self.size[segment] > 0)
        key, begin, size = keys[live], self.begin[segment[live]], self.size[segment[live]].astype(U64)
        level = 1
        while len(live) and level < LEVELS:
            one, two = hashed(key, level)
            for i in range(self.cfg.probes):
                at = begin + position(one, two, i, size)
                on = np.flatnonzero((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                live, key, begin, size, one, two = live[on], key[on], begin[on], size[on], one[on], two[on]
                if not len(live):
                    break
            out[live] = level
            level += 1
        return out


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """By the high 24 bits of a key; what a segment holds goes by the low 40."""
    return ((keys >> LOW) % U64(segments)).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """The low 40 bits of keys, five bytes each."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view(U64).ravel()


def hashed(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of an item, for double hashing."""
    h = tk.mix((keys & U64((1 << 40) - 1)) ^ U64(tk.mix_int(5, level)))
    return h >> U64(32), (h & U64(0xFFFFFFFF)) | U64(1)


def position(one: np.ndarray, two: np.ndarray, probe: int, size: np.ndarray) -> np.ndarray:
    """Bit of a probe; the multiplication maps 32 bits evenly to a segment's size."""
    return ((((one + U64(probe) * two) & U64(0xFFFFFFFF)) * size) >> U64(32)).astype(np.int64)


def segment_bits(cfg: LogBloom, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The filter of one segment as packed bytes."""
    items = int(levels.sum())
    size = max(64, -(-items * cfg.bits // 8) * 8) if items else 0
    bits = np.zeros(size, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        mine = keys[levels >= level]
        for i in range(cfg.probes):
            bits[position(*hashed(mine, level), i, U64(size))] = 1
    return np.packbits(bits, bitorder="little")


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a chunk, an end after each row, and offsets by row."""
    words = tk.Words(data, at, tk.SPACED)
    rows = len(at) - 1
    to = words.at + np.arange(rows + 1)
    out = np.full(to[-1], END, U64)
    place = np.arange(len(words.hashes)) + np.repeat(np.arange(rows), words.counts)
    out[place] = words.hashes
    return out, to


def left_of(token: np.ndarray, at: np.ndarray) -> np.ndarray:
    left = np.empty_like(token)
    left[1:] = token[:-1]
    left[at[:-1]] = START
    return left


def pair_key(left: np.ndarray, token: np.ndarray) -> np.ndarray:
    return tk.mix(left * tk.K1 + token)


def _prepared(docs: DataFrame, id_col: str, text_col: str, fold: int, folds: int) -> DataFrame:
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))


def _groups(batch: pa.RecordBatch, which: Callable, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """What ``which`` makes of the chunks of a batch's texts, about ``most`` values at a time."""
    held, n = [], 0
    for _, _, data, at in tk.chunks(tk.text_column(batch.column(0)), CHUNK):
        held.append(which(data, at))
        n += len(held[-1])
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _word_counts(train: DataFrame) -> DataFrame:
    def per_batch(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for keys in _groups(batch, lambda data, at: tokens(data, at)[0]):
                key, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tk.as_long(key)), pa.array(n)], ["key", "n"])

    return train.select("text").mapInArrow(per_batch, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _pair_bits(train: DataFrame, segments: int, cfg: LogBloom) -> DataFrame:
    """Filters of the pairs by segment."""

    def keyed(data, at):
        token, at = tokens(data, at)
        return pair_key(left_of(token, at), token)

    def pack(batches):
        for batch in batches:
            for keys in _groups(batch, keyed, 3 << 20):
                key, n = np.unique(keys, return_counts=True)
                part = segment_of(key, segments)
                order = np.argsort(part, kind="stable")
                key, n, part = key[order], n[order].astype(np.uint32), part[order]
                heads = np.searchsorted(part, np.arange(segments + 1))
                used = np.flatnonzero(heads[1:] > heads[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([packed(key[heads[s] : heads[s + 1]]) for s in used]), pa.array([n[heads[s] : heads[s + 1]].tobytes() for s in used])], ["segment", "keys", "counts"])

    def merge(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for s, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(s, []).append((unpacked(k), np.frombuffer(n, np.uint32)))
        for s in sorted(held):
            parts = held.pop(s)
            keys = np.concatenate([k for k, _ in parts])
            order = np.argsort(keys)
            keys, n = keys[order], np.concatenate([n for _, n in parts])[order].astype(np.int64)
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[heads], np.add.reduceat(n, heads)
            keys, n = keys[n >= cfg.min_pair], n[n >= cfg.min_pair]
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([segment_bits(cfg, keys, cfg.level(n)).tobytes()], pa.binary())], ["segment", "bits"])

    dealt = train.select("text").mapInArrow(pack, "segment long, keys binary, counts binary").repartition("segment")
    return dealt.mapInArrow(merge, "segment long, bits binary")


def _word_bits(counts: DataFrame, segments: int, cfg: LogBloom) -> DataFrame:
    def merge(batches):
        keys, n = [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy().view(U64))
            n.append(batch.column(1).to_numpy())
        if not keys:
            return
        keys, n = np.concatenate(keys), np.concatenate(n)
        part = segment_of(keys, segments)
        for s in np.unique(part).tolist():
            mine = part == s
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([segment_bits(cfg, keys[mine], cfg.level(n[mine])).tobytes()], pa.binary())], ["segment", "bits"])

    segment = F.shiftrightunsigned("key", int(LOW)) % segments
    return counts.withColumn("segment", segment).repartition("segment").select("key", "n").mapInArrow(merge, "segment long, bits binary")


def _filter(frame: DataFrame, segments: int, cfg: LogBloom) -> Filter:
    # a partition at a time: the driver holds the filter once
    got = {r.segment: np.frombuffer(bytes(r.bits), np.uint8) for r in frame.toLocalIterator()}
    parts = [got.get(s, np.zeros(0, np.uint8)) for s in range(segments)]
    size = np.array([len(p) * 8 for p in parts], np.int64)
    return Filter(cfg, np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]]), size)


@dataclass
class Model:
    """Counts of training and, where they are broadcast, the filters."""

    cfg: LogBloom
    words: Filter | None
    pairs: Filter | None
    n: int
    v: int

    def measured(self, frequent: tuple, ids: pa.Array, held: pa.Array, token: np.ndarray, at: np.ndarray, uniq: np.ndarray, which: np.ndarray, level: np.ndarray, pair_level: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        """A record for each row, and how often training tokens fall in each cell with one occurrence left out.

        ``token``: hashes of all rows, by offsets ``at``; ``uniq[which]`` is the same; ``level``: of ``uniq``; ``pair_level``: by token.
        """
        count = self.cfg.decoded()
        mine = level[which]
        left = np.empty(len(token), np.int64)
        left[1:] = mine[:-1]
        left[at[:-1]] = LEVELS - 1
        pair = count[pair_level]
        # a row's first token has no counted left word; its pair estimate is left out
        pair[at[:-1]] = 0
        some = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), np.diff(at))
        hits = np.bincount(self.cells(pair[some], count[mine[some]], count[left[some]], left[some], less=1), minlength=LEVELS * CELLS)
        cell = self.cells(pair, count[mine], count[left], left).astype(np.uint16)
        total = np.add.reduceat(np.log10(self.word(count[mine])), at[:-1])
        signed = tk.as_long(uniq)
        c = exact(*frequent, signed, -1)
        known = (c >= 0)[which]
        base = np.add.reduceat(np.where(known, np.log10((np.maximum(c, 0) + 0.5) / (self.n + 0.5 * (self.v + 1)))[which], 0), at[:-1])
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))[~known]
        rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(at))).astype(np.int32)), pa.array(signed[which[~known]]))
        blobs = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(cell)])
        return _batch(ids, held, np.diff(at), np.add.reduceat(known.astype(np.int64), at[:-1]), base, total, rare, blobs), hits

    def word(self, count: np.ndarray, less: int = 0) -> np.ndarray:
        return (np.maximum(count - less, 0) + 0.5) / (max(self.n - less, 0) + 0.5 * (self.v + 1))

    def cells(self, pair, count, left, level, less: int = 0) -> np.ndarray:
        """The left word's level and the binned log ratio of pair to word estimate, ``less`` occurrences left out; bin 0: no pair."""
        seen = np.flatnonzero(pair > less)
        estimate = np.minimum((pair[seen] - less) / np.maximum(left[seen] - less, 1), 1)
        ratio = np.log10(estimate / self.word(count[seen], less))
        out = level * CELLS
        out[seen] += np.clip(np.floor((ratio - RATIOS[0]) / (RATIOS[1] - RATIOS[0])).astype(np.int64) + 1, 1, CELLS - 1)
        return out


def _ratios() -> np.ndarray:
    """The ratio that each bin stands for: 0 without a pair, else the bin's lower edge, so that no estimate is raised."""
    return np.concatenate([[0], 10.0**RATIOS])


def exact(known: np.ndarray, counts: np.ndarray, keys: np.ndarray, none: int) -> np.ndarray:
    """Counts of signed keys by the sorted ``known``; ``none`` for others."""
    if not len(known):
        return np.full(len(keys), none, np.int64)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[place] == keys, counts[place], none)


def frequent(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of the most frequent, at most ``limit``, by whole powers of two."""
    by_power = {int(r.p): r.c for r in counts.groupBy(F.floor(F.log2("n") + 1e-9).alias("p")).agg(F.count("*").alias("c")).collect()}
    power, held = 64, 0
    while power > 0 and held + by_power.get(power - 1, 0) <= limit:
        power -= 1
        held += by_power.get(power, 0)
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = counts.where(F.col("n") >= 2**power).select("key", "n").toArrow()
    keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def gains(table: np.ndarray) -> np.ndarray:
    """What a cell adds to the log10 word estimate, from how often each occurs."""
    weight = _weights(table.reshape(LEVELS, CELLS))
    return np.log10(weight[:, None] * _ratios() + 1 - weight[:, None]).ravel()


def _weights(cells: np.ndarray) -> np.ndarray:
    """Interpolation weight of the pair estimate by the left word's level."""
    ratio = _ratios()
    out = np.zeros(len(cells))
    for k, row in enumerate(cells):
        if row.sum() and row[1:].sum():
            w = 0.3
            for _ in range(60):
                w = float((row * (w * ratio / (w * ratio + 1 - w))).sum() / row.sum())
                w = min(max(w, 1e-6), 0.999)
            out[k] = w
    out[-1] = 0  # the level that marks a row's first token
    return out


RECORD = "doc_id long, held_out boolean, n_tokens long, known long, base double, words double, rare array<long>, cells binary"


def histogram(hits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task has gathered of training cells, as one record that is no row."""
    if hits.any():
        used = np.flatnonzero(hits)
        yield _batch([None], [None], [-1], [0], [0.0], [0.0], [hits[used]], [used.astype(np.uint16).tobytes()])


def _batch(*columns) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary()]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "known", "base", "words", "rare", "cells"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 1, folds: int = 5, cfg: LogBloom = LogBloom()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per row of ``docs``."""
    from weftline.llm import lm_segments

    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = _prepared(docs, id_col, text_col, fold, folds)
    train = rows.where("not held_out")
    counts = scratch.write("words", _word_counts(train))
    n, v = counts.agg(F.sum("n"), F.count("*")).first()
    n = int(n or 0)
    v = int(v or 0)
    often = frequent(counts, cfg.frequent_limit)
    under = n + 0.5 * (v + 1)

    segments = max(1, -(-n // cfg.segment_tokens))
    word_bits = scratch.write("word_bits", _word_bits(counts, segments, cfg))
    pair_bits = scratch.write("pair_bits", _pair_bits(train, segments * 4, cfg))
    size = sum(f.agg(F.sum(F.length("bits"))).first()[0] or 0 for f in (word_bits, pair_bits))
    scratch.release()
    shared = None
    if size > cfg.most_broadcast:
        made = lm_segments.records(rows, often, Model(cfg, None, None, n, v), word_bits, pair_bits, segments, scratch)
    else:
        shared = spark.sparkContext.broadcast((Model(cfg, _filter(word_bits, segments, cfg), _filter(pair_bits, segments * 4, cfg), n, v), often))

        def per_batch(batches):
            model, often = shared.value
            gathered = np.zeros(LEVELS * CELLS, np.int64)
            for batch in batches:
                for lo, hi, data, at in tk.chunks(tk.text_column(batch.column(1)), CHUNK):
                    token, at = tokens(data, at)
                    uniq, which = np.unique(token, return_inverse=True)
                    pairs = model.pairs.levels(pair_key(left_of(token, at), token))
                    made, hits = model.measured(often, batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), token, at, uniq, which, model.words.levels(uniq), pairs)
                    gathered += hits
                    yield made
            yield from histogram(gathered)

        made = rows.select("doc_id", "text", "held_out").mapInArrow(per_batch, RECORD)
    made = scratch.write("scored", made.withColumn("row", F.monotonically_increasing_id()))
    if shared is not None:
        shared.destroy()
    scratch.drop("word_bits", "pair_bits", "groups")
    scratch.release()

    def gather(batches):
        for batch in batches:
            for cells, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(cells, np.uint16).astype(np.int64)), pa.array(counts)], ["cell", "n"])

    table = np.zeros(LEVELS * CELLS)
    for r in made.where("n_tokens < 0").select("cells", "rare").mapInArrow(gather, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[r.cell] = r.n
    gain = gains(table)
    made = made.where("n_tokens > 0")

    def interpolate(batches):
        for batch in batches:
            cells = batch.column(4)
            at = np.concatenate([[0], np.cumsum(batch.column(5).to_numpy())])
            got = gain[np.frombuffer(b"".join(cells.to_pylist()), np.uint16)]
            score = batch.column(6).to_numpy() + np.add.reduceat(got, at[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5), batch.column(7), pa.array(score)], ["row", "doc_id", "held_out", "known", "n_tokens", "base", "score"])

    scored = made.select("row", "doc_id", "held_out", "known", "cells", "n_tokens", "words", "base").mapInArrow(interpolate, "row long, doc_id long, held_out boolean, known long, n_tokens long, base double, score double")
    rare = made.select("row", F.explode("rare").alias("key")).join(counts, "key", "left")
    each = F.log10((F.coalesce(F.col("n"), F.lit(0)) + 0.5) / F.lit(under))
    sums = rare.groupBy("row").agg(F.sum(each).alias("rare_base"), F.count("n").alias("rare_known"))
    full = scored.join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("rare_known")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + zero("rare_base")).alias("base_score"), "score",
    )
