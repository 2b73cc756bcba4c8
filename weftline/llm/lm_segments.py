"""N-gram scoring with a filter too large to broadcast: the probes go to its segments.

Texts become groups of tokens, written once. The distinct words and pairs of a group
are sent, by segment, to the task that holds the segment's bits, and the levels read
there go back to the group. A task streams: it holds the bits of one segment and a
batch of probes, or the levels of one group, whatever the number of either. A word or
pair probes once a group, so that the most common ones weigh no more than a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import lm
from weftline.llm import textkit as tk
from weftline.llm.scratch import Scratch

WORDS, PAIRS = 0, 1


def groups(rows: DataFrame, cfg: lm.LogBloom) -> DataFrame:
    """g, ids, held, at (offsets), uniq (token hashes) and which (of them each token is): about ``group_tokens`` tokens a row."""

    def per_batch(batches):
        serial = TaskContext.get().partitionId() << 33
        held: list[tuple] = []

        def out():
            nonlocal serial
            ids, flags, counts, token = (np.concatenate(x) if k > 1 else [y for z in x for y in z] for k, x in enumerate(zip(*held, strict=True)))
            held.clear()
            uniq, which = np.unique(token, return_inverse=True)
            at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            serial += 1
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (at, uniq, which.astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.array([serial]), pa.array([ids], pa.list_(pa.int64())), pa.array([flags], pa.list_(pa.bool_())), *blobs], ["g", "ids", "held", "at", "uniq", "which"])

        for batch in batches:
            for lo, hi, data, at in tk.chunks(tk.text_column(batch.column(1)), lm.CHUNK):
                token, at = lm.tokens(data, at)
                held.append((batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(2).slice(lo, hi - lo).to_pylist(), np.diff(at), token))
                if sum(len(x[3]) for x in held) >= cfg.group_tokens:
                    yield out()
        if held:
            yield out()

    return rows.select("doc_id", "text", "held_out").mapInArrow(per_batch, "g long, ids array<long>, held array<boolean>, at binary, uniq binary, which binary")


def _split(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts keys in that of their segments, and where each segment starts."""
    part = lm.segment_of(keys, segments)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(segments + 1))


def _keys(at: np.ndarray, uniq: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their distinct pairs, and which of these each token ends."""
    token = uniq[which]
    pairs, ends = np.unique(lm.pair_key(lm.left_of(token, at), token), return_inverse=True)
    return token, pairs, ends


def _arrays(at, uniq, which):
    return np.frombuffer(at, np.int64), np.frombuffer(uniq, lm.U64), np.frombuffer(which, np.int32).astype(np.int64)


def records(rows: DataFrame, often: tuple, model: lm.Model, word_bits: DataFrame, pair_bits: DataFrame, segments: int, scratch: Scratch) -> DataFrame:
    """What the broadcast filter's pass makes of ``rows``: a record for each, and histograms of training cells."""
    cfg, shared = model.cfg, rows.sparkSession.sparkContext.broadcast((model, often))
    many = {WORDS: segments, PAIRS: segments * 4}
    grouped = scratch.write("groups", groups(rows, cfg))

    def ask(batches):
        for batch in batches:
            for g, *blobs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                at, uniq, which = _arrays(*blobs)
                for kind, keys in ((WORDS, uniq), (PAIRS, _keys(at, uniq, which)[1])):
                    order, heads = _split(keys, many[kind])
                    used = np.flatnonzero(heads[1:] > heads[:-1])
                    keys = keys[order]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(used), kind)), pa.array(used), pa.array(np.full(len(used), g)), pa.array([lm.packed(keys[heads[s] : heads[s + 1]]) for s in used], pa.binary())], ["kind", "segment", "g", "blob"]
                    )

    def probe(batches):
        held, bits = None, None
        for batch in batches:
            out = []
            for kind, segment, g, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g < 0:
                    held, bits = (kind, segment), lm.Filter(cfg, np.frombuffer(blob, np.uint8), np.zeros(1, np.int64), np.array([8 * len(blob)]))
                    continue
                keys = lm.unpacked(blob)
                level = bits.levels(keys) if held == (kind, segment) else np.zeros(len(keys), np.int64)
                out.append((g, kind, segment, level.astype(np.uint8).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["g", "kind", "segment", "levels"])

    def score(batches):
        model, often = shared.value
        gathered = np.zeros(lm.LEVELS * lm.CELLS, np.int64)
        levels: dict[int, list] = {WORDS: [], PAIRS: []}
        for batch in batches:
            at_row = batch.column(1).to_pylist()
            got = batch.column(3).to_pylist()
            for i, kind in enumerate(at_row):
                if kind in levels:
                    levels[kind].append(got[i])
                    continue
                at, uniq, which = _arrays(*(batch.column(k)[i].as_py() for k in (6, 7, 8)))
                token, pairs, ends = _keys(at, uniq, which)
                found = {}
                for k, keys in ((WORDS, uniq), (PAIRS, pairs)):
                    found[k] = np.empty(len(keys), np.int64)
                    found[k][_split(keys, many[k])[0]] = np.frombuffer(b"".join(levels[k]), np.uint8)
                    levels[k] = []
                ids, held = (pa.array(batch.column(k)[i].as_py(), t) for k, t in ((4, pa.int64()), (5, pa.bool_())))
                made, hits = model.measured(often, ids, held, token, at, uniq, which, found[WORDS], found[PAIRS][ends])
                gathered += hits
                yield made
        yield from lm.histogram(gathered)

    bits = [f.select(F.lit(kind).cast("long").alias("kind"), "segment", F.lit(-1).cast("long").alias("g"), F.col("bits").alias("blob")) for kind, f in ((WORDS, word_bits), (PAIRS, pair_bits))]
    asked = grouped.select("g", "at", "uniq", "which").mapInArrow(ask, "kind long, segment long, g long, blob binary")
    dealt = asked.unionByName(bits[0]).unionByName(bits[1]).repartition("kind", "segment").sortWithinPartitions("kind", "segment", "g")
    answers = dealt.mapInArrow(probe, "g long, kind long, segment long, levels binary")
    # a group's row comes after its answers, those in order of segments
    none = {c: F.lit(None).cast(t).alias(c) for c, t in grouped.dtypes if c != "g"}
    back = answers.select("g", "kind", "segment", "levels", *none.values())
    last = grouped.select("g", F.lit(2).cast("long").alias("kind"), F.lit(0).cast("long").alias("segment"), F.lit(None).cast("binary").alias("levels"), *none)
    return back.unionByName(last).repartition("g").sortWithinPartitions("g", "kind", "segment").mapInArrow(score, lm.RECORD)
