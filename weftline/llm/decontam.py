"""Benchmark decontamination by Wu-Manber search over words.

A benchmark item's windows are its runs of ``window`` words (an item of fewer
words is one window). Windows of one length are searched together: a table gives,
for the block of two words that ends at a position, how far the search may
shift; where it may not, the block's bucket names the windows that end in it, and
those are compared word by word (64-bit word hashes). All documents of a batch
advance at once, so the inner loop is vectorised.

The windows are broadcast while they take at most ``most_broadcast`` bytes;
beyond that, windows are joined to document positions by their words' hashes.

Defined results: null and empty texts have no words and are not contaminated;
an item without words has no window; repeated items count once by item_id;
overlapping occurrences hit each word once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textkit as tk

U64 = np.uint64
#: Most bytes of windows and item ids that are sent to the workers. The tables made of them hold as much again, and a thirteenth for the buckets.
MOST_BROADCAST = 64 << 20


class WuManber:
    """Windows of one length: words (windows x length) and the items of each."""

    def __init__(self, windows: np.ndarray, items: list[np.ndarray]):
        self.windows, self.items = windows, items
        self.length = windows.shape[1]
        self.block = min(2, self.length)
        bits = max(10, int(windows.size * 4).bit_length())
        self.mask = U64((1 << bits) - 1)
        # a byte a slot, at most 8 slots a word: the table is no larger than the windows; a shift cut at 255 is a safe one
        self.shift = np.full(1 << bits, min(self.length - self.block + 1, 255), np.uint8)
        for end in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self._slot(windows, end), np.uint8(min(self.length - 1 - end, 255)))
        last = self._hash(windows, self.length - 1)
        self.order = np.argsort(last, kind="stable")
        self.suffix = last[self.order]

    def _hash(self, words: np.ndarray, end) -> np.ndarray:
        h = words[:, end]
        return tk.mix(h + tk.K1 * words[:, end - 1]) if self.block == 2 else tk.mix(h)

    def _slot(self, words: np.ndarray, end) -> np.ndarray:
        return (self._hash(words, end) & self.mask).astype(np.int64)

    def search(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, window) of every occurrence inside rows of ``words`` given by offsets ``at``."""
        block = words.copy()
        if self.block == 2 and len(words):
            block[1:] = words[1:] + tk.K1 * words[:-1]
        block = tk.mix(block)
        shift = self.shift[(block & self.mask).astype(np.int64)]
        # long rows are cut in pieces that search their own ends, so that no row holds up the batch
        n = np.diff(at)
        pieces = np.maximum(1, -(-n // 1024))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        pos = at[:-1][row] + np.maximum(piece * 1024, self.length - 1)
        stop = np.minimum(at[:-1][row] + (piece + 1) * 1024, at[1:][row])
        live = pos < stop
        pos, stop = pos[live], stop[live]
        found_at, found = [], []
        while len(pos):
            step = shift[pos]
            zero = pos[step == 0]
            if len(zero):
                lo = np.searchsorted(self.suffix, block[zero], "left")
                hi = np.searchsorted(self.suffix, block[zero], "right")
                many = hi - lo
                where = np.repeat(zero, many)
                window = self.order[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
                same = np.ones(len(where), bool)
                for j in range(self.length):
                    on = np.flatnonzero(same)
                    if not len(on):
                        break
                    same[on] = words[where[on] - self.length + 1 + j] == self.windows[window[on], j]
                found_at.append(where[same] - self.length + 1)
                found.append(window[same])
            pos = pos + np.maximum(step, 1).astype(np.int64)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)


def _windows_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in tk.chunks(tk.text_column(batch.column(1))):
            words = tk.Words(data, at, tk.ALNUM)
            n = words.counts
            number = np.where(n >= window, n - window + 1, (n > 0).astype(np.int64))
            row = np.repeat(np.arange(hi - lo), number)
            begin = words.at[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            size = np.minimum(n, window)[row]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array([words.hashes[b : b + s].tobytes() for b, s in zip(begin, size, strict=True)], pa.binary())],
                ["item_id", "words"],
            )


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, words): the distinct windows of each item, as bytes of word hashes."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null")
    return rows.mapInArrow(lambda b: _windows_of(b, window), "item_id string, words binary").distinct()


def _machines(rows: list) -> list[WuManber]:
    by_length: dict[int, dict[bytes, set]] = {}
    for r in rows:
        words = bytes(r.words)
        by_length.setdefault(len(words) // 8, {}).setdefault(words, set()).add(r.item_id)
    out = []
    for _, windows in sorted(by_length.items()):
        keys = sorted(windows)
        out.append(WuManber(np.frombuffer(b"".join(keys), U64).reshape(len(keys), -1), [np.array(sorted(windows[k]), object) for k in keys]))
    return out


def _report(ids: pa.Array, counts: np.ndarray, hits: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(hits), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item ids as strings), one row per row of ``docs``."""
    windows, machines = _sent(docs, benchmark, item_col, item_text, window, most_broadcast)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if machines is None:
        return _joined(rows, windows, window)

    def per_batch(batches):
        for batch in batches:
            for lo, hi, counts, hits, items in _searched(batch.column(1), machines.value):
                yield _report(batch.column(0).slice(lo, hi - lo), counts, hits, [sorted(set(x)) for x in items])

    return rows.mapInArrow(per_batch, "doc_id long, n_words long, n_hit long, items array<string>")


def _sent(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, window: int, most: int):
    """The benchmark's windows, and the broadcast search machines where these take at most ``most`` bytes."""
    spark = docs.sparkSession
    windows = item_windows(benchmark, item_col, item_text, window)
    size = windows.agg(F.sum(F.length("words") + F.length("item_id"))).first()[0] or 0
    return windows, spark.sparkContext.broadcast(_machines(windows.collect())) if size <= most else None


def _searched(column, machines: list[WuManber]) -> Iterator[tuple]:
    """(first row, end row, words, hit words, items) over chunks of a batch's texts."""
    for lo, hi, data, at in tk.chunks(tk.text_column(column)):
        words = tk.Words(data, at, tk.ALNUM)
        edge = np.zeros(len(words.hashes) + 1, np.int64)
        items: list[list[str]] = [[] for _ in range(hi - lo)]
        for machine in machines:
            begin, which = machine.search(words.hashes, words.at)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + machine.length, -1)
            row = np.searchsorted(words.at, begin, side="right") - 1
            for r, w in np.unique(np.stack([row, which], 1), axis=0).tolist():
                items[r].extend(machine.items[w])
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        yield lo, hi, words.counts, np.diff(hit[words.at]), items


def _joined(rows: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """The same for a benchmark too large to broadcast: positions are joined to windows by the words' hash."""
    lengths = [r.n for r in windows.select((F.length("words") / 8).cast("int").alias("n")).distinct().collect()]

    def places(batches):
        for batch in batches:
            for _, _, data, at in tk.chunks(tk.text_column(batch.column(1))):
                words = tk.Words(data, at, tk.ALNUM)
                for n in lengths:
                    full = np.flatnonzero(words.counts >= n)
                    number = words.counts[full] - n + 1
                    offset = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                    begin = np.repeat(words.at[:-1][full], number) + offset
                    for part in range(0, len(begin), 1 << 15):
                        some = begin[part : part + (1 << 15)]
                        raw = words.hashes[some[:, None] + np.arange(n)]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(np.searchsorted(words.at, some, side="right") - 1)), pa.array(offset[part : part + (1 << 15)]), pa.array([x.tobytes() for x in raw], pa.binary())],
                            ["row", "begin", "words"],
                        )

    def sizes(batches):
        for batch in batches:
            n = [tk.Words(data, at, tk.ALNUM).counts for _, _, data, at in tk.chunks(tk.text_column(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], ["row", "doc_id", "n_words"])

    from weftline.llm.scratch import Scratch

    numbered = Scratch(rows.sparkSession, "decontam").write("rows", rows.withColumn("row", F.monotonically_increasing_id())).select("row", "doc_id", "text")

    def one_chunk_rows(batches):  # a chunk of its own for each row keeps the row's number
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1)

    at = numbered.select("row", "text").mapInArrow(lambda b: places(one_chunk_rows(b)), "row long, begin long, words binary")
    found = at.join(windows, "words").select("row", "begin", (F.col("begin") + F.length("words") / 8).cast("long").alias("end"), "item_id")
    hit = found.select("row", F.explode(F.sequence("begin", F.col("end") - 1)).alias("at")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    items = found.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    counted = numbered.mapInArrow(sizes, "row long, doc_id long, n_words long")
    out = counted.join(hit, "row", "left").join(items, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def with_verdict(found: DataFrame) -> DataFrame:
    """Adds n_items, items_sha256 and contaminated: hit words make up a twentieth of all, at least."""
    joined = F.concat_ws(",", "items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The rows of ``docs`` whose text isn't contaminated, found in one pass that moves none; rows with a null id stay."""
    _, machines = _sent(docs, benchmark, "item_id", "text", window, most_broadcast)
    if machines is None:
        found = contamination(docs, benchmark, id_col, text_col, window=window, most_broadcast=most_broadcast)
        gone = with_verdict(found).where("contaminated").select(F.col("doc_id").alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
        return docs.join(gone, id_col, "left_anti").select(*docs.columns)
    text, key = docs.columns.index(text_col), docs.columns.index(id_col)

    def per_batch(batches):
        for batch in batches:
            for lo, hi, counts, hits, _ in _searched(batch.column(text), machines.value):
                part = batch.slice(lo, hi - lo)
                dirty = (hits > 0) & (20 * hits >= counts) & part.column(key).is_valid().to_numpy(zero_copy_only=False)
                yield part.filter(pa.array(~dirty))

    return docs.mapInArrow(per_batch, docs.schema)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
