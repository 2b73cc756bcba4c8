"""Packing documents into sequences of a fixed number of tokens, by bounded-space best fit.

One pass tokenises whole texts and writes a row a piece: place, length and digest, no ids. A document
longer than a sequence is cut so that all its pieces but the first are full; full pieces are sequences
of their own. The others are dealt by hash into groups of about ``GROUP`` pieces, the number of groups growing
with the input, and each group is packed by ``BestFit``: pieces come one after another, and each goes to the open sequence
with the least room that holds it. Open sequences stand in stacks by free space, and the bits of one
integer tell which stacks are not empty, so the best is one shift away. At most
``open_bins`` are open; the fullest closes first. Pieces arrive in runs of as many, the longest of a run first,
so that a run closes none of the sequences that it opened.

Tokens come from a file of byte-pair ranks and its pattern of words, a parameter each. A text of over ``STRETCH``
characters is tokenised in stretches that end where a space follows something else, which no word spans.

Defined results: a null or empty text is its end token alone; repeated rows are packed each for itself; a null id stays null;
an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.scratch import Scratch
from weftline.llm.textkit import text_column

#: Pieces packed together, one task's group.
GROUP = 16_384
#: Characters tokenised at a time.
STRETCH = 1 << 20


class BestFit:
    """Online best fit with at most ``open_bins`` open bins; ``put`` gives (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.room, self.stacks = 0, [[] for _ in range(capacity + 1)]
        self.open = self.bins = 0

    def _take(self, free: int) -> int:
        found = self.stacks[free].pop()
        if not self.stacks[free]:
            self.room ^= 1 << free
        self.open -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        fits = self.room >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.open == self.open_bins:
                self._take((self.room & -self.room).bit_length() - 1)
            at, free = self.bins, self.capacity
            self.bins += 1
        left = free - length
        if left:
            self.stacks[left].append(at)
            self.room |= 1 << left
            self.open += 1
        return at, self.capacity - free


class Tokens:
    """Token ids of whole texts, as bytes of unsigned 32-bit integers, low byte first."""

    #: After a character that no library takes for a space, before one that all do: no word spans this.
    edge = re.compile(r"\S(?=[ \n])")

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            pairs = [line.split() for line in lines]
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks={base64.b64decode(word): int(rank) for word, rank in pairs}, special_tokens={})

    def stretches(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > STRETCH and (edge := self.edge.search(text, at + STRETCH)):
            yield text[at : edge.end()]
            at = edge.end()
        yield text[at:] if at else text

    def ids(self, text: str) -> bytes:
        return b"".join(np.asarray(self.encoding.encode_ordinary(part), "<u4").tobytes() for part in self.stretches(text))


_TOKENS: dict[tuple[str, str], Tokens] = {}


def pieces(docs: DataFrame, ranks: str, pattern: str, capacity: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece, with task and number, that tell rows apart. The digest is of the ids as unsigned 32-bit integers, low byte first."""
    kind = docs.schema[id_col].dataType
    names = ("id", "piece", "start", "length", "ids_crc32", "task", "number")
    kinds = (kind, T.IntegerType(), *[T.LongType()] * 5)
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (ranks, pattern) not in _TOKENS:  # once a worker
            _TOKENS[ranks, pattern] = Tokens(ranks, pattern)
        tokens, task, number, tail = _TOKENS[ranks, pattern], TaskContext.get().partitionId(), 0, np.array([end], "<u4").tobytes()
        for batch in batches:
            texts, rows, of = text_column(batch.column(1)), [], []
            for k in range(batch.num_rows):
                ids = tokens.ids(texts[k].as_py()) + tail
                total = len(ids) // 4
                at, length = 0, (total - 1) % capacity + 1
                for piece in range(-(-total // capacity)):
                    rows.append((piece, at, length, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + length)]), task, number))
                    of.append(k)
                    at, length, number = at + length, capacity, number + 1
            if rows:
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 5), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], list(names))

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, ranks: str, pattern: str, capacity: int = 1024, end: int = 2, open_bins: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id_col, piece, start, length, ids_crc32, sequence_id, offset, one for each piece of each document."""
    scratch = Scratch(docs.sparkSession, "packing")
    every = scratch.write("pieces", pieces(docs, ranks, pattern, capacity, end, id_col, text_col))
    short = every.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // GROUP))
    kind = every.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")]])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("order", "ascending"), ("task", "ascending"), ("number", "ascending")])
        lengths = group.column("length").to_numpy()
        arrival = np.lexsort((-lengths, np.arange(len(lengths)) // open_bins))
        group, fit = group.take(pa.array(arrival)), BestFit(capacity, open_bins)
        put = np.array([fit.put(n) for n in lengths[arrival].tolist()], np.int64).reshape(-1, 2)
        sequence = (key[0].as_py() << 32 | put[:, 0]) << 1
        return group.select(["id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(put[:, 1]))

    order = F.xxhash64("task", "number")
    dealt = short.withColumn("order", order).withColumn("group", F.pmod(order, F.lit(groups)))
    packed = dealt.groupBy("group").applyInArrow(run, schema)
    own = F.shiftleft(F.shiftleft("task", 32).bitwiseOR(F.col("number")), 1) + 1
    full = every.where(F.col("length") == capacity).select("id", "piece", "start", "length", "ids_crc32", own.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full).withColumnRenamed("id", id_col)
