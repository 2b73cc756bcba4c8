"""Vectorised tokenising and hashing of Arrow text columns.

Everything works on whole texts, in chunks of rows of a few MB, so that memory
is bounded by the chunk or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
K1, K2, K3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
CHUNK_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: ``[^\x20\x09-\x0D]+``: bytes of a word that white space ends.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over lower-cased text: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[ord("0") : ord("9") + 1] = ALNUM[ord("a") : ord("z") + 1] = ALNUM[0x80:] = True

_MASK = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 9)], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, a bijection of 64 bits."""
    x = (x ^ (x >> U64(30))) * K2
    x = (x ^ (x >> U64(27))) * K3
    return x ^ (x >> U64(31))


def mix_int(*parts: int) -> int:
    """A 64-bit hash of a few integers, the same in every process."""
    x = np.zeros(1, U64)
    for p in parts:
        x = mix((x + K1) ^ np.array([p & 0xFFFFFFFFFFFFFFFF], U64))
    return int(x[0])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_column(column) -> pa.Array:
    """One contiguous large_string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in a row and the n+1 offsets into them."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, count=n + 1, offset=8 * column.offset)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of rows of at most ``most`` bytes, or of one longer row."""
    data, at = raw(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


class Words:
    """Words of a chunk: starts and ends in its bytes, first word of each row, 64-bit hashes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray):
        n = len(data)
        padded = np.zeros(n + 16, np.uint8)
        np.take(LOWER, data, out=padded[:n])
        inside = np.zeros(n + 2, bool)
        inside[1 : n + 1] = kind[padded[:n]]
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        first[edge] = inside[1:-1][edge]
        last[edge - 1] = inside[1:-1][edge - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.starts, at)
        self.hashes = hash_spans(padded, self.starts, self.ends)
        self.counts = np.diff(self.at)


def hash_spans(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; ``padded`` has 8 spare bytes. Spans up to 8 bytes of equal length never collide."""
    if not len(starts):
        return np.zeros(0, U64)
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(U64), (len(padded) - 7,), (1,))
    size = ends - starts
    out = mix((eight[starts] & _MASK[np.minimum(size, 8)]) ^ (size.astype(U64) * K1))
    rest = np.flatnonzero(size > 8)
    step = 8
    while len(rest):
        left = size[rest] - step
        out[rest] = mix((out[rest] * K1) ^ (eight[starts[rest] + step] & _MASK[np.minimum(left, 8)]))
        rest = rest[left > 8]
        step += 8
    return out


def runs(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``length`` words, with offsets by row. A row of fewer words, but not none, gives one run."""
    counts, h = words.counts, words.hashes
    number = np.where(counts >= length, counts - length + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(number)])
    row = np.repeat(np.arange(len(counts)), number)
    begin = words.at[:-1][row] + (np.arange(at[-1]) - at[:-1][row])
    size = np.minimum(counts, length)[row]
    out = mix(size.astype(U64) * K1 + K2)
    for j in range(length):
        if j and not (counts[counts > 0] >= length).all():
            live = np.flatnonzero(size > j)
            out[live] = mix((out[live] * K1) ^ h[begin[live] + j])
        else:
            out = mix((out * K1) ^ h[begin + j])
    return out, at


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    values = values.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    keep[heads] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], total[at]


def whole_groups(batches, key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``; memory holds a batch and one group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if last is not None and keys[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        tail = keys[-1]
        cut = int(np.flatnonzero(keys != tail)[-1]) + 1 if (keys != tail).any() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = tail
    if held:
        yield pa.Table.from_batches(held)


def unused(table, name: str) -> str:
    """``name``, with underscores before it until no column of ``table`` is called so."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(table, *names: str):
    """``table`` less any columns called so, for an operator that adds them."""
    return table.drop(*[c for c in table.columns if c.lower() in {n.lower() for n in names}])
