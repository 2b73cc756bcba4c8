"""Fill-in-middle: documents cut in three, with the middle asked for last.

A text is cut into code points by the tokenizers library's ``Split`` pre-tokenizer,
every match isolated, nothing trained. The offset array has two levels: matches of
``BLOCK`` code points, the last of a text shorter, and within a block matches of one. The arrays' lengths
give n; the offsets of two ranks, drawn by hash of the id, are where prefix and
middle end, and only the blocks that hold them, and the last, are split into single code points.
Memory holds a batch, its outputs and an offset for each block.

Forms: ``plain``, the text as it is; ``psm``, prefix, suffix, middle, each after its
mark; ``spm``, suffix, prefix, middle. ``restored`` takes an output apart again, by
DataFrame functions: no text in a marked form holds a mark, so the split is exact.

Defined results: a null text is empty; empty texts and those that hold a mark stay plain;
cuts at the same place give an empty middle; a null id is drawn as 'null'; repeated ids are
cut alike; an empty table gives no rows; a column of ``docs`` that has the name of an added one
gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.textkit import text_column, unused, without

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output")
#: Code points of a block, code points split into blocks at a time (a multiple), and those after which outputs leave the task.
BLOCK, STRIDE, FLUSH = 256, 1 << 16, 8 << 20


class Units:
    """The code points of one text, by isolated matches: of blocks first, then of single ones in those blocks that are asked for."""

    def __init__(self, splits, text: str):
        coarse, self.single, self.text = *splits, text
        self.blocks = [at + span[0] for at in range(0, len(text), STRIDE) for _, span in coarse.pre_tokenize_str(text[at : at + STRIDE])]
        self.n = BLOCK * (len(self.blocks) - 1) + len(self._offsets(len(self.blocks) - 1)) if text else 0

    def _offsets(self, block: int) -> list[int]:
        first = self.blocks[block]
        return [first + span[0] for _, span in self.single.pre_tokenize_str(self.text[first : first + BLOCK])]

    def offset(self, rank: int) -> int:
        """Where the unit of this rank begins; the end of the text for rank n."""
        return len(self.text) if rank == self.n else self._offsets(rank // BLOCK)[rank % BLOCK]


def splitters():
    """Split pre-tokenizers of blocks and of single code points."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(f"(?m:.{{1,{BLOCK}}})"), "isolated"), Split(Regex("(?m:.)"), "isolated")


def draws(seed: int, key) -> list[int]:
    """Four 32-bit numbers of the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def cut(splits, text: str, key, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, output."""
    units = Units(splits, text)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return units.n, "plain", None, None, text
    low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.offset(low), units.offset(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < spm else "psm"
    front = (SUFFIX, suffix, PREFIX, prefix) if form == "spm" else (PREFIX, prefix, SUFFIX, suffix)
    return units.n, form, low, high - low, "".join((*front, MIDDLE, middle))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """Rows of ``docs`` with fim_n, fim_form, fim_prefix_chars, fim_middle_chars and fim_output. Of a hundred texts about ``rate`` are cut, ``spm`` of a hundred of these suffix first."""
    docs = without(docs, *ADDED)
    texts = unused(docs, "fim_text")
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, k) for c, k in zip(ADDED, kinds, strict=True)]])
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = splitters()

        def out(batch: pa.RecordBatch, first: int, rows: list[tuple]) -> pa.RecordBatch:
            own = batch.slice(first, len(rows))
            own = [own.column(k) for k in range(own.num_columns - 1)]
            return pa.RecordBatch.from_arrays([*own, *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]], [*batch.schema.names[:-1], *ADDED])

        for batch in batches:
            keys, column = batch.column(batch.schema.get_field_index(id_col)), text_column(batch.column(batch.num_columns - 1))
            rows, size, first = [], 0, 0
            for k in range(batch.num_rows):
                text = column[k].as_py()
                rows.append(cut(splits, text, keys[k].as_py(), seed, rate, spm))
                size += len(text)
                if size >= FLUSH:
                    yield out(batch, first, rows)
                    rows, size, first = [], 0, k + 1
            if rows:
                yield out(batch, first, rows)

    return docs.withColumn(texts, F.col(text_col)).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.get(parts, F.lit(k))
    first, second = F.when(form == "spm", part(2)).otherwise(part(1)), F.when(form == "spm", part(1)).otherwise(part(2))
    return F.when(form == "plain", output).otherwise(F.concat(first, part(3), second))
