r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as ``<|start|>role\ntext<|end|>\n`` per turn. The text
is parsed back by a deterministic grammar: split at ``<|start|>``, role up to the
first newline, text up to the first ``<|end|>``, which a newline and nothing else must follow, with
escapes undone; no role holds ``<|end|>``. Where the turns that come
back differ from the source, the fields at fault are escaped and the round trip is
run again; a conversation that still differs stops the job. Escaping adds a
backslash to every ``<\..\|`` run, so no escaped field holds ``<|``, and undoing it is
exact; a role, one line of the grammar, escapes backslashes, newlines and ``<|`` as pairs.
Conversations are rendered as they are where that already comes back identical.

The loss mask is a list of spans (start and length in code points) of the
assistant texts within the formatted text.

Defined results: null texts and roles are empty; a null turn comes first; turns of
equal number follow role, then text; a repeated row is a turn of its own; a null
conv_id is a conversation of its own; an empty table gives no rows. A conversation's
turns meet in one task, as one output row holds them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = "<|start|>", "<|end|>"
END = STOP + "\n"
#: A control string's opening, with any backslashes that escaping has put in.
_OPENING = r"<(\\*)\|"
_ESCAPED = r"<(\\*)\\\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _OPENING, r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"<$1|")


def escape_role(role: Column) -> Column:
    r"""Backslashes doubled, newlines as ``\n``, so that a role is one line without ``<|``."""
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("<|"), F.lit("<\\p"))


def unescape_role(role: Column) -> Column:
    """Undoes ``escape_role``: between doubled backslashes, read from the left, only its other two pairs remain."""
    parts = F.split(role, "\\\\\\\\", -1)  # at doubled backslashes
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("<\\p"), F.lit("<|")))
    return F.array_join(plain, "\\")


def render(turns: Column) -> Column:
    """turns: array of structs role, text as they are to be written."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: role, text, and the raw text with its start (code points from 1). What the grammar doesn't hold is a turn of nulls."""
    pieces = F.filter(F.split(formatted, r"<\|start\|>", -1), lambda x, i: i > 0)
    lengths = F.transform(pieces, F.length)
    # a piece begins behind all before it and its own start marker; lengths alone are summed up
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + len(START) + n)))
    heads = F.transform(F.arrays_zip(pieces.alias("p"), ends.alias("end")), lambda h: F.struct(h["p"].alias("p"), (h["end"] - F.length(h["p"])).alias("before"), F.instr(h["p"], "\n").alias("cut"), F.instr(h["p"], STOP).alias("stop")))

    def turn(h: Column) -> Column:
        whole = (h["cut"] > 0) & (h["stop"] > h["cut"]) & (h["stop"] == F.length(h["p"]) - len(END) + 1) & F.endswith(h["p"], F.lit(END))
        raw = F.when(whole, F.substring(h["p"], h["cut"] + 1, h["stop"] - h["cut"] - 1))
        role = F.when(whole, F.substring(h["p"], F.lit(1), h["cut"] - 1))
        return F.struct(unescape_role(role).alias("role"), unescape(raw).alias("text"), raw.alias("raw"), (h["before"] + h["cut"] + 1).cast("long").alias("start"))

    return F.transform(heads, turn)


def _same(parsed: Column, source: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == source


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and source, the turns in order as structs role, text."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    grouped = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return grouped.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))


def format_chats(rows: DataFrame, **columns) -> DataFrame:
    """conv_id, formatted, turns (as read back from it) and mask: spans (start, length) of assistant texts in it."""
    grouped = conversations(rows, **columns)
    # a turn is judged alone: its own rendering must come back as one turn, the same
    def field(t: Column) -> Column:
        own = F.struct(t["role"].alias("role"), t["text"].alias("text"))
        plain = (F.instr(t["role"], "\n") == 0) & (F.instr(t["role"], "\\") == 0) & (F.instr(t["role"], "<|") == 0) & (F.instr(t["text"], "<|") == 0) & (unescape(t["text"]) == t["text"])
        return F.when(plain, own).otherwise(F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")))

    first = grouped.withColumn("formatted", render(F.col("source"))).withColumn("parsed", parse(F.col("formatted")))
    second = first.withColumn("formatted", F.when(_same(F.col("parsed"), F.col("source")), F.col("formatted")).otherwise(render(F.transform("source", field))))
    third = second.withColumn("turns", parse(F.col("formatted")))
    sure = F.when(_same(F.col("turns"), F.col("source")), F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("a conversation does not come back from its formatted text: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    mask = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), F.length(t["raw"]).cast("long").alias("length")))
    return third.withColumn("turns", sure).select("conv_id", "formatted", "turns", mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its mask hold."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"].cast("int"), m["length"].cast("int")))), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
