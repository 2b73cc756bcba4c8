"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    x = x if low is None else F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def spin(chosen: Column) -> Column:
    """-1 for false, 1 for true."""
    return F.when(chosen, 1).otherwise(-1)


def flat_action(node: Column, label: Column, labels: int) -> Column:
    return node * labels + label


def split_action(action: Column, labels: int) -> tuple[Column, Column]:
    return F.floor(action / labels), F.pmod(action, F.lit(labels))


def finite(x: Column, otherwise: float = 0.0) -> Column:
    """``otherwise`` for null, NaN and infinities."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(otherwise)).otherwise(x)


def nearest(x: Column, named: dict[str, float]) -> Column:
    """The name whose value is nearest; the first of equals by name."""
    pairs = [F.struct(F.abs(x - v), F.lit(k).alias("name")) for k, v in sorted(named.items())]
    return F.array_min(F.array(*pairs))["name"]


def l2_norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def median_low(values: Column) -> Column:
    """The lower of the two middle values of an array."""
    s = F.sort_array(values)
    return F.element_at(s, F.floor((F.size(s) + 1) / 2).cast("int"))


def mostly(test: Column, share: float = 0.9) -> Column:
    """Aggregate: whether ``test`` holds for at least ``share`` of the rows."""
    return F.avg(test.cast("int")) >= share


def masked_mean(x: Column, mask: Column) -> Column:
    """Aggregate: the mean of ``x`` where ``mask`` holds, 0 where it holds nowhere."""
    return F.coalesce(F.sum(F.when(mask, x)), F.lit(0.0)) / F.greatest(F.count(F.when(mask, 1)), F.lit(1))


def all_digits(text: Column) -> Column:
    """Whether the whole text is one or more decimal digits of any script."""
    return text.rlike(r"\A\p{Nd}+\z")


def inline_html(text: Column) -> Column:
    """Escapes ``&``, ``<`` and ``>``, then turns ``**bold**`` and backquoted spans within a line into elements."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    text = F.regexp_replace(text, r"\*\*([^\n\r\x{2028}\x{2029}]+?)\*\*", "<b>$1</b>")
    return F.regexp_replace(text, r"`([^\n\r\x{2028}\x{2029}]+?)`", "<code>$1</code>")
