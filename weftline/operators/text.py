"""Cleaning of extracted page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the text rules. White space and digits are those of Unicode.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
DIGITS = r"\p{Nd}+"
HYPHENS = (r"([A-Za-z])-\n([a-z])", rf"([A-Za-z])-{SPACE}*\n{SPACE}*([a-z])")
SOFT_HYPHEN = "\u00ad"
LINE_END = "\n\r\u2028\u2029"
MARKS = ((rf"\*\*([^{LINE_END}]+?)\*\*", "<b>$1</b>"), (rf"`([^{LINE_END}]+?)`", "<code>$1</code>"))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def block_text(text: Column) -> Column:
    """A block or line as extracted: soft hyphens go, blanks become one space, ends are stripped."""
    return stripped(F.regexp_replace(F.replace(text, F.lit(SOFT_HYPHEN), F.lit("")), r"[ \t]+", " "))


def line_form(line: Column) -> Column:
    """What running headers of several pages have in common: runs of digits as ``#``, white space as one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, DIGITS, "#"), rf"{SPACE}+", " ")))


def furniture(lines: DataFrame, page: str = "page", line: str = "line", share: float = 0.34, least: int = 3, length: int = 4, of: list[str] | None = None, pages: DataFrame | None = None) -> DataFrame:
    """key and n of line forms of at least ``length`` characters found on at least max(least, int(share * pages)) pages; by ``of`` (a document) where given.

    Equal lines of a page count once, and different ones of one form each. ``pages``: all pages, where some have no lines.
    """
    of = of or []
    every = (pages if pages is not None else lines).groupBy(*of).agg(F.greatest(F.lit(least), F.floor(F.countDistinct(page) * share)).alias("need"))
    keyed = lines.select(*of, page, line).distinct().select(*of, line_form(F.col(line)).alias("key")).where(F.length("key") >= length)
    counted = keyed.groupBy(*of, "key").agg(F.count("*").alias("n"))
    joined = counted.join(every, of) if of else counted.join(F.broadcast(every))  # one row where there is no key
    return joined.where(F.col("n") >= F.col("need")).select(*of, "key", "n")


def dehyphenate(text: Column) -> Column:
    """Words broken over lines are joined."""
    for pattern in HYPHENS:
        text = F.regexp_replace(text, pattern, "$1$2")
    return text


def clean(text: Column) -> Column:
    """A page's text: broken words joined, runs of empty lines squeezed to one, ends stripped."""
    return stripped(F.regexp_replace(dehyphenate(text), r"\n{3,}", "\n\n"))


def is_number(text: Column) -> Column:
    """Whether the text is digits and nothing else."""
    return F.coalesce(F.rlike(text, F.lit(r"^[0-9]+$")), F.lit(False)) & ~F.coalesce(F.contains(text, F.lit("\n")), F.lit(False))


def marked_up(text: Column) -> Column:
    """HTML of a line of text: escaped, with ``**bold**`` and ```code```."""
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    for pattern, to in MARKS:
        text = F.regexp_replace(text, pattern, to)
    return text
