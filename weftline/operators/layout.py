"""Reading order and furniture of pages, from blocks of text with positions.

A block: doc, page, x0, y0, x1, y1, text; pages: doc, page, width, height. Positions come from any extractor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.text import block_text, clean, furniture, line_form

PAGE = ["doc", "page"]
#: Gutter candidates and margins as shares of the page, heading sizes in points.
GUTTER = {"from": 0.28, "to": 0.72, "steps": 240}
TOP, BOTTOM, EDGE_LENGTH = 0.085, 0.915, 120
SPARSE = 40
HEADING = {"large": 10.5, "bold": 8.5, "bold_length": 60, "length": 90}


def gutters(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, page, gutter: where a page of two columns is parted; no row for one of a single column.

    The best x has most blocks on its poorer side, less three for each block across it; the first of equals wins.
    """
    last = GUTTER["steps"] - 1
    x = lambda k: F.col("width") * (F.lit(GUTTER["from"]) + F.lit(GUTTER["to"] - GUTTER["from"]) * k / GUTTER["steps"])
    near = lambda v: F.greatest(F.least((F.try_divide(F.col(v), F.col("width")) - GUTTER["from"]) * (GUTTER["steps"] / (GUTTER["to"] - GUTTER["from"])), F.lit(float(last))), F.lit(1.0))

    def beyond(v: str, test) -> Column:
        """The first of the inner points that passes, one past the last if none does: the one reckoned or one beside it, told by the test itself."""
        k = F.coalesce(F.ceil(near(v)), F.lit(1)).cast("int")
        found = F.lit(last + 1)
        for step in (2, 1, 0, -1, -2):
            found = F.when((k + step >= 1) & (k + step <= last) & test(F.col(v), x(k + step)), k + step).otherwise(found)
        return found

    of = blocks.join(pages.select(*PAGE, "width"), PAGE).select(*PAGE, "width", beyond("x1", lambda v, at: v <= at).alias("k1"), beyond("x0", lambda v, at: v < at).alias("k0"), "x0")
    step = lambda k, left, right, n: F.struct(k.cast("int").alias("k"), F.lit(left).cast("long").alias("left"), F.lit(right).cast("long").alias("right"), F.lit(n).cast("long").alias("n"))
    right = F.col("x0").isNotNull().cast("long")
    # what a block adds from a point on: to the left of it, no more to the right of it, and at the first, to all
    steps = of.select(*PAGE, "width", F.explode(F.array(step(F.lit(1), 0, 0, 1).withField("right", right), step(F.col("k1"), 1, 0, 0), step(F.col("k0"), 0, 0, 0).withField("right", -right))).alias("s")).where(F.col("s.k") <= last)
    sums = steps.groupBy(*PAGE, "s.k").agg(F.first("width").alias("width"), *[F.sum(f"s.{c}").alias(c) for c in ("left", "right", "n")])
    upto = Window.partitionBy(*PAGE).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    # between two points where something changes all are equal, and the first wins
    at = sums.withColumns({c: F.sum(c).over(upto) for c in ("left", "right", "n")}).withColumn("cross", F.col("n") - F.col("left") - F.col("right"))
    found = at.where((F.col("n") >= 6) & (F.col("left") >= 4) & (F.col("right") >= 4) & (F.col("cross") <= F.greatest(F.lit(2), F.floor(F.col("n") * F.lit(0.15)))))
    return found.groupBy(*PAGE).agg(F.max_by(x(F.col("k")), F.struct(F.least("left", "right") - 3 * F.col("cross"), -F.col("k"))).alias("gutter"))


def ordered(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with their place in reading order, from 0: bands between full-width blocks, then columns, then top to bottom."""
    of = blocks.join(gutters(blocks, pages), PAGE, "left")
    wide = F.col("gutter").isNotNull() & (F.col("x0") < F.col("gutter")) & (F.col("x1") > F.col("gutter"))
    tops = F.collect_list(F.when(wide, F.col("y0"))).over(Window.partitionBy(*PAGE))
    band = F.size(F.filter("tops", lambda y: y < F.col("y0") - 2))
    column = F.when(F.col("gutter").isNull() | wide, 0).otherwise((F.col("x0") >= F.col("gutter")).cast("int"))
    place = Window.partitionBy(*PAGE).orderBy("band", "column", F.round("y0", 1), "x0", "y1", "text")
    return of.withColumn("tops", tops).withColumn("band", F.when(F.col("gutter").isNull(), 0).otherwise(band)).withColumn("column", column).withColumn("place", F.row_number().over(place) - 1).drop("tops", "gutter")


def page_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with their text cleaned, less those without any."""
    return blocks.withColumn("text", block_text(F.col("text"))).where("text != ''")


def edge_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Short lines that begin in the top margin or end in the bottom one, cleaned."""
    of = page_blocks(lines).join(pages.select(*PAGE, "height"), PAGE)
    return of.where(((F.col("y0") / F.col("height") < TOP) | (F.col("y1") / F.col("height") > BOTTOM)) & (F.length("text") <= EDGE_LENGTH)).drop("height")


def strip(texts: DataFrame, keys: DataFrame, key: list[str], text: str = "text", of: list[str] | None = None) -> DataFrame:
    """Texts less the lines whose form is one of ``keys`` (of the same document, where ``of`` names it), order kept, cleaned."""
    rows = texts.select(*key, F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("key", line_form(F.col("line")))
    kept = rows.join(keys.select(*(of or []), "key"), [*(of or []), "key"], "left_anti").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    joined = texts.select(*key).join(kept, key, "left")
    return joined.select(*key, F.coalesce(clean(F.array_join("l.line", "\n")), F.lit("")).alias(text))


def page_texts(blocks: DataFrame, lines: DataFrame, pages: DataFrame, keep: bool = False) -> DataFrame:
    """doc, page, cols (0 without blocks), gutter_x, text and chars of every page: blocks in reading order, furniture gone unless ``keep``, words and empty lines mended."""
    found = page_blocks(blocks)
    two = gutters(found, pages).select(*PAGE, F.round("gutter", 1).alias("gutter_x"))
    texts = ordered(found, pages).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("b")).select(*PAGE, F.array_join("b.text", "\n").alias("text"))
    if not keep:
        black = furniture(edge_lines(lines, pages), "page", "text", of=["doc"], pages=pages)
        texts = strip(texts, black, PAGE, of=["doc"])
    else:
        texts = texts.withColumn("text", clean(F.col("text")))
    of = pages.select(*PAGE).join(texts, PAGE, "left").join(two, PAGE, "left")
    cols = F.when(F.col("text").isNull(), 0).when(F.col("gutter_x").isNull(), 1).otherwise(2)
    return of.select(*PAGE, cols.alias("cols"), "gutter_x", F.coalesce("text", F.lit("")).alias("text")).withColumn("chars", F.length("text"))


def documents(made: DataFrame) -> DataFrame:
    """doc and its whole text, each page under a heading with its number and columns. A document's text is gathered in one row."""
    bar = "=" * 72
    n = F.count("*").over(Window.partitionBy("doc"))
    at = F.row_number().over(Window.partitionBy("doc").orderBy("page"))
    head = F.format_string(f"\n\n{bar}\n[page %d / %d]  cols=%d\n{bar}\n\n%s", at, n, F.col("cols"), F.col("text"))
    of = made.select("doc", at.alias("at"), head.alias("chunk"))
    return of.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "chunk"))).alias("c")).select("doc", F.array_join("c.chunk", "").alias("text"))


def meta(made: DataFrame, black: DataFrame) -> DataFrame:
    """doc and a JSON text of its pages, furniture and per-page figures."""
    per = made.groupBy("doc").agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(F.struct("page", "cols", "gutter_x", "chars"))).alias("per_page"))
    gone = black.groupBy("doc").agg(F.array_sort(F.collect_list("key")).alias("furniture_removed"))
    of = per.join(gone, "doc", "left").withColumn("furniture_removed", F.coalesce("furniture_removed", F.array().cast("array<string>")))
    return of.select("doc", F.to_json(F.struct("pages", "furniture_removed", "per_page")).alias("json"))


def outline(lines: DataFrame) -> DataFrame:
    """doc, page, size (one decimal), bold and text of headings. ``lines`` have size (their largest) and bold (any part)."""
    return page_blocks(lines).where(heading(F.col("size"), F.col("bold"), F.col("text"))).select(*PAGE, F.round("size", 1).alias("size"), "bold", "text")


def heading(size: Column, bold: Column, text: Column) -> Column:
    return (F.length(text) <= HEADING["length"]) & ((size >= HEADING["large"]) | (bold & (size >= HEADING["bold"]) & (F.length(text) < HEADING["bold_length"])))


def page_stats(texts: DataFrame, two: DataFrame) -> DataFrame:
    """Per document: pages, pages of two columns, characters, pages of fewer than 40."""
    of = texts.join(two.select(*PAGE, F.lit(1).alias("two")), PAGE, "left")
    return of.groupBy("doc").agg(F.count("*").alias("pages"), F.count("two").alias("two_columns"), F.sum(F.length("text")).cast("long").alias("chars"), F.sum((F.length("text") < SPARSE).cast("long")).alias("sparse"))


def axis(ticks: DataFrame, key: list[str]) -> DataFrame:
    """Slope and offset from position to value, by the outermost ticks of each axis."""
    ends = ticks.groupBy(*key).agg(F.min(F.struct("position", "value")).alias("_low"), F.max(F.struct("position", "value")).alias("_high"))
    slope = (F.col("_high.value") - F.col("_low.value")) / (F.col("_high.position") - F.col("_low.position"))
    return ends.select(*key, slope.alias("slope"), (F.col("_low.value") - slope * F.col("_low.position")).alias("offset"))
