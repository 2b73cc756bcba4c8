"""Connected components of a table of links, by hooking and pointer jumping.

Each round is a few joins and minimum aggregations; labels are written to the
shared folder after each, so lineage stays short and a lost executor costs one
round. The number of rounds is logarithmic in the longest chain. A hub's links,
and the members of a large component, are joined by broadcast (``hot_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch
from weftline.llm.skew import hot_join, hot_size


def connected_components(links: DataFrame, scratch: Scratch, name: str = "labels", most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); component is the smallest id reachable.

    No links give no rows. Repeated links and links of an id to itself do no harm.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a != b").distinct()
    edges = scratch.write(f"{name}_edges", both)
    total = edges.count()
    hubs = scratch.write(f"{name}_hubs", edges.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") >= hot_size(total)).select("b"))
    labels = scratch.write(f"{name}0", edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("f")))
    ids = labels.count()
    for n in range(1, most_rounds + 1):
        to = labels.select(F.col("id").alias("b"), F.col("f").alias("fb"))
        least = hot_join(edges, to, ["b"], total, hubs).groupBy(F.col("a").alias("id")).agg(F.min("fb").alias("m"))
        seen = labels.join(least, "id")
        offers = seen.select(F.col("f").alias("old"), F.explode(F.array(F.struct(F.col("id"), F.least("f", "m").alias("f"), F.col("f").alias("was")), F.struct(F.col("f").alias("id"), F.least("f", "m").alias("f"), F.lit(None).cast("long").alias("was")))).alias("x")).select("x.*")
        hooked = scratch.write(f"{name}{n}_hooked", offers.groupBy("id").agg(F.min("f").alias("f"), F.max("was").alias("old")))
        jump = hooked.select(F.col("id").alias("f"), F.col("f").alias("ff"))
        new = hot_join(hooked, jump, ["f"], ids).select("id", F.least("f", "ff").alias("f"), "old")
        written = scratch.write(f"{name}{n}", new)
        changed = written.where("f != old").limit(1).count()
        scratch.drop(f"{name}{n - 1}", f"{name}{n}_hooked")
        labels = written.select("id", "f")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    scratch.drop(f"{name}_edges", f"{name}_hubs")
    return labels.select("id", F.col("f").alias("component"))
