"""A Merkle manifest of a table, in DataFrame functions: digests that prove each row's place in one root.

Leaves of a group are ranked by id without a global sort. Ids are read as digits of
eight bits: a bucket is all ids that agree but for the last digit, and a
histogram of buckets is summed up digit by digit to ever shorter prefixes. A bucket's first
rank is the number of rows of the group in smaller digits of each prefix of it, one running sum
over at most 256 digits a prefix; within a bucket, of at most 256 different ids, rows are
put in order. So no task sees more than a bucket, whatever one group holds.

A rank, written in as many digits of base ``fanout`` as the group's size needs, is the key of a
trie's node. Nodes with the longest keys meet at their key less its last digit, their run, whose
digest is that of theirs in order; after as many rounds as digits a group has one node left,
its subroot. Subroots, in order of group, form a trie of the same kind, up to the root. Every
level's runs are written, so a lost executor costs one level. Then paths go down: a node's siblings to
its left and right, and its parent's path. What moves is ids and digests, never texts.

Defined results: a null field is ``-`` in a leaf, and so differs from an empty one; a null id counts as the smallest integer; rows
of one id stand in order of their digest, repeated rows one after another, each with a place of its
own; a null group is a group, the first; a lone leaf is its group's subroot, and a lone subroot the root; an empty
table gives no rows. Different rows that share one id meet in one task, as do the subroots, one row a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch

#: Bits of a digit of an id.
DIGIT = 8
_PATH = "array<struct<left:string,right:string>>"


def leaf(*fields: Column) -> Column:
    """Digest of fields, each as its length in bytes, a colon and itself, or ``-`` if null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, digest, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def _before(count: str, by: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(w), F.lit(0))


def ranked(rows: DataFrame, group: str, id_col: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with rank, from 0 in each group by ``id_col`` (a long without nulls), then by the columns ``order``; and group_size. Needs no other columns of these names, nor digit columns."""
    same = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")).withColumn("bucket", F.shiftright(id_col, DIGIT))
    low, high = rows.agg(F.min(id_col), F.max(id_col)).first()
    counts = [scratch.write("digits1", same.groupBy(group, "bucket").agg(F.sum("copies").alias("held")))]
    shift = DIGIT
    while low is not None and (high >> shift) - (low >> shift) >= 1 << DIGIT:
        shift += DIGIT
        counts.append(scratch.write(f"digits{shift // DIGIT}", counts[-1].groupBy(group, F.shiftright("bucket", DIGIT).alias("bucket")).agg(F.sum("held").alias("held"))))
    sizes = counts[-1].groupBy(group).agg(F.sum("held").alias("group_size"))
    first = counts[-1].select(group, "bucket", _before("held", [group], ["bucket"]).alias("first")).join(sizes, group)
    for finer in reversed(counts[:-1]):
        up = first.withColumnsRenamed({"bucket": "up", "first": "up_first"})
        first = finer.withColumn("up", F.shiftright("bucket", DIGIT)).withColumn("within", _before("held", [group, "up"], ["bucket"])).join(up, [group, "up"])
        first = first.select(group, "bucket", (F.col("up_first") + F.col("within")).alias("first"), "group_size")
    first = scratch.write("firsts", first)
    placed = same.withColumn("within", _before("copies", [group, "bucket"], [id_col, *order])).join(first, [group, "bucket"])
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    out = placed.select(*rows.columns, "first", "within", "group_size", copy)
    return out.select(*rows.columns, (F.col("first") + F.col("within") + F.col("copy")).alias("rank"), "group_size")


def _digits(number: Column, base: int) -> Column:
    return F.conv(number.cast("string"), 10, base)


def _depth(size: Column, base: int) -> Column:
    """Digits of the largest rank; none for a lone node."""
    return F.when(size > 1, F.length(_digits(size - 1, base))).otherwise(0)


def keyed(rows: DataFrame, base: int) -> DataFrame:
    """rank and group_size replaced by key, the rank in ``base``, with a digit for each level of the group's trie."""
    depth = _depth(F.col("group_size"), base)
    key = F.when(depth > 0, F.lpad(_digits(F.col("rank"), base), depth, "0")).otherwise("")
    return rows.withColumn("key", key).drop("rank", "group_size")


def climb(nodes: DataFrame, rounds: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """Runs by level: grp, key, kids (structs of digit, digest and what else ``nodes`` hold), digest. ``nodes``: grp, key, digest, ..."""
    levels = []
    for n in range(rounds):
        kid = F.struct(F.right("key", F.lit(1)).alias("digit"), *[c for c in nodes.columns if c not in ("grp", "key")])
        parent = F.expr("substring(key, 1, length(key) - 1)")
        runs = nodes.where("key != ''").groupBy("grp", parent.alias("key")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        levels.append(scratch.write(f"{name}{n}", runs.withColumn("digest", F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), ""), 256))))
        nodes = levels[-1].select("grp", "key", "digest")
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """grp, digest and depth of the one node that is left of each group."""
    out = nodes.where("key = ''").select("grp", "digest", F.lit(0).alias("depth"))
    for n, runs in enumerate(levels, 1):
        out = out.unionByName(runs.where("key = ''").select("grp", "digest", F.lit(n).alias("depth")))
    return out


def descend(levels: list[DataFrame], of: DataFrame) -> DataFrame:
    """Leaves under ``of`` (grp, depth, path, ...): columns of ``of`` but depth, with path from each leaf up, and kid, the leaf's own struct."""
    kept = [c for c in of.columns if c not in ("grp", "depth", "path")]
    at = None
    for n in reversed(range(len(levels))):
        tip = of.where(F.col("depth") == n + 1).select("grp", F.lit("").alias("key"), "path", *kept)
        at = tip if at is None else at.unionByName(tip)
        down = levels[n].drop("digest").join(at, ["grp", "key"]).select("grp", "key", "path", *kept, "kids", F.posexplode("kids").alias("place", "kid"))
        some = lambda a: F.array_join(F.transform(a, lambda k: k["digest"]), "")
        beside = F.struct(some(F.slice("kids", F.lit(1), F.col("place"))).alias("left"), some(F.slice("kids", F.col("place") + 2, F.size("kids"))).alias("right"))
        at = down.select("grp", F.concat("key", "kid.digit").alias("key"), F.concat(F.array(beside), "path").alias("path"), *kept, *(["kid"] if n == 0 else []))
    return at


def manifest(leaves: DataFrame, id_col: str = "doc_id", group_col: str = "source", digest_col: str = "leaf", fanout: int = 16) -> DataFrame:
    """Each row of ``leaves`` with subroot, root and path: structs left, right of its siblings' digests, from the leaf's level up.

    ``leaves`` holds a long id, a string group, a digest (see ``leaf``) and any small columns that are to go along, none named subroot, root or path.
    ``fanout`` is from 2 to 36.
    """
    if not 2 <= fanout <= 36:
        raise ValueError("fanout must be from 2 to 36")
    scratch = Scratch(leaves.sparkSession, "merkle")
    given = scratch.write("leaves", leaves)
    grp = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col)))
    row = F.struct(*[F.col(c) for c in leaves.columns])
    rows = given.select(grp.alias("grp"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(digest_col).alias("digest"), row.alias("row"))
    placed = ranked(rows, "grp", "id", ["digest", "row"], scratch)
    nodes = scratch.write("nodes", keyed(placed, fanout).drop("id"))
    deepest = nodes.agg(F.max(F.length("key"))).first()[0] or 0
    levels = climb(nodes, deepest, scratch, "runs")
    found = scratch.write("subroots", tops(nodes, levels))
    order = Window.orderBy("grp")  # one row a group
    above = found.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest", "depth", (F.row_number().over(order) - 1).cast("long").alias("rank"))
    above = keyed(above.withColumn("group_size", F.lit(found.count())), fanout)
    upper = climb(above, above.agg(F.max(F.length("key"))).first()[0] or 0, scratch, "upper")
    root = tops(above, upper)
    empty = F.array().cast(_PATH)
    if upper:
        under = descend(upper, root.select("grp", "depth", empty.alias("path"), F.col("digest").alias("root")))
        under = under.select(F.col("kid.of").alias("grp"), F.col("kid.depth").alias("depth"), "path", F.col("kid.digest").alias("subroot"), "root")
    else:
        under = above.select(F.col("of").alias("grp"), "depth", empty.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    under = scratch.write("paths", under)
    lone = nodes.where("key = ''").join(under, "grp").select("row.*", "subroot", "root", "path")
    if not levels:
        return lone
    return descend(levels, under).select("kid.row.*", "subroot", "root", "path").unionByName(lone)
