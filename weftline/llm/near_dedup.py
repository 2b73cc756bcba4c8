"""MinHash near-duplicate detection by a chosen-path set similarity join.

A document is the set of its distinct word shingles, kept as 64-bit hashes.
Documents with equal sets form a class and are compared once. Each of several
independent trees branches the classes by minwise tokens: a node picks one or
two of the signature's positions (1/similarity on average, from a hash of the
node), and every class in it moves to the child that its token there names.
Nodes of at most ``node_limit`` classes are compared exhaustively; larger ones
branch again.

The trees run in two rounds. The first takes the top nodes of two trees, large
ones in random blocks; its links settle most groups. The second takes all trees
with the components found: a node whose classes are of one component has nothing
to add and ends there, and only classes of different components are compared.
Large nodes of several components that branching no longer takes apart are solved
exactly: those that share classes are put together, and the classes outside the
largest component are compared with all others by their sketches, tile by tile.

Comparisons read sketches (a byte of each of 64 minhashes); links are confirmed
on full sets made from the whole texts, one set a document and round. A node
gives a spanning forest of its links, never all pairs, and components over all
links are the groups.

Defined results: null and empty texts, and those without words, have an empty
set and are linked with nothing; null ids are linked with nothing and kept, with
a null component; a repeated row gets the same component each time; rows that
share an id but not a text are judged by text. Ties go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import textkit as tk
from weftline.llm.components import connected_components
from weftline.llm.scratch import Scratch
from weftline.llm.skew import hot_join, hot_size

U64 = np.uint64


@dataclass(frozen=True)
class ChosenPath:
    """``shingle`` words; similarity in hundredths; trees, and those of the first round; signature length; most classes compared exhaustively; most classes of a random block of a larger node; share of the rows of large nodes that a level may leave for the next to branch on; most ids that a broadcast picks texts by."""

    shingle: int = 5
    similarity: int = 80
    trees: int = 12
    first_trees: int = 2
    signature: int = 64
    node_limit: int = 600
    block: int = 256
    shrink: float = 0.9
    most_broadcast: int = 1_000_000
    sketch_slack: float = 4.2
    seed: int = 1

    def depth(self, classes: int) -> int:
        """Levels of branching: more for more classes, as what common shingles put together shrinks by a factor each."""
        return 4 + int(np.ceil(np.log10(max(classes, 10)) / 2.5))

    def least_equal(self) -> int:
        """Equal sketch bytes that a linked pair reaches but for ``sketch_slack`` standard deviations."""
        p, n = self.similarity / 100, self.signature
        return int(n * p - self.sketch_slack * (n * p * (1 - p)) ** 0.5)


def features(docs: DataFrame, id_col: str, text_col: str, cfg: ChosenPath) -> DataFrame:
    """doc_id, n_shingles, the set's digest (d1, d2) and its minhash signature (empty for an empty set)."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.array([tk.mix_int(cfg.seed, 11, i) for i in range(cfg.signature)], U64)
        odd = np.array([tk.mix_int(cfg.seed, 12, i) | 1 for i in range(cfg.signature)], U64)
        for batch in batches:
            ids, texts = batch.column(0), tk.text_column(batch.column(1))
            for lo, hi, data, at in tk.chunks(texts):
                values, at = tk.distinct(*tk.runs(tk.Words(data, at, tk.SPACED), cfg.shingle))
                n = np.diff(at)
                full = np.flatnonzero(n)
                sig = np.zeros((len(full), cfg.signature), U64)
                d1, d2 = np.zeros(hi - lo, U64), np.zeros(hi - lo, U64)
                if len(full):
                    heads = at[:-1][full]
                    for i in range(cfg.signature):
                        sig[:, i] = np.minimum.reduceat((values ^ salt[i]) * odd[i], heads)
                    d1[full] = np.add.reduceat(tk.mix(values), heads)
                    d2[full] = np.add.reduceat(tk.mix(values ^ tk.K3), heads)
                size = np.zeros(hi - lo + 1, np.int32)
                size[1:][full] = 8 * cfg.signature
                sigs = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.cumsum(size, dtype=np.int32)), pa.py_buffer(sig)])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(tk.as_long(d1)), pa.array(tk.as_long(d2)), sigs], ["doc_id", "n_shingles", "d1", "d2", "sig"])

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(per_batch, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def _signatures(batch: pa.RecordBatch, name: str, cfg: ChosenPath) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.frombuffer(b"".join(column.to_pylist()), U64).reshape(len(column), cfg.signature)


def roots(sigs: DataFrame, cfg: ChosenPath, trees: range) -> DataFrame:
    """(node, doc_id, f) of the first level of some trees; trees start at different positions. ``f`` is the component so far."""

    def per_batch(batches):
        order = np.argsort([tk.mix_int(cfg.seed, 21, i) for i in range(cfg.signature)])
        picks, n = [], 0
        for tree in range(cfg.trees):
            for _ in range(_picks(tk.mix_int(cfg.seed, 22, tree), cfg)):
                if tree in trees:
                    picks.append((tk.mix_int(cfg.seed, 23, tree), int(order[n % cfg.signature])))
                n += 1
        for batch in batches:
            sig = _signatures(batch, "sig", cfg)
            for tree, i in picks:
                node = tk.mix(sig[:, i] ^ U64(tk.mix_int(tree, i)))
                yield pa.RecordBatch.from_arrays([pa.array(tk.as_long(node)), batch.column(0), batch.column(1)], ["node", "doc_id", "f"])

    return sigs.select("doc_id", "f", "sig").mapInArrow(per_batch, "node long, doc_id long, f long")


def _picks(h: int, cfg: ChosenPath) -> int:
    """Positions that a node picks: 1/similarity on average, at least one."""
    return 1 + (h % 10_000 < (100 / cfg.similarity - 1) * 10_000)


def _gathered(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``table`` joined once a document to the list of its ``key``s: a few for each tree."""
    return rows.groupBy("doc_id").agg(F.collect_list(key).alias("keys")).join(table, "doc_id")


def _dealt(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The flat keys of a batch of ``_gathered`` and the row of each."""
    keys = batch.column(batch.schema.get_field_index("keys"))
    return keys.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy(zero_copy_only=False))


def branch(large: DataFrame, sigs: DataFrame, cfg: ChosenPath) -> DataFrame:
    """(node, doc_id, f) of the children of large nodes."""

    def per_batch(batches):
        for batch in batches:
            sig = _signatures(batch, "sig", cfg)
            key, row = _dealt(batch)
            nodes, where = np.unique(key, return_inverse=True)
            position = np.full((len(nodes), 2), -1)
            for k, node in enumerate(nodes.tolist()):
                for j in range(_picks(tk.mix_int(cfg.seed, 24, node), cfg)):
                    position[k, j] = tk.mix_int(cfg.seed, 25 + j, node) % cfg.signature
            for j in range(2):
                at = position[where, j]
                on = np.flatnonzero(at >= 0)
                child = tk.mix(sig[row[on], at[on]] ^ tk.mix(nodes[where[on]].view(U64) + U64(j + 1)) ^ (at[on].astype(U64) * tk.K1))
                of = pa.array(row[on])
                yield pa.RecordBatch.from_arrays([pa.array(tk.as_long(child)), batch.column(0).take(of), batch.column(1).take(of)], ["node", "doc_id", "f"])

    return _gathered(large, "node", sigs).select("doc_id", "f", "sig", "keys").mapInArrow(per_batch, "node long, doc_id long, f long")


def in_several(level: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows of nodes that hold more than one component, with the node's number of rows ``n``."""
    level = scratch.write(name, level)
    total = level.count()
    sizes = level.groupBy("node").agg(F.count("*").alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi")).where("lo < hi").select("node", "n")
    sizes = scratch.write(f"{name}_sizes", sizes)
    found = scratch.write(f"{name}_several", hot_join(level, sizes, ["node"], total, sizes.where(F.col("n") >= hot_size(total)).select("node")))
    scratch.drop(name, f"{name}_sizes")
    return found


def random_blocks(large: DataFrame, cfg: ChosenPath, seed: int) -> DataFrame:
    """(node, doc_id): rows of large nodes dealt to blocks of about ``block``, each block a node of its own."""
    spot = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.ceil(F.col("n") / cfg.block).cast("long"))
    return large.select(F.xxhash64("node", spot, F.lit(seed)).alias("node"), "doc_id")


def candidates(small: DataFrame, sigs: DataFrame, cfg: ChosenPath) -> DataFrame:
    """(cand, doc_id): the classes of each small node that by their sketches have a partner of another component there; equal lists once."""
    need = cfg.least_equal()

    def sketch(batches):
        for batch in batches:
            sig = _signatures(batch, "sig", cfg)
            key, row = _dealt(batch)
            bytes_ = ((sig * tk.K1) >> U64(56)).astype(np.uint8)
            for part in range(0, len(key), 1 << 14):
                of = row[part : part + (1 << 14)]
                flat = pa.Array.from_buffers(pa.binary(cfg.signature), len(of), [None, pa.py_buffer(np.ascontiguousarray(bytes_[of]))])
                yield pa.RecordBatch.from_arrays([pa.array(key[part : part + (1 << 14)]), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), flat.cast(pa.binary())], ["node", "doc_id", "f", "sketch"])

    def compare(batches):
        for table in tk.whole_groups(batches, "node"):
            table = table.combine_chunks()
            node, ids, f = (table.column(c).to_numpy() for c in ("node", "doc_id", "f"))
            sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), cfg.signature)
            hit = np.zeros(len(ids), bool)
            for gap in range(1, len(ids)):
                left = np.flatnonzero(node[gap:] == node[:-gap])
                if not len(left):
                    break
                left = left[f[left] != f[left + gap]]
                for part in range(0, len(left), 1 << 16):
                    one = left[part : part + (1 << 16)]
                    close = one[(sk[one] == sk[one + gap]).sum(1) >= need]
                    hit[close] = hit[close + gap] = True
            found = _lists(node[hit], ids[hit])
            if found is not None:
                yield found

    sketched = _gathered(small, "node", sigs).select("doc_id", "f", "sig", "keys").mapInArrow(sketch, "node long, doc_id long, f long, sketch binary")
    lists = sketched.repartition("node").sortWithinPartitions("node").mapInArrow(compare, "cand long, ids array<long>")
    return lists.dropDuplicates(["cand"]).select("cand", F.explode("ids").alias("doc_id"))


def _lists(node: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
    """(cand, ids): the ids of each node, under a hash of the list."""
    if not len(ids):
        return None
    order = np.lexsort((ids, node))
    node, ids = node[order], ids[order]
    heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    mark = tk.mix(tk.mix(ids.view(U64) + tk.K2))
    cand = tk.mix(np.add.reduceat(mark, heads) + np.diff(np.append(heads, len(ids))).astype(U64))
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(ids)).astype(np.int32)), pa.array(ids))
    return pa.RecordBatch.from_arrays([pa.array(tk.as_long(cand)), lists], ["cand", "ids"])


def _links_of(ids: list[int], sets: list[np.ndarray], similarity: int) -> list[tuple[int, int]]:
    """(index, index of its component's smallest id) within one node, by breadth-first search over exact similarities."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = int(np.isin(sets[0], sets[1], assume_unique=True).sum()) if abs(size[0] - size[1]) * similarity <= 100 * size.max() else 0
        union = int(size.sum()) - both
        return [(0, 0), (1, 0)] if both and 100 * both >= similarity * union else [(0, 0), (1, 1)]
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(n), size)
    mark = np.zeros(int(token.max()) + 1 if len(token) else 1, bool)
    open_ = np.ones(n, bool)
    out = []
    for start in range(n):
        if not open_[start]:
            continue
        open_[start] = False
        queue, group = [start], []
        while queue:
            x = queue.pop()
            group.append(x)
            if not open_.any():
                continue
            mine = token[at[x] : at[x + 1]]
            mark[mine] = True
            both = np.bincount(row[mark[token]], minlength=n)
            mark[mine] = False
            near = np.flatnonzero(open_ & (both > 0) & (100 * both >= similarity * (size[x] + size - both)))
            open_[near] = False
            queue.extend(near.tolist())
        head = min(group, key=lambda k: ids[k])
        out.extend((x, head) for x in group)
    return out


def confirm(members: DataFrame, docs: DataFrame, cfg: ChosenPath) -> DataFrame:
    """(a, b): a spanning forest of the exact links within each ``cand`` of ``members`` (cand, doc_id)."""

    def sets_of(batches):
        for batch in batches:
            key, row = _dealt(batch)
            ids = batch.column(0).to_pylist()
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for lo, hi, data, at in tk.chunks(tk.text_column(batch.column(1))):
                values, at = tk.distinct(*tk.runs(tk.Words(data, at, tk.SPACED), cfg.shingle))
                out, size = [], 0
                for k in range(first[lo], first[hi]):
                    one = values[at[row[k] - lo] : at[row[k] - lo + 1]].tobytes()
                    out.append((key[k], ids[row[k]], one))
                    size += len(one)
                    if size > tk.CHUNK_BYTES or k + 1 == first[hi]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["cand", "doc_id", "values"])
                        out, size = [], 0

    def exact(batches):
        for table in tk.whole_groups(batches, "cand"):
            cand = table.column("cand").to_numpy()
            ids = table.column("doc_id").to_pylist()
            sets = [np.frombuffer(x, U64) for x in table.column("values").to_pylist()]
            heads = np.flatnonzero(np.concatenate([[True], cand[1:] != cand[:-1]])).tolist()
            out = []
            for a, b in zip(heads, [*heads[1:], len(ids)], strict=True):
                out += [(ids[a + x], ids[a + y]) for x, y in _links_of(ids[a:b], sets[a:b], cfg.similarity) if ids[a + x] != ids[a + y]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    wanted = members.select("doc_id").distinct()
    if wanted.count() <= cfg.most_broadcast:
        docs = docs.join(F.broadcast(wanted), "doc_id", "left_semi")
    sets = _gathered(members, "cand", docs).select("doc_id", "text", "keys").mapInArrow(sets_of, "cand long, doc_id long, values binary")
    return sets.repartition("cand").sortWithinPartitions("cand").mapInArrow(exact, "a long, b long").distinct()


def tiles(left: DataFrame, sigs: DataFrame, scratch: Scratch, cfg: ChosenPath) -> DataFrame:
    """(node, doc_id): what no branching takes apart, as tiles of at most twice ``node_limit`` classes.

    Nodes of several trees that share classes are put together and solved once. In each such group the classes outside its largest
    component meet all of the group: a class is repeated once for each ``node_limit`` classes of the other side.
    """
    stars = left.join(left.groupBy("node").agg(F.min("doc_id").alias("a")), "node").select("a", F.col("doc_id").alias("b"))
    group = connected_components(stars, scratch, "tiled").select(F.col("id").alias("doc_id"), F.col("component").alias("group"))
    rows = scratch.write("left", group.join(sigs.select("doc_id", "f"), "doc_id").distinct())
    parts = rows.groupBy("group", "f").agg(F.count("*").alias("c"))
    main = parts.groupBy("group").agg(F.sum("c").alias("n"), F.max(F.struct("c", "f")).alias("m")).select("group", "n", F.col("m.f").alias("main"), (F.col("n") - F.col("m.c")).alias("r")).where("r > 0")
    sized = hot_join(rows, main, ["group"], rows.count())
    count = lambda c: F.ceil(F.col(c) / cfg.node_limit).cast("long")
    spot = lambda seed, c: F.pmod(F.xxhash64("doc_id", F.lit(seed)), count(c))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), count(c) - 1))
    loose = sized.where("f != main").select("group", "doc_id", spot(31, "r").alias("i"), upto("n").alias("j"))
    every = sized.select("group", "doc_id", upto("r").alias("i"), spot(32, "n").alias("j"))
    made = scratch.write("tiles", loose.unionByName(every).distinct().select(F.xxhash64("group", "i", "j", F.lit(33)).alias("node"), "doc_id"))
    scratch.drop("left")
    return made


class _Groups:
    """Classes, their components so far, and the rounds that find links between them."""

    def __init__(self, sigs: DataFrame, texts: DataFrame, scratch: Scratch, cfg: ChosenPath):
        self.sigs, self.texts, self.scratch, self.cfg = sigs, texts, scratch, cfg
        self.links: list[DataFrame] = []
        self.rounds = 0

    def link(self, members: DataFrame) -> DataFrame | None:
        """Links confirmed among ``members``, kept; (id, component) by all links so far, or None without new ones."""
        n, self.rounds = self.rounds, self.rounds + 1
        members = self.scratch.write(f"members{n}", members)
        made = self.scratch.write(f"links{n}", confirm(members, self.texts, self.cfg))
        self.scratch.drop(f"members{n}")
        if not made.limit(1).count():
            return None
        self.links.append(made)
        every = self.links[0]
        for more in self.links[1:]:
            every = every.unionByName(more)
        return connected_components(every, self.scratch, f"round{n}")

    def relabel(self, found: DataFrame | None) -> None:
        if found is None:
            return
        n = self.rounds
        joined = self.sigs.drop("f").join(found.select(F.col("id").alias("doc_id"), F.col("component").alias("f")), "doc_id", "left")
        self.sigs = self.scratch.write(f"signatures{n}", joined.select("doc_id", F.coalesce("f", "doc_id").alias("f"), "sig"))


def _settled(sigs: DataFrame, texts: DataFrame, scratch: Scratch, cfg: ChosenPath) -> DataFrame | None:
    """(id, component) of all classes that are linked, or None where none are. ``sigs``: doc_id, f, sig."""
    groups = _Groups(sigs, texts, scratch, cfg)
    limit = cfg.node_limit
    top = in_several(roots(groups.sigs, cfg, range(cfg.first_trees)), scratch, "first")
    small, large = top.where(F.col("n") <= limit), top.where(F.col("n") > limit)
    blocks = random_blocks(large, cfg, 41).unionByName(random_blocks(large, cfg, 42))
    found = groups.link(candidates(small.select("node", "doc_id").unionByName(blocks), groups.sigs, cfg))
    groups.relabel(found)

    rest = roots(groups.sigs, cfg, range(cfg.first_trees, cfg.trees))
    if large.limit(1).count():
        rest = rest.unionByName(branch(large.select("node", "doc_id"), groups.sigs, cfg))
    level, smalls, left, before = in_several(rest, scratch, "level0"), [], None, None
    depths = cfg.depth(sigs.count())
    for depth in range(depths):
        smalls.append(level.where(F.col("n") <= limit).select("node", "doc_id"))
        large = level.where(F.col("n") > limit).select("node", "doc_id")
        rows = large.count()
        if not rows:
            break
        if depth + 1 == depths or before and rows > cfg.shrink * before:
            left = large
            break
        level, before = in_several(branch(large, groups.sigs, cfg), scratch, f"level{depth + 1}"), rows
    small = smalls[0]
    for more in smalls[1:]:
        small = small.unionByName(more)
    more = groups.link(candidates(small, groups.sigs, cfg))
    groups.relabel(more)
    found = more if more is not None else found
    if left is not None:
        more = groups.link(candidates(tiles(left, groups.sigs, scratch, cfg), groups.sigs, cfg))
        found = more if more is not None else found
    scratch.drop("first_several", "tiles", *[f"level{d}_several" for d in range(depths)], *[f"signatures{n}" for n in range(groups.rounds + 1)])
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: ChosenPath = ChosenPath()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept (doc_id = component_id), class_id (smallest id with the same set)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    made = scratch.write("features", features(docs, id_col, text_col, cfg))
    in_play = made.where("n_shingles > 0 and doc_id is not null")
    classes = in_play.groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.write("classes", classes)
    sigs = classes.select(F.col("class_id").alias("doc_id"), F.col("class_id").alias("f"), "sig")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _settled(sigs, texts, scratch, cfg)

    labels = classes.select("d1", "d2", "class_id", "n")
    if found is not None:
        labels = labels.join(found.select(F.col("id").alias("class_id"), F.col("component").alias("component_id")), "class_id", "left").withColumn("component_id", F.coalesce("component_id", "class_id"))
    else:
        labels = labels.withColumn("component_id", F.col("class_id"))
    labels = scratch.write("labels", labels)
    slim = made.select("doc_id", "n_shingles", "d1", "d2")
    total = made.count()
    told = hot_join(slim.where("n_shingles > 0"), labels, ["d1", "d2"], total, labels.where(F.col("n") >= hot_size(total)).select("d1", "d2"), how="left")
    none = F.lit(None).cast("long")
    bare = slim.where("n_shingles = 0").select("*", none.alias("class_id"), none.alias("n"), F.col("doc_id").alias("component_id"))
    joined = told.unionByName(bare)
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: ChosenPath = ChosenPath()) -> DataFrame:
    """The rows of ``docs`` whose document is its group's smallest id; where an id repeats, the row of its smallest text, once. Null ids stay."""
    found = near_duplicates(docs, id_col, text_col, cfg)
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    gone = ids.where("not kept").select(F.col("doc_id").alias(id_col))
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    again = ids.where("kept and rows > 1").select(F.col("doc_id").alias(id_col))
    if not again.limit(1).count():
        return kept
    rank = tk.unused(docs, "rank")
    several = kept.join(again, id_col, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())))
    return kept.join(again, id_col, "left_anti").select(*docs.columns).unionByName(several.where(F.col(rank) == 1).select(*docs.columns))
