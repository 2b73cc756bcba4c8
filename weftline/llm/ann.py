"""Nearest neighbours by a robust-pruned directed graph, one per shard.

Equal vectors are collapsed first (the ``top`` + 1 smallest ids of each suffice for
any answer), so a vector that makes up a third of the table is one node. Distinct
vectors are dealt to shards of about ``shard_rows`` by hash. A shard's graph is built
in batches: a greedy beam search from the shard's medoid proposes neighbours, robust
pruning keeps a candidate unless a kept one is closer to it by the factor ``alpha``,
and reverse edges are pruned alike. Queries go to the shards in blocks; a beam
search answers them there, and the best of all shards are merged. Scores are exact
distances in double precision on the original vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors are compared with those of equal length only; null ids
take no part; ties go to the smaller id; a repeated id counts once for each vector it
has, and never answers itself; fewer candidates give fewer rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch


@dataclass(frozen=True)
class Graph:
    """Out-degree, beam of building and of queries, relaxation, rows of a shard and of a block of queries, blocks that one task searches in a shard."""

    degree: int = 32
    build_beam: int = 48
    query_beam: int = 96
    alpha: float = 1.2
    shard_rows: int = 8192
    query_rows: int = 2048
    blocks_a_task: int = 16
    batch: int = 512


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``a`` (n x d) to its own rows of ``b`` (n x k x d)."""
    d = b - a[:, None, :]
    return np.einsum("nkd,nkd->nk", d, d)


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes that a greedy search from ``start`` meets, nearest first, and their squared distances; -1 and inf where fewer."""
    q = len(queries)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = distances(queries, np.broadcast_to(x[start], (q, 1, x.shape[1])))[:, 0]
    live = np.arange(q)
    while len(live):
        at = np.argmin(done[live], axis=1)  # the nearest that is still open
        node = ids[live, at]
        done[live, at] = True
        near = graph[node]
        mine = ids[live]
        new = near >= 0
        new &= ~(near[:, :, None] == mine[:, None, :]).any(2)
        d = np.where(new, distances(queries[live], x[np.maximum(near, 0)]), np.inf)
        all_ids = np.concatenate([mine, near], 1)
        all_d = np.concatenate([dist[live], d], 1)
        all_done = np.concatenate([done[live], ~new], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        all_d = np.take_along_axis(all_d, order, 1)
        gone = ~np.isfinite(all_d)
        ids[live] = np.where(gone, -1, np.take_along_axis(all_ids, order, 1))
        dist[live] = all_d
        done[live] = np.take_along_axis(all_done, order, 1) | gone
        live = live[~done[live].all(1)]
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, dist: np.ndarray, cfg: Graph) -> np.ndarray:
    """Neighbours of ``nodes`` chosen from candidates sorted by distance (-1: none)."""
    n, k = cand.shape
    alive = cand >= 0
    alive &= cand != nodes[:, None]
    same = np.sort(cand, axis=1)
    if (same[:, 1:] == same[:, :-1]).any():
        for r in range(n):  # a candidate named twice counts once
            _, first = np.unique(cand[r], return_index=True)
            keep = np.zeros(k, bool)
            keep[first] = True
            alive[r] &= keep
    out = np.full((n, cfg.degree), -1, np.int64)
    filled = np.zeros(n, np.int64)
    vec = x[np.maximum(cand, 0)]
    a2 = cfg.alpha**2
    for _ in range(cfg.degree):
        live = np.flatnonzero(alive.any(1))
        if not len(live):
            break
        best = alive[live].argmax(1)
        out[live, filled[live]] = cand[live, best]
        filled[live] += 1
        to_best = distances(vec[live, best], vec[live])
        alive[live] &= a2 * to_best > dist[live]
        alive[live, best] = False
    return out


def build(x: np.ndarray, cfg: Graph) -> tuple[np.ndarray, int]:
    """The graph (n x degree, -1: none) and its entry, the vector nearest to the mean."""
    n = len(x)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, cfg.degree), -1, np.int64)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at, size = 1, 16
    while at < n:
        nodes = order[at : at + size]
        at += size
        size = min(cfg.batch, size * 2)
        ids, dist = beam_search(x, graph, start, x[nodes], cfg.build_beam)
        # the batch's own members are candidates for each other
        peers = np.broadcast_to(nodes, (len(nodes), len(nodes)))
        if len(nodes) > 1:
            gram = (x[nodes] ** 2).sum(1)
            d = gram[:, None] + gram[None] - 2 * x[nodes] @ x[nodes].T
            np.fill_diagonal(d, np.inf)
            top = min(16, len(nodes) - 1)
            pick = np.argpartition(d, top - 1, axis=1)[:, :top]
            ids = np.concatenate([ids, np.take_along_axis(peers, pick, 1)], 1)
            dist = np.concatenate([dist, np.maximum(np.take_along_axis(d, pick, 1), 0)], 1)
            by = np.argsort(dist, axis=1, kind="stable")
            ids, dist = np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1)
        graph[nodes] = robust_prune(x, nodes, ids, dist, cfg)
        # reverse edges
        src = np.repeat(nodes, cfg.degree)
        dst = graph[nodes].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        heads = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
        count = np.diff(np.append(heads, len(dst)))
        rank = np.arange(len(dst)) - np.repeat(heads, count)
        for lo in range(0, int(count.max(initial=0)), cfg.degree):
            some = (rank >= lo) & (rank < lo + cfg.degree)
            touched, where = np.unique(dst[some], return_inverse=True)
            more = np.full((len(touched), cfg.degree), -1, np.int64)
            more[where, rank[some] - lo] = src[some]
            cand = np.concatenate([graph[touched], more], 1)
            used = (cand >= 0).sum(1)
            free = used <= cfg.degree
            if free.any():
                packed = np.take_along_axis(cand[free], np.argsort(cand[free] < 0, axis=1, kind="stable"), 1)[:, : cfg.degree]
                graph[touched[free]] = packed
            full = np.flatnonzero(~free)
            if len(full):
                t, c = touched[full], cand[full]
                d = np.where(c >= 0, distances(x[t], x[np.maximum(c, 0)]), np.inf)
                by = np.argsort(d, axis=1, kind="stable")
                graph[t] = robust_prune(x, t, np.take_along_axis(c, by, 1), np.take_along_axis(d, by, 1), cfg)
    return graph, start


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: c.cast("double") + F.lit(0.0)).alias("v"))


def _collapsed(rows: DataFrame, top: int) -> DataFrame:
    """v and ids, its ``top`` + 1 smallest ids: within partitions first, then over salts."""

    def per_batch(batches):
        held: dict[bytes, list[int]] = {}

        def out():
            keys = list(held)
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([sorted(set(held[k]))[: top + 1] for k in keys], pa.list_(pa.int64()))], ["v", "ids"])
            held.clear()
            return batch

        for batch in batches:
            column = batch.column(1)
            flat, at = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
            for i, key in enumerate(batch.column(0).to_pylist()):
                mine = held.setdefault(flat[at[i] : at[i + 1]].tobytes(), [])
                mine.append(key)
                if len(mine) > 8 * top:
                    mine[:] = sorted(set(mine))[: top + 1]
            if len(held) > 50_000:
                yield out()
        if held:
            yield out()

    part = rows.mapInArrow(per_batch, "v binary, ids array<long>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, top + 1).alias("ids")
    return part.groupBy("v", "salt").agg(least).groupBy("v").agg(least)


def nearest(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 10, cfg: Graph = Graph()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``top`` nearest found of all ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    distinct = scratch.write("distinct", _collapsed(_usable(vectors, id_col, vector_col), top))
    sizes = {r.bytes: r.n for r in distinct.groupBy(F.length("v").alias("bytes")).agg(F.count("*").alias("n")).collect()}
    schema_shards = "dim int, shard int, n int, x binary, ids binary, counts binary, graph binary, start int"
    shards = {size: max(1, round(n / cfg.shard_rows)) for size, n in sizes.items()}
    many = F.coalesce(F.element_at(F.create_map(*[F.lit(k) for s, n in shards.items() for k in (s, n)]), F.col("dim")), F.lit(1)) if shards else F.lit(1)

    def make(key, table):
        dim = key[0].as_py()
        order = np.argsort(np.array([v for v in table.column("v").to_pylist()], object))
        raws = [table.column("v")[int(i)].as_py() for i in order]
        x = np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1)
        ids = [table.column("ids")[int(i)].as_py() for i in order]
        graph, start = build(x.astype(np.float32), cfg)
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([len(x)], pa.int32()), "x": pa.array([x.tobytes()], pa.binary()),
            "ids": pa.array([np.array([i for y in ids for i in y], np.int64).tobytes()], pa.binary()), "counts": pa.array([np.array([len(y) for y in ids], np.int32).tobytes()], pa.binary()),
            "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary()), "start": pa.array([start], pa.int32()),
        })

    dealt = distinct.withColumn("dim", F.length("v")).withColumn("shard", F.pmod(F.xxhash64("v"), many).cast("int"))
    index = scratch.write("index", dealt.groupBy("dim", "shard").applyInArrow(make, schema_shards))

    asked = _usable(queries if queries is not None else vectors, id_col, vector_col).distinct()
    flat = asked.mapInArrow(_flatten, "vec_id long, v binary").withColumn("dim", F.length("v"))
    blocks = max(1, -(-asked.count() // cfg.query_rows))
    gathered = flat.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))).groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
    gathered = scratch.write("queries", gathered)

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"], np.float64).reshape(row["n"], -1)
                graph = np.frombuffer(row["graph"], np.int32).reshape(row["n"], -1).astype(np.int64)
                ids, counts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int32)
                first = np.concatenate([[0], np.cumsum(counts)])
                q_ids = [q["vec_id"] for q in row["q"]]
                q = np.frombuffer(b"".join(q["v"] for q in row["q"]), np.float64).reshape(len(q_ids), -1)
                found, _ = beam_search(x.astype(np.float32), graph, row["start"], q.astype(np.float32), max(cfg.query_beam, 2 * top))
                out_q, out_v, out_d = [], [], []
                for k, mine in enumerate(found):
                    mine = mine[mine >= 0]
                    d = x[mine] - q[k]
                    d = np.sqrt((d * d).sum(1))
                    some = np.concatenate([ids[first[m] : first[m + 1]] for m in mine])
                    score = np.repeat(d, counts[mine])
                    keep = some != q_ids[k]
                    some, score = some[keep], score[keep]
                    best = np.lexsort((some, score))[:top]
                    out_q += [q_ids[k]] * len(best)
                    out_v.append(some[best])
                    out_d.append(score[best])
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_d))], ["query_id", "vec_id", "score"])

    # every shard meets every block of queries, a stated query set against all rows: pairs of a shard and a few blocks are dealt one by one
    parts = max(1, -(-blocks // cfg.blocks_a_task))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    of_part = index.withColumn("part", every(F.lit(parts)))
    of_shard = gathered.withColumn("part", F.pmod("block", F.lit(parts)).cast("int")).withColumn("shard", every(many))
    over = of_part.join(of_shard, ["dim", "shard", "part"]).select("n", "x", "ids", "counts", "graph", "start", "q")
    hits = over.mapInArrow(search, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return hits.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _flatten(batches):
    for batch in batches:
        column = batch.column(1)
        flat, at = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["vec_id", "v"])
