"""``python -m weftline.cli list | run QUERY --data DIR [--out PATH] | generate KIND --out PATH | benchmark --data DIR
| train LEARNER --out FILE | eval LEARNER --weights FILE | configs --data DIR``."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline import registry
from weftline.operators import attacks, labels, learners, returns
from weftline.operators import local as L
from weftline.plans.views import brand_edges, brand_nodes
from weftline.sources import generators, sinks


def attack_table(nodes, edges, kinds: list[str]):
    """Mean robustness by attack, ranked, with the gap to the best: lower is better."""
    graph = dict(nodes.dtypes)["graph_id"]
    every = None
    for kind in kinds:
        of = L.per_graph(nodes, edges, attacks.attack(kind), f"graph_id {graph}, n long, removed long, nd double, cn double, nd_cost double, cn_cost double").withColumn("method", F.lit(kind))
        every = of if every is None else every.unionByName(of)
    return returns.ranked_methods(every, "method", "nd", maximise=False).orderBy("rank")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__)
    p.add_argument("command", choices=("list", "run", "generate", "benchmark", "train", "eval", "configs"))
    p.add_argument("name", nargs="?")
    p.add_argument("--data")
    p.add_argument("--out")
    p.add_argument("--graphs", type=int, default=10)
    p.add_argument("--nodes", type=int, nargs=2, default=(30, 50))
    p.add_argument("--methods", nargs="*", default=["degree", "corehd", "collective_influence"])
    p.add_argument("--problem", default="cover")
    p.add_argument("--episodes", type=int, default=300)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--weights")
    a = p.parse_args(argv)
    if a.command == "configs":
        print("\n".join(sorted(x.stem for x in Path(a.data).glob("*.yaml"))))
        return
    if a.command in ("train", "eval"):
        of = learners.train(a.name, a.problem, a.episodes, a.seed) if a.command == "train" else labels.restored(learners.LEARNERS[a.name](a.seed), a.weights)
        if a.out:
            labels.saved(of, a.out)
        print(learners.validated(of, a.problem))
        return
    parts = registry.parts()
    if a.command == "list":
        for kind, of in parts.items():
            print(f"{kind}: {' '.join(of.names())}")
        return
    spark = SparkSession.builder.getOrCreate()
    if a.command == "run":
        of = parts["query"].get(a.name)(spark, a.data)
        of.write.parquet(a.out) if a.out else of.show(truncate=False)
    elif a.command == "generate":
        sized = generators.sizes(spark, a.graphs, *a.nodes)
        sinks.graphs(generators.nodes(sized), parts["generator"].get(a.name)(sized), a.out)
    else:
        attack_table(brand_nodes(spark, a.data), brand_edges(spark, a.data), a.methods).show(truncate=False)


if __name__ == "__main__":
    main()
