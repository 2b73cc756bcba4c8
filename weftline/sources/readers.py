"""Graph files as edge tables, by Spark's text reader; ``.gz`` is opened as such."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.sources.generators import draw

#: Format by suffix.
SUFFIX = {"gml": "gml", "graphml": "graphml", "xml": "graphml", "net": "pajek", "mtx": "mtx", "col": "dimacs", "clq": "dimacs", "edges": "edgelist", "edgelist": "edgelist", "txt": "edgelist", "csv": "edgelist"}


def detect(path: str) -> str:
    name = path[:-3] if path.endswith(".gz") else path
    return SUFFIX.get(name.rsplit(".", 1)[-1].lower(), "edgelist")


def canonical(rows: DataFrame) -> DataFrame:
    """Simple undirected edges: src < dst, no loops, one row a pair."""
    ends = rows.select("graph_id", F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), "weight").where("src < dst")
    return ends.groupBy("graph_id", "src", "dst").agg(F.max("weight").alias("weight"))


def _text(spark: SparkSession, path: str, wholetext: bool = False, **options) -> DataFrame:
    return spark.read.options(**options).text(path, wholetext=wholetext)


def _lines(spark: SparkSession, path: str, **options) -> DataFrame:
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("k")
    return _text(spark, path, **options).select(F.input_file_name().alias("graph_id"), F.trim("value").alias("line"), place)


def edge_list(spark: SparkSession, path: str, weighted: bool | None = None, **options) -> DataFrame:
    """``u v [w]`` lines, blanks or commas between; ``#`` and ``%`` lines skipped; labels are strings.

    Unless told, a file has weights if its first row of data has a third column.
    """
    parts = _lines(spark, path, **options).where(~F.col("line").rlike("^[#%]")).select("graph_id", "k", F.split(F.regexp_replace("line", ",", " "), r"\s+").alias("p")).where(F.size("p") >= 2)
    given = F.coalesce(F.get("p", 2).try_cast("double"), F.lit(1.0))
    if weighted is None:
        first = parts.groupBy("graph_id").agg((F.min_by(F.size("p"), "k") >= 3).alias("has"))
        parts, weight = parts.join(first, "graph_id"), F.when(F.col("has"), given).otherwise(1.0)
    else:
        weight = given if weighted else F.lit(1.0)
    return canonical(parts.select("graph_id", F.col("p")[0].alias("u"), F.col("p")[1].alias("v"), weight.alias("weight")))


def dimacs(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Nodes 1..n of the ``p`` line, and ``e u v`` edges."""
    lines = _lines(spark, path, **options).select("graph_id", F.split("line", r"\s+").alias("p"))
    nodes = lines.where("p[0] = 'p'").select("graph_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("p")[2].cast("long"))).alias("node_id"))
    edges = lines.where("p[0] = 'e'").select("graph_id", F.col("p")[1].cast("long").alias("u"), F.col("p")[2].cast("long").alias("v"), F.lit(1.0).alias("weight"))
    return nodes, canonical(edges)


def _headed(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """The words of each file's first line that is no comment, and of the lines after it, by place in the file."""
    rows = _lines(spark, path, **options).where(~F.col("line").rlike("^[%#]") & (F.col("line") != "")).select("graph_id", "k", F.split("line", r"\s+").alias("p"))
    head = rows.groupBy("graph_id").agg(F.min("k").alias("head"), F.min_by("p", "k").alias("p"))
    return head.select("graph_id", "p"), rows.join(head.select("graph_id", "head"), "graph_id").where("k > head").select("graph_id", "p")


def _numbered(body: DataFrame, less: int = 1) -> DataFrame:
    at = lambda k: F.col("p")[k].cast("long") - less
    return canonical(body.where(F.size("p") >= 2).select("graph_id", at(0).alias("u"), at(1).alias("v"), F.coalesce(F.get("p", 2).try_cast("double"), F.lit(1.0)).alias("weight")))


def matrix_market(spark: SparkSession, path: str, **options) -> DataFrame:
    """Coordinate entries below the size line; 1-based indices become 0-based."""
    return _numbered(_headed(spark, path, **options)[1])


def gset(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Nodes 0..n-1 of the first line's n, and 1-based ``u v [w]`` edges as 0-based."""
    head, body = _headed(spark, path, **options)
    return head.select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p")[0].cast("long") - 1)).alias("node_id")), _numbered(body)


def _whole(spark: SparkSession, path: str, **options) -> DataFrame:
    """One row a file: formats with nesting or sections; a file must fit in a task."""
    return _text(spark, path, wholetext=True, **options).select(F.input_file_name().alias("graph_id"), F.col("value").alias("text"))


def gml(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Node ids and edges of ``node [ id .. ]`` and ``edge [ source .. target .. value|weight .. ]`` blocks."""
    of = _whole(spark, path, **options)
    number = lambda c, name: F.nullif(F.regexp_extract(c, rf"\b(?:{name})\s+([-+0-9.eE]+)", 1), F.lit(""))
    block = lambda kind: F.explode(F.regexp_extract_all("text", F.lit(rf"\b{kind}\s*\[([^\[\]]*)"), 1)).alias("b")
    nodes = of.select("graph_id", block("node")).select("graph_id", number("b", "id").cast("long").alias("node_id"))
    edges = of.select("graph_id", block("edge")).select("graph_id", number("b", "source").cast("long").alias("u"), number("b", "target").cast("long").alias("v"), F.coalesce(number("b", "value|weight").try_cast("double"), F.lit(1.0)).alias("weight"))
    return nodes, canonical(edges)


def graphml(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Node ids and edges; the weight is the edge datum whose key is declared with attr.name weight."""
    attribute = lambda c, name: F.regexp_extract(c, rf"\b{name}\s*=\s*[\"']([^\"']*)", 1)
    of = _whole(spark, path, **options).withColumn("key", attribute(F.regexp_extract("text", r"<key\b[^>]*attr\.name\s*=\s*[\"']weight[\"'][^>]*>", 0), "id"))
    nodes = of.select("graph_id", F.explode(F.regexp_extract_all("text", F.lit(r"<node\b([^>]*)"), 1)).alias("b")).select("graph_id", attribute("b", "id").alias("node_id"))
    edge = of.select("graph_id", "key", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<edge\b(?:[^>]*/>|.*?</edge>)"), 0)).alias("b"))
    data = F.regexp_extract_all("b", F.lit(r"(?s)<data\b[^>]*>[^<]*"), 0)
    mine = F.get(F.filter(data, lambda d: attribute(d, "key") == F.col("key")), F.lit(0))
    weight = F.coalesce(F.trim(F.regexp_extract(mine, r"(?s)>(.*)", 1)).try_cast("double"), F.lit(1.0))
    return nodes, canonical(edge.select("graph_id", attribute("b", "source").alias("u"), attribute("b", "target").alias("v"), weight.alias("weight")))


def pajek(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Nodes 0..n-1 of ``*Vertices n``, and the lines of ``*Edges`` and ``*Arcs`` sections, 1-based, as 0-based."""
    part = _whole(spark, path, **options).select("graph_id", F.explode(F.split("text", r"(?m)^\s*\*")).alias("s")).select("graph_id", F.split(F.trim("s"), r"\s*\n\s*").alias("lines"))
    named = part.withColumn("p", F.split(F.lower(F.col("lines")[0]), r"\s+"))
    nodes = named.where("p[0] = 'vertices'").select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p")[1].cast("long") - 1)).alias("node_id"))
    lines = named.where("p[0] in ('edges', 'arcs') and size(lines) > 1").select("graph_id", F.explode(F.slice("lines", 2, F.size("lines") - 1)).alias("line"))
    return nodes, _numbered(lines.where("line != ''").select("graph_id", F.split("line", r"\s+").alias("p")))


def _read(spark: SparkSession, path: str, kind: str, weighted: bool | None, options: dict) -> tuple[DataFrame | None, DataFrame]:
    """Nodes, where the format names them, and edges."""
    if kind == "edgelist":
        return None, edge_list(spark, path, weighted, **options)
    if kind == "mtx":
        return None, matrix_market(spark, path, **options)
    return {"dimacs": dimacs, "gset": gset, "gml": gml, "graphml": graphml, "pajek": pajek}[kind](spark, path, **options)


def load_graphs(spark: SparkSession, path: str, fmt: str = "auto", weighted: bool | None = None, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph_id, node_id, label) and edges of every graph file at ``path``: a file, a pattern, or a folder with all below it.

    The format goes by suffix unless given. Labels become 0..n-1 in each graph, numbers in their order before other labels. Files
    without nodes, and graphs of more than ``max_nodes``, are left out. No graph at all is an error.
    """
    parts = []
    folder = "recursiveFileLookup"
    if fmt != "auto":
        parts.append(_read(spark, path, fmt, weighted, {folder: True}))
    elif path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".gz").rpartition(".")[2].lower() in SUFFIX:
        parts.append(_read(spark, path, detect(path), weighted, {folder: True}))
    else:
        for kind in sorted(set(SUFFIX.values())):
            suffixes = ",".join(f"{s},{s}.gz" for s, k in SUFFIX.items() if k == kind)
            parts.append(_read(spark, path, kind, weighted, {folder: True, "pathGlobFilter": f"*.{{{suffixes}}}"}))
    text = lambda t, *c: t.select("graph_id", *[F.col(x).cast("string").alias(x) for x in c], *[x for x in ("weight",) if x in t.columns])
    edges, labels = None, None
    for named, found in parts:
        found = text(found, "src", "dst")
        mine = found.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
        if named is not None:
            mine = mine.unionByName(text(named, "node_id"))
        edges = found if edges is None else edges.unionByName(found)
        labels = mine if labels is None else labels.unionByName(mine)
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.col("node_id").try_cast("long").asc_nulls_last(), "node_id")) - 1
    nodes = labels.distinct().select("graph_id", place.cast("long").alias("node_id"), F.col("node_id").alias("label"))
    if max_nodes is not None:
        nodes = nodes.withColumn("n", F.count("*").over(Window.partitionBy("graph_id"))).where(F.col("n") <= max_nodes).drop("n")
    if not nodes.limit(1).count():
        raise FileNotFoundError(f"no readable graph at {path}")
    of = lambda end: nodes.select("graph_id", F.col("label").alias(end), F.col("node_id").alias(f"{end}_id"))
    joined = edges.join(of("src"), ["graph_id", "src"]).join(of("dst"), ["graph_id", "dst"])
    return nodes, joined.select("graph_id", F.least("src_id", "dst_id").alias("src"), F.greatest("src_id", "dst_id").alias("dst"), "weight")


def load_graph(spark: SparkSession, path: str, fmt: str = "auto", weighted: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """``load_graphs`` of one file, whose format goes by suffix, edge list where there is none."""
    return load_graphs(spark, path, detect(path) if fmt == "auto" else fmt, weighted)


class FileDataset:
    """Graph files as a source of batches: ``all`` gives every graph, ``random`` draws with replacement."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "auto", weighted: bool | None = None, max_nodes: int | None = None, mode: str = "random"):
        if mode not in ("random", "all"):
            raise ValueError(f"no mode {mode}: random, all")
        self.spark, self.mode = spark, mode
        self.nodes, self.edges = load_graphs(spark, path, fmt, weighted, max_nodes)

    def sample(self, batch: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges; drawn graphs are numbered 0..batch-1 in graph_id."""
        if self.mode == "all":
            return self.nodes, self.edges
        pool = self.nodes.select("graph_id").distinct().select("graph_id", (F.row_number().over(Window.orderBy("graph_id")) - 1).alias("at"))
        drawn = self.spark.range(batch).select(F.col("id").alias("draw"), F.floor(draw(seed, F.col("id")) * pool.count()).cast("int").alias("at")).join(pool, "at")
        as_drawn = lambda t: t.join(drawn.select("graph_id", "draw"), "graph_id").drop("graph_id").withColumnRenamed("draw", "graph_id")
        return as_drawn(self.nodes), as_drawn(self.edges)
