"""The code graph: nodes and edges as DataFrames, neighbours and bounded traversals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas import schemas
from codeatlas.operators.vectors import last_wins
from codeatlas.shared import cut, numbered, share_code

#: A frontier is broadcast up to this many ids; beyond it the step's join shuffles.
BROADCAST_ROWS = 100_000

#: Nodes and edges of the demonstration graph (fixed values).
SAMPLE_NODES = [
    ("class:MyClass", "class", "MyClass", "/src/MyClass.java"),
    ("class:BaseClass", "class", "BaseClass", "/src/BaseClass.java"),
    ("interface:MyInterface", "interface", "MyInterface", "/src/MyInterface.java"),
    ("method:processData", "method", "processData", "/src/MyClass.java"),
    ("method:saveData", "method", "saveData", "/src/MyClass.java"),
    ("class:DatabaseHelper", "class", "DatabaseHelper", "/src/util/DatabaseHelper.java"),
    ("method:connect", "method", "connect", "/src/util/DatabaseHelper.java"),
]
SAMPLE_EDGES = [
    ("class:MyClass", "class:BaseClass", "extends"),
    ("class:MyClass", "interface:MyInterface", "implements"),
    ("class:MyClass", "method:processData", "contains"),
    ("class:MyClass", "method:saveData", "contains"),
    ("method:processData", "method:saveData", "calls"),
    ("method:saveData", "class:DatabaseHelper", "uses"),
    ("class:DatabaseHelper", "method:connect", "contains"),
    ("method:saveData", "method:connect", "calls"),
]


def sample(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(SAMPLE_NODES, schemas.NODES), spark.createDataFrame([(*e, i) for i, e in enumerate(SAMPLE_EDGES)], schemas.EDGES)


def upsert_nodes(nodes: DataFrame, seq: str) -> DataFrame:
    return last_wins(nodes, ["node_id"], seq)


def insert_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (src, dst, rel) with the least edge_seq, of edges both of whose ends are nodes."""
    once = edges.groupBy("src", "dst", "rel").agg(F.min("edge_seq").alias("edge_seq")) if "edge_seq" in edges.columns else edges.select("src", "dst", "rel").distinct()
    ids = nodes.select("node_id")
    once = once.join(ids, once["src"] == ids["node_id"], "left_semi")
    return once.join(ids, once["dst"] == ids["node_id"], "left_semi")


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("node_id") == node_id)


def find_by_name(nodes: DataFrame, name: str) -> DataFrame:
    """The first node of that name, by node_id."""
    return nodes.filter(F.col("name") == name).orderBy("node_id").limit(1)


def related(edges: DataFrame, rels: Iterable[str] | None) -> DataFrame:
    """Edges of the named relationships; all if none are named."""
    rels = sorted(set(rels or ()))
    return edges.filter(F.col("rel").isin(rels)) if rels else edges


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str, rel: str | None = None, direction: str = "OUTGOING") -> DataFrame:
    """Distinct nodes at the other end of a node's edges. Any direction but OUTGOING and INCOMING means both; a self-loop gives the node."""
    own = related(edges, [rel] if rel else None)
    out = own.filter(F.col("src") == node_id).select(F.col("dst").alias("node_id"))
    back = own.filter(F.col("dst") == node_id).select(F.col("src").alias("node_id"))
    ids = out if direction == "OUTGOING" else back if direction == "INCOMING" else out.union(back)
    return nodes.join(ids.distinct(), "node_id", "left_semi")


def bfs(nodes: DataFrame, edges: DataFrame, start: str, max_depth: int, rels: Iterable[str] | None = None) -> DataFrame:
    """node_id, depth: nodes within max_depth outgoing edges of start, with their distance.

    An unknown start gives no rows; a bound below 1 gives start alone. A job a level; each level is written to the shared
    folder, and an edge whose end was reached before is dropped by an anti-join. Edges that end at no node go once, before
    the walk, if it has several levels.
    """
    spark = nodes.sparkSession
    seen = cut(node_by_id(nodes, start).select("node_id", F.lit(0).cast("long").alias("depth")).distinct(), "level")
    own = related(edges, rels).select("src", "dst")
    own = own.join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst")
    frontier, depth, n = seen, 0, seen.count()
    if n and max_depth > 1:
        own = cut(own, "edges")
    while n and depth < max_depth:
        depth += 1
        front = frontier.select(F.col("node_id").alias("src"))
        near = own.join(F.broadcast(front) if n <= BROADCAST_ROWS else front, "src", "left_semi").select(F.col("dst").alias("node_id")).distinct()
        near = near.join(seen.select("node_id"), "node_id", "left_anti")
        frontier = cut(near.withColumn("depth", F.lit(depth).cast("long")), "level")
        n = frontier.count()
        if n:
            seen = seen.unionByName(frontier)
    return seen if seen is not None else spark.createDataFrame([], "node_id string, depth long")


def dfs(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int, rels: Iterable[str] | None = None) -> DataFrame:
    """root, node_id, depth, pos: the pre-order of a depth-bounded depth-first walk from each row (root) of starts.

    A node is visited where the walk first meets it, however deep, so that the bound may hide what a shorter way reaches.
    Children go by (edge_seq, dst). A bound below 0 gives nothing. Walks are sequential; roots run in parallel, each over the
    edges that its breadth-first closure holds within the bound: one task holds those of one root, about 100 bytes each.
    """
    if max_depth < 0:
        return nodes.sparkSession.createDataFrame([], "root string, node_id string, depth long, pos long")
    share_code(nodes.sparkSession)
    own = related(edges, rels).select("src", "dst", "edge_seq")
    known = starts.select("root").distinct().join(nodes.select(F.col("node_id").alias("root")), "root", "left_semi")
    reach = cut(known.select("root", F.col("root").alias("node_id")), "reach")
    front, depth = reach, 0
    ids = nodes.select("node_id")
    while depth < max_depth and not front.isEmpty():
        depth += 1
        step = front.join(own, front["node_id"] == own["src"]).select("root", F.col("dst").alias("node_id")).distinct()
        front = cut(step.join(ids, "node_id", "left_semi").join(reach, ["root", "node_id"], "left_anti").select("root", "node_id"), "reach")
        reach = reach.unionByName(front)
    inner = reach.join(own, reach["node_id"] == own["src"]).select("root", "src", "dst", "edge_seq")
    inner = inner.join(reach.select("root", F.col("node_id").alias("dst")), ["root", "dst"], "left_semi").select("root", "src", "dst", "edge_seq")
    rows = inner.unionByName(known.select("root", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("long").alias("edge_seq")))

    def walk(pdf):
        root = pdf["root"].iloc[0]
        children: dict[str, list[str]] = {}
        for row in pdf.dropna(subset=["src"]).sort_values(["edge_seq", "dst"]).itertuples():
            children.setdefault(row.src, []).append(row.dst)
        seen, order, todo = set(), [], [(root, 0)]
        while todo:
            node, at = todo.pop()
            if at > max_depth or node in seen:
                continue
            seen.add(node)
            order.append((root, node, at, len(order)))
            todo += [(c, at + 1) for c in reversed(children.get(node, ()))]
        return type(pdf)(order, columns=["root", "node_id", "depth", "pos"])

    return rows.groupBy("root").applyInPandas(walk, "root string, node_id string, depth long, pos long")


def traverse(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 10, rels: Iterable[str] | None = None, mode: str = "BFS") -> DataFrame:
    """Nodes of a walk with depth and position: depth-first if mode is DFS in any case, else breadth-first (by depth, node_id)."""
    if mode.upper() == "DFS":
        starts = nodes.sparkSession.createDataFrame([(start,)], "root string")
        found = dfs(nodes, edges, starts, depth, rels).drop("root")
    else:
        found = numbered(bfs(nodes, edges, start, depth, rels), "pos", "depth", "node_id")
    return found.join(nodes, "node_id")


def node_count(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("cnt"))


def edge_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("cnt"))


def rel_types(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count("*").alias("cnt"))
