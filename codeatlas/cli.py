"""Command line: semi [query], semi build, graph."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from codeatlas import config as cfg
from codeatlas.functions import embedding as fe
from codeatlas.operators import graph as g
from codeatlas.operators import vectors
from codeatlas.plans import index as plans

LOG = logging.getLogger("codeatlas")
LEVELS = (logging.WARNING, logging.INFO, logging.DEBUG, logging.DEBUG)


def words(text: str) -> list[str]:
    return [w for w in text.split(",") if w]


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="codeatlas", description="Search source code by meaning and by its call graph.")
    root.add_argument("-v", "--verbose", action="count", default=0)
    root.add_argument("--version", action="version", version="codeatlas 0.1")
    commands = root.add_subparsers(dest="command")
    semi = commands.add_parser("semi", help="search the index; `semi build` builds it")
    semi.add_argument("query", nargs="?")
    semi.add_argument("-i", "--index-dir")
    semi.add_argument("-l", "--limit", type=int)
    semi.add_argument("-p", "--path")
    semi.add_argument("-o", "--output")
    semi.add_argument("-d", "--depth", type=int)
    semi.add_argument("-e", "--extensions", type=words)
    semi.add_argument("--home")
    semi.add_argument("-m", "--model")
    semi.add_argument("--model-name")
    semi.add_argument("--model-path")
    semi.add_argument("--model-loader", help="module:function that loads the model at the model path; ONNX graphs need none")
    semi.add_argument("--embedding-dim", type=int)
    semi.add_argument("--api-key")
    semi.add_argument("--batch-size", type=int)
    graph = commands.add_parser("graph", help="walk the code graph from a named node")
    graph.add_argument("query")
    graph.add_argument("-t", "--traversal", default="BFS")
    graph.add_argument("-m", "--max-nodes", type=int, help="depth of the walk")
    graph.add_argument("-r", "--relationship", type=words)
    graph.add_argument("--db-path", help="index folder; the demonstration graph if there is none")
    graph.add_argument("-p", "--path")
    for p in (semi, graph):
        p.add_argument("-v", "--verbose", action="count", default=0)
    return root


def session() -> SparkSession:
    return SparkSession.builder.appName("codeatlas").getOrCreate()


def run_semi(args: argparse.Namespace, spark: SparkSession | None) -> int:
    if not args.query:
        print('usage: semi "your query" [options], or semi build')
        return 0
    config = cfg.load(args.home)
    options = {"model": args.model, "model_name": args.model_name, "dimension": args.embedding_dim, "model_path": args.model_path, "api_key": args.api_key, "batch_size": args.batch_size}
    e = cfg.with_options(config, **options)
    model = fe.create(e.model, e.model_name, e.dimension, e.model_path, e.api_key, fe.loader(args.model_loader) if args.model_loader else None)
    if args.query == "build":
        index, path = os.path.abspath(args.output or config.index_dir), os.path.abspath(args.path or ".")
        if not os.path.exists(path):
            print(f"Error: Path does not exist: {path}", file=sys.stderr)
            return 0
        for row in plans.build(spark or session(), path, index, model, args.extensions, args.depth).collect():
            LOG.info("%s: %s", row["metric"], row["value"])
        return 0
    index, spark = os.path.abspath(args.index_dir or config.index_dir), spark or session()
    if not plans.exists(spark, index):
        print(f"Embedding index not found at {index}", file=sys.stderr)
        return 1
    hits = plans.search(spark, index, args.query, args.limit if args.limit and args.limit > 0 else config.top_k, model)
    lines = vectors.result_lines(hits).collect()
    print(f"\nTop {len(lines)} results for '{args.query}':" if lines else "No matching code found.")
    for row in lines:
        print(row["line"])
    return 0


def run_graph(args: argparse.Namespace, spark: SparkSession | None) -> int:
    spark = spark or session()
    index = args.db_path or cfg.load(None).index_dir
    nodes, edges = (plans.table(spark, index, "nodes"), plans.table(spark, index, "edges")) if plans.exists(spark, index) else g.sample(spark)
    start = g.find_by_name(nodes, args.query).first()
    if start is None:
        print(f"Node not found: {args.query}")
        return 0
    depth = 10 if args.max_nodes is None else args.max_nodes
    found = g.traverse(nodes, edges, start["node_id"], depth, args.relationship, args.traversal).orderBy("pos").collect()
    print(f"Found starting node: {start['name']} ({start['node_type']})\nGraph traversal results ({len(found)} nodes):")
    for i, n in enumerate(found):
        print(f"  {i + 1}. {n['name']} ({n['node_type']}) - {n['file_path']}")
    print(f"Total nodes: {nodes.count()}\nTotal edges: {edges.count()}")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code: 0, or 1 if the index is missing or something failed."""
    args = parser().parse_args(argv)
    logging.basicConfig()
    LOG.setLevel(LEVELS[min(args.verbose, 3)])
    if args.command is None:
        print("Use --help to see the commands: semi, graph")
        return 0
    try:
        return (run_semi if args.command == "semi" else run_graph)(args, spark)
    except Exception as e:
        print(f"{args.command} failed: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
