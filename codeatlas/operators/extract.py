"""The code graph of parsed files: classes contain methods, methods call callees of the same file and class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _methods(parsed: DataFrame) -> DataFrame:
    rows = parsed.filter(F.col("error").isNull()) if "error" in parsed.columns else parsed
    owner = F.concat_ws(":", "file_path", F.coalesce("class_name", F.lit("")))
    return rows.select("file_path", F.coalesce("class_name", F.lit("")).alias("class_name"), owner.alias("owner"), F.posexplode_outer("methods").alias("at", "m"))


def nodes(parsed: DataFrame) -> DataFrame:
    """node_id, node_type, name, file_path: of each class, its methods, and what they call. An id has one set of attributes, so dedup suffices."""
    rows = _methods(parsed)
    classes = rows.select(F.col("owner").alias("node_id"), F.lit("class").alias("node_type"), F.col("class_name").alias("name"), "file_path").distinct()
    names = rows.filter("m is not null").select("owner", "file_path", F.explode(F.array_union(F.array("m.name"), F.coalesce("m.callees", F.array().cast("array<string>")))).alias("name"))
    methods = names.select(F.concat_ws(":", "owner", "name").alias("node_id"), F.lit("method").alias("node_type"), "name", "file_path").distinct()
    return classes.unionByName(methods)


def calls(parsed: DataFrame) -> DataFrame:
    """src, dst, at, call_at: every call in the source, repeated ones too."""
    rows = _methods(parsed).filter("m is not null")
    return rows.select("owner", "m.name", "at", F.posexplode("m.callees").alias("call_at", "callee")).select(
        F.concat_ws(":", "owner", "name").alias("src"), F.concat_ws(":", "owner", "callee").alias("dst"), "at", "call_at"
    )


def edges(parsed: DataFrame) -> DataFrame:
    """src, dst, rel, edge_seq: distinct `contains` and `calls` edges; edge_seq orders a node's edges as the source does."""
    rows = _methods(parsed).filter("m is not null")
    contains = rows.select(F.col("owner").alias("src"), F.concat_ws(":", "owner", "m.name").alias("dst"), F.lit("contains").alias("rel"), F.col("at").cast("long").alias("edge_seq"))
    called = calls(parsed).select("src", "dst", F.lit("calls").alias("rel"), (F.col("at") * 1_000_000 + F.col("call_at")).cast("long").alias("edge_seq"))
    return contains.unionByName(called).groupBy("src", "dst", "rel").agg(F.min("edge_seq").alias("edge_seq"))
