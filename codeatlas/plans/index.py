"""The index: built from a source tree, kept as versioned Parquet tables, read by searches."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas import schemas
from codeatlas.functions import embedding as fe
from codeatlas.operators import chunks, extract, graph, vectors
from codeatlas.operators.parsing import parse_files, whole_files
from codeatlas.shared import cut, delete, drop, file_system
from codeatlas.sources import files as sources

TABLES = {"vectors": schemas.VECTORS, "nodes": schemas.NODES, "edges": schemas.EDGES}
#: Buckets of the vectors by key: an upsert rewrites those that its keys fall into.
BUCKETS = 64
#: Versions whose tables stay: readers of the last but one may go on.
KEPT = 2


class Conflict(RuntimeError):
    """Another writer published first; what this one read is out of date, so it has to run again."""


def _pointers(spark: SparkSession, index: str) -> dict[int, str]:
    """The published versions' files by number. A version is a file CURRENT-n; readers take the greatest n."""
    fs, at = file_system(spark, index)
    if not fs.exists(at):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return {int(n.rpartition("-")[2]): f"{index}/{n}" for n in names if re.fullmatch(r"CURRENT-\d+", n)}


def _folders(spark: SparkSession, pointer: str) -> dict[str, list[str]]:
    """The folders, relative to the index, that hold each table of a version."""
    return json.loads(spark.read.text(pointer, wholetext=True).first()[0])


def exists(spark: SparkSession, index: str) -> bool:
    return bool(_pointers(spark, index))


def version(spark: SparkSession, index: str) -> int:
    """Number of the version that readers see; 0 if there is none yet."""
    return max(_pointers(spark, index), default=0)


def folders(spark: SparkSession, index: str, at: int | None = None) -> dict[str, list[str]]:
    """Of each table the folders that hold it, in a version or the present one; empty if there is none yet."""
    found = _pointers(spark, index)
    return _folders(spark, found[max(found) if at is None else at]) if found and at != 0 else {}


def load(spark: SparkSession, index: str, name: str, where: list[str]) -> DataFrame:
    """The rows of a table that lie in these folders of the index."""
    if not where:
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).option("recursiveFileLookup", "true").parquet(*(f"{index}/{f}" for f in where))


def table(spark: SparkSession, index: str, name: str) -> DataFrame:
    """A table of the index; empty if there is none yet."""
    return load(spark, index, name, folders(spark, index).get(name, []))


def bucket(key: tuple[str, ...] = vectors.KEY) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def write(spark: SparkSession, index: str, name: str, df: DataFrame) -> list[str]:
    """Write a table, or some buckets of the vectors, to folders of its own, which no version names yet."""
    folder = f"{name}-{uuid.uuid4().hex}"
    if name != "vectors":
        df.write.parquet(f"{index}/{folder}")
        return [folder]
    df.withColumn("bucket", bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{index}/{folder}")
    fs, at = file_system(spark, f"{index}/{folder}")
    return sorted(f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(at) if s.isDirectory())


def publish(spark: SparkSession, index: str, tables: dict[str, DataFrame], after: int | None = None) -> int:
    """Write tables and publish them as a new version, in which all other tables are those of version `after` (the present one if None)."""
    after = version(spark, index) if after is None else after
    return point(spark, index, folders(spark, index, after) | {name: write(spark, index, name, df) for name, df in tables.items()}, after)


def point(spark: SparkSession, index: str, tables: dict[str, list[str]], after: int) -> int:
    """Publish folders that are written already as the version after `after`: by the rename of one file that holds their names, so
    readers see the old version or the new one whole, whenever the writer dies. A Conflict is raised if that version exists.
    """
    jvm = spark.sparkContext._jvm
    fs, made = file_system(spark, f"{index}/.made-{uuid.uuid4().hex}")
    out = fs.create(made, True)
    out.write(bytearray(json.dumps(tables).encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{index}/CURRENT-{after + 1}")
    try:
        # without an option to overwrite: a rename onto a version that another writer made fails
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(made), fs.makeQualified(target), none)
    except Exception as e:
        fs.delete(made, False)
        if fs.exists(target):
            raise Conflict(f"version {after + 1} of {index} exists already") from e
        raise
    clear(spark, index)
    return after + 1


def clear(spark: SparkSession, index: str) -> None:
    """Delete versions before the last KEPT, and the folders that only they name."""
    found = _pointers(spark, index)
    old = sorted(found)[:-KEPT]
    used = {f for n in sorted(found)[-KEPT:] for fs in _folders(spark, found[n]).values() for f in fs}
    for n in old:
        gone = {f for fs in _folders(spark, found[n]).values() for f in fs} - used
        for folder in gone:
            delete(spark, f"{index}/{folder}")
        for whole in {f.partition("/")[0] for f in gone} - {f.partition("/")[0] for f in used}:
            delete(spark, f"{index}/{whole}")
        delete(spark, found[n])


def upsert(spark: SparkSession, index: str, rows: DataFrame, seq: str = "seq") -> int:
    """Merge vector rows (with seq) into the index: the buckets that their keys fall into are read, merged and written, nothing else."""
    after = version(spark, index)
    now = folders(spark, index, after)
    last = cut(vectors.upsert(None, rows, vectors.KEY, seq), "upserts")
    touched = {r[0] for r in last.select(bucket()).distinct().collect()}  # BUCKETS numbers at most
    if not touched:
        return after
    own = [f for f in now.get("vectors", []) if int(f.rpartition("=")[2]) in touched]
    kept = load(spark, index, "vectors", own).join(last.select(*vectors.KEY), list(vectors.KEY), "left_anti")
    columns = load(spark, index, "vectors", []).columns
    merged = kept.select(columns).unionByName(last.select(columns))
    stay = [f for f in now.get("vectors", []) if f not in own]
    done = point(spark, index, now | {"vectors": sorted(stay + write(spark, index, "vectors", merged))}, after)
    drop(last)
    return done


def build(
    spark: SparkSession, path: str, index: str, model: fe.Model | None = None, extensions: list[str] | None = None, depth: int | None = None, max_tokens: int = chunks.MAX_TOKENS
) -> DataFrame:
    """Index the sources below path into index, over what is there, and return its statistics (metric, value).

    Vectors are keyed by (file_path, method_name): overloads overwrite each other, the last in source order stays. Rows of
    files that are gone stay. Files that fail to read or parse are left out; `errors` lists them.
    """
    model = model or fe.create("mock")
    after = version(spark, index)
    files = cut(sources.scan(spark, path, extensions, depth), "files")
    parsed = cut(parse_files(files), "parsed")
    known = parsed.filter("language is not null")
    chunked = chunks.chunk(known, max_tokens)
    method_rows = chunked.select("file_path", "package_name", "class_name", "method_name", F.col("full_context").alias("content"), "seq")
    rows = method_rows.unionByName(whole_files(files).withColumn("seq", F.lit(0).cast("long")))
    new = cut(fe.embed(vectors.last_wins(rows, vectors.KEY, "seq"), "content", model), "vectors")
    nodes = extract.nodes(known)
    before = folders(spark, index, after)
    old_nodes, old_edges, old = (load(spark, index, t, before.get(t, [])) for t in ("nodes", "edges", "vectors"))
    all_nodes = cut(old_nodes.join(nodes.select("node_id"), "node_id", "left_anti").select(nodes.columns).unionByName(nodes), "nodes")
    all_edges = cut(graph.insert_edges(all_nodes, old_edges.unionByName(extract.edges(known))), "edges")
    kept = old.join(new.select(*vectors.KEY), list(vectors.KEY), "left_anti").select(new.columns).unionByName(new)
    publish(spark, index, {"vectors": kept, "nodes": all_nodes, "edges": all_edges}, after)
    done = cut(stats(chunked, table(spark, index, "vectors"), all_nodes, all_edges, extract.calls(known)), "stats")
    drop(files, parsed, new, all_nodes, all_edges)
    return done


def stats(chunked: DataFrame, stored: DataFrame, nodes: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """metric, value: chunks of parsed files, vectors, nodes, edges, and calls counted before edges are made distinct."""
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    parts = [one(chunked, "total_chunks"), one(stored, "vectors"), one(nodes, "nodes"), one(edges, "edges"), one(calls, "total_calls")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is not null").select(F.col("file_path").alias("path"), "error")


def search(spark: SparkSession, index: str, query: str | list[float], k: int = 5, model: fe.Model | None = None) -> DataFrame:
    """rank, file_path, content, similarity of the k nearest chunks to a text or vector."""
    vector = (model or fe.create("mock")).vector(query) if isinstance(query, str) else query
    stored = table(spark, index, "vectors")
    q = spark.createDataFrame([(vector,)], "query_vector array<float>")
    hits = vectors.ranked(vectors.top_k(stored, q, k), vectors.KEY)
    return F.broadcast(hits).join(stored.select(*vectors.KEY, "content"), list(vectors.KEY)).select("rank", "file_path", "content", "similarity").orderBy("rank")
