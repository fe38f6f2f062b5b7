"""Stand-ins for source code: the synthetic tables read as vectors, graphs, paths and parsed files. Each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas import schemas
from codeatlas.sources import files

#: Extensions of the made-up paths: known ones, one in capitals, unknown ones and none.
EXTENSIONS = ("java", "py", "TS", "tsx", "go", "rs", "txt", "hpp", "R", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tagged(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and orders as nodes."""
    out = None
    for kind, name, key, label in (("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("order", "orders", "o_orderkey", "o_orderpriority")):
        part = table(spark, sf_dir, name).select(_tagged(kind, key).alias("node_id"), F.lit(kind).alias("node_type"), F.col(label).alias("name"), F.lit(f"/{name}").alias("file_path"))
        out = part if out is None else out.unionByName(part)
    return out


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -contains-> nation -contains-> customer -places-> order."""
    out = None
    for name, one, src, other, dst, rel in (("nation", "region", "n_regionkey", "nation", "n_nationkey", "contains"), ("customer", "nation", "c_nationkey", "customer", "c_custkey", "contains"), ("orders", "customer", "o_custkey", "order", "o_orderkey", "places")):
        part = table(spark, sf_dir, name).select(_tagged(one, src).alias("src"), _tagged(other, dst).alias("dst"), F.lit(rel).alias("rel"), F.col(dst).cast("long").alias("edge_seq"))
        out = part if out is None else out.unionByName(part)
    return out


GRAPH_SQL = """
nodes AS (
  SELECT 'region:' || r_regionkey AS node_id, 'region' AS node_type, r_name AS name, '/region' AS file_path FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, '/nation' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, '/customer' FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderpriority, '/orders' FROM orders
), edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS rel FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains' FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'places' FROM orders
)"""


def ring(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A cyclic graph over the customers: k -> 7 k + 3 and k -> k + 1, modulo their number."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    n = customers.agg(F.count("*").alias("n"))
    rows = customers.crossJoin(F.broadcast(n))
    nodes = rows.select((F.col("c_custkey") % F.col("n")).cast("string").alias("node_id"), F.lit("c").alias("node_type"), F.lit("").alias("name"), F.lit("").alias("file_path")).distinct()
    step = lambda to, seq: rows.select((F.col("c_custkey") % F.col("n")).cast("string").alias("src"), (to % F.col("n")).cast("string").alias("dst"), F.lit("calls").alias("rel"), F.lit(seq).cast("long").alias("edge_seq"))
    return nodes, step(F.col("c_custkey") * 7 + 3, 0).union(step(F.col("c_custkey") + 1, 1)).distinct()


RING_SQL = """
c AS (SELECT c_custkey AS k, (SELECT count(*) FROM customer) AS n FROM customer),
edges AS (SELECT DISTINCT CAST(k % n AS VARCHAR) AS src, CAST((k * 7 + 3) % n AS VARCHAR) AS dst FROM c UNION SELECT CAST(k % n AS VARCHAR), CAST((k + 1) % n AS VARCHAR) FROM c)"""

#: The path of a document, in SQL that both engines read.
PATH = (
    "concat('/src/', source, '/', CASE doc_id % 7 WHEN 0 THEN 'build/' WHEN 1 THEN '.hidden/' WHEN 2 THEN 'node_modules/x/' ELSE '' END, CASE doc_id % 11 WHEN 0 THEN '.' ELSE '' END, 'F', CAST(doc_id AS STRING), CASE doc_id % "
    + str(len(EXTENSIONS)) + " " + " ".join(f"WHEN {i} THEN '{'.' + e if e else ''}'" for i, e in enumerate(EXTENSIONS)) + " END)"
)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(PATH).alias("path"))


PATHS_SQL = f"paths AS (SELECT doc_id, text, {PATH} AS path, regexp_extract({PATH}, '[^/]+$') AS name FROM documents)"


#: Small sources, one of them with syntax errors, that queries parse; what must come of each is written out beside the query.
SOURCES = [
    ("/src/HelloWorld.java", """package com.example;

@Entity(name = "x")
public class HelloWorld {
    private String message, other = "a(b)";
    @Column protected Map<String, List<String>> counts;

    HelloWorld(String message) { this.message = check(message); }

    @Override
    public <K> Map<K, String> sayHello(@Nullable K to, int n) throws Exception {
        System.out.println(getMessage()); // not(this)
        return build(to, n);
    }

    public String getMessage() { return message; }
}
"""),
    ("/src/vector.cpp", """namespace store {
template <class T> class Vector : public Base {
public:
  int n = 1, *m;
  Vector(int a) : n(a) { init(a); }
  ~Vector() { release(); }
  int size() const { return count(); }
};
}
"""),
    ("/src/tool.py", """class Tool:
    size = 1

    def run(self, a, *rest) -> int:
        return outer(inner(a))

    def broken(:
        pass

    def last(self):
        self.run(1)
"""),
    ("/src/add.ts", """export const add = (a: number, b: number): number => plus(a, b);
function* each(list: number[]) {
  yield next(list);
}
"""),
    ("/src/main.go", """package main

type Server struct {
  host, port string
}

func (s *Server) Run(a int) error {
  return listen(s.host, a)
}
"""),
    ("/src/top.rs", """struct P { x: i32, pub y: i32 }
impl P {
  pub fn new(x: i32) -> P { make(x) }
}
"""),
    ("/src/nul.py", "def f():\0"),
    ("/src/notes.txt", "call(me)"),
]


def sources(spark: SparkSession) -> DataFrame:
    """SOURCES, and a file that isn't UTF-8, as a scan gives them."""
    rows = [(path, bytearray(code.encode())) for path, code in SOURCES] + [("/src/bad.py", bytearray(b"x = 1\xff\xfe"))]
    return files.decoded(spark.createDataFrame(rows, "path string, content binary"))


#: An acyclic part and a way back; the walk meets `c` and `d` deeper than the shortest way does.
LOOP_NODES = ("a", "b", "c", "d", "e", "f")
LOOP_EDGES = (("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("a", "e"), ("e", "d"), ("d", "a"), ("c", "f"), ("e", "missing"))


def loop_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    nodes = spark.createDataFrame([(n, "c", n, "") for n in LOOP_NODES], schemas.NODES)
    return nodes, spark.createDataFrame([(*e, "calls", i) for i, e in enumerate(LOOP_EDGES)], schemas.EDGES)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parsed files with doc_id % 3 methods, each calling the text's first three words: a stand-in for calls, no cut of an input."""
    docs = table(spark, sf_dir, "documents")
    method = lambda i: F.struct(
        F.concat(F.lit("m"), i.cast("string")).alias("name"), F.lit("").alias("return_type"), F.array().cast("array<string>").alias("parameters"), F.col("text").alias("body"),
        i.cast("int").alias("start_line"), (i + 9).cast("int").alias("end_line"), F.slice(F.split("text", " "), 1, 3).alias("callees"),
    )
    numbers = F.filter(F.sequence(F.lit(0), F.col("doc_id") % 3), lambda i: i > 0)
    return docs.select(
        F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.lit("JAVA").alias("language"), F.col("lang").alias("package_name"), F.col("source").alias("class_name"),
        F.array("lang").alias("properties"), F.transform(numbers, method).alias("methods"), F.lit(None).cast("string").alias("error"),
    )


PARSED_SQL = """
files AS (SELECT doc_id, '/doc/' || doc_id AS file_path, '/doc/' || doc_id || ':' || source AS owner, source, text, doc_id % 3 AS n FROM documents),
methods AS (SELECT f.*, i, 'm' || i AS method FROM files f, unnest(range(1, n + 1)) AS r(i)),
calls AS (SELECT owner || ':' || method AS src, owner || ':' || w AS dst, file_path, w FROM methods, unnest(list_slice(string_split(text, ' '), 1, 3)) AS x(w)),
all_nodes AS (
  SELECT owner AS node_id, 'class' AS node_type, source AS name FROM files
  UNION SELECT owner || ':' || method, 'method', method FROM methods
  UNION SELECT dst, 'method', w FROM calls
),
all_edges AS (SELECT owner AS src, owner || ':' || method AS dst, 'contains' AS rel FROM methods UNION SELECT src, dst, 'calls' FROM calls)"""
