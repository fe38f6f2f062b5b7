"""Named queries over the synthetic tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions import embedding as fe
from codeatlas.functions import language as fl
from codeatlas.functions import vectors as fv
from codeatlas.operators import chunks, extract, graph, vectors
from codeatlas.operators.parsing import called_names, parse_files, whole_files
from codeatlas.plans import index
from codeatlas.plans import proxies as p
from codeatlas.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def of(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return of


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Vectors

DOT = "list_sum([CAST({0}[i] * {1}[i] AS DOUBLE) for i in range(1, len({0}) + 1)])"
COSINE = f"CASE WHEN sqrt({DOT.format('a', 'a')}) * sqrt({DOT.format('b', 'b')}) = 0 THEN 0.0 ELSE {DOT.format('a', 'b')} / (sqrt({DOT.format('a', 'a')}) * sqrt({DOT.format('b', 'b')})) END"
SCORED = f"pairs AS (SELECT e.vec_id, e.embedding AS a, q.embedding AS b FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), scored AS (SELECT vec_id, {COSINE} AS raw, round({COSINE}, 6) AS similarity FROM pairs)"
TOP = f"WITH {SCORED}, top AS (SELECT vec_id, similarity, row_number() OVER (ORDER BY raw DESC, vec_id) AS rank FROM scored QUALIFY rank <= 10)"


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return p.table(spark, d, "embeddings")


def first_vector(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).filter("vec_id = 0").select(F.col("embedding").alias("query_vector"))


def nearest(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k(embeddings(spark, d), first_vector(spark, d), 10, key=("vec_id",))


@query(f"WITH {SCORED} SELECT vec_id, similarity FROM scored")
def vector_cosine(spark, d):
    return vectors.with_similarity(embeddings(spark, d), first_vector(spark, d)).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"{TOP} SELECT vec_id, similarity FROM top")
def vector_topk(spark, d):
    return nearest(spark, d).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"{TOP} SELECT rank, vec_id, similarity FROM top")
def vector_ranked(spark, d):
    return vectors.ranked(nearest(spark, d), ["vec_id"]).select("rank", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"{TOP} SELECT printf('%d. %s (similarity: %.4f)', rank, '/vec/' || vec_id, similarity) AS line FROM top")
def search_result_format(spark, d):
    hits = vectors.ranked(nearest(spark, d), ["vec_id"]).withColumn("similarity", F.round("similarity", 6))
    return vectors.result_lines(hits.withColumn("file_path", F.concat(F.lit("/vec/"), F.col("vec_id").cast("string"))))


@query(f"WITH {SCORED} SELECT vec_id, similarity FROM scored UNION ALL SELECT -1, 0.0")
def vector_zero_norm(spark, d):
    own = embeddings(spark, d).select("vec_id", "embedding")
    zero = own.filter("vec_id = 0").select(F.lit(-1).cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.lit(0.0).cast("float")).alias("embedding"))
    return vectors.with_similarity(own.unionByName(zero), first_vector(spark, d)).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT vec_id, round(sqrt({DOT.format('embedding', 'embedding')}) / CASE WHEN sqrt({DOT.format('embedding', 'embedding')}) = 0 THEN 1 ELSE sqrt({DOT.format('embedding', 'embedding')}) END, 4) AS n1, round(embedding[1] / sqrt({DOT.format('embedding', 'embedding')}), 3) + 0.0 AS v1 FROM embeddings")
def vector_normalize(spark, d):
    unit = embeddings(spark, d).select("vec_id", fv.normalized(F.col("embedding")).alias("v"))
    return unit.select("vec_id", F.round(F.sqrt(fv.dot(F.col("v"), F.col("v"))), 4).alias("n1"), (F.round(F.col("v")[0].cast("double"), 3) + 0.0).alias("v1"))


@query("SELECT count(*) AS cnt FROM embeddings")
def vector_count(spark, d):
    return vectors.count(embeddings(spark, d))


@query("SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def vector_upsert(spark, d):
    log = p.table(spark, d, "conversations").withColumn("seq", F.col("turn"))
    old, new = log.filter("turn < 2"), log.filter("turn >= 2")
    return vectors.upsert(vectors.last_wins(old, ["conv_id", "role"], "seq"), new, ["conv_id", "role"]).select("conv_id", "role", "turn", "text")


@query(f"WITH pairs AS (SELECT q.vec_id AS query_id, e.vec_id, e.embedding AS a, q.embedding AS b FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {COSINE} DESC, vec_id) AS rank FROM pairs QUALIFY rank <= 3")
def vector_batch_topk(spark, d):
    """Extension: the stated query set is every fiftieth vector."""
    q = embeddings(spark, d).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.batch_top_k(embeddings(spark, d), q, "query_id", 3, ["vec_id"]).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


# Graph


@query("SELECT 'customer:' || c_custkey AS node_id, CASE WHEN c_custkey % 2 = 0 THEN c_name || '_v2' ELSE c_name END AS name FROM customer")
def graph_node_upsert(spark, d):
    one = p.table(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node_id"), F.col("c_name").alias("name"), F.lit(1).alias("seq"), "c_custkey")
    two = one.filter("c_custkey % 2 = 0").withColumns({"name": F.concat("name", F.lit("_v2")), "seq": F.lit(2)})
    return graph.upsert_nodes(one.union(two).drop("c_custkey"), "seq").select("node_id", "name")


SUPPLY = "SELECT DISTINCT 'part:' || l_partkey AS src, 'supp:' || l_suppkey AS dst, 'supplied_by' AS rel FROM lineitem"


def supply(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tag = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    edges = p.table(spark, d, "lineitem").select(tag("part", "l_partkey").alias("src"), tag("supp", "l_suppkey").alias("dst"), F.lit("supplied_by").alias("rel"))
    nodes = p.table(spark, d, "part").select(tag("part", "p_partkey").alias("node_id")).union(p.table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(tag("supp", "s_suppkey")))
    return nodes, edges


@query(SUPPLY)
def graph_edge_dedup(spark, d):
    _, edges = supply(spark, d)
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    return graph.insert_edges(ends, edges).select("src", "dst", "rel")


@query(f"{SUPPLY} WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0)")
def graph_edge_dangling(spark, d):
    nodes, edges = supply(spark, d)
    return graph.insert_edges(nodes, edges).select("src", "dst", "rel")


@query(f"WITH {p.GRAPH_SQL} SELECT node_id, node_type, name FROM nodes WHERE node_id = 'nation:7'")
def graph_node_by_id(spark, d):
    return graph.node_by_id(p.graph_nodes(spark, d), "nation:7").select("node_id", "node_type", "name")


@query(f"WITH {p.GRAPH_SQL} SELECT node_id, node_type, name FROM nodes WHERE name = (SELECT min(o_orderpriority) FROM orders) ORDER BY node_id LIMIT 1")
def graph_find_by_name(spark, d):
    """Many orders have that name; the first by node_id counts."""
    name = p.table(spark, d, "orders").agg(F.min("o_orderpriority")).first()[0]
    return graph.find_by_name(p.graph_nodes(spark, d), name).select("node_id", "node_type", "name")


@query(f"WITH {p.GRAPH_SQL} SELECT count(*) AS cnt FROM nodes")
def graph_node_count(spark, d):
    return graph.node_count(p.graph_nodes(spark, d))


@query(f"WITH {p.GRAPH_SQL} SELECT count(*) AS cnt FROM edges")
def graph_edge_count(spark, d):
    return graph.edge_count(p.graph_edges(spark, d))


@query(f"WITH {p.GRAPH_SQL} SELECT rel, count(*) AS cnt FROM edges GROUP BY rel")
def graph_rel_types(spark, d):
    return graph.rel_types(p.graph_edges(spark, d))


def looped(spark: SparkSession, d: str) -> DataFrame:
    return p.graph_edges(spark, d).unionByName(spark.createDataFrame([("nation:7", "nation:7", "contains", 0)], "src string, dst string, rel string, edge_seq long"))


LOOPED = f"WITH {p.GRAPH_SQL}, own AS (SELECT * FROM edges UNION ALL SELECT 'nation:7', 'nation:7', 'contains') SELECT node_id, node_type, name FROM nodes WHERE node_id IN "


@query(LOOPED + "(SELECT dst FROM own WHERE src = 'nation:7')")
def graph_neighbors_out(spark, d):
    return graph.neighbors(p.graph_nodes(spark, d), looped(spark, d), "nation:7").select("node_id", "node_type", "name")


@query(LOOPED + "(SELECT src FROM own WHERE dst = 'nation:7')")
def graph_neighbors_in(spark, d):
    return graph.neighbors(p.graph_nodes(spark, d), looped(spark, d), "nation:7", direction="INCOMING").select("node_id", "node_type", "name")


@query(LOOPED + "(SELECT dst FROM own WHERE src = 'nation:7' UNION SELECT src FROM own WHERE dst = 'nation:7')")
def graph_neighbors_both(spark, d):
    return graph.neighbors(p.graph_nodes(spark, d), looped(spark, d), "nation:7", direction="BOTH").select("node_id", "node_type", "name")


@query(LOOPED + "(SELECT dst FROM own WHERE src = 'customer:7' AND rel = 'contains' UNION SELECT src FROM own WHERE dst = 'customer:7' AND rel = 'contains')")
def graph_neighbors_rel(spark, d):
    return graph.neighbors(p.graph_nodes(spark, d), looped(spark, d), "customer:7", rel="contains", direction="any other word").select("node_id", "node_type", "name")


def walked(start: str, depth: int, where: str = "TRUE") -> str:
    return f"walk AS (SELECT '{start}' AS node_id, CAST(0 AS BIGINT) AS depth UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node_id WHERE depth < {depth} AND {where})"


REACHED = "SELECT node_id, min(depth) AS depth FROM walk GROUP BY node_id"


@query(f"WITH RECURSIVE {p.GRAPH_SQL}, {walked('region:1', 3)} {REACHED}")
def graph_bfs(spark, d):
    return graph.bfs(p.graph_nodes(spark, d), p.graph_edges(spark, d), "region:1", 3)


@query(f"WITH RECURSIVE {p.RING_SQL}, {walked('1', 6)} {REACHED}")
def graph_bfs_cycle(spark, d):
    """The bound binds, on a graph of cycles."""
    return graph.bfs(*p.ring(spark, d), "1", 6)


@query(f"WITH RECURSIVE {p.GRAPH_SQL}, {walked('region:1', 3, "rel = 'contains'")} {REACHED}")
def graph_bfs_filtered(spark, d):
    return graph.bfs(p.graph_nodes(spark, d), p.graph_edges(spark, d), "region:1", 3, {"contains"})


@query(
    f"WITH RECURSIVE {p.GRAPH_SQL}, ordered AS (SELECT *, CAST(string_split(dst, ':')[2] AS BIGINT) AS seq FROM edges), "
    "walk AS (SELECT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS node_id, CAST(0 AS BIGINT) AS depth, CAST([] AS BIGINT[]) AS way FROM region "
    "UNION ALL SELECT root, dst, depth + 1, list_append(way, seq) FROM walk JOIN ordered ON src = node_id WHERE rel = 'contains') "
    "SELECT root, node_id, depth, row_number() OVER (PARTITION BY root ORDER BY way) - 1 AS pos FROM walk"
)
def graph_dfs(spark, d):
    """Walks from every region through its nations and their customers, in order."""
    roots = p.graph_nodes(spark, d).filter("node_type = 'region'").select(F.col("node_id").alias("root"))
    return graph.dfs(p.graph_nodes(spark, d), p.graph_edges(spark, d), roots, 10, {"contains"})


DFS_ROWS = "('a', 'a', 0, 0), ('a', 'b', 1, 1), ('a', 'c', 2, 2), ('a', 'e', 1, 3), ('a', 'd', 2, 4), ('b', 'b', 0, 0), ('b', 'c', 1, 1), ('b', 'd', 2, 2), ('b', 'f', 2, 3)"


@query(f"SELECT root, node_id, CAST(depth AS BIGINT) AS depth, CAST(pos AS BIGINT) AS pos FROM (VALUES {DFS_ROWS}) AS t(root, node_id, depth, pos)")
def graph_dfs_bound(spark, d):
    """The bound binds on a cyclic graph: from a, c is met at depth 2, so that f stays hidden though a shorter way reaches it."""
    return graph.dfs(*p.loop_graph(spark), spark.createDataFrame([("a",), ("b",), ("none",)], "root string"), 2)


@query(
    f"WITH RECURSIVE {p.GRAPH_SQL}, {walked('nation:3', 10)} SELECT 'start' AS section, node_id AS key, node_type AS value FROM nodes WHERE node_id = 'nation:3' "
    f"UNION ALL SELECT 'node', node_id, CAST(min(depth) AS VARCHAR) FROM walk GROUP BY node_id UNION ALL SELECT 'total', 'nodes', CAST(count(*) AS VARCHAR) FROM nodes UNION ALL SELECT 'total', 'edges', CAST(count(*) AS VARCHAR) FROM edges"
)
def graph_query(spark, d):
    nodes, edges = p.graph_nodes(spark, d), p.graph_edges(spark, d)
    name = graph.node_by_id(nodes, "nation:3").first()["name"]
    start = graph.find_by_name(nodes, name)
    found = graph.traverse(nodes, edges, start.first()["node_id"], 10)
    total = lambda df, key: df.select(F.lit("total").alias("section"), F.lit(key).alias("key"), F.col("cnt").cast("string").alias("value"))
    out = start.select(F.lit("start").alias("section"), F.col("node_id").alias("key"), F.col("node_type").alias("value"))
    out = out.union(found.select(F.lit("node"), "node_id", F.col("depth").cast("string")))
    return out.union(total(graph.node_count(nodes), "nodes")).union(total(graph.edge_count(edges), "edges"))


@query("SELECT * FROM (VALUES ('class:MyClass', 0), ('class:BaseClass', 1), ('interface:MyInterface', 1), ('method:processData', 1), ('method:saveData', 1), ('class:DatabaseHelper', 2), ('method:connect', 2)) AS t(node_id, depth)".replace("SELECT *", "SELECT node_id, CAST(depth AS BIGINT) AS depth"))
def sample_graph_bfs(spark, d):
    return graph.bfs(*graph.sample(spark), "class:MyClass", 10)


@query(f"WITH {p.PARSED_SQL} SELECT node_id, node_type, name FROM all_nodes")
def graph_extract_nodes(spark, d):
    return extract.nodes(p.parsed(spark, d)).select("node_id", "node_type", "name")


@query(f"WITH {p.PARSED_SQL} SELECT src, dst, rel FROM all_edges")
def graph_extract_edges(spark, d):
    return extract.edges(p.parsed(spark, d)).select("src", "dst", "rel")


# Files, languages, chunks

EXT = r"lower(regexp_extract(name, '^.+\.([^.]+)$', 1))"
# The oracles' own lists (fixed values), not those of the code under test.
BY_EXTENSION = (
    "('java', 'JAVA'), ('py', 'PYTHON'), ('js', 'JAVASCRIPT'), ('jsx', 'JAVASCRIPT'), ('ts', 'TYPESCRIPT'), ('tsx', 'TSX'), ('go', 'GO'), ('rs', 'RUST'), ('c', 'C'), ('h', 'C'), "
    "('cpp', 'CPP'), ('cc', 'CPP'), ('cxx', 'CPP'), ('hpp', 'CPP'), ('cs', 'C_SHARP'), ('rb', 'RUBY'), ('php', 'PHP'), ('swift', 'SWIFT'), ('kt', 'KOTLIN'), ('kts', 'KOTLIN'), "
    "('scala', 'SCALA'), ('dart', 'DART'), ('lua', 'LUA'), ('r', 'R'), ('bash', 'BASH'), ('sh', 'BASH')"
)
LANGUAGE = f"(SELECT language FROM (VALUES {BY_EXTENSION}) AS known(ext, language) WHERE ext = {EXT})"
FINE = "name NOT LIKE '.%' AND path NOT LIKE '%/.git/%' AND path NOT LIKE '%/node_modules/%' AND path NOT LIKE '%/build/%' AND path NOT LIKE '%/target/%' AND path NOT LIKE '%/.gradle/%'"
TAKEN = "'java', 'kt', 'js', 'ts', 'py', 'go', 'rs', 'cpp', 'c', 'h', 'cs', 'rb', 'php', 'swift', 'scala'"


@query(f"WITH {p.PATHS_SQL} SELECT path, {LANGUAGE} AS language FROM paths")
def language_detect(spark, d):
    return p.paths(spark, d).select("path", fl.language(F.col("path")).alias("language"))


@query(f"WITH {p.PATHS_SQL} SELECT path, {LANGUAGE} IS NOT NULL AS ok FROM paths")
def language_supported(spark, d):
    return p.paths(spark, d).select("path", fl.is_supported(F.col("path")).alias("ok"))


@query(f"WITH {p.PATHS_SQL} SELECT {LANGUAGE} AS language, count(*) AS cnt FROM paths GROUP BY 1")
def language_histogram(spark, d):
    return p.paths(spark, d).groupBy(fl.language(F.col("path")).alias("language")).agg(F.count("*").alias("cnt"))


@query(f"SELECT * FROM (VALUES {BY_EXTENSION}) AS t(ext, language)")
def supported_extensions(spark, d):
    return fl.supported_extensions(spark)


@query(f"WITH {p.PATHS_SQL} SELECT path FROM paths WHERE {FINE} AND name LIKE '%.%' AND regexp_extract(name, '[^.]+$') IN ({TAKEN})")
def file_filter(spark, d):
    return p.paths(spark, d).filter(files.included(F.col("path"))).select("path")


@query(f"WITH {p.PATHS_SQL} SELECT path FROM paths WHERE {FINE} AND (name LIKE '%.py' OR name LIKE '%.tsx')")
def file_filter_ext(spark, d):
    return p.paths(spark, d).filter(files.included(F.col("path"), ["py", "tsx"])).select("path")


@query(f"WITH {p.PATHS_SQL} SELECT path FROM paths WHERE len(string_split(substr(path, 6), '/')) <= 2")
def path_depth_filter(spark, d):
    return p.paths(spark, d).filter(files.within_depth(F.expr("substring(path, 6)"), 2)).select("path")


@query(f"WITH {p.PARSED_SQL} SELECT file_path, method AS method_name, CAST(i AS INT) AS start_line, CAST(i + 9 AS INT) AS end_line FROM methods UNION ALL SELECT file_path, '', 1, 1 FROM files WHERE n = 0")
def chunk_explode(spark, d):
    return chunks.chunk(p.parsed(spark, d)).select("file_path", "method_name", "start_line", "end_line")


CONTEXT = "CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Package: ' || lang || chr(10) END || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Class: ' || source || chr(10) END || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Method: doc_' || doc_id || chr(10) END || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'Properties: ' || lang || ', ' || source || chr(10) END || chr(10) || text"


def contexts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    context = chunks.full_context(
        F.when(n % 4 != 0, F.col("lang")), F.when(n % 3 == 0, F.lit("")).otherwise(F.col("source")), F.when(n % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("doc_"), n.cast("string"))),
        F.when(n % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source")), F.col("text"),
    )
    return p.table(spark, d, "documents").select("doc_id", context.alias("context"))


@query(f"SELECT doc_id, md5({CONTEXT}) AS context_md5 FROM documents")
def chunk_full_context(spark, d):
    return contexts(spark, d).select("doc_id", F.md5("context").alias("context_md5"))


@query(f"SELECT doc_id, length({CONTEXT}) // 4 AS tokens FROM documents")
def chunk_token_estimate(spark, d):
    return contexts(spark, d).select("doc_id", chunks.estimated_tokens(F.col("context")).alias("tokens"))


def one_method(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of one method each, named after the document."""
    files_ = p.parsed(spark, d).drop("methods", "properties")
    docs = p.table(spark, d, "documents").select(F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("file_path"), "doc_id", "text")
    method = F.struct(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("body"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.array().cast("array<string>").alias("callees"))
    return files_.join(docs, "file_path").withColumns({"methods": F.array(method), "properties": F.array().cast("array<string>")})


HEAD = "length('Package: ' || lang || chr(10) || 'Class: ' || source || chr(10) || 'Method: doc_' || doc_id || chr(10) || chr(10))"


@query(f"SELECT doc_id, CASE WHEN cut THEN 1969 ELSE length(text) END AS out_len, cut AS truncated FROM (SELECT *, ({HEAD} + length(text)) // 4 > 500 AND length(text) > 2000 AS cut FROM documents)")
def chunk_truncate(spark, d):
    out = chunks.chunk(one_method(spark, d), max_tokens=500)
    return out.select(F.substring_index("method_name", "_", -1).cast("long").alias("doc_id"), chunks.units(F.col("content")).alias("out_len"), F.col("content").endswith(chunks.CUT_MARK).alias("truncated"))


@query("SELECT doc_id FROM documents WHERE length('Package: ' || lang || chr(10) || 'Class: ' || text || chr(10) || chr(10) || '// No methods found in file') // 4 <= 500")
def chunk_drop_oversize(spark, d):
    docs = p.table(spark, d, "documents").select("doc_id", F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("file_path"), "text")
    bare = p.parsed(spark, d).join(docs, "file_path").withColumns({"class_name": F.col("text"), "methods": F.filter("methods", lambda m: F.lit(False)), "properties": F.array().cast("array<string>")})
    return chunks.chunk(bare, max_tokens=500).select(F.substring_index("file_path", "/", -1).cast("long").alias("doc_id"))


@query(f"WITH {p.PATHS_SQL} SELECT path, '' AS method_name, length(text) AS content_len FROM paths WHERE {LANGUAGE} IS NULL")
def fallback_whole_file(spark, d):
    rows = p.paths(spark, d).select("path", F.col("text").alias("content"), F.lit(None).cast("string").alias("error"))
    return whole_files(rows).select(F.col("file_path").alias("path"), "method_name", F.length("content").cast("long").alias("content_len"))


CALLED = r"([A-Za-z_][A-Za-z0-9_]*)\("  # the oracle's own


@query(f"SELECT page_id, callee, count(*) AS cnt FROM (SELECT page_id, unnest(regexp_extract_all(html, '{CALLED}', 1)) AS callee FROM pages) GROUP BY ALL")
def callee_regexp(spark, d):
    """Callees of texts that no parser knows."""
    found = p.table(spark, d, "pages").select("page_id", F.explode(called_names(F.col("html"))).alias("callee"))
    return found.groupBy("page_id", "callee").agg(F.count("*").alias("cnt"))


METADATA_ROWS = (
    "('/src/HelloWorld.java', 'JAVA', 'com.example', 'HelloWorld', 'message,other,counts'), ('/src/vector.cpp', 'CPP', 'store', 'Vector', 'n,m'), ('/src/tool.py', 'PYTHON', '', 'Tool', 'size'), "
    "('/src/add.ts', 'TYPESCRIPT', '', '', ''), ('/src/main.go', 'GO', 'main', 'Server', 'host,port'), ('/src/top.rs', 'RUST', '', 'P', 'x,y'), ('/src/nul.py', 'PYTHON', '', '', ''), "
    "('/src/notes.txt', NULL, '', '', ''), ('/src/bad.py', 'PYTHON', '', '', '')"
)


@query(f"SELECT * FROM (VALUES {METADATA_ROWS}) AS t(file_path, language, package_name, class_name, properties)")
def parse_metadata(spark, d):
    """Package, class and fields of small sources: decorated and templated ones, several names in a declaration."""
    return parse_files(p.sources(spark)).select("file_path", "language", "package_name", "class_name", F.array_join("properties", ",").alias("properties"))


METHOD_ROWS = (
    "('/src/HelloWorld.java', 0, 'HelloWorld', '', 'message', 8, 8), ('/src/HelloWorld.java', 1, 'sayHello', 'Map<K, String>', 'to,n', 11, 14), ('/src/HelloWorld.java', 2, 'getMessage', 'String', '', 16, 16), "
    "('/src/vector.cpp', 0, 'Vector', '', 'a', 5, 5), ('/src/vector.cpp', 1, '~Vector', '', '', 6, 6), ('/src/vector.cpp', 2, 'size', 'int', '', 7, 7), "
    "('/src/tool.py', 0, 'run', 'int', 'self,a,rest', 4, 5), ('/src/tool.py', 1, 'last', '', 'self', 10, 11), ('/src/add.ts', 0, 'add', 'number', 'a,b', 1, 1), ('/src/add.ts', 1, 'each', '', 'list', 2, 4), "
    "('/src/main.go', 0, 'Run', 'error', 'a', 7, 9), ('/src/top.rs', 0, 'new', 'P', 'x', 3, 3)"
)


def methods(spark: SparkSession) -> DataFrame:
    return parse_files(p.sources(spark)).select("file_path", F.posexplode("methods").alias("pos", "m")).select("file_path", "pos", "m.*")


@query(f"SELECT file_path, CAST(pos AS INT) AS pos, name, return_type, parameters, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line FROM (VALUES {METHOD_ROWS}) AS t(file_path, pos, name, return_type, parameters, start_line, end_line)")
def parse_methods(spark, d):
    """Methods in source order: constructors, destructors, generics, arrows, generators, and what a syntax error leaves."""
    return methods(spark).select("file_path", "pos", "name", "return_type", F.array_join("parameters", ",").alias("parameters"), "start_line", "end_line")


BODY_ROWS = (
    "('/src/HelloWorld.java', 'HelloWorld', '{ this.message = check(message); }'), ('/src/HelloWorld.java', 'getMessage', '{ return message; }'), ('/src/vector.cpp', 'Vector', '{ init(a); }'), "
    "('/src/vector.cpp', '~Vector', '{ release(); }'), ('/src/vector.cpp', 'size', '{ return count(); }'), ('/src/tool.py', 'run', '        return outer(inner(a))'), ('/src/tool.py', 'last', '        self.run(1)'), "
    "('/src/add.ts', 'add', 'plus(a, b)'), ('/src/top.rs', 'new', '{ make(x) }')"
)


@query(f"SELECT * FROM (VALUES {BODY_ROWS}) AS t(file_path, name, body)")
def parse_bodies(spark, d):
    """The text of each method's body that is one line."""
    return methods(spark).filter(~F.contains("body", F.lit("\n"))).select("file_path", "name", "body")


CALLEE_ROWS = (
    "('/src/HelloWorld.java', 'HelloWorld', 0, 'check'), ('/src/HelloWorld.java', 'sayHello', 0, 'println'), ('/src/HelloWorld.java', 'sayHello', 1, 'getMessage'), ('/src/HelloWorld.java', 'sayHello', 2, 'build'), "
    "('/src/vector.cpp', 'Vector', 0, 'init'), ('/src/vector.cpp', '~Vector', 0, 'release'), ('/src/vector.cpp', 'size', 0, 'count'), ('/src/tool.py', 'run', 0, 'outer'), ('/src/tool.py', 'run', 1, 'inner'), "
    "('/src/tool.py', 'last', 0, 'run'), ('/src/add.ts', 'add', 0, 'plus'), ('/src/add.ts', 'each', 0, 'next'), ('/src/main.go', 'Run', 0, 'listen'), ('/src/top.rs', 'new', 0, 'make')"
)


@query(f"SELECT file_path, name, CAST(pos AS INT) AS pos, callee FROM (VALUES {CALLEE_ROWS}) AS t(file_path, name, pos, callee)")
def parse_callees(spark, d):
    """Calls of each method, outer ones before those within them."""
    return methods(spark).select("file_path", "name", F.posexplode("callees").alias("pos", "callee"))


@query(
    f"WITH {p.PARSED_SQL} SELECT 'total_chunks' AS metric, CAST(sum(greatest(n, 1)) AS BIGINT) AS value FROM files UNION ALL SELECT 'vectors', CAST(sum(greatest(n, 1)) AS BIGINT) FROM files "
    "UNION ALL SELECT 'nodes', count(*) FROM all_nodes UNION ALL SELECT 'edges', count(*) FROM all_edges UNION ALL SELECT 'total_calls', count(*) FROM calls"
)
def index_stats(spark, d):
    parsed = p.parsed(spark, d)
    chunked = chunks.chunk(parsed)
    nodes = extract.nodes(parsed)
    return index.stats(chunked, vectors.last_wins(chunked.select(*vectors.KEY, "content", "seq"), vectors.KEY, "seq"), nodes, graph.insert_edges(nodes, extract.edges(parsed)), extract.calls(parsed))


# Embedding

PAYLOADS = [(1, '{"data": [{"embedding": [1.0, 2.5]}]}', "1.0,2.5"), (2, '{"embedding": [3.0]}', "3.0"), (3, '{"embeddings": [[4.0, 5.0], [6.0]]}', "4.0,5.0"), (4, '{"data": [], "embedding": [7.5]}', "7.5"), (5, '{"data": [{"embedding": [8.0]}], "embedding": [9.0]}', "8.0"), (6, '{"other": 1}', None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {'NULL' if v is None else repr(v)})" for i, _, v in PAYLOADS) + ") AS t(id, embedding_str)")
def http_payload_parse(spark, d):
    rows = spark.createDataFrame([(i, text) for i, text, _ in PAYLOADS], "id long, payload string")
    return rows.select("id", F.array_join(fe.payload_vector(F.col("payload")).cast("array<string>"), ",").alias("embedding_str"))


# The mock's vectors in SQL: a text's polynomial hash over UTF-16 units seeds a 48-bit generator, whose i-th state is a jump.
UNITS = "flatten([CASE WHEN unicode(c) > 65535 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] ELSE [unicode(c)] END for c in string_split(text, '') if c <> ''])"
DRAWS = (
    "jump AS (SELECT 0 AS i, CAST(25214903917 AS HUGEINT) AS a, CAST(11 AS HUGEINT) AS c UNION ALL "
    "SELECT i + 1, a * 25214903917 % 281474976710656, (c * 25214903917 + 11) % 281474976710656 FROM jump WHERE i < 767), "
    f"hashed AS (SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), {UNITS}), lambda h, u: (h * 31 + u) % 4294967296) AS h FROM texts), "
    "seeded AS (SELECT id, xor(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END, 25214903917) & 281474976710655 AS seed FROM hashed), "
    "draws AS (SELECT id, i, CAST((a * seed + c) % 281474976710656 // 16777216 AS DOUBLE) / 16777216 * 2 - 1 AS x FROM seeded, jump), "
    "norms AS (SELECT id, sqrt(sum(x * x)) AS norm FROM draws GROUP BY id)"
)
MOCK_VALUES = ", ".join(f"round(max(CASE WHEN i = {i} THEN x / norm END), 2) + 0.0 AS v{i}" for i in (0, 1, 767))


@query(
    f"WITH RECURSIVE texts AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {DRAWS} "
    f"SELECT id AS doc_id, CAST(count(*) AS BIGINT) AS dim, CAST(sum(CASE WHEN x > 0 AND i < 48 THEN CAST(1 AS BIGINT) << i ELSE 0 END) AS BIGINT) AS signs, {MOCK_VALUES} FROM draws JOIN norms USING (id) GROUP BY id"
)
def mock_embed(spark, d):
    """Number of values, the signs of the first 48 as bits, and three values."""
    docs = fe.embed(p.table(spark, d, "documents").select("doc_id", "text"), "text", fe.create("mock"))
    bits = F.transform(F.slice("embedding", 1, 48), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    values = [(F.round(F.col("embedding")[i].cast("double"), 2) + 0.0).alias(f"v{i}") for i in (0, 1, 767)]
    return docs.select("doc_id", F.size("embedding").cast("long").alias("dim"), F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b).alias("signs"), *values)


@query(
    f"WITH RECURSIVE texts AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL (SELECT -1, text FROM benchmark ORDER BY item_id LIMIT 1)), {DRAWS}, "
    "scored AS (SELECT d.id AS doc_id, sum(d.x * q.x) / (any_value(n.norm) * any_value(m.norm)) AS similarity FROM draws d JOIN draws q ON q.id = -1 AND q.i = d.i JOIN norms n ON n.id = d.id JOIN norms m ON m.id = -1 WHERE d.id <> -1 GROUP BY d.id) "
    "SELECT row_number() OVER (ORDER BY round(similarity, 6) DESC, doc_id) AS rank, doc_id, round(similarity, 4) AS similarity FROM scored QUALIFY rank <= 5"
)
def text_search(spark, d):
    model = fe.create("mock")
    text = p.table(spark, d, "benchmark").orderBy("item_id").first()["text"]
    q = spark.createDataFrame([(model.vector(text),)], "query_vector array<float>")
    stored = fe.embed(p.table(spark, d, "documents").select("doc_id", "text"), "text", model)
    return vectors.ranked(vectors.top_k(stored, q, 5, key=("doc_id",)), ["doc_id"]).select("rank", "doc_id", F.round("similarity", 4).alias("similarity"))


@query("SELECT * FROM (VALUES ('/src/bad.py', 'not valid UTF-8'), ('/src/nul.py', 'SyntaxError: source code string cannot contain null bytes')) AS t(path, error)")
def build_errors(spark, d):
    """Files that can't be read or parsed; the others are parsed all the same."""
    return index.errors(parse_files(p.sources(spark)))
