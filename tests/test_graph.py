import random

import pytest

from codeatlas.operators import graph


def make(spark, nodes, edges):
    n = spark.createDataFrame([(x, "t", x, "/f") for x in nodes], "node_id string, node_type string, name string, file_path string")
    return n, spark.createDataFrame([(s, d, r, i) for i, (s, d, r) in enumerate(edges)], "src string, dst string, rel string, edge_seq long")


def ids(df):
    return sorted(r["node_id"] for r in df.collect())


def depths(df):
    return {r["node_id"]: r["depth"] for r in df.collect()}


def dfs(spark, n, e, start, depth, rels=None):
    found = graph.dfs(n, e, spark.createDataFrame([(start,)], "root string"), depth, rels)
    return [r["node_id"] for r in found.orderBy("pos").collect()]


BOUND = (["A", "B", "C", "D"], [("A", "B", "calls"), ("B", "C", "calls"), ("A", "C", "calls"), ("C", "D", "calls")])


def test_a_depth_bound_hides_from_depth_first_what_breadth_first_reaches(spark):
    n, e = make(spark, *BOUND)
    assert ids(graph.bfs(n, e, "A", 2)) == ["A", "B", "C", "D"]
    assert dfs(spark, n, e, "A", 2) == ["A", "B", "C"]


@pytest.mark.parametrize(("depth", "breadth", "deep"), [(0, ["A"], ["A"]), (-1, ["A"], [])])
def test_depths_below_one(spark, depth, breadth, deep):
    n, e = make(spark, *BOUND)
    assert ids(graph.bfs(n, e, "A", depth)) == breadth
    assert dfs(spark, n, e, "A", depth) == deep


def test_unknown_start_reaches_nothing(spark):
    n, e = make(spark, *BOUND)
    assert graph.bfs(n, e, "X", 3).count() == 0 and dfs(spark, n, e, "X", 3) == []


def test_relationship_filter(spark):
    n, e = make(spark, "ABC", [("A", "B", "extends"), ("A", "C", "calls")])
    assert depths(graph.bfs(n, e, "A", 2, {"extends"})) == {"A": 0, "B": 1}
    assert ids(graph.bfs(n, e, "A", 2, set())) == ["A", "B", "C"]


@pytest.mark.parametrize("direction", ["OUTGOING", "INCOMING", "BOTH", "outgoing"])
def test_a_self_loop_makes_a_node_its_neighbour_once(spark, direction):
    n, e = make(spark, "A", [("A", "A", "calls")])
    assert ids(graph.neighbors(n, e, "A", direction=direction)) == ["A"]


def test_neighbours(spark):
    n, e = make(spark, ["1", "2", "3"], [("1", "2", "extends"), ("1", "3", "contains")])
    assert ids(graph.neighbors(n, e, "1")) == ["2", "3"]
    assert ids(graph.neighbors(n, e, "1", "extends")) == ["2"]
    assert ids(graph.neighbors(n, e, "2", direction="INCOMING")) == ["1"]
    assert ids(graph.neighbors(n, e, "2", direction="outgoing")) == ["1"]


def test_edges_need_both_ends_and_count_once_per_relationship(spark):
    n, e = make(spark, "AB", [("A", "Z", "calls"), ("A", "B", "calls"), ("A", "B", "calls"), ("A", "B", "uses")])
    assert graph.edge_count(graph.insert_edges(n, e)).first()["cnt"] == 2


def test_node_upsert_and_lookup(spark):
    log = spark.createDataFrame([("1", "class", "C", "/file1", 0), ("1", "class", "C", "/file2", 1)], "node_id string, node_type string, name string, file_path string, seq int")
    nodes = graph.upsert_nodes(log, "seq")
    assert nodes.count() == 1 and graph.find_by_name(nodes, "C").first()["file_path"] == "/file2"


def test_sample_graph(spark):
    n, e = graph.sample(spark)
    assert (n.count(), e.count()) == (7, 8)
    want = {"class:MyClass": 0, "method:processData": 1, "method:saveData": 1, "method:connect": 2}
    assert depths(graph.bfs(n, e, "class:MyClass", 10, {"contains", "calls"})) == want
    assert set(dfs(spark, n, e, "class:MyClass", 10)) == set(ids(n))
    walk = [r["node_id"] for r in graph.traverse(n, e, "class:MyClass", mode="dfs").orderBy("pos").collect()]
    assert walk[:2] == ["class:MyClass", "class:BaseClass"] and len(walk) == 7
    assert graph.traverse(n, e, "class:MyClass", mode="anything").orderBy("pos").first()["node_id"] == "class:MyClass"


def brute(edges, start, bound):
    children = {}
    for s, d, _ in edges:
        children.setdefault(s, []).append(d)
    dist, todo = {start: 0}, [start]
    for v in todo:
        for c in children.get(v, ()) if dist[v] < bound else ():
            if c not in dist:
                dist[c] = dist[v] + 1
                todo.append(c)
    order = []

    def visit(v, at):
        if at <= bound and v not in order:
            order.append(v)
            for c in children.get(v, ()):
                visit(c, at + 1)

    visit(start, 0)
    return dist, order


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_on_random_cyclic_graphs(spark, seed):
    r = random.Random(seed)
    nodes = [str(i) for i in range(12)]
    edges = list({(r.choice(nodes), r.choice(nodes), "calls") for _ in range(26)})
    n, e = make(spark, nodes, edges)
    dist, order = brute(edges, "0", 3)
    assert depths(graph.bfs(n, e, "0", 3)) == dist
    assert dfs(spark, n, e, "0", 3) == order


def test_numbers_over_ranges(spark):
    from codeatlas.shared import numbered

    df = spark.range(1000).selectExpr("id * 7919 % 1000 as v", "'x' as w")
    assert all(r["v"] == r["n"] for r in numbered(df, "n", "v").collect())
    assert numbered(df.limit(0), "n", "v").count() == 0
