import pytest
from pyspark.sql import functions as F

from codeatlas.functions import vectors as fv
from codeatlas.operators import vectors

SCHEMA = "file_path string, method_name string, content string, embedding array<float>, seq long"


def store(spark, *rows):
    return spark.createDataFrame([(p, m, c, e, i) for i, (p, m, c, e) in enumerate(rows)], SCHEMA)


def query(spark, v):
    return spark.createDataFrame([(v,)], "query_vector array<float>")


def test_nearest_two_in_order(spark):
    df = store(spark, ("f1", "", "a", [1.0, 0.0, 0.0]), ("f2", "", "b", [0.0, 1.0, 0.0]), ("f3", "", "c", [0.9, 0.1, 0.0]))
    hits = vectors.top_k(df, query(spark, [1.0, 0.0, 0.0]), 2).collect()
    assert [h["file_path"] for h in hits] == ["f1", "f3"]
    assert hits[0]["similarity"] > 0.99 and hits[1]["similarity"] > 0.89


@pytest.mark.parametrize("k", [0, -1])
def test_no_hits_for_a_limit_below_one(spark, k):
    assert vectors.top_k(store(spark, ("f", "", "a", [1.0])), query(spark, [1.0]), k).count() == 0


def test_empty_store(spark):
    assert vectors.top_k(spark.createDataFrame([], SCHEMA), query(spark, [1.0]), 5).count() == 0


def test_zero_vector_has_similarity_zero(spark):
    df = store(spark, ("f", "", "a", [0.0, 0.0]))
    assert vectors.top_k(df, query(spark, [1.0, 0.0]), 1).first()["similarity"] == 0.0


def test_lengths_must_agree(spark):
    with pytest.raises(Exception, match="different lengths"):
        vectors.top_k(store(spark, ("f", "", "a", [1.0, 2.0])), query(spark, [1.0]), 1).collect()


def test_ties_go_by_key(spark):
    df = store(spark, ("b", "", "x", [1.0]), ("a", "z", "x", [1.0]), ("a", "y", "x", [1.0]))
    hits = vectors.top_k(df, query(spark, [1.0]), 3).collect()
    assert [(h["file_path"], h["method_name"]) for h in hits] == [("a", "y"), ("a", "z"), ("b", "")]


def test_upsert_replaces_by_path_and_method(spark):
    old = store(spark, ("f", "m", "old", [1.0]), ("g", "m", "stays", [1.0])).drop("seq")
    new = store(spark, ("f", "m", "first", [1.0]), ("f", "m", "last", [2.0]), ("f", None, "other", [3.0]))
    got = {(r["file_path"], r["method_name"]): r["content"] for r in vectors.upsert(old, new).collect()}
    assert got == {("f", "m"): "last", ("g", "m"): "stays", ("f", ""): "other"}


def test_upsert_without_a_table(spark):
    assert vectors.upsert(None, store(spark, ("f", "", "a", [1.0]), ("f", "", "b", [1.0]))).first()["content"] == "b"


def test_batch_top_k_over_blocks_equals_one_block(spark):
    df = spark.range(40).select(F.col("id").alias("v"), F.array(F.sin("id").cast("float"), F.cos("id").cast("float")).alias("embedding"))
    q = df.filter("v % 7 = 0").select(F.col("v").alias("q"), F.col("embedding").alias("query_vector"))
    rows = lambda block: sorted(map(tuple, vectors.batch_top_k(df, q, "q", 3, ["v"], block=block).select("q", "v", "rank").collect()))
    assert rows(2) == rows(512) and len(rows(2)) == 18


def test_no_queries_and_several(spark):
    df = store(spark, ("f", "", "a", [1.0]))
    none = spark.createDataFrame([], "q long, query_vector array<float>")
    got = vectors.batch_top_k(df, none, "q", 3, ["file_path"])
    assert got.count() == 0 and got.columns == ["q", "file_path", "similarity", "rank"]
    assert vectors.top_k(df, none.drop("q"), 3).count() == 0
    with pytest.raises(Exception, match="more than one query vector"):
        vectors.top_k(df, query(spark, [1.0]).union(query(spark, [2.0])), 3).collect()


def test_normalized(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(fv.normalized(F.col("v")).alias("u"))
    assert [[round(x, 6) for x in r["u"]] for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_result_lines(spark):
    hits = spark.createDataFrame([(1, "/a.py", 0.98765)], "rank long, file_path string, similarity double")
    assert vectors.result_lines(hits).first()["line"] == "1. /a.py (similarity: 0.9877)"
