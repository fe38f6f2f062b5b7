"""The vector store: upsert, count, exact top-k, ranks and result lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions import vectors as fv

KEY = ("file_path", "method_name")


def last_wins(rows: DataFrame, key: list[str] | tuple[str, ...], seq: str) -> DataFrame:
    """Of each key the row of the greatest seq, without seq.

    An aggregate, so that rows of a hot key are combined before the shuffle.
    """
    rest = [c for c in rows.columns if c not in (*key, seq)]
    if not rest:
        return rows.select(*key).distinct()
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("last"))
    return best.select(*(F.col(c) if c in key else F.col(f"last.{c}").alias(c) for c in rows.columns if c != seq))


def upsert(existing: DataFrame | None, new: DataFrame, key: list[str] | tuple[str, ...] = KEY, seq: str = "seq") -> DataFrame:
    """Rows of existing whose key isn't in new, and the last row of each key of new. Null texts in the key become empty."""
    kinds = dict(new.dtypes)
    new = new.withColumns({c: F.coalesce(c, F.lit("")) for c in key if kinds[c] == "string"})
    last = last_wins(new, key, seq)
    if existing is None:
        return last
    return existing.join(last.select(*key), list(key), "left_anti").select(last.columns).unionByName(last)


def count(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("cnt"))


def with_similarity(vectors: DataFrame, query: DataFrame, embedding: str = "embedding") -> DataFrame:
    """vectors with similarity to the one row of query (column `query_vector`), which is broadcast: an aggregate makes it one.

    No row gives no rows, and several fail.
    """
    one = query.agg(F.any_value("query_vector").alias("query_vector"), F.count("*").alias("n")).filter(F.when(F.col("n") > 1, F.raise_error(F.lit("more than one query vector"))).otherwise(F.col("n") == 1))
    one = one.select("query_vector", fv.length(F.col("query_vector")).alias("query_length"))
    similarity = fv.cosine(F.col(embedding), F.col("query_vector"), length_b=F.col("query_length"))
    return vectors.crossJoin(F.broadcast(one)).withColumn("similarity", similarity).drop("query_vector", "query_length")


def top_k(vectors: DataFrame, query: DataFrame, k: int, key: list[str] | tuple[str, ...] = KEY, embedding: str = "embedding") -> DataFrame:
    """The key and similarity of the k nearest vectors, most similar first, ties by key; k below 1 gives none.

    Only key and score go through the selection; join other columns to its k rows.
    """
    scored = with_similarity(vectors.select(*key, embedding), query, embedding).select(*key, "similarity")
    return scored.orderBy(F.desc("similarity"), *key).limit(max(0, k))


def batch_top_k(vectors: DataFrame, queries: DataFrame, query_key: str, k: int, key: list[str] | tuple[str, ...], embedding: str = "embedding", block: int = 512) -> DataFrame:
    """The k nearest vectors of each query (query_key, query_vector). Extension.

    Queries are taken in blocks of about `block` rows, each broadcast; per block only k scores a query leave a partition.
    Norms are computed once a vector, not once a pair.
    """
    vectors = vectors.select(*key, embedding, fv.length(F.col(embedding)).alias("own_length"))
    queries = queries.select(query_key, "query_vector", fv.length(F.col("query_vector")).alias("query_length"))
    n = max(1, -(-queries.count() // block))  # no queries: one empty block
    out = None
    for i in range(n):
        part = queries.filter(F.pmod(F.xxhash64(query_key), F.lit(n)) == i) if n > 1 else queries
        similarity = fv.cosine(F.col(embedding), F.col("query_vector"), F.col("own_length"), F.col("query_length"))
        scored = vectors.crossJoin(F.broadcast(part)).select(query_key, *key, similarity.alias("similarity"))
        w = Window.partitionBy(query_key).orderBy(F.desc("similarity"), *key)
        best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out


def ranked(hits: DataFrame, key: list[str] | tuple[str, ...]) -> DataFrame:
    """hits (a top-k, so few rows) with rank 1 .. n."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), *key)).cast("long"))


def result_lines(hits: DataFrame, path: str = "file_path") -> DataFrame:
    """line: the text that a search prints for each ranked hit."""
    return hits.select(F.format_string("%d. %s (similarity: %.4f)", "rank", path, "similarity").alias("line"))
