"""Every query with SQL gives the rows that DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from codeatlas.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    own = catalogue.queries()[name](spark, sf_dir).toPandas()
    sql = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(own.columns) == sorted(sql.columns)
    assert rows(own) == rows(sql)


def test_top_k_is_a_bounded_selection(spark, sf_dir):
    plan = catalogue.queries()["vector_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_text_search_finds_the_same_text(spark):
    from codeatlas.functions import embedding as fe
    from codeatlas.operators import vectors

    model = fe.create("mock")
    stored = fe.embed(spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, None)], "doc_id long, text string"), "text", model)
    q = spark.createDataFrame([(model.vector("beta"),)], "query_vector array<float>")
    hit = vectors.top_k(stored, q, 1, key=("doc_id",)).first()
    assert hit["doc_id"] == 2 and abs(hit["similarity"] - 1) < 1e-6
