import importlib.util

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline isn't there", allow_module_level=True)

import corpus_pipeline
from codeatlas.llm import common, decontaminate, language_id, near_dedup, pii, registry


def test_stages_one_after_the_other(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    names, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = common.cut(stage(spark, before, sf_dir), name)
        assert kept.columns == names
        ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
        if name == "language_id":
            want = language_id.predict(before, language_id.fit(before)).filter("not rejected")
        elif name == "near_dedup":
            want = near_dedup.near_duplicates(before).filter("kept")
        elif name == "decontamination":
            want = before.join(decontaminate.hits(before, common.table(spark, sf_dir, "benchmark")), "doc_id", "left_anti")
        else:
            want = before
            assert pii.find(kept).filter("size(pii_base) > 0").count() == 0
        assert ids(kept) == ids(want)
    last = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r["doc_id"] for r in last.collect()) == ids(kept) and last.filter("not round_trip").count() == 0


def test_odd_repeated_and_no_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, clashing column names, and an empty table, through all stages."""
    from .helpers import ODD, documents

    words = "the thing there other that with which were from".split()
    texts = [" ".join(words[(i * k) % 9] for k in range(40)) + f" end{i}" for i in range(1, 13)]
    df = documents(spark, [*texts, *ODD], extra=True)
    df = df.union(df.limit(2)).union(df.limit(1).selectExpr("cast(null as long) as doc_id", *df.columns[1:]))
    bench = spark.createDataFrame([(1, "a passage of the benchmark that no document holds at all")], "item_id long, text string")
    for name, docs in (("some", df), ("none", df.limit(0))):
        at = str(tmp_path / name)
        docs.write.parquet(f"{at}/documents.parquet")
        bench.write.parquet(f"{at}/benchmark.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        if name == "none":
            assert got == []
        else:
            assert {r["doc_id"] for r in got} >= {3, 4} and all(r["round_trip"] for r in got) and None not in {r["doc_id"] for r in got}


def test_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in entry.queries()} and "pipeline" in entry.queries()
    assert set(registry.oracle_sql()) == {"op3_chat_formatting"} and set(entry.oracle_sql()) <= set(entry.queries())
