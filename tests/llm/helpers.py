"""Small tables for the operators' tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=False, lang="en"):
    """documents with ids 1, 2 ...; with columns of names that operators use themselves, if extra."""
    df = spark.createDataFrame([(i + 1, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in ("row", "cid", "key", "label", "part", "word", "path", "severity", "edges", "n", "slot")})
    return df


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


ODD = [None, "", "   \n\t ", "a", "x" * 60_000, "word " * 15_000, "Grüße \U0001f600 ①\x00", "same text here now", "same text here now"]
