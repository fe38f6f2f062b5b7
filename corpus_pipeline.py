"""The training corpus: documents through language ID, near-dedup, decontamination, PII redaction and encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents. There is no SQL for them; tests hold each stage against its operator, and each operator against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeatlas.llm import common, decontaminate, language_id, near_dedup, pii, sentencepiece_lattice

STAGES = [
    ("language_id", language_id.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("sentencepiece", sentencepiece_lattice.stage),
]

#: SQL can express neither the classifier, MinHash, alignment, boosted trees nor the lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder as Parquet and read again.

    What a stage cut for itself is deleted when its rows are written, and its input when the next stage has read it.
    """
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with common.scratch(spark):
            rows = stage(spark, docs, sf_dir)
            with common.outside():
                docs = common.cut(rows, f"stage-{name}")
        common.drop(before)
    return docs
