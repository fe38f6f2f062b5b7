"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codeatlas.shared import cut, drop, outside, scratch, share_code

__all__ = ["BROADCAST_ROWS", "by_batch", "by_ids", "cut", "drop", "mapped", "outside", "release", "scratch", "share_code", "slices", "spread", "table"]

#: A set of ids or hashes is broadcast up to this many rows (16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Bytes of an Arrow batch that goes to a worker, where the session has Spark's own bound (64 MB).
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")
#: A join key with more rows than this is dealt over several tasks.
HOT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """left_semi or left_anti join on doc_id; ids is broadcast if it has at most BROADCAST_ROWS rows, else both are shuffled."""
    few = ids.count() <= BROADCAST_ROWS
    return docs.join(broadcast(ids) if few else ids, "doc_id", how).select(docs.columns)


def spread(big: DataFrame, small: DataFrame, on: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """big joined to small, in which `on` is a key, so that rows of big with one value of `on` are dealt over tasks of about hot_rows.

    A hot value's rows get one of several salts, and its row of small is copied for each. Values are hot by a count over
    all of big; of more than BROADCAST_ROWS hot ones the hottest are salted.
    """
    counted = big.groupBy(on).agg(F.ceil(F.count("*") / hot_rows).cast("int").alias("salts_")).filter("salts_ > 1")
    if counted.isEmpty():
        return big.join(small, on, how)
    hot = cut(counted.orderBy(F.desc("salts_"), on).limit(BROADCAST_ROWS), "hot")
    salts = F.coalesce("salts_", F.lit(1))
    dealt = big.join(broadcast(hot), on, "left").withColumn("salt_", F.pmod(F.xxhash64(*big.columns), salts).cast("int"))
    copied = small.join(broadcast(hot), on, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.drop("salts_").join(copied.drop("salts_"), [on, "salt_"], how).drop("salt_")


def by_batch(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow over lists: make() runs once a task and returns the function from a batch's columns to the new columns."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch):
                columns = f({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], type=x.type) for x in out], schema=out)

    return mapped(df, run, schema)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow that gives a task's memory back to the system when the task ends: workers live on between tasks.

    A session that has Spark's own bound for the bytes of a batch gets a lower one, BATCH, from here on: batches of long texts
    are held several times over, by the executor and by its workers.
    """

    share_code(df.sparkSession)
    setting, default, lower = BATCH
    if df.sparkSession.conf.get(setting, None) == default:
        df.sparkSession.conf.set(setting, lower)

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(freed, schema)


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of about `most` bytes (one row at least), so that long texts never pile up in a worker."""
    if not batch.num_rows:
        return
    step = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
