"""Chat formatting: logged snapshots that longer conversations begin with are dropped, the rest rendered.

Only DataFrame functions. A conversation is one output row, so its turns meet in one task; copies of a conversation, and
turns that many conversations share, meet nowhere before they are aggregated by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (sorted array<struct<turn, role, text>>), prefixes: the rolling hash after each turn."""
    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = clean.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), "role", "text"))).alias("turns"))
    # the lengths keep role and text apart
    one = F.transform("turns", lambda t: F.md5(F.concat_ws(":", F.length(t["role"]).cast("string"), t["role"], t["text"])))
    rolled = F.aggregate(
        one,
        F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all")),
        lambda a, h: F.struct(F.md5(F.concat(a["last"], h)).alias("last"), F.concat(a["all"], F.array(F.md5(F.concat(a["last"], h)))).alias("all")),
        lambda a: a["all"],
    )
    return grouped.withColumn("prefixes", rolled)


def maximal(found: DataFrame) -> DataFrame:
    """conv_id, n_logged: of each run of turns that no other conversation goes on from, the least conv_id, and how many logs are equal to it."""
    whole = found.select("conv_id", F.element_at("prefixes", -1).alias("hash"))
    begun = found.select(F.explode(F.slice("prefixes", 1, F.size("prefixes") - 1)).alias("hash")).distinct()
    return whole.groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged")).join(begun, "hash", "left_anti").select("conv_id", "n_logged")


def rendered(turns: Column) -> Column:
    escaped = lambda t: F.replace(F.replace(t, F.lit("<|"), F.lit("<\\|")), F.lit("\x00"), F.lit(""))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), F.lower(escaped(t["role"])), F.lit("\n"), escaped(t["text"]), F.lit(CLOSE + "\n"))), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_logged, rendered: the maximal conversations.

    A conversation is dropped if its turns, in order, begin a longer one; of equal ones the least conv_id stays. Turns are
    ordered by turn, then role and text; a repeated row counts once. A null role is `unknown`, a null text empty, a null
    turn comes first, and rows without a conv_id are one conversation. `<|` within a text is written `<\\|`, so that no
    text forms a marker. Empty tables give no rows; other columns of turns are ignored.
    """
    found = conversations(turns)
    kept = maximal(found)
    both = found.join(kept.withColumnRenamed("conv_id", "kept_id"), F.col("conv_id").eqNullSafe(F.col("kept_id")))
    return both.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_logged", rendered(F.col("turns")).alias("rendered"))


def query(spark, sf_dir: str) -> DataFrame:
    return format_chats(common.table(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), whole AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS turns FROM turns GROUP BY conv_id
), prefixes AS (
  SELECT DISTINCT conv_id, list_slice(turns, 1, n) AS turns FROM whole, unnest(range(1, len(turns))) AS r(n)
), kept AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_logged, turns FROM whole
  WHERE turns NOT IN (SELECT turns FROM prefixes) GROUP BY turns
)
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, n_logged,
  list_aggregate(list_transform(turns, lambda t: '<|im_start|>' || lower(replace(replace(t.role, '<|', '<\|'), chr(0), '')) || chr(10) || replace(replace(t.text, '<|', '<\|'), chr(0), '') || '<|im_end|>' || chr(10)), 'string_agg', '') AS rendered
FROM kept
"""
