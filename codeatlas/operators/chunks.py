"""Chunks: one per method with its context, as Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits (fixed values): tokens of a chunk, characters of a token, characters kept short of the limit, what a cut body ends with.
MAX_TOKENS, CHARS_PER_TOKEN, MARGIN = 32_000, 4, 50
CUT_MARK = "\n// ... (truncated)"
NO_METHODS = "// No methods found in file"


def units(text: Column) -> Column:
    """Length in UTF-16 units: a character beyond the basic plane counts twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def header(name: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value, F.lit("\n"))).otherwise(F.lit(""))


def full_context(package: Column, class_name: Column, method: Column, properties: Column, content: Column) -> Column:
    """Header lines of what is known, an empty line, the content."""
    fields = header("Properties", F.array_join(properties, ", "))
    return F.concat(header("Package", package), header("Class", class_name), header("Method", method), fields, F.lit("\n"), F.coalesce(content, F.lit("")))


def estimated_tokens(context: Column) -> Column:
    return F.floor(units(context) / CHARS_PER_TOKEN).cast("long")


def truncated(content: Column, max_chars: int) -> Column:
    """A content of over max_chars units cut to MARGIN less, with a mark; others unchanged."""
    cut = F.concat(first_units(content, max_chars - MARGIN), F.lit(CUT_MARK))
    return F.when(units(content) > max_chars, cut).otherwise(content)


def first_units(text: Column, n: int) -> Column:
    """The first n UTF-16 units; half a surrogate pair at the cut is lost."""
    short = F.substring(text, 1, max(0, n))
    whole = F.decode(F.substring(F.encode(text, "UTF-16BE"), 1, 2 * max(0, n)), "UTF-16BE")
    return F.when(units(short) == F.length(short), short).otherwise(F.regexp_replace(whole, "�$", ""))


def chunk(parsed: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """A row for each method of each parsed file; a file without methods gives one placeholder row.

    A method whose context has over max_tokens tokens has its body cut, if the body alone is over the limit. A placeholder
    row over the limit is dropped. seq numbers a file's methods in source order.
    """
    limit = max_tokens * CHARS_PER_TOKEN
    rows = parsed.filter(F.col("error").isNull()) if "error" in parsed.columns else parsed
    rows = rows.select("file_path", *(F.coalesce(c, F.lit("")).alias(c) for c in ("package_name", "class_name")), "properties", F.posexplode_outer("methods").alias("seq", "m"))
    bare = F.col("m").isNull()
    rows = rows.select(
        "file_path", "package_name", "class_name", F.coalesce("m.name", F.lit("")).alias("method_name"), F.when(bare, F.lit(NO_METHODS)).otherwise(F.col("m.body")).alias("content"),
        F.when(bare, 1).otherwise(F.col("m.start_line")).alias("start_line"), F.when(bare, 1).otherwise(F.col("m.end_line")).alias("end_line"), "properties",
        F.coalesce("m.callees", F.array().cast("array<string>")).alias("callees"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), bare.alias("bare"),
    )
    context = full_context(F.col("package_name"), F.col("class_name"), F.col("method_name"), F.col("properties"), F.col("content"))
    over = estimated_tokens(context) > max_tokens
    rows = rows.filter(~(F.col("bare") & over)).withColumn("content", F.when(over, truncated(F.col("content"), limit)).otherwise(F.col("content")))
    rows = rows.withColumn("full_context", context).withColumn("est_tokens", estimated_tokens(F.col("full_context")).cast("int"))
    return rows.select("file_path", "package_name", "class_name", "method_name", "content", "start_line", "end_line", "properties", "callees", "full_context", "est_tokens", "seq")
