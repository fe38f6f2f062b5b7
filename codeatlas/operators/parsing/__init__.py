"""Source text to package, class, properties and methods."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas import schemas
from codeatlas.functions.language import language
from codeatlas.operators.parsing import braces, python_source, words
from codeatlas.shared import share_code

EMPTY = {"package_name": "", "class_name": "", "properties": [], "methods": []}


#: A call in text of any language: a name and a bracket.
CALLED = r"([A-Za-z_][A-Za-z0-9_]*)\("


def called_names(text: Column) -> Column:
    """array<string> of the names that stand before a bracket, repeated ones kept: callees where nothing parses the language."""
    return F.regexp_extract_all(text, F.lit(CALLED), F.lit(1))


def parse(code: str, lang: str) -> dict:
    """The parts of a source text. What a syntax error leaves readable is kept; a Python text that can't be read at all (one with NUL) raises."""
    if lang == "PYTHON":
        return python_source.parse(code)
    if lang in words.LANGUAGES:
        return words.parse(code, lang)
    return braces.parse(code, lang)


def parse_files(files: DataFrame) -> DataFrame:
    """A parsed row for each file (path, content, error). What a file of a known language fails with becomes its error; others go on.

    Files of unknown language keep a null language; `whole_files` turns them into rows.
    """

    share_code(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, lang, content, error in zip(batch["path"], batch["language"], batch["content"], batch["error"], strict=True):
                found = dict(EMPTY)
                if error is None and lang is not None:
                    try:
                        found = parse(content or "", lang)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                rows.append({"file_path": path, "language": lang, **found, "error": error})
            yield pd.DataFrame(rows, columns=["file_path", "language", *EMPTY, "error"])

    return files.select("path", language(F.col("path")).alias("language"), "content", "error").mapInPandas(run, schemas.PARSED)


def whole_files(files: DataFrame) -> DataFrame:
    """A row with the whole text, and empty names, for each readable file of unknown language."""
    rows = files.filter(language(F.col("path")).isNull() & F.col("error").isNull())
    empty = F.lit("")
    return rows.select(F.col("path").alias("file_path"), empty.alias("package_name"), empty.alias("class_name"), empty.alias("method_name"), "content")
