"""Source files: a distributed recursive scan with the same selection everywhere."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions.language import file_name
from codeatlas.shared import share_code

LOG = logging.getLogger("codeatlas")

#: Folders whose files are passed over, and the extensions taken by default (fixed values).
EXCLUDED = ("/.git/", "/node_modules/", "/build/", "/target/", "/.gradle/")
EXTENSIONS = ("java", "kt", "js", "ts", "py", "go", "rs", "cpp", "c", "h", "cs", "rb", "php", "swift", "scala")


def included(path: Column, extensions: list[str] | None = None) -> Column:
    """Whether a path is taken: not hidden, in no excluded folder, and with one of the extensions (case counts)."""
    name = file_name(path)
    fine = ~name.startswith(".")
    for part in EXCLUDED:
        fine &= ~path.contains(part)
    if extensions:
        some = F.lit(False)
        for e in extensions:
            some |= name.endswith(f".{e}")
        return fine & some
    return fine & name.contains(".") & F.substring_index(name, ".", -1).isin(*EXTENSIONS)


def within_depth(relative: Column, depth: int | None) -> Column:
    """Whether a path relative to the root lies at most depth levels below it; 1 means directly in it, None any."""
    return F.lit(True) if depth is None else F.size(F.split(relative, "/")) <= depth


def wanted(path: str, extensions: list[str] | None) -> bool:
    """`included` for one path, so that passed-over files are never read."""
    name = path.rsplit("/", 1)[-1]
    if name.startswith(".") or any(part in path for part in EXCLUDED):
        return False
    return any(name.endswith(f".{e}") for e in (extensions or EXTENSIONS))


def folders_in(folder: str) -> list[str]:
    """The folders directly in a folder; none, with a warning, if it can't be read: the rest of the tree is scanned all the same."""
    try:
        with os.scandir(folder) as found:
            return [e.path for e in found if e.is_dir(follow_symlinks=False)]
    except OSError as e:
        LOG.warning("passed over %s: %s", folder, e)
        return []


def subtrees(root: str, parts: int) -> list[tuple[str, bool]]:
    """Folders to list (alone, or with all below) that together hold the tree: about `parts` or more of them if it has so many."""
    alone, below = [], [root]
    while below and len(below) < parts:
        found = [path for d in below for path in folders_in(d)]
        alone += below
        below = [d for d in found if not any(part in f"{d}/" for part in EXCLUDED)]
    return [(d, False) for d in alone] + [(d, True) for d in below]


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """path, file_name, content, error of the selected files below root, or of root itself if it is a file.

    A missing root gives no rows. Content that isn't UTF-8 is null, with an error. Executors list and read the files: of a
    local or mounted tree by themselves, subtree by subtree; of another store through Spark's reader, which never sees names
    that begin with `_` or `.`.
    """
    if "://" not in root:
        return decoded(local(spark, os.path.abspath(root), extensions, depth))
    root = root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions or EXTENSIONS) + "}")
    found = reader.load(root).select("path", "content")
    found = found.filter(within_depth(F.substring("path", F.lit(len(root) + 2), F.length("path")), depth) | (F.col("path") == root))
    return decoded(found.filter(included(F.col("path"), extensions)))


def local(spark: SparkSession, root: str, extensions: list[str] | None, depth: int | None) -> DataFrame:
    schema = "path string, content binary"
    if not os.path.exists(root):
        return spark.createDataFrame([], schema)
    share_code(spark)
    single = os.path.isfile(root)
    parts = 4 * spark.sparkContext.defaultParallelism
    folders = [(root, False)] if single else subtrees(root, parts)

    def paths(folder: str, below: bool) -> Iterator[str]:
        if single:
            yield folder
            return
        for at, _, names in os.walk(folder):
            yield from (f"{at}/{n}" for n in names)
            if not below:
                return

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for folder, below in zip(batch["folder"], batch["below"], strict=True):
                for path in paths(folder, below):
                    if not wanted(path, extensions) or not os.path.isfile(path):
                        continue
                    if depth is not None and path[len(root) :].count("/") > depth and not single:
                        continue
                    try:
                        with open(path, "rb") as f:
                            rows.append((path, f.read()))
                    except OSError:
                        rows.append((path, None))
                    size += len(rows[-1][1] or b"")
                    if size > 16 << 20:
                        yield pd.DataFrame(rows, columns=["path", "content"])
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=["path", "content"])

    dealt = spark.createDataFrame(folders, "folder string, below boolean").repartition(min(parts, len(folders)))
    return dealt.mapInPandas(read, schema)


def decoded(found: DataFrame) -> DataFrame:
    """path, file_name, content, error of path and binary content: text, or null and an error if it can't be read or isn't UTF-8."""
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    error = F.when(F.col("content").isNull(), F.lit("can't be read")).when(~ok, F.lit("not valid UTF-8"))
    return found.select("path", file_name(F.col("path")).alias("file_name"), F.when(ok, F.col("content").cast("string")).alias("content"), error.alias("error"))
