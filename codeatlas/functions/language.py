"""Languages by file extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension and language (fixed values).
LANGUAGES = {
    "java": "JAVA", "py": "PYTHON", "js": "JAVASCRIPT", "jsx": "JAVASCRIPT", "ts": "TYPESCRIPT", "tsx": "TSX", "go": "GO", "rs": "RUST",
    "c": "C", "h": "C", "cpp": "CPP", "cc": "CPP", "cxx": "CPP", "hpp": "CPP", "cs": "C_SHARP", "rb": "RUBY", "php": "PHP", "swift": "SWIFT",
    "kt": "KOTLIN", "kts": "KOTLIN", "scala": "SCALA", "dart": "DART", "lua": "LUA", "r": "R", "bash": "BASH", "sh": "BASH",
}


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case text after the name's last dot; null if there is none, or only at either end of the name."""
    return F.lower(F.nullif(F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]+)$", 1), F.lit("")))


def language(path: Column) -> Column:
    """Language of a path, or null."""
    by_extension = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.element_at(by_extension, extension(path))


def is_supported(path: Column) -> Column:
    return language(path).isNotNull()


def supported_extensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(LANGUAGES.items()), "ext string, language string")
