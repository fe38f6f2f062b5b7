"""Vector expressions: cosine similarity and normalisation as Catalyst expressions, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Float products, summed as doubles in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, v: s + v)


def length(v: Column) -> Column:
    """The norm that `cosine` divides by; worth computing once for a vector that is compared often."""
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, length_a: Column | None = None, length_b: Column | None = None) -> Column:
    """Cosine similarity; 0 if either vector is zero; an error if the lengths differ; null if either is null."""
    norms = (length(a) if length_a is None else length_a) * (length(b) if length_b is None else length_b)
    same = F.size(a) == F.size(b)
    wrong = F.raise_error(F.concat(F.lit("vectors of different lengths: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))).cast("double")
    value = F.when(~same, wrong).when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(value)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: (x * x).cast("float")), F.lit(0.0).cast("float"), lambda s, x: (s + x).cast("float")).cast("double"))


def normalized(v: Column) -> Column:
    """Unit vector of floats; a zero vector stays as it is."""
    n = norm(v).cast("float")
    return F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)
