"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a vector is null or zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def mean_vectors(df: DataFrame, by: str, column: str) -> DataFrame:
    """Element-wise mean of the vectors of each group; each component is a partial aggregate."""
    each = df.select(by, F.posexplode(column).alias("at", "x")).groupBy(by, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))
