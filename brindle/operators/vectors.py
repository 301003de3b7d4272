"""Brute-force vector search as array expressions: a scan, a distance and a top-k, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(df: DataFrame, ident: str, vector: str, query_id: int, k: int, measure: str) -> DataFrame:
    """The ``k`` rows nearest to the row ``query_id``; ties go to the smaller id."""
    one = df.where(F.col(ident) == query_id).select(F.col(vector).alias("__q")).limit(1)
    value = {"cosine": cosine, "dot": dot, "l2": l2}[measure](F.col(vector), F.col("__q"))
    order = F.asc("score") if measure == "l2" else F.desc("score")
    return df.join(F.broadcast(one)).withColumn("score", value).drop("__q").orderBy(order, ident).limit(k)  # one row is broadcast
