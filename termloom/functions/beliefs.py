"""Smoothed language-model beliefs, as columns and as SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def background(cf: Column, collection: Column) -> Column:
    """Collection probability; an expression that never occurs counts as half an occurrence. Null in an empty collection."""
    return F.try_divide(F.when(cf > 0, cf.cast("double")).otherwise(0.5), collection)


def dirichlet(tf: Column, length: Column, p: Column, mu: float) -> Column:
    return F.ln((tf + F.lit(float(mu)) * p) / (length + F.lit(float(mu))))


def two_stage(tf: Column, length: Column, p: Column, mu: float, lam: float) -> Column:
    return F.ln((1 - F.lit(float(lam))) * (tf + F.lit(float(mu)) * p) / (length + F.lit(float(mu))) + F.lit(float(lam)) * p)


def pmi(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Pointwise mutual information of two document sets, natural log; null where a count is 0."""
    return F.when((both > 0) & (a > 0) & (b > 0), F.ln(both.cast("double") * n / (a.cast("double") * b)))


def idf(n: Column, cf: Column) -> Column:
    """ln(documents / occurrences), occurrences at least one."""
    return F.ln(n / F.greatest(cf, F.lit(1)).cast("double"))


def register(spark: SparkSession) -> None:
    """dirichlet_belief and two_stage_belief as temporary SQL functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dirichlet_belief(tf DOUBLE, len DOUBLE, p DOUBLE, mu DOUBLE) RETURNS DOUBLE RETURN ln((tf + mu * p) / (len + mu))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION two_stage_belief(tf DOUBLE, len DOUBLE, p DOUBLE, mu DOUBLE, lam DOUBLE) RETURNS DOUBLE RETURN ln((1 - lam) * (tf + mu * p) / (len + mu) + lam * p)")
