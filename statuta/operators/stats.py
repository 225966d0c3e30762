"""Token statistics: moments, quantiles and equal-width bins, exact.

Quantiles come from the counts of the distinct values, which Spark merges before the last task; token
counts have few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def describe(rows: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample deviation, minimum, quartiles and maximum; nulls are left out."""
    q = lambda p: F.percentile(column, F.lit(p)).alias(f"p{int(p * 100)}")
    return rows.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), q(0.25), q(0.5), q(0.75), F.max(column).alias("max"))


def histogram(rows: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n): equal-width bins from the minimum to the maximum; empty bins are left out.

    The maximum is in the last bin; if all values are equal there is one bin.
    """
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    range_ = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    placed = values.crossJoin(F.broadcast(range_)).withColumn("bin", F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / F.nullif(width, F.lit(0.0))).cast("int"))).otherwise(0))
    return placed.groupBy("bin").agg(F.count("*").alias("n"), F.first(F.col("lo") + F.col("bin") * width).alias("low"), F.first(F.col("lo") + (F.col("bin") + 1) * width).alias("high"))
