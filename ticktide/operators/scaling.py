"""Scaling fitted on train rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.operators.panel import join_spread

EPS = 2.220446049250313e-16


def vector_stats(df: DataFrame, group: Sequence[str], vec: str) -> DataFrame:
    """Mean, population deviation and row count per group; constant columns divide by 1."""
    s = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vec)))
    flat = df.groupBy(*group).agg(s.alias("_s")).select(
        *group,
        vector_to_array("_s.mean").alias("mean"),
        vector_to_array("_s.variance").alias("_var"),
        F.col("_s.count").cast("double").alias("n"),
    )

    def deviation(sample_var: Column, mean: Column) -> Column:
        var = sample_var * (F.col("n") - 1.0) / F.col("n")
        noise = F.col("n") * EPS * var + F.pow(F.col("n") * mean * EPS, F.lit(2.0))
        return F.when((F.col("n") <= 1) | (var <= noise), F.lit(1.0)).otherwise(F.sqrt(var))

    return flat.select(*group, "n", "mean", F.zip_with("_var", "mean", deviation).alias("std"))


def apply_scale(vec: Column, mean: Column, std: Column) -> Column:
    centred = F.zip_with(vec, mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: x / s)


def standard_scale(
    df: DataFrame, vec: str, group: Sequence[str] = ("Stock",), train: Column | None = None, out: str | None = None, spread: Column | None = None
) -> DataFrame:
    """Scale ``vec`` per group with the statistics of the group's train rows.

    ``spread`` tells rows of a group apart; give it where a group may hold a large share of all rows.
    """
    fitted = vector_stats(df if train is None else df.filter(train), group, vec).drop("n")
    if not group:
        joined = df.withColumns(_single(fitted))
    elif spread is None:
        joined = df.join(fitted, list(group))
    else:
        joined = join_spread(df, fitted, list(group), spread)
    scaled = joined.withColumn(out or vec, apply_scale(F.col(vec), F.col("mean"), F.col("std")))
    return scaled.drop("mean", "std")


def _single(fitted: DataFrame) -> dict[str, Column]:
    both = fitted.select(F.struct("mean", "std")).scalar()
    return {"mean": both["mean"], "std": both["std"]}
