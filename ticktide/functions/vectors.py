"""Vectors are ``array<double>`` columns; Spark ML vectors appear only at its borders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def number_or_zero(x: Column) -> Column:
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def nan_to_num(v: Column) -> Column:
    return F.transform(v, number_or_zero)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n))


def l2(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def mean_vector(v: Column) -> Column:
    """Element-wise mean as an aggregate: partial sums per task, one row per group shuffled."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))


def sum_vector(v: Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(v)))


def numbered(columns: Sequence[str], prefix: str) -> list[str]:
    """Columns ``prefix0, prefix1, ...`` in the order of their numbers, not of their text."""
    found = [c for c in columns if c.startswith(prefix) and c[len(prefix):].isdigit()]
    return sorted(found, key=lambda c: int(c[len(prefix):]))


def dimension(df: DataFrame, vec: str = "vec") -> int:
    """The length of all vectors; refuses vectors of different lengths."""
    low, high = df.agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} elements")
    return low or 0


def columns_to_vector(df: DataFrame, prefix: str = "vec_", out: str = "vec") -> DataFrame:
    names = numbered(df.columns, prefix)
    if not names:
        raise ValueError(f"no {prefix}* columns")
    rest = [c for c in df.columns if c not in set(names)]
    return df.select(*rest, F.array(*[F.col(c).cast("double") for c in names]).alias(out))


def vector_to_columns(df: DataFrame, dim: int, vec: str = "vec", prefix: str = "vec_") -> DataFrame:
    rest = [c for c in df.columns if c != vec]
    return df.select(*rest, *[F.col(vec)[i].alias(f"{prefix}{i}") for i in range(dim)])


def assemble_features(vec: str, numbers: Sequence[str]) -> Column:
    extra = F.array(*[F.col(c).cast("double") for c in numbers])
    return nan_to_num(F.concat(F.col(vec), extra)) if numbers else nan_to_num(F.col(vec))
