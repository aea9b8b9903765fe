"""Running totals and neighbours over groups of any size.

A plain window sorts a whole group in one task, which a group holding a third of all rows
does not survive. Here the order column is cut into ranges: totals per range are summed
first (a few numbers per group), and each range is then ordered by itself. The result is
the same as that of the plain window, whatever the ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE, FINE = "_coarse", "_fine"


def score_ranges(score: Column, bits: int = 10) -> tuple[Column, Column]:
    """Two levels of ranges for scores in [0, 1]: 2**bits wide ones, each cut 2**bits times."""
    width = float(1 << bits)
    return (
        F.floor(score * width).cast("long"),
        F.floor(score * (width * width)).cast("long"),
    )


def hash_ranges(digest: Column) -> tuple[Column, Column]:
    """Two levels of ranges for a hexadecimal digest: 256 wide ones, each cut 256 times."""
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("long"), F.conv(F.substring(digest, 1, 4), 16, 10).cast("long")


def _ranges(df: DataFrame, ranges: tuple[Column, Column]) -> DataFrame:
    return df.withColumn(COARSE, ranges[0]).withColumn(FINE, ranges[1])


def _earlier(column: str, w) -> Column:
    return F.coalesce(F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    values: Sequence[str],
    ranges: tuple[Column, Column],
    descending: bool = False,
) -> DataFrame:
    """Add ``<value>_before``: the sum over the group's rows ordered before this one.

    ``df`` holds one row per group and order value; ``ranges`` must not decrease with ``order``.
    """
    up = (lambda c: F.col(c).desc()) if descending else F.col
    group = list(group)
    rows = _ranges(df, ranges)
    fine = rows.groupBy(*group, COARSE, FINE).agg(*[F.sum(v).alias(v) for v in values])
    coarse = fine.groupBy(*group, COARSE).agg(*[F.sum(v).alias(v) for v in values])
    w_coarse = Window.partitionBy(*group).orderBy(up(COARSE))
    base = coarse.select(*group, COARSE, *[_earlier(v, w_coarse).alias(f"{v}_base") for v in values])
    w_fine = Window.partitionBy(*group, COARSE).orderBy(up(FINE))
    offsets = (
        fine.select(*group, COARSE, FINE, *[_earlier(v, w_fine).alias(f"{v}_step") for v in values])
        .join(base, [*group, COARSE])
        .select(*group, COARSE, FINE, *[(F.col(f"{v}_base") + F.col(f"{v}_step")).alias(f"{v}_offset") for v in values])
    )
    w_row = Window.partitionBy(*group, COARSE, FINE).orderBy(up(order))
    local = rows.select("*", *[_earlier(v, w_row).alias(f"{v}_local") for v in values])
    joined = local.join(offsets, [*group, COARSE, FINE])
    return joined.select(
        *df.columns,
        *[(F.col(f"{v}_local") + F.col(f"{v}_offset")).alias(f"{v}_before") for v in values],
    )
