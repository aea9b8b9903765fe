"""Signals and the strings shown for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """``digits`` decimals, ties to even on the exact value, no thousands separator."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def percent(x: Column, digits: int) -> Column:
    return F.concat(fixed(x * 100, digits), F.lit("%"))


def half_even(x: Column, digits: int = 4) -> Column:
    """Rounded like :func:`fixed`; plain ``round`` and ``bround`` look at the shortest decimal instead."""
    return fixed(x.cast("double"), digits).cast("double")


def threshold_signal(prob: Column, threshold: float = 0.5) -> dict[str, Column]:
    up = prob >= F.lit(threshold)
    return {
        "probability_up": half_even(prob),
        "confidence": half_even(F.when(up, prob).otherwise(F.lit(1.0) - prob)),
        "signal": F.when(up, 1).otherwise(0),
        "label": F.when(up, "Up").otherwise("Down"),
    }


def shown_label(label: Column) -> Column:
    return F.coalesce(label, F.lit("-"))


def shown_percent(x: Column, digits: int = 1) -> Column:
    return percent(F.coalesce(x, F.lit(0.0)), digits)
