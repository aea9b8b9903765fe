"""Mixing sources to target weights: entropy balancing by Newton iterations, rounded into copies.

Targets: sources share all words by weight; a target stops at ``most`` times its source's words, and what is over is
shared again by weight until no target is above. Rates: of all rates that meet the token constraints and lie from 0 to
``most``, those nearest to one copy each in relative entropy are exp(lambda * size / scale) cut at ``most``, with one
dual variable a source. The dual is convex; every Newton step sums gradient and curvature over all sizes with one
grouped aggregate, kept inside a bracket that halves where a step leaves it. Documents of one source and size share a
rate, so the steps run over counts by source and size, not over documents.

Rounding: every document gets the whole part of its rate. In a class of one source and size the fractions add up to a
number of further copies; classes go from large to small sizes and hand on what rounding owes, so a source's words end
within about half of its smallest sizes of the target. Which documents of a class get the further copy is decided by a
hash of the id, through counts of hash ranges, so a class may be of any size, and reruns agree.

A NULL text has size 0. A NULL source is a source, last in order. Sources without words have target 0; documents of
size 0 are taken zero words; without any words all targets are 0. Repeated rows count each. No rows: no rows.
``mix`` returns its own columns, ``repeat`` all columns of its input as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktide.llm.common import ROW, boxed, checked, words
from ticktide.operators.ordered import hash_ranges, running_totals
from ticktide.session import written

MOST = 3.0
WEIGHTS = (1, 2, 3)
TOLERANCE = 1e-9
STEPS = 60


def sizes(docs: DataFrame) -> DataFrame:
    """Id, source, whether the source is missing, and number of words of every row."""
    return docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col("source").isNull().alias("unnamed"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
    )


KEY = ["unnamed", "source"]


def targets(per_source: DataFrame, weights: Sequence[int] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``per_source`` (KEY, source_size) with weight and target; narrow, one row per source."""
    order = Window.orderBy(*KEY)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = written(per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most), "sources")
    full = F.lit(False)
    level, n_full = 0.0, -1
    while True:  # each round finds further full sources or ends
        total, kept, open_, n = t.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(full, 1)),
        ).first()
        if n == n_full or not open_:
            break
        level, n_full = (total - kept) / open_, n
        full = F.col("weight") * level > F.col("cap")
    return t.select(*KEY, "source_size", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


def rates(classes: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """One dual variable per source: KEY, scale and lam. ``classes`` holds KEY, size, n; ``goals`` KEY, target, source_size."""
    classes = classes.filter("size > 0")  # a source without words has no rate
    scale = classes.groupBy(*KEY).agg((F.sum(F.col("size") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("scale"))
    state = written(
        goals.filter("source_size > 0").join(scale, KEY).select(
            *KEY, "scale", "target", F.col("source_size").cast("double").alias("source_size"),
            F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
            F.lit(False).alias("done"),
        ),
        "duals",
    )
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(math.log(most))))
    inside = F.col("lam") * F.col("size") / F.col("scale") < math.log(most)
    mass = F.col("size") * F.col("n") * tilt
    for _ in range(STEPS):
        sums = classes.join(checked(state), KEY).groupBy(*KEY).agg(
            F.sum(mass).alias("words"),
            F.sum(F.when(inside, mass * F.col("size") / F.col("scale")).otherwise(0.0)).alias("curvature"),
        )
        gap = F.col("words") - F.col("target")
        at_most = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        moved = state.join(sums, KEY).select(
            *KEY, "scale", "target", "source_size", "lam", low.alias("low"), high.alias("high"),
            (at_most | (F.abs(gap) <= F.col("target") * TOLERANCE)).alias("done"),
            F.when(F.col("curvature") > 0, F.col("lam") - gap / F.col("curvature")).alias("newton"),
        )
        outside = F.col("newton").isNull() | (F.col("newton") <= F.col("low")) | (F.col("newton") >= F.col("high"))
        halved = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        step = F.when(F.coalesce(outside, F.lit(False)), halved).otherwise(F.col("newton"))
        state = written(
            moved.select(*KEY, "scale", "target", "source_size", F.when(F.col("done"), F.col("lam")).otherwise(step).alias("lam"), "low", "high", "done"), "duals"
        )
        if not state.filter(~F.col("done")).limit(1).count():
            break
    return state.select(*KEY, "scale", "lam", "target", (F.col("target") >= F.col("source_size") * most * (1 - 1e-12)).alias("at_most"))


def _copies(classes: DataFrame, duals: DataFrame, most: float) -> DataFrame:
    """KEY, size, whole copies of each document and number of documents with one more."""

    def rounded(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("size", ascending=False, ignore_index=True)
        owed, more = 0.0, []
        for size, n, part in zip(own["size"], own["n"], own["rate"] - own["whole"]):
            owed += size * n * part
            k = min(n, max(0, round(owed / size)))
            owed -= k * size
            more.append(k)
        return own.assign(more=more)[[*KEY, "size", "n", "whole", "more"]]

    rate = F.when(F.col("at_most"), F.lit(most)).otherwise(F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(math.log(most)))))
    # rounded, so that the order in which sums were added up does not show
    rated = classes.filter("size > 0").join(checked(duals), KEY).withColumn("rate", F.least(F.round(rate, 9), F.lit(most)))
    rated = rated.select(*KEY, "size", "n", "rate", F.floor("rate").alias("whole"))
    # a group is one source's different sizes: no more rows than the longest text has words
    return rated.groupBy(*KEY).applyInPandas(rounded, "unnamed boolean, source string, size long, n long, whole long, more long")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every row of ``docs`` (doc_id, text, source)."""
    rows = written(sizes(docs), "sizes")
    classes = written(rows.groupBy(*KEY, "size").agg(F.count("*").alias("n")), "classes")
    goals = written(targets(classes.groupBy(*KEY).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most), "targets")
    plan = written(_copies(classes, written(rates(classes, goals, most), "rates"), most), "copies")
    key = [*KEY, "size"]
    by_class = rows.join(checked(plan), key, "left").select(
        *key, "doc_id", F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("n", F.lit(0)).alias("n")
    )
    # only classes of which a part gets one more need an order
    split = by_class.filter("more > 0 and more < n")
    even = by_class.filter("more <= 0 or more >= n").withColumn("copies", F.col("whole") + (F.col("more") > 0).cast("long"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    ordered = running_totals(split.withColumn("digest", digest).withColumn("one", F.lit(1)), key, "digest", ["one"], hash_ranges(F.col("digest")))
    chosen = ordered.withColumn("copies", F.col("whole") + (F.col("one_before") < F.col("more")).cast("long"))
    cols = [*key, "doc_id", "copies"]
    return even.select(*cols).unionByName(chosen.select(*cols)).join(checked(goals), KEY).select(
        "doc_id", F.when(~F.col("unnamed"), F.col("source")).alias("source"), "size", "source_size", "target", "copies"
    )


def repeat(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them."""
    key = ["id", "from_source", "of_size"]
    taken = mix(docs, weights, most).groupBy(F.col("doc_id").alias("id"), F.col("source").alias("from_source"), F.col("size").alias("of_size"))
    taken = written(taken.agg(F.sum("copies").alias("total"), F.count("*").alias("rows")), "taken")
    rows = boxed(docs, "doc_id", "text", "source").withColumn("words", F.size(words(F.col("text"))).cast("long"))
    same = (
        F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").cast("string").eqNullSafe(F.col("from_source"))
        & (F.col("words") == F.col("of_size"))
    )
    joined = rows.join(checked(taken), same)
    single = joined.filter("rows = 1").select(ROW, F.col("total").alias("copies"))
    if taken.filter("rows > 1").limit(1).count():  # rows alike share what they are taken together
        nth = F.row_number().over(Window.partitionBy(*key).orderBy("text"))
        share = F.floor(F.col("total") / F.col("rows")) + (nth <= F.col("total") % F.col("rows")).cast("long")
        single = single.unionByName(joined.filter("rows > 1").select(ROW, share.alias("copies")))
    return single.select(ROW, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(f"{ROW}.*")
