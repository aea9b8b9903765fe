"""How well vectors separate two classes, per symbol and over all symbols.

Mean cosines come from sums of unit vectors, exactly and in one pass over all rows;
nothing forms pairs. Distances, which have no such form, are sampling operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.functions import vectors as V
from ticktide.functions.display import half_even
from ticktide.operators.neighbours import nearest
from ticktide.operators.ordered import hash_ranges, running_totals
from ticktide.operators.panel import join_spread
from ticktide.session import written

ALL = "ALL"
MIN_ROWS = 20
BROADCAST_GROUPS = 10_000  # one sum of vectors per class each


def with_all(df: DataFrame, stock: str = "Stock") -> DataFrame:
    """Every row under its symbol and once more under ALL."""
    return df.withColumn(stock, F.explode(F.array(F.col(stock), F.lit(ALL))))


def unit_sums(df: DataFrame, group: Sequence[str], vec: str = "vec") -> DataFrame:
    """Per group: the sum of unit vectors, the number of rows and of non-zero rows."""
    u = df.withColumn("_u", V.unit(F.col(vec)))
    return u.groupBy(*group).agg(
        V.sum_vector(F.col("_u")).alias("s"),
        F.count(F.lit(1)).alias("n"),
        F.sum(V.dot(F.col("_u"), F.col("_u"))).alias("sq"),
    )


def _class_sums(df: DataFrame, label: str, stock: str, vec: str) -> DataFrame:
    """Unit sums per symbol and class; ALL is added up from the per-symbol sums."""
    per_stock = unit_sums(df, [stock, label], vec)
    total = per_stock.groupBy(label).agg(
        V.sum_vector(F.col("s")).alias("s"), F.sum("n").alias("n"), F.sum("sq").alias("sq")
    )
    return per_stock.unionByName(total.withColumn(stock, F.lit(ALL)))


def cosine_quality(df: DataFrame, label: str = "Target_Label", stock: str = "Stock", vec: str = "vec") -> DataFrame:
    """Mean cosine within and between classes and over all distinct pairs (anisotropy).

    The mean over all pairs of two sets is the dot product of their mean unit vectors; over
    pairs i < j of one set it is (|sum|^2 - sum |u|^2) / (n (n - 1)).
    """
    sums = _class_sums(df, label, stock, vec)
    pick = lambda c, k: F.max(F.when(F.col(label) == k, F.col(c)))  # one row per class, so max picks it
    wide = sums.groupBy(stock).agg(
        *[pick(c, k).alias(f"{c}{k}") for k in (0, 1) for c in ("s", "n", "sq")]
    )

    def mean_cos(a: int, b: int) -> Column:
        n = F.col(f"n{a}") * F.col(f"n{b}")
        return V.dot(F.col(f"s{a}"), F.col(f"s{b}")) / n

    n0, n1 = F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0))
    s = F.when(F.col("s0").isNull(), F.col("s1")).when(F.col("s1").isNull(), F.col("s0")).otherwise(
        F.zip_with("s0", "s1", lambda x, y: x + y)
    )
    n = n0 + n1
    sq = F.coalesce("sq0", F.lit(0.0)) + F.coalesce("sq1", F.lit(0.0))
    anisotropy = F.when(n > 1, (V.dot(s, s) - sq) / (n * (n - 1)))
    return wide.select(
        stock,
        n0.alias("n_down"),
        n1.alias("n_up"),
        mean_cos(0, 0).alias("cosine_intra_down"),
        mean_cos(1, 1).alias("cosine_intra_up"),
        mean_cos(0, 1).alias("cosine_inter"),
        anisotropy.alias("anisotropy"),
    ).withColumn("spread_out", F.col("anisotropy") < 0.5)


# ---- symbols against each other -----------------------------------------------------

def centroids(df: DataFrame, stock: str = "Stock", vec: str = "vec") -> DataFrame:
    return df.groupBy(stock).agg(V.mean_vector(F.col(vec)).alias("centroid"))


def centroid_similarity(df: DataFrame, stock: str = "Stock", vec: str = "vec", limit: float = 0.97) -> DataFrame:
    """Per symbol the mean cosine of its centroid to all others; ``avg_off_diagonal`` over all.

    Linear in the number of symbols: the sum of all unit centroids is one vector.
    """
    units = centroids(df, stock, vec).withColumn("u", V.unit(F.col("centroid")))
    total = units.agg(V.sum_vector(F.col("u")).alias("s"), F.count(F.lit(1)).alias("n"), F.sum(V.dot(F.col("u"), F.col("u"))).alias("q"))
    rows = units.withColumn("_t", total.select(F.struct("s", "n", "q")).scalar()).select(
        stock, "u", F.col("_t.s").alias("_s"), F.col("_t.n").alias("_n"), F.col("_t.q").alias("_q")
    )
    others = V.dot(F.col("u"), F.col("_s")) - V.dot(F.col("u"), F.col("u"))
    several = lambda value: F.when(F.col("_n") > 1, value)  # noqa: E731  a lone symbol has no others: NULL
    average = several((V.dot(F.col("_s"), F.col("_s")) - F.col("_q")) / (F.col("_n") * (F.col("_n") - 1)))
    return rows.select(
        stock, several(others / (F.col("_n") - 1)).alias("mean_cosine_to_others"), average.alias("avg_off_diagonal")
    ).withColumn("too_similar", F.col("avg_off_diagonal") > limit)


def centroid_columns(df: DataFrame, anchors: Sequence[str], stock: str = "Stock", vec: str = "vec") -> DataFrame:
    """Heat-map rows: the cosine of every symbol's centroid to each of the named anchors."""
    c = written(centroids(df, stock, vec), "centroids")
    size = V.norm(F.col("centroid"))

    def to_anchor(given: Column) -> Column:
        return V.dot(F.col("centroid"), given) / (size * V.norm(given) + F.lit(1e-8))

    rows = c.withColumn("_a", _of_anchors(c, anchors, stock, F.col("centroid")))
    return rows.select(stock, *[to_anchor(F.col(f"_a._{i}")).alias(a) for i, a in enumerate(anchors)])


def _of_anchors(df: DataFrame, anchors: Sequence[str], stock: str, value: Column) -> Column:
    """One struct with the ``value`` of every anchor, which has one row; NULL if it has none."""
    given = [F.max(F.when(F.col(stock) == a, value)).alias(f"_{i}") for i, a in enumerate(anchors)]
    return df.agg(*given).select(F.struct(*[f"_{i}" for i in range(len(anchors))])).scalar()


def cosine_blocks(df: DataFrame, anchors: Sequence[str], stock: str = "Stock", vec: str = "vec") -> DataFrame:
    """Mean of the N x N cosine matrix over the block (symbol, anchor), without forming the matrix."""
    sums = written(unit_sums(df, [stock], vec), "unit_sums")

    def block(given: Column) -> Column:
        return V.dot(F.col("s"), given["s"]) / (F.col("n") * given["n"])

    rows = sums.withColumn("_a", _of_anchors(sums, anchors, stock, F.struct("s", "n")))
    return rows.select(stock, "n", *[block(F.col(f"_a._{i}")).alias(a) for i, a in enumerate(anchors)])


# ---- distances: sampling operators --------------------------------------------------

def shuffled(key: Column, seed: int) -> Column:
    """A reproducible random order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _places(df: DataFrame, group: Sequence[str], seed: int, vec: str) -> DataFrame:
    """Every row with its place in a random order of its group, which may be of any size."""
    rows = df.select(*group, F.col(vec).alias("v"), shuffled(F.col("_key"), seed).alias("_digest"), F.lit(1).alias("one"))
    return running_totals(rows, group, "_digest", ["one"], hash_ranges(F.col("_digest"))).select(*group, "v", (F.col("one_before") + 1).alias("place"))


def l2_quality(
    df: DataFrame, key: Column, label: str = "Target_Label", stock: str = "Stock", vec: str = "vec"
) -> DataFrame:
    """Mean L2 distance of random pairs within and between classes; every row is paired.

    Two independent random orders of a class are paired place by place, so a row may meet itself. Between the classes
    the order of the smaller one is run through again until every row of the larger one has a partner.
    """
    every = with_all(df.select(stock, label, F.col(vec), key.alias("_key")), stock)
    a, b = (written(_places(every, [stock, label], seed, vec), "places") for seed in (1, 2))
    alike = a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), [stock, label, "place"])
    sizes = written(a.groupBy(stock).agg(*[F.count(F.when(F.col(label) == y, 1)).alias(f"n{y}") for y in (0, 1)]), "sizes")

    def spread(rows: DataFrame, y: int, name: str) -> DataFrame:
        """Rows of class ``y`` at every place that they take; a row of the smaller class takes one in each run."""
        own = rows.filter(F.col(label) == y).drop(label)
        sized = own.join(F.broadcast(sizes), stock) if sizes.count() <= BROADCAST_GROUPS else join_spread(own, sizes, [stock], F.hash("v"))
        n, other = F.col(f"n{y}"), F.col(f"n{1 - y}")
        taken = F.sequence(F.col("place"), F.greatest(n, other), n)
        return sized.filter(other > 0).select(stock, F.col("v").alias(name), F.explode(taken).alias("place"))

    between = spread(a, 0, "va").join(spread(b, 1, "vb"), [stock, "place"])
    d = V.l2(F.col("va"), F.col("vb"))
    pairs = alike.select(stock, F.col(label).alias("pair"), d.alias("d")).unionByName(between.select(stock, F.lit(2).alias("pair"), d.alias("d")))
    mean = lambda k: F.avg(F.when(F.col("pair") == k, F.col("d")))
    return pairs.groupBy(stock).agg(mean(0).alias("intra_l2_down"), mean(1).alias("intra_l2_up"), mean(2).alias("inter_l2"))


def fisher_ratio(distances: DataFrame) -> DataFrame:
    intra = (F.col("intra_l2_down") + F.col("intra_l2_up")) / 2.0
    return distances.withColumn("fisher_ratio", F.when(intra > 0, half_even(F.col("inter_l2") / intra)).otherwise(F.lit(0.0)))


def silhouette(df: DataFrame, label: str = "Target_Label", stock: str = "Stock", vec: str = "vec") -> DataFrame:
    """Mean silhouette on squared Euclidean distances over all rows, per symbol and for ALL.

    The mean squared distance to a class follows from its sum of vectors, of squares and its
    number of rows, so no pairs are formed. Rows alone in their class, and groups of one class, count 0.
    """
    return silhouette_by_group(with_all(df, stock), label, stock, vec)


def silhouette_by_group(rows: DataFrame, label: str = "Target_Label", stock: str = "Stock", vec: str = "vec") -> DataFrame:
    """As :func:`silhouette` for rows that already stand under their groups, each on vectors of its own scale."""
    every = rows.select(stock, F.col(label).alias("y"), F.col(vec).alias("v"))
    sums = every.groupBy(stock, "y").agg(V.sum_vector(F.col("v")).alias("s"), F.count(F.lit(1)).alias("n"), F.sum(V.dot(F.col("v"), F.col("v"))).alias("q"))
    classes = sums.groupBy(stock).agg(F.collect_list(F.struct("y", "s", "n", "q")).alias("classes"))  # a few classes
    classes = written(classes, "classes")
    if classes.count() <= BROADCAST_GROUPS:
        joined = every.join(F.broadcast(classes), stock)
    else:
        joined = join_spread(every, classes, [stock], F.hash("v"))
    rows = joined.withColumn("x2", V.dot(F.col("v"), F.col("v")))
    away = F.transform("classes", lambda c: F.struct(
        (c["y"] == F.col("y")).alias("own"), c["n"].alias("n"),
        F.greatest(F.col("x2") + (c["q"] - V.dot(F.col("v"), c["s"]) * 2.0) / c["n"], F.lit(0.0)).alias("d"),
    ))
    own = F.filter(away, lambda c: c["own"])[0]
    rows = rows.select(stock, own.alias("own"), F.array_min(F.transform(F.filter(away, lambda c: ~c["own"]), lambda c: c["d"])).alias("b"))
    a = F.col("own.d") * F.col("own.n") / (F.col("own.n") - 1)
    larger = F.greatest(a, F.col("b"))
    score = F.when((F.col("own.n") > 1) & F.col("b").isNotNull() & (larger > 0), (F.col("b") - a) / larger).otherwise(0.0)
    return rows.groupBy(stock).agg(F.avg(score).alias("silhouette"))


# ---- nearest neighbours -------------------------------------------------------------

def knn_vote(
    folded: DataFrame, k: int = 5, key: str = "key", label: str = "y", group: str = "grp", fold: str = "fold", vec: str = "vec", **sizes: int
) -> DataFrame:
    """Majority vote of the ``k`` nearest rows (cosine) outside a row's own fold; exact, see :mod:`neighbours`."""
    rows = folded.select(
        F.col(group).alias("grp"), F.col(key).cast("string").alias("key"), F.col(label).cast("int").alias("y"),
        F.col(fold).cast("int").alias("fold"), V.unit(F.col(vec)).alias("u"),
    )
    votes = nearest(rows, k, **sizes).groupBy("grp", "key", "y", "fold").agg(F.avg(F.col("cand_y").cast("double")).alias("share_up"))
    return votes.withColumn("predicted", (F.col("share_up") > 0.5).cast("int"))


def knn_accuracy(votes: DataFrame, group: str = "grp") -> DataFrame:
    """Mean accuracy over folds."""
    per_fold = votes.groupBy(group, "fold").agg(F.avg((F.col("predicted") == F.col("y")).cast("double")).alias("acc"))
    return per_fold.groupBy(group).agg(F.avg("acc").alias("knn_acc"))


# ---- score card ---------------------------------------------------------------------

def score_card(quality: DataFrame) -> DataFrame:
    """0-100 points from fisher_ratio, logreg_auc, silhouette and anisotropy; grade A to D."""
    fisher = F.least(F.coalesce("fisher_ratio", F.lit(1.0)) / 2.0, F.lit(1.0)) * 25
    auc = F.greatest(F.coalesce("logreg_auc", F.lit(0.5)) - 0.5, F.lit(0.0)) * 2 * 35
    sil = (F.coalesce("silhouette", F.lit(0.0)) + 1.0) / 2.0 * 25
    ani = (F.lit(1.0) - F.coalesce("anisotropy", F.lit(0.5))) * 15
    score = fisher + auc + sil + ani
    grade = F.when(score >= 75, "A").when(score >= 60, "B").when(score >= 45, "C").otherwise("D")
    return quality.select(
        "*",
        half_even(fisher, 1).alias("separability_index"),
        half_even(auc, 1).alias("linear_probe_auc"),
        half_even(sil, 1).alias("silhouette_points"),
        half_even(ani, 1).alias("anisotropy_penalty"),
        half_even(score, 1).alias("overall_score"),
        grade.alias("grade"),
    )


def rows_enough(df: DataFrame, stock: str = "Stock", minimum: int = MIN_ROWS) -> DataFrame:
    """Drop the rows of symbols with fewer than ``minimum``."""
    kept = df.groupBy(stock).count().filter(F.col("count") >= minimum).select(stock)
    return df.join(kept, stock, "left_semi")


def per_stock_quality(df: DataFrame, key: Column, label: str = "Target_Label", stock: str = "Stock", vec: str = "vec") -> DataFrame:
    """Distances, Fisher's ratio and cosines per symbol and for ALL; short symbols count for ALL only."""
    cosines = cosine_quality(df, label, stock, vec)
    distances = fisher_ratio(l2_quality(df, key, label, stock, vec))
    both = cosines.join(distances, stock, "left")
    return both.filter((F.col(stock) == ALL) | (F.col("n_down") + F.col("n_up") >= MIN_ROWS))
