"""Queries: embedding quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.functions.display import half_even
from ticktide.operators import embedding_quality as E
from ticktide.operators import metrics as M
from ticktide.operators import models as L
from ticktide.operators import scaling as S
from ticktide.operators.ordered import hash_ranges
from ticktide.plans.oracle import with_views
from ticktide.plans.queries_metrics import sql_round
from ticktide.plans.queries_panel import FOLDS_SQL, panel, panel_once
from ticktide.plans.registry import query, r
from ticktide.session import written
from ticktide.sources.tables import SYMBOLS, Tables


def row_key() -> Column:
    return F.concat_ws("|", "Stock", F.col("Target_Date").cast("string"))


# brute force: all pairs of rows of a group
PAIRS = """SELECT a.grp, a.key AS ka, b.key AS kb, a.Target_Label AS ca, b.Target_Label AS cb, list_cosine_similarity(a.vec, b.vec) AS c, list_distance(a.vec, b.vec) AS d
  FROM both_groups a JOIN both_groups b ON a.grp = b.grp"""


@query("e1_cosine_intra_inter", with_views("both_groups", """SELECT grp AS Stock, round(avg(c) FILTER (ca = 0 AND cb = 0), 6) AS cosine_intra_down,
  round(avg(c) FILTER (ca = 1 AND cb = 1), 6) AS cosine_intra_up, round(avg(c) FILTER (ca = 0 AND cb = 1), 6) AS cosine_inter FROM pairs GROUP BY grp""", pairs=PAIRS))
def cosine_intra_inter(t: Tables) -> DataFrame:
    return E.cosine_quality(panel_once(t)).select("Stock", r("cosine_intra_down"), r("cosine_intra_up"), r("cosine_inter"))


@query("e2_anisotropy", with_views("both_groups", "SELECT grp AS Stock, round(avg(c), 6) AS anisotropy, CAST(avg(c) < 0.5 AS INTEGER) AS spread_out FROM pairs WHERE ka < kb GROUP BY grp", pairs=PAIRS))
def anisotropy(t: Tables) -> DataFrame:
    return E.cosine_quality(panel_once(t)).select("Stock", r("anisotropy"), "spread_out")


DRAWN = """SELECT *, row_number() OVER (PARTITION BY grp, Target_Label ORDER BY md5('1:' || key), key) AS p1,
  row_number() OVER (PARTITION BY grp, Target_Label ORDER BY md5('2:' || key), key) AS p2,
  count(*) FILTER (Target_Label = 0) OVER (PARTITION BY grp) AS n0, count(*) FILTER (Target_Label = 1) OVER (PARTITION BY grp) AS n1 FROM both_groups"""
L2 = """SELECT a.grp AS Stock, avg(list_distance(a.vec, b.vec)) FILTER (a.Target_Label = 0 AND b.Target_Label = 0) AS intra_l2_down,
  avg(list_distance(a.vec, b.vec)) FILTER (a.Target_Label = 1 AND b.Target_Label = 1) AS intra_l2_up,
  avg(list_distance(a.vec, b.vec)) FILTER (a.Target_Label <> b.Target_Label) AS inter_l2
  FROM drawn a JOIN drawn b ON a.grp = b.grp AND ((a.Target_Label = b.Target_Label AND a.p1 = b.p2)
    OR (a.Target_Label = 0 AND b.Target_Label = 1 AND CASE WHEN a.n0 >= a.n1 THEN b.p2 = (a.p1 - 1) % a.n1 + 1 ELSE a.p1 = (b.p2 - 1) % a.n0 + 1 END)) GROUP BY a.grp"""


@query("e3_l2_intra_inter", with_views("both_groups", "SELECT Stock, round(intra_l2_down, 6) AS intra_l2_down, round(intra_l2_up, 6) AS intra_l2_up, round(inter_l2, 6) AS inter_l2 FROM l2", drawn=DRAWN, l2=L2))
def l2_intra_inter(t: Tables) -> DataFrame:
    return E.l2_quality(panel_once(t), row_key()).select("Stock", r("intra_l2_down"), r("intra_l2_up"), r("inter_l2"))


@query("e4_fisher_ratio", with_views("both_groups", f"SELECT Stock, CASE WHEN intra_l2_down + intra_l2_up > 0 THEN {sql_round('inter_l2 / ((intra_l2_down + intra_l2_up) / 2)')} ELSE 0 END AS fisher_ratio FROM l2", drawn=DRAWN, l2=L2))
def fisher_ratio(t: Tables) -> DataFrame:
    return E.fisher_ratio(E.l2_quality(panel_once(t), row_key())).select("Stock", "fisher_ratio")


@query("e5_cosine_blocks", with_views("both_groups", "SELECT Stock, n, " + ", ".join(f"round(any_value(c) FILTER (s2 = '{s}'), 6) AS \"{s}\"" for s in SYMBOLS) + """ FROM (
  SELECT split_part(ka, '|', 1) AS Stock, split_part(kb, '|', 1) AS s2, avg(c) AS c, count(DISTINCT ka) AS n FROM pairs WHERE grp = 'ALL' GROUP BY ALL) GROUP BY Stock, n""", pairs=PAIRS))
def cosine_blocks(t: Tables) -> DataFrame:
    return E.cosine_blocks(panel(t), SYMBOLS).select("Stock", "n", *[r(s) for s in SYMBOLS])


SCALED = """SELECT grp, key, Target_Label, list(CASE WHEN d = 0 THEN x - m ELSE (x - m) / d END ORDER BY pos) AS vec FROM (
  SELECT grp, key, Target_Label, pos, x, avg(x) OVER (PARTITION BY grp, pos) AS m, stddev_pop(x) OVER (PARTITION BY grp, pos) AS d
  FROM (SELECT grp, key, Target_Label, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM both_groups)) GROUP BY grp, key, Target_Label"""


# brute force: all pairs of rows of a group
SHAPES = """SELECT grp, avg(CASE WHEN n_own = 1 OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (
  SELECT a.grp, a.key, sum(CASE WHEN a.Target_Label = b.Target_Label THEN list_distance(a.vec, b.vec) ** 2 ELSE 0 END) / nullif(count(*) FILTER (a.Target_Label = b.Target_Label) - 1, 0) AS a,
  avg(list_distance(a.vec, b.vec) ** 2) FILTER (a.Target_Label <> b.Target_Label) AS b, count(*) FILTER (a.Target_Label = b.Target_Label) AS n_own
  FROM scaled a JOIN scaled b ON a.grp = b.grp GROUP BY a.grp, a.key) GROUP BY grp"""


def scaled_groups(t: Tables) -> DataFrame:
    """Panel rows per symbol and for ALL, each group on its own scale."""
    rows = E.with_all(panel_once(t).select("Stock", L.LABEL, "vec", row_key().alias("key")))
    return S.standard_scale(rows, "vec", spread=F.col("key"))


@query("e6_silhouette", with_views("both_groups", "SELECT grp AS Stock, round(silhouette, 6) AS silhouette FROM shapes", scaled=SCALED, shapes=SHAPES))
def silhouette(t: Tables) -> DataFrame:
    return E.silhouette_by_group(written(scaled_groups(t), "scaled")).select("Stock", r("silhouette"))


def folded(t: Tables) -> DataFrame:
    """Panel rows per symbol and for ALL in five shuffled, class-balanced folds."""
    rows = E.with_all(panel_once(t).select("Stock", "Target_Date", "Target_Label", "vec", row_key().alias("key")))
    return M.stratified_folds(rows, E.shuffled(F.col("key"), 42), first="key", ranges=hash_ranges)


FOLDED_SQL = FOLDS_SQL.replace("arg_min(Target_Label, Target_Date)", "arg_min(Target_Label, key)").format(
    cols="grp, key, Target_Label, vec", grp="grp", order="md5('42:' || key)", src="both_groups"
)


@query("m7_shuffled_folds", with_views("both_groups", "SELECT grp AS Stock, key, Target_Label, fold FROM folded", folded=FOLDED_SQL))
def shuffled_folds(t: Tables) -> DataFrame:
    return folded(t).select("Stock", "key", "Target_Label", "fold")


@query("e8_knn_scaled", with_views("both_groups", """SELECT grp AS Stock, round(avg(acc), 6) AS knn_acc FROM (SELECT grp, fold, avg(CAST(CAST(share > 0.5 AS INTEGER) = y AS DOUBLE)) AS acc FROM (
  SELECT grp, key, any_value(y) AS y, any_value(fold) AS fold, avg(cy) AS share FROM (
  SELECT a.grp, a.key, a.fold, a.Target_Label AS y, b.Target_Label AS cy, row_number() OVER (PARTITION BY a.grp, a.key ORDER BY round(1 - list_cosine_similarity(a.vec, b.vec), 9), b.key) AS p
  FROM folded a JOIN folded b ON a.grp = b.grp AND a.fold <> b.fold) WHERE p <= 5 GROUP BY grp, key) GROUP BY grp, fold) GROUP BY grp""",
  scaled=SCALED, folded=FOLDED_SQL.replace("both_groups", "scaled")))
def knn_scaled(t: Tables) -> DataFrame:
    """Scaled but not reduced, so that SQL can check it."""
    rows = M.stratified_folds(written(scaled_groups(t), "scaled"), E.shuffled(F.col("key"), 42), first="key", ranges=hash_ranges)
    return E.knn_accuracy(E.knn_vote(rows, label="Target_Label", group="Stock")).select(F.col("grp").alias("Stock"), r("knn_acc"))


CENTROIDS = """SELECT Stock, list(m ORDER BY pos) AS c FROM (SELECT Stock, pos, avg(m) AS m FROM cells GROUP BY Stock, pos) GROUP BY Stock"""


@query("j8_centroid_similarity", with_views("cells", """SELECT a.Stock, round(avg(list_cosine_similarity(a.c, b.c)), 5) AS mean_cosine_to_others,
  round(avg(avg(list_cosine_similarity(a.c, b.c))) OVER (), 5) AS avg_off_diagonal, CAST(avg(avg(list_cosine_similarity(a.c, b.c))) OVER () > 0.97 AS INTEGER) AS too_similar
  FROM centroids a JOIN centroids b ON a.Stock <> b.Stock GROUP BY a.Stock""", centroids=CENTROIDS))
def centroid_similarity(t: Tables) -> DataFrame:
    return E.centroid_similarity(panel(t)).select("Stock", r("mean_cosine_to_others", 5), r("avg_off_diagonal", 5), "too_similar")


@query("j8_centroid_columns", with_views("cells", "SELECT Stock, " + ", ".join(f"round(any_value(sim) FILTER (b = '{s}'), 6) AS \"{s}\"" for s in SYMBOLS) + """ FROM (
  SELECT a.Stock, b.Stock AS b, list_inner_product(a.c, b.c) / (sqrt(list_inner_product(a.c, a.c)) * sqrt(list_inner_product(b.c, b.c)) + 1e-8) AS sim
  FROM centroids a CROSS JOIN centroids b) GROUP BY Stock""", centroids=CENTROIDS))
def centroid_columns(t: Tables) -> DataFrame:
    return E.centroid_columns(panel(t), SYMBOLS).select("Stock", *[r(s) for s in SYMBOLS])


POINTS = ("separability_index", "linear_probe_auc", "silhouette_points", "anisotropy_penalty", "overall_score", "grade")


def quality(t: Tables) -> DataFrame:
    """Fisher's ratio and anisotropy per symbol and for ALL, rounded as they are reported."""
    rows = panel_once(t)
    distances = E.fisher_ratio(E.l2_quality(rows, row_key()))
    return distances.select("Stock", "fisher_ratio").join(E.cosine_quality(rows).select("Stock", half_even(F.col("anisotropy")).alias("anisotropy")), "Stock")


@query("e9_score_card_unprobed", with_views("both_groups", f"""SELECT Stock, {sql_round('f', 1)} AS separability_index, CAST(0 AS DOUBLE) AS linear_probe_auc, {sql_round('s', 1)} AS silhouette_points,
  {sql_round('a', 1)} AS anisotropy_penalty, {sql_round('f + s + a', 1)} AS overall_score, CASE WHEN f + s + a >= 75 THEN 'A' WHEN f + s + a >= 60 THEN 'B' WHEN f + s + a >= 45 THEN 'C' ELSE 'D' END AS grade
  FROM (SELECT Stock, least(coalesce({sql_round('inter_l2 / ((intra_l2_down + intra_l2_up) / 2)')}, 1.0) / 2, 1) * 25 AS f, ({sql_round('silhouette')} + 1) / 2 * 25 AS s, (1 - {sql_round('ani')}) * 15 AS a
  FROM l2 JOIN shapes ON shapes.grp = l2.Stock JOIN (SELECT grp, avg(c) AS ani FROM pairs WHERE ka < kb GROUP BY grp) p ON p.grp = l2.Stock)""", pairs=PAIRS, drawn=DRAWN, l2=L2, scaled=SCALED, shapes=SHAPES))
def score_card_unprobed(t: Tables) -> DataFrame:
    """Without a probe its AUC counts as 0.5; e9_score_card has it."""
    shapes = E.silhouette_by_group(written(scaled_groups(t), "scaled")).select("Stock", half_even(F.col("silhouette")).alias("silhouette"))
    q = quality(t).join(shapes, "Stock").withColumn("logreg_auc", F.lit(None).cast("double"))
    return E.score_card(q).select("Stock", *POINTS)


@query("e10_per_stock_quality", with_views("both_groups", f"""SELECT l2.Stock, n_down, n_up, round(intra_l2_down, 6) AS intra_l2_down, round(intra_l2_up, 6) AS intra_l2_up, round(inter_l2, 6) AS inter_l2,
  {sql_round('inter_l2 / ((intra_l2_down + intra_l2_up) / 2)')} AS fisher_ratio, round(cos_down, 6) AS cosine_intra_down, round(ani, 6) AS anisotropy FROM l2
  JOIN (SELECT grp, avg(c) FILTER (ca = 0 AND cb = 0) AS cos_down, avg(c) FILTER (ka < kb) AS ani FROM pairs GROUP BY grp) p ON p.grp = l2.Stock
  JOIN (SELECT grp, count(*) FILTER (Target_Label = 0) AS n_down, count(*) FILTER (Target_Label = 1) AS n_up FROM both_groups GROUP BY grp) n ON n.grp = l2.Stock
  WHERE l2.Stock = 'ALL' OR n_down + n_up >= 20""", pairs=PAIRS, drawn=DRAWN, l2=L2))
def per_stock_quality(t: Tables) -> DataFrame:
    q = E.per_stock_quality(panel_once(t), row_key())
    return q.select("Stock", "n_down", "n_up", r("intra_l2_down"), r("intra_l2_up"), r("inter_l2"), "fisher_ratio", r("cosine_intra_down"), r("anisotropy"))
