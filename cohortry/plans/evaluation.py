"""Queries on predictions: metrics, inference, fairness, generalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.prng import draw_sql, lot_sql
from ..operators import cohorts, fairness, generalize, inference, metrics
from ..sources import work
from .base import P2, P3, auc_sql, class_sql, predictions2, predictions3, query, resample_sql, rounded, table

B = 100
#: Replicates of the reference. The queries of B replicates are the forms that SQL can check; those named _full do the whole job.
FULL_B = 1000
_DRAW = draw_sql("{b}", "{i}", "{n}")
_SCORED3 = "x AS (SELECT grp, label, y_true = label AS positive, proba[label + 1] AS score FROM p, range(3) t(label))"
_ONE = "x AS (SELECT 0 AS one, y_true = 1 AS positive, score FROM p)"


def _scored2(spark: SparkSession, sf: str) -> DataFrame:
    return predictions2(spark, sf).select("uid", (F.col("y_true") == 1).alias("positive"), F.element_at("proba", 2).alias("score"))


@query("q1_subgroup_fairness", f"WITH {P2}, g AS (SELECT grp, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL), {class_sql('g', 'grp')} SELECT grp AS \"group\", n, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(f1_macro, 6) AS f1_macro, round(max(balanced_accuracy) OVER () - min(balanced_accuracy) OVER (), 6) AS delta_ba FROM m")
def q1(spark: SparkSession, sf: str) -> DataFrame:
    groups = metrics.summary(metrics.per_class(metrics.cells(predictions2(spark, sf), ["grp"]), ["grp"]), ["grp"])
    gap = groups.agg((F.max("balanced_accuracy") - F.min("balanced_accuracy")).alias("delta_ba"))
    return rounded(groups.join(F.broadcast(gap)).select(F.col("grp").alias("group"), "n", "accuracy", "balanced_accuracy", "f1_macro", "delta_ba"))


@query("MET_01_confusion", f"WITH {P3} SELECT t.i AS y_true, q.j AS y_pred, coalesce(c.n, 0) AS n FROM range(3) t(i) CROSS JOIN range(3) q(j) LEFT JOIN cells c ON c.y_true = t.i AND c.y_pred = q.j")
def met01(spark, sf):
    return metrics.confusion(predictions3(spark, sf), 3).select(F.col("y_true").cast("long"), F.col("y_pred").cast("long"), "n")


@query("MET_02_per_class", f"WITH {P3}, {class_sql('cells')} SELECT label, tp, fp, fn, total - support - fp AS tn, support, round(tp / nullif(predicted, 0)::DOUBLE, 6) AS precision, round(tp / nullif(support, 0)::DOUBLE, 6) AS recall, round(2 * tp / (support + predicted)::DOUBLE, 6) AS f1 FROM c")
def met02(spark, sf):
    return rounded(metrics.per_class(metrics.cells(predictions3(spark, sf))).select("label", "tp", "fp", "fn", "tn", "support", "precision", "recall", "f1"))


def _measure(name: str, column: str) -> None:
    @query(name, f"WITH {P3}, {class_sql('cells')} SELECT round({column}, 6) AS {column} FROM m")
    def one(spark, sf):
        return rounded(metrics.summary(metrics.per_class(metrics.cells(predictions3(spark, sf)))).select(column))


for _name, _column in (("MET_03_accuracy", "accuracy"), ("MET_04_balanced_accuracy", "balanced_accuracy"), ("MET_05_macro_f1", "f1_macro")):
    _measure(_name, _column)


@query("MET_06_sensitivity", f"WITH {P3}, {class_sql('cells')} SELECT t.i AS label, round(coalesce(tp / nullif(support, 0)::DOUBLE, 0), 6) AS sensitivity FROM range(4) t(i) LEFT JOIN c ON c.label = t.i")
def met06(spark, sf):
    known = metrics.per_class(metrics.cells(predictions3(spark, sf))).select("label", "recall")
    labels = spark.range(4).withColumnRenamed("id", "label")
    return rounded(labels.join(known, "label", "left").select("label", F.coalesce("recall", F.lit(0.0)).alias("sensitivity")))


@query("MET_07_macro_auc", f"WITH {P3}, {_SCORED3}, {auc_sql('x', 'label')} SELECT round(avg(auc), 6) AS auc_ovr_macro FROM a")
def met07(spark, sf):
    return rounded(metrics.macro_auc(metrics.one_vs_rest(predictions3(spark, sf)), 3).select(F.col("auc").alias("auc_ovr_macro")))


@query("MET_07_binary_auc", f"WITH {P2}, {_ONE}, {auc_sql('x', 'one')} SELECT round(auc, 6) AS auc FROM a")
def met07b(spark, sf):
    return rounded(metrics.macro_auc(metrics.one_vs_rest(predictions2(spark, sf)), 2))


@query("MET_08_tpr_fpr", f"WITH {P3}, {class_sql('cells')} SELECT round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM m")
def met08(spark, sf):
    return rounded(metrics.summary(metrics.per_class(metrics.cells(predictions3(spark, sf)))).select("tpr", "fpr"))


@query("MET_09_errors", f"WITH {P3}, e AS (SELECT * FROM cells WHERE y_true <> y_pred ORDER BY n DESC, y_true, y_pred LIMIT 1) SELECT sum(CASE WHEN c.y_true <> c.y_pred THEN c.n ELSE 0 END)::BIGINT AS n_errors, sum(c.n)::BIGINT AS n, round(sum(CASE WHEN c.y_true <> c.y_pred THEN c.n ELSE 0 END) / sum(c.n)::DOUBLE, 6) AS error_rate, max(e.y_true) AS most_true, max(e.y_pred) AS most_pred, max(e.n) AS most_n FROM cells c, e")
def met09(spark, sf):
    return rounded(metrics.errors(metrics.cells(predictions3(spark, sf))))


@query("MET_10_ovr_auc", f"WITH {P3}, {_SCORED3}, {auc_sql('x', 'label')} SELECT label, n_pos, n_neg, round(auc, 6) AS auc FROM a")
def met10(spark, sf):
    return rounded(metrics.one_vs_rest(predictions3(spark, sf)).withColumn("label", F.col("label").cast("long")))


@query("MET_11_hand_till", f"WITH {P3}, x AS (SELECT i AS a_, j AS b_, y_true = j AS positive, proba[j + 1] / (proba[i + 1] + proba[j + 1]) AS score FROM p, range(3) t(i), range(3) q(j) WHERE i < j AND y_true IN (i, j)), {auc_sql('x', 'a_, b_')} SELECT a_ AS a, b_ AS b, n_neg AS n_a, n_pos AS n_b, round(auc, 6) AS auc FROM a")
def met11(spark, sf):
    return rounded(metrics.one_vs_one(predictions3(spark, sf), 3).select(F.col("a").cast("long"), F.col("b").cast("long"), "n_a", "n_b", "auc"))


@query("MET_12_label_check", f"WITH {P3} SELECT 4 AS k, count(DISTINCT y_true)::INT AS k_observed, (SELECT string_agg(i::VARCHAR, ',' ORDER BY i) FROM range(4) t(i) WHERE i NOT IN (SELECT y_true FROM p)) AS missing, count(DISTINCT y_true) = 4 AS matches FROM p")
def met12(spark, sf):
    return metrics.label_check(predictions3(spark, sf), 4)


_PERM = f"""l AS (SELECT y_true = 1 AS positive, row_number() OVER (ORDER BY uid) AS i FROM p),
o AS (SELECT b, score, row_number() OVER (PARTITION BY b ORDER BY {lot_sql('b', 'uid')}, uid) AS i FROM p, range({B}) t(b)),
x AS (SELECT b AS one, positive, score FROM o JOIN l USING (i) UNION ALL SELECT -1, y_true = 1, score FROM p)"""


@query("MET_13_permutation_test", f"WITH {P2}, {_PERM}, {auc_sql('x', 'one')}, obs AS (SELECT auc AS observed FROM a WHERE one = -1) SELECT round(max(observed), 6) AS observed, round(avg(auc), 6) AS null_mean, round(stddev_samp(auc), 6) AS null_sd, round(quantile_cont(auc, 0.95), 6) AS null_p95, round((count(*) FILTER (auc >= observed) + 1) / (count(auc) + 1)::DOUBLE, 6) AS p_value FROM a, obs WHERE one >= 0")
def met13(spark, sf):
    return rounded(inference.permutation_test(_scored2(spark, sf), B))


@query("MET_14_chance_adjusted", f"WITH {P3}, {class_sql('cells')}, {_SCORED3}, {auc_sql('x', 'label')}, u AS (SELECT avg(auc) AS auc FROM a) SELECT round((auc - .5) / .5, 6) AS auc_adjusted, round((balanced_accuracy - 1 / 3.0::DOUBLE) / (1 - 1 / 3.0::DOUBLE), 6) AS ba_adjusted, round((auc - .5) / .5 - (balanced_accuracy - 1 / 3.0::DOUBLE) / (1 - 1 / 3.0::DOUBLE), 6) AS adjusted_difference FROM m, u")
def met14(spark, sf):
    p = predictions3(spark, sf)
    both = metrics.macro_auc(metrics.one_vs_rest(p), 3).join(metrics.summary(metrics.per_class(metrics.cells(p))))
    return rounded(both.select(*metrics.chance_adjusted(F.col("auc"), F.col("balanced_accuracy"), 3)))


@query("MET_15_diagnostics", f"WITH {P2}, {class_sql('cells')}, {_PERM}, {auc_sql('x', 'one')} SELECT round((SELECT auc FROM a WHERE one = -1), 6) AS auc, round((SELECT avg(auc) FROM a WHERE one >= 0), 6) AS null_mean, round(balanced_accuracy, 6) AS balanced_accuracy, n_supported AS k_observed FROM m")
def met15(spark, sf):
    p = predictions2(spark, sf)
    test = inference.permutation_test(_scored2(spark, sf), B).select(F.col("observed").alias("auc"), "null_mean")
    m = metrics.summary(metrics.per_class(metrics.cells(p))).select("balanced_accuracy", F.col("n_supported").cast("int").alias("k_observed"))
    return rounded(test.join(m))


@query("MET_16_bundle", f"WITH {P3}, {class_sql('cells')}, {_SCORED3}, {auc_sql('x', 'label')} SELECT n, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(f1_macro, 6) AS f1_macro, round((SELECT avg(auc) FROM a), 6) AS auc FROM m")
def met16(spark, sf):
    p = predictions3(spark, sf)
    return rounded(metrics.summary(metrics.per_class(metrics.cells(p))).select("n", "accuracy", "balanced_accuracy", "f1_macro").join(metrics.macro_auc(metrics.one_vs_rest(p), 3)))


def _interval_sql(rows: str, measures: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, round(quantile_cont({m}, 0.025), 6) AS ci_low, round(quantile_cont({m}, 0.975), 6) AS ci_high, count({m}) AS n_valid FROM {rows}" for m in measures)


@query("BST_01_intervals", f"WITH {P3}, {resample_sql('cells', B, _DRAW)}, {class_sql('d', 'b')}, v AS (SELECT * FROM m WHERE n_supported >= 2) {_interval_sql('v', ['accuracy', 'balanced_accuracy', 'f1_macro'])}")
def bst01(spark, sf):
    return rounded(inference.bootstrap_summary(predictions3(spark, sf), B))


@query("BST_01_auc", f"WITH {P2}, i AS (SELECT y_true = 1 AS positive, score, row_number() OVER (ORDER BY uid) - 1 AS i FROM p), n AS (SELECT count(*) AS n FROM p), dr AS (SELECT b, {draw_sql('b', 'k', 'n')} AS i FROM range({B}) t(b), n, range((SELECT count(*) FROM p)) q(k)), x AS (SELECT b, positive, score FROM dr JOIN i USING (i)), {auc_sql('x', 'b')} SELECT round(quantile_cont(auc, 0.025), 6) AS ci_low, round(quantile_cont(auc, 0.975), 6) AS ci_high, count(auc) AS n_valid FROM a")
def bst01_auc(spark, sf):
    each = inference.resampled_auc(_scored2(spark, sf), B)
    return rounded(inference.interval(each, ["auc"]).drop("metric"))


_GAP_CELLS = "g AS (SELECT grp || '|' || y_true AS y_true, y_pred::VARCHAR AS y_pred, count(*) AS n FROM p GROUP BY ALL)"


@query("BST_02_gap_intervals", f"WITH {P2}, {_GAP_CELLS}, {resample_sql('g', B, _DRAW)}, e AS (SELECT b, split_part(y_true, '|', 1) AS grp, split_part(y_true, '|', 2)::INT AS y_true, y_pred::INT AS y_pred, n FROM d), {class_sql('e', 'b, grp')}, v AS (SELECT b, CASE WHEN count(balanced_accuracy) >= 2 THEN max(balanced_accuracy) - min(balanced_accuracy) END AS delta_ba, CASE WHEN count(f1_macro) >= 2 THEN max(f1_macro) - min(f1_macro) END AS delta_f1, CASE WHEN count(tpr) >= 2 THEN max(tpr) - min(tpr) END AS tpr_gap, CASE WHEN count(fpr) >= 2 THEN max(fpr) - min(fpr) END AS fpr_gap FROM m WHERE n_supported >= 2 GROUP BY b) {_interval_sql('v', ['delta_ba', 'delta_f1', 'tpr_gap', 'fpr_gap'])}")
def bst02(spark, sf):
    return rounded(fairness.gap_intervals(predictions2(spark, sf), "grp", B))


_SIDES = f"{P2}, ci AS (SELECT y_true, y_pred, count(*) AS n FROM p WHERE grp = 'en' GROUP BY ALL), co AS (SELECT y_true, y_pred, count(*) AS n FROM p WHERE grp <> 'en' GROUP BY ALL)"


def _side_sql(cells: str, tag: str, offset: int) -> str:
    names = ("s", "c0", "c", "m")
    out = class_sql("d" + tag, "b")
    for n in names:
        out = out.replace(f"\n{n} AS (", f"\n{n}{tag} AS (").replace(f"FROM {n} GROUP", f"FROM {n}{tag} GROUP")
    out = out.replace("FROM c0)", f"FROM c0{tag})")
    return resample_sql(cells, B, _DRAW, offset, "d" + tag, "t" + tag) + "," + out


@query("BST_03_difference_intervals", f"WITH {_SIDES}, {_side_sql('ci', '_in', 0)}, {_side_sql('co', '_out', B)}, v AS (SELECT m_in.balanced_accuracy - m_out.balanced_accuracy AS drop_ba, m_in.f1_macro - m_out.f1_macro AS drop_f1 FROM m_in JOIN m_out USING (b)) {_interval_sql('v', ['drop_ba', 'drop_f1'])}")
def bst03(spark, sf):
    p = predictions2(spark, sf)
    return rounded(generalize.difference_interval(p.where("grp = 'en'"), p.where("grp <> 'en'"), B))


@query("BST_04_nan_guard", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders")
def bst04(spark, sf):
    v = F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", F.nanvl(v, F.lit(None).cast("double")).alias("v"))


_GROUPS = f"{P3}, g AS (SELECT grp, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL), {class_sql('g', 'grp')}, {_SCORED3}, {auc_sql('x', 'grp, label')}, ga AS (SELECT grp, avg(auc) AS auc FROM a GROUP BY grp), f AS (SELECT m.grp AS \"group\", m.n, m.n < 10 AS low_n, m.accuracy, m.balanced_accuracy, m.f1_macro, ga.auc, m.tpr, m.fpr FROM m JOIN ga USING (grp))"


def _groups(spark, sf):
    return fairness.by_subgroup(predictions3(spark, sf), "grp", 3)


@query("FAIR_01_subgroups", f"WITH {_GROUPS} SELECT \"group\", n, low_n, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(f1_macro, 6) AS f1_macro, round(auc, 6) AS auc, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM f")
def fair01(spark, sf):
    return rounded(_groups(spark, sf))


@query("FAIR_02_report", f"WITH {P2}, b AS (SELECT 'lang' AS dimension, grp AS g, y_true, y_pred FROM p UNION ALL SELECT 'size', CASE WHEN n_chars % 120 > 0 AND n_chars % 120 <= 50 THEN '<50' WHEN n_chars % 120 > 50 AND n_chars % 120 <= 70 THEN '50-70' WHEN n_chars % 120 > 70 THEN '>=70' END, y_true, y_pred FROM p), g AS (SELECT dimension, g AS grp, y_true, y_pred, count(*) AS n FROM b WHERE g IS NOT NULL GROUP BY ALL), {class_sql('g', 'dimension, grp')} SELECT dimension, grp AS \"group\", n, round(balanced_accuracy, 6) AS balanced_accuracy FROM m WHERE n_supported >= 2 ")
def fair02(spark, sf):
    p = predictions2(spark, sf).withColumn("age", N.age_bin((F.col("n_chars") % 120).cast("double")))
    return rounded(fairness.report(p, {"lang": "grp", "size": "age"}, 2).where("balanced_accuracy IS NOT NULL").select("dimension", "group", "n", "balanced_accuracy"))


@query("FAIR_03_max_gap", f"WITH {_GROUPS} SELECT round(max(balanced_accuracy) - min(balanced_accuracy), 6) AS delta, first(\"group\" ORDER BY balanced_accuracy DESC, \"group\") AS best_group, first(\"group\" ORDER BY balanced_accuracy, \"group\") AS worst_group FROM f")
def fair03(spark, sf):
    return rounded(fairness.max_gap(_groups(spark, sf), "balanced_accuracy"))


@query("FAIR_04_average_gap", f"WITH {_GROUPS}, o AS (SELECT avg(accuracy) AS v FROM f) SELECT round(avg(abs(accuracy - v)), 6) AS avg_gap FROM f, o")
def fair04(spark, sf):
    g = _groups(spark, sf)
    joined = g.join(F.broadcast(g.agg(F.avg("accuracy").alias("v"))))
    return rounded(fairness.average_gap(joined, "accuracy", F.col("v")))


@query("FAIR_05_odds_gaps", f"WITH {_GROUPS} SELECT round(max(tpr) - min(tpr), 6) AS tpr_gap, round(max(fpr) - min(fpr), 6) AS fpr_gap FROM f")
def fair05(spark, sf):
    return rounded(fairness.odds_gaps(_groups(spark, sf)))


@query("FAIR_06_equity_scaled", f"WITH {_GROUPS} SELECT \"group\", round(auc - 0.5 * (SELECT max(auc) - min(auc) FROM f), 6) AS auc_es FROM f")
def fair06(spark, sf):
    g = _groups(spark, sf)
    delta = g.agg((F.max("auc") - F.min("auc")).alias("delta"))
    return rounded(g.join(F.broadcast(delta)).select("group", fairness.equity_scaled(F.col("auc"), F.col("delta"), 0.5).alias("auc_es")))


@query("FAIR_07_gap_summary", f"WITH {_GROUPS} SELECT count(auc) AS n_subgroups, round(max(auc) - min(auc), 6) AS delta_auc, round(max(balanced_accuracy) - min(balanced_accuracy), 6) AS delta_ba, round(max(f1_macro) - min(f1_macro), 6) AS delta_f1, round(avg(abs(auc - 0.6)), 6) AS avg_gap, round(max(tpr) - min(tpr), 6) AS tpr_gap, round(max(fpr) - min(fpr), 6) AS fpr_gap, round(0.6 - (max(auc) - min(auc)), 6) AS auc_es FROM f")
def fair07(spark, sf):
    return rounded(fairness.gap_summary(_groups(spark, sf), F.lit(0.6)))


@query("FAIR_08_error_analysis", f"WITH {P3}, g AS (SELECT grp, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL), e AS (SELECT grp, y_true, y_pred, n, row_number() OVER (PARTITION BY grp ORDER BY n DESC, y_true, y_pred) AS k FROM g WHERE y_true <> y_pred), t AS (SELECT grp, sum(CASE WHEN y_true <> y_pred THEN n ELSE 0 END)::BIGINT AS n_errors, sum(n)::BIGINT AS n, count(DISTINCT y_true) AS c FROM g GROUP BY grp) SELECT t.grp AS \"group\", n_errors, t.n, round(n_errors / t.n::DOUBLE, 6) AS error_rate, e.y_true AS most_true, e.y_pred AS most_pred, e.n AS most_n FROM t JOIN e ON e.grp = t.grp AND k = 1 WHERE t.n >= 10 AND c >= 2")
def fair08(spark, sf):
    return rounded(fairness.error_analysis(predictions3(spark, sf), "grp", 3))


_SPLIT_GROUPS = f"{P3}, g AS (SELECT cust % 2 AS half, grp, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL), {class_sql('g', 'half, grp')}, d2 AS (SELECT half, grp AS attribute, balanced_accuracy AS v FROM m)"


@query("FAIR_09_amplification", f"WITH {_SPLIT_GROUPS}, i AS (SELECT attribute, v FROM d2 WHERE half = 0 AND attribute <> '1-URGENT'), o AS (SELECT attribute, v FROM d2 WHERE half = 1) SELECT attribute, round(i.v, 6) AS in_value, round(o.v, 6) AS out_value, round(o.v - i.v, 6) AS change, o.v > i.v AS amplified FROM i FULL JOIN o USING (attribute)")
def fair09(spark, sf):
    p = predictions3(spark, sf).withColumn("half", F.col("cust") % 2)
    m = metrics.summary(metrics.per_class(metrics.cells(p, ["half", "grp"]), ["half", "grp"]), ["half", "grp"]).withColumnsRenamed({"grp": "attribute", "balanced_accuracy": "delta_ba"})
    return rounded(fairness.amplification(m.where("half = 0 AND attribute <> '1-URGENT'"), m.where("half = 1")))


@query("FAIR_10_group_case", "SELECT upper(g) AS grp, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS g FROM orders) GROUP BY 1")
def fair10(spark, sf):
    g = F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").groupBy(F.upper(g).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


_COHORT = "co AS (SELECT c_mktsegment AS cohort, c_nationkey % 3 AS label FROM customer)"


@query("OOD_02_pairs", f"WITH {_COHORT}, z AS (SELECT cohort, count(*) AS n, count(DISTINCT label) AS k FROM co GROUP BY 1) SELECT a.cohort AS train, b.cohort AS test, a.n AS n_train, b.n AS n_test FROM z a, z b WHERE a.cohort <> b.cohort AND a.n >= 30 AND b.n >= 10 AND a.k >= 2 AND b.k >= 2")
def ood02(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("cohort"), (F.col("c_nationkey") % 3).alias("label"))
    return generalize.viable_pairs(rows).select("train", "test", "n_train", "n_test")


_OOD = f"{P3}, g AS (SELECT grp, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL), {class_sql('g', 'grp')}"


def _ood(spark, sf):
    p = predictions3(spark, sf)
    inside = metrics.summary(metrics.per_class(metrics.cells(p, ["grp"]), ["grp"]), ["grp"]).select(F.col("grp").alias("cohort"), "balanced_accuracy", "f1_macro")
    pairs = generalize.ordered_pairs(inside.select("cohort"))
    outside = pairs.join(inside.withColumnRenamed("cohort", "test"), "test")
    return inside, outside


def _degradation_sql(side: str) -> str:
    return f"WITH {_OOD} SELECT a.grp AS train, b.grp AS test, round({side}.balanced_accuracy, 6) AS id_balanced_accuracy, round(b.balanced_accuracy, 6) AS ood_balanced_accuracy, round({side}.balanced_accuracy - b.balanced_accuracy, 6) AS drop_balanced_accuracy, round(CASE WHEN {side}.balanced_accuracy > 0 THEN ({side}.balanced_accuracy - b.balanced_accuracy) / {side}.balanced_accuracy END, 6) AS relative_balanced_accuracy FROM m a, m b WHERE a.grp <> b.grp"


@query("OOD_03_degradation", _degradation_sql("a"))
def ood03(spark, sf):
    return rounded(generalize.degradation(*_ood(spark, sf), ["balanced_accuracy"]))


@query("JOIN_06_id_lookup", _degradation_sql("b"))
def join06(spark, sf):
    return rounded(generalize.degradation(*_ood(spark, sf), ["balanced_accuracy"], id_side="test"))


@query("OOD_04_display", f"WITH {P3}, {resample_sql('cells', B, _DRAW)}, {class_sql('d', 'b')}, q AS (SELECT quantile_cont(balanced_accuracy, 0.025) AS lo, avg(balanced_accuracy) AS mid, quantile_cont(balanced_accuracy, 0.975) AS hi FROM m) SELECT printf('%.3f [%.3f, %.3f]', mid, lo, hi) AS shown FROM q")
def ood04(spark, sf):
    return _display(inference.resampled_cells(metrics.cells(predictions3(spark, sf)), B))


def _display(drawn: DataFrame) -> DataFrame:
    each = metrics.summary(metrics.per_class(drawn, ["b"]), ["b"])
    q = each.agg(F.avg("balanced_accuracy").alias("mid"), F.percentile("balanced_accuracy", [0.025, 0.975]).alias("q"))
    return q.select(N.interval_text(F.col("mid"), F.col("q")[0], F.col("q")[1]).alias("shown"))


@query("CTR_03_summary_row", f"WITH {P3}, {class_sql('cells')} SELECT 'A' AS experiment, '1 vs 2 vs 3' AS comparison, n, 3 AS n_classes, round(balanced_accuracy, 6) AS balanced_accuracy, printf('%.1f%%', 100 * accuracy) AS shown FROM m")
def ctr03(spark, sf):
    m = metrics.summary(metrics.per_class(metrics.cells(predictions3(spark, sf))))
    return rounded(m.select(F.lit("A").alias("experiment"), N.comparison_text(F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("comparison"), "n", F.lit(3).alias("n_classes"), "balanced_accuracy", F.format_string("%.1f%%", F.col("accuracy") * 100).alias("shown")))


@query("CTR_04_auc_key", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_custkey::DOUBLE END AS auc, CASE WHEN o_orderkey % 2 = 0 THEN 'auc' ELSE 'auc_ovr_macro' END AS key FROM orders")
def ctr04(spark, sf):
    auc, macro = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")), F.col("o_custkey").cast("double")
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(auc, macro).alias("auc"), F.when(auc.isNotNull(), "auc").otherwise("auc_ovr_macro").alias("key"))


# -- the reference's number of replicates and all its measures: checked by rows and by tests --
@query("MET_13_permutation_test_full")
def met13_full(spark, sf):
    return rounded(inference.permutation_test(_scored2(spark, sf), FULL_B))


@query("MET_15_diagnostics_full")
def met15_full(spark, sf):
    p = predictions2(spark, sf)
    test = inference.permutation_test(_scored2(spark, sf), FULL_B).select(F.col("observed").alias("auc"), "null_mean")
    m = metrics.summary(metrics.per_class(metrics.cells(p))).select("balanced_accuracy", F.col("n_supported").cast("int").alias("k_observed"))
    return rounded(test.join(m))


@query("BST_01_intervals_full")
def bst01_full(spark, sf):
    work.shared_folder(spark)
    drawn = inference.vectors.drawn_cells(metrics.cells(predictions3(spark, sf)), FULL_B).checkpoint()  # read twice, B x K x K rows
    classes = inference.sensitivity_intervals(drawn).select(F.concat(F.lit("sensitivity_"), "label").alias("metric"), "ci_low", "ci_high", "n_valid")
    return rounded(inference.summary_intervals(drawn).unionByName(classes))


@query("BST_01_auc_full")
def bst01_auc_full(spark, sf):
    return rounded(inference.interval(inference.resampled_auc(_scored2(spark, sf), FULL_B), ["auc"]).drop("metric"))


@query("BST_02_gap_intervals_full")
def bst02_full(spark, sf):
    return rounded(fairness.all_gap_intervals(predictions2(spark, sf), "grp", 2, FULL_B))


@query("BST_03_difference_intervals_full")
def bst03_full(spark, sf):
    p = predictions2(spark, sf)
    return rounded(generalize.difference_interval(p.where("grp = 'en'"), p.where("grp <> 'en'"), FULL_B))


@query("OOD_04_display_full")
def ood04_full(spark, sf):
    return _display(inference.vectors.drawn_cells(metrics.cells(predictions3(spark, sf)), FULL_B))
