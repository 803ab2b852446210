"""Classifier metrics over prediction tables.

All figures derive from the long confusion form (keys, y_true, y_pred, n), so a global, subgroup, fold or replicate
metric is the same operator with other keys: one grouped count, then steps over K x K rows. Ranking metrics group
equal scores first and take their prefix sums in score buckets, so no task sorts all rows of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def cells(predictions: DataFrame, keys: list[str] = []) -> DataFrame:
    return predictions.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion(predictions: DataFrame, k: int, keys: list[str] = []) -> DataFrame:
    """Cells of all k x k label pairs, empty ones as 0."""
    found = cells(predictions, keys)
    spark = predictions.sparkSession
    grid = spark.range(k * k).select((F.col("id") / k).cast("int").alias("y_true"), (F.col("id") % k).cast("int").alias("y_pred"))
    groups = found.select(*keys).distinct() if keys else None
    grid = groups.join(F.broadcast(grid)) if keys else grid  # k x k rows for each key
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys] + [F.col(f"g.{c}") == F.col(f"f.{c}") for c in ("y_true", "y_pred")]
    joined = grid.alias("g").join(found.alias("f"), same, "left")
    return joined.select(*[f"g.{c}" for c in keys], "g.y_true", "g.y_pred", F.coalesce("f.n", F.lit(0)).alias("n"))


def per_class(cm: DataFrame, keys: list[str] = []) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, fpr and support of each label; a figure without a base is 0."""
    both = cm.select(*keys, F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))).alias("s"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit"))
    sums = both.groupBy(*keys, "s.label").agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum(F.when(F.col("s.support") > 0, F.col("hit")).otherwise(0)).alias("tp"))
    total = F.sum("support").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    out = sums.withColumn("total", total).withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp"))
    out = out.withColumn("tn", F.col("total") - F.col("support") - F.col("fp"))
    return out.select(
        *keys, "label", "tp", "fp", "fn", "tn", "support", "predicted",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(F.col("tp") * 2, F.col("support") + F.col("predicted")).alias("f1"), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
    )


def summary(classes: DataFrame, keys: list[str] = []) -> DataFrame:
    """n, accuracy, balanced accuracy (labels with support), macro F1 and mean TPR and FPR (labels true or predicted)."""
    used = (F.col("support") + F.col("predicted")) > 0
    out = classes.groupBy(*keys).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg(F.when(used, F.col("f1"))).alias("f1_macro"),
        F.avg(F.when(used, F.col("recall"))).alias("tpr"),
        F.avg(F.when(used, F.col("fpr"))).alias("fpr"),
        F.sum(used.cast("int")).alias("n_labels"),
        F.sum((F.col("support") > 0).cast("int")).alias("n_supported"),
    )
    return out.withColumn("tpr", F.when(F.col("n_labels") >= 2, F.col("tpr"))).withColumn("fpr", F.when(F.col("n_labels") >= 2, F.col("fpr")))


def errors(cm: DataFrame, keys: list[str] = []) -> DataFrame:
    """n_errors, n, error_rate and the most confused pair (by count, then row-major)."""
    wrong = F.col("y_true") != F.col("y_pred")
    order = F.struct("n", -F.col("y_true"), -F.col("y_pred"))
    return cm.groupBy(*keys).agg(
        F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("n_errors"), F.sum("n").alias("n"), (F.sum(F.when(wrong, F.col("n")).otherwise(0)) / F.sum("n")).alias("error_rate"),
        F.max_by(F.struct("y_true", "y_pred", "n"), F.when(wrong & (F.col("n") > 0), order)).alias("most"),
    ).select(*keys, "n_errors", "n", "error_rate", F.col("most.y_true").alias("most_true"), F.col("most.y_pred").alias("most_pred"), F.col("most.n").alias("most_n"))


def auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_pos, n_neg, auc) of rows (keys, positive boolean, score in [0, 1]): the Mann-Whitney statistic.

    Null unless both classes are there. Equal scores count half.
    """
    by_score = scored.groupBy(*keys, "score").agg(F.sum(F.col("positive").cast("long")).alias("pos"), F.sum((~F.col("positive")).cast("long")).alias("neg"))
    by_score = by_score.withColumn("bucket", F.least(F.floor(F.col("score") * BUCKETS), F.lit(BUCKETS)).cast("int"))
    buckets = by_score.groupBy(*keys, "bucket").agg(F.sum("neg").alias("bucket_neg"))
    ahead = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("neg_ahead", F.coalesce(F.sum("bucket_neg").over(ahead), F.lit(0))).drop("bucket_neg")
    inside = Window.partitionBy(*keys, "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_score.withColumn("neg_before", F.coalesce(F.sum("neg").over(inside), F.lit(0))).alias("s")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys] + [F.col("s.bucket") == F.col("b.bucket")]
    joined = ranked.join(buckets.alias("b"), same).select(*[f"s.{c}" for c in keys], "s.pos", "s.neg", "s.neg_before", "b.neg_ahead")
    wins = F.sum(F.col("pos") * (2 * (F.col("neg_ahead") + F.col("neg_before")) + F.col("neg")))
    return joined.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("w")).select(*keys, "n_pos", "n_neg", F.try_divide(F.col("w").cast("double"), 2 * F.col("n_pos") * F.col("n_neg")).alias("auc"))


def one_vs_rest(predictions: DataFrame, keys: list[str] = []) -> DataFrame:
    """AUC of each class against the rest; ``proba`` is exploded once."""
    rows = predictions.select(*keys, "y_true", F.posexplode("proba").alias("label", "score"))
    return auc(rows.select(*keys, "label", (F.col("y_true") == F.col("label")).alias("positive"), "score"), [*keys, "label"])


def macro_auc(classes: DataFrame, k: int, keys: list[str] = []) -> DataFrame:
    """Mean of the classes' AUC, null if any class lacks support; of two classes, the second's."""
    value = F.when(F.count("auc") == k, F.avg("auc")) if k > 2 else F.max(F.when(F.col("label") == 1, F.col("auc")))
    return classes.groupBy(*keys).agg(value.alias("auc"))


def one_vs_one(predictions: DataFrame, k: int) -> DataFrame:
    """AUC of each pair of classes a < b on the rows of either, by p_b / (p_a + p_b); sizes count all rows."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(k) for b in range(a + 1, k)])
    rows = predictions.select("y_true", "proba", F.explode(pairs).alias("p")).where((F.col("y_true") == F.col("p.a")) | (F.col("y_true") == F.col("p.b")))
    rows = rows.select(F.col("p.a").alias("a"), F.col("p.b").alias("b"), (F.col("y_true") == F.col("p.b")).alias("positive"), F.element_at("proba", F.col("p.a") + 1).alias("pa"), F.element_at("proba", F.col("p.b") + 1).alias("pb"))
    sizes = rows.groupBy("a", "b").agg(F.sum((~F.col("positive")).cast("long")).alias("n_a"), F.sum(F.col("positive").cast("long")).alias("n_b"))
    scored = rows.where(F.col("pa") + F.col("pb") > 0).select("a", "b", "positive", (F.col("pb") / (F.col("pa") + F.col("pb"))).alias("score"))
    return sizes.join(auc(scored, ["a", "b"]).select("a", "b", "auc"), ["a", "b"], "left")


def label_check(predictions: DataFrame, k: int) -> DataFrame:
    """Canonical and observed number of labels, and which of the former are missing."""
    seen = F.array_sort(F.collect_set("y_true"))
    return predictions.agg(seen.alias("seen")).select(F.lit(k).alias("k"), F.size("seen").alias("k_observed"), F.array_join(F.array_except(F.sequence(F.lit(0), F.lit(k - 1)), "seen"), ",").alias("missing"), (F.size("seen") == k).alias("matches"))


def chance_adjusted(auc_value: F.Column, balanced: F.Column, k: int) -> list[F.Column]:
    a, b = (auc_value - 0.5) / 0.5, (balanced - 1.0 / k) / (1 - 1.0 / k)
    return [a.alias("auc_adjusted"), b.alias("ba_adjusted"), (a - b).alias("adjusted_difference")]
