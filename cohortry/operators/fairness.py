"""Subgroup fairness: metrics by group, gaps between groups, and their change from one cohort to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import inference, metrics
from .ranks import numbered

MIN_GROUP = 10


def by_subgroup(predictions: DataFrame, group: str, k: int, min_group: int = MIN_GROUP) -> DataFrame:
    """Metrics of each non-null group with a low_n flag; a group of one true class has its size only."""
    known = predictions.where(F.col(group).isNotNull()).withColumn("group", F.col(group).cast("string"))
    out = metrics.summary(metrics.per_class(metrics.cells(known, ["group"]), ["group"]), ["group"])
    out = out.join(metrics.macro_auc(metrics.one_vs_rest(known, ["group"]), k, ["group"]), "group", "left")
    two = F.col("n_supported") >= 2
    return out.select("group", "n", (F.col("n") < min_group).alias("low_n"), *[F.when(two, F.col(c)).alias(c) for c in ("accuracy", "balanced_accuracy", "f1_macro", "auc", "tpr", "fpr")])


def report(predictions: DataFrame, dimensions: dict[str, str], k: int, min_group: int = MIN_GROUP) -> DataFrame:
    """``by_subgroup`` of several dimensions (name to column), stacked."""
    parts = [by_subgroup(predictions, column, k, min_group).select(F.lit(name).alias("dimension"), "*") for name, column in dimensions.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def max_gap(groups: DataFrame, measure: str, keys: list[str] = []) -> DataFrame:
    """Best minus worst group and their names, null below two groups; ties go to the first name."""
    valid = groups.where(F.col(measure).isNotNull())
    best = F.max(F.struct(F.col(measure).alias("v")))["v"]
    worst = F.min(measure)
    out = valid.groupBy(*keys).agg(best.alias("best"), worst.alias("worst"), F.count(F.lit(1)).alias("n_groups"), F.sort_array(F.collect_list(F.struct("group", F.col(measure).alias("v")))).alias("every"))
    first = lambda end: F.element_at(F.filter("every", lambda g: g["v"] == F.col(end)), 1)["group"]
    two = F.col("n_groups") >= 2
    return out.select(*keys, F.when(two, F.col("best") - F.col("worst")).alias("delta"), F.when(two, first("best")).alias("best_group"), F.when(two, first("worst")).alias("worst_group"))


def average_gap(groups: DataFrame, measure: str, overall: Column, keys: list[str] = []) -> DataFrame:
    return groups.groupBy(*keys).agg(F.avg(F.abs(F.col(measure) - overall)).alias("avg_gap"))


def odds_gaps(groups: DataFrame, keys: list[str] = []) -> DataFrame:
    """Largest difference of TPR and of FPR between groups, null below two."""
    gap = lambda c: F.when(F.count(c) >= 2, F.max(c) - F.min(c))
    return groups.groupBy(*keys).agg(gap("tpr").alias("tpr_gap"), gap("fpr").alias("fpr_gap"))


def equity_scaled(auc: Column, delta: Column, weight: float = 1.0) -> Column:
    return auc - weight * delta


def gap_summary(groups: DataFrame, overall_auc: Column, weight: float = 1.0, exclude_low_n: bool = False, keys: list[str] = []) -> DataFrame:
    """All gaps in one row per key. Groups of low n take part unless ``exclude_low_n``."""
    kept = groups.where(~F.col("low_n")) if exclude_low_n else groups
    gap = lambda c: F.when(F.count(c) >= 2, F.max(c) - F.min(c))
    out = kept.groupBy(*keys).agg(
        F.count("auc").alias("n_subgroups"), gap("auc").alias("delta_auc"), gap("balanced_accuracy").alias("delta_ba"), gap("f1_macro").alias("delta_f1"),
        F.avg(F.abs(F.col("auc") - overall_auc)).alias("avg_gap"), gap("tpr").alias("tpr_gap"), gap("fpr").alias("fpr_gap"),
    )
    return out.withColumn("auc_es", equity_scaled(overall_auc, F.col("delta_auc"), weight))


def gap_intervals(predictions: DataFrame, group: str, replicates: int) -> DataFrame:
    """Bootstrap intervals of the count-metric gaps between groups: all groups are resampled together.

    The group is part of the cell, so a resample is one draw over (group, true, predicted) cells.
    """
    known = predictions.where(F.col(group).isNotNull()).withColumn("group", F.col(group).cast("string"))
    cells = metrics.cells(known, ["group"])
    # One key for all rows: a cell's name carries the group along.
    named = cells.select(F.concat_ws("|", "group", "y_true").alias("y_true"), F.col("y_pred").cast("string").alias("y_pred"), "n")
    drawn = inference.resampled_cells(named, replicates)
    drawn = drawn.select("b", F.regexp_extract("y_true", r"^(.*)\|(-?\d+)$", 1).alias("group"), F.regexp_extract("y_true", r"^(.*)\|(-?\d+)$", 2).cast("int").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred"), "n")
    each = metrics.summary(metrics.per_class(drawn, ["b", "group"]), ["b", "group"]).where("n_supported >= 2")
    gap = lambda c: F.when(F.count(c) >= 2, F.max(c) - F.min(c))
    gaps = each.groupBy("b").agg(gap("balanced_accuracy").alias("delta_ba"), gap("f1_macro").alias("delta_f1"), gap("tpr").alias("tpr_gap"), gap("fpr").alias("fpr_gap"))
    return inference.interval(gaps, ["delta_ba", "delta_f1", "tpr_gap", "fpr_gap"])


def all_gap_intervals(predictions: DataFrame, group: str, k: int, replicates: int) -> DataFrame:
    """Bootstrap intervals of all seven gaps between groups, those of AUC included: whole rows are resampled together."""
    rows = predictions.withColumn("group", F.col(group).cast("string")).select("uid", "group", "y_true", "y_pred", "proba")
    n = rows.count()
    drawn = inference.vectors.resampled_groups if 0 < n <= inference.vectors.HELD else joined_groups
    cells, aucs = drawn(numbered(rows, ["uid"], name="i"), n, k, replicates)
    several = cells.groupBy("b").agg(F.count_distinct("y_true").alias("classes")).where("classes >= 2").select("b")
    overall = several.join(metrics.macro_auc(aucs.where("of < 0"), k, ["b"]), "b", "left").withColumnRenamed("auc", "overall")
    keys = ["b", "group"]
    out = metrics.summary(metrics.per_class(cells.where(F.col("group").isNotNull()), keys), keys).where("n_supported >= 2")
    out = out.join(metrics.macro_auc(aucs.where("of >= 0"), k, keys), keys, "left").join(overall, "b")
    gaps = gap_summary(out, F.col("overall"), keys=["b", "overall"])
    return inference.interval(gaps, ["delta_ba", "delta_f1", "delta_auc", "avg_gap", "tpr_gap", "fpr_gap", "auc_es"])


def joined_groups(placed: DataFrame, n: int, k: int, replicates: int) -> tuple[DataFrame, DataFrame]:
    """``replicates.resampled_groups`` of any number of rows: B x n draws meet the rows on the number."""
    rows = inference.joined_rows(placed, n, replicates)
    overall, each = metrics.one_vs_rest(rows, ["b"]), metrics.one_vs_rest(rows.where("group IS NOT NULL"), ["b", "group"])
    aucs = overall.select("b", F.lit(-1).alias("of"), F.lit(None).cast("string").alias("group"), "label", "auc")
    return metrics.cells(rows, ["b", "group"]), aucs.unionByName(each.select("b", F.lit(0).alias("of"), "group", "label", "auc"))


def error_analysis(predictions: DataFrame, group: str, k: int, min_group: int = MIN_GROUP) -> DataFrame:
    """Errors of each group of enough rows and at least two true classes."""
    known = predictions.where(F.col(group).isNotNull()).withColumn("group", F.col(group).cast("string"))
    large = known.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("y_true").alias("classes")).where((F.col("rows") >= min_group) & (F.col("classes") >= 2))
    return metrics.errors(metrics.cells(known, ["group"]), ["group"]).join(large.select("group"), "group", "left_semi")


def amplification(inside: DataFrame, outside: DataFrame, measure: str = "delta_ba") -> DataFrame:
    """(attribute, id, ood, change, amplified) of two gap tables; an attribute of one side only has no change."""
    a, b = inside.select("attribute", F.col(measure).alias("in_value")), outside.select("attribute", F.col(measure).alias("out_value"))
    change = F.col("out_value") - F.col("in_value")
    return a.join(b, "attribute", "full_outer").select("attribute", "in_value", "out_value", change.alias("change"), (change > 0).alias("amplified"))
