"""In-distribution against out-of-distribution: ordered cohort pairs, degradation, and intervals of differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import interval_text
from . import inference, metrics


def ordered_pairs(cohorts: DataFrame) -> DataFrame:
    """(train, test) of all cohorts that differ; cohorts are few by nature, and the count grows as their square."""
    a, b = cohorts.select(F.col("cohort").alias("train")).distinct(), cohorts.select(F.col("cohort").alias("test")).distinct()
    return a.join(b, F.col("train") != F.col("test"))


def viable_pairs(rows: DataFrame, min_train: int = 30, min_test: int = 10) -> DataFrame:
    """Ordered pairs of cohorts (rows: cohort, label) with enough rows and two classes on both sides."""
    sizes = rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("k"))
    pairs = ordered_pairs(sizes)
    left, right = sizes.select(F.col("cohort").alias("train"), F.col("n").alias("n_train"), F.col("k").alias("k_train")), sizes.select(F.col("cohort").alias("test"), F.col("n").alias("n_test"), F.col("k").alias("k_test"))
    joined = pairs.join(left, "train").join(right, "test")
    return joined.where((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test) & (F.col("k_train") >= 2) & (F.col("k_test") >= 2))


def degradation(inside: DataFrame, outside: DataFrame, measures: list[str], id_side: str = "train") -> DataFrame:
    """(train, test) rows with each measure inside and outside, their difference, and its share of the former.

    ``inside``: cohort and measures; ``outside``: train, test and measures. ``id_side`` says whose own figure counts.
    """
    own = inside.select(F.col("cohort").alias(id_side), *[F.col(m).alias(f"id_{m}") for m in measures])
    joined = outside.join(own, id_side)
    columns = []
    for m in measures:
        drop = F.col(f"id_{m}") - F.col(m)
        columns += [F.col(f"id_{m}"), F.col(m).alias(f"ood_{m}"), drop.alias(f"drop_{m}"), F.when(F.col(f"id_{m}") > 0, drop / F.col(f"id_{m}")).alias(f"relative_{m}")]
    return joined.select("train", "test", *columns)


def difference_interval(inside: DataFrame, outside: DataFrame, replicates: int) -> DataFrame:
    """Intervals of the drop in balanced accuracy and macro F1; both sides are resampled independently."""
    def each(rows: DataFrame, offset: int, side: str) -> DataFrame:
        drawn = inference.resampled_cells(metrics.cells(rows), replicates, offset=offset)
        out = metrics.summary(metrics.per_class(drawn, ["b"]), ["b"])
        return out.select("b", F.col("balanced_accuracy").alias(f"ba_{side}"), F.col("f1_macro").alias(f"f1_{side}"))

    joined = each(inside, 0, "in").join(each(outside, replicates, "out"), "b")
    return inference.interval(joined.select("b", (F.col("ba_in") - F.col("ba_out")).alias("drop_ba"), (F.col("f1_in") - F.col("f1_out")).alias("drop_f1")), ["drop_ba", "drop_f1"])


def display_rows(intervals: DataFrame) -> DataFrame:
    """metric and "point [low, high]" of (metric, point, ci_low, ci_high)."""
    return intervals.select("metric", interval_text(F.col("point"), F.col("ci_low"), F.col("ci_high")).alias("shown"))
