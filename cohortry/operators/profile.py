"""Dataset profiles: types, missing values, numeric, categorical and datetime summaries, crosstabs with margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import age_group
from .ranks import quantiles

NUMERIC_RATIO, DATETIME_RATIO, MAX_CATEGORIES = 0.8, 0.8, 30


def _stacked(df: DataFrame, per_column: dict[str, dict[str, Column]]) -> DataFrame:
    """One row per column of aggregates taken in a single pass."""
    flat = [v.alias(f"{i}_{k}") for i, values in enumerate(per_column.values()) for k, v in values.items()]
    one = df.agg(*flat)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{k}").alias(k) for k in values]) for i, (c, values) in enumerate(per_column.items())])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values, missing values and their share, of each column; most missing first, then fewest values."""
    n = F.count(F.lit(1))
    out = _stacked(df, {c: {"n_unique": F.count_distinct(c), "n_missing": F.count_if(F.col(c).isNull()), "pct_missing": F.try_divide(F.count_if(F.col(c).isNull()) * 100.0, n)} for c in columns})
    return out.orderBy(F.desc("pct_missing"), "n_unique", "column")


def dataset_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    cells = F.count(F.lit(1)) * len(columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(columns)).alias("n_columns"), missing.alias("n_missing_cells"), F.try_divide(missing * 100.0, cells).alias("pct_missing"))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, min, quartiles (linear), max and interquartile range of each column."""
    def stats(c: str) -> dict[str, Column]:
        return {"n": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c).cast("double"), "max": F.max(c).cast("double")}

    out = _stacked(df, {c: stats(c) for c in columns}).join(F.broadcast(quantiles(df, columns, [0.25, 0.5, 0.75])), "column")
    return out.select("column", "n", "mean", "std", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max", (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def datetime_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    return _stacked(df, {c: {"n_missing": F.count_if(F.col(c).isNull()), "min": F.min(c).cast("string"), "max": F.max(c).cast("string"), "n_unique": F.count_distinct(c)} for c in columns})


def detected_types(df: DataFrame, columns: list[str], forced: dict[str, str] = {}) -> DataFrame:
    """Type of each text column: forced, else numeric or datetime if 80 % of all rows can be cast, else by distinct values."""
    n = F.count(F.lit(1))
    text = lambda c: F.col(c).cast("string")
    facts = {c: {"numeric": F.try_divide(F.count(text(c).try_cast("double")), n), "datetime": F.try_divide(F.count(F.try_to_timestamp(text(c))), n), "n_unique": F.count_distinct(c)} for c in columns}
    kind = F.when(F.col("numeric") >= NUMERIC_RATIO, "numeric").when(F.col("datetime") >= DATETIME_RATIO, "datetime").when(F.col("n_unique") > MAX_CATEGORIES, "string").otherwise("categorical")
    for column, forced_kind in forced.items():
        kind = F.when(F.col("column") == column, forced_kind).otherwise(kind)
    return _stacked(df, facts).select("column", kind.alias("type"))


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """(value, n, pct) most frequent first, ties by value; the first ``k`` of them if given."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0)))).orderBy(F.desc("n"), "value")
    return out.limit(k) if k else out


def merged_rare(df: DataFrame, column: str, least_percent: float, other: str = "OTHER") -> DataFrame:
    """Values of less than ``least_percent`` of all rows become ``other``; nulls count as rows and stay."""
    shares = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    shares = shares.withColumn("_share", F.col("_n") * 100.0 / F.sum("_n").over(Window.partitionBy(F.lit(0)))).where(F.col(column).isNotNull()).select(column, "_share")
    return df.join(shares, column, "left").withColumn(column, F.when(F.col("_share") < least_percent, other).otherwise(F.col(column))).drop("_share")


def filled_for_display(df: DataFrame, column: str, label: str = "MISSING", include: bool = True) -> DataFrame:
    return df.withColumn(column, F.coalesce(column, F.lit(label))) if include else df.where(F.col(column).isNotNull())


def categorical_summary(df: DataFrame, column: str, label: str = "MISSING", rare_percent: float = 0.0, k: int = 20, least: int = 0) -> DataFrame:
    """Fill, merge rare values, count, take the first ``k``, drop those below ``least``, in this order."""
    return value_counts(merged_rare(filled_for_display(df, column, label), column, rare_percent), column, k).where(F.col("n") >= least)


def crosstab(df: DataFrame, target: str, group: str, total: str = "Total") -> DataFrame:
    """(target, group, n, pct) with margins: one cube; pct is of the group's column."""
    cube = df.select(F.coalesce(target, F.lit("MISSING")).alias("target"), F.coalesce(group, F.lit("MISSING")).alias("group")).cube("target", "group")
    counts = cube.agg(F.count(F.lit(1)).alias("n"), F.grouping("target").alias("gt"), F.grouping("group").alias("gg"))
    named = counts.select(F.when(F.col("gt") == 1, total).otherwise(F.col("target")).alias("target"), F.when(F.col("gg") == 1, total).otherwise(F.col("group")).alias("group"), "n", "gt")
    column_total = F.max(F.when(F.col("gt") == 1, F.col("n"))).over(Window.partitionBy("group"))
    return named.select("target", "group", "n", (F.col("n") * 100.0 / column_total).alias("pct"))


def small_cells(table: DataFrame, threshold: int = 10) -> DataFrame:
    return table.where(F.col("n") < threshold)


def group_table(df: DataFrame, column: str, group: str, groups: list[str]) -> DataFrame:
    """Counts of each value by group, in columns; empty cells are 0."""
    return df.groupBy(column).pivot(group, groups).agg(F.count(F.lit(1))).fillna(0)


def age_description(df: DataFrame, column: str) -> DataFrame:
    """n, mean, median, quartile text and missing values of ages."""
    out = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.count_if(F.col(column).isNull()).alias("n_missing"), F.count(F.lit(1)).alias("all"))
    out = out.join(F.broadcast(quantiles(df, [column], [0.25, 0.5, 0.75])))
    return out.select("n", "mean", F.col("q")[1].alias("median"), F.format_string("%.1f-%.1f", F.col("q")[0], F.col("q")[2]).alias("iqr"), "n_missing", F.try_divide(F.col("n_missing") * 100.0, F.col("all")).alias("pct_missing"))


def age_distribution(df: DataFrame, column: str) -> DataFrame:
    return value_counts(df.select(age_group(F.col(column)).alias("g")), "g")


def retention(df: DataFrame, stages: dict[str, Column], by: str) -> DataFrame:
    """Rows of each cohort that pass each stage, and their share of all its rows; stages are tested together."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("raw"), *[F.count_if(c).alias(k) for k, c in stages.items()])
    return counts.select(by, "raw", *stages, *[(F.col(k) * 100.0 / F.col("raw")).alias(f"pct_{k}") for k in stages])


def otsu(histogram: DataFrame) -> DataFrame:
    """Threshold bin of a 256-bin histogram (bin, n): the largest between-class spread, in this form's own scale.

    The lower mean is a ratio of running sums; the upper one divides a sum of counts by a share, as the masks that
    this reproduces were made with it. Ties take the first bin.
    """
    everything, upto = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(everything)
    run = histogram.withColumn("w0", F.sum("n").over(upto) / total).withColumn("sum0", F.sum(F.col("n") * F.col("bin") / 255.0).over(upto)).withColumn("all", F.sum(F.col("n") * F.col("bin") / 255.0).over(everything)).withColumn("count0", F.sum("n").over(upto))
    mu0 = F.col("sum0") / (F.col("count0") + 1e-10)
    mu1 = (F.col("all") - F.col("sum0")) / (1 - F.col("w0") + 1e-10)
    spread = F.col("w0") * (1 - F.col("w0")) * (mu0 - mu1) * (mu0 - mu1)
    return run.withColumn("spread", spread).agg(F.max_by("bin", F.struct("spread", -F.col("bin"))).alias("threshold"), F.max("spread").alias("spread"))
