"""Cohort tables: keys, joins with diagnostics, set operations, filters, deduplication, splits and pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import is_missing
from ..functions.prng import lot
from .ranks import numbered, quantiles


class KeyError_(ValueError):
    """A table breaks a key or column rule."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if absent := [c for c in columns if c not in df.columns]:
        raise KeyError_(f"missing columns: {', '.join(absent)}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str], samples: int = 5) -> DataFrame:
    """The table itself, or an error that names a few duplicate keys. Looks at ``samples`` rows on the driver."""
    if found := duplicate_keys(df, keys).limit(samples).collect():
        raise KeyError_(f"duplicate keys: {[tuple(r[k] for k in keys) for r in found]}")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The inner join, and the keys that only one side has: (key, side)."""
    sides = left.join(right, key, "left_anti").select(key, F.lit("left").alias("side")).union(right.join(left, key, "left_anti").select(key, F.lit("right").alias("side")))
    return left.join(right, key), sides


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key, the first in an order that leaves no ties."""
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")


def merge_shards(shards: list[DataFrame], key: str) -> DataFrame:
    """Shards as one table, a key's row from the first shard that has it; one shard alone stays as it is."""
    if len(shards) == 1:
        return shards[0]
    out = None
    for k, shard in enumerate(shards):
        part = shard.withColumn("_shard", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return keep_first(out, [key], ["_shard"]).drop("_shard")


def fuse(cohorts: list[tuple[str, DataFrame, str]], label: str) -> DataFrame:
    """Cohorts (name, table with id, label column) as one: ids prefixed by the name, labels under one name."""
    out = None
    for name, df, column in cohorts:
        part = df.withColumn("id", F.concat(F.lit(f"{name}_"), F.col("id").cast("string"))).withColumnRenamed(column, label)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(~F.greatest(*[is_missing(F.col(c)) for c in columns], F.lit(False)))


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing, n_total, pct_missing) and the rows that dropping them all would leave, in one pass."""
    any_missing = F.greatest(*[is_missing(F.col(c)) for c in columns], F.lit(False))
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~any_missing).alias("kept"), *[F.count_if(is_missing(F.col(c))).alias(f"m_{k}") for k, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{k}").alias("n_missing")) for k, c in enumerate(columns)])
    return counts.select(F.explode(rows).alias("r"), "n", "kept").select("r.column", "r.n_missing", F.col("n").alias("n_total"), F.try_divide(F.col("r.n_missing") * 100.0, F.col("n")).alias("pct_missing"), F.col("kept").alias("n_kept"))


def outliers_iqr(df: DataFrame, column: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, bounds and the number of values outside; a null value counts as outside."""
    q = quantiles(df, [column], [0.25, 0.75])
    bounds = q.select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).withColumn("low", F.col("q1") - (F.col("q3") - F.col("q1")) * reach).withColumn("high", F.col("q3") + (F.col("q3") - F.col("q1")) * reach)
    return df.join(F.broadcast(bounds)).groupBy("q1", "q3", "low", "high").agg(F.count_if(~F.coalesce(F.col(column).between(F.col("low"), F.col("high")), F.lit(False))).alias("n_outliers"))


# -- splits --

CV_BELOW = 60


def evaluation_method(n: Column, method_id: Column, use_cv: Column) -> Column:
    """A configured method wins, then a configured choice; else cross-validation for fewer than 60 patients."""
    return F.coalesce(method_id, F.when(use_cv, "cv5").when(~use_cv, "fixed_split"), F.when(n < CV_BELOW, "cv5").otherwise("fixed_split"))


def evaluation_reason(n: Column, reason: Column) -> Column:
    return F.coalesce(reason, F.when(n < CV_BELOW, f"fallback_size_<{CV_BELOW}").otherwise(f">={CV_BELOW}"))


def folds(df: DataFrame, k: int, seed: int = 42, uid: str = "uid", label: str = "label") -> DataFrame:
    """Fold 0 to k - 1 of each row: round-robin within each label in an order drawn by lot."""
    return numbered(df, [lot(seed, F.col(uid)), uid], [label], "fold").withColumn("fold", (F.col("fold") % k).cast("int"))


def fixed_split(df: DataFrame, train: float = 0.70, val: float = 0.15, test: float = 0.15, seed: int = 42, uid: str = "uid", label: str = "label") -> DataFrame:
    """train, val or test: test is a first fold of all, val a first fold of the rest."""
    if abs(train + val + test - 1) > 1e-9:
        raise ValueError("fractions must add up to 1")
    outer, inner = max(2, round(1 / test)), max(2, round(1 / (val / (train + val))))
    first = folds(df, outer, seed, uid, label).withColumnRenamed("fold", "_outer")
    # Numbered again among the rows that are left, so that val has its share of every label.
    rest = folds(first.where("_outer <> 0"), inner, seed + 1, uid, label)
    named = rest.withColumn("split", F.when(F.col("fold") == 0, "val").otherwise("train")).drop("fold")
    return named.unionByName(first.where("_outer = 0").withColumn("split", F.lit("test"))).drop("_outer")


def leaks(df: DataFrame, group: str = "uid", split: str = "split") -> DataFrame:
    """Groups that stand in more than one split; none in a sound split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def oversample(df: DataFrame, label: str = "label", uid: str = "uid") -> DataFrame:
    """Each class repeated to the size of the largest: whole copies, then the first rows by lot."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.agg(F.max("_n").alias("_top"))
    ranked = numbered(df, [lot(42, F.col(uid)), uid], [label], "_nth")
    copies = ranked.join(sizes, label).join(F.broadcast(top)).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_top") / F.col("_n")) - 1)))
    return copies.where(F.col("copy") * F.col("_n") + F.col("_nth") < F.col("_top")).drop("_n", "_top", "_nth")


def label_codes(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, code): codes 0 to K - 1 in the labels' own order."""
    distinct = df.where(F.col(label).isNotNull()).select(label).distinct()
    return distinct.withColumn("code", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(label)) - 1)


def seen_labels_only(df: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    return df.join(train.select(label).distinct(), label, "left_semi")


# -- pooling --


def mean_vectors(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Mean vector and number of rows of each key; dimensions are summed where the rows are, then put in order."""
    parts = df.select(*keys, F.posexplode(vector).alias("dim", "v")).groupBy(*keys, "dim").agg(F.avg(F.col("v").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    ordered = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("all"), F.max("n").alias("n"))
    return ordered.select(*keys, F.transform("all", lambda p: p["v"]).alias(vector), "n")


def patient_vectors(patches: DataFrame, patient: list[str], slide: str, vector: str = "embedding") -> DataFrame:
    """Patches to slides, slides to patients: a mean of means, so that slides weigh the same whatever their size."""
    slides = mean_vectors(patches, [*patient, slide], vector).drop("n")
    return mean_vectors(slides, patient, vector).withColumnRenamed("n", "n_slides")
