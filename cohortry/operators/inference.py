"""Bootstrap and permutation inference by integer counters: results do not depend on partitioning.

Count metrics depend on a resample only through its confusion cells, so a draw is an index into the cells' cumulative
counts (K x K rows) and no resample is joined back to the predictions. ``replicates.drawn_cells`` takes the same draws by
vectors in Python, for many replicates of large tables. ``poisson_cells`` is the form for tables too large for B x n draws:
every row weighs in with its own count per replicate, in one pass with map-side sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prng import draw, lot
from . import metrics
from . import replicates as vectors
from .ranks import numbered


CHUNK = 1 << 16


def indices(df: DataFrame, total: Column, name: str) -> DataFrame:
    """Each row once for each of 0 to ``total`` - 1, made in chunks that are dealt over the tasks: no array holds them all."""
    last = total.cast("long") - 1
    chunked = df.where(total > 0).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / CHUNK))))
    # A number of its own: chunks are few bytes each before they are made, so they would else be put together in one task.
    chunked = chunked.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "b", "_from")
    start = F.col("_from") * CHUNK
    return chunked.withColumn(name, F.explode(F.sequence(start, F.least(last, start + CHUNK - 1)))).drop("_from")


def cumulative(cm: DataFrame, keys: list[str] = []) -> DataFrame:
    """Cells with the index range [from_i, to_i) they own among their key's rows, and the key's total."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = F.sum("n").over(by.orderBy("y_true", "y_pred").rowsBetween(Window.unboundedPreceding, 0))
    return cm.where("n > 0").withColumn("to_i", upto).withColumn("from_i", F.col("to_i") - F.col("n")).withColumn("total", F.sum("n").over(by))


def resampled_cells(cm: DataFrame, replicates: int, keys: list[str] = [], offset: int = 0) -> DataFrame:
    """(b, keys, y_true, y_pred, n) of ``replicates`` draws with replacement of as many rows as each key has."""
    ranges = cumulative(cm, keys)
    totals = ranges.select(*keys, "total").distinct()
    spark = cm.sparkSession
    draws = totals.join(F.broadcast(spark.range(replicates).select(F.col("id").alias("b"))))
    draws = indices(draws, F.col("total"), "i")
    draws = draws.withColumn("at", draw(F.col("b") + offset, F.col("i"), F.col("total"))).alias("d")
    # Draws of one cell count, before they meet the cells: at most K x K ranges a key, so the range test is cheap.
    cells = F.broadcast(ranges.select(*keys, "y_true", "y_pred", "from_i", "to_i")).alias("c")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in keys]
    hit = draws.join(cells, [*same, F.col("d.at") >= F.col("c.from_i"), F.col("d.at") < F.col("c.to_i")])
    return hit.groupBy("d.b", *[f"d.{c}" for c in keys], "c.y_true", "c.y_pred").agg(F.count(F.lit(1)).alias("n"))


def poisson_cells(predictions: DataFrame, replicates: int, keys: list[str] = []) -> DataFrame:
    """(b, keys, y_true, y_pred, n): each row (uid) counts Poisson(1) times in each replicate."""
    u = draw(F.col("b"), F.pmod(F.xxhash64("uid"), F.lit(1 << 30)), F.lit(1_000_000)) / 1e6
    # Cumulative probabilities of a Poisson variable with mean 1.
    steps = [0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406, 0.999917]
    weight = sum(((u >= s).cast("long") for s in steps), F.lit(0))
    rows = predictions.select("uid", *keys, "y_true", "y_pred", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    return rows.groupBy("b", *keys, "y_true", "y_pred").agg(F.sum(weight).alias("n")).where("n > 0")


def interval(replicated: DataFrame, measures: list[str], keys: list[str] = [], level: float = 0.95) -> DataFrame:
    """Percentile interval and number of valid replicates of each measure, in long form."""
    tail = (1 - level) / 2
    stacked = replicated.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in measures])).alias("s"))
    ends = stacked.groupBy(*keys, "s.metric").agg(F.percentile("s.v", [tail, 1 - tail]).alias("q"), F.count("s.v").alias("n_valid"))
    return ends.select(*keys, "metric", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "n_valid")


def bootstrap_summary(predictions: DataFrame, replicates: int, keys: list[str] = [], level: float = 0.95) -> DataFrame:
    """Intervals of accuracy, balanced accuracy and macro F1; replicates with one true class are left out."""
    return summary_intervals(resampled_cells(metrics.cells(predictions, keys), replicates, keys), keys, level)


def summary_intervals(drawn: DataFrame, keys: list[str] = [], level: float = 0.95) -> DataFrame:
    """``bootstrap_summary`` of drawn cells."""
    each = metrics.summary(metrics.per_class(drawn, ["b", *keys]), ["b", *keys]).where("n_supported >= 2")
    return interval(each, ["accuracy", "balanced_accuracy", "f1_macro"], keys, level)


def sensitivity_intervals(drawn: DataFrame, level: float = 0.95) -> DataFrame:
    """(label, metric, ci_low, ci_high, n_valid) of the sensitivity of each class, of drawn cells."""
    each = metrics.per_class(drawn, ["b"]).where("support > 0")
    several = each.groupBy("b").agg(F.count(F.lit(1)).alias("classes")).where("classes >= 2")
    return interval(each.join(several, "b", "left_semi").withColumn("sensitivity", F.col("recall")), ["sensitivity"], ["label"], level)


def joined_rows(placed: DataFrame, n: int, replicates: int) -> DataFrame:
    """(b, columns of ``placed``): B x n draws of whole rows, numbered by ``i``, for metrics of scores.

    The draws come out of a few chunks, which look small enough to broadcast: a merge join keeps them off the driver.
    """
    draws = indices(placed.sparkSession.range(replicates).select(F.col("id").alias("b")), F.lit(n), "k")
    return draws.withColumn("i", draw(F.col("b"), F.col("k"), F.lit(n))).hint("merge").join(placed, "i").drop("i", "k")


def resampled_auc(scored: DataFrame, replicates: int) -> DataFrame:
    """AUC of each bootstrap replicate of rows (uid, positive, score), numbered in uid order.

    Draws are taken in the workers, which hold the table; one of more than ``HELD`` rows takes the join of all draws.
    """
    n = scored.count()
    placed = numbered(scored, ["uid"], name="i")
    return vectors.resampled_auc(placed, n, replicates) if 0 < n <= vectors.HELD else joined_auc(placed, n, replicates)


def joined_auc(placed: DataFrame, n: int, replicates: int) -> DataFrame:
    """``resampled_auc`` of any number of rows (i, positive, score)."""
    return metrics.auc(joined_rows(placed.select("i", "positive", "score"), n, replicates), ["b"])


def permuted_auc(scored: DataFrame, permutations: int) -> DataFrame:
    """AUC with labels permuted: labels in uid order meet scores in the order of a lot drawn per permutation.

    Lots are drawn and sorted in the workers, which hold the table; one of more than ``HELD`` rows takes the sort of all lots.
    """
    n = scored.count()
    placed = numbered(scored, ["uid"], name="i")
    return vectors.permuted_auc(placed, n, permutations) if 0 < n <= vectors.HELD else joined_permutations(placed, permutations)


def joined_permutations(placed: DataFrame, permutations: int) -> DataFrame:
    """``permuted_auc`` of any number of rows (i, uid, positive, score): B x n lots are sorted and meet the labels."""
    labels = placed.select("i", "positive")
    each = placed.sparkSession.range(permutations).select(F.col("id").alias("b"))
    drawn = numbered(placed.select("uid", "score").join(F.broadcast(each)), [lot(F.col("b"), F.col("uid")), "uid"], ["b"], "i")
    return metrics.auc(drawn.select("b", "i", "score").join(labels, "i").select("b", "positive", "score"), ["b"])


def permutation_test(scored: DataFrame, permutations: int) -> DataFrame:
    """Observed AUC, mean, deviation and 95th percentile under the null, and p = (1 + #null >= observed) / (B + 1)."""
    observed = metrics.auc(scored.select(F.lit(0).alias("one"), "positive", "score"), ["one"]).select(F.col("auc").alias("observed"))
    null = permuted_auc(scored, permutations).select("auc")
    return null.join(F.broadcast(observed)).agg(F.first("observed").alias("observed"), F.avg("auc").alias("null_mean"), F.stddev_samp("auc").alias("null_sd"), F.percentile("auc", 0.95).alias("null_p95"), ((F.sum((F.col("auc") >= F.col("observed")).cast("int")) + 1) / (F.count("auc") + 1)).alias("p_value"))
