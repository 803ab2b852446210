"""Row numbers and exact quantiles without a task that holds a whole group: ranges of rows, each with its own offset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import work


def running(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (), weight: Column | None = None, name: str = "before") -> DataFrame:
    """``name``: the sum of ``weight`` (1 if none) over the rows before each row, in the order within its keys.

    Rows are dealt to tasks by ranges of (keys, order), so one key may hold any share of them; only rows equal in the
    whole order stay together. Ranges come from a sample, so they are fixed by a checkpoint before offsets are taken:
    this runs a job. Offsets are a row for each range and key in it.
    """
    work.shared_folder(df.sparkSession)
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranks = [f"_order{i}" for i in range(len(by))]
    laid = df.withColumns({"_weight": F.lit(1).cast("long") if weight is None else weight, **dict(zip(ranks, by))})
    laid = laid.repartitionByRange(*ranks).withColumn("_range", F.spark_partition_id()).checkpoint()
    # Keys under names of their own: null keys are keys as well.
    sums = laid.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_at")).agg(F.sum("_weight").alias("_sum"))
    earlier = Window.partitionBy(*([f"_of_{k}" for k in keys] or [F.lit(0)])).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_range", *keys).orderBy(*ranks).rowsBetween(Window.unboundedPreceding, -1)
    local = laid.withColumn("_local", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    same = [F.col("_range") == F.col("_at"), *[F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]]
    out = local.join(offsets, same).withColumn(name, F.col("_offset") + F.col("_local"))
    return out.drop("_weight", "_range", "_local", "_at", "_offset", *ranks, *[f"_of_{k}" for k in keys])


def numbered(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (), name: str = "place") -> DataFrame:
    """``name``: 0, 1, ... in the order within the keys."""
    return running(df, order, keys, None, name)


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(column, q): exact quantiles of each column's values, linear between neighbours; null without any value.

    Equal values are counted where they lie first; each share then takes the two values whose counts hold its place.
    """
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
    counts = stacked.where("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = running(counts, ["v"], ["column"], F.col("n"))
    totals = counts.groupBy("column").agg((F.sum("n") - 1).alias("last"))
    near = placed.join(F.broadcast(totals), "column")  # a row a column

    def held(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("v")))

    at = [F.col("last") * s for s in shares]
    ends = [f(p) for p in at for f in (lambda p: held(F.floor(p)), lambda p: held(F.ceil(p)))]
    found = near.groupBy("column", "last").agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)])

    def between(i: int, p: Column) -> Column:
        low, high = F.col(f"e{2 * i}"), F.col(f"e{2 * i + 1}")
        return F.when(F.floor(p) == F.ceil(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    values = found.select("column", F.array(*[between(i, p) for i, p in enumerate(at)]).alias("q"))
    wanted = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return wanted.join(values, "column", "left")
