"""Sinks: delimited text, JSON, Parquet by partition, Markdown, work lists without what is done already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work


def write_csv(df: DataFrame, path: str, single: bool = False, separator: str = ",", encoding: str = "utf-8", mark: bool = False) -> None:
    """One file only if asked: that is for summaries, whose rows fit one task. ``mark`` puts a byte-order mark before the header."""
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    out = (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("sep", separator)
    out.option("encoding", encoding).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, partitions: list[str]) -> None:
    body = df.select(*partitions, F.to_json(F.struct(*[c for c in df.columns if c not in partitions])).alias("value"))
    body.write.mode("overwrite").partitionBy(*partitions).text(path)


def write_table(df: DataFrame, path: str, partitions: list[str] = [], append: bool = False) -> None:
    """Parquet; task commits are atomic, so a lost task leaves nothing half written."""
    df.write.mode("append" if append else "overwrite").partitionBy(*partitions).parquet(path)


def write_whole(df: DataFrame, path: str) -> None:
    """Parquet that is there whole or not at all: what a failed write leaves is removed, and its error goes on."""
    try:
        df.write.parquet(path)
    except Exception:
        work.remove(df.sparkSession, path)
        raise


def write_lists(df: DataFrame, path: str, key: str, item: str) -> None:
    """One YAML file a key, with the sorted list of its items: ``dataset: ...``, then ``selected:`` and an item a line."""
    items = df.groupBy(key).agg(F.array_sort(F.collect_list(F.col(item))).alias("items"))
    text = F.concat(F.lit("dataset: "), F.to_json(F.struct(F.col(key).alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(key).alias("k")))) - 6), F.lit("\nselected:\n- "), F.array_join(F.col("items").cast("array<string>"), "\n- "))
    items.select(key, text.alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def written_as_expected(df: DataFrame, path: str, expected: int) -> None:
    found = df.sparkSession.read.parquet(path).count()
    if found != expected:
        raise ValueError(f"{path} has {found} rows, not {expected}")


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def markdown_rows(df: DataFrame) -> DataFrame:
    """Lines of a Markdown table's body, in the order of the rows' own text."""
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in df.columns])
    return df.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def markdown_header(df: DataFrame) -> str:
    return "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
