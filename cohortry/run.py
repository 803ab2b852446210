"""Runner: lists or runs task and model combinations, each to a Parquet result of its own; those that are there are skipped.

    python -m cohortry.run --predictions DIR --out DIR (--list | --all | --task T [--model M] | --combo T:M ...) [--dry-run]

A combination's predictions are the Parquet table DIR/<task>/<model>: uid, y_true, y_pred, proba and group columns.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators import metrics
from .sources import sinks, work

Combo = tuple[str, str]


def combos(values: Sequence[str]) -> list[Combo]:
    """(task, model) of ``task:model`` texts; anything else is an error."""
    out = []
    for value in values:
        task, colon, model = value.partition(":")
        if not (task and colon and model) or ":" in model:
            raise ValueError(f"{value} is not task:model")
        out.append((task, model))
    return out


def found(spark: SparkSession, folder: str) -> list[Combo]:
    """The combinations that have predictions below a folder, sorted."""
    if not work.exists(spark, folder):
        return []
    return sorted((task, model) for task in work.folders(spark, folder) for model in work.folders(spark, f"{folder}/{task}"))


def chosen(known: list[Combo], everything: bool, task: str | None, model: str | None, named: list[Combo]) -> list[Combo]:
    unknown = [c for c in named if c not in known]
    if unknown:
        raise ValueError(f"no predictions for {unknown}")
    if named:
        return named
    if not (everything or task or model):
        raise ValueError("choose --all, --task, --model or --combo")
    return [c for c in known if (not task or c[0] == task) and (not model or c[1] == model)]


def evaluated(predictions: DataFrame) -> DataFrame:
    return metrics.summary(metrics.per_class(metrics.cells(predictions)))


def run(spark: SparkSession, predictions: str, out: str, work_list: list[Combo], evaluate: Callable[[DataFrame], DataFrame] = evaluated, say: Callable[[str], None] = print) -> list[tuple[Combo, str]]:
    """The failures, each with its error: one combination's failure does not end the others."""
    failures = []
    for task, model in work_list:
        path = f"{out}/{task}/{model}"
        if work.exists(spark, f"{path}/_SUCCESS"):
            say(f"skip {task} {model}")
            continue
        try:
            work.remove(spark, path)
            sinks.write_whole(evaluate(spark.read.parquet(f"{predictions}/{task}/{model}")), path)
            say(f"done {task} {model}")
        except Exception as e:  # noqa: BLE001 - logged, and the exit code tells
            failures.append(((task, model), f"{type(e).__name__}: {str(e).splitlines()[0]}"))
            say(f"failed {task} {model}: {failures[-1][1]}")
    return failures


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cohortry.run", description="Evaluate predictions by task and model.")
    parser.add_argument("--predictions", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--list", action="store_true", help="name the combinations and end")
    parser.add_argument("--all", action="store_true")
    parser.add_argument("--task")
    parser.add_argument("--model")
    parser.add_argument("--combo", nargs="+", default=[], metavar="TASK:MODEL")
    parser.add_argument("--dry-run", action="store_true", help="name what would run and end")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    known = found(spark, given.predictions)
    if given.list:
        print("\n".join(f"{t}:{m}" for t, m in known))
        return 0
    try:
        todo = chosen(known, given.all, given.task, given.model, combos(given.combo))
    except ValueError as e:
        parser.error(str(e))
    if given.dry_run:
        print("\n".join(f"would run {t}:{m}" for t, m in todo))
        return 0
    return 1 if run(spark, given.predictions, given.out, todo) else 0


if __name__ == "__main__":
    sys.exit(main())
