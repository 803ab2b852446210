"""Cohort metadata by specification: one table per cohort, then one for all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import mapped, normalize_id, to_number, uid
from ..operators.cohorts import require_columns, require_unique
from .readers import DatasetSpec, read_csv


@dataclass(frozen=True)
class Task:
    """An evaluation task: its cohorts, and whether they are evaluated as one population."""

    task_name: str
    datasets: tuple[DatasetSpec, ...]
    evaluate_merged: bool = False


# Dimensions of the patch models' vectors.
MODEL_DIMS = {"uni2": 1536, "virchow2": 2560, "phikon_v2": 1024, "prov_gigapath": 1536}


def cohort_rows(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """uid, patient_id, dataset, age, sex, label of a cohort's raw table; rows without a label go, keys must be unique.

    Labels outside the map stay as they are. Columns for age and sex may be absent: they are null then.
    """
    needed = [spec.id_column] + ([] if spec.force_label else [spec.label_column])
    require_columns(df, [c for c in needed if c])
    text = lambda c: F.trim(F.col(f"`{c}`").cast("string")) if c in df.columns else F.lit(None).cast("string")
    label = F.lit(spec.force_label) if spec.force_label else mapped(text(spec.label_column), spec.label_map)
    rows = df.select(normalize_id(F.col(f"`{spec.id_column}`")).alias("patient_id"), to_number(text(spec.age_column)).alias("age"), text(spec.sex_column).alias("sex"), label.alias("label"))
    rows = rows.where(F.col("patient_id").isNotNull() & F.col("label").isNotNull())
    named = rows.select(uid(F.lit(spec.name), F.col("patient_id")).alias("uid"), "patient_id", F.lit(spec.name).alias("dataset"), "age", "sex", "label")
    return require_unique(named, ["uid"])


def unmapped_labels(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """(label, n) of labels that the map does not name, where there is one."""
    label = F.trim(F.col(f"`{spec.label_column}`").cast("string"))
    known = [*spec.label_map, *spec.label_map.values()]
    return df.where(label.isNotNull() & ~label.isin(known)).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def load_task(spark: SparkSession, task: Task) -> DataFrame:
    """All cohorts of a task, keys unique over all of them."""
    out = None
    for spec in task.datasets:
        part = cohort_rows(read_csv(spark, spec.metadata_csv), spec)
        out = part if out is None else out.unionByName(part)
    return require_unique(out, ["uid"])
