"""Sources: delimited text with encodings to try, JSON arrays, slide files by layout, configuration, registries."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import MISSING_TOKENS, missing_to_null
from . import work

ENCODINGS = ("utf-8", "iso-8859-1")
LAYOUTS = ("case_folders", "flat", "split_folders", "surgen")


@dataclass(frozen=True)
class DatasetSpec:
    """Where a cohort's table lies and how its columns are called."""

    name: str
    metadata_csv: str
    id_column: str
    subfolder_structure: str
    embeddings_dir: str = ""
    stem_filter: str | None = None
    label_column: str | None = None
    force_label: str | None = None
    label_map: dict[str, str] = field(default_factory=dict)
    sex_column: str = "sex"
    age_column: str = "age"

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a dataset needs a name")
        if self.subfolder_structure not in LAYOUTS:
            raise ValueError(f"unknown layout {self.subfolder_structure}")


@dataclass(frozen=True)
class EvalConfig:
    task_name: str
    model_name: str
    datasets: tuple[DatasetSpec, ...]
    output_dir: str = "results"
    seed: int = 42

    def __post_init__(self) -> None:
        if not self.datasets:
            raise ValueError("a task needs a dataset")


def load_config(spark: SparkSession, path: str) -> EvalConfig:
    import yaml

    raw = yaml.safe_load(work.get_bytes(spark, path).decode("utf-8"))
    return EvalConfig(raw["task_name"], raw["model_name"], tuple(DatasetSpec(**d) for d in raw["datasets"]), raw.get("output_dir", "results"), raw.get("seed", 42))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, separator: str = ",", encoding: str = "utf-8", na: list[str] = MISSING_TOKENS,
    decimal: str = ".", true_values: list[str] | None = None, false_values: list[str] | None = None, multiline: bool = True,
) -> DataFrame:
    """A delimited file with a header; missing tokens are null, a byte-order mark in the first name goes.

    With a decimal sign or lists of truth values of one's own, the schema's doubles and booleans are read by them.
    ``multiline`` off lets Spark split files, where no quoted field holds a line break.
    """
    reader = spark.read.option("header", True).option("sep", separator).option("encoding", encoding).option("multiLine", multiline).option("escape", '"')
    own = {f.name: f.dataType for f in schema or () if (decimal != "." and isinstance(f.dataType, T.DoubleType)) or (true_values and isinstance(f.dataType, T.BooleanType))}
    if schema:
        reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) if f.name in own else f for f in schema]))
    df = reader.csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])

    def column(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.StringType):
            return c
        text = missing_to_null(c, na).alias(f.name)
        if f.name not in own:
            return text
        if isinstance(own[f.name], T.DoubleType):
            return F.replace(text, F.lit(decimal), F.lit(".")).try_cast("double").alias(f.name)
        return F.when(F.trim(text).isin(true_values), True).when(F.trim(text).isin(false_values or []), False).alias(f.name)

    return df.select(*[column(f) for f in df.schema])


def sniff(spark: SparkSession, path: str) -> str:
    """csv or excel: by extension, else by the first bytes."""
    if path.lower().endswith((".csv", ".tsv", ".txt")):
        return "csv"
    if path.lower().endswith((".xlsx", ".xls", ".xlsm")):
        return "excel"
    first = spark.read.format("binaryFile").load(path).select(F.expr("substring(content, 1, 2)").alias("m")).first()
    return "excel" if first and bytes(first["m"]) == b"PK" else "csv"


def read_with_fallback(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """UTF-8 (with or without a byte-order mark) if every line's bytes are valid UTF-8, else Latin-1.

    Lines are tested where they lie: the text source hands bytes on undecoded.
    """
    bad = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return read_csv(spark, path, separator=separator, encoding=ENCODINGS[1 if bad else 0])


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def rows_at(df: DataFrame, index: str, wanted: DataFrame) -> DataFrame:
    """The rows whose index is wanted: random access as a semi-join, so that Spark may push the keys to the scan."""
    return df.join(wanted.select(F.col(wanted.columns[0]).alias(index)), index, "left_semi")


def distinct_ids(df: DataFrame, names: list[str]) -> DataFrame:
    """Distinct non-blank ids of the first of ``names`` that the header has."""
    column = next((n for n in names if n in df.columns), None)
    if column is None:
        raise ValueError(f"none of {names} is a column")
    ids = F.trim(F.col(column).cast("string"))
    return df.select(ids.alias("id")).where(F.col("id").isNotNull() & (F.col("id") != "")).distinct()


def slide_files(spark: SparkSession, root: str, pattern: str = "*", skip: str = "patches") -> DataFrame:
    """(path, parent, stem, length) of files below ``root``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    return slide_paths(found).where(F.col("parent") != skip)


def slide_paths(paths: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return paths.withColumn("parent", F.element_at(parts, -2)).withColumn("stem", F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""))


def stems_by_case(stems: DataFrame, prefix: str) -> DataFrame:
    """(case, stems) of slide stems that start with ``prefix`` and hold a case number."""
    case = F.regexp_extract("stem", r"_T0*(\d+)_", 1)
    return stems.where(F.startswith("stem", F.lit(prefix)) & (case != "")).groupBy(case.alias("case")).agg(F.array_sort(F.collect_list("stem")).alias("stems"))


def nearest_level(levels: DataFrame, wanted: float) -> DataFrame:
    """Of each slide's pyramid levels (slide, level, downsample), the one nearest to a downsample."""
    return levels.groupBy("slide").agg(F.min_by("level", F.struct(F.abs(F.col("downsample") - wanted), "level")).alias("level"))


def parse_shard_name(name: str, models: list[str], tasks: list[str]) -> tuple[str, str] | None:
    """(model, task) of a shard's file name; names may hold underscores, so known ones are tried, longest first."""
    stem = re.sub(r"\.\w+$", "", name)
    for model in sorted(models, key=len, reverse=True):
        for task in sorted(tasks, key=len, reverse=True):
            if stem.endswith(f"{model}_{task}"):
                return model, task
    return None
