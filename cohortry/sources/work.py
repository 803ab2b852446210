"""Files on any file system Spark knows: the shared folder, small files whole, existence, retries."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

R = TypeVar("R")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one where the session names none and its master is local."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tables-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, so that queries that run at once do not meet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _path(spark, path)
    return files.exists(target)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, those of a format's own (_ or .) left out."""
    files, target = _path(spark, path)
    found = [(s.getPath().getName(), s.isDirectory()) for s in files.listStatus(target)]
    return sorted(n for n, is_folder in found if is_folder and not n.startswith(("_", ".")))


def remove(spark: SparkSession, path: str) -> None:
    files, target = _path(spark, path)
    files.delete(target, True)


def put_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file: written under another name first, so that a reader never sees half of it."""
    files, target = _path(spark, path)
    _, part = _path(spark, f"{path}.part")
    stream = files.create(part, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    files.delete(target, False)
    if not files.rename(part, target):
        raise OSError(f"{path} could not be written")


def get_bytes(spark: SparkSession, path: str) -> bytes:
    """One small file whole: configuration, never data."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row["content"])


def first_existing(spark: SparkSession, folders: list[str], name: str) -> str | None:
    return next((f"{f}/{name}" for f in folders if exists(spark, f"{f}/{name}")), None)


def retried(action: Callable[[], R], attempts: int = 3, delay: float = 2.0, errors: tuple[type[BaseException], ...] = (OSError,)) -> R:
    """The action's result; after an error of these kinds it runs again, ``attempts`` times in all, the n-th wait n delays long."""
    if attempts < 1:
        raise ValueError("attempts must be 1 or more")
    for attempt in range(1, attempts):
        try:
            return action()
        except errors:
            time.sleep(delay * attempt)
    return action()


def processed(work: DataFrame, key: str, action: Callable[[str], str], attempts: int = 3, delay: float = 0.0) -> DataFrame:
    """(key, result, error) of an action on every item's key, on the executors; a failing item is a row of the log, not a failed job."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            results, failures = [], []
            for value in batch[key]:
                result = error = None
                try:
                    result = retried(lambda v=value: action(v), attempts, delay, (Exception,))
                except Exception as e:  # noqa: BLE001 - the item's error is its row
                    error = f"{type(e).__name__}: {e}"
                results.append(result)
                failures.append(error)
            yield pd.DataFrame({key: batch[key], "result": pd.Series(results, dtype=object), "error": pd.Series(failures, dtype=object)})

    kind = work.schema[key].dataType.simpleString()
    return work.select(key).mapInPandas(run, f"`{key}` {kind}, result string, error string")
