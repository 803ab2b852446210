"""Helpers shared by the corpus operators: table access, checkpoints, vectorised word splitting and hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than these (space, tab, LF, VT, FF, CR).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark opens the path, so any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(session: SparkSession) -> str:
    """The folder for intermediate tables that all machines of the session share: that of ``spark.checkpoint.dir``.

    Where the session names none, a local folder does for a local master; on a cluster that is an error.
    """
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The rows as a Parquet table in the shared folder, and what drops it once its readers have run.

    For large intermediate tables: columns take a fraction of the space of checkpointed rows. A table whose writing
    fails is removed again.
    """
    session = df.sparkSession
    context = session.sparkContext
    path = f"{shared_folder(session)}/table-{uuid.uuid4().hex}"

    def drop() -> None:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)

    try:
        df.write.parquet(path)
    except BaseException:
        drop()
        raise
    return session.read.schema(df.schema).parquet(path), drop


def released(session: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now: it does so once their plans are collected as garbage."""
    gc.collect()
    session.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, and its memory released when it ends."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        trim()

    return wrapped


def trimmed(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` over a group, and its memory released when it ends."""

    def wrapped(found: pa.Table) -> pa.Table:
        out = run(found)
        trim()
        return out

    return wrapped


def source_key(column) -> F.Column:
    """A never-null text that orders like the source itself, null last."""
    return F.when(column.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), column))


def chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts) in runs of about ``limit`` bytes; a longer text is a run of its own."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield start, held


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LANES = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            steps = np.full(n + n // 4, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (multiply, xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a run of texts: byte bounds, hashes and, per text, where its words begin.

    A word's hash is a polynomial over its bytes, read off prefix sums, so a whole run is hashed at once.
    """

    def __init__(self, raws: list[bytes]):
        self.buffer = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        self.text_starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        space = _SPACE[self.buffer]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.text_starts)  # of each text, and one past the last

    def hashes(self) -> np.ndarray:
        n = len(self.buffer)
        forth, back = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.buffer] * forth[:n], out=sums[1:])
        return mix64((sums[self.ends] - sums[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order (none if there are fewer)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n] * _LANES[0]
    for k in range(1, width):
        total += words[k : n + k] * _LANES[k]
    return mix64(total)


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """One hash of a whole short sequence, apart from those of full windows."""
    return mix64((words * _LANES[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))


def record_batch(columns: dict[str, list | np.ndarray | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, field.type) for c, field in zip((columns[f.name] for f in schema), schema)], schema=schema)
