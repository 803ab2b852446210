"""Cut rows into shards of near equal bytes by histogram sort.

The sort key is 64 bits: 32 bits of the text's hash, then 32 bits of the row's hash. Equal texts are neighbours,
and a group too large for one shard can still be cut inside. Probes are the edges of equal key ranges: one pass
counts the exact bytes and rows of 4096 ranges; ranges that hold a splitter and are wider than the tolerance, or
that hold many times the mean number of rows, are probed again by 1024 finer edges, and so on until every
splitter meets the tolerance or its key bits are used up. Then one exchange deals the rows to the final ranges.

What reaches the driver are counts of ranges: 4096 and 1024 for each range refined, of which there can be no
more than (shards - 1 + 4096 / HEAVY) at a time, so the bound does not depend on the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed

FIRST_BITS = 12
MORE_BITS = 10
#: A range with so many times the mean of the first ranges' rows is cut again, so that no task ranks too many rows.
HEAVY = 16
LEAST_HEAVY_ROWS = 20_000
TOLERANCE = 0.001


def sized_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key) of every row; a null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    high = F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)), 32)
    low = F.xxhash64("doc_id", F.monotonically_increasing_id()).bitwiseAND(F.lit(0xFFFFFFFF))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), high.bitwiseOR(low).alias("key"))


def _prefix(bits: int) -> F.Column:
    return F.shiftrightunsigned("key", 64 - bits)


def _steps() -> list[int]:
    steps = [FIRST_BITS]
    while steps[-1] < 64:
        steps.append(min(64, steps[-1] + MORE_BITS))
    return steps


def find_ranges(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int, int, int]]:
    """(bits, prefix, bytes, rows) of the final key ranges in key order; together they cover every row once."""
    steps = _steps()

    def count(frame: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        found = frame.groupBy(_prefix(bits).alias("prefix")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        return sorted((bits, r["prefix"] & (2**64 - 1), r["bytes"], r["n"]) for r in found)

    ranges = count(rows, steps[0])
    total, n_rows = sum(r[2] for r in ranges), sum(r[3] for r in ranges)
    heavy = max(LEAST_HEAVY_ROWS, HEAVY * n_rows >> FIRST_BITS)
    slack = tolerance * total / shards
    for bits, finer in zip(steps, steps[1:]):
        below, again = 0, []
        for r in ranges:
            upto = below + r[2]
            goals = range(-(-below * shards // total) if total else 0, upto * shards // total + 1 if total else 0)
            # A goal inside the range is off both edges by more than the tolerance.
            off = any(min(g * total / shards - below, upto - g * total / shards) > slack for g in goals if 0 < g < shards)
            if r[0] == bits and r[3] > 1 and (off or r[3] > heavy):
                again.append(r)
            below = upto
        if not again:
            break
        inside = count(rows.where(_prefix(bits).isin([r[1] for r in again])), finer)
        ranges = sorted([r for r in ranges if r not in again] + inside, key=lambda r: r[1] << (64 - r[0]))
    return ranges


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text).

    Law ``bytes``: a shard's bytes are within ``tolerance`` of an equal share plus one range that cannot be cut
    (a row, or rows whose 64 key bits agree). Equal texts stay together save where a shard ends. Slots number a shard's rows from 0 without gaps in
    key order. Null texts count as empty, each row has size 1 at least; null doc_ids and repeated rows are rows like
    any other; an empty table gives an empty result; other columns are ignored.
    """
    rows = checkpointed(sized_rows(docs))
    ranges = find_ranges(rows, shards, tolerance)
    total = sum(r[2] for r in ranges)
    plan, below, place = [], 0, [0] * shards
    for bits, prefix, size, n in ranges:
        shard = min(shards - 1, int((below + size / 2) * shards // total))
        start = (prefix << (64 - bits)) & (2**64 - 1)
        plan.append((start - 2**64 if start >= 2**63 else start, shard, place[shard]))
        place[shard] += n
        below += size
    schema = T.StructType([T.StructField("range", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("first_slot", T.LongType())])
    # At most a few ten thousand ranges of 20 bytes, whatever the input: safe to broadcast.
    plan = F.broadcast(docs.sparkSession.createDataFrame(plan, schema))
    refined = {}
    for bits, prefix, _, _ in ranges:
        for coarse in _steps():
            if coarse < bits:
                refined.setdefault(coarse, set()).add(prefix >> (bits - coarse))
    start = F.shiftleft(_prefix(64), 0)
    for bits in reversed(_steps()[:-1]):
        whole = F.shiftleft(_prefix(bits), 64 - bits)
        start = F.when(~_prefix(bits).isin(sorted(refined[bits])), whole).otherwise(start) if bits in refined else whole
    order = Window.partitionBy("range").orderBy("key", "doc_id", "text_crc32")
    placed = rows.withColumn("range", start).withColumn("nth", F.row_number().over(order) - 1).join(plan, "range")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_slot") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
