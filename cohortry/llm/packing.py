"""Pack tokenised documents into sequences by the sum-of-squares rule.

Documents are tokenised once, and what moves on is one small row per piece. Pieces longer than a sequence are cut
so that only the first can be short; full ones are sequences by themselves. First pieces are dealt at random to
groups of about ``GROUP_ITEMS`` and every group is packed by itself, longest piece first: a piece goes to the open
sequence after which the sum over all gaps of (number of open sequences with that gap) squared is smallest, ties
to the smallest gap, and a new sequence is opened only if the piece fits into none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .tokens import ByteBpe

SEQUENCE = 1024
END_ID = 2
GROUP_ITEMS = 8192
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PACKED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
_FIELDS = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(length: int, capacity: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than ``capacity``."""
    first = (length - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def sum_of_squares(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of every item, as the rule places them, longest first (ties in the order given)."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_with = np.zeros(capacity + 1, np.int64)  # by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        after, now = open_with[: capacity - size], open_with[size:capacity]
        gap = capacity
        if len(now):
            # Moving one sequence from gap g to g - size changes the sum by 2 (n[g-size] - n[g] + 1); a full one leaves.
            change = 2 * (after - now + 1)
            change[0] = 1 - 2 * now[0]
            change[now == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if now[best]:
                gap = best + size
        if gap == capacity:
            number, used = used, used + 1
        else:
            number = stacks[gap].pop()
            open_with[gap] -= 1
        bins[i], offsets[i] = number, capacity - gap
        if gap > size:
            stacks[gap - size].append(number)
            open_with[gap - size] += 1
    return bins, offsets


def token_pieces(docs: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents' pieces; a null text is an empty one."""
    # Vocabulary files lie beside the installed library on every machine.
    ranks, tokenizer, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBpe(ranks, tokenizer, pattern)
        end = np.array([END_ID], np.uint32)
        for part in (batch.slice(start, 256) for batch in batches for start in range(0, batch.num_rows, 256)):
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                ids = np.concatenate([ids, end]).astype("<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)] if rows else [pa.array([], f.type) for f in _PIECES], schema=_PIECES)

    return docs.select("doc_id", "text").mapInArrow(tidy(tokenise), _FIELDS)


def pack(docs: DataFrame, capacity: int = SEQUENCE, group_items: int = GROUP_ITEMS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text).

    Null and empty texts are one piece, the end id alone. Null doc_ids and repeated rows are packed like any other
    rows; an empty table gives an empty result; other columns are ignored. Offsets in a sequence leave no gap.
    """
    groups = max(1, -(-docs.count() // group_items))

    def place(found: pa.Table) -> pa.Table:
        found = found.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = found["length"].to_numpy()
        bins, offsets = sum_of_squares(lengths, capacity)
        group = found["part"][0].as_py()
        return pa.table([found[f.name] for f in _PIECES] + [pa.array((group << 40) + bins), pa.array(offsets)], schema=_PACKED)

    pieces = token_pieces(docs, capacity).withColumn("part", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups)))
    return pieces.groupBy("part").applyInArrow(place, f"{_FIELDS}, sequence_id bigint, offset bigint")
