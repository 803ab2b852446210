"""Replicates of a table that a worker holds: draws, ranks and lots as vectors, a few replicates a task.

Draws are those of ``functions.prng``, to the bit. A table's rows are packed into blocks in their order and every group of
replicates reads all blocks, so no drawn row is ever a row of Spark, nothing is broadcast and nothing passes the driver.
Each group of replicates gets a copy of a small table; of one above ``COPIED`` rows there is one copy that all groups read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prng import B_MIX, B_STEP, I_MIX, I_STEP, LAST, OFFSET, PRIME
from ..sources import work

#: Rows a worker holds (some 60 bytes each at most); larger tables take the joins of ``inference``.
HELD = 1 << 23
#: Rows of a table that is copied for each group of replicates.
COPIED = 1 << 20
#: Replicates of one group, rows of a block, counters of one vector, counters of a task's turn over cells.
GROUP, BLOCK, STEP, TURN = 20, 1 << 16, 1 << 15, 1 << 18
_P, _BITS = np.uint64(PRIME), np.uint64(31)


class Counters:
    """The draws of counters ``start`` to ``stop`` - 1; what does not depend on the replicate is computed once."""

    def __init__(self, start: int, stop: int) -> None:
        i = np.arange(start, stop, dtype=np.uint64)
        self.i, self.first, self.mixed = i % _P, (i * np.uint64(I_STEP) + np.uint64(OFFSET)) % _P, i * np.uint64(I_MIX) % _P
        self.x, self.y = np.empty_like(i), np.empty_like(i)

    def _fold(self, times: int) -> None:
        """A number equal modulo the prime 2^31 - 1: below 2^63 two times give at most 2^31 + 1, whose square fits."""
        for _ in range(times):
            np.right_shift(self.x, _BITS, out=self.y)
            np.bitwise_and(self.x, _P, out=self.x)
            np.add(self.x, self.y, out=self.x)

    def at(self, b: int, n: int) -> np.ndarray:
        x = self.x
        np.add(self.first, np.uint64(b * B_STEP % PRIME), out=x)
        self._fold(1)
        np.multiply(x, x, out=x)
        np.add(x, self.i, out=x)
        np.add(x, np.uint64(b * B_MIX % PRIME), out=x)
        self._fold(2)
        np.multiply(x, x, out=x)
        np.add(x, self.mixed, out=x)
        np.add(x, np.uint64(b % PRIME), out=x)
        self._fold(2)
        np.multiply(x, np.uint64(LAST), out=x)
        self._fold(2)
        drawn = x.astype(np.uint32)
        drawn[drawn == PRIME] = 0
        if n < PRIME:
            drawn -= drawn // np.uint32(n) * np.uint32(n)
        return drawn


def counted(ends: np.ndarray, b: range, start: int, stop: int) -> np.ndarray:
    """Draws of each replicate by the range of cumulative counts ``ends`` they fall into."""
    out, n = np.zeros((len(b), len(ends)), np.int64), int(ends[-1])
    for low in range(start, stop, STEP):
        counters = Counters(low, min(low + STEP, stop))
        for k, replicate in enumerate(b):
            at = counters.at(replicate, n)
            if len(ends) <= 64:
                below = np.array([np.count_nonzero(at < np.uint32(e)) for e in ends[:-1]] + [len(at)])
                out[k] += np.diff(below, prepend=0)
            else:
                out[k] += np.bincount(np.searchsorted(ends, at, "right"), minlength=len(ends))
    return out


def drawn_cells(cm: DataFrame, replicates: int, offset: int = 0) -> DataFrame:
    """(b, y_true, y_pred, n): the draws of ``inference.resampled_cells`` without keys, by vectors of counters."""
    cells = F.array_sort(F.collect_list(F.struct("y_true", "y_pred", F.col("n").cast("long").alias("n"))))
    table = cm.where("n > 0").agg(cells.alias("cells"))
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    groups = cm.sparkSession.range(0, replicates, GROUP).select(F.col("id").alias("b"))
    turns = groups.join(F.broadcast(table.select(total.alias("total"), F.col("cells")["n"].alias("ns")))).where("total > 0")
    turns = turns.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(TURN).cast("long"))))
    # A number of its own: these rows are few bytes each, so they would else be dealt to one task.
    turns = turns.repartition(4 * cm.sparkSession.sparkContext.defaultParallelism, "b", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                several = range(r["b"], min(r["b"] + GROUP, replicates))
                n = counted(np.cumsum(r["ns"]), range(several.start + offset, several.stop + offset), r["start"], min(r["start"] + TURN, r["total"]))
                k, c = np.nonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(k + several.start), pa.array(c.astype(np.int32)), pa.array(n[k, c])], ["b", "cell", "n"])

    sums = turns.mapInArrow(run, "b long, cell int, n long").groupBy("b", "cell").agg(F.sum("n").alias("n"))
    names = table.select(F.posexplode("cells").alias("cell", "c")).select("cell", "c.y_true", "c.y_pred")
    return sums.join(F.broadcast(names), "cell").select("b", "y_true", "y_pred", "n")  # K x K rows


def weights(b: range, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """How often each of ``n`` rows is drawn in each replicate."""
    parts = [Counters(low, min(low + STEP, n)) for low in range(0, n, STEP)] if n <= 1 << 20 else None
    for replicate in b:
        at = np.empty(n, np.int64)
        for low in range(0, n, STEP):
            part = parts[low // STEP] if parts else Counters(low, min(low + STEP, n))
            at[low : low + STEP] = part.at(replicate, n)
        yield replicate, np.bincount(at, minlength=n)


class Ranking:
    """Rows by key and score. A row without key (-1), score (NaN) or class (``positive`` -1) takes no part."""

    def __init__(self, key: np.ndarray, positive: np.ndarray, score: np.ndarray) -> None:
        rows = np.flatnonzero((key >= 0) & (positive >= 0) & ~np.isnan(score))
        rows = rows[np.lexsort((score[rows], key[rows]))]
        k, s = key[rows], score[rows]
        new_key = np.concatenate([[True], k[1:] != k[:-1]])[: len(rows)]
        new = new_key | np.concatenate([[True], s[1:] != s[:-1]])[: len(rows)]
        self.runs = int(new.sum())
        self.code = np.full(len(key), 2 * self.runs, np.int64)
        run = np.cumsum(new) - 1
        self.code[rows] = 2 * run + positive[rows]
        self.keys, self.starts = k[new_key], run[new_key]
        self.of_run = np.repeat(np.arange(len(self.keys)), np.diff(np.append(self.starts, self.runs)))

    def sums(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each key's positives, negatives and twice its wins (ties count half), of counts by run and class."""
        if not self.runs:
            return self.keys, self.keys, self.keys
        neg, pos = counts[0 : 2 * self.runs : 2], counts[1 : 2 * self.runs : 2]
        before = np.cumsum(neg) - neg
        before -= before[self.starts][self.of_run]
        return tuple(np.add.reduceat(v, self.starts) for v in (pos, neg, pos * (2 * before + neg)))

    def weighted(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.sums(np.bincount(self.code, w, 2 * self.runs + 1).astype(np.int64))


def by_groups(placed: DataFrame, n: int, columns: dict[str, Column], replicates: int, run: Callable, schema: str) -> DataFrame:
    """``run``(arrays by name, in the order of ``i``; range of replicates) for each group of replicates, over all ``n`` rows.

    This runs a job for tables above ``COPIED`` rows.
    """
    inner = F.sort_array(F.collect_list(F.struct("i", *[c.alias(n) for n, c in columns.items()])))
    blocks = placed.groupBy(F.floor(F.col("i") / BLOCK).alias("block")).agg(inner.alias("rows"))
    names = list(columns)
    blocks = blocks.select("block", *[F.col("rows")[n].alias(n) for n in names])
    groups = -(-replicates // GROUP)
    several = lambda g: range(g * GROUP, min(g * GROUP + GROUP, replicates))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[int, dict[str, pa.Array]]] = {}  # of one group, as each has a task of its own
        for batch in batches:
            for k, (g, block) in enumerate(zip(batch["g"].to_pylist(), batch["block"].to_pylist())):
                # An array put together is one of its own, which does not keep the batch.
                found.setdefault(g, {})[block] = {n: pa.concat_arrays([(a := batch[n].slice(k, 1).flatten()), a[:0]]) for n in names}
            del batch
        for g, parts in found.items():
            order = sorted(parts)
            arrays = {n: pa.concat_arrays([parts[block].pop(n) for block in order]) for n in names}
            yield from run(arrays, several(g)).to_batches()

    if n > COPIED:
        work.shared_folder(placed.sparkSession)
        each = placed.sparkSession.range(0, groups, 1, groups).select(F.col("id").alias("g"))
        return each.hint("shuffle_replicate_nl").join(blocks.checkpoint().coalesce(1)).mapInArrow(read, schema)
    every = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups, "g")

    def one(key: tuple, table: pa.Table) -> pa.Table:
        g, table = key[0].as_py(), table.sort_by("block")
        arrays = {n: pa.concat_arrays([c.flatten() for c in table[n].chunks]) for n in names}
        return run(arrays, several(g))

    return every.groupBy("g").applyInArrow(one, schema)


def ranked_score(score: Column) -> Column:
    """The score as SQL ranks it: NaN above all numbers, null above NaN."""
    score = score.cast("double")
    return F.when(F.isnan(score), F.lit(np.finfo(float).max)).otherwise(F.coalesce(score, F.lit(float("inf"))))


def _numbers(a: pa.Array, missing: float, kind: type) -> np.ndarray:
    if pa.types.is_boolean(a.type):
        a = a.cast(pa.int8())
    return a.fill_null(missing).to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _auc(tallies: DataFrame) -> Column:
    return F.try_divide(F.col("w").cast("double"), 2 * F.col("n_pos") * F.col("n_neg")).alias("auc")


_AUC = "b long, n_pos long, n_neg long, w long"


def _rows(found: list[tuple], names: str) -> pa.Table:
    fields = [f.split() for f in names.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = zip(*found) if found else [[] for _ in fields]
    return pa.table({n: pa.array(list(map(lambda v: v if isinstance(v, str) else int(v), c)), kinds[k]) for (n, k), c in zip(fields, columns)})


def resampled_auc(placed: DataFrame, n: int, replicates: int) -> DataFrame:
    """(b, n_pos, n_neg, auc) of ``replicates`` draws of the ``n`` rows (i, positive, score) with replacement."""

    def run(a: dict[str, pa.Array], b: range) -> pa.Table:
        positive = _numbers(a["positive"], -1, np.int8)
        ranking = Ranking(np.zeros(n, np.int8), positive, _numbers(a["score"], np.nan, float))
        found = [(r, *(int(v.sum()) for v in ranking.weighted(w))) for r, w in weights(b, n)]
        return _rows(found, _AUC)

    out = by_groups(placed, n, {"positive": F.col("positive"), "score": ranked_score(F.col("score"))}, replicates, run, _AUC)
    return out.select("b", "n_pos", "n_neg", _auc(out))


_GAPS = "b long, kind string, of int, label int, n_pos long, n_neg long, w long"


def resampled_groups(placed: DataFrame, n: int, k: int, replicates: int) -> tuple[DataFrame, DataFrame]:
    """What ``replicates`` draws of the ``n`` rows (i, group, y_true, y_pred, proba) come to, in two tables.

    (b, group, y_true, y_pred, n), and (b, group, label, auc) of each of ``k`` labels against the rest, where a row without
    a label's score has no part; the AUC over all rows has ``of`` -1. This runs a job: both come from one pass over draws.
    """
    work.shared_folder(placed.sparkSession)
    cell = ["group", "y_true", "y_pred"]
    kinds = placed.select(cell).distinct().agg(F.array_sort(F.collect_list(F.struct(*cell))).alias("cells"))
    kinds = kinds.select("cells", F.array_sort(F.array_distinct(F.filter(F.col("cells")["group"], lambda g: g.isNotNull()))).alias("groups"))
    # One row a (group, true, predicted): groups are few by nature.
    named = kinds.select("groups", F.posexplode("cells").alias("cell", "c")).select("cell", "c.*", (F.array_position("groups", F.col("c.group")) - 1).cast("int").alias("of"))
    named = named.withColumn("of", F.coalesce("of", F.lit(-1))).checkpoint()
    c = named.select(*[F.col(x).alias(f"_{x}") for x in named.columns])
    known = placed.join(F.broadcast(c), [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in cell])
    columns = {"cell": F.col("_cell"), "of": F.col("_of"), "y_true": F.col("y_true").cast("int")}
    columns |= {f"score{j}": F.when(F.size("proba") > j, ranked_score(F.get("proba", F.lit(j)))) for j in range(k)}

    def run(a: dict[str, pa.Array], b: range) -> pa.Table:
        cell, of, true = _numbers(a["cell"], -1, np.int64), _numbers(a["of"], -1, np.int64), _numbers(a["y_true"], -1, np.int64)
        rankings = []
        for j in range(k):
            positive = np.where(true < 0, -1, true == j).astype(np.int8)
            score = _numbers(a[f"score{j}"], np.nan, float)
            # Keys: 0 for all rows, and the groups from 1 on.
            rankings += [(j, -1, Ranking(np.zeros(n, np.int8), positive, score)), (j, 0, Ranking(of, positive, score))]
        found = []
        for r, w in weights(b, n):
            counts = np.bincount(cell, w).astype(np.int64)
            found += [(r, "cell", x, -1, counts[x], 0, 0) for x in np.flatnonzero(counts)]
            for j, shift, ranking in rankings:
                found += [(r, "auc", key + shift, j, p, q, v) for key, p, q, v in zip(ranking.keys, *ranking.weighted(w))]
        return _rows(found, _GAPS)

    out = by_groups(known, n, columns, replicates, run, _GAPS).checkpoint()
    cells = out.where("kind = 'cell'").select("b", F.col("of").alias("cell"), F.col("n_pos").alias("n")).join(F.broadcast(named), "cell").select("b", *cell, "n")
    groups = named.where("of >= 0").select("of", "group").distinct()
    aucs = out.where("kind = 'auc'").join(F.broadcast(groups), "of", "left")
    return cells, aucs.select("b", "of", "group", "label", _auc(aucs))


# Fixed values of MD5: rotations, sines and start.
_TURNS = [r for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in four * 4]
_SINES = [int(abs(np.sin(k + 1)) * 2**32) & 0xFFFFFFFF for k in range(64)]
_WORD = [k if k < 16 else (5 * k + 1) % 16 if k < 32 else (3 * k + 5) % 16 if k < 48 else 7 * k % 16 for k in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_LANES = 1 << 14


def md5_blocks(words: list[np.ndarray | int], rows: int) -> list[np.ndarray]:
    """The digest's four words of messages of one block each: 16 words, those equal in all rows as numbers."""
    a, b, c, d = (np.full(rows, s, np.uint32) for s in _START)
    f, t = np.empty(rows, np.uint32), np.empty(rows, np.uint32)
    for k in range(64):
        if k < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif k < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words[_WORD[k]]
        if isinstance(word, int):
            np.add(f, np.uint32((word + _SINES[k]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, word, out=f)
            np.add(f, np.uint32(_SINES[k]), out=f)
        np.left_shift(f, np.uint32(_TURNS[k]), out=t)
        np.right_shift(f, np.uint32(32 - _TURNS[k]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [v + np.uint32(s) for v, s in zip((a, b, c, d), _START)]


class Lots:
    """Orders of rows by ``functions.prng.lot``: the MD5 of a replicate's number and the row's ``ends``, then the row itself."""

    def __init__(self, ends: pa.Array) -> None:
        wide = pa.types.is_large_string(ends.type) or pa.types.is_large_binary(ends.type)
        first = np.frombuffer(ends.buffers()[1], np.int64 if wide else np.int32)[ends.offset : ends.offset + len(ends) + 1]
        content = np.frombuffer(ends.buffers()[2] or b"", np.uint8)
        sizes = np.diff(first)
        self.n, self.parts = len(ends), []
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size).astype(np.int32)
            held = np.empty((len(rows), size), np.uint8)
            for at in range(0, len(rows), _LANES):
                held[at : at + _LANES] = content[first[rows[at : at + _LANES]][:, None] + np.arange(size)]
            self.parts.append((rows, held))

    def order(self, b: int) -> np.ndarray:
        prefix, lots = str(b).encode(), np.empty(self.n, np.uint64)
        # Each row's place stands in the last bits of its lot's first half: numbers sort faster than places by numbers.
        last = np.uint64((1 << max(1, self.n - 1).bit_length()) - 1)
        for rows, content in self.parts:
            for at in range(0, len(rows), _LANES):
                some = rows[at : at + _LANES]
                lots[some] = self._digests(prefix, content[at : at + _LANES])[0] & ~last | some.astype(np.uint64)
        lots.sort()
        tied = np.concatenate([np.flatnonzero(lots[at + 1 : at + 1 + BLOCK] ^ lots[at : at + BLOCK][: self.n - 1 - at] <= last) + at for at in range(0, max(1, self.n - 1), BLOCK)])
        np.bitwise_and(lots, last, out=lots)
        order = lots.view(np.int64)
        if len(tied):
            # Rows equal in the other bits go by the whole lot, then by their own place.
            tied = np.union1d(tied, tied + 1)
            found = np.sort(order[tied])
            high, low = np.empty(len(found), np.uint64), np.empty(len(found), np.uint64)
            for rows, content in self.parts:
                at = np.flatnonzero(np.isin(rows, found, assume_unique=True))
                if len(at):
                    to = np.searchsorted(found, rows[at])
                    high[to], low[to] = self._digests(prefix, content[at])
            order[tied] = found[np.lexsort((low, high))]
        return order

    def _digests(self, prefix: bytes, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, size = content.shape
        size += len(prefix)
        if size > 55:  # more than a block
            both = np.array([np.frombuffer(hashlib.md5(prefix + c.tobytes()).digest(), ">u8") for c in content], np.uint64)
            return both[:, 0], both[:, 1]
        block = np.zeros((rows, 64), np.uint8)
        block[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
        block[:, len(prefix) : size] = content
        block[:, size], block[:, 56:58] = 0x80, np.frombuffer((8 * size).to_bytes(2, "little"), np.uint8)
        words, used = block.view("<u4"), range(len(prefix) // 4, size // 4 + 1)
        digest = md5_blocks([np.ascontiguousarray(words[:, k]) if k in used else int(words[0, k]) for k in range(16)], rows)
        a, b, c, d = (v.byteswap().astype(np.uint64) for v in digest)
        return a << np.uint64(32) | b, c << np.uint64(32) | d


def permuted_auc(placed: DataFrame, n: int, replicates: int) -> DataFrame:
    """(b, n_pos, n_neg, auc) of rows (i, uid, positive, score): classes in their order meet scores in the order of lots."""

    def run(a: dict[str, pa.Array], b: range) -> pa.Table:
        # What has been turned into another form goes at once: two workers share what an executor's heap leaves.
        score = _numbers(a.pop("score"), np.nan, float)
        values = np.unique(score[~np.isnan(score)])
        run_of = np.empty(n, np.int32)  # rows without score have the number behind the last
        for at in range(0, n, BLOCK):
            run_of[at : at + BLOCK] = np.searchsorted(values, score[at : at + BLOCK])
        del score
        runs, lots, positive = len(values), Lots(a.pop("ends")), _numbers(a.pop("positive"), -1, np.int8)
        step = max(STEP, 2 * runs)
        found = []
        for r in b:
            order, counts = lots.order(r), np.zeros(2 * runs + 2, np.int64)
            for at in range(0, n, step):
                known = positive[at : at + step]
                code = 2 * run_of[order[at : at + step]] + known
                counts += np.bincount(code if (known >= 0).all() else code[known >= 0], minlength=len(counts))
            neg, pos = counts[0 : 2 * runs : 2], counts[1 : 2 * runs : 2]
            found.append((r, int(pos.sum()), int(neg.sum()), int((pos * (2 * (np.cumsum(neg) - neg) + neg)).sum())))
        return _rows(found, _AUC)

    ends = F.coalesce(F.concat(F.lit("|"), F.col("uid").cast("string")), F.lit(""))  # concat_ws leaves a null out
    out = by_groups(placed, n, {"ends": ends, "positive": F.col("positive"), "score": ranked_score(F.col("score"))}, replicates, run, _AUC)
    return out.select("b", "n_pos", "n_neg", _auc(out))
