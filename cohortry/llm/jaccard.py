"""Exact Jaccard self-join of documents on word shingles, by token-combination prefixes, and its components.

A token is the hash of a shingle. One pass counts token classes (``CLASS_BITS`` bits of the hash, so the sketch has a
fixed size); classes far above the mean are frequent. All documents order their tokens by class, rare ones first. With
p = n - ceil(0.75 n) + 1, two linked documents share a token among their first p. If a shared one there is rare, both
index it by itself. Otherwise all they share is frequent; then both prefixes are extended to 2p tokens, hold at least
p_min + 1 shared ones, and, as gaps add up to less than 5 p_min, some neighbouring two of these are at most 3 places
apart in both documents. So pairs of frequent tokens up to 3 places apart are indexed instead of single ones. (Sets
of under 8 tokens are too small for that; those of up to 10 index frequent tokens singly besides.) A pair so frequent
that its list could outgrow a task is indexed once per pair of salts, so that any two members still meet.

Equal sets are one node, named by the set's hash, never by a doc_id. The sets of all nodes that stand in a list beside
one of a fitting size are compared as a whole: a node's reach is the number of its tokens that other such sets hold
too. No node can share more than that, so those whose reach is under 0.75 of their size leave all lists, and a pair is
looked at only if the lesser reach allows the threshold. That takes away the fringe of large families (copies changed
too much to link), which otherwise would meet every member. The sets of the nodes that remain are written once.

Index lists are then read twice. First each member meets the hubs of its lists; verified links make components, so
most of a family of near copies is one component after a few comparisons a member. Then a node that stands in a list
beside one of a larger component asks that one's family, once, whatever they share besides: its set is counted
against the sets of all members in bounded blocks, so pairs never become rows, and only links come out. Verifying is
exact everywhere. Nothing but fixed-size sketches reaches the driver. Lists are dealt out by ranges of their keys' hash,
as many as the tokens or entries ask for, so a call's share grows neither with the number of texts nor with their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, checkpointed, chunks, mix64, released, sequence_hash, tidy, trimmed, window_hashes, written

WIDTH = 5
PERCENT = 75
CLASS_BITS = 23
PARTS = 64  # of the class sketch
#: A class's level is the number of these that its count exceeds the mean by, noise (three deviations) aside.
LEVELS = (3, 6, 10, 16, 1 << 17, 1 << 18, 1 << 19, 1 << 20, 1 << 21, 1 << 22, 1 << 23, 1 << 24)
FREQUENT = 4  # from this level on a class is frequent; each level above it doubles the salts of a pair's list
GAP = 3
BLOOM_BITS = 23
BLOOM_HASHES = 4
#: A range of the hash, which one call holds, has about so many tokens of all sets, or so many entries of lists, at most.
TOKENS_A_RANGE = 1 << 21
ENTRIES_A_RANGE = 1 << 18
LEAST_RANGES = 8
SLICE_ENTRIES = 1 << 17
FLUSH_ENTRIES = 1 << 18
FLUSH_TOKENS = 1 << 20
ROWS_AT_ONCE = 1 << 19
#: A unit of comparison holds about so many sets of either side; a task of comparisons holds about so many tokens.
BLOCK_NODES = 256
TOKENS_A_TASK = 1 << 21
_FIRST, _SECOND = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)
_SALT, _OTHER = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def _texts(column: pa.Array) -> Iterator[str | None]:
    """The column's texts one by one, so that no second copy of a whole batch is held."""
    return (value.as_py() for value in column)


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct token hashes of each text; fewer words than a shingle are one token, none are none."""
    for _, raws in chunks(texts):
        words = Words([raw.lower() for raw in raws])  # bytes.lower changes A-Z only
        hashes = words.hashes()
        windows = window_hashes(hashes, WIDTH)
        for a, b in zip(words.first[:-1], words.first[1:]):
            if b - a >= WIDTH:
                yield np.unique(windows[a : b - WIDTH + 1])
            else:
                yield sequence_hash(hashes[a:b]) if b > a else np.empty(0, np.uint64)


def node_id(tokens: np.ndarray) -> int:
    """64-bit name of a set; two of n different sets share one with probability below n^2 / 2^65."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
_SIGNED_DDL = "doc_id bigint, text_key bigint, n_shingles bigint, node bigint, part int, counts binary"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, node) of every document, and (part, counts) rows: the classes each task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts, any_set = set(), np.zeros(1 << CLASS_BITS, np.uint8), False
        for batch in batches:
            sizes, nodes = [], []
            for tokens in shingle_sets(_texts(batch.column(2))):
                node = node_id(tokens) if len(tokens) else None
                sizes.append(len(tokens))
                nodes.append(node)
                if node is not None and node not in seen:
                    seen.add(node)
                    classes, times = np.unique((tokens >> np.uint64(64 - CLASS_BITS)).astype(np.int64), return_counts=True)
                    counts[classes] = np.minimum(counts[classes] + times, 255)  # a task's say on one class is bounded; only the cost depends on it
                    any_set = True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())], schema=_SIGNED)
        if any_set:
            step = (1 << CLASS_BITS) // PARTS
            parts = [zlib.compress(counts[k * step : (k + 1) * step].tobytes(), 1) for k in range(PARTS)]
            none = pa.nulls(PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], schema=_SIGNED)

    return _keyed(docs).mapInArrow(tidy(run), _SIGNED_DDL)


def class_levels(signed: DataFrame) -> np.ndarray:
    """The level of each class, 0 for rare to len(LEVELS) for the most frequent: 8 MB whatever the input."""

    def mark(found: pa.Table) -> pa.Table:
        total = np.zeros((1 << CLASS_BITS) // PARTS, np.int64)
        for blob in found["counts"]:
            total += np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)
        mean = total.mean()
        level = np.searchsorted(np.array(LEVELS), total - mean - 3 * np.sqrt(mean)).astype(np.uint8)
        return pa.table({"part": found["part"].slice(0, 1), "levels": pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())})

    rows = signed.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(mark, "part int, levels binary").collect()
    whole = np.zeros(1 << CLASS_BITS, np.uint8)
    step = len(whole) // PARTS
    for r in rows:
        whole[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    return whole


def _level(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[(tokens >> np.uint64(64 - CLASS_BITS)).astype(np.int64)]


def _salted(keys: np.ndarray, level: np.ndarray, node: int) -> np.ndarray:
    """The keys with those of the highest levels replaced by one key per pair of salts, of which the node's own is one."""
    hot = level > FREQUENT
    if not hot.any():
        return keys
    out = [keys[~hot]]
    for at in np.unique(level[hot]):
        salts = 1 << int(at - FREQUENT)
        mine, other = node % salts, np.arange(salts)
        pair = (np.minimum(mine, other) * salts + np.maximum(mine, other)).astype(np.uint64)
        out.append(mix64(keys[level == at][:, None] * _SALT + pair * _OTHER).ravel())
    return np.concatenate(out)


def index_keys(tokens: np.ndarray, levels: np.ndarray, node: int = 0) -> tuple[np.ndarray, int]:
    """The keys under which a set is indexed, and how many of them are single rare tokens.

    Tokens stand in the order of their class's level, then of their hash: the same order in every set.
    """
    n = len(tokens)
    prefix = n - -(-PERCENT * n // 100) + 1
    level = _level(tokens, levels)
    order = np.argsort(level, kind="stable")
    tokens, level = tokens[order], level[order]
    often = level >= FREQUENT
    rare = tokens[~often][:prefix]
    if len(rare) == prefix:
        return rare, prefix
    common, at = tokens[often], level[often]
    keys = [rare]
    if n <= 10:
        some = prefix - len(rare)
        keys.append(_salted(common[:some], at[:some], node))
    if n >= 8:
        within, at = common[: 2 * prefix - len(rare)], at[: 2 * prefix - len(rare)]
        for gap in range(1, GAP + 1):
            if len(within) > gap:
                keys.append(_salted(mix64(within[:-gap] * _FIRST + within[gap:] * _SECOND), np.minimum(at[:-gap], at[gap:]), node))
    return np.concatenate(keys), len(rare)


_ENTRY = np.dtype([("key", "<u8"), ("node", "<i8"), ("n", "<i4"), ("rare", "<i4")])
_LISTS = "key bigint, node bigint, n int, rare int"


def _by_part(part: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts met, where each begins, where it ends) of rows put in the order of their part."""
    part = part[ordered]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return part[first], first, np.append(first[1:], len(part))


def ranges_for(amount: int, of_each: int) -> int:
    """A number of ranges, a power of two, that gives each ``of_each`` or less of ``amount``."""
    return max(LEAST_RANGES, 1 << (amount // of_each).bit_length())


def _beside(entries: np.ndarray) -> np.ndarray:
    """Those of ``entries`` that stand in a list beside one of a fitting size, each node once a list, by key, size and node."""
    entries = entries[np.argsort(entries["key"], kind="stable")]
    key = entries["key"]
    again = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    again[1:] |= same
    again[:-1] |= same
    entries = entries[again]  # most keys stand in one document only
    entries = entries[np.lexsort((entries["node"], entries["n"], entries["key"]))]
    key, node = entries["key"], entries["node"]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    entries = entries[fresh]
    key, n = entries["key"], entries["n"].astype(np.int64)
    fits = (key[1:] == key[:-1]) & (n[:-1] * 100 >= n[1:] * PERCENT)  # a list is in the order of sizes
    again = np.zeros(len(key), bool)
    again[1:] |= fits
    again[:-1] |= fits
    return entries[again]


def meeting_entries(blobs: Iterable[pa.Buffer | bytes], ranges: int) -> np.ndarray:
    """``_beside`` of a range's blobs of entries. They are read where they lie, a slice of the range after the other: no copy of all is made."""
    views = [np.frombuffer(b, _ENTRY) for b in blobs]
    slices = 1 << (sum(map(len, views)) // SLICE_ENTRIES).bit_length()
    if slices == 1:
        return _beside(np.concatenate(views))
    forth, back = np.uint64(ranges.bit_length() - 1), np.uint64(64 - (slices.bit_length() - 1))
    return np.concatenate([_beside(np.concatenate([v[v["key"] << forth >> back == k] for v in views])) for k in range(slices)])


def index_lists(docs: DataFrame, levels: np.ndarray, ranges: int) -> DataFrame:
    """(key, node, n, rare): the entries of all index lists, each node once a list and only beside one of a size that allows a link."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            entries = np.concatenate(held)
            part = (entries["key"] >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(entries), np.int64)
            order = np.argsort(part, kind="stable")
            parts, first, ends = _by_part(part, order)
            entries = entries[order]
            blobs = [entries[a:b].tobytes() for a, b in zip(first, ends)]
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "entries"])

        for batch in batches:
            for tokens in shingle_sets(_texts(batch.column(0))):
                if not len(tokens) or (node := node_id(tokens)) in seen:
                    continue
                seen.add(node)
                keys, rare = index_keys(tokens, shared.value, node)
                entries = np.empty(len(keys), _ENTRY)
                entries["key"], entries["node"], entries["n"], entries["rare"] = keys, node, len(tokens), rare
                held.append(entries)
                size += len(entries)
                if size > FLUSH_ENTRIES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def collect(found: pa.Table) -> pa.Table:
        entries = meeting_entries((b.as_buffer() for b in found["entries"]), ranges)
        return pa.table({"key": entries["key"].view(np.int64), "node": entries["node"], "n": entries["n"], "rare": entries["rare"]})

    return docs.select("text").mapInArrow(tidy(emit), "part bigint, entries binary").groupBy("part").applyInArrow(trimmed(collect), _LISTS)


def _bloom(keys: DataFrame) -> np.ndarray:
    """Bits of the 64-bit ``text_key`` hashes (2^23 bits: 1 MB whatever the input)."""
    spots = keys.select(F.explode(F.array(*[_spot(F.col("text_key"), k) for k in range(BLOOM_HASHES)])).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, spot & 31)")).alias("bits"))
    out = np.zeros(1 << (BLOOM_BITS - 5), "<u4")
    for r in words.collect():
        out[r["word"]] = r["bits"]
    return out


def _spot(key: F.Column, k: int) -> F.Column:
    return F.shiftrightunsigned(key, 13 * k).bitwiseAND(F.lit((1 << BLOOM_BITS) - 1)).cast("int")


def _let_through(docs: DataFrame, wanted: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]]:
    """(node, tokens) of the texts in batches of (text_key, text) that a Bloom filter of ``wanted`` (text_key) lets through, each node once."""
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        bits, seen = bloom.value, set()
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            let = np.ones(len(key), bool)
            for k in range(BLOOM_HASHES):
                spot = (key >> np.uint64(13 * k)).astype(np.int64) & ((1 << BLOOM_BITS) - 1)
                let &= (bits[spot >> 5] >> (spot & 31).astype(np.uint32) & 1).astype(bool)
            for tokens in shingle_sets(_texts(batch.column(1).filter(pa.array(let)))):
                if len(tokens) and (node := node_id(tokens)) not in seen:
                    seen.add(node)
                    yield node, tokens

    return run


def token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, tokens) of the texts of ``wanted`` (text_key), and of a few more. Several tasks may give the same node."""
    sets_of = _let_through(docs, wanted)
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, size = [], [], 0
        for node, tokens in sets_of(batches):
            nodes.append(node)
            sets.append(tokens.view(np.int64))
            size += len(tokens)
            if size > FLUSH_TOKENS:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)
                nodes, sets, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return _keyed(docs).select("text_key", "text").mapInArrow(tidy(run), "node bigint, tokens array<bigint>")


def reaches(docs: DataFrame, wanted: DataFrame, levels: np.ndarray, ranges: int) -> DataFrame:
    """(node, reach) of the texts of ``wanted`` (text_key): how many of its tokens some other of these nodes may hold too.

    Tokens of frequent classes count as held by others, so no list here is long. Tokens are told apart by their range
    and 32 more bits: a chance meeting makes a reach one too large, never too small.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    sets_of = _let_through(docs, wanted)
    bits = ranges.bit_length() - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names: list[int] = []
        often: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            owner = np.repeat(np.arange(len(held)), [len(t) for t in held])
            part = (tokens >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
            order = np.argsort(part, kind="stable")
            parts, first, ends = _by_part(part, order) if len(part) else ([], [], [])
            low = ((tokens << np.uint64(bits)) >> np.uint64(32)).astype("<u4")[order]
            owner, name = owner[order], np.array(names, "<i8")
            rows = []
            for k, a, b in zip(parts, first, ends):
                who, counts = np.unique(owner[a:b], return_counts=True)  # owners stand in order within a part
                rows.append((int(k), name[who].tobytes(), counts.astype("<u4").tobytes(), low[a:b].tobytes()))
            # Negative parts carry the numbers of frequent tokens.
            own = -1 - (name & (ranges - 1))
            rows += [(int(k), name[own == k].tobytes(), np.array(often, "<u4")[own == k].tobytes(), b"") for k in np.unique(own)]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "nodes", "counts", "tokens"])

        for node, tokens in sets_of(batches):
            rare = tokens[_level(tokens, shared.value) < FREQUENT]
            held.append(rare)
            names.append(node)
            often.append(len(tokens) - len(rare))
            size += len(tokens)
            if size > FLUSH_TOKENS:
                yield flush()
                held, names, often, size = [], [], [], 0
        if names:
            yield flush()

    def count(found: pa.Table) -> pa.Table:
        every = lambda c, kind: np.concatenate([np.frombuffer(b.as_py(), kind) for b in found[c]])
        names, at, place = np.unique(every("nodes", "<i8"), return_index=True, return_inverse=True)
        counts = every("counts", "<u4")
        if found["part"][0].as_py() < 0:
            return packed(names, counts[at].astype(np.int64))
        owner = np.repeat(place, counts).astype(np.int32)
        tokens = every("tokens", "<u4")
        order = np.lexsort((owner, tokens))
        tokens, owner = tokens[order], owner[order]
        fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])  # a node given by two tasks counts once
        tokens, owner = tokens[fresh], owner[fresh]
        same = tokens[1:] == tokens[:-1]
        held = np.zeros(len(tokens), bool)
        held[1:] |= same
        held[:-1] |= same
        times = np.bincount(owner[held], minlength=len(names))
        return packed(names[times > 0], times[times > 0].astype(np.int64))

    def packed(names: np.ndarray, held: np.ndarray) -> pa.Table:
        home = names & (ranges - 1)
        order = np.argsort(home, kind="stable")
        homes, first, ends = _by_part(home, order) if len(home) else ([], [], [])
        names, held = names[order].astype("<i8"), held[order].astype("<u4")
        return pa.table({"home": pa.array(homes, pa.int64()), "nodes": pa.array([names[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()), "held": pa.array([held[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())})

    def add(found: pa.Table) -> pa.Table:
        names, place = np.unique(np.concatenate([np.frombuffer(b.as_py(), "<i8") for b in found["nodes"]]), return_inverse=True)
        return pa.table({"node": names, "reach": np.bincount(place, np.concatenate([np.frombuffer(b.as_py(), "<u4") for b in found["held"]])).astype(np.int32)})

    parts = _keyed(docs).select("text_key", "text").mapInArrow(tidy(emit), "part bigint, nodes binary, counts binary, tokens binary")
    return parts.groupBy("part").applyInArrow(trimmed(count), "home bigint, nodes binary, held binary").groupBy("home").applyInArrow(trimmed(add), "node bigint, reach int")


def _allowed(n: F.Column, m: F.Column, reach: F.Column) -> F.Column:
    """Whether sets of sizes n and m that share ``reach`` tokens at most can reach the threshold."""
    return reach * (100 + PERCENT) >= (n + m) * PERCENT


def _with_part(lists: DataFrame, ranges: int) -> DataFrame:
    return lists.withColumn("part", F.shiftrightunsigned("key", 64 - (ranges.bit_length() - 1)) if ranges > 1 else F.lit(0).cast("bigint"))


def star_pairs(lists: DataFrame, ranges: int, partners: int = 3) -> DataFrame:
    """(a, b, nth): each node a with the hubs b that it meets most often, in that order, if sizes and reach allow a link.

    A list has two hubs: the member that meets most others in its range's lists, and the one of the largest reach for
    its size. Of a family of near copies both are central ones.
    """
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("met", pa.int64()), ("rare", pa.int32())])

    def meet(found: pa.Table) -> pa.Table:
        key, node, n, rare, reach = (found[c].to_numpy() for c in ("key", "node", "n", "rare", "reach"))
        if not len(key):
            return fields.empty_table()
        order = np.argsort(key, kind="stable")
        key, node, n, rare, reach = key[order], node[order], n[order].astype(np.int64), rare[order], reach[order].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(start, len(key)))
        which_list = np.repeat(np.arange(len(start)), sizes)
        names, place = np.unique(node, return_inverse=True)
        met = np.bincount(place, np.repeat(sizes, sizes))[place]
        codes = []
        for worth in (met, reach / n):
            hub = np.repeat(np.lexsort((node, -worth, which_list))[start], sizes)
            fits = (node != node[hub]) & (np.minimum(reach, reach[hub]) * (100 + PERCENT) >= (n + n[hub]) * PERCENT)
            codes.append(np.stack([place[fits], place[hub[fits]], rare[fits]]))
        a, b, few = np.concatenate(codes, axis=1)
        code, first, times = np.unique(a * np.int64(len(names)) + b, return_index=True, return_counts=True)
        return pa.table([pa.array(x, f.type) for x, f in zip((names[code // len(names)], names[code % len(names)], times, few[first]), fields)], schema=fields)

    met = _with_part(lists, ranges).groupBy("part").applyInArrow(trimmed(meet), "a bigint, b bigint, met bigint, rare int")
    counts = met.groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("rare").alias("rare"))
    best = counts.where(F.col("met") * 5 >= F.col("rare")).withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("met"), "b")))
    return best.where(F.col("nth") <= partners).select("a", "b", "nth")


def families(lists: DataFrame, components: DataFrame, stars: DataFrame) -> DataFrame:
    """(node, n, component, size, family) of the nodes in ``lists``; any partition into families gives the same links.

    A node's family is its component or, if it has none, that of the hub it meets most often. ``size`` is the
    component's number of nodes.
    """
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    known = components.join(sizes, "component").select("node", "component", "size")
    hubs = stars.where("nth = 1").select(F.col("a").alias("node"), F.col("b").alias("hub")).join(components.select(F.col("node").alias("hub"), F.col("component").alias("of_hub")), "hub", "left")
    nodes = lists.groupBy("node").agg(F.first("n").alias("n")).join(known, "node", "left").join(hubs, "node", "left")
    return nodes.select("node", "n", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("component", "of_hub", "hub", "node").alias("family"))


def questions(lists: DataFrame, grouped: DataFrame, ranges: int) -> DataFrame:
    """(node, family): a node must be compared with a family if a list holds it beside one of another component.

    Of two components the smaller one asks (ties: the smaller id), so the members of a large one never do for the sake
    of its fringe. There is one row for a node and a family, however many members they meet in however many lists.
    """
    fields = pa.schema([("node", pa.int64()), ("family", pa.int64())])

    def ask(found: pa.Table) -> pa.Table:
        key, node, component, family = (found[c].to_numpy() for c in ("key", "node", "component", "family"))
        n, reach, size = (found[c].to_numpy().astype(np.int64) for c in ("n", "reach", "size"))
        if not len(key):
            return fields.empty_table()
        order = np.lexsort((family, key))
        key, node, component, family, n, reach, size = (x[order] for x in (key, node, component, family, n, reach, size))
        by_rank = np.lexsort((component, size))
        changes = np.concatenate([[0], (np.diff(size[by_rank]) != 0) | (np.diff(component[by_rank]) != 0)])
        rank = np.empty(len(key), np.int64)
        rank[by_rank] = np.cumsum(changes)
        new_list = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.flatnonzero(new_list | np.concatenate([[True], family[1:] != family[:-1]]))  # the families of each list
        top, least, most, far = np.maximum.reduceat(rank, group), np.minimum.reduceat(n, group), np.maximum.reduceat(n, group), np.maximum.reduceat(reach, group)
        list_of = np.cumsum(new_list) - 1
        first_group = np.searchsorted(list_of[group], np.arange(list_of[-1] + 2))
        counts = np.diff(first_group)[list_of]
        upto = np.concatenate([[0], np.cumsum(counts)])
        out: list[np.ndarray] = []
        names, who = np.unique(node, return_inverse=True)
        homes, home = np.unique(family, return_inverse=True)
        at = 0
        while at < len(key):
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + ROWS_AT_ONCE, side="right")) - 1)
            i = np.repeat(np.arange(at, stop), counts[at:stop])
            g = first_group[list_of[i]] + np.arange(len(i)) - np.repeat(upto[at:stop] - upto[at], counts[at:stop])
            fits = (top[g] > rank[i]) & (n[i] * 100 >= least[g] * PERCENT) & (most[g] * 100 >= n[i] * PERCENT) & (np.minimum(reach[i], far[g]) * (100 + PERCENT) >= (n[i] + least[g]) * PERCENT)
            out = [np.unique(np.concatenate([*out, who[i[fits]] * np.int64(len(homes)) + home[group[g[fits]]]]))]
            at = stop
        return pa.table([names[out[0] // len(homes)], homes[out[0] % len(homes)]], schema=fields)

    named = lists.select("key", "node", "n", "reach").join(grouped.drop("n"), "node")
    return _with_part(named, ranges).groupBy("part").applyInArrow(trimmed(ask), "node bigint, family bigint").distinct()


def answers(asked: DataFrame, grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of each asking node to the families it asks, at least one for each component that it links with.

    A family is cut into blocks of about ``BLOCK_NODES`` members, those who ask it likewise; a unit is one block of
    each, so that no task holds a whole family. A unit counts shared tokens on an inverted index of its members.
    """
    n_members = grouped.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).alias("blocks"))
    sides = checkpointed(asked.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).alias("turns")).join(n_members, "family"))
    nth = lambda node, among: F.pmod(F.xxhash64(node), F.col(among))
    every = lambda among: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(among) - 1))
    asking = asked.join(sides, "family").withColumn("turn", nth("node", "turns")).withColumn("block", every("blocks")).join(grouped.select("node", "n", "component"), "node")
    members = grouped.join(sides, "family").withColumn("block", nth("node", "blocks")).withColumn("turn", every("turns"))
    row = ["family", "block", "turn", "node", "n", "component"]
    rows = checkpointed(asking.select(*row, F.lit(True).alias("asks")).unionByName(members.select(*row, F.lit(False).alias("asks"))).withColumn("unit", F.xxhash64("family", "block", "turn")).drop("family", "block", "turn"))
    tasks = 1 + (rows.agg(F.sum("n")).first()[0] or 0) // TOKENS_A_TASK
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def count(found: pa.Table) -> pa.Table:
        found = found.sort_by([("unit", "ascending"), ("asks", "ascending"), ("node", "ascending")])
        unit, node, component, asks = (found[c].to_numpy() for c in ("unit", "node", "component", "asks"))
        tokens = found["tokens"].combine_chunks()
        values, bounds = tokens.values.to_numpy(), tokens.offsets.to_numpy()
        a: list[int] = []
        b: list[int] = []
        start = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])) if len(unit) else np.empty(0, np.int64)
        for first, end in zip(start, np.append(start[1:], len(unit))):
            middle = first + int((~asks[first:end]).sum())
            if middle == first or middle == end:
                continue
            sizes = np.diff(bounds[first : middle + 1]).astype(np.int64)
            pool = values[bounds[first] : bounds[middle]]
            order = np.argsort(pool, kind="stable")
            pool, owner = pool[order], np.repeat(np.arange(middle - first), sizes)[order]
            for x in range(middle, end):
                mine = values[bounds[x] : bounds[x + 1]]
                low, high = np.searchsorted(pool, mine, "left"), np.searchsorted(pool, mine, "right")
                times = high - low
                at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
                common = np.bincount(owner[at], minlength=middle - first)
                linked = np.flatnonzero((common * (100 + PERCENT) >= (len(mine) + sizes) * PERCENT) & (component[first:middle] != component[x]))
                if len(linked):
                    _, one = np.unique(component[first:middle][linked], return_index=True)
                    a += [node[x]] * len(one)
                    b += node[first + linked[one]].tolist()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=fields)

    dealt = rows.join(sets.dropDuplicates(["node"]), "node").withColumn("part", F.pmod(F.col("unit"), F.lit(int(tasks))))
    return dealt.select("part", "unit", "node", "component", "asks", "tokens").groupBy("part").applyInArrow(trimmed(count), "a bigint, b bigint")


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets reach the threshold: two joins, which Spark may spill and split as it needs."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("tokens").alias(f"of_{side}")).dropDuplicates([side])
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(_allowed(F.size("of_a"), F.size("of_b"), common)).select("a", "b")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), by alternating stars.

    Every round replaces edges by edges to smaller neighbours until all lead to the smallest; rounds grow with the
    logarithm of the longest path. Minima are grouped aggregates, so a node's neighbours never meet in one row.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_shingles, node) of every row, and (node, component) of every node."""
    session = docs.sparkSession
    signed = checkpointed(signatures(docs))
    own = signed.where("part is null").drop("part", "counts")
    ranges = ranges_for(own.agg(F.sum("n_shingles")).first()[0] or 0, TOKENS_A_RANGE)
    levels = class_levels(signed)
    nodes = checkpointed(own.where("node is not null").groupBy("node").agg(F.min("text_key").alias("text_key")))
    every, drop_every = written(index_lists(docs, levels, ranges))
    released(session)
    keys = lambda lists: lists.select("node").distinct().join(nodes, "node").select("text_key")
    reach = reaches(docs, keys(every), levels, ranges)
    lists, drop_lists = written(every.join(reach, "node").where(F.col("reach") * 100 >= F.col("n") * PERCENT))
    drop_every()
    released(session)
    ranges = ranges_for(lists.count(), ENTRIES_A_RANGE)
    sets, drop_sets = written(token_sets(docs, keys(lists)))
    stars = checkpointed(star_pairs(lists, ranges))
    first = connected_components(verified(sets, stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    grouped = checkpointed(families(lists, first, stars))
    asked = checkpointed(questions(lists, grouped, ranges))
    drop_lists()
    released(session)
    # Components go on as edges to their smallest node, with the links between them.
    last = connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(answers(asked, grouped, sets)))
    drop_sets()
    released(session)
    return own, nodes.join(last, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Documents link when their sets' Jaccard similarity is at least 0.75; component_id is the smallest doc_id that
    links lead to. Null, empty and wordless texts have no shingles and are their own component. Rows of a null doc_id
    link like any others, but a null is never the smallest; if all of a component are null, so is its id. Repeated rows
    share a component; an empty table gives an empty result; other columns are ignored.
    """
    own, components = _components(docs.select("doc_id", "text"))
    smallest = own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(components, "node")
    named = smallest.join(smallest.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    return own.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id (nulls last, then by a hash of the text).

    Documents without shingles link with nothing: they stay, repeated rows once. Rows that agree in doc_id and text
    are repeated rows, whatever their other columns hold. Columns stay as they are.
    """
    own, components = _components(docs.select("doc_id", "text"))
    rows = own.groupBy("node", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"))
    first = rows.join(components, "node").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "times")).alias("row"))
    keep = first.select("row.doc_id", "row.text_key", "row.times").unionByName(rows.where("node is null").select("doc_id", "text_key", "times"))
    keep = checkpointed(keep.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), (F.col("times") > 1).alias("_again")))
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
    chosen = keyed.join(keep, keyed["_doc"].eqNullSafe(keep["_id"]) & (keyed["_text"] == keep["_key"]))
    # Only repeated rows, few or many, need another shuffle.
    once = chosen.where("not _again").select("_row")
    again = chosen.where("_again").dropDuplicates(["_doc", "_text"]).select("_row")
    return once.unionByName(again).select("_row.*")


#: The same rows in SQL, for tables small enough to compare all pairs that share a shingle.
COMPONENTS_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
