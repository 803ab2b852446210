"""Mix sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Every source is cut into blocks by a seeded hash of the document, so block numbers are already in random order.
A source's target asks for whole passes over its blocks and then for a prefix of them. These visits are the
source's block quota. A binary tree splits the vector of quotas among the output shards: at each node the left
half takes an exact multivariate-hypergeometric draw of half the visits, drawn urn-wise, source after source.
A shard then reads the runs of visits that its leaf owns; runs are disjoint and together they are all visits.
Inside a shard, rows are put in a seeded order of their own.

Only the quota vector (one number per source) is ever in one row, and it counts at most some 2^21 visits: blocks hold
``block_words`` words, more where the corpus would have over ``MOST_BLOCKS`` blocks. Documents meet block plans in a
join on (source, block), whose keys hold one block's words however large the source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, checkpointed, source_key

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
EPOCH_LIMIT = 2.0
BLOCK_WORDS = 1 << 18
MOST_BLOCKS = 1 << 20
SHARDS = 8
FILL_ROUNDS = 6
BROADCAST_ROWS = 100_000
_UNIT = float(1 << 31)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _unit(*key: Column) -> Column:
    """A number in [0, 1) that the key decides."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 31)) / F.lit(_UNIT)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, limit: float = EPOCH_LIMIT) -> DataFrame:
    """(source_key, source_size) to the same with ``target``: shares by cyclic weight, none above ``limit`` sizes.

    The excess of full sources is shared again by weight among the others. Sources in the order of the ratio at
    which they fill (limit * size / weight) fill in that order, so one running sum finds the level of the rest.
    Rows here are sources, not documents.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    everything = Window.partitionBy(F.lit(0))
    ranked = (
        sizes.withColumn("nth", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source_key")) - 1)
        .withColumn("weight", F.element_at(w, (F.col("nth") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * limit)
        .withColumn("budget", F.sum("source_size").over(everything) * share)
        .withColumn("fills_at", F.col("cap") / F.col("weight"))
    )
    before = Window.partitionBy(F.lit(0)).orderBy("fills_at", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # While the sources below a source are full, ``level`` is what a unit of weight would get; the first source
    # that would not fill sets the level of all that follow.
    at = ranked.withColumn("level", level).withColumn("open", F.col("level") < F.col("fills_at"))
    final = F.min(F.when(F.col("open"), F.struct("fills_at", "source_key", "level"))).over(everything)["level"]
    return at.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("cap", F.coalesce(final, F.lit(float("inf"))) * F.col("weight")))).select(
        "source_key", "source_size", "target"
    )


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_key, visits) to (source_key, shard, from_visit, to_visit): an exact split of all visits.

    One row holds the quota vector; each level halves every node. A node's left child gets half of the node's
    visits, drawn without replacement: visit by visit, left with probability (left places left)/(visits left).
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("source_key", F.col("visits").alias("n")))).alias("quota")).select(F.lit(0).alias("node"), "quota")
    levels = shards.bit_length() - 1
    for level in range(levels):
        total = F.aggregate("quota", F.lit(0).cast("long"), lambda a, q: a + q["n"])

        def draw(state: Column, q: Column) -> Column:
            def one(urn: Column, i: Column) -> Column:
                left = (_unit(F.lit(seed), F.lit(level), F.col("node"), q["source_key"], i) * urn["all"]) < urn["places"]
                return F.struct((urn["places"] - left.cast("long")).alias("places"), (urn["all"] - 1).alias("all"))

            urn = F.struct(state["places"].alias("places"), state["all"].alias("all"))
            end = F.when(q["n"] > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(q["n"], F.lit(1).cast("long"))), urn, one)).otherwise(urn)
            return F.struct(
                end["places"].alias("places"),
                end["all"].alias("all"),
                F.concat(state["left"], F.array(F.struct(q["source_key"].alias("source_key"), (state["places"] - end["places"]).alias("n")))).alias("left"),
            )

        empty = F.expr("cast(array() as array<struct<source_key:string,n:bigint>>)")
        start = F.struct(((total + 1) / 2).cast("long").alias("places"), total.alias("all"), empty.alias("left"))
        split = node.withColumn("left", F.aggregate("quota", start, draw)["left"])
        right = F.zip_with("quota", "left", lambda q, d: F.struct(q["source_key"].alias("source_key"), (q["n"] - d["n"]).alias("n")))
        node = split.select(
            F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quota")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quota")))).alias("child")
        ).select("child.node", "child.quota")
    leaves = node.select(F.col("node").cast("int").alias("shard"), F.explode("quota").alias("q")).select("q.source_key", "shard", F.col("q.n").alias("n"))
    upto = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return leaves.withColumn("to_visit", F.sum("n").over(upto)).select("source_key", "shard", (F.col("to_visit") - F.col("n")).alias("from_visit"), "to_visit").where("to_visit > from_visit")


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed table of sources, marked for broadcast if it is no larger than ``BROADCAST_ROWS``; else Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _plan(docs: DataFrame, shards: int, block_words: int, seed: int, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """What the mix takes of each row: doc_id, source_key, text_key, size, source_size, target, block, visits.

    Rows that agree in doc_id, source and text are read alike.
    """
    own = docs.select("doc_id", source_key(F.col("source")).alias("source_key"), F.xxhash64("text").alias("text_key"), n_words(F.col("text")).alias("size"))
    own = checkpointed(own.withColumn("lot", F.xxhash64(F.lit(seed), "doc_id", "text_key")))
    targets = source_targets(own.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, share, limit)
    # Blocks grow with the corpus, so that the tree never draws more than about TOTAL_SHARE times MOST_BLOCKS visits.
    block = F.greatest(F.lit(float(block_words)), F.sum("source_size").over(Window.partitionBy(F.lit(0))) / MOST_BLOCKS)
    sources = targets.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)).cast("long"))
    sources = sources.withColumn("goal", F.round("target").cast("long")).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
    sources = _small(checkpointed(sources.select("source_key", "source_size", "target", "n_blocks", "passes", "rest")))
    every = own.join(sources, "source_key").withColumn("block", F.pmod("lot", F.col("n_blocks")))
    placed = every.where("size > 0")
    blocks = placed.groupBy("source_key", "block").agg(F.sum("size").alias("block_size"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # A hash leaves some block numbers without a document, so visits count the blocks there are.
    blocks = checkpointed(
        blocks.withColumn("left_over", F.col("rest") - F.coalesce(F.sum("block_size").over(before), F.lit(0)))
        .withColumn("nth", F.row_number().over(Window.partitionBy("source_key").orderBy("block")) - 1)
        .withColumn("n_blocks", F.count("block").over(Window.partitionBy("source_key")))
    )
    # In the last, partial pass a block is read whole, in part (the one where the target ends) or not at all.
    read = F.col("passes") + (F.col("left_over") > 0).cast("long")
    quotas = blocks.groupBy("source_key").agg(F.sum(read).alias("visits"))
    runs = splitting_tree(quotas, shards, seed)
    visit = (
        blocks.select("source_key", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("epoch"), (F.col("epoch") * F.col("n_blocks") + F.col("nth")).alias("visit"), "passes", "left_over")
        .where((F.col("epoch") < F.col("passes")) | (F.col("left_over") > 0))
    )
    reads = visit.join(runs, (visit["source_key"] == runs["source_key"]) & (visit["visit"] >= runs["from_visit"]) & (visit["visit"] < runs["to_visit"])).select(visit["source_key"], "block", "epoch", "shard")
    reads = reads.groupBy("source_key", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("reads"))
    plan = blocks.join(reads, ["source_key", "block"], "left").select("source_key", "block", "block_size", "left_over", "reads")
    joined = placed.join(plan, ["source_key", "block"])
    # Only the documents of a source's last block are ordered; it holds one block's words however large the source is.
    last = (F.col("left_over") > 0) & (F.col("left_over") < F.col("block_size"))
    ending = joined.where(last).withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("source_key", "doc_id", "text_key")))
    alike = Window.partitionBy("source_key", "doc_id", "text_key").orderBy("size")
    ending = ending.withColumn("alike", F.row_number().over(alike)).withColumn("more", F.lit(False)).withColumn("words_left", F.col("left_over"))
    # Whole documents are taken in the order of their lot as long as they fit, then of those behind the first that does
    # not the ones that still fit, and so on: what is missing in the end is less than nearly every document left.
    order = Window.partitionBy("source_key").orderBy("lot", "doc_id", "text_key", "alike")
    for _ in range(FILL_ROUNDS):
        # Equal rows stand for one of their total size at the first of them.
        offer = F.when(~F.col("more") & (F.col("alike") == 1) & (F.col("size") * F.col("times") <= F.col("words_left")), F.col("size") * F.col("times")).otherwise(0)
        upto = F.sum("offer").over(order.rowsBetween(Window.unboundedPreceding, 0))
        ending = ending.withColumn("offer", offer).withColumn("now", (F.col("offer") > 0) & (upto <= F.col("words_left")))
        ending = ending.withColumn("words_left", F.col("words_left") - F.sum(F.when(F.col("now"), F.col("offer")).otherwise(0)).over(Window.partitionBy("source_key")))
        ending = ending.withColumn("more", F.col("more") | F.col("now"))
    # The smallest one left goes in if the end is nearer to the target with it.
    whole = F.struct((F.col("size") * F.col("times")).alias("size"), "lot", "doc_id", "text_key")
    least = F.min(F.when(~F.col("more") & (F.col("alike") == 1), whole)).over(Window.partitionBy("source_key"))
    ending = ending.withColumn("least", least).withColumn("more", F.col("more") | (whole.eqNullSafe(F.col("least")) & (F.col("alike") == 1) & (F.col("least.size") < F.col("words_left") * 2)))
    ending = ending.withColumn("more", F.max("more").over(Window.partitionBy("source_key", "doc_id", "text_key"))).drop("times", "alike", "words_left", "offer", "now", "least")
    others = joined.where(~F.coalesce(last, F.lit(False))).withColumn("more", F.col("left_over") > 0)
    none = F.expr("cast(array() as array<struct<epoch:bigint,shard:int,words:bigint>>)")
    visits = F.transform(
        F.filter(F.coalesce("reads", F.expr("cast(array() as array<struct<epoch:bigint,shard:int>>)")), lambda r: (r["epoch"] < F.col("passes")) | F.col("more")),
        lambda r: F.struct(r["epoch"].alias("epoch"), r["shard"].alias("shard"), F.col("size").alias("words")),
    )
    columns = ["doc_id", "source_key", "text_key", "size", "source_size", "target", "block"]
    return others.unionByName(ending).select(*columns, visits.alias("visits")).unionByName(every.where("size = 0").select(*columns, none.alias("visits")))


def mix(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = 11, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, limit: float = EPOCH_LIMIT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): what the mix takes of it.

    Columns: doc_id, size (words; null or wordless text: 0), source_size, target, taken (words, repeats counted),
    visits (array of struct(epoch, shard, words), one per time the mix reads the document: what the tree's runs give).

    A null source is a source like any other and comes last. Sources of size 0 have target 0. Documents are taken
    whole: in the block where a source's target ends, those that fit in, and then the smallest of the rest if that ends
    nearer, so taken words miss the target by half of a small document at most. Rows that agree in doc_id, source and text are taken alike;
    an empty table gives an empty result; other columns are ignored. The same rows and seed give the same result.
    """
    taken = F.aggregate("visits", F.lit(0).cast("long"), lambda a, r: a + r["words"])
    return _plan(docs, shards, block_words, seed, weights, share, limit).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "visits")


def mixed_documents(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = 11, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, limit: float = EPOCH_LIMIT) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a document stands once per visit, shards in local random order.

    Texts are whole; wordless documents are never taken. Rows that agree in doc_id, source and text share one decision,
    and each of them stands once per visit. Columns may have any names.
    """
    plan = _plan(docs, shards, block_words, seed, weights, share, limit).where(F.size("visits") > 0)
    plan = plan.select("doc_id", "source_key", "text_key", "block", "visits").dropDuplicates(["doc_id", "source_key", "text_key"])
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    rows = docs.select(row, docs["doc_id"].alias("id"), source_key(docs["source"]).alias("from"), F.xxhash64(docs["text"]).alias("key"))
    taken = rows.join(plan, rows["id"].eqNullSafe(plan["doc_id"]) & (rows["from"] == plan["source_key"]) & (rows["key"] == plan["text_key"]))
    visits = taken.select("row", "id", "key", "from", "block", F.explode("visits").alias("visit"))
    own = F.xxhash64(F.lit(seed), "id", "key", "visit.epoch")
    return visits.repartition("visit.shard", "from", "block").sortWithinPartitions("visit.shard", own).select("row.*")
