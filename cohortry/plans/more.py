"""Queries for what the other families use inside: orders, shares, ranks, resample indices, scalar coverage, guards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.prng import draw, draw_sql, lot_sql
from ..operators import cohorts, fairness, generalize, metrics, profile, ranks, tiles
from .base import P2, P3, class_sql, predictions2, predictions3, query, rounded, table
from .tables import _COVER, _mask, _slides

c = F.col


@query("FLT_08_coverage", f"WITH {_COVER} SELECT count(*) AS kept FROM f WHERE fraction >= 0.5")
def flt08(spark, sf):
    covered = tiles.coverage(tiles.grid(_slides(spark), F.lit(64), overlap=0.25, padding=False), _mask(spark), ["slide"], 16, 12)
    return tiles.keep_covered(covered, 0.5).agg(F.count(F.lit(1)).alias("kept"))


@query("GEO_05_scalar_coverage", f"WITH {_COVER} SELECT slide, round(max(fraction), 6) AS most, round(min(fraction), 6) AS least FROM f GROUP BY 1")
def geo05(spark, sf):
    covered = tiles.coverage(tiles.grid(_slides(spark), F.lit(64), overlap=0.25, padding=False), _mask(spark), ["slide"], 16, 12)
    return rounded(covered.groupBy(c("slide").cast("long").alias("slide")).agg(F.max("fraction").alias("most"), F.min("fraction").alias("least")))


@query("GEO_02_threshold", "WITH h AS (SELECT p_size * 5 AS bin, count(*) AS n FROM part GROUP BY 1), r AS (SELECT bin, sum(n) OVER (ORDER BY bin)::DOUBLE AS c0, sum(n) OVER ()::DOUBLE AS t, sum(n * bin / 255.0::DOUBLE) OVER (ORDER BY bin) AS s0, sum(n * bin / 255.0::DOUBLE) OVER () AS s FROM h), v AS (SELECT bin, (c0 / t) * (1 - c0 / t) * (s0 / (c0 + 1e-10) - (s - s0) / (1 - c0 / t + 1e-10)) ** 2 AS sp FROM r) SELECT round(first(bin ORDER BY sp DESC, bin) / 255.0::DOUBLE, 6) AS threshold FROM v")
def geo02(spark, sf):
    h = table(spark, sf, "part").groupBy((c("p_size") * 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(profile.otsu(h).select((c("threshold") / 255.0).alias("threshold")))


@query("AGG_11_retention_trace", "SELECT 'raw' AS stage, count(*) AS n FROM orders UNION ALL SELECT 'curated', count(*) FILTER (o_orderstatus <> 'P') FROM orders UNION ALL SELECT 'eligible', count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice > 100000) FROM orders")
def agg11(spark, sf):
    curated, eligible = c("o_orderstatus") != "P", c("o_totalprice") > 100000
    one = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("raw"), F.count_if(curated).alias("curated"), F.count_if(curated & eligible).alias("eligible"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), c(s).alias("n")) for s in one.columns])).alias("r")).select("r.*")


@query("AGG_26_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg26(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("WIN_03_share", "SELECT p_brand, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1")
def win03(spark, sf):
    return rounded(profile.value_counts(table(spark, sf, "part"), "p_brand").select(c("value").alias("p_brand"), (c("pct") / 100).alias("share")))


@query("WIN_04_average_ranks", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS rk FROM part")
def win04(spark, sf):
    by = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, sf, "part").select("p_partkey", (F.rank().over(by) + (F.count(F.lit(1)).over(Window.partitionBy("p_brand", "p_size")) - 1) / 2.0).alias("rk"))


@query("WIN_05_round_robin", "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 AS fold FROM orders")
def win05(spark, sf):
    placed = ranks.numbered(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], ["o_orderstatus"])
    return placed.select("o_orderkey", (c("place") % 5).alias("fold"))


@query("SRT_02_group_order", "SELECT g, row_number() OVER (ORDER BY g) AS place FROM (SELECT unnest(['>=70', '<50', '50-70']) AS g)")
def srt02(spark, sf):
    g = spark.createDataFrame([(">=70",), ("<50",), ("50-70",)], "g string")
    return g.select("g", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("g")).cast("long").alias("place"))


@query("SRT_03_confused_pairs", f"WITH {P3} SELECT y_true, y_pred, n, row_number() OVER (ORDER BY n DESC, y_true, y_pred) AS place FROM cells WHERE y_true <> y_pred")
def srt03(spark, sf):
    cells = metrics.cells(predictions3(spark, sf)).where("y_true <> y_pred")
    return cells.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "y_true", "y_pred")).cast("long"))


@query("SRT_05_nearest", "SELECT p_partkey FROM part ORDER BY abs(p_size - 25), p_partkey LIMIT 3")
def srt05(spark, sf):
    return table(spark, sf, "part").orderBy(F.abs(c("p_size") - 25), "p_partkey").select("p_partkey").limit(3)


@query("SPL_02_reason", "SELECT c_nationkey, CASE WHEN count(*) < 60 THEN 'fallback_size_<60' ELSE '>=60' END AS reason FROM customer GROUP BY 1")
def spl02(spark, sf):
    n = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("c_nationkey", cohorts.evaluation_reason(c("n"), F.lit(None).cast("string")).alias("reason"))


@query("SPL_06_out_of_fold", f"SELECT c_custkey AS uid, 1::BIGINT AS n, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY {lot_sql('42', 'c_custkey')}, c_custkey) - 1) % 5)::INT AS fold FROM customer")
def spl06(spark, sf):
    rows = cohorts.folds(table(spark, sf, "customer").select(c("c_custkey").alias("uid"), c("c_mktsegment").alias("label")), 5)
    parts = [rows.where(c("fold") == k) for k in range(5)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.max("fold").alias("fold"))


@query("SPL_08_resample_indices", f"SELECT b, i, {draw_sql('b', 'i', '1058')} AS idx FROM range(20) t(b), range(1058) q(i)")
def spl08(spark, sf):
    grid = spark.range(20).select(c("id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1057).cast("long"))).alias("i"))
    return grid.select("b", "i", draw(c("b"), c("i"), F.lit(1058)).alias("idx"))


@query("OOD_01_held_out_cohort", f"WITH {P2}, g AS (SELECT y_true, y_pred, count(*) AS n FROM p WHERE source <> 'src0' AND y_true IN (SELECT y_true FROM p WHERE source = 'src0') GROUP BY ALL), {class_sql('g')} SELECT n, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy FROM m")
def ood01(spark, sf):
    p = predictions2(spark, sf)
    target = cohorts.seen_labels_only(p.where("source <> 'src0'"), p.where("source = 'src0'"), "y_true")
    return rounded(metrics.summary(metrics.per_class(metrics.cells(target))).select("n", "accuracy", "balanced_accuracy"))


@query("CTR_02_experiments", "SELECT 'A' AS experiment, 'AMERICA vs ASIA vs EUROPE' AS comparison UNION ALL SELECT 'B', 'AMERICA vs ASIA' UNION ALL SELECT 'B', 'AMERICA vs EUROPE' UNION ALL SELECT 'B', 'ASIA vs EUROPE'")
def ctr02(spark, sf):
    centres = spark.createDataFrame([("AMERICA",), ("ASIA",), ("EUROPE",)], "cohort string")
    pairs = generalize.ordered_pairs(centres).where("train < test").select(F.lit("B").alias("experiment"), F.array("train", "test").alias("names"))
    whole = centres.agg(F.array_sort(F.collect_list("cohort")).alias("names")).select(F.lit("A").alias("experiment"), "names")
    return whole.union(pairs).select("experiment", F.array_join("names", " vs ").alias("comparison"))


@query("ML_02_stacked_vectors", "SELECT vec_id, round(list_sum(embedding)::DOUBLE, 4) AS total, len(embedding)::INT AS dims FROM embeddings")
def ml02(spark, sf):
    from pyspark.ml.functions import vector_to_array

    from ..operators import probes

    v = probes.stacked(table(spark, sf, "embeddings")).withColumn("a", vector_to_array("features"))
    return rounded(v.select("vec_id", F.aggregate("a", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("a").alias("dims")), 4)


@query("CHK_01_required_columns", "SELECT count(*) AS n FROM customer")
def chk01(spark, sf):
    return cohorts.require_columns(table(spark, sf, "customer"), ["c_custkey", "c_mktsegment"]).agg(F.count(F.lit(1)).alias("n"))


@query("CHK_02_not_empty", "SELECT label AS slide, count(*) > 0 AS readable FROM embeddings GROUP BY 1")
def chk02(spark, sf):
    return table(spark, sf, "embeddings").groupBy(c("label").alias("slide")).agg((F.count("embedding") > 0).alias("readable"))


@query("UDF_02_expression_columns", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS band, length(o_orderpriority) AS width FROM orders")
def udf02(spark, sf):
    from ..functions.normalize import derived

    rules = {"band": "CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END", "width": F.length("o_orderpriority").cast("long")}
    return derived(table(spark, sf, "orders"), rules).select("o_orderkey", "band", "width")


@query("PLT_01_plot_rows", "SELECT o_orderstatus AS category, o_orderpriority AS grp, count(*) AS n FROM orders GROUP BY 1, 2")
def plt01(spark, sf):
    cross = profile.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    return cross.where("target <> 'Total' AND `group` <> 'Total'").select(c("target").alias("category"), c("group").alias("grp"), "n")


@query("FAIR_07_without_small_groups", f"WITH {P3}, g AS (SELECT grp, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL), {class_sql('g', 'grp')} SELECT count(*) AS n_groups, round(max(balanced_accuracy) - min(balanced_accuracy), 6) AS delta_ba FROM m WHERE n >= 10")
def fair07b(spark, sf):
    groups = fairness.by_subgroup(predictions3(spark, sf), "grp", 3)
    return rounded(fairness.gap_summary(groups, F.lit(0.6), exclude_low_n=True).select(c("n_subgroups").alias("n_groups"), "delta_ba"))


