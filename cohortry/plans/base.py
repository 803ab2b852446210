"""Registration of queries beside their SQL, and the prediction tables that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Fractions at six decimals: sums of doubles depend on their order in the last bits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def predictions3(spark: SparkSession, sf: str) -> DataFrame:
    """Three classes: orders' status, and scores made by integer arithmetic. Group: priority."""
    o = table(spark, sf, "orders")
    y = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    w = [1 + (F.col("o_orderkey") * (7 + 2 * k) + F.col("o_custkey") * (3 + k)) % 97 + F.when(y == k, 20).otherwise(0) for k in range(3)]
    o = o.select(F.col("o_orderkey").alias("uid"), y.alias("y_true"), F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("cust"), *[w[k].alias(f"w{k}") for k in range(3)])
    top, total = F.greatest("w0", "w1", "w2"), F.col("w0") + F.col("w1") + F.col("w2")
    pred = F.when(F.col("w0") == top, 0).when(F.col("w1") == top, 1).otherwise(2)
    return o.select("uid", "y_true", pred.alias("y_pred"), F.array(*[F.col(f"w{k}") / total for k in range(3)]).alias("proba"), "grp", "cust")


P3 = """
w AS (SELECT o_orderkey AS uid, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y_true, o_orderpriority AS grp, o_custkey AS cust,
  1 + (o_orderkey * 7 + o_custkey * 3) % 97 + CASE WHEN o_orderstatus = 'F' THEN 20 ELSE 0 END AS w0,
  1 + (o_orderkey * 9 + o_custkey * 4) % 97 + CASE WHEN o_orderstatus = 'O' THEN 20 ELSE 0 END AS w1,
  1 + (o_orderkey * 11 + o_custkey * 5) % 97 + CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 20 ELSE 0 END AS w2 FROM orders),
p AS (SELECT uid, y_true, grp, cust, CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END AS y_pred,
  [w0 / (w0 + w1 + w2)::DOUBLE, w1 / (w0 + w1 + w2)::DOUBLE, w2 / (w0 + w1 + w2)::DOUBLE] AS proba FROM w),
cells AS (SELECT y_true, y_pred, count(*) AS n FROM p GROUP BY ALL)"""


def predictions2(spark: SparkSession, sf: str) -> DataFrame:
    """Two classes: quality labels of documents, and a rule on their length. Group: language."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    score = (F.col("n_chars") % 1000) / 1000.0
    return rows.select(F.col("doc_id").alias("uid"), F.col("quality").alias("y_true"), (F.col("n_chars") > 1000).cast("int").alias("y_pred"), F.array(1 - score, score).alias("proba"), F.col("lang").alias("grp"), "source", "n_chars")


P2 = """
p AS (SELECT doc_id AS uid, quality AS y_true, (n_chars > 1000)::INT AS y_pred, (n_chars % 1000) / 1000.0::DOUBLE AS score, lang AS grp, source, n_chars FROM labels JOIN documents USING (doc_id)),
cells AS (SELECT y_true, y_pred, count(*) AS n FROM p GROUP BY ALL)"""


def class_sql(source: str, keys: str = "") -> str:
    """CTEs c(keys, label, support, predicted, tp, total) and m(keys, metrics) over ``source``(keys, y_true, y_pred, n)."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
s AS (SELECT {k}y_true AS label, n AS support, 0 AS predicted, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM {source}
      UNION ALL SELECT {k}y_pred, 0, n, 0 FROM {source}),
c0 AS (SELECT {k}label, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted, sum(tp)::BIGINT AS tp FROM s GROUP BY {k}label),
c AS (SELECT *, predicted - tp AS fp, support - tp AS fn, (sum(support) OVER ({part}))::BIGINT AS total FROM c0),
m AS (SELECT {k}sum(support)::BIGINT AS n, sum(tp) / sum(support)::DOUBLE AS accuracy,
  avg(CASE WHEN support > 0 THEN tp / support::DOUBLE END) AS balanced_accuracy,
  avg(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted)::DOUBLE END) AS f1_macro,
  CASE WHEN count(*) FILTER (support + predicted > 0) >= 2 THEN avg(CASE WHEN support + predicted > 0 THEN coalesce(tp / nullif(support, 0)::DOUBLE, 0) END) END AS tpr,
  CASE WHEN count(*) FILTER (support + predicted > 0) >= 2 THEN avg(CASE WHEN support + predicted > 0 THEN coalesce(fp / nullif(total - support, 0)::DOUBLE, 0) END) END AS fpr,
  count(*) FILTER (support > 0)::INT AS n_supported FROM c {group})"""


def auc_sql(source: str, keys: str) -> str:
    """CTE a(keys, n_pos, n_neg, auc) by average ranks over ``source``(keys, positive, score)."""
    return f"""
r AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS rk FROM {source}),
a AS (SELECT {keys}, count(*) FILTER (positive) AS n_pos, count(*) FILTER (NOT positive) AS n_neg,
  (sum(CASE WHEN positive THEN rk END) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0) / nullif(count(*) FILTER (positive) * count(*) FILTER (NOT positive), 0)::DOUBLE AS auc FROM r GROUP BY {keys})"""


def resample_sql(cells: str, replicates: int, draw: str, offset: int = 0, name: str = "d", bounds: str = "t") -> str:
    """CTE d(b, y_true, y_pred, n): draws with replacement over the cells' cumulative counts."""
    return f"""
{bounds} AS (SELECT *, sum(n) OVER (ORDER BY y_true, y_pred) AS to_i, sum(n) OVER () AS total FROM {cells}),
{name} AS (SELECT b, y_true, y_pred, count(*) AS n FROM (
    SELECT b, {draw.format(b=f'b + {offset}', i='i', n='total')} AS pick FROM range({replicates}) t1(b), (SELECT max(total)::BIGINT AS total FROM {bounds}) t2, range((SELECT max(total)::BIGINT FROM {bounds})) t3(i)) z
  JOIN {bounds} ON pick >= to_i - n AND pick < to_i GROUP BY b, y_true, y_pred)"""
