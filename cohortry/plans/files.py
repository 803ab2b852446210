"""Queries that write files to the shared folder and read them back, logs of failing items, user functions, probes.

What they write stays in the session's shared folder: their results are lazy and read it.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import run
from ..functions import user
from ..operators import metrics
from ..sources import readers, sheets, sinks, work
from .base import P3, class_sql, predictions3, query, rounded, table

c = F.col


@query("SRC_01_delimited", "SELECT c_custkey, c_name || '; \"' || c_mktsegment || '\"' AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS nation, c_acctbal AS balance, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM customer")
def src01(spark, sf):
    path = work.new_path(spark, "delimited")
    name = F.concat("c_name", F.lit('; "'), "c_mktsegment", F.lit('"'))
    flag = F.when(c("c_custkey") % 3 == 0, "yes").when(c("c_custkey") % 3 == 1, "no").otherwise("N/A")
    nation = F.when(c("c_custkey") % 4 != 0, c("c_nationkey").cast("string")).otherwise("NA")
    raw = table(spark, sf, "customer").select("c_custkey", name.alias("name"), nation.alias("nation"), F.replace(c("c_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("balance"), flag.alias("flag"))
    sinks.write_csv(raw, path, separator=";")
    schema = T.StructType().add("c_custkey", "long").add("name", "string").add("nation", "integer").add("balance", "double").add("flag", "boolean")
    return readers.read_csv(spark, path, schema, ";", decimal=",", true_values=["yes"], false_values=["no"])


@query("SRC_02_encodings", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name || ' ñé' AS name, e AS encoding FROM nation, (SELECT unnest(['utf-8', 'iso-8859-1', 'utf-8-sig']) AS e)")
def src02(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit(" ñé")).alias("name"))
    out = None
    for encoding in ("utf-8", "iso-8859-1", "utf-8-sig"):
        path = work.new_path(spark, "encoded")
        sinks.write_csv(rows, path, single=True, encoding=encoding.removesuffix("-sig"), mark=encoding.endswith("-sig"))
        part = readers.read_with_fallback(spark, path).withColumn("encoding", F.lit(encoding))
        out = part if out is None else out.unionByName(part)
    return out


_SHEET = "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name || ' <&>' AS name, CASE WHEN s_nationkey % 4 <> 0 THEN s_acctbal END AS balance FROM supplier"


def _workbook(spark, sf, path):
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" <&>")).alias("name"), F.when(c("s_nationkey") % 4 != 0, c("s_acctbal")).alias("balance"))
    sheets.write_sheet(rows, path, "cohort")
    return path


@query("SRC_03_workbook", _SHEET)
def src03(spark, sf):
    return sheets.read_sheet(spark, _workbook(spark, sf, work.new_path(spark, "book") + ".xlsx"), "cohort").withColumn("balance", c("balance").cast("double"))


@query("SNK_02_workbook", f"SELECT count(*) AS n, count(balance) AS n_balance, round(sum(balance), 2) AS total FROM ({_SHEET})")
def snk02(spark, sf):
    rows = sheets.read_sheet(spark, _workbook(spark, sf, work.new_path(spark, "book") + ".xlsx"), 0)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("balance").alias("n_balance"), F.round(F.sum(c("balance").cast("double")), 2).alias("total"))


@query("SRC_04_sniff", "SELECT 'book' AS file, 'excel' AS format UNION ALL SELECT 'lines', 'csv' UNION ALL SELECT 'name.xlsm', 'excel' UNION ALL SELECT 'name.TXT', 'csv'")
def src04(spark, sf):
    folder = work.new_path(spark, "sniffed")
    _workbook(spark, sf, f"{folder}/book")
    work.put_bytes(spark, f"{folder}/lines", b"id,name\n1,PK\n")
    return spark.createDataFrame([(f, readers.sniff(spark, f"{folder}/{f}")) for f in ("book", "lines", "name.xlsm", "name.TXT")], "file string, format string")


@query("SRC_05_json_array", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def src05(spark, sf):
    path = work.new_path(spark, "array")
    rows = table(spark, sf, "nation").agg(F.collect_list(F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("r"))
    rows.select(F.concat(F.lit("[\n"), F.array_join("r", ",\n"), F.lit("\n]"))).coalesce(1).write.text(path)
    return readers.read_json_array(spark, path, T.StructType().add("n_nationkey", "long").add("n_name", "string").add("n_regionkey", "long"))


@query("SRC_06_config", "SELECT n_name AS dataset, 'id' AS id_column, CASE WHEN n_regionkey = 1 THEN 'flat' ELSE 'surgen' END AS layout, 7::BIGINT AS seed FROM nation")
def src06(spark, sf):
    path = work.new_path(spark, "config") + ".yaml"
    layout = F.when(c("n_regionkey") == 1, "flat").otherwise("surgen")
    nations = table(spark, sf, "nation").select(F.format_string("- {name: %s, metadata_csv: m.csv, id_column: id, subfolder_structure: %s}", F.to_json(F.struct("n_name")).substr(F.lit(11), F.length("n_name") + 2), layout).alias("line"))
    lines = [r["line"] for r in nations.collect()]  # 25 nations
    work.put_bytes(spark, path, "\n".join(["task_name: t", "model_name: m", "seed: 7", "datasets:", *lines]).encode())
    config = readers.load_config(spark, path)
    return spark.createDataFrame([(d.name, d.id_column, d.subfolder_structure, config.seed) for d in config.datasets], "dataset string, id_column string, layout string, seed long")


@query("SRC_09_rows_at", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT item_id * 3 FROM benchmark)")
def src09(spark, sf):
    wanted = table(spark, sf, "benchmark").select((c("item_id") * 3).alias("i"))
    return readers.rows_at(table(spark, sf, "embeddings"), "vec_id", wanted).select("vec_id", "label")


@query("SRC_15_first_existing", "SELECT r_name, CASE WHEN r_regionkey % 2 = 0 THEN 'a' ELSE 'b' END AS folder FROM region WHERE r_regionkey < 4 UNION ALL SELECT r_name, NULL FROM region WHERE r_regionkey = 4")
def src15(spark, sf):
    root = work.new_path(spark, "found")
    found = []
    for key, name in sorted((r["r_regionkey"], r["r_name"]) for r in table(spark, sf, "region").collect()):  # 5 regions
        for folder in [f for f in ("a", "b") if key < 4 and (f == "b" or key % 2 == 0)]:
            work.put_bytes(spark, f"{root}/{folder}/{key}.bin", b"x")
        path = work.first_existing(spark, [f"{root}/a", f"{root}/b"], f"{key}.bin")
        found.append((name, path.split("/")[-2] if path else None))
    return spark.createDataFrame(found, "r_name string, folder string")


@query("SNK_01_summary", "SELECT o_orderpriority, count(*)::VARCHAR AS n FROM orders GROUP BY 1")
def snk01(spark, sf):
    path = work.new_path(spark, "summary")
    sinks.write_csv(table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), path, single=True, mark=True)
    return readers.read_csv(spark, path)


@query("SNK_03_json_results", "SELECT o_orderstatus AS status, o_orderpriority AS priority, '{\"n\":' || count(*) || ',\"n_customers\":' || count(DISTINCT o_custkey) || '}' AS value FROM orders GROUP BY 1, 2")
def snk03(spark, sf):
    path = work.new_path(spark, "results")
    groups = table(spark, sf, "orders").groupBy(c("o_orderstatus").alias("status"), c("o_orderpriority").alias("priority"))
    sinks.write_json(groups.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_customers")), path, ["status", "priority"])
    return spark.read.schema("value string, status string, priority string").text(path)


@query("SNK_04_predictions", f"WITH {P3} SELECT uid, y_true, y_pred, round(proba[1], 6) AS p0, round(proba[3], 6) AS p2 FROM p")
def snk04(spark, sf):
    path = work.new_path(spark, "predictions")
    sinks.write_table(predictions3(spark, sf).select("uid", "y_true", "y_pred", "proba"), path, ["y_true"])
    p = spark.read.parquet(path)
    return rounded(p.select("uid", "y_true", "y_pred", c("proba")[0].alias("p0"), c("proba")[2].alias("p2")))


@query("SNK_05_frame", "SELECT vec_id AS uid, label::VARCHAR AS label, len(embedding)::INT AS dims, embedding[1] AS first, embedding[64] AS last FROM embeddings")
def snk05(spark, sf):
    path = work.new_path(spark, "frame")
    sinks.write_table(table(spark, sf, "embeddings").select(c("vec_id").alias("uid"), c("label").cast("string").alias("label"), "embedding"), path)
    return spark.read.parquet(path).select("uid", "label", F.size("embedding").alias("dims"), c("embedding")[0].alias("first"), c("embedding")[63].alias("last"))


@query("SNK_06_appended", "SELECT o_orderkey, o_orderkey % 2 AS batch FROM orders")
def snk06(spark, sf):
    path = work.new_path(spark, "appended")
    orders = table(spark, sf, "orders").select("o_orderkey", (c("o_orderkey") % 2).alias("batch"))
    for batch in (0, 1):
        sinks.write_table(orders.where(c("batch") == batch), path, append=True)
    return spark.read.parquet(path)


@query("SNK_07_whole_or_nothing", "SELECT n_nationkey, false AS left_over FROM nation")
def snk07(spark, sf):
    path = work.new_path(spark, "whole")
    rows = table(spark, sf, "nation").select("n_nationkey")
    broken = rows.select(F.when(c("n_nationkey") == 7, F.raise_error(F.lit("unreadable"))).otherwise(c("n_nationkey")).alias("n_nationkey"))
    failed = False
    try:
        sinks.write_whole(broken, path)
    except Exception as e:  # noqa: BLE001 - the failure is what this query shows
        if "unreadable" not in str(e):
            raise
        failed = True
    left = work.exists(spark, path) or not failed
    sinks.write_whole(rows, path)
    return spark.read.parquet(path).withColumn("left_over", F.lit(left))


@query("SNK_10_work_config", "SELECT n_name AS dataset, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS selected FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def snk10(spark, sf):
    path = work.new_path(spark, "lists")
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), c("n_nationkey") == c("c_nationkey"))
    sinks.write_lists(joined, path, "n_name", "c_custkey")
    text = spark.read.text(path, wholetext=True)
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)^.*?selected:\n- ", ""), r"\n$", "")
    return text.select(F.regexp_extract("value", '^dataset: "([^"]*)"\n', 1).alias("dataset"), F.replace(body, F.lit("\n- "), F.lit(",")).alias("selected"))


@query("CHK_03_written_rows", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def chk03(spark, sf):
    path = work.new_path(spark, "checked")
    orders = table(spark, sf, "orders")
    sinks.write_table(orders.select("o_orderkey", "o_orderstatus"), path)
    sinks.written_as_expected(orders, path, orders.count())
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("CLI_01_runner", f"WITH {P3}, {class_sql('cells')} SELECT t AS task, x AS model, n, round(accuracy, 6) AS accuracy FROM m, (VALUES ('site', 'uni2'), ('site', 'virchow2'), ('side', 'uni2')) c(t, x)")
def cli01(spark, sf):
    given, out = work.new_path(spark, "given"), work.new_path(spark, "results")
    for task, model in (("site", "uni2"), ("site", "virchow2"), ("side", "uni2")):
        sinks.write_table(predictions3(spark, sf).select("uid", "y_true", "y_pred"), f"{given}/{task}/{model}")
    known = run.found(spark, given)
    failures = run.run(spark, given, out, run.chosen(known, True, None, None, []), say=lambda line: None)
    if failures:
        raise ValueError(str(failures))
    done = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(out)
    place = F.split(F.col("_metadata.file_path"), "/")
    return rounded(done.select(F.element_at(place, -3).alias("task"), F.element_at(place, -2).alias("model"), "n", "accuracy"))


def _length_of(name: str) -> str:
    if name.endswith("A"):
        raise OSError(f"cannot read {name}")
    return str(len(name))


@query("CHK_04_failed_log", "SELECT n_name, CASE WHEN n_name NOT LIKE '%A' THEN length(n_name)::VARCHAR END AS result, CASE WHEN n_name LIKE '%A' THEN 'OSError: cannot read ' || n_name END AS error FROM nation")
def chk04(spark, sf):
    return work.processed(table(spark, sf, "nation"), "n_name", _length_of)


@query("UDF_01_user_function", "SELECT p_partkey, reverse(lower(p_type)) AS turned, p_size * 2 + length(p_brand) AS weight FROM part")
def udf01(spark, sf):
    turned = user.elementwise(lambda t: None if t is None else t.lower()[::-1], "string", c("p_type"))
    weight = user.vectorised(lambda size, brand: size * 2 + brand.str.len(), "long", c("p_size"), c("p_brand"))
    return table(spark, sf, "part").select("p_partkey", turned.alias("turned"), weight.alias("weight"))


# -- probes: a class moves its own coordinate by 8, against noise of a tenth; a model that learns anything is right on every held-out row --
def _separable(spark, sf, classes):
    code = c("label") % classes
    moved = [F.when(code == k, 8.0).otherwise(0.0) for k in range(classes)]
    vector = F.concat(F.transform("embedding", lambda x: x.cast("double") / 10), F.array(*moved))
    return table(spark, sf, "embeddings").select(c("vec_id").alias("uid"), F.concat(F.lit("d"), code.cast("string")).alias("label"), vector.alias("embedding"))


def _probed(predictions):
    return rounded(metrics.summary(metrics.per_class(metrics.cells(predictions))).select("n", "accuracy", "balanced_accuracy", "f1_macro"))


_PERFECT = "SELECT count(*) AS n, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS balanced_accuracy, 1.0::DOUBLE AS f1_macro FROM embeddings"


@query("ML_04_linear_probe", _PERFECT)
def ml04(spark, sf):
    from ..operators import probes

    return _probed(probes.cross_validated(_separable(spark, sf, 3), probes.linear_probe(20), 3))


@query("ML_03_mlp_probe", _PERFECT)
def ml03(spark, sf):
    from ..operators import probes

    return _probed(probes.cross_validated(_separable(spark, sf, 2), probes.mlp_probe(66, 2, 256, 500), 5))


@query("CTR_01_centre_effect", f"{_PERFECT} WHERE label % 4 < 3")
def ctr01(spark, sf):
    from ..operators import probes

    df = _separable(spark, sf, 4).withColumnRenamed("label", "dataset")
    return _probed(probes.centre_effect(df, ["d0", "d1", "d2"], probes.linear_probe(20), 3))


@query("UDF_03_own_model", _PERFECT)
def udf03(spark, sf):
    from pyspark.ml.classification import RandomForestClassifier

    from ..operators import probes

    model = RandomForestClassifier(featuresCol="features", labelCol="code", numTrees=20, maxDepth=6, featureSubsetStrategy="all", seed=42)
    return _probed(probes.cross_validated(_separable(spark, sf, 3), model, 3))
