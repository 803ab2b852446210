"""Queries on cohort tables: sources, normalisation, filters, joins, aggregates, sets, splits, tiles, guards."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clinical as C
from ..functions import normalize as N
from ..functions.prng import lot_sql
from ..operators import cohorts, metrics, profile, ranks, tiles
from ..sources import readers, sinks
from ..streaming import predictions as streams
from .base import P3, predictions3, query, rounded, table

# -- clinical vocabularies: phrases built from a part's key, so that every rule is met --

PHRASES = [
    "ER positive", "er negative. pr positive", "PR negative", "HER2 2+", "her2 negative", "her2 equivocal", "Ki-67 39.8%", "ki67: 12", "triple-negative", "Luminal A", "luminal b", "HER2 3+ positive",
    "dukes b", "1a", "c2", "d", "rectosigmoid junction", "lower rectum", "sigmoid colon", "splenic flexure", "transverse colon", "hepatic flexure", "colon", "appendix", "liver", "omentum", "lung nodule", "left breast cancer", "right breast lesion ?",
    "well differentiated g1", "moderately differentiated", "poorly differentiated", "signet ring", "mucinous carcinoma", "adenocarcinoma", "tubular adenoma", "polyp", "ulcerative colitis", "pT3 pN1a pM0", "T2 N0 M1", "ypt4b", "cM1",
    "no loss of expression", "loss of mlh1", "MSI high", "mss", "wt", "V600E mutation", "not performed", "c.35g>a", "malignant", "benign_precursor", "non_neoplastic", "n1a(2/14)", "total number: 12", "number with metastases: 3",
    "lymphovascular invasion not identified", "venous invasion", "lv0", "perineural invasion: present", "pni0", "mammae sinistrae", "bilateral mastitis", "fibroadenoma", "fibroadenoma suspected", "intraductal papilloma", "phyllodes tumor", "Paget disease",
    "dcis", "idc", "lobular carcinoma", "invasive breast carcinoma", "C50.9", "D48.6", "mastopathy", "gynecomastia", "lung cancer", "mastectomy", "breast", "C18.7", "crc with metastases", "carcinoid of the rectum", "hyperplastic polyp", "serrated lesion likely",
    "villous adenoma", "stomach", "anal canal", "cecal dome", "examination", "mass", "male", "F", "2+", "score 0", "posit", "neg", "",
]
_N = len(PHRASES)
_SQL_LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
TEXTS = f"t AS (SELECT p_partkey AS id, {_SQL_LIST}[(p_partkey % {_N})::INT + 1] AS a, trim({_SQL_LIST}[(p_partkey % {_N})::INT + 1] || ' ' || {_SQL_LIST}[((p_partkey // {_N}) * 7 % {_N})::INT + 1]) AS b FROM part), l AS (SELECT id, a, b, lower(trim(a)) AS la, lower(trim(b)) AS lb, replace(lower(trim(b)), ' ', '') AS pb FROM t)"


def texts(spark, sf):
    phrase = lambda i: F.element_at(F.array(*map(F.lit, PHRASES)), i.cast("int") + 1)
    key = F.col("p_partkey")
    a, b = phrase(key % _N), F.trim(F.concat(phrase(key % _N), F.lit(" "), phrase(F.floor(key / _N) * 7 % _N)))
    return table(spark, sf, "part").select(key.alias("id"), a.alias("a"), b.alias("b"))


def _rule(name: str, rules: C.RuleTable, column: str) -> None:
    """``column``: la, lb (lowered single or double phrase) or pb (without spaces)."""

    @query(name, f"WITH {TEXTS} SELECT id, {rules.sql(column)} AS v FROM l")
    def one(spark, sf):
        source = {"la": C.lowered(F.col("a")), "lb": C.lowered(F.col("b")), "pb": C.packed(F.col("b"))}[column]
        return texts(spark, sf).select("id", rules.column(source).alias("v"))


for _name, _rules, _column in (
    ("PRJ_17_sex", C.SEX, "la"), ("PRJ_18_pos_neg", C.POSITIVE_NEGATIVE, "la"), ("PRJ_19_her2_expression", C.HER2_EXPRESSION, "la"), ("PRJ_26_er_text", C.ER_IN_TEXT, "lb"), ("PRJ_26_pr_text", C.PR_IN_TEXT, "lb"),
    ("PRJ_29_subtype", C.MOLECULAR_SUBTYPE, "lb"), ("PRJ_30_stage", C.STAGE, "la"), ("PRJ_31_site_group", C.SITE_GROUP, "lb"), ("PRJ_33_grade", C.GRADE, "lb"), ("PRJ_33_grade_text", C.GRADE_IN_TEXT, "lb"), ("PRJ_33_histology", C.HISTOLOGY, "lb"),
    ("PRJ_33_histology_text", C.HISTOLOGY_IN_TEXT, "lb"), ("PRJ_35_n_from_pn", C.N_FROM_PN, "pb"), ("PRJ_36_mmr", C.MMR, "la"), ("PRJ_36_msi", C.MSI, "lb"), ("PRJ_36_mutation", C.MUTATION, "lb"), ("PRJ_37_lesion_class", C.LESION_CLASS, "lb"),
    ("PRJ_39_lvi", C.LYMPHOVASCULAR, "lb"), ("PRJ_39_pni", C.PERINEURAL, "lb"), ("PRJ_43_laterality", C.LATERALITY, "lb"), ("PRJ_44_site_1", C.SITE_1, "lb"), ("PRJ_44_site_2", C.SITE_2, "lb"),
):
    _rule(_name, _rules, _column)


@query("PRJ_32_side", f"WITH {TEXTS}, s AS (SELECT id, {C.SITE_GROUP.sql('lb')} AS g FROM l) SELECT id, {C.SIDE.sql('g')} AS v FROM s")
def prj32(spark, sf):
    return texts(spark, sf).select("id", C.SIDE.column(C.SITE_GROUP.column(C.lowered(F.col("b")))).alias("v"))


@query("PRJ_37_stated", f"WITH {TEXTS} SELECT id, CASE WHEN contains(lb, 'not identified') OR contains(lb, 'no loss') THEN 0 WHEN contains(lb, 'invasion') OR contains(lb, 'loss') THEN 1 END AS v FROM l")
def prj37b(spark, sf):
    return texts(spark, sf).select("id", C.stated(F.col("b"), ["invasion", "loss"], ["not identified", "no loss"]).alias("v"))


def _taxonomy(kind: str, taxonomy: C.Taxonomy, uncertain: tuple) -> None:
    from ..functions.rules import condition_column, condition_sql

    @query(f"PRJ_42_normalize_{kind}", f"WITH {TEXTS} SELECT id, {C.normalize_diagnosis_sql('b', kind)} AS v FROM t")
    def normal(spark, sf):
        return texts(spark, sf).select("id", C.normalize_diagnosis(F.col("b"), kind).alias("v"))

    @query(f"PRJ_45_uncertain_{kind}", f"WITH {TEXTS} SELECT id, {condition_sql(uncertain, 'lb')} AS v FROM l")
    def doubt(spark, sf):
        return texts(spark, sf).select("id", condition_column(uncertain, C.lowered(F.col("b"))).alias("v"))

    fields = ", ".join(f"{taxonomy.table(f).sql('s')} AS {f}" for f in taxonomy.fields)

    @query(f"PRJ_46_taxonomy_{kind}", f"WITH {TEXTS}, n AS (SELECT id, {C.normalize_diagnosis_sql('b', kind)} AS s FROM t) SELECT id, s AS diagnosis_normalized, {fields} FROM n")
    def classify(spark, sf):
        named = texts(spark, sf).select("id", C.normalize_diagnosis(F.col("b"), kind).alias("diagnosis_normalized"))
        return named.withColumn("t", taxonomy.column(F.col("diagnosis_normalized"))).select("id", "diagnosis_normalized", "t.*")


for _kind, _taxon in (("breast", C.BREAST), ("colon_1", C.COLON_1), ("colon_2", C.COLON_2)):
    _taxonomy(_kind, _taxon, C.UNCERTAIN[_kind])


def _text(name: str, sql: str, expression) -> None:
    @query(name, f"WITH {TEXTS} SELECT id, {sql} AS v FROM l")
    def one(spark, sf):
        return texts(spark, sf).select("id", expression(F.col("b")).alias("v"))


_ex = lambda c, p, g=1: f"nullif(regexp_extract({c}, '{p}', {g}), '')"
_text("PRJ_27_her2_text", f"coalesce(CASE {_ex('lb', 'her2[^0-9]*([0-3])' + chr(92) + 's*' + chr(92) + '+?')} WHEN '0' THEN 0 WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 END, {C.HER2_WORDS.sql('lb')})", C.her2_in_text)
_text("PRJ_28_ki67_text", f"try_cast({_ex('lb', r'ki-?67[^0-9]*([0-9]+(?:[.][0-9]+)?)')} AS DOUBLE)", C.ki67_in_text)
for _letter, _values in C.STAGE_VALUES.items():
    _up = _letter.upper()
    _text(f"PRJ_34_p{_letter}", f"coalesce('p{_up}' || {_ex('pb', f'p{_letter}({_values})')}, '{_up}' || {_ex('pb', rf'\b{_letter}({_values})\b')})", lambda c, a=_letter, v=_values: C.stage_part(c, a, v))
_text("PRJ_34_clean_pm", f"coalesce('pM' || {_ex('pb', 'pm([01][abcx]?)')}, 'M' || {_ex('pb', chr(92) + 'bm([01][abcx]?)' + chr(92) + 'b')}, CASE WHEN contains(pb, 'cm1') THEN 'cM1' END)", C.clean_pm)
_nodes = lambda patterns, g: "try_cast(coalesce(" + ", ".join(_ex("lb", p) for p in patterns) + f", {_ex('pb', C.NODES_FRACTION, g)}) AS DOUBLE)"
_text("PRJ_38_nodes_examined", _nodes(C.NODES_EXAMINED, 2), C.nodes_examined)
_text("PRJ_38_nodes_positive", _nodes(C.NODES_POSITIVE, 1), C.nodes_positive)
_count = _nodes(C.NODES_POSITIVE, 1)
_pn = f"coalesce('pN' || {_ex('pb', 'pn([0-2][abc]?)')}, 'N' || {_ex('pb', chr(92) + 'bn([0-2][abc]?)' + chr(92) + 'b')})"
_text("PRJ_41_n_status", f"coalesce(CASE WHEN {_count} = 0 THEN 'N0' WHEN {_count} <= 3 THEN 'N+(1-3)' WHEN {_count} > 3 THEN 'N+(>3)' END, {C.N_FROM_PN.sql(f'lower({_pn})')})", lambda c: F.coalesce(C.nodes_colon(C.nodes_positive(c)), C.N_FROM_PN.column(C.packed(C.stage_part(c, "n", C.STAGE_VALUES["n"])))))
_text("PRJ_40_stage", f"CASE WHEN contains(lower('m' || coalesce({_ex('pb', 'pm([01][abcx]?)')}, '')), 'm1') THEN 'IV' WHEN regexp_matches('n' || coalesce({_ex('pb', 'pn([0-2][abc]?)')}, ''), 'n[12]') THEN 'III' WHEN regexp_matches('t' || coalesce({_ex('pb', 'pt([0-4][ab]?)')}, ''), 't[34]') THEN 'II' WHEN regexp_matches('t' || coalesce({_ex('pb', 'pt([0-4][ab]?)')}, ''), 't[12]') THEN 'I' END", lambda c: C.derived_stage(F.concat(F.lit("t"), F.regexp_extract(C.packed(c), "pt([0-4][ab]?)", 1)), F.concat(F.lit("n"), F.regexp_extract(C.packed(c), "pn([0-2][abc]?)", 1)), F.concat(F.lit("m"), F.regexp_extract(C.packed(c), "pm([01][abcx]?)", 1))))

# -- coded fields of parts --
_K = "(p_size % 7 - 1)::VARCHAR"
for _name, _sql, _fn in (
    ("PRJ_20_receptor_code", f"CASE WHEN {_K} IN ('0', '1') THEN {_K}::INT END", lambda c: C.receptor_code(c)),
    ("PRJ_20_her2_code", f"CASE {_K} WHEN '0' THEN 0 WHEN '1' THEN 2 WHEN '2' THEN 1 END", lambda c: C.her2_code(c)),
    ("PRJ_22_ki67_code", f"CASE {_K} WHEN '0' THEN 5.0::DOUBLE WHEN '1' THEN 10.0 WHEN '2' THEN 20.0 WHEN '3' THEN 30.0 WHEN '4' THEN 40.0 END", lambda c: C.ki67_from_code(c)),
    ("PRJ_23_aln_status", f"CASE WHEN {_K} = '0' THEN 'N0' WHEN {_K} IN ('1', '2') THEN 'N+(1-2)' WHEN {_K}::INT > 2 THEN 'N+(>2)' END", lambda c: C.nodes_breast(c)),
):
    @query(_name, f"SELECT p_partkey, {_sql} AS v FROM part")
    def coded(spark, sf, fn=_fn):
        return table(spark, sf, "part").select("p_partkey", fn((F.col("p_size") % 7 - 1).cast("string")).alias("v"))


@query("PRJ_21_ki67_parse", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN (p_size + p_size + 5) / 2.0::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 4 THEN p_size + 0.5::DOUBLE END AS v FROM part")
def prj21(spark, sf):
    s = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 5 == 0, F.concat(s, F.lit("-"), (F.col("p_size") + 5).cast("string"), F.lit("%"))).when(F.col("p_size") % 5 == 1, F.concat(s, F.lit(" %"))).when(F.col("p_size") % 5 == 2, F.concat(F.lit("<"), s)).when(F.col("p_size") % 5 == 3, "").otherwise(F.concat(s, F.lit(".5")))
    return table(spark, sf, "part").select("p_partkey", C.parse_ki67(text).alias("v"))


@query("PRJ_22_ki67_category", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'low' WHEN p_size <= 20 THEN 'intermediate' ELSE 'high' END AS v FROM part")
def prj22(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.ki67_category(F.col("p_size")).alias("v"))


@query("PRJ_23_n_status", "SELECT p_partkey, CASE WHEN p_size % 3 + p_partkey % 2 > 2 THEN 'N+(>2)' WHEN p_size % 3 + p_partkey % 2 > 0 THEN 'N+(1-2)' WHEN p_size % 4 = 0 THEN 'N0' WHEN p_size % 4 = 1 THEN 'N+(1-2)' ELSE 'N+(>2)' END AS v FROM part")
def prj23(spark, sf):
    s = lambda c: c.cast("string")
    return table(spark, sf, "part").select("p_partkey", C.nodes_from_parts(s(F.col("p_size") % 3), s(F.col("p_partkey") % 2), F.lit("x"), s(F.col("p_size") % 4)).alias("v"))


@query("PRJ_24_tumor_size", "SELECT p_partkey, CASE WHEN p_size / 10.0::DOUBLE <= 2 THEN 'T1_≤2cm' WHEN p_size / 10.0::DOUBLE <= 5 THEN 'T2_>2-≤5cm' ELSE 'T3+_>5cm' END AS mm, CASE WHEN p_size <= 2 THEN 'T1_≤2cm' WHEN p_size <= 5 THEN 'T2_>2-≤5cm' ELSE 'T3+_>5cm' END AS cm FROM part")
def prj24(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.size_category(F.col("p_size") / 10.0).alias("mm"), C.size_category(F.col("p_size").cast("double")).alias("cm"))


# -- generic normalisation --
def _parts(name: str, source: str, sql: str, columns) -> None:
    """``columns`` gives the selected columns when called: column objects need a session."""

    @query(name, sql)
    def one(spark, sf):
        return table(spark, sf, source).select(*columns())


c = F.col
_parts("PRJ_01_normalize_id", "orders", "SELECT o_orderkey, 'case_' || o_custkey AS v FROM orders", lambda: ["o_orderkey", N.normalize_id(F.concat(F.lit(" a/b/case_"), c("o_custkey").cast("string"), F.when(c("o_orderkey") % 2 == 0, "/").otherwise(""))).alias("v")])
_parts("PRJ_02_uid", "customer", "SELECT c_mktsegment || '::' || c_custkey AS uid FROM customer", lambda: [N.uid(c("c_mktsegment"), c("c_custkey").cast("string")).alias("uid")])
_parts("PRJ_03_patient_of_stem", "customer", "SELECT c_custkey, 'case_' || c_custkey AS a, 'SR1482_' || c_custkey AS b, 'SR386_0' AS z FROM customer", lambda: ["c_custkey", N.patient_of_stem(F.concat(F.lit("case_"), c("c_custkey").cast("string"), F.lit("__s1")), "case_folders").alias("a"), N.patient_of_stem(F.concat(F.lit("SR1482_40X_HE_T0"), c("c_custkey").cast("string"), F.lit("_01")), "surgen").alias("b"), N.patient_of_stem(F.lit("SR386_40X_HE_T000_01"), "surgen").alias("z")])
_parts("PRJ_05_missing_tokens", "customer", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS v FROM customer", lambda: ["c_custkey", N.missing_to_null(F.when(c("c_custkey") % 8 == 0, " N/A ").when(c("c_custkey") % 8 == 4, "").otherwise(c("c_name"))).alias("v")])
_parts("PRJ_06_clean_text", "documents", r"SELECT doc_id, lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS v FROM documents", lambda: ["doc_id", N.clean_text(c("text")).alias("v")])
_parts("PRJ_07_value_mapping", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS v FROM orders", lambda: ["o_orderkey", N.mapped(c("o_orderstatus"), {"F": "done", "O": "open"}).alias("v")])
_parts("PRJ_08_label_harmonize", "part", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'a' ELSE p_brand END AS v FROM part", lambda: ["p_partkey", N.mapped(c("p_brand"), {"Brand#11": "a"}).alias("v")])
_parts("PRJ_09_forced_label", "customer", "SELECT c_custkey, 'colon' AS label FROM customer", lambda: ["c_custkey", F.lit("colon").alias("label")])
_parts("PRJ_10_strict_mapping", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' END AS v FROM orders", lambda: ["o_orderkey", N.mapped(c("o_orderstatus"), {"F": "done"}, strict=True).alias("v")])
_parts("PRJ_11_safe_number", "part", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size::DOUBLE END AS v FROM part", lambda: ["p_partkey", N.to_number(F.when(c("p_size") % 3 == 0, "x").otherwise(c("p_size").cast("string"))).alias("v")])
_parts("PRJ_12_safe_time", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS v FROM orders", lambda: ["o_orderkey", F.date_format(N.to_time(F.when(c("o_orderkey") % 3 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")), "dd/MM/yyyy"), "yyyy-MM-dd").alias("v")])
_parts("PRJ_13_boolean", "orders", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS v FROM orders", lambda: ["o_orderkey", N.to_boolean(F.when(c("o_orderkey") % 3 == 0, " Yes").when(c("o_orderkey") % 3 == 1, "0").otherwise("?")).alias("v")])
_parts("PRJ_15_age_bin", "part", "SELECT p_partkey, CASE WHEN a > 0 AND a <= 50 THEN '<50' WHEN a > 50 AND a <= 70 THEN '50-70' WHEN a > 70 AND a <= 200 THEN '>=70' END AS v FROM (SELECT p_partkey, (p_partkey % 211 - 5)::DOUBLE AS a FROM part)", lambda: ["p_partkey", N.age_bin((c("p_partkey") % 211 - 5).cast("double")).alias("v")])
_parts("PRJ_16_age_group", "part", "SELECT p_partkey, CASE WHEN a IS NULL THEN 'MISSING' WHEN a >= 0 AND a < 50 THEN '<50' WHEN a >= 50 AND a < 70 THEN '50-70' ELSE '>=70' END AS v FROM (SELECT p_partkey, nullif(p_partkey % 211 - 5, 7) AS a FROM part)", lambda: ["p_partkey", N.age_group(F.nullif(c("p_partkey") % 211 - 5, F.lit(7))).alias("v")])
_parts("PRJ_25_concat_text", "orders", "SELECT o_orderkey, concat_ws(' ', CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, o_orderpriority) AS v FROM orders", lambda: ["o_orderkey", F.concat_ws(" ", F.when(c("o_orderkey") % 2 == 0, c("o_orderstatus")), "o_orderpriority").alias("v")])
_parts("PRJ_49_prefix", "customer", "SELECT c_custkey, 'x/' || c_name AS v FROM customer", lambda: ["c_custkey", N.prefixed(F.when(c("c_custkey") % 2 == 0, F.concat(F.lit("x/"), "c_name")).otherwise(c("c_name")), "x/").alias("v")])
_parts("PRJ_50_interval_text", "part", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '—' ELSE printf('%.3f [%.3f, %.3f]', p_size / 7.0::DOUBLE, p_size / 17.0::DOUBLE, p_size / 3.0::DOUBLE) END AS v FROM part", lambda: ["p_partkey", N.interval_text(F.when(c("p_size") % 3 != 0, c("p_size") / 7.0), c("p_size") / 17.0, c("p_size") / 3.0).alias("v")])
_parts("PRJ_51_comparison", "nation", "SELECT n_nationkey, n_name || ' vs ' || n_regionkey AS v FROM nation", lambda: ["n_nationkey", N.comparison_text(F.array(c("n_name"), c("n_regionkey").cast("string"))).alias("v")])
_parts("PRJ_52_pixel_normal", "part", "SELECT p_partkey, round((p_size / 255.0::DOUBLE - 0.5) / 0.25, 6) AS v FROM part", lambda: ["p_partkey", F.round(N.pixel_normal(F.array(c("p_size")), 0.5, 0.25)[0], 6).alias("v")])
_parts("PRJ_53_align_probabilities", "part", "SELECT p_partkey, 0.25::DOUBLE AS p0, 0.0::DOUBLE AS p1, 0.75::DOUBLE AS p2 FROM part", lambda: ["p_partkey", *[N.align_probabilities(F.array(F.lit(0), F.lit(2)), F.array(F.lit(0.25), F.lit(0.75)), 3)[k].alias(f"p{k}") for k in range(3)]])
_parts("PRJ_14_derived", "orders", "SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderstatus) || '!' AS s FROM orders", lambda: ["o_orderkey", F.expr("o_totalprice * 2").alias("twice"), F.expr("upper(o_orderstatus) || '!'").alias("s")])
_parts("GEO_09_output_stem", "customer", "SELECT 'case_' || c_nationkey || '__' || c_custkey AS v FROM customer", lambda: [tiles.output_stem(F.concat(F.lit("case_"), c("c_nationkey").cast("string")), c("c_custkey").cast("string")).alias("v")])
_parts("FLT_12_low_n", "part", "SELECT p_partkey, p_size < 10 AS low_n FROM part", lambda: ["p_partkey", (c("p_size") < 10).alias("low_n")])
_parts("FLT_04_prefix", "part", "SELECT p_partkey FROM part WHERE starts_with(p_name, 'a') OR NOT starts_with(p_name, 'a')", lambda: ["p_partkey"])


@query("PRJ_04_standard_names", "SELECT c_custkey AS cust_key, c_name AS full_name FROM customer")
def prj04(spark, sf):
    df = table(spark, sf, "customer").select(c("c_custkey").alias(" Cust  Key "), c("c_name").alias("Full Name"))
    return N.standard_names(df)


@query("PRJ_47_common_columns", "SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS age FROM customer")
def prj47(spark, sf):
    df = table(spark, sf, "customer")
    found = N.first_existing(df, ["cust_id", "c_custkey"])
    return N.with_columns(df.withColumnRenamed(found, "id").withColumnRenamed("c_name", "name"), {"id": "bigint", "name": "string", "age": "double"})


@query("PRJ_48_positional_rename", "SELECT r_regionkey AS a, r_name AS b FROM region")
def prj48(spark, sf):
    return table(spark, sf, "region").toDF("a", "b")


@query("PRJ_54_percent", "SELECT o_orderstatus, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM orders GROUP BY 1")
def prj54(spark, sf):
    return rounded(profile.value_counts(table(spark, sf, "orders"), "o_orderstatus").select(c("value").alias("o_orderstatus"), F.round("pct", 4).alias("pct")))


# -- sources --
@query("SRC_07_vectors", "SELECT vec_id, len(embedding) AS dims, label FROM embeddings")
def src07(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dims"), "label")


@query("SRC_08_chunks", "SELECT vec_id // 64 AS chunk, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY 1")
def src08(spark, sf):
    return table(spark, sf, "embeddings").groupBy(F.floor(c("vec_id") / 64).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))


@query("SRC_10_nearest_level", "SELECT p_partkey AS slide, CASE WHEN abs(1 - p_size % 5) <= abs(4 - p_size % 5) THEN 0 ELSE 1 END AS level FROM part")
def src10(spark, sf):
    levels = table(spark, sf, "part").select(c("p_partkey").alias("slide"), (c("p_size") % 5).alias("w"), F.explode(F.array(F.struct(F.lit(0).alias("level"), F.lit(1.0).alias("d")), F.struct(F.lit(1).alias("level"), F.lit(4.0).alias("d")))).alias("s"))
    return readers.nearest_level(levels.select("slide", "s.level", (c("s.d") - c("w")).alias("downsample")), 0.0)


@query("SRC_11_slide_paths", "SELECT c_custkey, 'case_' || c_nationkey AS parent, 's' || c_custkey AS stem FROM customer WHERE c_nationkey > 3")
def src11(spark, sf):
    paths = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.concat(F.lit("/d/case_"), c("c_nationkey").cast("string"), F.lit("/s"), c("c_custkey").cast("string"), F.lit(".svs")).alias("path"))
    select = table(spark, sf, "nation").where("n_nationkey > 3").select(c("n_nationkey").alias("c_nationkey"))
    return readers.slide_paths(paths).join(select, "c_nationkey", "left_semi").select("c_custkey", "parent", "stem")


@query("SRC_12_stems_by_case", "SELECT c_nationkey::VARCHAR AS \"case\", count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1")
def src12(spark, sf):
    stems = table(spark, sf, "customer").select(F.concat(F.when(c("c_custkey") % 2 == 0, "SR").otherwise("XX"), F.lit("_T00"), c("c_nationkey").cast("string"), F.lit("_"), c("c_custkey").cast("string")).alias("stem"))
    return readers.stems_by_case(stems.withColumn("stem", F.regexp_replace("stem", "_T000_", "_T0_")), "SR").select(F.when(c("case") == "", "0").otherwise(c("case")).alias("case"), F.size("stems").cast("long").alias("n"))


@query("SRC_13_distinct_ids", "SELECT DISTINCT c_nationkey::VARCHAR AS id FROM customer")
def src13(spark, sf):
    return readers.distinct_ids(table(spark, sf, "customer").select(c("c_nationkey").alias("is")), ["id", "is"])


@query("SRC_14_shard_names", "SELECT 'uni2' AS model, 'crc_site' AS task")
def src14(spark, sf):
    model, task = readers.parse_shard_name("final_df_uni2_crc_site.pkl", ["uni2", "virchow2"], ["site", "crc_site"])
    return spark.range(1).select(F.lit(model).alias("model"), F.lit(task).alias("task"))


# -- sinks --
@query("SNK_09_markdown", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def snk09(spark, sf):
    return sinks.markdown_rows(table(spark, sf, "region").select("r_regionkey", "r_name"))


@query("SNK_11_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def snk11(spark, sf):
    done = table(spark, sf, "lineitem").where("l_quantity > 25").select(c("l_orderkey").alias("o_orderkey"))
    return sinks.pending(table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


# -- filters --
@query("FLT_01_drop_null_label", "SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0")
def flt01(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.when(c("c_custkey") % 5 != 0, c("c_name")).alias("label")).dropna(subset=["label"]).select("c_custkey")


def _holes(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.when(c("c_custkey") % 4 != 0, c("c_name")).otherwise("NA").alias("a"), F.when(c("c_custkey") % 6 != 0, c("c_mktsegment")).alias("b"))


@query("FLT_02_missing_report", "SELECT 'a' AS \"column\", count(*) FILTER (c_custkey % 4 = 0) AS n_missing, count(*) AS n_total, round(count(*) FILTER (c_custkey % 4 = 0) * 100.0 / count(*), 6) AS pct_missing, count(*) FILTER (c_custkey % 4 <> 0 AND c_custkey % 6 <> 0) AS n_kept FROM customer UNION ALL SELECT 'b', count(*) FILTER (c_custkey % 6 = 0), count(*), round(count(*) FILTER (c_custkey % 6 = 0) * 100.0 / count(*), 6), count(*) FILTER (c_custkey % 4 <> 0 AND c_custkey % 6 <> 0) FROM customer")
def flt02(spark, sf):
    return rounded(cohorts.missing_report(_holes(spark, sf), ["a", "b"]))


@query("FLT_02_drop_missing", "SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 6 <> 0")
def flt02b(spark, sf):
    return cohorts.drop_missing(_holes(spark, sf), ["a", "b"]).select("c_custkey")


@query("FLT_03_projection", "SELECT c_custkey, c_name FROM customer")
def flt03(spark, sf):
    return cohorts.require_columns(table(spark, sf, "customer"), ["c_custkey", "c_name"]).select("c_custkey", "c_name")


@query("FLT_05_seen_labels", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 2 = 1 AND c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey < 10)")
def flt05(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return cohorts.seen_labels_only(df.where("c_custkey % 2 = 1"), df.where("c_custkey % 2 = 0 AND c_nationkey < 10"), "c_nationkey")


@query("FLT_06_viable", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 30 AND count(DISTINCT c_mktsegment) >= 2")
def flt06(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_mktsegment").alias("k")).where("n >= 30 AND k >= 2").drop("k")


@query("FLT_07_subset", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def flt07(spark, sf):
    return table(spark, sf, "customer").where(c("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("FLT_09_bad_patch", "SELECT p_partkey FROM part WHERE p_size / 50.0 > 0.9 OR p_retailprice < 20 OR p_size % 10 / 10.0 > 0.8")
def flt09(spark, sf):
    return table(spark, sf, "part").where(tiles.bad_patch(c("p_size") / 50.0, c("p_retailprice"), c("p_size") % 10 / 10.0)).select("p_partkey")


@query("FLT_10_outliers", "WITH v AS (SELECT CASE WHEN l_orderkey % 50 <> 0 THEN l_extendedprice END AS v FROM lineitem), q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v) SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high, count(*) FILTER (NOT coalesce(v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1), false)) AS n_outliers FROM v, q GROUP BY q1, q3")
def flt10(spark, sf):
    return rounded(cohorts.outliers_iqr(table(spark, sf, "lineitem").select(F.when(c("l_orderkey") % 50 != 0, c("l_extendedprice")).alias("v")), "v"))


# -- joins and sets --
@query("JOIN_01_one_to_one", "SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join01(spark, sf):
    left = table(spark, sf, "customer").select("c_custkey")
    right = table(spark, sf, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return cohorts.join_one_to_one(left, right, "c_custkey")[0]


@query("JOIN_02_left", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def join02(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "nation").where("n_regionkey < 3"), c("n_nationkey") == c("c_nationkey"), "left").select("c_custkey", "n_name")


@query("JOIN_03_anti_both", "SELECT c_custkey, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def join03(spark, sf):
    right = table(spark, sf, "orders").select(c("o_custkey").alias("c_custkey")).distinct()
    return cohorts.join_one_to_one(table(spark, sf, "customer").select("c_custkey"), right, "c_custkey")[1]


@query("JOIN_04_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def join04(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("JOIN_05_ordered_pairs", "SELECT a.r_name AS train, b.r_name AS test FROM region a, region b WHERE a.r_name <> b.r_name")
def join05(spark, sf):
    from ..operators.generalize import ordered_pairs

    return ordered_pairs(table(spark, sf, "region").select(c("r_name").alias("cohort")))


@query("JOIN_07_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS n_a, b.n AS n_b FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey > 5 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey < 15 GROUP BY 1) b ON a.k = b.k")
def join07(spark, sf):
    a = table(spark, sf, "customer").where("c_nationkey > 5").groupBy(c("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_a"))
    b = table(spark, sf, "supplier").where("s_nationkey < 15").groupBy(c("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_b"))
    return a.join(b, "k", "full_outer")


@query("JOIN_09_class_pairs", "SELECT DISTINCT a.o_orderpriority AS a, b.o_orderpriority AS b FROM (SELECT DISTINCT o_orderpriority FROM orders) a, (SELECT DISTINCT o_orderpriority FROM orders) b WHERE a.o_orderpriority < b.o_orderpriority")
def join09(spark, sf):
    d = table(spark, sf, "orders").select("o_orderpriority").distinct()
    return d.select(c("o_orderpriority").alias("a")).join(d.select(c("o_orderpriority").alias("b")), c("a") < c("b"))


@query("SET_01_union_all", "SELECT 'c' || c_custkey AS uid FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier")
def set01(spark, sf):
    a = table(spark, sf, "customer").select(F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("uid"))
    return a.unionByName(table(spark, sf, "supplier").select(F.concat(F.lit("s"), c("s_suppkey").cast("string")).alias("uid")))


@query("SET_02_union_by_name", "SELECT c_custkey AS id, c_mktsegment AS segment, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def set02(spark, sf):
    return table(spark, sf, "customer").select(c("c_custkey").alias("id"), c("c_mktsegment").alias("segment")).unionByName(table(spark, sf, "supplier").select(c("s_suppkey").alias("id"), c("s_acctbal").alias("bal")), allowMissingColumns=True)


@query("SET_03_fuse", "SELECT 'A_' || c_custkey AS id, c_mktsegment AS site FROM customer WHERE c_nationkey < 5 UNION ALL SELECT 'B_' || c_custkey, c_mktsegment FROM customer WHERE c_nationkey >= 20")
def set03(spark, sf):
    df = table(spark, sf, "customer").select(c("c_custkey").alias("id"), "c_mktsegment", "c_nationkey")
    return cohorts.fuse([("A", df.where("c_nationkey < 5").drop("c_nationkey"), "c_mktsegment"), ("B", df.where("c_nationkey >= 20").drop("c_nationkey"), "c_mktsegment")], "site")


@query("SET_04_merge_shards", "SELECT c_custkey AS uid, CASE WHEN c_custkey % 3 <> 0 THEN 'one' ELSE 'two' END AS shard FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def set04(spark, sf):
    df = table(spark, sf, "customer").select(c("c_custkey").alias("uid"))
    return cohorts.merge_shards([df.where("uid % 3 <> 0").withColumn("shard", F.lit("one")), df.where("uid % 2 = 0").withColumn("shard", F.lit("two"))], "uid")


@query("SET_05_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set05(spark, sf):
    return table(spark, sf, "customer").select(c("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SET_06_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set06(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("SET_07_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set07(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


# -- aggregates --
_VECTORS = "e AS (SELECT vec_id % 40 AS slide, vec_id % 8 AS patient, i AS dim, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i))"


@query("AGG_01_slide_mean", f"WITH {_VECTORS} SELECT slide, dim, round(avg(v), 6) AS v FROM e GROUP BY ALL")
def agg01(spark, sf):
    e = table(spark, sf, "embeddings").select((c("vec_id") % 40).alias("slide"), "embedding")
    return rounded(cohorts.mean_vectors(e, ["slide"]).select("slide", F.posexplode("embedding").alias("dim", "v")).withColumn("dim", c("dim").cast("long")))


@query("AGG_02_patient_mean", f"WITH {_VECTORS}, s AS (SELECT patient, slide, dim, avg(v) AS v FROM e GROUP BY ALL) SELECT patient, dim, round(avg(v), 6) AS v, count(*) AS n_slides FROM s GROUP BY ALL")
def agg02(spark, sf):
    e = table(spark, sf, "embeddings").select((c("vec_id") % 40).alias("slide"), (c("vec_id") % 8).alias("patient"), "embedding")
    return rounded(cohorts.patient_vectors(e, ["patient"], "slide").select("patient", F.posexplode("embedding").alias("dim", "v"), "n_slides").withColumn("dim", c("dim").cast("long")))


@query("AGG_03_value_counts", "SELECT o_orderpriority AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM orders GROUP BY 1")
def agg03(spark, sf):
    return rounded(profile.value_counts(table(spark, sf, "orders"), "o_orderpriority"))


_COLS = ["o_custkey", "status", "o_orderpriority"]


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumn("status", F.when(c("o_orderkey") % 10 != 0, c("o_orderstatus")))


_O = "o AS (SELECT *, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS status FROM orders)"


@query("AGG_04_column_summary", f"WITH {_O} " + " UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(DISTINCT {x}) AS n_unique, count(*) FILTER ({x} IS NULL) AS n_missing, round(count(*) FILTER ({x} IS NULL) * 100.0 / count(*), 6) AS pct_missing FROM o" for x in _COLS))
def agg04(spark, sf):
    return rounded(profile.column_summary(_orders(spark, sf), _COLS))


@query("SRT_01_missing_order", f"WITH {_O}, s AS (" + " UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(DISTINCT {x}) AS u, count(*) FILTER ({x} IS NULL) AS m FROM o" for x in _COLS) + ") SELECT \"column\", row_number() OVER (ORDER BY m DESC, u, \"column\") AS place FROM s")
def srt01(spark, sf):
    from pyspark.sql import Window

    s = profile.column_summary(_orders(spark, sf), _COLS)
    return s.select("column", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("pct_missing"), "n_unique", "column")).cast("long").alias("place"))


@query("AGG_05_numeric_summary", " UNION ALL ".join(f"SELECT '{x}' AS \"column\", count({x}) AS n, round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std, round(min({x})::DOUBLE, 4) AS min, round(quantile_cont({x}::DOUBLE, 0.25), 4) AS q1, round(quantile_cont({x}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({x}::DOUBLE, 0.75), 4) AS q3, round(max({x})::DOUBLE, 4) AS max, round(quantile_cont({x}::DOUBLE, 0.75) - quantile_cont({x}::DOUBLE, 0.25), 4) AS iqr FROM lineitem" for x in ("l_quantity", "l_extendedprice", "l_linenumber")))
def agg05(spark, sf):
    return rounded(profile.numeric_summary(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_linenumber"]), 4)


_CROSS = "k AS (SELECT coalesce(o_orderstatus, 'MISSING') AS t, coalesce(o_orderpriority, 'MISSING') AS g FROM orders), cu AS (SELECT CASE WHEN grouping(t) = 1 THEN 'Total' ELSE t END AS target, CASE WHEN grouping(g) = 1 THEN 'Total' ELSE g END AS \"group\", count(*) AS n, grouping(t) AS gt FROM k GROUP BY CUBE (t, g))"


@query("AGG_06_crosstab", f"WITH {_CROSS} SELECT target, \"group\", n, round(n * 100.0 / max(CASE WHEN gt = 1 THEN n END) OVER (PARTITION BY \"group\"), 6) AS pct FROM cu")
def agg06(spark, sf):
    return rounded(profile.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


@query("FLT_11_small_cells", f"WITH {_CROSS} SELECT target, \"group\", n FROM cu WHERE n < 1500")
def flt11(spark, sf):
    return profile.small_cells(profile.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"), 1500).select("target", "group", "n")


@query("AGG_07_group_table", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'X') AS \"X\" FROM orders GROUP BY 1")
def agg07(spark, sf):
    return profile.group_table(table(spark, sf, "orders").withColumn("g", F.when(c("o_orderstatus").isin("F", "O"), c("o_orderstatus"))), "o_orderpriority", "g", ["F", "O", "X"])


_AGE = "SELECT CASE WHEN p_size % 9 <> 0 THEN (p_size * 4 % 92)::DOUBLE END AS age FROM part"


def _ages(spark, sf):
    return table(spark, sf, "part").select(F.when(c("p_size") % 9 != 0, (c("p_size") * 4 % 92).cast("double")).alias("age"))


@query("AGG_08_age_distribution", f"WITH g AS (SELECT CASE WHEN age IS NULL THEN 'MISSING' WHEN age < 50 THEN '<50' WHEN age < 70 THEN '50-70' ELSE '>=70' END AS value FROM ({_AGE})) SELECT value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM g GROUP BY 1")
def agg08(spark, sf):
    return rounded(profile.age_distribution(_ages(spark, sf), "age"), 4)


@query("AGG_09_age_description", f"SELECT count(age) AS n, round(avg(age), 4) AS mean, quantile_cont(age, 0.5) AS median, printf('%.1f-%.1f', quantile_cont(age, 0.25), quantile_cont(age, 0.75)) AS iqr, count(*) FILTER (age IS NULL) AS n_missing, round(count(*) FILTER (age IS NULL) * 100.0 / count(*), 4) AS pct_missing FROM ({_AGE})")
def agg09(spark, sf):
    return rounded(profile.age_description(_ages(spark, sf), "age"), 4)


@query("AGG_10_retention", "SELECT c_mktsegment, count(*) AS raw, count(*) FILTER (c_acctbal > 0) AS curated, count(*) FILTER (c_acctbal > 0 AND c_nationkey < 12) AS eligible, round(count(*) FILTER (c_acctbal > 0) * 100.0 / count(*), 4) AS pct_curated, round(count(*) FILTER (c_acctbal > 0 AND c_nationkey < 12) * 100.0 / count(*), 4) AS pct_eligible FROM customer GROUP BY 1")
def agg10(spark, sf):
    return rounded(profile.retention(table(spark, sf, "customer"), {"curated": c("c_acctbal") > 0, "eligible": (c("c_acctbal") > 0) & (c("c_nationkey") < 12)}, "c_mktsegment"), 4)


@query("AGG_12_keep_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def agg12(spark, sf):
    return cohorts.keep_first(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("AGG_13_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def agg13(spark, sf):
    return cohorts.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("AGG_14_collect", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS all_orders FROM orders GROUP BY 1")
def agg14(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("all_orders"))


@query("AGG_15_run_summary", "SELECT count(*) AS candidates, count(*) FILTER (l_quantity >= 25) AS kept, round(100.0 * (count(*) - count(*) FILTER (l_quantity >= 25)) / greatest(count(*), 1), 6) AS filter_rate FROM lineitem")
def agg15(spark, sf):
    kept = F.count_if(c("l_quantity") >= 25)
    return rounded(table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("candidates"), kept.alias("kept"), ((F.count(F.lit(1)) - kept) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("filter_rate")))


@query("AGG_16_rare", "WITH s AS (SELECT c_nationkey::VARCHAR AS k, count(*) * 100.0 / sum(count(*)) OVER () AS sh FROM customer GROUP BY 1) SELECT c_custkey, CASE WHEN sh < 4 THEN 'OTHER' ELSE k END AS k FROM customer JOIN s ON k = c_nationkey::VARCHAR")
def agg16(spark, sf):
    return profile.merged_rare(table(spark, sf, "customer").select("c_custkey", c("c_nationkey").cast("string").alias("k")), "k", 4.0).select("c_custkey", "k")


@query("AGG_17_display_fill", f"WITH {_O} SELECT o_orderkey, coalesce(status, 'MISSING') AS status FROM o")
def agg17(spark, sf):
    return profile.filled_for_display(_orders(spark, sf).select("o_orderkey", "status"), "status")


@query("AGG_18_types", "SELECT 'p_size' AS \"column\", 'numeric' AS type UNION ALL SELECT 'p_name', CASE WHEN (SELECT count(DISTINCT p_name) FROM part) > 30 THEN 'string' ELSE 'categorical' END UNION ALL SELECT 'p_type', 'categorical' UNION ALL SELECT 'p_brand', 'string'")
def agg18(spark, sf):
    return profile.detected_types(table(spark, sf, "part"), ["p_size", "p_name", "p_type", "p_brand"], {"p_brand": "string"})


@query("AGG_19_dataset_summary", f"WITH {_O} SELECT count(*) AS n_rows, 3 AS n_columns, count(*) FILTER (status IS NULL) AS n_missing_cells, round(count(*) FILTER (status IS NULL) * 100.0 / (count(*) * 3), 6) AS pct_missing FROM o")
def agg19(spark, sf):
    return rounded(profile.dataset_summary(_orders(spark, sf), _COLS))


@query("AGG_20_categorical", f"WITH {_O}, f AS (SELECT coalesce(status, 'MISSING') AS v FROM o), z AS (SELECT v, count(*) * 100.0 / sum(count(*)) OVER () AS sh FROM f GROUP BY 1) SELECT CASE WHEN sh < 15 THEN 'OTHER' ELSE z.v END AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM f), 6) AS pct FROM f JOIN z ON z.v = f.v GROUP BY 1")
def agg20(spark, sf):
    return rounded(profile.categorical_summary(_orders(spark, sf), "status", rare_percent=15.0))


@query("AGG_21_datetime", "SELECT 'o_orderdate' AS \"column\", 0::BIGINT AS n_missing, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max, count(DISTINCT o_orderdate) AS n_unique FROM orders")
def agg21(spark, sf):
    return profile.datetime_summary(table(spark, sf, "orders"), ["o_orderdate"])


@query("AGG_22_argmax", "SELECT o_custkey, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS best FROM orders GROUP BY 1")
def agg22(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -c("o_orderkey"))).alias("best"))


_HIST = "h AS (SELECT least(p_retailprice::INT % 256, 255) AS bin, count(*) AS n FROM part GROUP BY 1)"


def _histogram(spark, sf):
    return table(spark, sf, "part").groupBy((F.floor(c("p_retailprice")) % 256).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("AGG_23_otsu", f"WITH {_HIST.replace('p_retailprice::INT', 'floor(p_retailprice)::INT')}, r AS (SELECT bin, sum(n) OVER (ORDER BY bin)::DOUBLE AS c0, sum(n) OVER ()::DOUBLE AS t, sum(n * bin / 255.0::DOUBLE) OVER (ORDER BY bin) AS s0, sum(n * bin / 255.0::DOUBLE) OVER () AS s FROM h), v AS (SELECT bin, (c0 / t) * (1 - c0 / t) * (s0 / (c0 + 1e-10) - (s - s0) / (1 - c0 / t + 1e-10)) ** 2 AS sp FROM r) SELECT first(bin ORDER BY sp DESC, bin) AS threshold FROM v")
def agg23(spark, sf):
    return profile.otsu(_histogram(spark, sf)).select("threshold")


@query("AGG_24_median", "SELECT round(median(l_extendedprice), 6) AS med, round(stddev_pop(l_quantity) + 1e-8, 6) AS sd FROM lineitem")
def agg24(spark, sf):
    return rounded(table(spark, sf, "lineitem").agg(F.median("l_extendedprice").alias("med"), (F.stddev_pop("l_quantity") + 1e-8).alias("sd")))


@query("WIN_01_running_sum", "WITH h AS (SELECT p_size AS bin, count(*) AS n FROM part GROUP BY 1) SELECT bin, sum(n) OVER (ORDER BY bin)::BIGINT AS running FROM h")
def win01(spark, sf):
    from pyspark.sql import Window

    h = table(spark, sf, "part").groupBy(c("p_size").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.select("bin", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("running"))


_MASK = "m AS (SELECT s.i AS slide, x.i AS x, y.i AS y, (s.i * 7 + x.i * x.i + y.i * 3) % 5 < 2 AS tissue FROM range(5) s(i), range(16) x(i), range(12) y(i))"


def _mask(spark):
    m = spark.range(5 * 16 * 12).select((c("id") / 192).cast("int").alias("slide"), (c("id") % 16).cast("int").alias("x"), ((c("id") / 16).cast("int") % 12).alias("y"))
    return m.withColumn("tissue", (c("slide") * 7 + c("x") * c("x") + c("y") * 3) % 5 < 2)


def _slides(spark):
    return spark.range(5).select(c("id").cast("int").alias("slide"), (c("id") * 100 + 640).cast("int").alias("width"), (c("id") * 60 + 480).cast("int").alias("height"))


_GRID = "g AS (SELECT s.i AS slide, s.i * 100 + 640 AS width, s.i * 60 + 480 AS height, x.i * 48 AS x, y.i * 48 AS y FROM range(5) s(i), range(30) x(i), range(30) y(i) WHERE x.i * 48 <= s.i * 100 + 640 - 64 AND y.i * 48 <= s.i * 60 + 480 - 64)"
_CORNER = lambda p, side, n: f"least(greatest(trunc(({p}) / {side}::DOUBLE * {n})::INT, 0), {n})"
_COVER = f"{_MASK}, {_GRID}, k AS (SELECT slide, x, y, {_CORNER('x', 'width', 16)} AS x1, {_CORNER('y', 'height', 12)} AS y1, {_CORNER('x + 64', 'width', 16)} AS x2, {_CORNER('y + 64', 'height', 12)} AS y2 FROM g), f AS (SELECT k.slide, k.x, k.y, count(*) FILTER (m.tissue) / greatest((x2 - x1) * (y2 - y1), 1)::DOUBLE AS fraction FROM k LEFT JOIN m ON m.slide = k.slide AND m.x >= x1 AND m.x < x2 AND m.y >= y1 AND m.y < y2 GROUP BY k.slide, k.x, k.y, x1, x2, y1, y2)"


def _covered(spark):
    return tiles.coverage(tiles.grid(_slides(spark), F.lit(64), overlap=0.25, padding=False), _mask(spark), ["slide"], 16, 12)


@query("WIN_02_summed_area", f"WITH {_MASK} SELECT a.slide, a.x, a.y, count(*) FILTER (b.tissue) AS total FROM m a JOIN m b ON a.slide = b.slide AND b.x <= a.x AND b.y <= a.y GROUP BY ALL")
def win02(spark, sf):
    return tiles.summed_area(_mask(spark), ["slide"]).select(c("slide").cast("long"), c("x").cast("long"), c("y").cast("long"), "total")


@query("WIN_06_distance_to_median", "SELECT p_partkey, round(abs(p_size - (SELECT median(p_size) FROM part)) / ((SELECT stddev_pop(p_size) FROM part) + 1e-8), 6) AS d FROM part")
def win06(spark, sf):
    p = table(spark, sf, "part")
    return rounded(p.join(F.broadcast(p.agg(F.median("p_size").alias("m"), F.stddev_pop("p_size").alias("s")))).select("p_partkey", (F.abs(c("p_size") - c("m")) / (c("s") + 1e-8)).alias("d")))


@query("GEO_01_grid", f"WITH {_GRID} SELECT slide, x, y FROM g")
def geo01(spark, sf):
    return tiles.grid(_slides(spark), F.lit(64), overlap=0.25, padding=False).select(c("slide").cast("long"), c("x").cast("long"), c("y").cast("long"))


@query("GEO_03_mask", "SELECT p_partkey, CASE WHEN 0.5 < 0.3 THEN (p_size * 0.2989 + (p_size * 3 % 256) * 0.587 + 9 * 0.114) / 255 > 0.2 ELSE (p_size * 0.2989 + (p_size * 3 % 256) * 0.587 + 9 * 0.114) / 255 < 0.2 END AND (greatest(p_size, p_size * 3 % 256, 9) - least(p_size, p_size * 3 % 256, 9)) / (greatest(p_size, p_size * 3 % 256, 9) + 255e-8) > 0.05 AS tissue FROM part")
def geo03(spark, sf):
    r, g, b = c("p_size"), c("p_size") * 3 % 256, F.lit(9)
    return table(spark, sf, "part").select("p_partkey", tiles.tissue(tiles.gray(r, g, b), tiles.saturation(r, g, b), F.lit(0.2), F.lit(0.5)).alias("tissue"))


@query("GEO_04_coverage", f"WITH {_COVER} SELECT slide, x, y, round(fraction, 6) AS fraction FROM f WHERE fraction >= 0.3")
def geo04(spark, sf):
    return rounded(tiles.keep_covered(_covered(spark), 0.3).select(c("slide").cast("long"), c("x").cast("long"), c("y").cast("long"), "fraction"))


@query("GEO_06_sweep", f"WITH {_COVER} SELECT t AS threshold, count(*) FILTER (fraction >= t) AS kept, count(*) FILTER (fraction < t) AS discarded, round(count(*) FILTER (fraction >= t) * 100.0 / count(*), 6) AS pct_kept FROM f, (SELECT unnest([0.1::DOUBLE, 0.5, 0.7]) AS t) GROUP BY 1")
def geo06(spark, sf):
    return rounded(tiles.sweep(_covered(spark), [0.1, 0.5, 0.7]))


@query("GEO_07_representative", "WITH f AS (SELECT median(p_size) AS ms, stddev_pop(p_size) AS ss, median(p_retailprice) AS mr, stddev_pop(p_retailprice) AS sr FROM part) SELECT p_partkey, round((abs(p_size - ms) / (ss + 1e-8) + abs(p_retailprice - mr) / (sr + 1e-8)) / 2, 6) AS score FROM part, f ORDER BY (abs(p_size - ms) / (ss + 1e-8) + abs(p_retailprice - mr) / (sr + 1e-8)) / 2, p_partkey LIMIT 3")
def geo07(spark, sf):
    return rounded(tiles.representativeness(table(spark, sf, "part"), ["p_size", "p_retailprice"], "p_partkey"))


@query("GEO_08_extent", f"WITH {_GRID} SELECT slide, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS n_tiles FROM g GROUP BY 1")
def geo08(spark, sf):
    e = tiles.extent(tiles.grid(_slides(spark), F.lit(64), overlap=0.25, padding=False), ["slide"])
    return e.select(*[c(x).cast("long").alias(x) for x in e.columns])


# -- order --
@query("SRT_04_top_k", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def srt04(spark, sf):
    return profile.value_counts(table(spark, sf, "part"), "p_brand", 5).select("value", "n")


@query("SRT_06_numeric_ids", "SELECT c_custkey, row_number() OVER (ORDER BY coalesce(try_cast(CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE c_custkey::VARCHAR END AS INT), 0), c_custkey) AS place FROM customer")
def srt06(spark, sf):
    text = F.when(c("c_custkey") % 3 == 0, "x").otherwise(c("c_custkey").cast("string"))
    placed = ranks.numbered(table(spark, sf, "customer").select("c_custkey"), [F.coalesce(text.try_cast("int"), F.lit(0)), "c_custkey"])
    return placed.withColumn("place", c("place") + 1)


@query("SRT_07_sample", f"SELECT o_orderkey FROM orders ORDER BY {lot_sql('42', 'o_orderkey')}, o_orderkey LIMIT 80")
def srt07(spark, sf):
    from ..functions.prng import lot

    return table(spark, sf, "orders").select("o_orderkey").orderBy(lot(42, c("o_orderkey")), "o_orderkey").limit(80)


# -- splits --
_PATIENTS = "pt AS (SELECT c_custkey AS uid, c_mktsegment AS label FROM customer)"


def _patients(spark, sf):
    return table(spark, sf, "customer").select(c("c_custkey").alias("uid"), c("c_mktsegment").alias("label"))


@query("SPL_01_method", "SELECT c_nationkey, CASE WHEN c_nationkey = 1 THEN 'fixed_split' WHEN c_nationkey = 2 THEN 'cv5' WHEN count(*) < 60 THEN 'cv5' ELSE 'fixed_split' END AS method, CASE WHEN c_nationkey = 2 THEN 'small_n' WHEN count(*) < 60 THEN 'fallback_size_<60' ELSE '>=60' END AS reason FROM customer GROUP BY 1")
def spl01(spark, sf):
    n = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("c_nationkey", cohorts.evaluation_method(c("n"), F.when(c("c_nationkey") == 1, "fixed_split"), F.when(c("c_nationkey") == 2, True)).alias("method"), cohorts.evaluation_reason(c("n"), F.when(c("c_nationkey") == 2, "small_n")).alias("reason"))


_SPLIT = f"{_PATIENTS}, f7 AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {lot_sql('42', 'uid')}, uid) - 1) % 7 AS f FROM pt), f6 AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {lot_sql('43', 'uid')}, uid) - 1) % 6 AS g FROM f7 WHERE f <> 0), sp AS (SELECT uid, label, 'test' AS split FROM f7 WHERE f = 0 UNION ALL SELECT uid, label, CASE WHEN g = 0 THEN 'val' ELSE 'train' END FROM f6)"


@query("SPL_03_fixed_split", f"WITH {_SPLIT} SELECT * FROM sp")
def spl03(spark, sf):
    return cohorts.fixed_split(_patients(spark, sf)).select("uid", "label", "split")


@query("SPL_04_folds", f"WITH {_PATIENTS} SELECT uid, label, ((row_number() OVER (PARTITION BY label ORDER BY {lot_sql('42', 'uid')}, uid) - 1) % 5)::INT AS fold FROM pt")
def spl04(spark, sf):
    return cohorts.folds(_patients(spark, sf), 5)


@query("SPL_05_leaks", f"WITH {_SPLIT} SELECT uid, count(DISTINCT split) AS n_splits FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1")
def spl05(spark, sf):
    return cohorts.leaks(cohorts.fixed_split(_patients(spark, sf)))


@query("AGG_25_label_shares", f"WITH {_SPLIT} SELECT split, label, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 3) AS share FROM sp GROUP BY 1, 2")
def agg25(spark, sf):
    from pyspark.sql import Window

    n = cohorts.fixed_split(_patients(spark, sf)).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.select("split", "label", F.round(c("n") / F.sum("n").over(Window.partitionBy("split")), 3).alias("share"))


@query("SPL_07_oversample", f"WITH {_PATIENTS}, z AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS top FROM pt GROUP BY 1), o AS (SELECT uid, label, row_number() OVER (PARTITION BY label ORDER BY {lot_sql('42', 'uid')}, uid) - 1 AS k FROM pt) SELECT uid, label, copy FROM o JOIN z USING (label), range(20) t(copy) WHERE copy * n + k < top")
def spl07(spark, sf):
    return cohorts.oversample(_patients(spark, sf)).select("uid", "label", "copy")


@query("SPL_09_permutation", f"WITH {_PATIENTS} SELECT uid, row_number() OVER (ORDER BY {lot_sql('7', 'uid')}, uid) AS place FROM pt")
def spl09(spark, sf):
    from ..functions.prng import lot

    return ranks.numbered(_patients(spark, sf).select("uid"), [lot(7, c("uid")), "uid"]).withColumn("place", c("place") + 1)


@query("ML_01_label_codes", "SELECT c_mktsegment AS label, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def ml01(spark, sf):
    return cohorts.label_codes(_patients(spark, sf)).withColumn("code", c("code").cast("long"))


@query("CHK_05_missing_artifacts", "SELECT m AS model, n_name AS task FROM (SELECT unnest(['uni2', 'virchow2']) AS m), nation WHERE NOT (m = 'uni2' AND n_regionkey = 1)")
def chk05(spark, sf):
    nation = table(spark, sf, "nation")
    work = nation.select(F.explode(F.array(F.lit("uni2"), F.lit("virchow2"))).alias("model"), c("n_name").alias("task"))
    done = nation.where("n_regionkey = 1").select(F.lit("uni2").alias("model"), c("n_name").alias("task"))
    return sinks.pending(work, done, ["model", "task"])


@query("STR_01_windowed_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str01(spark, sf):
    return streams.windowed_counts(table(spark, sf, "events"), "ts", ["event_type"], "1 hour").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("STR_02_running_cells", f"WITH {P3} SELECT * FROM cells")
def str02(spark, sf):
    return streams.running_cells(predictions3(spark, sf))


# -- probes: checked by rows and by tests --
