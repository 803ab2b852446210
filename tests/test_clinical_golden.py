"""Inputs and outputs of the clinical rules, written by hand from their definition: the rule tables do not feed their own check here."""

import pytest
from pyspark.sql import functions as F

from cohortry.functions import clinical as C

RULES = {
    "STAGE": [("", None), ("1", "I"), ("2a", "II"), ("3C", "III"), ("4", "IV"), ("A1", None), ("adukes", None), ("b1", "II"), ("B", "II"), ("c3", "III"), ("d", "IV"), ("d1", None), ("dukes", "IV"), ("Dukes A", "I"), ("dukes b", "II"), ("dukes c1", "III"), ("x", None), ("0", None)],
    "SITE_GROUP": [("", None), ("Rectosigmoid junction", "rectosigmoid"), ("lower rectum", "rectum"), ("perirectal", "rectum"), ("sigmoid colon", "sigmoid"), ("descending colon", "left_colon"), ("splenic flexure", "left_colon"), ("left colon", "left_colon"), ("transverse", "transverse_colon"), ("ascending", "right_colon"), ("Caecum", "right_colon"), ("cecum", "right_colon"), ("hepatic flexure", "right_colon"), ("right colon", "right_colon"), ("colon", "colon_unspecified"), ("appendix", "appendix"), ("liver", "metastatic_liver"), ("hepatic", "metastatic_liver"), ("omentum", "metastatic_peritoneal"), ("peritoneum", "metastatic_peritoneal"), ("lung", "metastatic_lung"), ("skin", "other")],
    "SIDE": [("right_colon", "right"), ("caecum", "right"), ("ascending", "right"), ("left_colon", "left"), ("sigmoid", "left"), ("transverse_colon", "transverse"), ("rectum", "rectum"), ("rectosigmoid", "rectosigmoid"), ("appendix", None), ("other", None)],
    "GRADE": [("", None), ("well differentiated", "G1"), ("moderately well", "G1"), ("G1-G2", "G1"), ("moderate", "G2"), ("g2/g3", "G2"), ("poorly", "G3"), ("low differentiation", "G3"), ("high", None)],
    "HISTOLOGY": [("", None), ("signet ring, mucinous", "signet_ring"), ("Mucinous adenocarcinoma", "mucinous_adenocarcinoma"), ("adenocarcinoma in adenoma", "adenocarcinoma"), ("A/C", "adenocarcinoma"), ("tubular adenoma", "adenoma_or_polyp"), ("polyp", "adenoma_or_polyp"), ("ulcerative colitis", "inflammatory"), ("proctitis", "inflammatory"), ("lymphoma", "other")],
    "MMR": [("", None), ("loss of MLH1", "dMMR"), ("No loss", "pMMR"), ("0", "pMMR"), ("0.0", "pMMR"), ("1", "dMMR"), ("1.0", "dMMR"), ("10", None), ("intact", None)],
    "MSI": [("", None), ("MSI high", "MSI-H"), ("msi-h", "MSI-H"), ("no MSI", "MSS_or_non_MSIH"), ("MSS", "MSS_or_non_MSIH"), ("not performed", None), ("msi low", None)],
    "MUTATION": [("", None), ("Not performed", None), ("failed", None), ("WT", "WT"), ("no mutation", "WT"), ("V600E mutation", "V600E"), ("mutation", "Mutated"), ("p.(G12D)", "Mutated"), ("c.35G>A", "Mutated"), ("m (exon 2)", "Mutated"), ("c.G", None), ("unknown", None)],
    "LESION_CLASS": [("", None), ("malignant", "malignant"), ("benign_precursor", "benign_precursor"), ("inflammatory", "inflammatory_or_non_neoplastic"), ("non_neoplastic", "inflammatory_or_non_neoplastic"), ("nonspecific_neoplastic", "other_neoplastic"), ("benign", "other")],
    "SEX": [("M", "M"), ("male", "M"), ("F", "F"), ("Female", "F"), ("fem", None), ("", None)],
    "POSITIVE_NEGATIVE": [("Positive", 1), ("pos", 1), ("neg", 0), ("NEGATIVE", 0), ("not pos", None), ("", None)],
    "N_FROM_PN": [("", None), ("pN0", "N0"), ("n0(i+)", "N0"), ("pn0a", None), ("pN1c", "N+(1-3)"), ("n2b", "N+(>3)"), ("nx", None)],
}


@pytest.mark.parametrize("name", list(RULES))
def test_rules(spark, name):
    table = getattr(C, name)
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(RULES[name])], "i int, t string")
    got = [r["v"] for r in df.select("i", table.column(C.lowered(F.col("t"))).alias("v")).orderBy("i").collect()]
    assert list(zip([t for t, _ in RULES[name]], got)) == RULES[name]


FUNCTIONS = {
    "t": [("pT3 N1", "pT3"), ("ypT4b", "pT4b"), (" T 2 ", "T2"), ("T2N0", None), ("pTis", None), ("", None), (None, None)],
    "n": [("pN1c", "pN1c"), ("pT3 pN2b", "pN2b"), ("N0", "N0"), ("N3", None), ("", None)],
    "m": [("pM1a", "pM1a"), ("M0", "M0"), ("mx", None), ("cM1", "cM1"), ("", None)],
}


@pytest.mark.parametrize("letter", list(FUNCTIONS))
def test_stage_parts(spark, letter):
    part = C.clean_pm if letter == "m" else lambda c: C.stage_part(c, letter, C.STAGE_VALUES[letter])
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(FUNCTIONS[letter])], "i int, t string")
    got = [r["v"] for r in df.select("i", part(F.col("t")).alias("v")).orderBy("i").collect()]
    assert list(zip([t for t, _ in FUNCTIONS[letter]], got)) == FUNCTIONS[letter]


BREAST = [
    ("-", "missing_or_uninformative", "missing_or_blank", "final"),
    ("Breast", "missing_or_uninformative", "missing_or_blank", "final"),
    ("lung cancer", "non_breast_or_metadata_noise", "non_breast_entity", "final"),
    ("state after mastectomy, fibroadenoma", "non_breast_or_metadata_noise", "procedure_or_anatomic_note", "final"),
    ("mastitis", "inflammatory_or_reactive", "mastitis_or_inflammatory", "final"),
    ("gynecomastia", "benign", "gynecomastia", "final"),
    ("fibroadenoma", "benign", "fibroadenoma", "final"),
    ("intraductal papilloma", "benign", "intraductal_papilloma", "final"),
    ("mastopathy", "benign", "fibrocystic_change_or_mastopathy", "final"),
    ("sclerosing adenosis", "benign", "adenosis", "final"),
    ("malignant phyllodes tumor", "malignant", "malignant_phyllodes_or_mixed", "final"),
    ("phyllodes tumor", "atypical_or_borderline", "phyllodes_tumor_borderline_unspecified", "review"),
]


def test_breast_taxonomy(spark):
    df = spark.createDataFrame([(i, row[0]) for i, row in enumerate(BREAST)], "i int, t string")
    named = df.select("i", C.BREAST.column(C.normalize_diagnosis(F.col("t"), "breast")).alias("r")).orderBy("i").collect()
    assert [(BREAST[r["i"]][0], r["r"]["taxonomy_group"], r["r"]["taxonomy_subgroup"], r["r"]["taxonomy_status"]) for r in named] == BREAST


def test_derived_stage(spark):
    rows = [("pT3", "pN1", "pM1a", "IV"), ("pT1", "N2", "M0", "III"), ("pT4", "pN0", None, "II"), ("T2", "N0", "M0", "I"), (None, None, None, None), ("T0", "N0", None, None)]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, t string, n string, m string")
    assert [r["v"] for r in df.select("i", C.derived_stage(F.col("t"), F.col("n"), F.col("m")).alias("v")).orderBy("i").collect()] == [r[3] for r in rows]
