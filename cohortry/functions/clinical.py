"""Clinical vocabularies as expressions: receptor states, grades, stages, sites and diagnosis taxonomies.

Inputs are text columns; ``lowered`` brings them to the form that rules expect (trimmed, lower case, null as empty).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import RuleTable, Taxonomy


def lowered(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def packed(c: Column) -> Column:
    """Lowered, without spaces: what the stage patterns read."""
    return F.replace(lowered(c), F.lit(" "), F.lit(""))


def _group(c: Column, pattern: str, k: int = 1) -> Column:
    """Group ``k`` of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


# -- Fixed values: the vocabularies, in the order in which they are tried. --
SEX = RuleTable(((("is", "m", "male"), "M"), (("is", "f", "female"), "F")))
POSITIVE_NEGATIVE = RuleTable(((("starts", "pos"), 1), (("starts", "neg"), 0)))
HER2_EXPRESSION = RuleTable(((("is", "0", "0+", "score 0", "1", "1+"), 0), (("is", "2", "2+"), 1), (("is", "3", "3+"), 2)))
MOLECULAR_SUBTYPE = RuleTable(
    (
        (("has", "triple-negative", "triple negative"), "Triple negative"),
        (("has", "luminal a"), "Luminal A"),
        (("has", "luminal b"), "Luminal B"),
        (("and", ("has", "her2"), ("has", "positive", "3+")), "HER2+"),
    )
)
STAGE = RuleTable(
    (
        (("is", ""), None),
        (("starts", "1"), "I"),
        (("starts", "2"), "II"),
        (("starts", "3"), "III"),
        (("starts", "4"), "IV"),
        (("starts", "a"), None),
        (("and", ("has", "dukes"), ("has", "a")), "I"),
        (("and", ("has", "dukes"), ("has", "b")), "II"),
        (("and", ("has", "dukes"), ("has", "c")), "III"),
        (("has", "dukes"), "IV"),  # the word itself holds a d
        (("is", "a", "a1", "a2"), "I"),
        (("is", "b", "b1", "b2"), "II"),
        (("is", "c", "c1", "c2", "c3"), "III"),
        (("is", "d"), "IV"),
    )
)
SITE_GROUP = RuleTable(
    (
        (("is", ""), None),
        (("has", "rectosig"), "rectosigmoid"),
        (("has", "rectum", "rectal"), "rectum"),
        (("has", "sigmoid"), "sigmoid"),
        (("has", "descending", "splenic flexure", "left colon"), "left_colon"),
        (("has", "transverse"), "transverse_colon"),
        (("has", "ascending", "caecum", "cecum", "hepatic flexure", "right colon"), "right_colon"),
        (("has", "colon"), "colon_unspecified"),
        (("has", "appendix"), "appendix"),
        (("has", "liver", "hepatic"), "metastatic_liver"),
        (("has", "peritone", "omentum"), "metastatic_peritoneal"),
        (("has", "lung"), "metastatic_lung"),
    ),
    "other",
)
SIDE = RuleTable(
    (
        (("is", "right_colon", "caecum", "ascending"), "right"),
        (("is", "left_colon", "sigmoid"), "left"),
        (("is", "transverse_colon"), "transverse"),
        (("is", "rectum"), "rectum"),
        (("is", "rectosigmoid"), "rectosigmoid"),
    )
)
GRADE = RuleTable((((("has", "well", "g1"), "G1")), (("has", "mod", "g2"), "G2"), (("has", "poor", "low differentiation", "g3"), "G3")))
GRADE_IN_TEXT = RuleTable(
    (
        (("or", ("like", r"\bg1\b"), ("has", "grade: 1", "1-high grade differentiation")), "G1"),
        (("or", ("like", r"\bg2\b"), ("has", "grade: 2")), "G2"),
        (("or", ("like", r"\bg3\b"), ("has", "grade: 3", "low differentiation")), "G3"),
        (("has", "well differentiated"), "G1"),
        (("has", "moderately differentiated"), "G2"),
        (("has", "poorly differentiated"), "G3"),
    )
)
HISTOLOGY = RuleTable(
    (
        (("is", ""), None),
        (("has", "signet"), "signet_ring"),
        (("has", "mucin"), "mucinous_adenocarcinoma"),
        (("has", "adenocarcinoma", "a/c"), "adenocarcinoma"),
        (("has", "adenoma", "polyp"), "adenoma_or_polyp"),
        (("has", "colitis", "proctitis"), "inflammatory"),
    ),
    "other",
)
HISTOLOGY_IN_TEXT = RuleTable(
    (
        (("has", "signet"), "signet_ring"),
        (("has", "mucinous"), "mucinous_adenocarcinoma"),
        (("has", "adenocarcinoma"), "adenocarcinoma"),
        (("has", "adenoma", "polyp", "serrated"), "adenoma_or_polyp"),
        (("has", "colitis", "proctitis"), "inflammatory"),
    )
)
N_FROM_PN = RuleTable(((("like", r"n0\b"), "N0"), (("has", "n1"), "N+(1-3)"), (("has", "n2"), "N+(>3)")))
MMR = RuleTable(((("has", "no loss"), "pMMR"), (("has", "loss"), "dMMR"), (("is", "0", "0.0"), "pMMR"), (("is", "1", "1.0"), "dMMR")))
MSI = RuleTable(((("has", "msi high", "msi-h"), "MSI-H"), (("has", "no msi", "mss"), "MSS_or_non_MSIH")))
MUTATION = RuleTable(
    (
        (("has", "not performed", "fail"), None),
        (("has", "wt", "no mutation"), "WT"),
        (("has", "v600e"), "V600E"),
        (("or", ("has", "mutation", "m (", "p.("), ("like", r"c\.\d+")), "Mutated"),
    )
)
LESION_CLASS = RuleTable(
    (
        (("is", ""), None),
        (("has", "malignant"), "malignant"),
        (("has", "benign_precursor"), "benign_precursor"),
        (("has", "inflammatory", "non_neoplastic"), "inflammatory_or_non_neoplastic"),
        (("has", "nonspecific_neoplastic"), "other_neoplastic"),
    ),
    "other",
)
_LVI = ("has", "lymphovascular invasion", "venous invasion")
LYMPHOVASCULAR = RuleTable(((("and", _LVI, ("has", "not identified")), 0), (("or", _LVI, ("has", "lvi1", "lv1")), 1), (("has", "lvi0", "lv0"), 0)))
#: "pn1" and "pn0" also are node stages: a text that states one counts as stating perineural invasion too.
PERINEURAL = RuleTable(((("has", "perineural invasion: present", "pni1", "pn1"), 1), (("has", "perineural invasion: not identified", "pni0", "pn0"), 0)))
ER_IN_TEXT = RuleTable(((("like", r"\ber\b[^.]*negative"), 0), (("like", r"\ber\b[^.]*positive"), 1)))
PR_IN_TEXT = RuleTable(((("like", r"\bpr\b[^.]*negative"), 0), (("like", r"\bpr\b[^.]*positive"), 1)))
HER2_WORDS = RuleTable(((("and", ("has", "her2"), ("has", "negative")), 0), (("and", ("has", "her2"), ("has", "undetermined", "equivocal")), 1)))
LATERALITY = RuleTable(
    (
        (("or", ("like", r"\bbilateral\b"), ("has", "right and left", "left and right", "both breasts")), "bilateral"),
        (("and", ("like", r"\bleft\b|\bsinistrae\b"), ("like", r"\bright\b|\bdextrae\b")), "bilateral"),
        (("like", r"\bleft\b|\bsinistrae\b"), "left"),
        (("like", r"\bright\b|\bdextrae\b"), "right"),
    ),
    "unspecified",
)
UNCERTAIN = {
    "breast": ("has", "?", "suspicious", "possible", "query", "suspected", "indeterminate", "cannot exclude", "vs", "differential diagnosis"),
    "colon_1": ("has", "?", "suspicious", "suspicion", "suspected", "possible", "likely", "uncertain"),
    "colon_2": ("has", "?", "suspicious", "suspicion", "suspected", "possible"),
}
SITE_1 = RuleTable(
    (
        (("has", "rectosigmoid"), "rectosigmoid_junction"),
        (("or", ("like", r"\brectal\b|\brectum\b"), ("has", "ampullary", "ampulla")), "rectum"),
        (("or", ("has", "sigmoid colon"), ("like", r"\bsigmoid\b|\bsigma\b")), "sigmoid_colon"),
        (("has", "descending colon"), "descending_colon"),
        (("has", "splenic flexure"), "splenic_flexure"),
        (("has", "transverse colon"), "transverse_colon"),
        (("has", "hepatic flexure"), "hepatic_flexure"),
        (("has", "ascending colon"), "ascending_colon"),
        (("or", ("like", r"\bcecal\b|\bcecum\b"), ("has", "cecal dome", "ileocecal")), "cecum"),
        (("or", ("has", "anal canal", "internal anal sphincter"), ("like", r"\banal\b")), "anal_canal"),
        (("or", ("like", r"\bcolon\b|\bcolonic\b|\bcolorectal\b|\bintestinal\b|\bbowel\b"), ("has", "large intestine")), "colon_unspecified"),
    ),
    "unspecified",
)
SITE_2 = RuleTable(
    (
        (("has", "rectosigmoid"), "rectosigmoid_junction"),
        (("or", ("like", r"\brectal\b|\brectum\b"), ("has", "ampullary", "ampulla")), "rectum"),
        (("or", ("has", "sigmoid colon"), ("like", r"\bsigmoid\b")), "sigmoid_colon"),
        (("has", "descending colon"), "descending_colon"),
        (("has", "transverse colon"), "transverse_colon"),
        (("has", "ascending colon", "right colon"), "ascending_colon"),
        (("or", ("like", r"\bcecal\b|\bcecum\b"), ("has", "cecal dome")), "cecum"),
        (("or", ("has", "anal canal", "anal sphincter"), ("like", r"\banal\b")), "anal_canal"),
        (("like", r"\bcolon\b|\bcolorectal\b|\bcolonic\b|\bintest"), "colon_unspecified"),
    ),
    "unspecified",
)
# Replacements before classification, in order; the second list is of patterns.
REPLACEMENTS = {
    "breast": [("mammae sinistrae", "left breast"), ("mammae dextrae", "right breast"), ("ca ", "cancer "), (" c-r ", " cancer "), (" cr ", " cancer "), ("ibc", "invasive breast cancer"), ("idc", "invasive ductal carcinoma"), ("dcis", "ductal carcinoma in situ")],
    "colon_1": [("c-r", "cancer"), ("cr ", "cancer "), ("crc", "colorectal cancer"), ("ca ", "cancer ")],
    "colon_2": [("c-r", "cancer"), ("cr ", "cancer "), ("crc", "colorectal cancer")],
}
CODES = {
    "breast": [(r"c50(\.\d+)?", "breast cancer"), (r"d24(\.\d+)?", "benign breast neoplasm"), (r"d48\.6", "indeterminate breast neoplasm")],
    "colon_1": [
        (r"c18\.0", "cecal cancer"), (r"c18\.1", "appendiceal cancer"), (r"c18\.2", "ascending colon cancer"), (r"c18\.3", "hepatic flexure colon cancer"), (r"c18\.4", "transverse colon cancer"),
        (r"c18\.5", "splenic flexure colon cancer"), (r"c18\.6", "descending colon cancer"), (r"c18\.7", "sigmoid colon cancer"), (r"c19", "rectosigmoid cancer"), (r"c20", "rectal cancer"),
        (r"d12\.5", "sigmoid colon adenoma"), (r"d ?37\.7", "intestinal neoplasm uncertain"),
    ],
    "colon_2": [],
}
_B, _C1, _C2 = UNCERTAIN["breast"], UNCERTAIN["colon_1"], UNCERTAIN["colon_2"]
_FIELDS = ("taxonomy_group", "taxonomy_subgroup", "taxonomy_status", "taxonomy_rule")
_CANCER_WORDS = ("has", "breast cancer", "breast carcinoma", "carcinoma of the breast", "malignant neoplasm of the breast", "breast malignancy", "malignant breast neoplasm", "malignant mammary tumor", "cancer of the left breast", "cancer of the right breast")
BREAST = Taxonomy(
    _FIELDS,
    (
        (("is", "", "-", "breast", "breast unspecified part", "unspecified breast disease"), ("missing_or_uninformative", "missing_or_blank", "final", "empty_or_uninformative")),
        (("has", "lung cancer", "nsclc", "ovarian neoplasm", "nose deformity"), ("non_breast_or_metadata_noise", "non_breast_entity", "final", "non_breast_entity")),
        (("has", "sectoral resection", "mastectomy", "endoprosthesis", "implant", "morphological verification"), ("non_breast_or_metadata_noise", "procedure_or_anatomic_note", "final", "procedure_note")),
        (("has", "mastitis", "inflammatory"), ("inflammatory_or_reactive", "mastitis_or_inflammatory", "final", "inflammatory")),
        (("has", "gynecomastia"), ("benign", "gynecomastia", "final", "gynecomastia")),
        (("and", ("has", "fibroadenoma"), _B), ("suspicious_or_uncertain", "query_benign_vs_malignant", "review", "fibroadenoma_uncertain")),
        (("has", "fibroadenoma"), ("benign", "fibroadenoma", "final", "fibroadenoma")),
        (("and", ("has", "intraductal papilloma", "papillomatosis", "cystadenopapilloma", "cystoadenopapilloma", "mintz"), ("not", ("has", "papillary carcinoma"))), ("benign", "intraductal_papilloma", "final", "papilloma")),
        (("has", "fibrocystic", "mastopathy", "fibrosclerosis", "dysplasia"), ("benign", "fibrocystic_change_or_mastopathy", "final", "fibrocystic_mastopathy")),
        (("has", "adenosis"), ("benign", "adenosis", "final", "adenosis")),
        (("has", "phyllodes sarcoma", "malignant mixed tumor", "malignant phyllodes"), ("malignant", "malignant_phyllodes_or_mixed", "final", "malignant_phyllodes")),
        (("has", "phyllodes tumor"), ("atypical_or_borderline", "phyllodes_tumor_borderline_unspecified", "review", "phyllodes_unspecified")),
        (("has", "paget"), ("malignant", "paget_disease", "final", "paget")),
        (("has", "carcinoma in situ", "breast in situ carcinoma"), ("malignant", "ductal_carcinoma_in_situ", "final", "dcis")),
        (("has", "invasive ductal carcinoma", "infiltrating ductal carcinoma"), ("malignant", "invasive_ductal_carcinoma", "final", "idc")),
        (("has", "lobular carcinoma"), ("malignant", "lobular_carcinoma", "final", "lobular")),
        (("has", "mucinous carcinoma"), ("malignant", "mucinous_carcinoma", "final", "mucinous")),
        (("has", "papillary carcinoma"), ("malignant", "papillary_carcinoma", "final", "papillary_carcinoma")),
        (("has", "metastasis of breast cancer", "breast cancer metastasis", "metastatic breast cancer", "metastasis of invasive breast cancer", "metastatic to liver", "metastases to the lungs", "metastases to axillary lymph nodes", "secondary bone involvement"), ("malignant", "metastatic_breast_cancer", "final", "metastatic")),
        (("has", "invasive breast cancer", "invasive breast carcinoma", "invasive mammary carcinoma", "invasive carcinoma", "infiltrating carcinoma", "invasive unspecified breast cancer", "invasive unspecified breast carcinoma", "breast invasive carcinoma", "breast invasive malignancy", "invasive malignant neoplasm of the breast"), ("malignant", "invasive_carcinoma_nos", "final", "invasive_carcinoma_nos")),
        (("and", _CANCER_WORDS, _B), ("suspicious_or_uncertain", "suspicious_for_malignancy", "review", "cancer_uncertain")),
        (_CANCER_WORDS, ("malignant", "breast_carcinoma_nos", "final", "breast_cancer_nos")),
        (("has", "indeterminate breast neoplasm", "indeterminate neoplasm", "suspicious malignant neoplasm"), ("atypical_or_borderline", "indeterminate_neoplasm", "review", "indeterminate_neoplasm")),
        (_B, ("suspicious_or_uncertain", "suspicious_for_malignancy", "review", "generic_uncertainty")),
        (("has", "lesion", "mass", "tumor", "formation", "neoplasm", "nodule", "microcalcifications"), ("nonspecific_lesion_or_mass", "breast_mass_or_lesion_nos", "review", "nonspecific_mass_lesion")),
    ),
    ("non_breast_or_metadata_noise", "unmapped_review", "review", "fallback_unmapped"),
)


def _either(condition: tuple, doubt: tuple, subgroup: str, rule: str, doubtful: str | None = None) -> tuple:
    """A precursor lesion that is up for review if the text doubts it."""
    return ((("and", condition, doubt), ("benign_precursor", doubtful or subgroup, "review", rule)), (condition, ("benign_precursor", subgroup, "final", rule)))


COLON_1 = Taxonomy(
    _FIELDS,
    (
        (("is", "", "-", "examination", "observation", "gastrointestinal tract examination", "colorectal disease"), ("missing_or_uninformative", "missing_or_unspecified", "review", "uninformative")),
        (("has", "stomach", "gastric", "gastritis", "esophagitis", "esophageal", "prostate cancer", "cholecystitis", "cholelithiasis", "peritonitis"), ("non_colorectal_or_noise", "other_organ_or_noise", "review", "non_colorectal")),
        (("has", "colitis", "proctitis", "ileitis", "proctosigmoiditis", "typhlitis", "inflammation"), ("inflammatory_or_non_neoplastic", "colitis_or_proctitis", "final", "inflammatory")),
        (("and", ("has", "hyperplasia", "infiltrate"), ("not", ("has", "adenocarcinoma"))), ("inflammatory_or_non_neoplastic", "hyperplasia_or_non_neoplastic_lesion", "review", "hyperplasia")),
        (("and", ("has", "metastatic", "with metastases", "secondary malignant neoplasm of the liver"), ("has", "colon", "rect", "sigmoid", "cecal", "adenocarcinoma", "cancer")), ("malignant", "metastatic_colorectal_cancer", "final", "metastatic_crc")),
        (("and", ("has", "neuroendocrine tumor", "carcinoid", "lymphoma"), ("has", "rect", "colon", "cecal", "anal", "intestinal")), ("malignant", "neuroendocrine_or_carcinoid", "review", "neuroendocrine")),
        (("has", "adenocarcinoma"), ("malignant", "adenocarcinoma", "final", "adenocarcinoma")),
        (("and", ("has", "cancer", "malignant neoplasm", "carcinoma", "blastoma"), ("not", _C1)), ("malignant", "colorectal_carcinoma_nos", "final", "crc_nos")),
        (("and", _C1, ("has", "cancer", "neoplasm", "tumor", "carcinoma")), ("suspicious_or_uncertain", "suspicious_for_malignancy", "review", "suspicious_malignancy")),
        (("has", "tubulovillous adenoma"), ("benign_precursor", "tubulovillous_adenoma", "final", "tubulovillous_adenoma")),
        *_either(("has", "tubular adenoma"), _C1, "tubular_adenoma", "tubular_adenoma", "adenoma"),
        (("has", "villous tumor", "villous adenoma"), ("benign_precursor", "villous_adenoma_or_tumor", "review", "villous_lesion")),
        *_either(("has", "serrated lesion", "serrated adenoma"), _C1, "serrated_lesion_or_adenoma", "serrated"),
        (("has", "hyperplastic polyp"), ("benign_precursor", "hyperplastic_polyp", "final", "hyperplastic_polyp")),
        (("has", "adenoma", "benign neoplasm"), ("benign_precursor", "adenoma", "final", "adenoma")),
        *_either(("and", ("has", "polyp"), ("not", ("has", "cancer"))), _C1, "polyp_nos", "polyp"),
        (("has", "formation", "neoplasm", "tumor", "mass", "lesion", "neoplasia"), ("nonspecific_neoplastic", "epithelial_formation_or_neoplasm", "review", "nonspecific_neoplastic")),
    ),
    ("non_colorectal_or_noise", "unmapped_review", "review", "fallback"),
)
COLON_2 = Taxonomy(
    _FIELDS,
    (
        (("is", "", "-", "examination", "observation"), ("missing_or_uninformative", "missing_or_unspecified", "review", "uninformative")),
        (("has", "stomach", "gastric", "prostate"), ("non_colorectal_or_noise", "other_organ_or_noise", "review", "non_colorectal")),
        (("has", "colitis", "proctitis", "ileitis"), ("inflammatory_or_non_neoplastic", "colitis_or_proctitis", "final", "inflammatory")),
        (("has", "adenocarcinoma"), ("malignant", "adenocarcinoma", "final", "adenocarcinoma")),
        (("and", ("has", "cancer", "malignant neoplasm", "carcinoma"), ("not", _C2)), ("malignant", "colorectal_carcinoma_nos", "final", "crc_nos")),
        (("and", _C2, ("has", "cancer", "tumor", "neoplasm", "cr")), ("suspicious_or_uncertain", "suspicious_for_malignancy", "review", "suspicious_malignancy")),
        (("has", "adenoma", "benign neoplasm"), ("benign_precursor", "adenoma", "final", "adenoma")),
        *_either(("and", ("has", "polyp"), ("not", ("has", "cancer"))), _C2, "polyp_nos", "polyp"),
        (("has", "formation", "neoplasm", "tumor", "mass"), ("nonspecific_neoplastic", "epithelial_formation_or_neoplasm", "review", "nonspecific_neoplastic")),
    ),
    ("non_colorectal_or_noise", "unmapped_review", "review", "fallback"),
)
# -- end of fixed values --


def normalize_diagnosis(c: Column, kind: str) -> Column:
    """Free-text diagnosis to the taxonomies' form: words and codes replaced, other signs to single spaces."""
    out = lowered(c)
    for word, by in REPLACEMENTS[kind]:
        out = F.replace(out, F.lit(word), F.lit(by))
    for pattern, by in CODES[kind]:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9\s?\-]", " "), r"\s+", " "))


def normalize_diagnosis_sql(text: str, kind: str) -> str:
    out = f"lower(trim(coalesce({text}, '')))"
    for word, by in REPLACEMENTS[kind]:
        out = f"replace({out}, '{word}', '{by}')"
    for pattern, by in CODES[kind]:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return rf"trim(regexp_replace(regexp_replace({out}, '[^a-z0-9\s?\-]', ' ', 'g'), '\s+', ' ', 'g'))"


def number(c: Column) -> Column:
    return c.try_cast("double")


def parse_ki67(c: Column) -> Column:
    """Percentages: a sign is dropped, a range is its ends' mean, anything else that is no number is null."""
    text = F.replace(F.trim(c.cast("string")), F.lit("%"), F.lit(""))
    parts = F.transform(F.filter(F.split(text, "-"), lambda p: p != ""), lambda p: p.try_cast("double"))
    mean = F.when(F.exists(parts, lambda p: p.isNull()) | (F.size(parts) == 0), F.lit(None)).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, p: a + p) / F.nullif(F.size(parts), F.lit(0)))
    return F.when(F.contains(text, F.lit("-")), mean).otherwise(text.try_cast("double"))


def ki67_category(p: Column) -> Column:
    return F.when(p < 10, "low").when(p <= 20, "intermediate").when(p.isNotNull(), "high")


def ki67_from_code(c: Column) -> Column:
    code = c.try_cast("int")
    return F.when(code == 0, 5.0).when(code.between(1, 4), code * 10.0)


def receptor_code(c: Column) -> Column:
    code = c.try_cast("int")
    return F.when(code.isin(0, 1), code)


def her2_code(c: Column) -> Column:
    code = c.try_cast("int")
    return F.when(code == 0, 0).when(code == 1, 2).when(code == 2, 1)


def nodes_breast(count: Column) -> Column:
    n = count.try_cast("int")
    return F.when(n == 0, "N0").when(n.between(1, 2), "N+(1-2)").when(n > 2, "N+(>2)")


def nodes_from_parts(macro: Column, micro: Column, itc: Column, code: Column) -> Column:
    """By the sum of positive nodes; where it is 0 or unknown, by the N code."""
    total = sum((F.coalesce(c.try_cast("int"), F.lit(0)) for c in (macro, micro, itc)), F.lit(0))
    n = code.try_cast("int")
    return F.when(total > 2, "N+(>2)").when(total > 0, "N+(1-2)").when(n == 0, "N0").when(n == 1, "N+(1-2)").when(n >= 2, "N+(>2)")


def size_category(cm: Column) -> Column:
    return F.when(cm <= 2, "T1_≤2cm").when(cm <= 5, "T2_>2-≤5cm").when(cm.isNotNull(), "T3+_>5cm")


def her2_in_text(c: Column) -> Column:
    score = _group(lowered(c), r"her2[^0-9]*([0-3])\s*\+?").cast("int")
    return F.coalesce(F.when(score <= 1, 0).when(score == 2, 1).when(score == 3, 2), HER2_WORDS.column(lowered(c)))


def ki67_in_text(c: Column) -> Column:
    return _group(lowered(c), r"ki-?67[^0-9]*([0-9]+(?:\.[0-9]+)?)").try_cast("double")


def stage_part(c: Column, letter: str, values: str) -> Column:
    """pT, pN or pM, else a T, N or M that stands alone; read after spaces are removed."""
    t = packed(c)
    return F.coalesce(F.concat(F.lit("p" + letter.upper()), _group(t, f"p{letter}({values})")), F.concat(F.lit(letter.upper()), _group(t, rf"\b{letter}({values})\b")))


STAGE_VALUES = {"t": "[0-4][ab]?", "n": "[0-2][abc]?", "m": "[01][abcx]?"}


def clean_pm(c: Column) -> Column:
    return F.coalesce(stage_part(c, "m", STAGE_VALUES["m"]), F.when(F.contains(packed(c), F.lit("cm1")), "cM1"))


NODES_EXAMINED = [r"total number:\s*(\d+)", r"number examined:\s*(\d+)", r"(\d+)\s*lymph nodes examined"]
NODES_POSITIVE = [r"number of involved lymph nodes:\s*(\d+)", r"number of affected lymph nodes:\s*(\d+)", r"number with metastases:\s*(\d+)"]
NODES_FRACTION = r"n\d+[ab]?\((\d+)/(\d+)\)"


def nodes_examined(c: Column) -> Column:
    return F.coalesce(*[_group(lowered(c), p) for p in NODES_EXAMINED], _group(packed(c), NODES_FRACTION, 2)).try_cast("double")


def nodes_positive(c: Column) -> Column:
    return F.coalesce(*[_group(lowered(c), p) for p in NODES_POSITIVE], _group(packed(c), NODES_FRACTION, 1)).try_cast("double")


def nodes_colon(positive: Column) -> Column:
    return F.when(positive == 0, "N0").when(positive <= 3, "N+(1-3)").when(positive.isNotNull(), "N+(>3)")


def derived_stage(pt: Column, pn: Column, pm: Column) -> Column:
    t, n, m = lowered(pt), lowered(pn), lowered(pm)
    return F.when(F.contains(m, F.lit("m1")), "IV").when(n.rlike("n[12]"), "III").when(t.rlike("t[34]"), "II").when(t.rlike("t[12]"), "I")


def stated(c: Column, positive: list[str], negative: list[str]) -> Column:
    """0 if a negative term stands in the text, else 1 if a positive one does, else null."""
    return RuleTable(((("has", *negative), 0), (("has", *positive), 1))).column(lowered(c))
