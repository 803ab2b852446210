"""Generic column normalisation: ids, missing tokens, text, casts, labels, bins and display strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens that stand for a missing value.
MISSING_TOKENS = ["MISSING", "missing", "nan", "NaN", "NA", "N/A", "n/a", "Unknown", "unknown", "UNKNOWN", "", "None", "none"]
TRUE_TOKENS, FALSE_TOKENS = ["true", "t", "yes", "y", "1"], ["false", "f", "no", "n", "0"]
AGE_BINS, AGE_LABELS = [0, 50, 70, 200], ["<50", "50-70", ">=70"]


def normalize_id(c: Column) -> Column:
    """Trimmed; of a path, the last segment."""
    return F.element_at(F.split(F.regexp_replace(F.trim(c.cast("string")), "/+$", ""), "/"), -1)


def uid(dataset: Column, patient: Column) -> Column:
    """dataset::patient; null if either is."""
    return F.concat(dataset, F.lit("::"), patient)


def patient_of_stem(stem: Column, layout: str) -> Column:
    """The patient of a slide's file stem; a stem that does not fit its layout is an error."""
    bad = lambda: F.raise_error(F.concat(F.lit("no patient in stem "), stem))
    if layout == "case_folders":
        found = F.regexp_extract(stem, r"^(case_\d+)", 1)
        return F.when(found != "", found).otherwise(bad())
    if layout == "surgen":
        digits = F.regexp_extract(stem, r"_T(\d+)_", 1)
        bare = F.regexp_replace(digits, "^0+", "")
        return F.when(digits != "", F.concat(F.substring_index(stem, "_", 1), F.lit("_"), F.when(bare == "", "0").otherwise(bare))).otherwise(bad())
    if layout in ("flat", "split_folders"):
        return stem
    raise ValueError(f"unknown layout {layout}")


def standard_names(df: DataFrame, separator: str = "_", lower: bool = True) -> DataFrame:
    names = [separator.join(n.strip().split()) for n in df.columns]
    return df.toDF(*[n.lower() if lower else n for n in names])


def first_existing(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def with_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly these columns in this order; absent ones are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])


def missing_to_null(c: Column, tokens: list[str] = MISSING_TOKENS) -> Column:
    return F.when(~F.trim(c.cast("string")).isin(tokens), c)


def is_missing(c: Column, tokens: list[str] = MISSING_TOKENS) -> Column:
    return c.isNull() | F.trim(c.cast("string")).isin(tokens)


def clean_text(c: Column, lower: bool = True) -> Column:
    out = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.lower(out) if lower else out


def mapped(c: Column, values: dict[str, str], strict: bool = False) -> Column:
    """Values replaced by the map; others stay, or become null if ``strict``."""
    if not values:
        return F.lit(None).cast("string") if strict else c
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)
    return found if strict else F.coalesce(found, c)


def to_number(c: Column) -> Column:
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def to_time(c: Column, pattern: str | None = None) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)) if pattern else F.try_to_timestamp(c)


def to_boolean(c: Column, true: list[str] = TRUE_TOKENS, false: list[str] = FALSE_TOKENS) -> Column:
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(true), True).when(text.isin(false), False)


def derived(df: DataFrame, rules: dict[str, str | Column]) -> DataFrame:
    """Columns by SQL expressions or column objects, in order."""
    return reduce(lambda d, kv: d.withColumn(kv[0], F.expr(kv[1]) if isinstance(kv[1], str) else kv[1]), rules.items(), df)


def age_bin(age: Column, bins: list[float] = AGE_BINS, labels: list[str] = AGE_LABELS) -> Column:
    """Bins open on the left and closed on the right; outside of all: null."""
    out = None
    for low, high, label in zip(bins, bins[1:], labels):
        inside = (age > low) & (age <= high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def age_group(age: Column) -> Column:
    """Report groups, closed on the left; null is MISSING and what is out of range counts as the oldest."""
    return F.when(age.isNull(), "MISSING").when((age >= 0) & (age < 50), "<50").when((age >= 50) & (age < 70), "50-70").otherwise(">=70")


def prefixed(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), c).otherwise(F.concat(F.lit(prefix), c))


def interval_text(point: Column, low: Column, high: Column) -> Column:
    """0.835 [0.818, 0.852]; a dash where any part is missing."""
    whole = point.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.when(whole, F.format_string("%.3f [%.3f, %.3f]", point, low, high)).otherwise("—")


def comparison_text(names: Column) -> Column:
    return F.array_join(names, " vs ")


def pixel_normal(values: Column, mean: float, std: float) -> Column:
    return F.transform(values, lambda v: (v / 255.0 - mean) / std)


def align_probabilities(classes: Column, probabilities: Column, k: int) -> Column:
    """Probabilities of classes 0 to k - 1; those the model has not seen are 0."""
    by_class = F.map_from_arrays(classes, probabilities)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.coalesce(F.try_element_at(by_class, c), F.lit(0.0)))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), digits)
