"""Document quality by hierarchical empirical Bayes: a document's own evidence, shrunk site and path posteriors.

A logistic model of a few text figures gives each document's evidence. Sites (hosts) and the paths below them get
Beta-binomial posteriors from the evidence of all their documents: the prior strength at each level is fitted by
the method of moments from grouped sums, so a path with few documents falls back to its site, and a site with few
documents to the whole corpus. The document's posterior adds its own likelihood ratio to its path's log-odds.

Everything but the fit of a handful of coefficients (on a bounded labelled sample) is grouped aggregation with
map-side sums; the sums that leave each task are one row per path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, checkpointed

SAMPLE_ROWS = 20_000
KEEP_AT = 0.5
#: A word marks a text as toxic from this log likelihood ratio on, if so many labelled rows hold it.
TOXIC_RATIO, TOXIC_ROWS = 4.0, 10
#: Strength of a level's prior: fitted, but within these bounds.
STRENGTH_BOUNDS = (2.0, 1000.0)
#: How far a site may move a document's log-odds.
SITE_REACH = 2.0
RIDGE = 1.0


def figures(text: Column) -> list[Column]:
    """Figures of a text, none of which depends on who published it."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.greatest(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(1)).cast("double")
    share = lambda kept: F.length(F.regexp_replace(text, kept, "")) / chars
    lines = F.split(text, "\n")
    listed = F.split(F.lower(F.trim(text)), r"\s+")
    return [
        F.log1p(words),
        chars / words,
        F.least(share(r"[^#*$%&|<>]+") * F.lit(10.0), F.lit(3.0)),
        share(r"[^0-9]+") * F.lit(10.0),
        share(r"[^.,;:!?]+") * F.lit(10.0),
        share(r"[^\p{Lu}]+") * F.lit(10.0),
        F.lit(1.0) - F.size(F.array_distinct(lines)) / F.size(lines),
        share(r"[\p{L}\s]+") * F.lit(5.0),
        F.size(F.array_distinct(listed)) / F.size(listed),
        F.regexp_count(F.lower(text), F.lit(r"(?<!\S)(\S++)(?=\s+\1(?!\S))")) / words,  # the same word again
    ]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Site and path keys of a URL: the host in lower case, and the host with the first segment of the path."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?#:]*)", 1))
    return host, F.concat(host, F.lit("/"), F.regexp_extract(bare, r"^[^/?#]*/([^/?#]*)", 1))


def fit_evidence(labelled: DataFrame, label: str, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (last: intercept), means and deviations of a ridge logistic model on ``x`` and ``label``.

    ``labelled`` has columns x (array of doubles), key and the label; at most about ``sample_rows`` rows are drawn,
    by a hash of the key.
    """
    n = labelled.count()
    drawn = labelled.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(min(1.0, sample_rows / max(n, 1)) * (1 << 30)))
    rows = drawn.select("x", F.col(label).cast("double").alias("y")).collect()
    width = len(rows[0]["x"]) if rows else 10
    x, y = np.array([r["x"] for r in rows], float).reshape(-1, width), np.array([r["y"] for r in rows], float)
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(width), np.ones(width))
    design = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    beta = np.zeros(width + 1)
    penalty = np.diag([RIDGE] * width + [1e-3])
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta, mean, scale


def _letters(text: Column) -> Column:
    """The distinct words of a text, letters only, in lower case."""
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"))


def toxic_words(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Words that labelled toxic texts hold far more often than others: log likelihood ratios of presence, smoothed.

    From at most about ``sample_rows`` labelled rows, drawn as for the evidence model.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(min(1.0, sample_rows / max(n, 1)) * (1 << 30)))
    rows = docs.select("doc_id", "text").join(known, "doc_id").select(F.col("toxic").cast("int").alias("toxic"), _letters(F.col("text")).alias("found"))
    totals = rows.agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other")).first()
    if not totals["toxic"] or not totals["other"]:
        return []
    held = rows.select("toxic", F.explode("found").alias("word")).where("word <> ''").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    ratio = F.log((F.col("t") + 0.5) / (totals["toxic"] + 1)) - F.log((F.col("o") + 0.5) / (totals["other"] + 1))
    return sorted(r["word"] for r in held.where((F.col("t") + F.col("o") >= TOXIC_ROWS) & (ratio >= TOXIC_RATIO)).select("word").collect())


def _strength(groups: DataFrame, parent_mean: Column) -> Column:
    """Method of moments for the prior strength of a level from its groups' (n, s): an aggregate expression.

    With group means m_i around the parent's mean, the variance between groups is what is left of their scatter
    after the binomial part; strength = mean (1 - mean) / between - 1.
    """
    m = F.col("s") / F.col("n")
    within = F.avg(m * (1 - m) / F.col("n"))
    between = F.avg((m - parent_mean) * (m - parent_mean)) - within
    spread = F.avg(parent_mean * (1 - parent_mean))
    low, high = STRENGTH_BOUNDS
    return F.least(F.greatest(F.coalesce(F.when(between > 1e-9, spread / between - 1), F.lit(high)), F.lit(low)), F.lit(high))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """(site, path, p) rows to (site, path, n, site_n, global_mean, site_mean, path_mean), shrunk level by level."""
    paths = checkpointed(evidence.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")))
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    everything = paths.agg((F.sum("s") / F.sum("n")).alias("global_mean"))
    row = everything.first()
    mean = row["global_mean"] if row and row["global_mean"] is not None else 0.5
    strength = sites.agg(_strength(sites, F.lit(mean)).alias("a")).first()["a"] or STRENGTH_BOUNDS[1]
    sites = sites.select("site", F.col("n").alias("site_n"), ((F.col("s") + strength * mean) / (F.col("n") + strength)).alias("site_mean"))
    joined = checkpointed(paths.join(sites, "site"))
    below = joined.agg(_strength(joined, F.col("site_mean")).alias("a")).first()["a"] or STRENGTH_BOUNDS[1]
    return joined.select("site", "path", "n", "site_n", F.lit(float(mean)).alias("global_mean"), "site_mean", ((F.col("s") + below * F.col("site_mean")) / (F.col("n") + below)).alias("path_mean"))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def quality_posteriors(docs: DataFrame, labels: DataFrame, site: Column, path: Column, keep_at: float = KEEP_AT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, evidence, site_mean, path_mean, posterior, kept of every row of ``docs`` (doc_id, text).

    ``kept``: the posterior is ``keep_at`` or more, and, if ``labels`` has a column toxic, the text holds no toxic word.
    ``labels`` (doc_id, quality) may cover any part of the documents. Null texts count as empty; null sites and paths
    are groups of their own. Without labels of both kinds the evidence is flat and all documents are kept. Repeated
    rows count as often as they stand; an empty table gives an empty result; other columns are ignored.
    """
    # In Python's view: keys are made never-null first, so that joins below keep null sites.
    marks = toxic_words(docs, labels, sample_rows) if "toxic" in labels.columns else []
    toxic = F.arrays_overlap(_letters(F.col("text")), F.array(*map(F.lit, marks))) if marks else F.lit(False)
    rows = docs.select("doc_id", toxic.alias("toxic"), F.array(*figures(F.col("text"))).alias("x"), F.coalesce(F.concat(F.lit("0"), site), F.lit("1")).alias("site"), F.coalesce(F.concat(F.lit("0"), path), F.lit("1")).alias("path"))
    rows = checkpointed(rows)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = rows.where(F.col("doc_id").isNotNull()).join(known, "doc_id").select("x", F.col("doc_id").alias("key"), "quality")
    beta, mean, scale = fit_evidence(labelled, "quality", sample_rows)
    weights = beta[:-1] / scale
    score = F.lit(float(beta[-1] - (weights * mean).sum()))
    for k, w in enumerate(weights):
        score = score + F.lit(float(w)) * F.col("x")[k]
    scored = rows.select("doc_id", "toxic", "site", "path", F.least(F.greatest(score, F.lit(-12.0)), F.lit(12.0)).alias("score"))
    scored = scored.withColumn("p", 1 / (1 + F.exp(-F.col("score"))))
    sites = site_posteriors(scored)
    # The sites' rows are salted for the join, as one site may hold a third of all documents.
    salts = 16
    salted = sites.withColumn("salt", F.explode(F.when(F.col("n") > 10_000, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    spread = salted.select("site", "path", "salt", "n", "global_mean", "site_mean", "path_mean")
    big = sites.where("n > 10000").select("site", "path", F.lit(True).alias("big"))
    # Paths of over 10,000 documents: no more than one for each 10,000 rows, and Spark broadcasts them only if small.
    flagged = scored.join(big, ["site", "path"], "left").withColumn("salt", F.when(F.col("big"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).otherwise(0))
    joined = flagged.join(spread, ["site", "path", "salt"])
    own = F.col("score") - _logit(F.col("global_mean"))
    shift = _logit(F.col("path_mean")) - _logit(F.col("global_mean"))
    odds = _logit(F.col("global_mean")) + own + F.least(F.greatest(shift, F.lit(-SITE_REACH)), F.lit(SITE_REACH))
    posterior = 1 / (1 + F.exp(-odds))
    return joined.select("doc_id", F.col("p").alias("evidence"), "site_mean", "path_mean", posterior.alias("posterior"), ((posterior >= keep_at) & ~F.col("toxic")).alias("kept"))
