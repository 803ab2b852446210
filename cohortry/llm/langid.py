"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

Models are trained on a bounded sample of labelled documents (``SAMPLE_DOCS`` per language, drawn by hash): raw
counts for the highest order, continuation counts below, one discount per order and language. Probabilities are
interpolated once, when training: for every n-gram that any language has seen, the table of its order holds the
final log-probability under all languages, in an array sorted by the n-gram's hash. A text is scored with one binary
search per character; only characters whose n-gram no language has seen look at shorter ones, with the back-off
weights of their contexts, which are kept in the same kind of array.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, tidy

ORDER = 4
SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
RUN_CHARS = 1 << 18
HELD_OUT = 5
UNDETERMINED = "und"
#: A text is rejected if its cross-entropy (nats per character) is above the limit for its language and length. Limits
#: are calibrated on training texts that the models have not seen, cut to each of these lengths: the quantile that
#: leaves ``REJECT_RATE`` of them above, carried on beyond it by ``REJECT_REACH`` times its distance from their median
#: (a sample is finite, and a corpus has more kinds of clean text than it).
LENGTHS = (8, 16, 32, 64, 128, 256, 512, 1024)
REJECT_RATE = 0.001
REJECT_REACH = 2.0
CALIBRATED = 5  # of so many sample texts, one is kept for calibration
SLICES = 24  # taken at most of one text for one length
LEAST_SLICES = 50  # with fewer of a length, the limit of the next shorter one holds
TOTAL_DOCS = 6400  # of all languages, so that many languages do not outgrow the driver
_STEP = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint32(0x110000)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, each led by ORDER - 1 start marks; where each text's marks begin."""
    lead = np.full(ORDER - 1, _START, np.uint32)
    parts, lengths = [], []
    for text in texts:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        parts += [lead, points]
        lengths.append(len(lead) + len(points))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters that end at each place from ``ORDER - 1`` on (order 0: one constant)."""
    n = len(points) - (ORDER - 1)
    out = np.full(n, np.uint64(order + 1))
    for back in range(order):
        out *= _STEP
        out += points[ORDER - 1 - back : ORDER - 1 - back + n].astype(np.uint64) + np.uint64(1)
    return mix64(out)


def context_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters before each place, equal to ``gram_hashes`` one place earlier."""
    n = len(points) - (ORDER - 1)
    out = np.full(n, np.uint64(order + 1))
    for back in range(1, order + 1):
        out *= _STEP
        out += points[ORDER - 1 - back : ORDER - 1 - back + n].astype(np.uint64) + np.uint64(1)
    return mix64(out)


@dataclass
class Models:
    """grams[k] and contexts[k]: sorted hashes of order k + 1 and k, each with a row of values per hash."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    limits: np.ndarray  # rejection: the highest cross-entropy of an accepted text, per language and length


def _find(sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_hashes, wanted)
    at[at == len(sorted_hashes)] = 0
    return at, sorted_hashes[at] == wanted


def _set_apart(texts: list[str]) -> tuple[list[str], list[str]]:
    """(texts to learn from, texts to calibrate with); a single text does both."""
    held = texts[CALIBRATED - 1 :: CALIBRATED]
    return ([t for k, t in enumerate(texts) if k % CALIBRATED != CALIBRATED - 1], held) if held else (texts, texts)


def _limits(models: Models, held: dict[str, list[str]]) -> np.ndarray:
    """The rejection limit of each language at each of LENGTHS, from texts that the models have not seen."""
    limits = np.full((len(models.languages), len(LENGTHS)), np.inf)
    for j, language in enumerate(models.languages):
        for k, length in enumerate(LENGTHS):
            slices = []
            for text in held[language]:
                step = max(length, len(text) // SLICES)
                slices += [text[a : a + length] for a in range(0, len(text) - length + 1, step) if has_letter(text[a : a + length])]
            if len(slices) >= LEAST_SLICES:
                means = _scored(models, slices)[0]
                loss = -means[means.argmax(axis=1) == j, j]  # a slice in another language says nothing on this one
                if not len(loss):
                    continue
                high, middle = np.quantile(loss, 1 - REJECT_RATE), np.median(loss)
                limits[j, k] = high + REJECT_REACH * (high - middle)
    return np.minimum.accumulate(limits, axis=1)  # longer texts scatter less


def train(samples: dict[str, list[str]]) -> Models:
    """Interpolated Kneser-Ney models of all languages from their sample texts."""
    languages = sorted(samples)
    apart = {language: _set_apart(samples[language]) for language in languages}
    points_of = {language: _points(apart[language][0]) for language in languages}

    def counted(language: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams of order k with their contexts, their last k - 1 characters' hashes, and counts."""
        points, bounds = points_of[language]
        real = np.ones(len(points), bool)
        real[(bounds[:-1, None] + np.arange(ORDER - 1)).ravel()] = False
        real = real[ORDER - 1 :]
        gram = gram_hashes(points, k)[real]
        if k < ORDER:  # continuation counts: in how many distinct one-character extensions to the left
            before = points[ORDER - 1 - k : len(points) - k][real]
            longer = np.unique(mix64(gram ^ (before.astype(np.uint64) * _STEP)), return_index=True)[1]
            distinct, first, count = np.unique(gram[longer], return_index=True, return_counts=True)
            first = longer[first]
        else:
            distinct, first, count = np.unique(gram, return_index=True, return_counts=True)
        shorter = gram_hashes(points, k - 1)[real][first] if k > 1 else distinct
        return distinct, context_hashes(points, k - 1)[real][first], shorter, count

    alphabet = len(np.unique(np.concatenate([np.unique(p) for p, _ in points_of.values()])))
    floor = 1.0 / (4 * alphabet + 4)
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    contexts: list[tuple[np.ndarray, np.ndarray]] = []
    lower: tuple[np.ndarray, np.ndarray] | None = None  # the order below, as probabilities
    for k in range(1, ORDER + 1):
        every = [counted(language, k) for language in languages]
        all_grams, first = np.unique(np.concatenate([e[0] for e in every]), return_index=True)
        context_of = np.concatenate([e[1] for e in every])[first]
        all_contexts = np.unique(context_of)
        context_at = np.searchsorted(all_contexts, context_of)
        probability = np.zeros((len(all_grams), len(languages)))
        weight = np.ones((len(all_contexts), len(languages)))
        if k == 1:
            below = np.full((len(all_grams), len(languages)), floor)
        else:
            below = lower[1][np.searchsorted(lower[0], np.concatenate([e[2] for e in every])[first])]
        for j, (gram, _, _, counts) in enumerate(every):
            count = np.zeros(len(all_grams))
            count[np.searchsorted(all_grams, gram)] = counts
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total = np.bincount(context_at, count, minlength=len(all_contexts))
            kinds = np.bincount(context_at, count > 0, minlength=len(all_contexts))
            known = total > 0
            weight[known, j] = discount * kinds[known] / total[known]
            own = np.where(known[context_at], np.maximum(count - discount, 0) / np.maximum(total[context_at], 1), 0.0)
            probability[:, j] = own + weight[context_at, j] * below[:, j]
        grams.append((all_grams, np.log(probability).astype(np.float32)))
        contexts.append((all_contexts, np.log(weight).astype(np.float32)))
        lower = (all_grams, probability)
    models = Models(languages, grams, contexts, math.log(floor), np.empty((len(languages), len(LENGTHS))))
    models.limits = _limits(models, {language: held for language, (_, held) in apart.items()})
    return models


def log_probabilities(models: Models, points: np.ndarray) -> np.ndarray:
    """log p(character | those before) under every language, for each place from ORDER - 1 on."""
    n = len(points) - (ORDER - 1)
    out = np.zeros((n, len(models.languages)), np.float32)
    open_at = np.arange(n)
    for k in range(ORDER, 0, -1):
        hashes = gram_hashes(points, k)
        if len(open_at) < n:
            hashes = hashes[open_at]
        at, hit = _find(models.grams[k - 1][0], hashes)
        out[open_at[hit]] += models.grams[k - 1][1][at[hit]]
        open_at = open_at[~hit]
        if not len(open_at):
            return out
        at, hit = _find(models.contexts[k - 1][0], context_hashes(points, k - 1)[open_at])
        out[open_at[hit]] += models.contexts[k - 1][1][at[hit]]
    out[open_at] += models.floor
    return out


def _scored(models: Models, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean log-probability per character under every language, and the number of characters, of each text."""
    means, sizes = [], []

    def flush(held: list[str]) -> None:
        points, bounds = _points(held)
        scores = log_probabilities(models, points)
        # A text's places follow its marks; seen from ORDER - 1 on, they begin where its marks begin.
        for a, b in zip(bounds[:-1], bounds[1:]):
            n = b - a - (ORDER - 1)
            sizes.append(n)
            means.append(scores[a : a + n].sum(axis=0, dtype=np.float64) / max(n, 1))

    held, size = [], 0
    for text in texts:
        if held and size + len(text) > RUN_CHARS:
            flush(held)
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        flush(held)
    return np.array(means).reshape(-1, len(models.languages)), np.array(sizes)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(models: Models, texts: list[str | None]) -> tuple[list[str], list[float], list[bool], list[float | None]]:
    """(language, score, rejected, cross-entropy) of each text.

    The score is the posterior of the chosen language when a text counts as at most ``EVIDENCE`` independent
    characters. A text without a letter, or null, is ``und``, score 0, rejected.
    """
    readable = [i for i, t in enumerate(texts) if has_letter(t)]
    languages, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    rejected, entropy = [True] * len(texts), [None] * len(texts)
    if not readable or not models.languages:
        return languages, scores, rejected, entropy
    means, sizes = _scored(models, [texts[i] for i in readable])
    best = means.argmax(axis=1)
    evidence = (means - means.max(axis=1, keepdims=True)) * np.minimum(sizes, EVIDENCE)[:, None]
    posterior = 1 / np.exp(evidence).sum(axis=1)
    loss = -means[np.arange(len(best)), best]
    at = np.searchsorted(LENGTHS, sizes, "right") - 1  # the limit of the next shorter length; shorter texts than all are kept
    limit = np.where(at >= 0, models.limits[best, np.maximum(at, 0)], np.inf)
    for i, j, p, e, over in zip(readable, best, posterior, loss, loss > limit):
        languages[i], scores[i], rejected[i], entropy[i] = models.languages[j], float(min(1.0, p)), bool(over), float(e)
    return languages, scores, rejected, entropy


EVIDENCE = 50


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_fold() != 0))


def _fold() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT)), F.lit(1))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Models:
    """Train on at most about ``sample_docs`` documents per language (``TOTAL_DOCS`` in all), long ones by ``sample_chars`` of their characters.

    Documents are drawn by a hash of their text, at a rate set by the language's own count, so the sample's size does
    not depend on the table's. Of a longer text a run of ``sample_chars`` characters is learned, which its hash places.
    Held-out documents, null languages and null texts are not used.
    """
    rows = training_rows(docs.select("doc_id", "text", "lang")).where(F.length("text") > 0)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Models([], [], [], 0.0, np.zeros((0, len(LENGTHS))))
    sample_docs = min(sample_docs, max(1, TOTAL_DOCS // len(counts)))
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample_docs / n))]), F.col("lang"))
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < rate * F.lit(1 << 30))
    samples: dict[str, list[str]] = {}
    spare = F.greatest(F.length("text") - sample_chars, F.lit(0))
    drawn = drawn.select("lang", F.substring("text", F.pmod(F.xxhash64(F.lit(1), "text"), spare + 1) + 1, F.lit(sample_chars)).alias("text"))
    # Equal texts are drawn together, so copies are dropped before anything is sent.
    for r in drawn.groupBy("lang", "text").agg(F.lit(1).alias("one")).select("lang", "text").collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    return train({k: sorted(v) for k, v in samples.items()})


_FIELDS = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean, cross_entropy double"


def identify_documents(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, cross_entropy of every whole text.

    Null texts and texts without a letter are ``und``, score 0, rejected. A null doc_id is never held out. Repeated
    rows are predicted alike; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = identify(shared.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(v, t) for v, t in zip(found, (pa.string(), pa.float64(), pa.bool_(), pa.float64())))], names=["doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy"])

    return docs.select(F.col("doc_id").cast("long"), (_fold() == 0).alias("held_out"), "text").mapInArrow(tidy(run), _FIELDS)


def language_id(docs: DataFrame) -> DataFrame:
    return identify_documents(docs, fit(docs))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised; those that the models reject go. Columns stay as they are.

    Null texts and texts without a letter go too; null doc_ids and repeated rows are judged by their text alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rejected = identify(shared.value, part.column(at).to_pylist())[2]
                yield part.filter(pa.array([not r for r in rejected]))

    return docs.mapInArrow(tidy(run), docs.schema)
