"""Quality rules from a tokeniser's fertility: characters per token, byte-fallback share, token entropy.

A public vocabulary reads prose of its languages with few tokens, no fallback to bytes and a wide spread of
tokens; noise, wrong encodings and repeated text stand out in these three figures. Bands are kept per script,
from quartiles over all documents that pass the base rules, so scripts the vocabulary knows less are judged
among their own. The spread of tokens falls with a text's length, so its band lies around the script's own line
over the logarithm of the word count. A band reaches ``REACH`` quartile ranges beyond the quartiles; texts that the
vocabulary reads mostly as bytes go whatever the rest of their script is like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, checkpointed, chunks, tidy, window_hashes
from .tokens import PieceEncoder

REACH = 1.25
#: A band is at least this wide on each side, in the measure's own unit.
LEAST_MARGIN = {"chars_per_token": 0.1, "byte_share": 0.05, "token_spread": 0.02}
#: Figures of short texts scatter: a text of n words may be off by this over the square root of n besides.
SCATTER = {"chars_per_token": 1.0, "byte_share": 0.2, "token_spread": 0.1}
#: Texts with a larger share of byte tokens are not read by the vocabulary at all, however common they are.
BYTE_CEILING = 0.75
#: Change of the token spread when a text doubles, for scripts of under SLOPE_ROWS documents.
SLOPE, SLOPE_ROWS = -0.05, 30
MEASURES = tuple(LEAST_MARGIN)
# First and last letters of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
_NAMES = [*SCRIPTS, "none"]
WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
_BASE = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
_FIELDS = f"{_BASE}, script string, chars_per_token double, byte_share double, token_spread double"


def repeated_words(words: np.ndarray, width: int = WINDOW) -> int:
    """How many words lie in a window of ``width`` words that the text holds twice or more."""
    windows = window_hashes(words, width)
    if len(windows) < 2:
        return 0
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    if not again.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:-width][again] += 1
    cover[width:][again] -= 1
    return int((np.cumsum(cover) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def _script_table() -> np.ndarray:
    table = np.full(0x110000, len(SCRIPTS), np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            table[a : b + 1] = k
    return table


def _measures(model_path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    pieces = PieceEncoder(lambda words: model.encode(words, num_threads=1))
    scripts = _script_table()
    symbols = np.zeros(256, bool)
    symbols[list(b"#*$%&|<>")] = True

    def measure(raws: list[bytes]) -> dict[str, list]:
        words = Words(raws)
        hashes = words.hashes()
        text = words.buffer
        lead = (text & 0xC0) != 0x80  # first bytes of characters
        chars_upto = np.concatenate([[0], np.cumsum(lead)])
        symbol_upto = np.concatenate([[0], np.cumsum(symbols[text])])
        word_chars = chars_upto[words.ends] - chars_upto[words.starts]
        chars_before = np.concatenate([[0], np.cumsum(word_chars)])
        whole = text.tobytes().decode("utf-8", "surrogatepass")
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ids, counts = pieces.flat(whole, hashes, chars_upto[words.starts], chars_upto[words.ends]) if len(hashes) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        tokens_before = np.concatenate([[0], np.cumsum(counts)])
        bytes_before = np.concatenate([[0], np.cumsum(is_byte[ids])])
        kinds = scripts[points]
        out: dict[str, list] = {name: [] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", *MEASURES)}
        for i, raw in enumerate(raws):
            a, b = words.first[i], words.first[i + 1]
            s, e = words.text_starts[i], words.text_starts[i + 1] - 1
            t0, t1 = tokens_before[a], tokens_before[b]
            n = int(t1 - t0)
            out["n_words"].append(int(b - a))
            out["word_chars"].append(int(chars_before[b] - chars_before[a]))
            out["n_symbols"].append(int(symbol_upto[e] - symbol_upto[s]))
            out["n_dup_lines"].append(duplicate_lines(raw))
            out["n_repeat_words"].append(repeated_words(hashes[a:b]))
            letters = np.bincount(kinds[chars_upto[s] : chars_upto[e]], minlength=len(_NAMES))[:-1]
            out["script"].append(_NAMES[int(letters.argmax())] if letters.any() else "none")
            out["chars_per_token"].append(out["word_chars"][-1] / n if n else None)
            out["byte_share"].append(float(bytes_before[t1] - bytes_before[t0]) / n if n else None)
            if n > 1:
                found = np.sort(ids[t0:t1])
                runs = np.diff(np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1], [True]])))
                # Entropy over the most that so many tokens can have, so that short and long texts compare.
                out["token_spread"].append(float(-(runs / n * np.log2(runs / n)).sum() / np.log2(n)))
            else:
                out["token_spread"].append(None)
        return out

    return measure


def document_measures(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Base counts, script and fertility of every whole text; a null text has no words."""
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _measures(path)
        kinds = {"script": pa.string(), **{m: pa.float64() for m in MEASURES}}
        for batch in batches:
            doc_ids = batch.column(0)
            for start, raws in chunks(text.as_py() for text in batch.column(1)):
                found = measure(raws)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(start, len(raws)), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items())], names=["doc_id", *found])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), _FIELDS)


def _level(measure: str) -> Column:
    """A measure free of length: of the token spread, what is left over the script's line."""
    return F.col(measure) - F.col("slope") * F.log2(F.greatest("n_words", F.lit(1))) if measure == "token_spread" else F.col(measure)


def bands(measured: DataFrame, reach: float = REACH) -> DataFrame:
    """script, slope, and low and high ends of each measure's band, from the quartiles of all documents of the script."""
    fitted = F.regr_slope("token_spread", F.log2(F.greatest("n_words", F.lit(1))))
    slope = F.coalesce(F.when(F.count("token_spread") >= SLOPE_ROWS, fitted), F.lit(SLOPE))
    slopes = measured.groupBy("script").agg(slope.alias("slope"))
    quartiles = measured.join(F.broadcast(slopes), "script").groupBy("script", "slope").agg(*[F.percentile_approx(_level(m), [0.25, 0.75], 2000).alias(m) for m in MEASURES])
    ends = []
    for m in MEASURES:
        margin = F.greatest((F.col(m)[1] - F.col(m)[0]) * reach, F.lit(LEAST_MARGIN[m]))
        ends += [(F.col(m)[0] - margin).alias(f"{m}_low"), (F.col(m)[1] + margin).alias(f"{m}_high")]
    return quartiles.select("script", "slope", *ends)


def quality_rules(docs: DataFrame, vocabulary: str | None = None, reach: float = REACH) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the measures.

    ``base_failed``: under 10 words, or over 20 % of them in repeated 5-word windows. ``kept`` is false then, and
    else says that all three measures lie in the script's bands and the byte share is at most ``BYTE_CEILING``. Null and empty texts have no words and fail.
    Repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    measured = checkpointed(document_measures(docs, vocabulary)).withColumn("base_failed", failed)
    # One row per script of the fixed list above: 15 at most.
    limits = F.broadcast(bands(measured.where(~F.col("base_failed")), reach))
    inside = F.coalesce(F.col("byte_share") <= BYTE_CEILING, F.lit(True))
    for m in MEASURES:
        scatter = F.lit(SCATTER[m]) / F.sqrt(F.greatest("n_words", F.lit(1)))
        inside = inside & F.coalesce(_level(m).between(F.col(f"{m}_low") - scatter, F.col(f"{m}_high") + scatter), F.lit(True))
    judged = measured.join(limits, "script", "left").withColumn("kept", ~F.col("base_failed") & inside)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", *MEASURES)
