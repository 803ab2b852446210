"""Token ids of whole texts for public vocabularies, fast: each distinct piece of a run is encoded once.

A byte-level BPE first cuts a text into pieces by a fixed pattern and then encodes every piece by itself. Here
the cut is done for a whole run of texts at once on arrays of character classes; pieces are told apart by 64-bit
hashes, and only pieces not seen before by this worker go to the encoder. The ids equal the library's own.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from .common import mix64

LETTER, NUMBER, SPACE = 1, 2, 3
# White space by the Unicode property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The endings that follow an apostrophe in a piece of their own.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
CACHE_PIECES = 150_000
RUN_CHARS = 1 << 18

_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other (0)."""
    if not _classes:
        out = np.fromiter((LETTER if c[0] == "L" else NUMBER if c[0] == "N" else 0 for c in map(unicodedata.category, map(chr, range(0x110000)))), np.uint8, 0x110000)
        out[WHITE_SPACE] = SPACE
        _classes.append(out)
    return _classes[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pieces of  's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+  begin; texts are cut apart first.

    ``text_starts`` are the places of all non-empty texts' first characters.
    """
    n = len(points)
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    change = first.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(change)  # the last is n
    start, end = runs[:-1], runs[1:]
    run_kind = kind[start]
    begin = np.zeros(n, bool)
    begin[start] = True
    # The last of a run of spaces goes with what follows it: as its lead if it is U+0020, else as a piece.
    followed = (run_kind == SPACE) & ~first[end]
    begin[end[followed] - 1] = True
    lead = followed & (points[end - 1] == 0x20)
    begin[end[lead]] = False
    # An apostrophe alone, without a lead, takes an ending from the letters behind it.
    alone = (end - start == 1) & (points[start] == 0x27) & ~first[end]
    alone[1:] &= ~lead[:-1]
    alone[:-1] &= run_kind[1:] == LETTER
    for at in start[alone[: len(start)]]:
        for ending in ENDINGS:
            stop = at + 1 + len(ending)
            if stop <= n and not first[at + 2 : stop].any() and all(points[at + 1 + k] == ord(c) for k, c in enumerate(ending)):
                begin[at + 1] = False
                if stop < n and not first[stop] and kind[stop] == LETTER:
                    begin[stop] = True
                break
    return np.flatnonzero(begin)


class PieceEncoder:
    """Ids of pieces, kept by hash. ``encode`` takes a list of pieces and gives their id lists."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.start = np.zeros(1, np.int64)

    def flat(self, text: str, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, how many ids each piece has) for the pieces text[starts:ends]."""
        if len(self.known) > CACHE_PIECES:
            self._clear()
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        get = self.known.get
        place = np.array([get(h, -1) for h in distinct.tolist()], np.int64)
        if len(new := np.flatnonzero(place < 0)):
            found = self.encode([text[starts[i] : ends[i]] for i in at[new]])
            counts = np.fromiter(map(len, found), np.int64, len(found))
            base, used = len(self.start) - 1, int(self.start[-1])
            need = used + int(counts.sum())
            if need > len(self.ids):
                self.ids = np.concatenate([self.ids[:used], np.empty(need + (need >> 1), np.uint32)])
            self.ids[used:need] = np.fromiter((x for ids in found for x in ids), np.uint32, need - used)
            self.start = np.concatenate([self.start, used + np.cumsum(counts)])
            place[new] = base + np.arange(len(new))
            self.known.update(zip(distinct[new].tolist(), place[new].tolist()))
        where = place[which]
        first = self.start[where]
        counts = self.start[where + 1] - first
        before = np.cumsum(counts) - counts
        return self.ids[np.repeat(first - before, counts) + np.arange(counts.sum())], counts


_KEY = np.uint64(0xD6E8FEB86659FD93)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_power: dict[str, np.ndarray] = {}


def range_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges [starts, ends) of code points, read off one prefix sum."""
    n = len(points)
    if len(_power.get("up", ())) <= n:
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            steps = np.full(n + n // 4 + 1, base, np.uint64)
            steps[0] = 1
            _power[name] = np.cumprod(steps, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    spread = (points + np.uint64(1)) * _KEY
    spread ^= spread >> np.uint64(29)
    np.cumsum(spread * _power["up"][:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _power["down"][starts] + (ends - starts).astype(np.uint64))


def runs_of(texts: list[str], limit: int = RUN_CHARS) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


class ByteBpe:
    """Ids of a byte-level BPE vocabulary in ranks form (.tiktoken), as its tokenizers form gives them.

    A text that holds a special token's string is given to the tokenizers library itself.
    """

    def __init__(self, ranks_path: str, tokenizer_path: str, pattern: str, special: tuple[str, ...] = ("<|endoftext|>",)):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        one = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = PieceEncoder(lambda pieces: [one(p.encode("utf-8", "surrogatepass")) for p in pieces])
        self.tokenizer_path, self.special, self.whole = tokenizer_path, special, None

    def _whole(self, text: str) -> np.ndarray:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.tokenizer_path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for run in runs_of(texts):
            text = "".join(run)
            lengths = np.fromiter(map(len, run), np.int64, len(run))
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            if not text:
                yield from (np.empty(0, np.uint32) for _ in run)
                continue
            points = code_points(text)
            starts = piece_starts(points, bounds[:-1][lengths > 0])
            ends = np.append(starts[1:], len(points))
            ids, counts = self.pieces.flat(text, range_hashes(points, starts, ends), starts, ends)
            upto = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, bounds)]
            for i, one in enumerate(run):
                yield self._whole(one) if any(s in one for s in self.special) else ids[upto[i] : upto[i + 1]]
