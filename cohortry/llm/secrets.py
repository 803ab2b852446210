"""Secret scans: fixed patterns, and a character convolutional network over every further candidate.

Candidates are all runs of key-like characters that are long enough and mix classes as prose does not (such runs with
single dots between them are one candidate). The network, numpy only, scores every candidate, whether or not pattern
findings lie in it; reads the candidate's characters and its surroundings: an embedding of character classes, two
convolutions with maxima over the candidate and over its context, and a logistic output. Longer candidates than its
window are read in overlapping windows, and the highest score counts. It is trained on labelled findings made by rule:
secrets of public formats and look-alikes (words, numbers, links, mail addresses, paths) in invented contexts. One
held-out part calibrates its output (Platt scaling), another sets the threshold, at which recall there is at least
``RECALL`` and no more look-alikes are found than at the highest such one. Pattern findings always stay; the network adds a span of kind ``model`` for every candidate at
or above the threshold, over pattern findings too.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "model")
_KEYWORDS = (b"passw", b"secret", b"token", b"api")  # every finding of ASSIGN holds one of these, in lower case
LEAST_RUN = 16
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
WINDOW, CONTEXT, STRIDE = 64, 24, 16
RECALL = 0.99
_HEX_MAP = bytes(0x68 if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))
_KEY_MAP = bytes(0x6B if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_=-") else 0x20 for c in range(256))
MASK = "[SECRET]"


def base_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes of the pattern findings: leftmost, non-overlapping per kind; too short ones drop."""
    found = []
    lower = raw.lower()
    if any(word in lower for word in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(raw) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST["access"]]
    run = b"h" * LEAST["hex"]
    marked = raw.translate(_HEX_MAP)
    at = marked.find(run)
    while at >= 0:
        end = HEX.match(raw, at).end()
        found.append((at, end, "hex"))
        at = marked.find(run, end)
    return found


def _key_like(word: bytes) -> bool:
    return bool((re.search(rb"\d", word) and re.search(rb"[A-Za-z]", word)) or re.search(rb"[a-z][A-Z]+[a-z]", word))


def candidates(raw: bytes) -> list[tuple[int, int]]:
    """Byte spans of key-like runs that hold a digit and a letter, or change case inside; dotted ones are one."""
    marked, run, out = raw.translate(_KEY_MAP), b"k" * LEAST_RUN, []
    at = marked.find(run)
    while at >= 0:
        end = CANDIDATE.match(raw, at).end()
        if _key_like(raw[at:end]):
            if out and out[-1][1] == at - 1 and raw[at - 1] == 0x2E:
                at = out.pop()[0]
            out.append((at, end))
        at = marked.find(run, end)
    return out


def spans_over(start: int, end: int) -> list[tuple[int, int]]:
    """Windows of at most WINDOW bytes over a candidate, STRIDE apart; the last one ends with it."""
    last = max(start, end - WINDOW)
    return [(s, min(end, s + WINDOW)) for s in [*range(start, last, STRIDE), last]]


def _codes(raw: bytes) -> np.ndarray:
    """Small codes of bytes: 0 none, letters 1-26 (case apart 27-52), digits 53-62, signs by themselves, rest."""
    return _CODE[np.frombuffer(raw, np.uint8)]


_CODE = np.full(256, 94, np.int64)
for _k in range(26):
    _CODE[97 + _k], _CODE[65 + _k] = 1 + _k, 27 + _k
for _k in range(10):
    _CODE[48 + _k] = 53 + _k
for _k, _c in enumerate("+/_.=-\"':@, \n;()[]{}<>#*?!&%$|\\~"):
    _CODE[ord(_c)] = 63 + _k if 63 + _k < 94 else 94
N_CODES = 95


def features(raw: bytes, start: int, end: int, window: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a window of a candidate (by default its first) and of the CONTEXT bytes on either side of the candidate."""
    inner, outer = np.zeros(WINDOW, np.int64), np.zeros(2 * CONTEXT, np.int64)
    first, last = window or spans_over(start, end)[0]
    word = raw[first:last]
    inner[: len(word)] = _codes(word)
    left, right = raw[max(0, start - CONTEXT) : start], raw[end : end + CONTEXT]
    if left:
        outer[CONTEXT - len(left) : CONTEXT] = _codes(left)
    outer[CONTEXT : CONTEXT + len(right)] = _codes(right)
    return inner, outer


def labelled_findings(n: int = 6000, seed: int = 5) -> tuple[list[tuple[bytes, int, int]], np.ndarray]:
    """(text, start, end) and 1 for secrets, 0 for look-alikes, made by rule from a seed."""
    rng = np.random.default_rng(seed)
    pick = lambda signs, k: "".join(rng.choice(list(signs), k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    onsets = ["", "b", "bl", "br", "c", "ch", "cl", "cr", "d", "dr", "f", "fl", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "pl", "pr", "qu", "r", "s", "sch", "sh", "sp", "st", "str", "t", "th", "tr", "v", "w", "y", "z"]
    vowels, codas = ["a", "e", "i", "o", "u", "ai", "ea", "ei", "io", "oo", "ou"], ["", "", "", "b", "ck", "ct", "d", "ff", "g", "l", "ll", "m", "n", "nd", "ng", "nt", "p", "r", "rs", "s", "ss", "t", "tt", "x"]
    draw = random.Random(seed)
    word = lambda k: "".join(draw.choice(onsets) + draw.choice(vowels) + draw.choice(codas) for _ in range(k))
    title = lambda k: "".join(word(int(rng.integers(1, 4))).title() for _ in range(k))
    secrets = [
        lambda: pick(lower + upper + digits, int(rng.integers(20, 45))),
        lambda: pick(lower + upper + digits + "+/", int(rng.integers(24, 64))) + "=" * int(rng.integers(0, 3)),
        lambda: pick("0123456789abcdef", int(rng.choice([24, 32, 40, 64]))),
        lambda: "AKIA" + pick(upper + digits, 16),
        lambda: "ghp_" + pick(lower + upper + digits, 36),
        lambda: "sk_live_" + pick(lower + upper + digits, 24),
        lambda: "xoxb-" + pick(digits, 11) + "-" + pick(lower + upper + digits, 24),
        lambda: "AIza" + pick(lower + upper + digits + "_-", 35),
        lambda: "eyJ" + pick(lower + upper + digits, int(rng.integers(20, 50))),
    ]
    others = [
        lambda: word(int(rng.integers(4, 9))).capitalize() + pick(digits, int(rng.integers(1, 5))) + (word(int(rng.integers(2, 6))) if rng.random() < 0.5 else ""),
        lambda: "-".join(word(2) for _ in range(int(rng.integers(3, 6)))) + str(int(rng.integers(1, 99))),
        lambda: "/".join(word(2) for _ in range(int(rng.integers(3, 6)))) + "/" + pick(digits, int(rng.integers(1, 5))),
        lambda: (word(2) if rng.random() < 0.5 else "") + title(int(rng.integers(3, 6))),
        lambda: "_".join(word(2) for _ in range(int(rng.integers(3, 6)))) + rng.choice(["", "_"]) + pick(digits, int(rng.integers(1, 4))),
        lambda: pick(digits, int(rng.integers(12, 20))) + rng.choice(list(lower)),
        lambda: "page-" + pick(digits, 12) + "-" + word(2),
        lambda: word(5).upper() + word(5) + pick(digits, 1),
        lambda: f"{int(rng.integers(1990, 2030))}-{int(rng.integers(10, 13))}-{int(rng.integers(10, 28))}T{pick(digits, 2)}-{word(3)}",
    ]
    leads = ['key = "', "Authorization: Bearer ", "secret: ", 'token="', "export KEY=", " ", "\n", "(", "see ", "id: ", "http://", "www.", "ref=", "### ", "= "]
    tails = ['"', "\n", " ", ".", ", ", '";', ")", "###", "/", "' "]
    rows, labels = [], []
    for i in range(n):
        label = i % 2
        body = (secrets if label else others)[int(rng.integers(0, 9))]()
        if rng.random() < 0.25:  # behind a path in one run of key-like characters
            body = "/".join(word(int(rng.integers(1, 4))) for _ in range(int(rng.integers(1, 5 if label else 16)))) + "/" + body
        lead = leads[int(rng.integers(0, 9 if label else len(leads)))] if rng.random() < 0.8 else leads[int(rng.integers(5, len(leads)))]
        before = " ".join(word(int(rng.integers(1, 4))) for _ in range(5)) + " " + lead
        text = (before + body + tails[int(rng.integers(0, len(tails)))] + " ".join(word(2) for _ in range(5))).encode()
        start = len(before.encode())
        rows.append((text, start, start + len(body.encode())))
        labels.append(label)
    return rows, np.array(labels, float)


@dataclass
class Network:
    """Embedding, one convolution over the candidate, one over the context, and the output weights."""

    embed: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    out: np.ndarray
    platt: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def hidden(self, inner: np.ndarray, outer: np.ndarray) -> dict[str, np.ndarray]:
        cache: dict[str, np.ndarray] = {}
        parts = []
        for name, codes, kernel in (("inner", inner, self.inner), ("outer", outer, self.outer)):
            x = self.embed[codes]  # rows, places, dims
            width = 3
            windows = np.concatenate([x[:, k : x.shape[1] - width + 1 + k] for k in range(width)], axis=2)
            there = (codes[:, : codes.shape[1] - width + 1] > 0)[:, :, None]
            act = np.maximum(windows @ kernel, 0) * there
            best = act.argmax(axis=1)
            top = np.take_along_axis(act, best[:, None], 1)[:, 0]
            mean = act.sum(axis=1) / np.maximum(there.sum(axis=1), 1)
            cache |= {f"{name}_windows": windows, f"{name}_act": act, f"{name}_best": best, f"{name}_there": there}
            parts += [top, mean]
        cache["h"] = np.concatenate([*parts, np.ones((len(inner), 1))], axis=1)
        return cache

    def raw_score(self, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        return self.hidden(inner, outer)["h"] @ self.out

    def score(self, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.raw_score(inner, outer) + b, -30, 30)))


def train(n: int = 6000, seed: int = 5, epochs: int = 8, dims: int = 8, kernels: int = 16) -> Network:
    """Train on eight tenths, calibrate on one, and set the threshold on another.

    It lies half way between the highest that keeps recall at RECALL and the next look-alike's score below that.
    """
    rows, labels = labelled_findings(n, seed)
    rng = np.random.default_rng(seed)
    # A secret is where its candidate ends; a look-alike must not look like one in any window.
    views = [spans_over(start, end) for _, start, end in rows]
    codes = [features(text, start, end, v[-1] if label else v[int(rng.integers(0, len(v)))]) for (text, start, end), v, label in zip(rows, views, labels)]
    inner, outer = np.stack([c[0] for c in codes]), np.stack([c[1] for c in codes])
    net = Network(rng.normal(0, 0.3, (N_CODES, dims)), rng.normal(0, 0.3, (3 * dims, kernels)), rng.normal(0, 0.3, (3 * dims, kernels)), np.zeros(4 * kernels + 1))
    net.embed[0] = 0
    tenth = np.arange(n) // 2 % 10  # secrets and look-alikes alternate
    learn, calibrate, limit = np.flatnonzero(tenth < 8), tenth == 8, tenth == 9
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in ("embed", "inner", "outer", "out")}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(learn)
        for at in range(0, len(order), 64):
            i = order[at : at + 64]
            cache = net.hidden(inner[i], outer[i])
            p = 1 / (1 + np.exp(-np.clip(cache["h"] @ net.out, -30, 30)))
            d = (p - labels[i]) / len(i)
            grads = {"out": cache["h"].T @ d + 1e-4 * net.out, "embed": np.zeros_like(net.embed)}
            dh = d[:, None] * net.out
            for part, (name, c) in enumerate((("inner", inner[i]), ("outer", outer[i]))):
                act, windows, there = cache[f"{name}_act"], cache[f"{name}_windows"], cache[f"{name}_there"]
                d_top, d_mean = dh[:, 2 * part * kernels : (2 * part + 1) * kernels], dh[:, (2 * part + 1) * kernels : (2 * part + 2) * kernels]
                d_act = np.repeat((d_mean / np.maximum(there.sum(axis=1), 1))[:, None], act.shape[1], 1)
                np.put_along_axis(d_act, cache[f"{name}_best"][:, None], np.take_along_axis(d_act, cache[f"{name}_best"][:, None], 1) + d_top[:, None], 1)
                d_act *= act > 0
                grads[name] = np.einsum("npk,npj->kj", windows, d_act)
                d_windows = d_act @ getattr(net, name).T
                for k in range(3):
                    np.add.at(grads["embed"], c[:, k : c.shape[1] - 2 + k], d_windows[:, :, k * dims : (k + 1) * dims])
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                getattr(net, k)[...] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.embed[0] = 0
    raw, y = net.raw_score(inner[calibrate], outer[calibrate]), labels[calibrate]
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt scaling by gradient steps
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        a, b = a - 0.05 * ((p - y) * raw).mean(), b - 0.05 * (p - y).mean()
    net.platt = (float(a), float(b))
    score, y = net.score(inner[limit], outer[limit]), labels[limit]
    highest = np.sort(score[y == 1])[int((1 - RECALL) * (y == 1).sum())]
    below = score[(y == 0) & (score < highest)]
    net.threshold = float((highest + below.max(initial=0.0)) / 2)
    return net


@lru_cache(maxsize=1)
def production_network() -> Network:
    return train()


def find_spans(net: Network, raw: bytes) -> list[tuple[int, int, str]]:
    """All spans of a UTF-8 text in code points, by start and then kind: the base findings and the network's."""
    free = candidates(raw)
    # Windows of candidates one after the other, in bounded batches.
    best = np.zeros(len(free))
    views = ((i, s, e, w) for i, (s, e) in enumerate(free) for w in spans_over(s, e))
    while part := list(islice(views, 256)):
        codes = [features(raw, s, e, w) for _, s, e, w in part]
        scores = net.score(np.stack([c[0] for c in codes]), np.stack([c[1] for c in codes]))
        np.maximum.at(best, [i for i, *_ in part], scores)
    found = base_spans(raw) + [(s, e, "model") for (s, e), p in zip(free, best) if p >= net.threshold]
    if not found:
        return []
    if not raw.isascii():  # byte to code point: count the bytes that begin a character
        upto = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        found = [(int(upto[s]), int(upto[e]), k) for s, e, k in found]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2]), f[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text of ``docs`` (doc_id, text).

    Spans are kind:start:end in code points, end exclusive. Null texts count as empty and have none; null doc_ids and
    repeated rows are scanned like any other; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net or production_network())  # some 20 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in batch.column(1):
                spans = find_spans(shared.value, (text.as_py() or "").encode("utf-8", "surrogatepass"))
                base = [s for s in spans if s[2] != "model"]
                for kind in KINDS[:3]:
                    rows[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                rows["spans"].append(_joined(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in rows.items())], names=["doc_id", *rows])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, done = [], 0
    for start, end, _ in spans:
        if end <= done:
            continue
        out += [text[done : max(start, done)], "" if start < done else MASK]
        done = end
    return "".join([*out, text[done:]])


def redacted_documents(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """All documents, found secrets masked; n_chars follows where it is a column. Columns stay as they are.

    Null and empty texts stay; rows without findings, repeated rows and null doc_ids go through unchanged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net or production_network())
    schema = docs.schema

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        texts = batch.column(names.index("text")).to_pylist()
        sizes = batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
        changed = False
        for i, text in enumerate(texts):
            if text and (spans := find_spans(shared.value, text.encode("utf-8", "surrogatepass"))):
                texts[i], changed = redact(text, spans), True
                if sizes:
                    sizes[i] = len(texts[i])
        if not changed:
            return batch
        columns = list(batch.columns)
        columns[names.index("text")] = pa.array(texts, pa.string())
        if sizes is not None:
            columns[names.index("n_chars")] = pa.array(sizes, batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                yield mask(batch.slice(start, 256))

    return docs.mapInArrow(tidy(run), schema)
