"""Media columns: progressive JPEG files as binary values, decoded to full-resolution RGB tensors.

The decoder takes any Huffman-coded progressive file of 8-bit samples (SOF2): it accumulates spectral-selection and
successive-approximation scans into one coefficient array per component, transforms them back in numpy, upsamples
chroma by repetition and converts to RGB. Scalar decoding is helped by strides: if a table's shortest code is a
single coefficient of fixed size, as many of them as stand in a row are read at once.

The encoder stores bytes without loss. The unit of the format that a decoder gives back exactly is the quantised
coefficient, not the sample, so a payload byte is a coefficient: byte b is the one whose eight magnitude bits are b
(b, or b - 255 below 128), 64 to a block in zigzag order, luminance blocks first, then both chroma planes at 4:2:0.
A comment segment holds the payload's length and the number of blocks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

BLOCK = 64
MAX_RUN = 32767


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Row-major place of each zigzag index: along antidiagonals, turning at every edge."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    u, x = np.mgrid[0:8, 0:8]
    return np.where(u == 0, np.sqrt(0.125), 0.5 * np.cos((2 * x + 1) * u * np.pi / 16))


class Huffman:
    """Codes of a DHT segment: symbol -> (code, length), and by 16-bit look-ahead."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[int, tuple[int, int]] = {}
        self.by_code: dict[tuple[int, int], int] = {}
        code = k = 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                self.codes[symbols[k]] = (code, length)
                self.by_code[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.raw = bytes(counts) + bytes(symbols[:k])
        # The first code, if it is one coefficient without a run: (length, size)
        first = symbols[0] if k else 0
        self.stride = (self.codes[first][1], first) if 0 < first < 16 else None
        self.longest = max((n for _, n in self.codes.values()), default=0)

    def segment(self, kind: int, ident: int) -> bytes:
        return _segment(0xC4, bytes([kind << 4 | ident]) + self.raw)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(by_length: dict[int, list[int]]) -> Huffman:
    counts = bytes(len(by_length.get(n, ())) for n in range(1, 17))
    return Huffman(counts, bytes(s for n in range(1, 17) for s in by_length.get(n, ())))


_ENDS = [n << 4 for n in range(15)]
DC_TABLE = _table({2: [0], 3: [7, 8, 6, 9, 5], 4: [4], 5: [3], 6: [2], 7: [1], 8: [10]})
FIRST_TABLE = _table({1: [7], 5: _ENDS})
REFINE_TABLE = _table({4: _ENDS})
_DC_CODE = np.array([DC_TABLE.codes[s][0] for s in range(11)])
_DC_LENGTH = np.array([DC_TABLE.codes[s][1] for s in range(11)])


def _bits(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The low ``lengths`` bits of each value, most significant first, in a row."""
    which = np.repeat(np.arange(len(values)), lengths)
    upto = np.cumsum(lengths)
    return (values[which] >> (upto[which] - 1 - np.arange(upto[-1] if len(upto) else 0)) & 1).astype(np.uint8)


def _packed(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes: padded with ones, a zero stuffed behind each FF."""
    short = -len(bits) % 8
    if short:
        bits = np.concatenate([bits, np.ones(short, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _end_runs(blocks: int, table: Huffman) -> list[tuple[int, np.ndarray]]:
    """(blocks, bits) of the end-of-band runs that cover so many blocks."""
    out = []
    while blocks > 0:
        run = min(blocks, MAX_RUN)
        n = run.bit_length() - 1
        code, length = table.codes[n << 4]
        out.append((run, _bits(np.array([code, run - (1 << n)]), np.array([length, n]))))
        blocks -= run
    return out


@lru_cache(maxsize=4096)
def _interleaved(wide: int, high: int) -> np.ndarray:
    """Places, in the order Y raster, Cb raster, Cr raster, of the blocks in MCU order for 4:2:0."""
    row, col = np.mgrid[0:high, 0:wide]
    y = np.stack([(2 * row + r) * 2 * wide + 2 * col + c for r in (0, 1) for c in (0, 1)], axis=-1)
    chroma = 4 * wide * high + row * wide + col
    return np.concatenate([y, chroma[..., None], chroma[..., None] + wide * high], axis=-1).reshape(-1)


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A progressive JPEG that holds ``payload`` (a positive multiple of 64 bytes) in its coefficients."""
    blocks = len(payload) // BLOCK
    units = -(-blocks // 6)
    wide = int(np.ceil(np.sqrt(units)))
    high = -(-units // wide)
    if wide > 4095:
        raise ValueError("payload does not fit an image")
    area = wide * high
    raw = np.frombuffer(payload, np.uint8).reshape(blocks, BLOCK)
    dc = np.zeros(6 * area, np.int64)
    first = raw[:, 0].astype(np.int64)
    dc[:blocks] = np.where(first >= 128, first, first - 255)
    order = _interleaved(wide, high)
    out = [b"\xff\xd8", _segment(0xFE, f"payload {n_bytes} {blocks}".encode()), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"))
    out += [DC_TABLE.segment(0, 0), FIRST_TABLE.segment(1, 0), REFINE_TABLE.segment(1, 1)]

    def scan(components: list[tuple[int, int]], start: int, end: int, high_bit: int, low_bit: int, data: bytes) -> None:
        out.append(_segment(0xDA, bytes([len(components)]) + b"".join(bytes(c) for c in components) + bytes([start, end, high_bit << 4 | low_bit])))
        out.append(data)

    shown = (dc >> 1)[order]
    component = np.tile([0, 0, 0, 0, 1, 2], area)
    diff = np.empty_like(shown)
    for c in range(3):
        own = component == c
        diff[own] = np.diff(shown[own], prepend=0)
    size = np.where(diff == 0, 0, np.floor(np.log2(np.maximum(np.abs(diff), 1))).astype(np.int64) + 1)
    extra = np.where(diff >= 0, diff, diff + (1 << size) - 1)
    scan([(1, 0x00), (2, 0x00), (3, 0x00)], 0, 0, 0, 1, _packed(_bits(_DC_CODE[size] << size | extra, _DC_LENGTH[size] + size)))
    bounds = [(0, 4 * area), (4 * area, 5 * area), (5 * area, 6 * area)]
    bands = {0: [(1, 5), (6, 63)], 1: [(1, 63)], 2: [(1, 63)]}
    for c, (a, b) in enumerate(bounds):
        held = raw[a : min(b, blocks)]
        for s, e in bands[c]:
            # The code of a 7-bit coefficient is one zero bit, so code and magnitude bits are one byte: b >> 1.
            data = (held[:, s : e + 1] >> 1).tobytes()
            ends = [bits for _, bits in _end_runs(b - a - len(held), FIRST_TABLE)]
            scan([(c + 1, 0x00)], s, e, 0, 1, data + (_packed(np.concatenate(ends)) if ends else b""))
    for c, (a, b) in enumerate(bounds):
        held = raw[a : min(b, blocks), 1:]
        low = (held & 1) ^ (held < 128)  # the last bit of the magnitude
        bits, at = [], 0
        for run, code in _end_runs(b - a, REFINE_TABLE):
            bits += [code, low[at : at + run].reshape(-1)]
            at += run
        scan([(c + 1, 0x01)], 1, 63, 1, 0, _packed(np.concatenate(bits)))
    scan([(1, 0x00), (2, 0x00), (3, 0x00)], 0, 0, 1, 0, _packed((dc[order] & 1).astype(np.uint8)))
    return b"".join([*out, b"\xff\xd9"])


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0  # in blocks, as far as single-component scans go
    high: int = 0
    stored_wide: int = 0  # in blocks, rounded up to whole MCUs
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


class _Bits:
    """Bits of one restart interval; past the end, ones."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.n = len(self.bits)
        self.at = 0
        self._bytes = self.bits.tobytes()

    def read(self, n: int) -> int:
        out = 0
        for bit in self._bytes[self.at : self.at + n]:
            out = out << 1 | bit
        self.at += n
        return out

    def symbol(self, table: Huffman) -> int:
        code, bits, at = 0, self._bytes, self.at
        for length in range(1, table.longest + 1):
            if at >= self.n:
                raise ValueError("entropy-coded data ends early")
            code = code << 1 | bits[at]
            at += 1
            found = table.by_code.get((length, code))
            if found is not None:
                self.at = at
                return found
        raise ValueError("no such code")

    def take(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("entropy-coded data ends early")
        self.at += n
        return out


def _extend(bits: int, size: int) -> int:
    return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1


def _first_band(bits: _Bits, table: Huffman, plane: np.ndarray, places: np.ndarray, start: int, end: int, low: int) -> None:
    """A first AC scan over the blocks at ``places``: fills plane[place, start..end]."""
    span = end - start + 1
    flat, total = 0, len(places) * span
    wait = 0
    powers = None
    while flat < total:
        if table.stride and wait == 0:
            length, size = table.stride
            step = length + size
            most = min(total - flat, (bits.n - bits.at) // step)
            if most > 0:
                lane = bits.bits[bits.at : bits.at + most * step].reshape(most, step)
                wrong = lane[:, :length].any(axis=1) if length > 1 else lane[:, 0] != 0  # the first code is all zeros
                good = int(wrong.argmax()) if wrong.any() else most
                if good:
                    powers = 1 << np.arange(size - 1, -1, -1) if powers is None else powers
                    value = lane[:good, length:] @ powers
                    value = np.where(lane[:good, length] == 1, value, value - (1 << size) + 1) << low
                    where = np.arange(flat, flat + good)
                    plane[places[where // span], start + where % span] = value
                    bits.at += good * step
                    flat += good
                    if flat >= total:
                        return
            wait = 64
        symbol = bits.symbol(table)
        run, size = symbol >> 4, symbol & 15
        wait -= wait > 0
        if size:
            flat += run
            if flat >= total or (flat - run) // span != flat // span:
                raise ValueError("a run leaves its block")
            plane[places[flat // span], start + flat % span] = _extend(bits.read(size), size) * (1 << low)
            flat += 1
        elif run == 15:
            flat += 16
        else:
            flat = (flat // span + (1 << run) + bits.read(run)) * span
    if flat > total and (flat - total) % span:
        raise ValueError("a run leaves the scan")


def _refine_band(bits: _Bits, table: Huffman, plane: np.ndarray, places: np.ndarray, start: int, end: int, low: int) -> None:
    """A later AC scan: corrects known coefficients by one bit and adds new ones."""
    one = 1 << low

    def correct(rows: np.ndarray, row: np.ndarray) -> None:
        known = row != 0
        n = int(known.sum())
        if n:
            fix = bits.take(n).astype(row.dtype) * one
            old = row[known]
            row[known] = old + np.sign(old) * fix
        plane[rows, start : end + 1] = row

    block = 0
    while block < len(places):
        row = plane[places[block], start : end + 1]
        k, ended = 0, 0
        while k <= end - start:
            symbol = bits.symbol(table)
            run, size = symbol >> 4, symbol & 15
            if size == 0 and run < 15:
                ended = (1 << run) + bits.read(run)
                break
            new = (one if bits.read(1) else -one) if size else 0
            while k <= end - start:
                if row[k]:
                    if bits.read(1):
                        row[k] += one if row[k] > 0 else -one
                else:
                    if run == 0:
                        break
                    run -= 1
                k += 1
            if new and k <= end - start:
                row[k] = new
            k += 1
        if ended:
            rest = row[k:]
            known = np.flatnonzero(rest)
            if len(known):
                fix = bits.take(len(known)).astype(row.dtype) * one
                rest[known] += np.sign(rest[known]) * fix
            block += 1
            if ended > 1:
                rows = places[block : block + ended - 1]
                correct(rows, plane[rows, start : end + 1])
                block += ended - 1
        else:
            block += 1


def _dc_scan(bits: _Bits, tables: list[Huffman], which: list[int], planes: list[np.ndarray], places: list[int], high: int, low: int) -> None:
    """DC values of the blocks in scan order: differences at first, one more bit each later."""
    if high:
        fix = bits.take(len(which)).astype(np.int32) << low
        which, places = np.array(which), np.array(places)
        for c, plane in enumerate(planes):
            own = which == c
            plane[places[own], 0] |= fix[own]
        return
    last = [0] * len(planes)
    values: list[list[int]] = [[] for _ in planes]
    spots: list[list[int]] = [[] for _ in planes]
    symbol, read = bits.symbol, bits.read
    for c, place in zip(which, places):
        size = symbol(tables[c])
        if size:
            last[c] += _extend(read(size), size)
        values[c].append(last[c])
        spots[c].append(place)
    for plane, value, spot in zip(planes, values, spots):
        plane[spot, 0] = np.array(value, np.int32) << low


@lru_cache(maxsize=4096)
def _scan_order(shape: tuple[tuple[int, int, int], ...], wide: int, high: int) -> tuple[list[int], list[int]]:
    """(component, block) of an interleaved scan; shape: (h, v, stored blocks in a row) of its components."""
    row, col = np.mgrid[0:high, 0:wide]
    which, places = [], []
    for c, (h, v, stored) in enumerate(shape):
        for r in range(v):
            for k in range(h):
                which.append(np.full((high, wide), c))
                places.append((row * v + r) * stored + col * h + k)
    return np.stack(which, -1).reshape(-1).tolist(), np.stack(places, -1).reshape(-1).tolist()


def _frame(image: Image, body: bytes) -> tuple[int, int]:
    precision, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
    if precision != 8 or not image.height or not image.width or n not in (1, 3):
        raise ValueError("only 8-bit grey or three-component images")
    for k in range(n):
        ident, hv, quant = body[6 + 3 * k : 9 + 3 * k]
        image.components.append(Component(ident, hv >> 4, hv & 15, quant))
    h_max, v_max = max(c.h for c in image.components), max(c.v for c in image.components)
    wide, high = -(-image.width // (8 * h_max)), -(-image.height // (8 * v_max))
    for c in image.components:
        c.wide, c.high = -(-(-(-image.width * c.h // h_max)) // 8), -(-(-(-image.height * c.v // v_max)) // 8)
        c.stored_wide = wide * c.h
        c.coefficients = np.zeros((wide * c.h * high * c.v, 64), np.int32)
    return wide, high


def _entropy_end(data: bytes, at: int) -> tuple[int, list[tuple[int, int]]]:
    """Where the entropy-coded data at ``at`` ends, and the bounds of its restart intervals."""
    parts, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("no end of image")
        mark = data[at + 1]
        if mark == 0 or mark == 0xFF:
            at += 2 if mark == 0 else 1
        elif 0xD0 <= mark <= 0xD7:
            parts.append((start, at))
            at = start = at + 2
        else:
            return at, [*parts, (start, at)]


def decode_coefficients(data: bytes) -> Image:
    """All scans of a progressive file, accumulated; ValueError for anything else or for damage."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, tables, at, every = Image(), {}, 2, 0
    units = (0, 0)
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("no marker")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            return image
        (size,) = struct.unpack(">H", data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xFE:
            image.comments.append(body)
        elif mark == 0xDB:
            while body:
                wide, ident = body[0] >> 4, body[0] & 15
                image.quant[ident] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xDD:
            (every,) = struct.unpack(">H", body[:2])
        elif mark == 0xC2:
            units = _frame(image, body)
        elif 0xC0 <= mark <= 0xCF:
            raise ValueError("not a progressive Huffman-coded image")
        elif mark == 0xDA:
            n = body[0]
            chosen = [(next(c for c in image.components if c.ident == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
            start, end, approx = body[1 + 2 * n : 4 + 2 * n]
            high, low = approx >> 4, approx & 15
            stop, parts = _entropy_end(data, at)
            if n > 1:
                which, places = _scan_order(tuple((c.h, c.v, c.stored_wide) for c, _ in chosen), *units)
                per_unit = sum(c.h * c.v for c, _ in chosen)
            else:
                c = chosen[0][0]
                places = (np.arange(c.high)[:, None] * c.stored_wide + np.arange(c.wide)).reshape(-1)
                which, per_unit = [0] * len(places), 1
            step = every * per_unit or len(places)
            for k, (a, b) in enumerate(parts):
                bits, piece = _Bits(data[a:b]), places[k * step : (k + 1) * step]
                if start == 0:
                    _dc_scan(bits, [tables.get(t >> 4) for _, t in chosen], which[k * step : (k + 1) * step], [c.coefficients for c, _ in chosen], list(piece), high, low)
                else:
                    (_refine_band if high else _first_band)(bits, tables[0x10 | chosen[0][1] & 15], chosen[0][0].coefficients, piece, start, end, low)
            at = stop


def rgb(image: Image) -> np.ndarray:
    """Height x width x 3 samples: dequantised, transformed back, chroma repeated to full size, converted."""
    basis = _basis()
    planes = []
    h_max, v_max = max(c.h for c in image.components), max(c.v for c in image.components)
    for c in image.components:
        natural = np.zeros((len(c.coefficients), 64))
        natural[:, zigzag()] = c.coefficients * image.quant[c.quant]
        blocks = (basis.T @ natural.reshape(-1, 8, 8)) @ basis
        rows = len(blocks) // c.stored_wide
        plane = np.clip(np.rint(blocks.reshape(rows, c.stored_wide, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, -1) + 128), 0, 255)
        if h_max != c.h or v_max != c.v:
            plane = plane.repeat(v_max // c.v, axis=0).repeat(h_max // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, b, r = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((image.height, image.width, 3), np.uint8)
    out[..., 0] = np.clip(np.rint(y + 1.402 * r), 0, 255)
    out[..., 1] = np.clip(np.rint(y - 0.344136 * b - 0.714136 * r), 0, 255)
    out[..., 2] = np.clip(np.rint(y + 1.772 * b), 0, 255)
    return out


def padded(raw: bytes) -> bytes:
    return raw + b"\x00" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def stored_payload(image: Image) -> tuple[int, bytes]:
    """(length before padding, payload) of a file that ``encode`` made."""
    word, n_bytes, blocks = image.comments[0].split()
    if word != b"payload":
        raise ValueError("no payload")
    values = np.concatenate([c.coefficients for c in image.components])[: int(blocks)]
    return int(n_bytes), np.where(values >= 128, values, values + 255).astype(np.uint8).tobytes()


def feature(tensor: np.ndarray) -> str:
    """Size, channel means (hundredths), and shares (per mille) of dark and bright samples of an RGB tensor."""
    means = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 100 // (tensor.shape[0] * tensor.shape[1])
    dark, bright = int((tensor < 64).sum()) * 1000 // tensor.size, int((tensor >= 192).sum()) * 1000 // tensor.size
    return f"{tensor.shape[0]}x{tensor.shape[1]};{means[0]},{means[1]},{means[2]};{dark},{bright}"


def encode_column(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every whole text as a progressive JPEG; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                raws = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(padded(r), len(r)) for r in raws], pa.binary())], names=["doc_id", "media"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, media binary")


def decode_tensors(media: DataFrame) -> DataFrame:
    """(doc_id, height, width, rgb, error) of a media column: the tensor as height * width * 3 bytes.

    Null, damaged or other files give an error text and no tensor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("doc_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part, rows = batch.slice(start, 64), []
                for doc_id, value in zip(part.column(0).to_pylist(), part.column(1)):
                    try:
                        tensor = rgb(decode_coefficients(value.as_py() or b""))
                        rows.append({"doc_id": doc_id, "height": tensor.shape[0], "width": tensor.shape[1], "rgb": tensor.tobytes()})
                    except (ValueError, KeyError, IndexError, StopIteration, struct.error) as error:
                        rows.append({"doc_id": doc_id, "error": f"{type(error).__name__}: {error}"})
                yield pa.RecordBatch.from_pylist(rows, fields)

    return media.selectExpr("cast(doc_id as bigint) doc_id", "media").mapInArrow(tidy(run), "doc_id bigint, height int, width int, rgb binary, error string")


_DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_digests(media: DataFrame) -> DataFrame:
    """Digests and features of a media column that ``encode_column`` made, all from the bytes as read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(1):
                stored = value.as_py()
                image = decode_coefficients(stored)
                n_bytes, payload = stored_payload(image)
                rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(rgb(image))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[f.split()[0] for f in _DIGEST.split(", ")])

    return media.mapInArrow(tidy(run), _DIGEST)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every text.

    Texts are stored as media and read back from the stored bytes. Null texts count as empty (one block of zeros);
    null doc_ids and repeated rows are rows like any other, and equal texts give equal values. An empty table gives an
    empty result; other columns are ignored.
    """
    return media_digests(encode_column(docs))
