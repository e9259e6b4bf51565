"""Media columns: progressive JPEG, decoded in numpy to full-resolution RGB tensors.

``decode`` reads any 8-bit progressive (or sequential Huffman) JPEG with one to three components: it
accumulates the spectral-selection and successive-approximation scans into coefficient arrays,
inverse-transforms all blocks with one matrix product, upsamples chroma and converts to RGB.

``encode_payload`` stores bytes in such an image without loss.  The unit is the quantised AC
coefficient: size category 8 of the format holds exactly 256 values, one for each byte.  A first scan
carries the upper seven bits of every coefficient (successive approximation, low bit 1) and a
refinement scan the last bit, each split in two spectral bands, for each component.  Codes of a scan
with a one-symbol table all have the same length, so both directions work on whole arrays.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A payload is padded with bytes 255 to a positive multiple of this.
GRANULE = 576
#: AC coefficients of a block, and blocks of a 4:2:0 unit (four of luma, one of each chroma).
AC, UNIT_BLOCKS = 63, 6
MAX_SIDE = 4095  # units of 16 pixels in a row; 65,520 pixels

# Zigzag order of an 8x8 block, by the rule of the format: diagonals in turn, alternating direction.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))])


def _basis() -> np.ndarray:
    """The inverse transform of a zigzag-ordered block as a 64 x 64 matrix."""
    u = np.arange(8)
    one = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) / 2
    one[:, 0] = 1 / np.sqrt(8)
    both = np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)
    return both[ZIGZAG]


BASIS = _basis().astype(np.float32)


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % GRANULE if data else GRANULE)


# ---- reading -----------------------------------------------------------------------------------


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    rows: int = 0  # blocks that non-interleaved scans hold
    cols: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int16))


class Codes:
    """A Huffman table: lookup by 16 bits, and the one symbol of a table that has no other."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.lengths, self.symbols = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
        code, at = 0, 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                low = code << (16 - length)
                self.lengths[low : low + (1 << (16 - length))] = length
                self.symbols[low : low + (1 << (16 - length))] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.only = (symbols[0], next(n + 1 for n in range(16) if counts[n])) if len(symbols) == 1 else None


@functools.lru_cache(maxsize=64)
def _codes(counts: bytes, symbols: bytes) -> Codes:
    return Codes(counts, symbols)


class Bits:
    """Bits of one restart interval, most significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0\0\0\0", 0, 8 * len(data)

    def peek16(self) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 3], "big") >> (8 - (self.at & 7))) & 0xFFFF if i + 3 <= len(self.data) else 0

    def get(self, n: int) -> int:
        if not n:
            return 0
        value = self.peek16() >> (16 - n)
        self.at += n
        return value

    def symbol(self, codes: Codes) -> int:
        at = self.peek16()
        n = int(codes.lengths[at])
        if not n or self.at >= self.end:
            raise ValueError("the entropy-coded data are damaged")
        self.at += n
        return int(codes.symbols[at])

    def signed(self, n: int) -> int:
        value = self.get(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comments: list[bytes]


def _uniform_first(codes: Codes, low: int, band: int, blocks: int, data: bytes) -> np.ndarray | None:
    """A first AC scan of one-symbol codes without runs: all coefficients at once, or None."""
    if codes.only is None or codes.only[0] >> 4 or not codes.only[0]:
        return None
    (size, length), n = codes.only, blocks * band
    if (n * (length + size) + 7) // 8 != len(data):
        return None
    if length + size == 8:
        raw = np.frombuffer(data, np.uint8).astype(np.int16) & ((1 << size) - 1)
    else:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * (length + size)).reshape(n, -1)[:, length:]
        raw = (bits.astype(np.int32) @ (1 << np.arange(size)[::-1])).astype(np.int16)
    negative = raw < (1 << (size - 1))
    return ((raw - negative * np.int16((1 << size) - 1)) << low).reshape(blocks, band)


def _uniform_refine(codes: Codes, old: np.ndarray, low: int, data: bytes) -> np.ndarray | None:
    """A refinement scan that is one end-of-band run over nonzero coefficients, or None."""
    blocks, band = old.shape
    if not old.all():
        return None
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    flags, at, done = [], 0, 0
    while done < blocks:
        reader = Bits(data[at // 8 : at // 8 + 8])
        reader.at = at % 8
        symbol = reader.symbol(codes)
        if symbol & 15 or symbol >> 4 == 15:
            return None
        run = (1 << (symbol >> 4)) + reader.get(symbol >> 4)
        at = at // 8 * 8 + reader.at
        run = min(run, blocks - done)
        flags.append(bits[at : at + run * band])
        at, done = at + run * band, done + run
    plus = (flags[0] if len(flags) == 1 else np.concatenate(flags)).reshape(blocks, band).astype(np.int16) << low
    return old + plus * ((old > 0) * np.int16(2) - np.int16(1))


def _first(block: np.ndarray, bits: Bits, codes: Codes, ss: int, se: int, low: int, run: int) -> int:
    """One block of a first AC scan; returns the end-of-band run that is left."""
    if run:
        return run - 1
    k = ss
    while k <= se:
        symbol = bits.symbol(codes)
        skip, size = symbol >> 4, symbol & 15
        if size:
            k += skip
            block[k] = bits.signed(size) * (1 << low)
            k += 1
        elif skip == 15:
            k += 16
        else:
            return (1 << skip) + bits.get(skip) - 1
    return 0


def _refine(block: np.ndarray, bits: Bits, codes: Codes, ss: int, se: int, low: int, run: int) -> int:
    """One block of a refining AC scan."""
    one, k = 1 << low, ss

    def correct(k: int) -> None:
        if bits.get(1) and not abs(int(block[k])) & one:
            block[k] += one if block[k] > 0 else -one

    while not run and k <= se:
        symbol = bits.symbol(codes)
        skip, size, value = symbol >> 4, symbol & 15, 0
        if size:
            value = one if bits.get(1) else -one
        elif skip < 15:
            run = (1 << skip) + bits.get(skip)
            break
        while k <= se:
            if block[k]:
                correct(k)
            elif skip:
                skip -= 1
            else:
                if value:
                    block[k] = value
                k += 1
                break
            k += 1
    if run:
        for k in range(k, se + 1):
            if block[k]:
                correct(k)
        return run - 1
    return 0


def _sequential(block: np.ndarray, bits: Bits, dc: Codes, ac: Codes, last: int) -> int:
    """One block of a sequential scan; returns its DC value."""
    last += bits.signed(bits.symbol(dc))
    block[0] = last
    k = 1
    while k < 64:
        symbol = bits.symbol(ac)
        skip, size = symbol >> 4, symbol & 15
        if size:
            k += skip
            block[k] = bits.signed(size)
            k += 1
        elif skip == 15:
            k += 16
        else:
            break
    return last


def _scan(image: Image, parts: list[tuple[Component, int, int]], tables: dict, restart: int, ss: int, se: int, high: int, low: int, data: bytes, progressive: bool) -> None:
    hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
    pieces = _intervals(data, restart)
    if len(parts) == 1 and not restart and len(pieces) == 1 and progressive:
        c, dc, ac = parts[0]
        view, n = c.coefficients[: c.rows, : c.cols], c.rows * c.cols
        if ss == 0 and not high and (codes := tables[0, dc]).only == (0, 1) and len(pieces[0]) == (n + 7) // 8:
            return  # every difference is zero
        if ss and not high and (got := _uniform_first(tables[1, ac], low, se - ss + 1, n, pieces[0])) is not None:
            view[:, :, ss : se + 1] = got.reshape(c.rows, c.cols, -1)
            return
        if ss and high and (got := _uniform_refine(tables[1, ac], view[:, :, ss : se + 1].reshape(n, -1), low, pieces[0])) is not None:
            view[:, :, ss : se + 1] = got.reshape(c.rows, c.cols, -1)
            return
    if len(parts) == 1:
        c, unit = parts[0][0], 1
        order = [(0, r, x) for r in range(c.rows) for x in range(c.cols)]
    else:
        across, down = -(-image.width // (8 * hmax)), -(-image.height // (8 * vmax))
        inner = [(i, r, x) for i, (c, *_) in enumerate(parts) for r in range(c.v) for x in range(c.h)]
        unit = len(inner)
        order = [(i, my * parts[i][0].v + r, mx * parts[i][0].h + x) for my in range(down) for mx in range(across) for i, r, x in inner]
    per = restart * unit if restart else len(order)
    for number, first in enumerate(range(0, len(order), per)):
        bits, last, run = Bits(pieces[number]), [0] * len(parts), 0
        for i, r, x in order[first : first + per]:
            c, dc, ac = parts[i]
            block = c.coefficients[r, x]
            if not progressive:
                last[i] = _sequential(block, bits, tables[0, dc], tables[1, ac], last[i])
            elif ss == 0:
                if high:
                    block[0] |= bits.get(1) << low
                else:
                    last[i] += bits.signed(bits.symbol(tables[0, dc]))
                    block[0] = last[i] << low
            else:
                run = (_refine if high else _first)(block, bits, tables[1, ac], ss, se, low, run)


_RESTART, _MARKER = re.compile(rb"\xff[\xd0-\xd7]"), re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)


def _intervals(data: bytes, restart: int) -> list[bytes]:
    """Restart intervals of a scan without stuffing."""
    return [x.replace(b"\xff\x00", b"\xff") for x in (_RESTART.split(data) if restart else [data])]


def read(data: bytes) -> Image:
    """All scans of an image, accumulated into its coefficient arrays."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, tables, restart, progressive, at = Image(0, 0, [], {}, []), {}, 0, True, 2
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        (n,) = struct.unpack(">H", data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker in (0xC0, 0xC1, 0xC2):
            progressive = marker == 0xC2
            image.height, image.width = struct.unpack(">HH", body[1:5])
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
            for c in image.components:
                c.cols, c.rows = -(-(-(-image.width * c.h // hmax)) // 8), -(-(-(-image.height * c.v // vmax)) // 8)
                c.coefficients = np.zeros((-(-image.height // (8 * vmax)) * c.v, -(-image.width // (8 * hmax)) * c.h, 64), np.int16)
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            by_id = {c.ident: c for c in image.components}
            parts = [(by_id[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            ss, se, both = body[-3:]
            if (end := _MARKER.search(data, at)) is None:
                raise ValueError("the image ends inside a scan")
            _scan(image, parts, tables, restart, ss, se, both >> 4, both & 15, data[at : end.start()], progressive)
            at = end.start()
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError(f"frame type {marker:#x} is not supported")
    return image


def planes(image: Image) -> list[np.ndarray]:
    """Each component inverse-transformed, at its own resolution."""
    out = []
    for c in image.components:
        rows, cols, _ = c.coefficients.shape
        pixels = (c.coefficients.reshape(-1, 64) * image.quant[c.table]) @ BASIS
        out.append(pixels.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8) + np.float32(128))
    return out


def rgb(image: Image) -> np.ndarray:
    """The full-resolution RGB tensor (height x width x 3, uint8)."""
    hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
    full = []
    for c, plane in zip(image.components, planes(image), strict=True):
        if c.v < vmax or c.h < hmax:
            plane = np.repeat(np.repeat(plane, vmax // c.v, axis=0), hmax // c.h, axis=1)
        full.append(plane[: image.height, : image.width])
    if len(full) == 1:
        full = full * 3
    else:
        y, cb, cr = full[0], full[1] - np.float32(128), full[2] - np.float32(128)
        full = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
    out = np.empty((image.height, image.width, 3), np.uint8)
    for i, x in enumerate(full):
        out[:, :, i] = np.clip(np.rint(x), 0, 255)
    return out


def decode(data: bytes) -> np.ndarray:
    return rgb(read(data))


# ---- bytes in coefficients ---------------------------------------------------------------------

_NOTE = b"payload "
#: (first, last) coefficient of the two spectral bands.
BANDS = ((1, 5), (6, 63))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int, slot: int, symbol: int) -> bytes:
    return bytes([kind << 4 | slot, 1, *[0] * 15, symbol])


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 image that holds the payload in its AC coefficients."""
    units = max(1, -(-len(payload) // (UNIT_BLOCKS * AC)))
    across = min(MAX_SIDE, int(np.ceil(np.sqrt(units))))
    down = -(-units // across)
    n = across * down
    data = np.full(n * UNIT_BLOCKS * AC, 255, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    data = data.reshape(-1, AC)
    parts = [data[: 4 * n], data[4 * n : 5 * n], data[5 * n :]]
    out = [b"\xff\xd8", _segment(0xFE, _NOTE + str(len(payload)).encode()), _segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # One-symbol tables: zero difference, a coefficient of seven bits, and 15 end-of-band runs.
    runs = bytes([1 << 4 | 1, 0, 0, 0, 15, *[0] * 12, *[r << 4 for r in range(15)]])
    out.append(_segment(0xC4, _one_code(0, 0, 0) + _one_code(1, 0, 7) + runs))

    def scan(ident: int, slot: int, ss: int, se: int, both: int, body: bytes) -> None:
        out.append(_segment(0xDA, bytes([1, ident, slot, ss, se, both])) + body.replace(b"\xff", b"\xff\x00"))

    for ident, blocks in enumerate(parts, 1):
        scan(ident, 0, 0, 0, 0, np.packbits(np.concatenate([np.zeros(len(blocks), np.uint8), np.ones(-len(blocks) % 8, np.uint8)])).tobytes())
    for ss, se in BANDS:
        for ident, blocks in enumerate(parts, 1):
            scan(ident, 0, ss, se, 1, (blocks[:, ss - 1 : se] >> 1).tobytes())
    for ss, se in BANDS:
        for ident, blocks in enumerate(parts, 1):
            # The last bit of the magnitude: the byte's own for positive values, else its complement.
            flags = (blocks[:, ss - 1 : se] & 1) ^ (blocks[:, ss - 1 : se] < 128)
            bits = []
            for first in range(0, len(flags), 32767):
                part = flags[first : first + 32767]
                r = len(part).bit_length() - 1
                head = f"{r:04b}" + (f"{len(part) - (1 << r):0{r}b}" if r else "")
                bits += [np.frombuffer(head.encode(), np.uint8) - 48, part.reshape(-1)]
            whole = np.concatenate(bits)
            scan(ident, 1, ss, se, 1 << 4, np.packbits(np.concatenate([whole, np.ones(-len(whole) % 8, np.uint8)])).tobytes())
    return b"".join([*out, b"\xff\xd9"])


def payload_of(image: Image) -> bytes:
    """The bytes that ``encode_payload`` stored, from the accumulated coefficients."""
    length = next(int(x[len(_NOTE) :]) for x in image.comments if x.startswith(_NOTE))
    values = np.concatenate([c.coefficients[:, :, 1:].reshape(-1) for c in image.components])[:length]
    return (values + (values < 0) * np.int16(255)).astype(np.uint8).tobytes()


# ---- columns -----------------------------------------------------------------------------------


def feature(tensor: np.ndarray) -> str:
    """Height, width, exact channel means and a checksum of the tensor."""
    sums = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    h, w, _ = tensor.shape
    return f"{h}x{w}:" + ",".join(f"{s / (h * w):.4f}" for s in sums) + f":{zlib.crc32(tensor):08x}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Every text as a media column: stored, read back, decoded to an RGB tensor and digested.

    With ``with_media`` the columns ``media`` (the image) and ``tensor`` (height, width and the RGB
    bytes) come too.  Null and empty texts store one granule of padding; equal texts give equal
    values; an empty table gives no rows; further columns are ignored.
    """
    schema = SCHEMA + (", media binary, tensor struct<height:int,width:int,rgb:binary>" if with_media else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])]
        names = [f.split()[0] for f in SCHEMA.split(", ")] + ["media", "tensor"] * with_media
        for batch in batches:
            ids, texts = common.column(batch, "doc_id").to_pylist(), common.utf8(batch, "text")
            for first, last in common.steps([len(x) for x in texts], 16 * common.STEP_BYTES):
                rows = []
                for doc_id, text in zip(ids[first:last], texts[first:last], strict=True):
                    media = encode_payload(pad(text))
                    image = read(media)
                    back, tensor = payload_of(image), rgb(image)
                    row = (doc_id, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(tensor))
                    rows.append(row + ((media, {"height": tensor.shape[0], "width": tensor.shape[1], "rgb": tensor.tobytes()}) if with_media else ()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
