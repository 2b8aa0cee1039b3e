"""Media columns: progressive JPEG, written and read without an image library.

Reading: `decode` takes any progressive Huffman JPEG (8 bits, 1 to 4 components, any sampling factors, restart
intervals).  Its scans - DC and AC, first passes over a spectral band and refinements by one bit - accumulate into
one coefficient array per component.  `rgb` multiplies by the quantisers, inverts the transform as one matrix
product in numpy, repeats chroma samples up to full resolution, and converts to a height x width x 3 tensor.  All
arithmetic is on integers (the product runs in doubles that stay below 2 ** 53), so equal files give equal tensors.

Writing: `encode_payload` stores bytes without loss in the format's unit, the quantised coefficient: each 64 bytes are
one 8 x 8 block in zigzag order, six blocks are one 4:2:0 unit (four of Y, Cb, Cr), and a byte b is the
coefficient b - 122 up to 120 and b - 119 beyond, so that no coefficient is 0 or +-1.  The image is filled up to whole
units with bytes 0; a comment segment tells the lengths.  Scans: DC without its last bit, Y 1-5, Cb, Cr, Y 6-63 without
the last bit, then the last bits.  The Huffman codes give every first-pass value the same total length (code and
extra bits: 8 for text), which keeps the file's bytes in step with the payload's - it compresses well in Parquet -
and lets the reader take a whole scan through one table lookup; other files are read bit by bit.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal files; a null file decodes to null fields;
a broken file raises ValueError; an empty table gives an empty one.  One map to write, one to read; memory is one slice.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, ensure_columns, new_path, slices, utf8, with_columns

MAGIC = b"seqweave"
MOST_UNITS = 4095  # of 16 samples, in a row of an image of at most 65,535


@lru_cache
def zigzag() -> np.ndarray:
    """For each zigzag index the row-major place in the block: anti-diagonals, taken up and down in turn."""
    cells = [(r + c, (r if (r + c) % 2 else c), r * 8 + c) for r in range(8) for c in range(8)]
    return np.array([place for *_, place in sorted(cells)])


@lru_cache
def basis() -> np.ndarray:
    """The inverse transform of zigzag-ordered coefficients to row-major samples, times 2 ** 20 and rounded."""
    u, x = np.mgrid[0:8, 0:8]
    one = np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.rint(np.einsum("ax,by->abxy", one, one).reshape(64, 64)[zigzag()] * 2**20)


# ---------------------------------------------------------------- Huffman tables


class Table:
    """A Huffman table: code lengths' counts and symbols, as a DHT segment has them."""

    def __init__(self, counts: bytes, symbols: bytes, ac: bool):
        self.codes: dict[tuple[int, int], int] = {}
        self.of: dict[int, tuple[int, int]] = {}
        code, k = 0, 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                self.codes[length, code] = symbols[k]
                self.of[symbols[k]] = (length, code)
                code, k = code + 1, k + 1
            code <<= 1
        totals = {length + (s & 15 if ac else s) for s, (length, _) in self.of.items()}
        plain = not ac or all(s >> 4 == 0 and s for s in self.of)
        self.total = totals.pop() if plain and len(totals) == 1 and max(totals, default=0) <= 16 else 0
        self.values = self.lookup() if 0 < self.total <= 16 else None

    def lookup(self) -> np.ndarray:
        """The value of each word of `total` bits; a word that no value has is 1 << 30."""
        out = np.full(1 << self.total, 1 << 30, np.int64)
        for size, (_, code) in self.of.items():
            extra = np.arange(1 << size)
            out[(code << size) + extra] = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra) if size else 0
        return out

    def words(self) -> dict[int, int]:
        return {int(v): k for k, v in enumerate(self.values) if v != 1 << 30}


@lru_cache(256)
def table(counts: bytes, symbols: bytes, ac: bool) -> Table:
    return Table(counts, symbols, ac)


@lru_cache
def even_table(least: int, most: int, ac: bool) -> tuple[bytes, bytes, np.ndarray, int]:
    """Counts, symbols, words by value + 1024, and bits: a table that gives all sizes least..most the same total length."""
    total = most + 1 if ac or least else most + 1
    total = max(total, 8)
    counts = bytearray(16)
    for size in range(least, most + 1):
        counts[total - size - 1] += 1
    symbols = bytes(range(most, least - 1, -1))
    made = table(bytes(counts), symbols, ac)
    words = np.zeros(2049, np.int64)
    for value, word in made.words().items():
        words[value + 1024] = word
    return bytes(counts), symbols, words, total


# ---------------------------------------------------------------- writing


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def packed(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes: filled up with ones, FF stuffed."""
    fill = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(fill, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


def coded(values: np.ndarray, words: np.ndarray, total: int) -> bytes:
    w = words[values + 1024]
    if total == 8:
        return w.astype(np.uint8).tobytes().replace(b"\xff", b"\xff\x00")
    return packed(((w[:, None] >> np.arange(total - 1, -1, -1)) & 1).astype(np.uint8).ravel())


def size_of(most: int) -> int:
    return int(most).bit_length()


def scan(components: list[int], tables: int, start: int, end: int, high: int, low: int) -> bytes:
    picks = b"".join(bytes([c, tables]) for c in components)
    return segment(0xDA, bytes([len(components)]) + picks + bytes([start, end, high << 4 | low]))


#: Symbols of end-of-band runs 0 to 14, four bits each; runs of 2 ** n blocks and up.
RUN_COUNTS, RUN_SYMBOLS = bytes([0, 0, 0, 15, *[0] * 12]), bytes(n << 4 for n in range(15))


def last_bits(blocks: np.ndarray) -> bytes:
    """A refinement of blocks (n, 63) without zeros: runs of blocks with their correction bits."""
    out, at = [], 0
    while at < len(blocks):
        run = min(len(blocks) - at, 32767)
        n = run.bit_length() - 1
        head = [(n >> k) & 1 for k in (3, 2, 1, 0)] + [((run - (1 << n)) >> k) & 1 for k in range(n - 1, -1, -1)]
        out += [np.array(head, np.uint8), (np.abs(blocks[at : at + run]) & 1).astype(np.uint8).ravel()]
        at += run
    return packed(np.concatenate(out))


def encode_payload(payload: bytes | memoryview, n_bytes: int) -> bytes:
    """A progressive JPEG that holds payload, of which n_bytes are content."""
    n = len(payload)
    if not n or n % 64:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    units = -(-n // 384)
    tall = -(-units // MOST_UNITS)
    wide = -(-units // tall)
    raw = np.zeros(tall * wide * 384, np.int64)
    raw[:n] = np.frombuffer(payload, np.uint8)
    value = np.where(raw <= 120, raw - 122, raw - 119).reshape(-1, 6, 64)
    luma = value[:, :4].reshape(tall, wide, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    planes = [luma, value[:, 4], value[:, 5]]
    dc = value[:, :, 0] >> 1
    steps = np.empty_like(dc)
    for part in (slice(0, 4), slice(4, 5), slice(5, 6)):
        line = dc[:, part].ravel()
        steps[:, part] = np.diff(line, prepend=0).reshape(len(dc), -1)
    half = [np.sign(p) * (np.abs(p) >> 1) for p in planes]
    dc_counts, dc_symbols, dc_words, dc_bits = even_table(0, max(7, size_of(np.abs(steps).max())), False)
    ac_counts, ac_symbols, ac_words, ac_bits = even_table(1, max(6, size_of(max(np.abs(h).max() for h in half))), True)
    frame = struct.pack(">BHHB", 8, tall * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [
        b"\xff\xd8", segment(0xFE, MAGIC + struct.pack(">QQ", n_bytes, n)), segment(0xDB, b"\x00" + b"\x01" * 64), segment(0xC2, frame),
        segment(0xC4, b"\x00" + dc_counts + dc_symbols + b"\x10" + ac_counts + ac_symbols + b"\x11" + RUN_COUNTS + RUN_SYMBOLS),
        scan([1, 2, 3], 0, 0, 0, 0, 1), coded(steps.ravel(), dc_words, dc_bits),
    ]
    for c, start, end in ((1, 1, 5), (2, 1, 63), (3, 1, 63), (1, 6, 63)):
        out += [scan([c], 0, start, end, 0, 1), coded(half[c - 1][:, start : end + 1].ravel(), ac_words, ac_bits)]
    out += [scan([1, 2, 3], 0, 0, 0, 1, 0), packed((value[:, :, 0] & 1).astype(np.uint8).ravel())]
    for c in (1, 2, 3):
        out += [scan([c], 1, 1, 63, 1, 0), last_bits(planes[c - 1][:, 1:])]
    return b"".join([*out, b"\xff\xd9"])


# ---------------------------------------------------------------- reading


@dataclass
class Component:
    name: int
    across: int
    down: int
    quantiser: int
    wide: int = 0  # blocks in a row, without the fill of interleaved scans
    tall: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int64))


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


class Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | b
        if self.at + n > len(self.bits):
            raise ValueError("a scan ends early")
        self.at += n
        return out

    def symbol(self, t: Table) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := t.codes.get((length, code))) is not None:
                return found
        raise ValueError("a code that the table does not have")

    def value(self, size: int) -> int:
        x = self.take(size)
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


def decode(data: bytes) -> Image:
    """The image of a progressive JPEG, with all scans accumulated."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, tables, interval, at = Image(), {}, 0, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        (length,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC2:
            frame(image, body)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a progressive Huffman JPEG")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = table(body[1:17], body[17 : 17 + n], bool(body[0] >> 4))
                body = body[17 + n :]
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            end = at
            while True:  # up to a marker that is no stuffing and no restart
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("a scan does not end")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                else:
                    break
            read_scan(image, body, data[at:end], tables, interval)
            at = end
    if not image.components:
        raise ValueError("no frame")
    return image


def frame(image: Image, body: bytes) -> None:
    precision, image.height, image.width, n = struct.unpack_from(">BHHB", body)
    if precision != 8 or not image.height or not image.width:
        raise ValueError("only 8-bit images of known size")
    parts = [body[6 + 3 * k : 9 + 3 * k] for k in range(n)]
    image.components = [Component(p[0], p[1] >> 4, p[1] & 15, p[2]) for p in parts]
    across, down = max(c.across for c in image.components), max(c.down for c in image.components)
    units_wide, units_tall = -(-image.width // (8 * across)), -(-image.height // (8 * down))
    for c in image.components:
        c.wide, c.tall = -(-(-(-image.width * c.across // across)) // 8), -(-(-(-image.height * c.down // down)) // 8)
        c.coefficients = np.zeros((units_tall * c.down, units_wide * c.across, 64), np.int64)


def read_scan(image: Image, body: bytes, entropy: bytes, tables: dict[int, Table], interval: int) -> None:
    n = body[0]
    picks = [(next(c for c in image.components if c.name == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
    start, end, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    if start and n > 1:
        raise ValueError("an AC scan has one component")
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in restarts(entropy)]
    order = block_order(image, [c for c, _ in picks])
    per = len(order[0]) if n == 1 else sum(c.across * c.down for c, _ in picks)
    where, which = order
    step = (interval * (1 if n == 1 else per)) if interval else len(where)
    for k, piece in enumerate(pieces):
        part = slice(k * step, min((k + 1) * step, len(where)))
        rows, owner = where[part], which[part]
        if not len(rows):
            break
        if not start and high:
            dc_refine([c for c, _ in picks], rows, owner, piece, low)
        elif not start:
            dc_first([c for c, _ in picks], [tables[t >> 4] for _, t in picks], rows, owner, piece, low)
        else:
            c, t = picks[0]
            (ac_refine if high else ac_first)(c.coefficients.reshape(-1, 64), tables[16 + (t & 15)], rows, piece, start, end, low)


def restarts(entropy: bytes) -> list[bytes]:
    out, at, begin = [], 0, 0
    while (at := entropy.find(b"\xff", at)) >= 0:
        if at + 1 < len(entropy) and 0xD0 <= entropy[at + 1] <= 0xD7:
            out.append(entropy[begin:at])
            begin = at + 2
        at += 2
    return [*out, entropy[begin:]]


def block_order(image: Image, components: list[Component]) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of a scan in order: place in the component's array, and which component."""
    if len(components) == 1:
        c = components[0]
        return (np.arange(c.tall)[:, None] * c.coefficients.shape[1] + np.arange(c.wide)).ravel(), np.zeros(c.tall * c.wide, np.int64)
    tall, wide = components[0].coefficients.shape[0] // components[0].down, components[0].coefficients.shape[1] // components[0].across
    rows, owners = [], []
    for k, c in enumerate(components):
        y = np.arange(tall)[:, None, None, None] * c.down + np.arange(c.down)[None, None, :, None]
        x = np.arange(wide)[None, :, None, None] * c.across + np.arange(c.across)[None, None, None, :]
        rows.append((y * c.coefficients.shape[1] + x).reshape(tall * wide, -1))
        owners.append(np.full(rows[-1].shape, k))
    return np.concatenate(rows, 1).ravel(), np.concatenate(owners, 1).ravel()


def even_values(piece: bytes, t: Table, n: int) -> np.ndarray:
    """n values of a table whose values have all the same total length."""
    if len(piece) * 8 < n * t.total:
        raise ValueError("a scan ends early")
    if t.total == 8:
        words = np.frombuffer(piece, np.uint8, n)
    else:
        words = np.unpackbits(np.frombuffer(piece, np.uint8), count=n * t.total).reshape(n, t.total) @ (1 << np.arange(t.total - 1, -1, -1))
    out = t.values[words]
    if (out == 1 << 30).any():
        raise ValueError("a code that the table does not have")
    return out


def dc_first(components: list[Component], tables: list[Table], rows: np.ndarray, owner: np.ndarray, piece: bytes, low: int) -> None:
    if all(t is tables[0] for t in tables) and tables[0].values is not None:
        steps = even_values(piece, tables[0], len(rows))
    else:
        bits = Bits(piece)
        steps = np.array([bits.value(bits.symbol(tables[k])) for k in owner.tolist()], np.int64)
    for k, c in enumerate(components):
        mine = owner == k
        c.coefficients.reshape(-1, 64)[rows[mine], 0] = np.cumsum(steps[mine]) << low


def dc_refine(components: list[Component], rows: np.ndarray, owner: np.ndarray, piece: bytes, low: int) -> None:
    if len(piece) * 8 < len(rows):
        raise ValueError("a scan ends early")
    bits = np.unpackbits(np.frombuffer(piece, np.uint8), count=len(rows)).astype(np.int64) << low
    for k, c in enumerate(components):
        mine = owner == k
        c.coefficients.reshape(-1, 64)[rows[mine], 0] |= bits[mine]


def ac_first(blocks: np.ndarray, t: Table, rows: np.ndarray, piece: bytes, start: int, end: int, low: int) -> None:
    width = end + 1 - start
    if t.values is not None:
        values = even_values(piece, t, len(rows) * width)
        blocks[rows, start : end + 1] = (values << low).reshape(-1, width)
        return
    bits, run = Bits(piece), 0
    for row in rows.tolist():
        if run:
            run -= 1
            continue
        k = start
        while k <= end:
            r, size = divmod(bits.symbol(t), 16)
            if size:
                k += r
                if k > end:
                    raise ValueError("a run leaves its band")
                blocks[row, k] = bits.value(size) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) - 1 + (bits.take(r) if r else 0)
                break


def correct(block: np.ndarray, at: np.ndarray, bits: np.ndarray, low: int) -> None:
    """Add a bit to the magnitude of the coefficients at the places `at`."""
    block[at] += np.sign(block[at]) * (bits.astype(np.int64) << low)


def ac_refine(blocks: np.ndarray, t: Table, rows: np.ndarray, piece: bytes, start: int, end: int, low: int) -> None:
    bits, n = Bits(piece), 0
    while n < len(rows):
        row, k = rows[n], start
        while k <= end:
            r, size = divmod(bits.symbol(t), 16)
            if not size and r < 15:
                # An end of band: what is not zero from here on, in this block and the run's others, gets one bit each.
                run = min((1 << r) + (bits.take(r) if r else 0), len(rows) - n)
                part = blocks[rows[n : n + run], start : end + 1]
                live = part != 0
                live[0, : k - start] = False
                count = int(live.sum())
                got = bits.bits[bits.at : bits.at + count]
                if len(got) < count:
                    raise ValueError("a scan ends early")
                bits.at += count
                part[live] += np.sign(part[live]) * (got.astype(np.int64) << low)
                blocks[rows[n : n + run], start : end + 1] = part
                n += run - 1
                break
            new = (1 if bits.take(1) else -1) * (1 << low) if size else 0
            while k <= end:
                if blocks[row, k]:
                    if bits.take(1):
                        blocks[row, k] += (1 << low) * (1 if blocks[row, k] > 0 else -1)
                elif r:
                    r -= 1
                else:
                    blocks[row, k] = new
                    k += 1
                    break
                k += 1
        n += 1


def plane(image: Image, c: Component) -> np.ndarray:
    """The samples of a component, 0 to 255, of its whole block array."""
    tall, wide, _ = c.coefficients.shape
    scaled = (c.coefficients.reshape(-1, 64) * image.quantisers[c.quantiser]).astype(np.float64) @ basis()
    scaled *= 2.0**-20  # exact, as is the sum: the integers above have less than 40 bits
    scaled += 128.5
    np.clip(np.floor(scaled, out=scaled), 0, 255, out=scaled)
    return scaled.astype(np.int32).reshape(tall, wide, 8, 8).transpose(0, 2, 1, 3).reshape(tall * 8, wide * 8)


def rgb(image: Image) -> np.ndarray:
    """The full-resolution tensor, height x width x 3, 8 bits."""
    across, down = max(c.across for c in image.components), max(c.down for c in image.components)
    full = []
    for c in image.components[:3]:
        p = plane(image, c)
        for axis, own, most, size in ((0, c.down, down, image.height), (1, c.across, across, image.width)):
            if most % own == 0:
                p = p if most == own else np.repeat(p, most // own, axis)
            else:
                p = np.take(p, np.arange(size) * own // most, axis)
        full.append(p[: image.height, : image.width])
    out = np.empty((image.height, image.width, 3), np.uint8)
    if len(full) < 3:
        out[:] = full[0][:, :, None]
        return out
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    half = 1 << 15  # fixed point with 16 bits
    out[:, :, 0] = np.clip(y + ((91881 * cr + half) >> 16), 0, 255)
    out[:, :, 1] = np.clip(y - ((22554 * cb + 46802 * cr + half) >> 16), 0, 255)
    out[:, :, 2] = np.clip(y + ((116130 * cb + half) >> 16), 0, 255)
    return out


def payload(image: Image) -> tuple[bytes, int]:
    """The payload and the length of its content, from the coefficients of an image of encode_payload."""
    head = next((c for c in image.comments if c[: len(MAGIC)] == MAGIC), None)
    if head is None:
        raise ValueError("the image holds no payload")
    n_bytes, n = struct.unpack(">QQ", head[len(MAGIC) :])
    luma, cb, cr = (c.coefficients for c in image.components)
    tall, wide, _ = cb.shape
    value = np.concatenate([luma.reshape(tall, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64), cb.reshape(-1, 1, 64), cr.reshape(-1, 1, 64)], 1).ravel()[:n]
    return np.where(value < 0, value + 122, value + 119).astype(np.uint8).tobytes(), n_bytes


def features(tensor: np.ndarray) -> str:
    """Size, mean and deviation of each channel (from exact sums), and a checksum of the tensor."""
    h, w, _ = tensor.shape
    flat = tensor.reshape(-1, 3)
    total = flat.sum(0, dtype=np.int64).tolist()
    square = np.einsum("ij,ij->j", flat, flat, dtype=np.int64).tolist()
    mean = [t / (h * w) for t in total]
    spread = [max(0.0, q / (h * w) - m * m) ** 0.5 for q, m in zip(square, mean, strict=True)]
    return f"{h}x{w}x3 mean {' '.join(f'{m:.3f}' for m in mean)} deviation {' '.join(f'{s:.3f}' for s in spread)} crc32 {crc32(tensor.tobytes()):08x}"


# ---------------------------------------------------------------- columns


def with_media(docs: DataFrame, text: str = "text", media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but the text by default) with the image that holds the text's UTF-8."""
    ensure_columns(docs, text)
    keep = [c for c in docs.columns if c not in (text, media)] if keep is None else keep
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
            raw, files = data.tobytes(), []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                files.append(encode_payload(raw[a:b] + bytes(-(b - a) % 64 or (0 if b > a else 64)), b - a))
            yield with_columns(batch, keep, {media: pa.array(files, pa.binary())})

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(media, T.BinaryType())])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decoded(rows: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """keep with height, width and tensor (row-major RGB bytes at full resolution) of the images in `media`."""
    ensure_columns(rows, media)
    new = T._parse_datatype_string("height int, width int, tensor binary").fields
    keep = [c for c in rows.columns if c != media and c not in {f.name for f in new}] if keep is None else keep
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one image at a time: a tensor is much larger than its file
                one = batch.slice(k, 1)
                file = one.column(one.schema.get_field_index(media))[0].as_py()
                tensor = None if file is None else rgb(decode(file))
                height, width = (None, None) if tensor is None else tensor.shape[:2]
                yield with_columns(one, keep, {"height": pa.array([height], pa.int32()), "width": pa.array([width], pa.int32()), "tensor": pa.array([None if tensor is None else tensor.tobytes()], pa.binary())})

    return rows.select(*dict.fromkeys([*keep, media])).mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + new))


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(rows: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """keep with what the images in `media` hold: lengths and sums of the payload and the file, and features of the tensor."""
    ensure_columns(rows, media)
    new = T._parse_datatype_string(DIGEST).fields
    keep = [c for c in rows.columns if c != media and c not in {f.name for f in new}] if keep is None else keep
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in new]
            for file in batch.column(batch.schema.get_field_index(media)).to_pylist():
                found = [None] * len(new)
                if file is not None:
                    image = decode(file)
                    held, n_bytes = payload(image)
                    found = [n_bytes, len(held), hashlib.sha256(held).hexdigest(), crc32(held[-64:]), len(file), hashlib.sha256(file).hexdigest(), features(rgb(image))]
                for column, x in zip(out, found, strict=True):
                    column.append(x)
            kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in new]
            yield with_columns(batch, keep, {f.name: pa.array(x, k) for f, x, k in zip(new, out, kinds, strict=True)})

    return rows.select(*dict.fromkeys([*keep, media])).mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + new))


def stored_media(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """with_media, written as Parquet (zstandard) under `path` (default: a new one in the shared folder) and read back."""
    made = with_media(docs, text, keep=keep)
    path = path or new_path(docs.sparkSession, "media")
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)
