"""Progressive JPEG: payload round trips, and the reader against a plain writer with all kinds of scans."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from seqweave.llm import media


class Writer:
    """Bits of an entropy-coded segment, written one by one."""

    def __init__(self, codes):
        self.bits, self.codes = [], codes

    def put(self, value, n):
        self.bits += [(value >> k) & 1 for k in range(n - 1, -1, -1)]

    def symbol(self, s):
        n, code = self.codes[s]
        self.put(code, n)

    def value(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def bytes(self):
        return media.packed(np.array(self.bits, np.uint8))


def flat_table(symbols):
    """A table in which all of up to 255 symbols have 8 bits."""
    return bytes([0] * 7 + [len(symbols)] + [0] * 8), bytes(symbols), {s: (8, k) for k, s in enumerate(symbols)}


DC = flat_table(range(12))
AC = flat_table([s for s in range(0xFB) if s & 15 <= 10])


def shifted(v, low):
    return int(np.sign(v)) * (abs(int(v)) >> low)


def ac_first(blocks, start, end, low):
    w, run = Writer(AC[2]), 0

    def flush():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            w.symbol(n << 4)
            w.put(run - (1 << n), n)
            run = 0

    for b in blocks:
        zeros, some = 0, [shifted(v, low) for v in b[start : end + 1]]
        last = max((k for k, v in enumerate(some) if v), default=-1)
        if last >= 0:
            flush()
        for v in some[: last + 1]:
            if not v:
                zeros += 1
                continue
            while zeros > 15:
                w.symbol(0xF0)
                zeros -= 16
            w.symbol(zeros << 4 | abs(v).bit_length())
            w.value(v)
            zeros = 0
        if last < end - start:
            run += 1
    flush()
    return w.bytes()


def ac_refine(blocks, start, end, low):
    """Each block ends with its own end of band."""
    w = Writer(AC[2])
    for b in blocks:
        band = [int(v) for v in b[start : end + 1]]
        now = [shifted(v, low) for v in band]
        last = max((k for k, v in enumerate(now) if abs(v) == 1), default=-1)
        zeros, waiting = 0, []
        for k, v in enumerate(now[: last + 1]):
            if not v:
                if zeros == 15 and k <= last:
                    w.symbol(0xF0)
                    w.bits += waiting
                    zeros, waiting = 0, []
                    continue
                zeros += 1
            elif abs(v) > 1:
                waiting.append(abs(v) & 1)
            else:
                w.symbol(zeros << 4 | 1)
                w.put(int(v > 0), 1)
                w.bits += waiting
                zeros, waiting = 0, []
        if last < len(now) - 1:
            w.symbol(0)
            w.bits += waiting + [abs(v) & 1 for v in now[last + 1 :] if abs(v) > 1]
    return w.bytes()


def jpeg(planes, width, height, sampling, restart=0):
    """planes: coefficient blocks (tall, wide, 64) of each component, whole units."""
    parts = b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling))
    out = [b"\xff\xd8", media.segment(0xDB, b"\x00" + bytes(range(1, 65))), media.segment(0xC2, struct.pack(">BHHB", 8, height, width, len(planes)) + parts)]
    out.append(media.segment(0xC4, b"\x00" + DC[0] + DC[1] + b"\x10" + AC[0] + AC[1]))
    if restart:
        out.append(media.segment(0xDD, struct.pack(">H", restart)))
    h0, v0 = max(h for h, _ in sampling), max(v for _, v in sampling)
    units = [(y, x) for y in range(-(-height // (8 * v0))) for x in range(-(-width // (8 * h0)))]
    if len(planes) == 1:
        units = [(y, x) for y in range(-(-height // 8)) for x in range(-(-width // 8))]
    step = restart or len(units)
    for high, low in ((0, 1), (1, 0)):
        pieces = []
        for at in range(0, len(units), step):
            w, last = Writer(DC[2]), [0] * len(planes)
            for y, x in units[at : at + step]:
                for k, ((h, v), p) in enumerate(zip(sampling, planes, strict=True)):
                    h, v = (1, 1) if len(planes) == 1 else (h, v)
                    for r in range(v):
                        for c in range(h):
                            d = int(p[y * v + r, x * h + c, 0])
                            if high:
                                w.put(d & 1, 1)
                            else:
                                w.symbol(abs((d >> 1) - last[k]).bit_length())
                                w.value((d >> 1) - last[k])
                                last[k] = d >> 1
            pieces.append(w.bytes())
        body = b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k < len(pieces) - 1 else b"") for k, p in enumerate(pieces))
        out += [media.scan(range(1, len(planes) + 1), 0, 0, 0, high, low), body]
    for k, ((h, v), p) in enumerate(zip(sampling, planes, strict=True)):
        tall, wide = -(-(-(-height * v // v0)) // 8), -(-(-(-width * h // h0)) // 8)
        blocks = p[:tall, :wide].reshape(-1, 64)
        step = restart or len(blocks)
        for start, end, high, low in ((1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (1, 63, 1, 0)):
            write = ac_refine if high else ac_first
            pieces = [write(blocks[a : a + step], start, end, low) for a in range(0, len(blocks), step)]
            body = b"".join(x + (bytes([0xFF, 0xD0 + n % 8]) if n < len(pieces) - 1 else b"") for n, x in enumerate(pieces))
            out += [media.scan([k + 1], 0, start, end, high, low), body]
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("width,height,sampling,restart", [(16, 8, [(1, 1)], 0), (33, 21, [(2, 2), (1, 1), (1, 1)], 0), (40, 17, [(2, 1), (1, 1), (1, 1)], 3), (25, 30, [(1, 1)] * 3, 2)])
def test_reader_on_all_kinds_of_scans(width, height, sampling, restart):
    rng = np.random.default_rng(width)
    h0, v0 = max(h for h, _ in sampling), max(v for _, v in sampling)
    planes = []
    for h, v in sampling:
        tall, wide = -(-height // (8 * v0)) * v, -(-width // (8 * h0)) * h
        p = np.where(rng.random((tall, wide, 64)) < 0.25, rng.integers(-20, 21, (tall, wide, 64)), 0)
        p[:, :, 0] = rng.integers(-200, 200, (tall, wide))
        p[rng.random((tall, wide)) < 0.3, 1:] = 0
        planes.append(p)
    image = media.decode(jpeg(planes, width, height, sampling, restart))
    for c, p in zip(image.components, planes, strict=True):
        assert (c.coefficients[: c.tall, : c.wide] == p[: c.tall, : c.wide]).all()
    tensor = media.rgb(image).astype(float)
    assert tensor.shape == (height, width, 3)
    full = []
    u, x = np.mgrid[0:8, 0:8]
    one = np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    for c in image.components:
        grid = np.zeros((*c.coefficients.shape[:2], 64))
        grid[:, :, media.zigzag()] = c.coefficients * np.arange(1, 65)
        s = np.clip(np.rint(np.einsum("yxab,ai,bj->yxij", grid.reshape(*grid.shape[:2], 8, 8), one, one)) + 128, 0, 255)
        s = s.transpose(0, 2, 1, 3).reshape(grid.shape[0] * 8, -1)
        full.append(np.kron(s, np.ones((v0 // c.down, h0 // c.across)))[:height, :width])
    if len(full) == 1:
        assert np.abs(tensor - full[0][:, :, None]).max() <= 1
    else:
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
        assert np.abs(tensor - np.clip(want, 0, 255)).max() <= 3


def test_zigzag():
    assert sorted(media.zigzag().tolist()) == list(range(64)) and media.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and media.zigzag()[-1] == 63


@pytest.mark.parametrize("n", [64, 128, 384, 448, 64 * 977])
def test_payloads(n):
    for raw in (bytes(n), bytes(random.Random(n).randrange(256) for _ in range(n)), ("é漢 text " * n).encode()[:n]):
        image = media.decode(media.encode_payload(raw, n - 3))
        assert media.payload(image) == (raw, n - 3)
    with pytest.raises(ValueError):
        media.encode_payload(raw[:-1], 5)


def test_broken_files():
    good = media.encode_payload(bytes(range(64)), 64)
    for bad in (b"", b"no image", good[:40], good[: len(good) // 2]):
        with pytest.raises(ValueError):
            media.payload(media.decode(bad))
    baseline = good.replace(b"\xff\xc2", b"\xff\xc0", 1)
    with pytest.raises(ValueError, match="progressive"):
        media.decode(baseline)


def test_columns(spark):
    texts = [None, "", "x", "same", "same", "é漢🙂" * 40, "long words " * 9000]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    stored = media.stored_media(df, keep=["doc_id"])
    out = {r["doc_id"]: r for r in media.digests(stored).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        file = media.encode_payload(padded, len(raw))
        assert out[k][1:7] == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(file), hashlib.sha256(file).hexdigest())
    assert out[3]["feature"] == out[4]["feature"] and out[0]["media_sha256"] == out[1]["media_sha256"]
    tensors = {r["doc_id"]: r for r in media.decoded(stored).collect()}
    assert all(len(r["tensor"]) == 3 * r["height"] * r["width"] for r in tensors.values())
    none = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert media.digests(none).first()["n_bytes"] is None and media.decoded(none).first()["tensor"] is None
    assert media.digests(stored.limit(0)).count() == 0
