"""Media columns: PNG images in binary columns, decoded with checksum tests and hashed by low frequencies.

``decode`` reads the chunks, tests every CRC-32, inflates the data with zlib (which tests its Adler-32), and
undoes the five row filters with numpy: images of one shape are unfiltered together, one row at a time for the
filters that only look up, one column at a time for those that look left.  ``phash`` is the 64-bit hash of the
lowest 8 x 8 frequencies of a 32 x 32 cosine transform, each against their median.

Grey, grey with alpha, colour, colour with alpha and palette images of 8 bits, grey of 1, 2, 4 bits and
palettes of those, and 16 bits are read, plain or interlaced (Adam7).  Images are decoded in groups of about ``GROUP``
bytes of pixels, which are hashed and let go before the next, in blocks of about ``BLOCK`` pixels, by one matrix product
for all of a shape: memory doesn't grow with a batch, but with its largest image.

Cases.  Every row gives one row with a status: ``ok``, ``null``, ``not png``, ``truncated``, ``bad crc``,
``bad data`` or ``unsupported``; only ``ok`` has a size and a hash.  An empty value is ``not png``.  Repeated
rows and null ids are each reported.  Equal images have equal hashes.  An empty table gives an empty result.
Only the id and image columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import release

MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Images of more pixels than this are reported as unsupported: a decoder's guard against a hostile header.
MAX_PIXELS = 1 << 26
GROUP, BLOCK = 16 << 20, 1 << 20
#: First column and row of each of Adam7's passes, and the steps between them.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filter_rows(rows: np.ndarray, bpp: int, kinds: np.ndarray) -> bytes:
    """The filtered bytes of (height x stride) uint8 rows, each with its kind of filter before it."""
    rows = rows.astype(np.int16)
    left = np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, bpp:] = rows[:-1, :-bpp]
    by = [0, left, up, (left + up) >> 1, paeth(left, up, corner)]
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = kinds
    for k in range(5):
        at = kinds == k
        out[at, 1:] = ((rows - by[k]) & 255)[at]
    return out.tobytes()


def encode(pixels: np.ndarray, kinds: np.ndarray | None = None) -> bytes:
    """A PNG of (height x width) or (height x width x channels) uint8 pixels."""
    if pixels.ndim == 2:
        pixels = pixels[:, :, None]
    h, w, c = pixels.shape
    kinds = np.arange(h) % 5 if kinds is None else kinds
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filter_rows(pixels.reshape(h, w * c), c, kinds))) + chunk(b"IEND", b"")


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    x, y, z = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((x <= y) & (x <= z), a, np.where(y <= z, b, c))


def unfilter(data: np.ndarray, bpp: int) -> np.ndarray:
    """(images x height x stride) bytes from (images x height x (1 + stride)) filtered ones."""
    n, h, stride = data.shape[0], data.shape[1], data.shape[2] - 1
    out = np.zeros((n, h, stride), np.uint8)
    above = np.zeros((n, stride), np.uint8)
    for y in range(h):
        kind, row = data[:, y, 0], data[:, y, 1:]
        now = np.where((kind == 2)[:, None], row + above, row)
        sub = np.flatnonzero(kind == 1)
        if len(sub):
            wide = -(-stride // bpp) * bpp
            part = np.zeros((len(sub), wide), np.uint8)
            part[:, :stride] = row[sub]
            now[sub] = np.cumsum(part.reshape(len(sub), -1, bpp), axis=1, dtype=np.uint8).reshape(len(sub), wide)[:, :stride]
        for code in (3, 4):
            some = np.flatnonzero(kind == code)
            if not len(some):
                continue
            line, up = row[some].astype(np.int16), above[some].astype(np.int16)
            zero = np.zeros((len(some), bpp), np.int16)
            left = corner = zero
            for x in range(0, stride, bpp):
                u = up[:, x : x + bpp]
                k = u.shape[1]
                guess = (left[:, :k] + u) >> 1 if code == 3 else paeth(left[:, :k], u, corner[:, :k])
                left = (line[:, x : x + bpp] + guess) & 255
                line[:, x : x + bpp] = left
                corner = u
            now[some] = line
        out[:, y] = above = now
    return out


def passes(w: int, h: int, interlaced: int) -> list[tuple[int, int, int, int, int, int]]:
    """(first column, first row, column step, row step, width, height) of each part of an image that has pixels."""
    cut = [(x, y, dx, dy, -(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in (ADAM7 if interlaced else ((0, 0, 1, 1),))]
    return [p for p in cut if p[4] > 0 and p[5] > 0]


def parse(data: bytes | None) -> tuple[str, tuple | None]:
    """(status, (width, height, depth, colour, interlaced, palette, inflated data))."""
    if data is None:
        return "null", None
    if not data.startswith(MAGIC):
        return "not png", None
    at, head, palette, body, ended = len(MAGIC), None, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            return "truncated", None
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            return "truncated", None
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            return "bad crc", None
        if kind == b"IHDR":
            head = part
        elif kind == b"PLTE":
            palette = part
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended:
        return "truncated", None
    if head is None or len(head) != 13:
        return "bad data", None
    w, h, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", head)
    if not w or not h or colour not in CHANNELS or depth not in DEPTHS[colour] or packing or filtering or interlace > 1 or (colour == 3 and (not palette or len(palette) % 3)):
        return "bad data", None
    if w * h > MAX_PIXELS:
        return "unsupported", None
    sizes = [(ph, (pw * CHANNELS[colour] * depth + 7) // 8) for *_, pw, ph in passes(w, h, interlace)]
    need = sum(ph * (stride + 1) for ph, stride in sizes)
    try:
        inflater = zlib.decompressobj()
        raw = inflater.decompress(b"".join(body), need + 1)
        if len(raw) == need:
            raw += inflater.decompress(inflater.unconsumed_tail, 1) if not inflater.eof else b""
        sound = len(raw) == need and inflater.eof
    except zlib.error:
        sound = False
    at = 0
    for ph, stride in sizes if sound else ():
        sound &= max(raw[at : at + ph * (stride + 1) : stride + 1]) <= 4
        at += ph * (stride + 1)
    return ("ok", (w, h, depth, colour, interlace, palette, raw)) if sound else ("bad data", None)


def pixels(w: int, depth: int, colour: int, palette: bytes | None, rows: np.ndarray) -> np.ndarray:
    """(height x width x channels) uint8 from unfiltered rows; palettes become colours, small depths are stretched."""
    c = CHANNELS[colour]
    if depth == 16:
        rows = rows.reshape(len(rows), -1, 2)[:, :, 0]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : w * depth].reshape(len(rows), w, depth)
        rows = bits @ (1 << np.arange(depth)[::-1]).astype(np.uint8)
        if colour == 0:
            rows = rows * np.uint8(255 // ((1 << depth) - 1))
    out = rows.reshape(len(rows), w, c)
    if colour == 3:
        table = np.zeros((256, 3), np.uint8)
        colours = np.frombuffer(palette, np.uint8).reshape(-1, 3)[:256]
        table[: len(colours)] = colours
        out = table[out[:, :, 0]]
    return out.astype(np.uint8)


def decode_all(images: list[bytes | None]) -> list[tuple[str, np.ndarray | None]]:
    """(status, pixels) of each image; images of one shape are unfiltered together."""
    out: list[tuple[str, np.ndarray | None]] = []
    groups = defaultdict(list)
    for i, data in enumerate(images):
        status, found = parse(data)
        out.append((status, None))
        if found:
            *shape, palette, raw = found
            groups[tuple(shape)].append((i, palette, raw))
    for (w, h, depth, colour, interlaced), members in groups.items():
        bpp, c = max(1, CHANNELS[colour] * depth // 8), 3 if colour == 3 else CHANNELS[colour]
        whole = np.empty((len(members), h, w, c), np.uint8)
        at = 0
        for x, y, dx, dy, pw, ph in passes(w, h, interlaced):
            stride = (pw * CHANNELS[colour] * depth + 7) // 8
            size = ph * (stride + 1)
            data = np.frombuffer(b"".join(raw[at : at + size] for _, _, raw in members), np.uint8).reshape(len(members), ph, stride + 1)
            for n, rows in enumerate(unfilter(data, bpp)):
                whole[n, y::dy, x::dx] = pixels(pw, depth, colour, members[n][1], rows)
            at += size
        for n, (i, _, _) in enumerate(members):
            out[i] = "ok", whole[n]
    return out


def grouped(images: list[bytes | None], limit: int = GROUP) -> Iterator[list[bytes | None]]:
    """Consecutive images of about ``limit`` bytes of pixels by what their headers say."""
    part, held = [], 0
    for data in images:
        size = 0
        if data is not None and len(data) > 25 and data.startswith(MAGIC):
            w, h, depth, colour = struct.unpack_from(">IIBB", data, 16)
            size = w * h * CHANNELS.get(colour, 1) * max(1, depth // 8) if w * h <= MAX_PIXELS else 0
        if part and held + size > limit:
            yield part
            part, held = [], 0
        part.append(data)
        held += size
    if part:
        yield part


@lru_cache(64)
def _shrink(n: int, to: int = 32) -> np.ndarray:
    """Area weights that bring n samples to ``to``."""
    edge = np.linspace(0, n, to + 1)
    low, high = np.maximum(edge[:-1, None], np.arange(n)), np.minimum(edge[1:, None], np.arange(n) + 1)
    weight = np.maximum(high - low, 0)
    return weight / weight.sum(1, keepdims=True)


@lru_cache(1)
def _cosines(n: int = 32, k: int = 8) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(k)[:, None] / (2 * n))


def phashes(images: np.ndarray) -> list[bytes]:
    """8 bytes for each of (images x height x width x channels); alpha is laid over black."""
    n, h, w, c = images.shape
    down, across = _shrink(h), _shrink(w).T
    out, step, rows = [], max(1, BLOCK // (h * w)), max(1, BLOCK // w)
    for s in range(0, n, step):
        small = 0
        for y in range(0, h, rows):
            x = images[s : s + step, y : y + rows].astype(float)
            if c in (2, 4):
                x = x[..., :-1] * (x[..., -1:] / 255)
            grey = x[..., 0] if x.shape[3] == 1 else x @ np.array([0.299, 0.587, 0.114])
            small = small + down[:, y : y + rows] @ (grey @ across)
        low = np.round(_cosines() @ small @ _cosines().T, 6).reshape(-1, 64)
        bits = np.packbits(low > np.median(low[:, 1:], axis=1, keepdims=True), axis=1)
        out.extend(row.tobytes() for row in bits)
    return out


def phash(image: np.ndarray) -> bytes:
    return phashes(image[None])[0]


def hashes(media: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """(id_col, status, width, height, channels, phash) of every row; no shuffle.  An id column of one of these names lends it to the result's with an underscore."""
    names = [id_col, *(n + "_" * (n == id_col.lower()) for n in ("status", "width", "height", "channels", "phash"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, shape, marks = [], [], []
            for part in grouped(batch.column(1).to_pylist()):
                found = decode_all(part)
                status.extend(s for s, _ in found)
                shape.extend((None, None, None) if x is None else x.shape for _, x in found)
                mine, alike = [None] * len(found), defaultdict(list)
                for i, (_, x) in enumerate(found):
                    if x is not None:
                        alike[x.shape].append(i)
                for some in alike.values():
                    one = found[some[0]][1][None] if len(some) == 1 else np.stack([found[i][1] for i in some])
                    for i, mark in zip(some, phashes(one)):
                        mine[i] = mark
                marks.extend(mine)
                del found
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(status, pa.string()), *(pa.array([x[j] for x in shape], pa.int32()) for j in (1, 0, 2)), pa.array(marks, pa.binary())], names)
            release()

    schema = T.StructType([T.StructField(id_col, media.schema[id_col].dataType), T.StructField(names[1], T.StringType()), *(T.StructField(n, T.IntegerType()) for n in names[2:5]), T.StructField(names[5], T.BinaryType())])
    return media.select(id_col, image_col).mapInArrow(run, schema)


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", side: int = 8, scale: int = 4) -> DataFrame:
    """(id_col, image): each vector of side * side numbers as a grey PNG of side * scale pixels square; null for any other."""

    @F.arrow_udf("binary")
    def draw(column: pa.Array) -> pa.Array:
        out = []
        for v in column.to_pylist():
            if v is None or len(v) != side * side or any(x is None or x != x for x in v):
                out.append(None)
                continue
            x = np.asarray(v).reshape(side, side)
            low, high = x.min(), x.max()
            grey = np.rint(255 * (x - low) / (high - low) if high > low else x * 0).astype(np.uint8)
            out.append(encode(np.kron(grey, np.ones((scale, scale), np.uint8))))
        return pa.array(out, pa.binary())

    return vectors.select(id_col, draw(F.col(vector_col)).alias("image"))
