import struct
import zlib

import numpy as np
import pytest
from quadrille.llm import media as m


def slow_unfilter(raw, h, stride, bpp):
    """The row filters byte by byte, as the PNG specification gives them."""
    out = [[0] * stride]
    for y in range(h):
        kind, line, up, row = raw[y * (stride + 1)], raw[y * (stride + 1) + 1 :], out[-1], []
        for x in range(stride):
            a, b, c = row[x - bpp] if x >= bpp else 0, up[x], up[x - bpp] if x >= bpp else 0
            p = a + b - c
            pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            guess = [0, a, b, (a + b) // 2, a if pa <= pb and pa <= pc else b if pb <= pc else c][kind]
            row.append((line[x] + guess) & 255)
        out.append(row)
    return np.array(out[1:], np.uint8)


def made(head, raw, *more):
    return m.MAGIC + m.chunk(b"IHDR", head) + b"".join(more) + m.chunk(b"IDAT", zlib.compress(raw)) + m.chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_round_trip_of_every_filter(channels):
    r = np.random.default_rng(channels)
    images = [r.integers(0, 256, (h, w, channels), np.uint8) for h, w in [(1, 1), (7, 5), (7, 5), (33, 40)]]
    got = m.decode_all([m.encode(x, r.integers(0, 5, len(x))) for x in images])
    assert all(s == "ok" and (g == x).all() for (s, g), x in zip(got, images))


def test_unfilter_equals_the_specification():
    r = np.random.default_rng(9)
    for bpp, stride in [(1, 9), (3, 12), (4, 8)]:
        data = r.integers(0, 256, (6, 11, stride + 1), np.uint8)
        data[:, :, 0] %= 5
        got = m.unfilter(data, bpp)
        for i in range(6):
            assert (got[i] == slow_unfilter(data[i].tobytes(), 11, stride, bpp)).all()


def test_small_depths_palettes_and_wide_samples():
    bits = made(struct.pack(">IIBBBBB", 3, 1, 1, 0, 0, 0, 0), b"\0\xa0")
    two = made(struct.pack(">IIBBBBB", 3, 1, 2, 0, 0, 0, 0), b"\0\x1b")
    wide = made(struct.pack(">IIBBBBB", 2, 1, 16, 0, 0, 0, 0), b"\0\x12\x34\xff\x00")
    table = made(struct.pack(">IIBBBBB", 2, 1, 8, 3, 0, 0, 0), b"\0\1\0", m.chunk(b"PLTE", bytes([1, 2, 3, 9, 8, 7])))
    got = [x.tolist() for _, x in m.decode_all([bits, two, wide, table])]
    assert got == [[[[255], [0], [255]]], [[[0], [85], [170]]], [[[18], [255]]], [[[9, 8, 7], [1, 2, 3]]]]


def test_phash_equals_a_plain_cosine_transform():
    r = np.random.default_rng(1)
    x = r.integers(0, 256, (32, 32, 1), np.uint8)
    low = np.array([[sum(float(x[a, b, 0]) * np.cos(np.pi * (2 * a + 1) * u / 64) * np.cos(np.pi * (2 * b + 1) * v / 64) for a in range(32) for b in range(32)) for v in range(8)] for u in range(8)]).ravel()
    want = "".join("1" if v > np.median(low[1:]) else "0" for v in low)
    assert "".join(f"{b:08b}" for b in m.phash(x)) == want
    brighter = np.clip(x.astype(int) // 2 + 60, 0, 255).astype(np.uint8)
    other = r.integers(0, 256, (32, 32, 1), np.uint8)
    bits = lambda p, q: bin(int.from_bytes(m.phash(p)) ^ int.from_bytes(m.phash(q))).count("1")
    assert bits(x, brighter) <= 6 < 16 <= bits(x, other)
    assert m.phash(np.kron(x[:, :, 0], np.ones((3, 3), np.uint8))[:, :, None]) == m.phash(x)


def test_every_status_and_the_column(make):
    good = m.encode(np.arange(64, dtype=np.uint8).reshape(8, 8))
    flip = bytearray(good)
    flip[45] ^= 1
    body = made(struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0), b"\0" * 71)
    kinds = made(struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0), b"\7\0")
    laced = made(struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 2), b"\0\0")
    huge = made(struct.pack(">IIBBBBB", 1 << 20, 1 << 20, 8, 0, 0, 0, 0), b"\0\0")
    adler = bytearray(zlib.compress(b"\0\0"))
    adler[-1] ^= 1
    summed = m.MAGIC + m.chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + m.chunk(b"IDAT", bytes(adler)) + m.chunk(b"IEND", b"")
    rows = [(1, good), (1, good), (None, good), (2, None), (3, b""), (4, b"GIF89a"), (5, good[:-3]), (6, bytes(flip)), (7, body), (8, kinds), (9, laced), (10, huge), (11, summed), (12, m.MAGIC)]
    frame = make([(i, b, 0, "x") for i, b in rows], "vec_id bigint, image binary, width int, status string")
    got = [(r.vec_id, r.status) for r in m.hashes(frame, "vec_id", "image").collect()]
    want = ["ok", "ok", "ok", "null", "not png", "not png", "truncated", "bad crc", "bad data", "bad data", "bad data", "unsupported", "bad data", "truncated"]
    assert sorted(got, key=str) == sorted(zip([i for i, _ in rows], want), key=str)
    assert m.hashes(frame.limit(0), "vec_id", "image").collect() == []


def test_vectors_become_images_and_back(make):
    r = np.random.default_rng(3)
    vectors = [(i, r.normal(size=64).tolist()) for i in range(40)] + [(50, None), (51, [1.0]), (52, [float("nan")] * 64), (53, [2.0] * 64)]
    frame = make(vectors, "vec_id bigint, embedding array<float>")
    images = m.rendered(frame)
    got = {x.vec_id: x for x in m.hashes(images, "vec_id", "image").collect()}
    assert {i for i, x in got.items() if x.status == "null"} == {50, 51, 52} and got[53].status == "ok"
    for i, v in vectors[:40]:
        x = np.float32(v).reshape(8, 8).astype(float)
        grey = np.rint(255 * (x - x.min()) / (x.max() - x.min())).astype(np.uint8)
        assert bytes(got[i].phash) == m.phash(np.kron(grey, np.ones((4, 4), np.uint8))[:, :, None]) and got[i].width == 32


def lace(x, r):
    """The seven passes of an image, each filtered by itself."""
    raw = b""
    for x0, y0, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)):
        part = x[y0::dy, x0::dx]
        if part.size:
            raw += m.filter_rows(part.reshape(len(part), -1), x.shape[2], r.integers(0, 5, len(part)))
    return raw


def test_interlaced_images_equal_plain_ones():
    r = np.random.default_rng(12)
    for c, colour in ((1, 0), (3, 2), (4, 6)):
        for h, w in [(1, 1), (2, 3), (5, 1), (8, 8), (9, 13), (33, 17)]:
            x = r.integers(0, 256, (h, w, c), np.uint8)
            raw = lace(x, r)
            (status, got), (bad, _) = m.decode_all([made(struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 1), raw), made(struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 1), raw[:-1])])
            assert status == "ok" and (got == x).all() and bad == "bad data"
    x = np.array([[1, 0, 1], [0, 1, 1]], np.uint8)
    rows = [x[0:1, 0:1], x[0:1, 2:3], x[0:1, 1:2], x[1:2, :]]  # one bit a sample: the passes that a 3 x 2 image has
    raw = b"".join(b"\0" + np.packbits(p, axis=1).tobytes() for p in rows)
    assert (m.decode_all([made(struct.pack(">IIBBBBB", 3, 2, 1, 0, 0, 0, 1), raw)])[0][1][:, :, 0] == 255 * x).all()


def test_blocks_and_groups_change_no_hash(monkeypatch, make):
    r = np.random.default_rng(2)
    images = [r.integers(0, 256, (h, w, c), np.uint8) for h, w, c in [(40, 30, 1), (40, 30, 1), (64, 64, 3), (5, 9, 4), (40, 30, 2)]]
    want = [m.phash(x) for x in images]
    monkeypatch.setattr(m, "BLOCK", 100)
    assert [m.phash(x) for x in images] == want and m.phashes(np.stack(images[:2])) == want[:2]
    parts = list(m.grouped([m.encode(x) for x in images] + [None, b""], 1300))
    assert [len(p) for p in parts] == [1, 1, 1, 1, 1, 2]
    frame = make([(i, m.encode(x)) for i, x in enumerate(images)], "status bigint, image binary")
    got = m.hashes(frame, "status", "image")
    assert got.columns == ["status", "status_", "width", "height", "channels", "phash"] and [bytes(x.phash) for x in sorted(got.collect())] == want


def test_a_hundred_large_images_need_little_memory():
    import subprocess
    import sys

    code = """
import resource, numpy as np
from quadrille.llm import media as m
image = m.encode(np.kron(np.arange(64, dtype=np.uint8).reshape(8, 8), np.ones((256, 256), np.uint8)), np.full(2048, 2))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
marks = [m.phashes(x[None]) for part in m.grouped([image] * 100) for _, x in m.decode_all(part)]
assert len(marks) == 100
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 300 << 10
