"""TIFF files of every kind that is read, and images end to end, against plain versions."""

import struct
import zlib

import numpy as np
import pytest

from haargrid.jobs import images
from haargrid.sources import tiff

RNG = np.random.default_rng(7)


def plain_file(a, order="<", compression=1, predictor=1, photometric=None, tile=None, rows=2, fmt=1):
    """A file written without the library, with strips or square tiles."""
    a = a.astype(a.dtype.newbyteorder(order))
    h, w, s = (*a.shape, 1)[:3]
    a3 = a.reshape(h, w, s)
    if tile:
        parts = []
        for i in range(0, h, tile):
            for j in range(0, w, tile):
                t = np.zeros((tile, tile, s), a.dtype)
                t[: min(tile, h - i), : min(tile, w - j)] = a3[i : i + tile, j : j + tile]
                parts.append(t)
    else:
        parts = [a3[i : i + rows] for i in range(0, h, rows)]
    if predictor == 2:
        parts = [np.concatenate([p[:, :1], p[:, 1:] - p[:, :-1]], axis=1).astype(a.dtype) for p in parts]
    pack = {1: bytes, 8: zlib.compress, 32773: runs}[compression]
    data = [pack(p.tobytes()) for p in parts]
    at, body = [], b""
    for d in data:
        at.append(8 + len(body))
        body += d
    body += b"\0" * (len(body) % 2)
    tags = {256: [w], 257: [h], 258: [a.itemsize * 8] * s, 259: [compression], 262: [(2 if s >= 3 else 1) if photometric is None else photometric], 277: [s], 317: [predictor], 339: [fmt] * s}
    tags |= {322: [tile], 323: [tile], 324: at, 325: [len(d) for d in data]} if tile else {273: at, 278: [rows], 279: [len(d) for d in data]}
    directory = 8 + len(body)
    extra, out, free = b"", b"", directory + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        v = struct.pack(f"{order}{len(tags[tag])}I", *tags[tag])
        out += struct.pack(f"{order}HHI", tag, 4, len(tags[tag])) + (v if len(v) <= 4 else struct.pack(f"{order}I", free + len(extra)))
        extra += v if len(v) > 4 else b""
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, directory) + body + struct.pack(f"{order}H", len(tags)) + out + b"\0" * 4 + extra


def runs(data):
    out, i = b"", 0
    while i < len(data):
        n = 1
        while i + n < len(data) and n < 128 and data[i + n] == data[i]:
            n += 1
        out += bytes([257 - n, data[i]]) if n > 1 else bytes([0, data[i]])
        i += n
    return out + b"\x80"


def read(spark, folder):
    rows = tiff.read_gray(spark, str(folder)).collect()
    out = np.full((max(r.x for r in rows) + 1, max(r.y for r in rows) + 1), np.nan)
    for r in rows:
        assert np.isnan(out[r.x, r.y])
        out[r.x, r.y] = r.value
    return out


GREY16 = RNG.integers(0, 65536, (5, 9)).astype(np.uint16)
GREY8 = np.repeat(RNG.integers(0, 256, (7, 3)), 3, axis=1).astype(np.uint8)
COLOUR = RNG.integers(0, 65536, (6, 4, 3)).astype(np.uint16)


@pytest.mark.parametrize(
    ("array", "kind", "expected"),
    [
        (GREY16, {"order": "<"}, GREY16 / 65535),
        (GREY16, {"order": ">", "compression": 8, "predictor": 2}, GREY16 / 65535),
        (GREY16, {"tile": 4, "compression": 8}, GREY16 / 65535),
        (GREY8, {"compression": 32773}, GREY8 / 255),
        (GREY8, {"photometric": 0, "rows": 100}, 1 - GREY8 / 255),
        (COLOUR, {"predictor": 2, "order": ">"}, COLOUR @ [0.2989, 0.5870, 0.1140] / 65535),
        (np.concatenate([COLOUR, COLOUR[:, :, :1]], axis=2), {}, COLOUR @ [0.2989, 0.5870, 0.1140] / 65535),
        (np.float32([[0.25, -1.5], [3.0, 0.0]]), {"fmt": 3}, np.array([[0.25, -1.5], [3.0, 0.0]])),
    ],
)
def test_kinds(spark, tmp_path, array, kind, expected):
    (tmp_path / "a.tif").write_bytes(plain_file(array, **kind))
    (tmp_path / "readme.txt").write_text("not an image")
    assert read(spark, tmp_path) == pytest.approx(expected, abs=1e-12)


def test_own_files(spark, tmp_path):
    for a in (GREY16, COLOUR, GREY8, np.zeros((1, 1), np.uint16)):
        for compression in (1, 8):
            _, tags = tiff.directory(tiff.encoded(a, 2, compression))
            assert (tags[257][0], tags[256][0]) == a.shape[:2]
    (tmp_path / "a.tiff").write_bytes(tiff.encoded(COLOUR, 4))
    assert read(spark, tmp_path) == pytest.approx(COLOUR @ [0.2989, 0.5870, 0.1140] / 65535)


def test_unreadable_files_say_why(spark):
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.directory(b"\x89PNG....")
    with pytest.raises(ValueError, match="compression 5"):
        list(tiff.blocks("p", tiff.encoded(GREY8, 64, 1).replace(struct.pack("<HHIHH", 259, 3, 1, 1, 0), struct.pack("<HHIHH", 259, 3, 1, 5, 0))))
    assert tiff.cells(spark.createDataFrame([("a", None)], "path string, content binary")).count() == 0



@pytest.mark.parametrize("coarser", [0, 1, 2, 5])
def test_resampling_takes_means(spark, coarser):
    """Without loss, at any coarser levels, what is resampled is the mean of the image's cells there."""
    a = RNG.integers(0, 3, (9, 5)).astype(float)
    rows = [("i", x, y, float(a[x, y])) for x in range(9) for y in range(5)]
    box, full, after = images.compressed(spark.createDataFrame(rows, "tree_id string, x long, y long, value double"))
    assert full.count() == 32
    sx, sy = min(8, 1 << coarser), min(4, 1 << coarser)
    expected = {(x, y): a[x * sx : (x + 1) * sx, y * sy : (y + 1) * sy].mean() for x in range(8 // sx) for y in range(4 // sy)}
    for leaves in (full, after):
        got = {(r.x, r.y): r.value for r in images.resampled(leaves, box, coarser).collect()}
        assert got == pytest.approx(expected)


def test_flat_images_become_one_box(spark):
    rows = [(t, x, y, v) for t, v, w in (("a", 0.5, 6), ("b", 0.25, 1)) for x in range(4) for y in range(w)]
    out = images.compressed(spark.createDataFrame(rows, "tree_id string, x long, y long, value double"))
    got = {r.tree_id: (r.boxes_before, r.boxes_after, r.nodes_after, r.max_difference) for r in images.summary(*out).collect()}
    assert got == {"a": (16, 1, 1, 0.0), "b": (4, 1, 1, 0.0)}


def test_cap(spark):
    rows = [("i", x, y, float(x + y)) for x in range(8) for y in range(8)]
    box, full, _ = images.compressed(spark.createDataFrame(rows, "tree_id string, x long, y long, value double"), cap=1)
    assert full.count() == 4 and (box.first().level_x, box.first().level_y) == (1, 1)
