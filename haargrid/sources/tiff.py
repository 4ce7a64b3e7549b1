"""TIFF images: strips and tiles of a file are decoded by different tasks.

Read are integers of 8, 16 and 32 bits and floats, of either byte order, stored plainly, by deflate or by runs of
bytes, with or without differences along a row. Cells are (tree_id: the path, x: row, y: column, value).
Brightness goes from 0 to 1: integers are divided by the largest of their width (so 16 bits aren't clipped), floats are
taken as they are. A file that isn't read that way is an error that says why.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags, bytes of each type of value, and weights of a colour's brightness.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
TYPES = {1: "B", 3: "H", 4: "I"}
PLAIN, DEFLATE, OLD_DEFLATE, RUNS = 1, 8, 32946, 32773
GREY = np.array([0.2989, 0.5870, 0.1140])
#: Cells of a batch that a task sends on.
CELLS = 1 << 16

BLOCK = "path string, row int, col int, rows int, cols int, stored int, order string, bits int, samples int, format int, white_is_zero boolean, compression int, predictor int, data binary"


def directory(raw: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of a file's first image."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", raw, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(order + "H", raw, at)[0]):
        place = at + 2 + 12 * i
        tag, kind, n = struct.unpack_from(order + "HHI", raw, place)
        if kind in TYPES:
            form = f"{order}{n}{TYPES[kind]}"
            tags[tag] = struct.unpack_from(form, raw, place + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", raw, place + 8)[0])
    return order, tags


def blocks(path: str, raw: bytes) -> Iterator[tuple]:
    """The strips or tiles of a file, not decoded yet."""
    order, tags = directory(raw)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bits = one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 1)
    about = (order, bits, one(SAMPLES, 1), one(FORMAT, 1), one(PHOTOMETRIC, 1) == 0, one(COMPRESSION, PLAIN), one(PREDICTOR, 1))
    if one(FORMAT, 1) not in (1, 3) or (one(FORMAT, 1), bits) not in {(1, 8), (1, 16), (1, 32), (3, 32), (3, 64)} or one(PHOTOMETRIC, 1) > 2 or (about[2] > 1 and one(PLANAR, 1) != 1) or about[5] not in (PLAIN, DEFLATE, OLD_DEFLATE, RUNS) or about[6] > 2:
        raise ValueError(f"{path}: bits {bits}, format {one(FORMAT, 1)}, photometric {one(PHOTOMETRIC, 1)}, planes {one(PLANAR, 1)}, compression {about[5]}, predictor {about[6]} aren't read")
    tiled = TILE_OFFSETS in tags
    across, down = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(one(ROWS, height), height))
    per_row = -(-width // across) if width else 0
    for i, (at, n) in enumerate(zip(*((tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[OFFSETS], tags[COUNTS])), strict=True)):
        row, col = i // per_row * down, i % per_row * across
        yield path, row, col, min(down, height - row), min(across, width - col), across, *about, raw[at : at + n]


def unpacked(data: bytes) -> bytes:
    """Runs of bytes: a length up to 127 is followed by one more literal bytes than it says, one from 129 by a byte to repeat."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def brightness(b) -> np.ndarray:
    """A block's rows as brightness."""
    data = zlib.decompress(b.data) if b.compression in (DEFLATE, OLD_DEFLATE) else unpacked(b.data) if b.compression == RUNS else b.data
    kind = np.dtype(f"{b.order}{'f' if b.format == 3 else 'u'}{b.bits // 8}")
    a = np.frombuffer(data, kind, b.rows * b.stored * b.samples).reshape(b.rows, b.stored, b.samples)
    if b.predictor == 2:
        a = np.cumsum(a, axis=1, dtype=kind.newbyteorder("="))
    a = a[:, : b.cols].astype(float)
    # grey may have opacity beside it, colours too
    v = a[:, :, :3] @ GREY if b.samples >= 3 else a[:, :, 0]
    v = v if b.format == 3 else v / (2**b.bits - 1)
    return 1.0 - v if b.white_is_zero else v


def cells(images: DataFrame) -> DataFrame:
    """Cells of images (path, content), as the binaryFile source gives them; rows without content are left out."""

    def cut(batches):
        for pdf in batches:
            for path, raw in zip(pdf.path, pdf.content, strict=True):
                for block in blocks(path, bytes(raw)):
                    yield pd.DataFrame([block], columns=[c.split()[0] for c in BLOCK.split(", ")])

    def decode(batches):
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                v = brightness(b)
                step = max(1, CELLS // max(1, b.cols))
                for at in range(0, b.rows, step):
                    part = v[at : at + step]
                    x, y = np.divmod(np.arange(part.size), b.cols)
                    yield pa.RecordBatch.from_arrays([pa.repeat(b.path, part.size), pa.array(x + b.row + at), pa.array(y + b.col), pa.array(part.ravel())], names=["tree_id", "x", "y", "value"])

    def decode_arrow(batches):
        yield from decode(b.to_pandas() for b in batches)

    # compressed blocks move once, so that one large image isn't one task's work
    spread = images.filter("content is not null").select("path", "content").mapInPandas(cut, BLOCK).repartition("path", "row", "col")
    return spread.mapInArrow(decode_arrow, "tree_id string, x long, y long, value double")


def read_gray(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the TIFF files in a folder, or of one."""
    return cells(spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(path))


def encoded(array: np.ndarray, rows: int = 64, compression: int = DEFLATE) -> bytes:
    """A grey or coloured image of whole numbers as a file, little-endian, in strips of ``rows`` rows."""
    a = np.ascontiguousarray(array, array.dtype.newbyteorder("<"))
    height, width, samples = (*a.shape, 1)[:3]
    strips = [a[i : i + rows].tobytes() for i in range(0, height, rows)]
    strips = [zlib.compress(s) for s in strips] if compression == DEFLATE else strips
    counts = [len(s) for s in strips]
    starts = (8 + np.cumsum([0, *counts[:-1]])).tolist()
    body = b"".join(strips) + b"\0" * (sum(counts) % 2)
    values = {WIDTH: [width], HEIGHT: [height], BITS: [a.itemsize * 8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [2 if samples == 3 else 1], OFFSETS: starts, SAMPLES: [samples], ROWS: [rows], COUNTS: counts}
    at = 8 + len(body)
    free = at + 2 + 12 * len(values) + 4
    entries, after = b"", b""
    for tag, v in sorted(values.items()):
        kind = "I" if tag in (OFFSETS, COUNTS, WIDTH, HEIGHT, ROWS) else "H"
        packed = struct.pack(f"<{len(v)}{kind}", *v)
        entries += struct.pack("<HHI", tag, 4 if kind == "I" else 3, len(v)) + (packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack("<I", free + len(after)))
        after += packed if len(packed) > 4 else b""
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(values)) + entries + b"\0\0\0\0" + after


def files_of(cells: DataFrame) -> DataFrame:
    """(path, content): an image of 16 bits for each tree_id from (tree_id, x, y, level: 0 to 65535); cells that aren't there are black.

    A file is one value, so an image has to fit a task.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf.x.max()) + 1, int(pdf.y.max()) + 1), np.uint16)
        a[pdf.x, pdf.y] = pdf.level
        return pd.DataFrame({"path": [str(pdf.tree_id.iloc[0])], "content": [encoded(a, rows=3)]})

    return cells.groupBy("tree_id").applyInPandas(one, "path string, content binary")
