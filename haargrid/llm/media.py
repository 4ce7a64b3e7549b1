"""FLAC in a binary column: texts stored as 8-bit mono samples, decoded again in bulk.

Frames of many files are worked on together: one numpy step reads the next Rice code of
every open frame. A seek table with a point for each frame lets the decoder open all
frames of a file at once; without one it goes from frame to frame.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from haargrid.llm.rows import small_batches, tidy

BLOCK = 4096
RATE = 8000
#: Bytes of samples that are coded together.
TOGETHER = 4 << 20
SIGN = bytes(b ^ 0x80 for b in range(256))


# checksums


def _crc_table(poly: int, bits: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, t << 1 ^ poly, t << 1) & ((1 << bits) - 1)
    return t


CRC8, CRC16 = _crc_table(0x07, 8).tolist(), _crc_table(0x8005, 16).astype(np.uint16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


@functools.lru_cache(1)
def _crc16_by_distance(size: int) -> np.ndarray:
    """What a byte contributes to the CRC-16, by its distance from the end: the checksum is linear."""
    t = np.empty((size, 256), np.uint16)
    t[0] = CRC16
    for d in range(1, size):
        t[d] = t[d - 1] << 8 ^ CRC16[t[d - 1] >> 8]
    return t.ravel()


def crc16_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each stretch of data; stretches are in order and apart or adjacent, none empty."""
    lengths = ends - starts
    table = _crc16_by_distance(1 << int(max(13, int(lengths.max()) - 1).bit_length() if lengths.max() > 8192 else 13))
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)
    far = np.repeat(ends, lengths) - 1 - at
    return np.bitwise_xor.reduceat(table[far * 256 + data[at]], first)


# encoder


@functools.lru_cache(4096)
def _header(number: int, samples: int) -> bytes:
    if number < 0x80:
        coded = bytes([number])
    else:
        tail = []
        lead = 0x3F
        while number > lead:
            tail.append(0x80 | number & 0x3F)
            number >>= 6
            lead >>= 1
        coded = bytes([(~lead << 1) & 0xFF | number, *reversed(tail)])
    head = b"\xff\xf8\x70\x02" + coded + struct.pack(">H", samples - 1)
    return head + bytes([crc8(head)])


def _frames(samples: np.ndarray, sizes: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Coded frames: a constant one as such, any other by the first difference and one Rice parameter."""
    starts = np.cumsum(sizes) - sizes
    s = samples.astype(np.int32)
    diff = np.empty_like(s)
    diff[0] = 0
    np.subtract(s[1:], s[:-1], out=diff[1:])
    diff[starts] = 0  # the first sample is stored as it is
    u = (diff << 1) ^ (diff >> 31)
    flat = np.add.reduceat(u, starts) == 0
    coded = sizes - 1
    cost = np.stack([np.add.reduceat(u >> k, starts) + coded * (k + 1) for k in (5, 6, 7)])
    k_of = 5 + cost.argmin(0)
    bits = 10 + cost.min(0)
    size = np.where(flat, 0, (bits + 7) // 8)
    base = np.cumsum(size) - size
    k = np.repeat(k_of, sizes)
    q = u >> k
    length = q + 1 + k
    length[starts] = 0
    end = np.cumsum(length)  # one behind each code's last bit, counted over all frames
    end += np.repeat(8 * base + 10 - (end[starts] - length[starts]), sizes)
    real = ~np.repeat(flat, sizes)
    real[starts] = False
    v, last = ((1 << k) | (u & ((1 << k) - 1)))[real], end[real] - 1
    v <<= 7 - (last & 7)  # a code's stop bit and low bits lie in its last two bytes
    byte = last >> 3
    total = int(size.sum()) + 2
    body = np.bincount(byte, v & 0xFF, total) + np.bincount(np.maximum(byte - 1, 0), v >> 8, total)
    open_ = np.flatnonzero(~flat)
    np.add.at(body, base[open_], k_of[open_] >> 2)
    np.add.at(body, base[open_] + 1, (k_of[open_] & 3) << 6)
    body = body.astype(np.uint8).tobytes()
    out = []
    for f, (at, n, number) in enumerate(zip(starts.tolist(), sizes.tolist(), numbers, strict=True)):
        warm = int(samples[at]) & 0xFF
        out.append(_header(number, n) + (bytes([0x00, warm]) if flat[f] else bytes([0x12, warm]) + body[base[f] : base[f] + size[f]]))
    lengths = np.array([len(x) for x in out])
    ends = np.cumsum(lengths)
    crc = crc16_of(np.frombuffer(b"".join(out), np.uint8), ends - lengths, ends)
    return [x + struct.pack(">H", c) for x, c in zip(out, crc.tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file for each payload (none empty), with a seek point for each frame."""
    plan = [(i, k, p[k * BLOCK : (k + 1) * BLOCK]) for i, p in enumerate(payloads) for k in range(-(-len(p) // BLOCK))]
    frames: list[list[bytes]] = [[] for _ in payloads]
    at = 0
    while at < len(plan):
        part = plan[at : at + TOGETHER // BLOCK]
        at += len(part)
        samples = np.frombuffer(b"".join(x[2] for x in part).translate(SIGN), np.int8)
        for (i, _, _), f in zip(part, _frames(samples, np.array([len(x[2]) for x in part]), [x[1] for x in part]), strict=True):
            frames[i].append(f)
    out = []
    for p, fs in zip(payloads, frames, strict=True):
        info = struct.pack(">HH", BLOCK, BLOCK) + min(map(len, fs)).to_bytes(3, "big") + max(map(len, fs)).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(p.translate(SIGN)).digest()
        offset, points = 0, []
        for k, f in enumerate(fs):
            points.append(struct.pack(">QQH", k * BLOCK, offset, min(BLOCK, len(p) - k * BLOCK)))
            offset += len(f)
        seek = b"".join(points)
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(fs))
    return out


# decoder


class _Info:
    """The metadata of a file: where its frames are, and what they must give."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC file")
        at, last, self.points = 4, False, []
        while not last:
            kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            last, body = bool(data[at] & 0x80), data[at + 4 : at + 4 + size]
            at += 4 + size
            if kind == 0:
                x = int.from_bytes(body[10:18], "big")
                self.channels, self.bits, self.samples, self.md5 = (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & (1 << 36) - 1, body[18:34]
                self.block = int.from_bytes(body[:2], "big")
            elif kind == 3:
                self.points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
        self.start = at
        if self.channels != 1 or self.bits > 16:
            raise ValueError("only one channel of up to 16 bits is stored here")


#: Fixed values of the format: block sizes by their code.
SIZES = {1: 192} | {c: 576 << (c - 2) for c in range(2, 6)} | {c: 256 << (c - 8) for c in range(8, 16)}
LEAD = np.array([16 - int(x).bit_length() for x in range(1 << 16)], np.int64)


class _Frame:
    """The parts of a frame before its residuals; ``bit`` is the next bit of the whole buffer."""

    def __init__(self, data: bytes, at: int, bits: int, block: int):
        self.start = at
        if data[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
            raise ValueError("no frame where one must start")
        code, rate = data[at + 2] >> 4, data[at + 2] & 15
        b = data[at + 4]
        more = 0 if b < 0x80 else 8 - (b ^ 0xFF).bit_length() - 1
        number = b if b < 0x80 else b & (0x3F >> more)
        for c in data[at + 5 : at + 5 + more]:
            number = number << 6 | c & 0x3F
        p = at + 5 + more
        if code in (6, 7):
            self.n = int.from_bytes(data[p : p + code - 5], "big") + 1
            p += code - 5
        else:
            self.n = SIZES[code]
        p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        if crc8(data[at:p]) != data[p]:
            raise ValueError("a frame header's checksum differs")
        self.first = number if data[at + 1] & 1 else number * block
        kind = data[p + 1]
        if kind & 0x81:
            raise ValueError("wasted bits aren't stored here")
        self.bit, self.kind = (p + 2) * 8, kind >> 1
        read = lambda n: self._signed(data, n)
        self.warm, self.coefs, self.shift, self.residuals = [], [], 0, True
        if self.kind == 0:
            self.order, self.values, self.residuals = 0, [read(bits)] * self.n, False
        elif self.kind == 1:
            self.order, self.values, self.residuals = 0, [read(bits) for _ in range(self.n)], False
        elif 8 <= self.kind <= 12 or self.kind >= 32:
            self.order = self.kind - 8 if self.kind < 32 else self.kind - 31
            self.warm = [read(bits) for _ in range(self.order)]
            if self.kind >= 32:
                precision = self._bits(data, 4) + 1
                self.shift = read(5)
                self.coefs = [read(precision) for _ in range(self.order)]
        else:
            raise ValueError("unknown kind of subframe")
        if self.residuals:
            self.wide = 4 + self._bits(data, 2)
            self.parts = 1 << self._bits(data, 4)

    def _bits(self, data: bytes, n: int) -> int:
        a, b = self.bit >> 3, (self.bit + n + 7) >> 3
        x = int.from_bytes(data[a:b], "big") >> (8 * b - self.bit - n)
        self.bit += n
        return x & ((1 << n) - 1)

    def _signed(self, data: bytes, n: int) -> int:
        x = self._bits(data, n)
        return x - (1 << n) if x >> (n - 1) else x


def _rice(window: np.ndarray, p: np.ndarray, k: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next m codes with parameter k from bit p of each frame: (step, frame) values, and the bits behind them."""
    order = np.argsort(-m, kind="stable")
    p, k, left = p[order].copy(), k[order], m[order]
    out = np.zeros((int(left[0]) if len(left) else 0, len(m)), np.int32)
    active = np.searchsorted(-left, -np.arange(len(out)), "left")  # frames with more codes than the step
    low, k1 = (63 - k).astype(np.uint64), k + 1
    for t, n in enumerate(active.tolist()):
        at = p[:n]
        w = window[at >> 3] << (at & 7).astype(np.uint64)
        q = LEAD[(w >> np.uint64(48)).astype(np.int64)]
        if q.max() < 16:
            rest = w << (q + 1).astype(np.uint64)
            used = q
        else:  # rare: more than 15 zeros
            q = q.copy()
            for i in np.flatnonzero(q == 16).tolist():
                b = int(at[i]) + 16
                while not int(window[b >> 3]) >> (63 - (b & 7)) & 1:
                    b += 1
                q[i] = b - int(at[i])
            after = at + q + 1
            rest = window[after >> 3] << (after & 7).astype(np.uint64)
            used = q
        u = (used << k[:n]) | ((rest >> np.uint64(1)) >> low[:n]).astype(np.int64)
        out[t, :n] = (u >> 1) ^ -(u & 1)
        p[:n] = at + q + k1[:n]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[:, back], p[back]


def _residuals(data: bytes, window: np.ndarray, frames: list[_Frame]) -> None:
    """Reads all partitions of all frames; leaves ``values`` (residuals) and ``bit`` in the frames."""
    for f in frames:
        f.got = []
    for part in range(max((f.parts for f in frames), default=0)):
        now = []
        for f in frames:
            if part < f.parts:
                f.k = f._bits(data, f.wide)
                f.m = f.n // f.parts - (f.order if part == 0 else 0)
                if f.k == (1 << f.wide) - 1:  # stored without a code
                    wide = f._bits(data, 5)
                    f.got.append(np.array([f._signed(data, wide) if wide else 0 for _ in range(f.m)], np.int32))
                else:
                    now.append(f)
        if now:
            values, p = _rice(window, np.array([f.bit for f in now]), np.array([f.k for f in now]), np.array([f.m for f in now]))
            values = np.ascontiguousarray(values.T)
            for i, f in enumerate(now):
                f.got.append(values[i, : f.m])
                f.bit = int(p[i])
    for f in frames:
        f.values = f.got[0] if len(f.got) == 1 else np.concatenate(f.got)


def _restore(f: _Frame) -> np.ndarray:
    if not f.residuals:
        return np.array(f.values, np.int32)
    r = f.values.astype(np.int64)
    if f.kind >= 32:
        s = [*f.warm, *r.tolist()]
        for t in range(f.order, f.n):
            s[t] += sum(c * s[t - 1 - j] for j, c in enumerate(f.coefs)) >> f.shift
        return np.array(s, np.int32)
    # the residual is the order-th difference: sum it up as often
    for j in range(f.order, 0, -1):
        r = np.cumsum(r) + int(np.diff(f.warm, j - 1)[-1])
    return np.concatenate([np.array(f.warm, np.int64), r]).astype(np.int32)


def decode(files: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(file, first sample, samples) of all frames, a file's in order. Every header's and frame's checksum,
    the number of samples and (8 bits) their MD5 are verified; a difference raises ValueError."""
    at = 0
    while at < len(files):
        many, size = 1, len(files[at])
        while at + many < len(files) and size + len(files[at + many]) <= TOGETHER:
            size += len(files[at + many])
            many += 1
        for i, first, s in _decode(files[at : at + many]):
            yield at + i, first, s
        at += many


def _decode(files: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    infos = [_Info(x) for x in files]
    data = b"".join(files) + bytes(16)
    raw = np.frombuffer(data, np.uint8)
    window = np.zeros(len(raw) - 8, np.uint64)
    for j in range(8):
        window |= raw[j : len(raw) - 8 + j].astype(np.uint64) << np.uint64(56 - 8 * j)
    base = np.cumsum([0, *map(len, files)]).tolist()
    # from each seek point to the next, or from the first frame to the end
    spans = []
    for i, x in enumerate(infos):
        starts = sorted({base[i] + x.start, *(base[i] + x.start + p[1] for p in x.points)} - {base[i + 1]})
        spans += [[i, a, b] for a, b in zip(starts, [*starts[1:], base[i + 1]], strict=True)]
    done: list[list[tuple[int, np.ndarray]]] = [[] for _ in files]
    while spans:
        frames = [_Frame(data, a, infos[i].bits, infos[i].block) for i, a, _ in spans]
        _residuals(data, window, [f for f in frames if f.residuals])
        ends = np.array([(f.bit + 7) // 8 for f in frames])
        crc = crc16_of(raw, np.array([f.start for f in frames]), ends)
        stored = raw[ends].astype(np.uint16) << 8 | raw[ends + 1]
        if (crc != stored).any():
            raise ValueError("a frame's checksum differs")
        for x, f, end in zip(spans, frames, ends.tolist(), strict=True):
            done[x[0]].append((f.first, _restore(f)))
            x[1] = end + 2
        spans = [x for x in spans if x[1] < x[2]]
    for i, (info, blocks) in enumerate(zip(infos, done, strict=True)):
        blocks.sort(key=lambda b: b[0])
        if sum(len(s) for _, s in blocks) != info.samples:
            raise ValueError("samples are missing")
        if info.bits == 8 and info.md5 != bytes(16) and hashlib.md5(b"".join(s.astype(np.int8).tobytes() for _, s in blocks)).digest() != info.md5:
            raise ValueError("the samples' MD5 differs")
        for first, s in blocks:
            yield i, first, s


# Spark


def _map_binary(df: DataFrame, f, out: str, value_col: str, keep: list[str]) -> DataFrame:
    """f(list of values) gives (row of the list, computed columns...); the columns of ``keep`` go along."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), *T._parse_datatype_string(out).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            values, at = b.column(len(keep)).cast(pa.binary()), 0
            while at < b.num_rows:
                size, stop = 0, at
                while stop < b.num_rows and stop - at < 1024 and size < TOGETHER // 2:
                    size += len(values[stop].as_buffer()) if values[stop].is_valid else 0
                    stop += 1
                rows = list(f([x or b"" for x in values.slice(at, stop - at).to_pylist()]))
                back = pa.array([at + r[0] for r in rows], pa.int64())
                cols = list(zip(*(r[1:] for r in rows), strict=True)) or [[] for _ in arrow.names[len(keep) :]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(i).take(back).cast(arrow.field(i).type) for i in range(len(keep))] + [pa.array(c, t.type) for c, t in zip(cols, list(arrow)[len(keep) :], strict=True)],
                    schema=arrow,
                )
                at = stop

    return small_batches(df).select(*keep, value_col).mapInArrow(tidy(run), schema)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """Each text's UTF-8 bytes, padded with zeros to a positive multiple of ``unit``, as a FLAC file.

    Null and empty texts give ``unit`` zeros; null ids and repeated rows are stored like others.
    """

    def f(texts):
        payloads = [t + bytes(-len(t) % unit if t else unit) for t in texts]
        for i, (t, p, m) in enumerate(zip(texts, payloads, encode(payloads), strict=True)):
            yield i, len(t), len(p), m

    return _map_binary(docs, f, "n_bytes long, payload_bytes long, media binary", text_col, [id_col])


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The decoded blocks of every file: block number, first sample, number of samples, 8-bit PCM bytes."""

    def f(files):
        if len(files):
            seen = [0] * len(files)
            for i, first, s in decode(files):
                yield i, seen[i], first, len(s), s.astype(np.int8).tobytes()
                seen[i] += 1

    return _map_binary(media, f, "block long, first_sample long, n_samples long, pcm binary", media_col, [id_col])


def read_back(media: DataFrame, keep: tuple[str, ...] = ("doc_id",), media_col: str = "media") -> DataFrame:
    """Digests and features of every stored file, from its decoded samples: range, sum, energy and sign changes."""

    def f(files):
        pcm: list[list[np.ndarray]] = [[] for _ in files]
        for i, _, s in decode(files):
            pcm[i].append(s)
        for i, (x, parts) in enumerate(zip(files, pcm, strict=True)):
            s = np.concatenate(parts)
            p = (s.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()
            e = s.astype(np.int64)
            feature = f"frames={len(parts)};min={e.min()};max={e.max()};sum={e.sum()};energy={(e * e).sum()};turns={int(((e[1:] < 0) != (e[:-1] < 0)).sum())}"
            yield i, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(x), hashlib.sha256(x).hexdigest(), feature

    return _map_binary(media, f, "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", media_col, list(keep))
