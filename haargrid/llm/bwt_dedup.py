"""Removal of byte strings that an earlier document has, by merging Burrows-Wheeler transforms.

Strings of 50 bytes are compared. Each has an anchor, the 20-byte string of least hash in
it; equal strings have equal anchors, so only documents with an anchor in common can share
a string. Blocks of documents tell which anchors they have, learn which of them others
have too, and send the contexts of those: the bytes of runs of strings that have the anchor in common.

A receiver makes equal contexts one (by their bytes) and cuts those of an anchor in two by where the
anchor lies in the string, which lengthens what the strings of a part must share. Where different
contexts are left, they are put into two shards; each shard's suffixes are sorted into its
transform, and the transforms are merged by refining their interleave: after h rounds suffixes
are in order by h bytes, and a place where a new interval starts has h - 1 as its common prefix. After 50 rounds,
or as soon as a round starts none, an interval holds equal strings, and its smallest document
keeps them. No merged suffix is sorted again. What is too much for one merge is cut in two again, so a call's memory is bounded.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haargrid.llm.exchange import mix
from haargrid.llm.rows import small_batches, tidy, written
from haargrid.llm.set_join import ranges

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
#: Documents of a block on average; bytes from which on a block is cut; blocks from which on an anchor's
#: contexts are sent in parts (of FINE places of the anchor) that spread over more receivers.
BLOCK, BYTES, HOT, FINE = 1024, 4 << 20, 32, 8
#: Bytes that are hashed together (they fit a processor's cache), a longer text in parts; and of contexts merged together.
TOGETHER, MERGED = 1 << 17, 1 << 18
#: Contexts of whole groups that a receiver works on together.
ENTRIES = 1 << 15
BASE = 0x9E3779B97F4A7C15
_POWER = [np.uint64(pow(BASE, k, 1 << 64)) for k in range(GRAM + 1)]


# anchors


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place."""
    h1 = data.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * _POWER[1] + h1[1:]
    h4 = h2[:-2] * _POWER[2] + h2[2:]
    h8 = h4[:-4] * _POWER[4] + h4[4:]
    h16 = h8[:-8] * _POWER[8] + h8[8:]
    return mix(h16[: len(data) - GRAM + 1] * _POWER[4] + h4[16 : 16 + len(data) - GRAM + 1])


class Grams:
    """``gram_hashes`` of some places only, computed when they are asked for."""

    def __init__(self, data: np.ndarray):
        self.data = data

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.uint64)
        for k in range(GRAM):
            out = out * _POWER[1] + (self.data[places + k].astype(np.uint64) + np.uint64(1))
        return mix(out)


def runs_of(texts: list[bytes]):
    """(buffer, its hashes, text, anchor, first string, last string) of all runs of strings with one anchor."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts) + bytes(LENGTH + SPAN), np.uint8)
    h = gram_hashes(data)
    # the leftmost of least hash: the place goes into the low bits; windows double up to SPAN
    key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < SPAN:
        key = np.minimum(key[: width - SPAN], key[SPAN - width :])
    p = ranges(ends - sizes, ends - sizes + np.maximum(sizes - LENGTH + 1, 0))
    owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - LENGTH + 1, 0))
    if not len(p):
        z = np.zeros(0, np.int64)
        return data, h, z, z, z, z
    a = (key[p] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.append(first[1:] - 1, len(p) - 1)
    return data, h, owner[first], a[first], p[first], p[last]


def context_key(h: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Key of a context: 20-byte strings that cover it, and its length."""
    k = mix(group + (hi - lo).astype(np.uint64))
    for at in (lo, lo + GRAM, hi + LENGTH - 2 * GRAM, hi + LENGTH - GRAM):
        k = mix(k ^ h[at])
    return k


def parts_of(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut by where the anchor lies in their strings, ``width`` places a part: (run, first string, last string)."""
    first, last = (a - hi) // width, (a - lo) // width
    back = np.repeat(np.arange(len(a)), last - first + 1)
    c = ranges(first, last + 1)
    return back, np.maximum(lo[back], a[back] - (c + 1) * width + 1), np.minimum(hi[back], a[back] - c * width)


def shared_key(h: np.ndarray, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Key of the bytes that all strings of such a part, in any document, have in common."""
    if width >= SPAN:
        return h[a]
    c = (a - hi) // width
    start = a - c * width
    end = a + GRAM + np.maximum(SPAN - (c + 1) * width, 0)
    k = mix(h[start] ^ (c * SPAN + width).astype(np.uint64))
    return mix(mix(k ^ h[(start + end - GRAM) // 2]) ^ h[end - GRAM])


def _has(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def contexts(texts: list[bytes], repeated: np.ndarray, hot: np.ndarray):
    """Contexts of anchors that other documents have too: buffer, keys, keys of what their strings share, texts,
    first and last strings, anchors, widths of their parts (FINE for anchors that are hot)."""
    data, h, owner, a, lo, hi = runs_of(texts)
    some = _has(repeated, h[a])
    owner, a, lo, hi = owner[some], a[some], lo[some], hi[some]
    fine = _has(hot, h[a])
    width = np.full(len(a), SPAN)
    if fine.any():
        back, x, y = parts_of(a[fine], lo[fine], hi[fine], FINE)
        owner, a, lo, hi, width = (np.concatenate([u[~fine], v]) for u, v in ((owner, owner[fine][back]), (a, a[fine][back]), (lo, x), (hi, y), (width, np.full(len(x), FINE))))
    group = np.empty(len(a), np.uint64)
    for w in (SPAN, FINE):
        own = width == w
        group[own] = shared_key(h, a[own], lo[own], hi[own], w)
    return data, context_key(h, group, lo, hi), group, owner, lo, hi, a, width


def distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each context, of the smallest document, in order of groups; and the number of each entry's context. Bytes are compared."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    while True:
        order = np.lexsort((doc, key, group))
        head = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (group[order][1:] != group[order][:-1])])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(head) - 1
        one = order[head]
        more = np.flatnonzero(one[of] != np.arange(len(of)))
        rep = one[of[more]]
        other = size[more] != size[rep]
        same = more[~other]
        rep, at = rep[~other], np.flatnonzero(~other)
        for x in range(0, len(same), 1 << 13):
            s, r = same[x : x + (1 << 13)], rep[x : x + (1 << 13)]
            n = size[s]
            unequal = data[ranges(start[s], start[s] + n)] != data[ranges(start[r], start[r] + n)]
            other[at[x : x + len(s)][np.logical_or.reduceat(unequal, np.cumsum(n) - n)]] = True
        if not other.any():
            return one, of
        key = key.copy()  # different bytes under one key: they get another
        key[more[other]] = mix(key[more[other]])


# transforms


def _transform(text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and transform of strings that end in 0 (other symbols are 1 to 256); starts of the strings."""
    n = len(text)
    shut = text == 0  # whether a string ends in the symbols seen so far
    key = text.astype(np.int64)
    for k in range(1, 7):
        key <<= 9
        key[: n - k] |= np.where(shut[: n - k], 0, text[k:])
        shut[: n - k] |= text[k:] == 0
    order = np.argsort(key, kind="stable").astype(np.int32)
    fresh = np.ones(n, bool)
    fresh[1:] = (key[order[1:]] != key[order[:-1]]) | shut[order[1:]]  # strings that have ended differ, in the order of the strings
    width = 7
    while not fresh.all():
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(fresh, dtype=np.int32) - 1
        key = rank.astype(np.int64)
        key *= n + 1
        key[: n - width] += rank[width:]
        order = np.argsort(key, kind="stable").astype(np.int32)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        width *= 2
    before = np.empty(n, text.dtype)
    before[1:] = text[:-1]
    before[start] = 0
    return order, before[order]


def merged_intervals(shards: list[tuple[np.ndarray, np.ndarray]], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shard, place in it, interval (suffixes that agree in ``depth`` symbols) and common prefix with the suffix before
    (``depth`` at most) of all suffixes in merged order.

    ``shards`` has for each shard (two at most) its text and its strings' starts.
    """
    built = [_transform(*s) for s in shards]
    symbols = np.concatenate([b[1] for b in built])
    used = np.unique(symbols)
    small = np.zeros(257, np.uint8 if len(used) <= 256 else np.uint16)
    small[used] = np.arange(len(used))  # as few symbols as there are: bytes sort fastest
    symbols = small[symbols]
    ended = np.concatenate([np.full(int((s[0] == 0).sum()), k, bool) for k, s in enumerate(shards)])
    n = len(symbols)
    z = np.arange(n) >= len(built[0][1])
    common = np.full(n, -1, np.int8)  # what isn't known yet
    common[0] = 0
    interval = np.zeros(n, np.int32)

    def rows(z: np.ndarray) -> np.ndarray:
        """Row of each merged suffix among the shards' rows: a shard's come in order."""
        ones = np.cumsum(z, dtype=np.int32)
        return np.where(z, ones + np.int32(len(built[0][1]) - 1), np.arange(n, dtype=np.int32) - ones)

    for h in range(depth):
        s = symbols[rows(z)]
        order = np.argsort(s, kind="stable")
        z = z[order]
        z[: len(ended)] = ended
        s, old = s[order], interval[order]
        fresh = np.ones(n, bool)
        fresh[1:] = (s[1:] != s[:-1]) | (old[1:] != old[:-1])
        fresh[: len(ended) + 1] = True
        new = fresh & (common < 0)
        common[new] = h
        if not new.any() and h:  # no two suffixes have a common prefix of h symbols, so none has one of h + 1
            break
        interval = np.cumsum(fresh, dtype=np.int32)
    common[common < 0] = depth
    place = np.concatenate([b[0] for b in built])[rows(z)]
    return z.astype(np.int8), place, np.cumsum(common < depth, dtype=np.int32), common


def least_documents(texts: list[bytes], docs: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
    """For each context the smallest document that has the string, string by string."""
    parts = []
    for k in np.unique(shard).tolist():
        own = np.flatnonzero(shard == k)
        sizes = np.array([len(texts[i]) + 1 for i in own.tolist()])
        text = np.frombuffer(b"".join(texts[i] + b"\0" for i in own.tolist()), np.uint8).astype(np.uint16) + np.uint16(1)
        start = np.cumsum(sizes) - sizes
        text[start + sizes - 1] = 0
        parts.append((own, text, start, sizes))
    z, place, interval, _ = merged_intervals([(p[1], p[2]) for p in parts])
    doc = np.empty(len(z), np.int64)
    for k, p in enumerate(parts):
        mine = z == k
        doc[mine] = np.repeat(docs[p[0]], p[3])[place[mine]]
    head = np.ones(len(z), bool)
    head[1:] = interval[1:] != interval[:-1]
    first = np.flatnonzero(head)
    least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(z))))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    for k, (own, text, start, sizes) in enumerate(parts):
        mine = z == k
        back = np.empty(len(text), np.int64)
        back[place[mine]] = least[mine]
        for i, s, n in zip(own.tolist(), start.tolist(), sizes.tolist(), strict=True):
            out[i] = back[s : s + n - LENGTH].copy()
    return out


# Spark


def _pack(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def _pieces(ids: list, texts: list[bytes]):
    """Runs of rows with about TOGETHER bytes; a longer text in parts whose strings don't repeat."""
    rows, held = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 1), TOGETHER):
            part = t[at : at + TOGETHER + LENGTH - 1]
            rows.append((i, at, part))
            held += len(part)
            if held >= TOGETHER:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _by_bucket(keys: np.ndarray, n: int):
    """Order by bucket, and where each bucket (in use) begins and ends in it."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    if not len(order):
        return order, []
    used, at = np.unique(bucket[order], return_index=True)
    return order, [(int(b), int(x), int(y)) for b, x, y in zip(used, at, [*at[1:], len(order)], strict=True)]


def _announce(n_buckets: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(1).to_pylist(), [t or b"" for t in batch.column(2).to_pylist()]
            blocks = np.array(batch.column(0).to_pylist(), np.int64)
            grams, docs = [], []
            for rows in _pieces(ids, texts):
                _, h, owner, a, _, _ = runs_of([r[2] for r in rows])
                row = np.array([r[0] for r in rows])
                grams.append(h[a])
                docs.append(row[owner])
            if not grams:
                continue
            gram, doc = np.concatenate(grams), np.concatenate(docs)
            fine = np.array([i is not None for i in ids])[doc]
            gram, doc = gram[fine], doc[fine]
            for b in np.unique(blocks).tolist():
                own = blocks[doc] == b
                g, d = gram[own], doc[own]
                order = np.argsort(g, kind="stable")  # rows of a gram stay in order
                g, d = g[order], d[order]
                head = np.concatenate([np.ones(min(1, len(g)), bool), g[1:] != g[:-1]])
                last = np.concatenate([np.flatnonzero(head)[1:] - 1, [len(g) - 1]])[: int(head.sum())]
                many = d[head] != d[last]
                g = g[head]
                order, buckets = _by_bucket(g, n_buckets)
                g, many = g[order], many[order]
                rows = [(k, b, _pack(g[x:y][~many[x:y]], "<u8"), _pack(g[x:y][many[x:y]], "<u8")) for k, x, y in buckets]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "once", "often"])

    return run


def _by_buckets(f):
    """f over the rows of each bucket, bucket after bucket: a task holds one at a time."""

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                if held and bucket[x] != last:
                    yield from f(held)
                    held = []
                last = bucket[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield from f(held)

    return tidy(run)


def _answered(batches, hot_blocks: int):
    """Which anchors of a block another document has too, and which of them very many blocks have."""
    blocks, keys, row, many = [], [], [], []
    for batch in batches:
        for block, once, often in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            a, b = np.frombuffer(once, "<u8"), np.frombuffer(often, "<u8")
            keys += [a, b]
            row.append(np.full(len(a) + len(b), len(blocks)))
            many.append(np.arange(len(a) + len(b)) >= len(a))
            blocks.append(block)
    key, row, many = np.concatenate(keys), np.concatenate(row), np.concatenate(many)
    order = np.argsort(key, kind="stable")
    key, row, many = key[order], row[order], many[order]
    head = np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
    group = np.cumsum(head) - 1
    size = np.bincount(group)
    known = (size > 1) | (np.bincount(group, many) > 0)
    pick = known[group]
    key, row, hot = key[pick], row[pick], size[group[pick]] > hot_blocks
    order = np.argsort(row, kind="stable")
    key, row, hot = key[order], row[order], hot[order]
    at = np.searchsorted(row, np.arange(len(blocks) + 1))
    out = [(blocks[k], _pack(key[x:y], "<u8"), _pack(key[x:y][hot[x:y]], "<u8")) for k, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if y > x]
    for k in range(0, len(out), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 256], strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "repeated", "hot"])


def _sorted_keys(column) -> np.ndarray:
    parts = [np.frombuffer(x, "<u8") for x in column.to_pylist() if x]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _squeezed(batches):
    """Texts compressed for the shuffle that both passes read."""
    z = zstandard.ZstdCompressor(3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(x) for x in b.column(2).to_pylist()], pa.binary())], names=["block", "doc_id", "raw"])


def _texts(docs: pa.Table) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(x) for x in docs.column("raw").to_pylist()]


SENT = "bucket int, block long, n int, about binary, context binary"


def _send(n_buckets: int):
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T._parse_datatype_string(SENT))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """A block's distinct contexts of repeated anchors, with the smallest and largest document of each."""
        repeated, hot = _sorted_keys(answers.column("repeated")), _sorted_keys(answers.column("hot"))
        if not len(repeated):
            return schema.empty_table()
        ids = docs.column("doc_id").to_pylist()
        texts = [t if i is not None else b"" for t, i in zip(_texts(docs), ids, strict=True)]
        block = docs.column("block")[0].as_py()
        got: list[tuple] = []
        for rows in _pieces(ids, texts):
            data, key, group, owner, lo, hi, a, width = contexts([r[2] for r in rows], repeated, hot)
            doc = np.array([ids[r[0]] if ids[r[0]] is not None else 0 for r in rows], np.int64)[owner]
            n = hi - lo + LENGTH
            got.append((group, key, a - lo, width, doc, n, data[ranges(lo, lo + n)]))
        group, key, at, width, doc, n, data = (np.concatenate([g[i] for g in got]) for i in range(7))
        start = np.cumsum(n) - n
        one, of = distinct(data, start, n, group, key, doc)
        if not len(one):
            return schema.empty_table()
        if (np.diff(np.sort(key[one])) == 0).any():
            raise ValueError("different contexts of a block have one key; run again with another BASE")
        most = np.full(len(one), np.iinfo(np.int64).min)
        np.maximum.at(most, of, doc)
        order, buckets = _by_bucket(group[one], n_buckets)
        z = zstandard.ZstdCompressor(3)
        rows = []
        for k, x, y in buckets:
            o = one[order[x:y]]
            about = b"".join((_pack(at[o], "u1"), _pack(width[o], "u1"), _pack(n[o], "u1"), _pack(doc[o], "<i8"), _pack(most[order[x:y]], "<i8")))
            rows.append((k, block, len(o), z.compress(about), z.compress(data[ranges(start[o], start[o] + n[o])].tobytes())))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def answers_of(data: np.ndarray, h: np.ndarray, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, doc: np.ndarray, shard: np.ndarray, merged: int = MERGED) -> tuple[np.ndarray, np.ndarray]:
    """For each context the smallest document of each of its strings: numbers, and where each context's begin.

    Equal contexts are one; one that no other shares anything with has its own document for answer. Of the
    others, parts of half the width are compared in the same way, until merging them is little work.
    """
    group = shared_key(h, a, lo, hi, width)
    one, of = distinct(data, lo, hi - lo + LENGTH, group, context_key(h, group, lo, hi), doc)
    n = (hi - lo + 1)[one]
    begin = np.cumsum(n) - n
    least = np.repeat(doc[one], n)
    g = group[one]
    first = np.concatenate([np.ones(min(1, len(g)), bool), g[1:] != g[:-1]])
    number = np.cumsum(first) - 1
    rest = np.flatnonzero(np.bincount(number)[number] > 1) if len(g) else g.astype(np.int64)
    bytes_of = n + LENGTH
    total = np.bincount(number, bytes_of)[number] if len(g) else n
    # whole anchors and what is too much are cut; a part of one string has no other part to differ from
    cut = (total[rest] > merged) | (width == SPAN)
    deep = rest[cut & (width > 1)]
    if len(deep):
        half = (width + 1) // 2
        back, x, y = parts_of(a[one[deep]], lo[one[deep]], hi[one[deep]], half)
        got, at = answers_of(data, h, a[one[deep]][back], x, y, half, doc[one[deep]][back], shard[one[deep]][back], merged)
        size = y - x + 1
        least[ranges(begin[deep[back]] + x - lo[one[deep[back]]], begin[deep[back]] + x - lo[one[deep[back]]] + size)] = got[ranges(at, at + size)]
    todo = rest[~cut]
    at = 0
    while at < len(todo):
        stop = at + max(1, int(np.searchsorted(np.cumsum(bytes_of[todo[at:]]), merged)))
        while stop < len(todo) and number[todo[stop]] == number[todo[stop - 1]]:
            stop += 1
        some = todo[at:stop]
        texts = [data[lo[k] : hi[k] + LENGTH].tobytes() for k in one[some].tolist()]
        for i, found in zip(some.tolist(), least_documents(texts, doc[one[some]], shard[one[some]] % 2), strict=True):
            least[begin[i] : begin[i] + n[i]] = found
        at = stop
    return least, begin[of]


def _later_runs(data, h, a, lo, hi, w, doc, most, row, own):
    """By block: keys, runs of strings and their smallest document, of the contexts that a larger document has."""
    a, lo, hi, most, row = a[own], lo[own], hi[own], most[own], row[own]
    least, begin = answers_of(data, h, a, lo, hi, w, doc[own], row)
    key = context_key(h, shared_key(h, a, lo, hi, w), lo, hi)
    for x in range(0, len(own), 1 << 13):
        n = (hi - lo + 1)[x : x + (1 << 13)]
        entry, string = np.repeat(np.arange(x, x + len(n)), n), ranges(np.zeros_like(n), n)
        value = least[ranges(begin[x : x + len(n)], begin[x : x + len(n)] + n)]
        fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (entry[1:] != entry[:-1])])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:] - 1, len(fresh) - 1)
        later = value[first] < most[entry[first]]
        first, last = first[later], last[later]
        e = entry[first]
        order = np.argsort(row[e], kind="stable")
        block = row[e][order]
        cols = key[e][order], string[first][order], string[last][order], value[first][order]
        used, start = np.unique(block, return_index=True)
        for b, i, j in zip(used.tolist(), start.tolist(), [*start[1:].tolist(), len(block)] if len(used) else [], strict=True):
            yield b, [c[i:j] for c in cols]


def _merged(batches):
    """For each block and context the runs of strings that a smaller document has, with that document."""
    z = zstandard.ZstdDecompressor()
    blocks, raw, about, row = [], [], [], []
    for batch in batches:
        for block, n, numbers, context in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
            b = z.decompress(numbers)
            about.append((*(np.frombuffer(b, np.uint8, n, i * n).astype(np.int64) for i in range(3)), np.frombuffer(b, "<i8", n, 3 * n), np.frombuffer(b, "<i8", n, 11 * n)))
            raw.append(z.decompress(context))
            row.append(np.full(n, len(blocks)))
            blocks.append(block)
    at, width, size, doc, most = (np.concatenate(x) for x in zip(*about, strict=True))
    row = np.concatenate(row)
    data = np.frombuffer(b"".join(raw) + bytes(LENGTH), np.uint8)
    del raw, about
    h = Grams(data)
    lo = np.cumsum(size) - size
    hi, a = lo + size - LENGTH, lo + at
    group = np.empty(len(lo), np.uint64)
    for w in np.unique(width).tolist():
        own = width == w
        group[own] = shared_key(h, a[own], lo[own], hi[own], w)
    order = np.lexsort((group, width))
    cut = np.flatnonzero(np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (width[order][1:] != width[order][:-1])]))
    out: dict[int, list] = {}
    begin = 0
    while begin < len(order):
        # whole groups of one width, ENTRIES or more
        k = int(np.searchsorted(cut, begin + ENTRIES))
        end = int(cut[k]) if k < len(cut) else len(order)
        w = int(width[order[begin]])
        end = min(end, int(np.searchsorted(width[order], w, "right")))
        for block, runs in _later_runs(data, h, a, lo, hi, w, doc, most, row, order[begin:end]):
            out.setdefault(blocks[block], []).append(runs)
        begin = end
    rows = [(b, *(_pack(np.concatenate(c), t) for c, t in zip(zip(*parts, strict=True), ("<u8", "u1", "u1", "<i8"), strict=True))) for b, parts in out.items()]
    for i in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 256], strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)], names=["block", "keys", "from_", "to_", "doc"])


def _cut(docs: pa.Table, found: pa.Table) -> pa.Table:
    """Each document of a block without the strings that a smaller document has."""
    ids = docs.column("doc_id").to_pylist()
    texts = _texts(docs)
    repeated, hot = _sorted_keys(found.column("repeated")), _sorted_keys(found.column("hot"))
    parts = [[np.frombuffer(x, t) for x in found.column(c).to_pylist() if x is not None] for c, t in (("keys", "<u8"), ("from_", "u1"), ("to_", "u1"), ("doc", "<i8"))]
    covered = [np.zeros(len(t) + 1, np.int32) for t in texts]
    if parts[0] and len(repeated):
        keys, from_, to_, doc = (np.concatenate(p) for p in parts)
        order = np.argsort(keys, kind="stable")
        keys, from_, to_, doc = keys[order], from_[order].astype(np.int64), to_[order].astype(np.int64), doc[order]
        for rows in _pieces(ids, [t if i is not None else b"" for t, i in zip(texts, ids, strict=True)]):
            _, key, _, owner, lo, _, _, _ = contexts([r[2] for r in rows], repeated, hot)
            x, y = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            n = y - x
            back = np.repeat(np.arange(len(key)), n)
            hit = x[back] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            mine = np.array([ids[r[0]] if ids[r[0]] is not None else -1 for r in rows], np.int64)[owner[back]]
            later = doc[hit] < mine
            back, hit = back[later], hit[later]
            if not len(back):
                continue
            start = np.cumsum([0, *(len(r[2]) for r in rows)])[:-1]
            at = lo[back] - start[owner[back]] + np.array([r[1] for r in rows])[owner[back]]
            row = np.array([r[0] for r in rows])[owner[back]]
            order = np.argsort(row, kind="stable")
            row, begin, end = row[order], (at + from_[hit])[order], (at + to_[hit] + LENGTH)[order]
            used, p = np.unique(row, return_index=True)
            for r, i, j in zip(used.tolist(), p.tolist(), [*p[1:].tolist(), len(row)], strict=True):
                np.add.at(covered[r], begin[i:j], 1)
                np.add.at(covered[r], end[i:j], -1)
    out = []
    for t, c in zip(texts, covered, strict=True):
        gone = np.cumsum(c[:-1]) > 0
        removed = int(gone.sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if removed else t
        spans = int(np.diff(np.concatenate([[0], gone.view(np.int8)])).clip(0).sum()) if removed else 0
        out.append((len(t), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
    cols = list(zip(*out, strict=True))
    return pa.Table.from_arrays([docs.column("doc_id").combine_chunks(), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_size: int = BLOCK, hot_blocks: int = HOT, block_bytes: int = BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row: its bytes without each 50-byte string
    that starts in a document with a smaller id too.

    A null text is empty; texts of under 50 bytes lose nothing. A row without an id is kept
    whole and takes no part; rows with the same id don't affect each other. Ids are long numbers.

    Anchors are looked up by 64-bit hashes, which only proposes; contexts are compared by their bytes, and a block
    knows its own contexts by a 64-bit key and fails if two of them had the same.
    """
    tasks = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(256, 4 * tasks)
    doc = F.col(id_col).cast("long")
    rows = small_batches(docs).select(doc.alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("raw"))
    # neighbouring ids are a block, so that what a task reads belongs to few of them; one of many bytes is cut
    ids = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n")).first()
    width = max(1, ((ids.high - ids.low + 1) * block_size // ids.n)) if ids.n else 1
    rows = rows.withColumn("span", F.coalesce(F.floor(F.col("doc_id") / width).cast("long"), -1 - F.pmod(F.xxhash64("raw"), F.lit(1 << 20))))
    large = written(rows.groupBy("span").agg(F.ceil(F.sum(F.octet_length("raw")) / block_bytes).cast("int").alias("n_parts")).filter("n_parts > 1"))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("n_parts")), F.lit(0)).cast("long")
    rows = rows.join(large, "span", "left").select(F.xxhash64("span", part).alias("block"), "doc_id", "raw")
    by_block = rows.mapInArrow(tidy(_squeezed), "block long, doc_id long, raw binary").groupBy("block")
    told = rows.mapInArrow(tidy(_announce(n)), "bucket int, block long, once binary, often binary")
    answers = told.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_by_buckets(lambda b: _answered(b, hot_blocks)), "block long, repeated binary, hot binary")
    sent = by_block.cogroup(answers.groupBy("block")).applyInArrow(_send(n), SENT)
    merged = sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_by_buckets(_merged), "block long, keys binary, from_ binary, to_ binary, doc binary")
    found = answers.unionByName(merged, allowMissingColumns=True)
    out = by_block.cogroup(found.groupBy("block")).applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("doc_id", id_col)
