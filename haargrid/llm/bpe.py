"""Byte-level BPE encoding and decoding of whole texts by overlapping chunks.

Every text is cut into chunks that overlap. Each chunk is split into pre-tokens
by itself; its first ones may be wrong, since it starts anywhere, but the chunk before has the
same characters in its overlap. Neighbours are stitched where their pre-token boundaries agree again; what lies between
two such places is a piece, which is encoded apart from the others. Only boundaries at which white space follows other text count:
no pre-token of the pattern reaches over them, whatever stands before. A text of many chunks is first dealt out to tasks as
large chunks, rows of their own, in the same way. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haargrid.llm.rows import BATCH, slices, small_batches, tidy, written

#: Characters that the \\s of the pattern matches (Unicode White_Space).
WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of a chunk, and of its overlap with the next.
CHUNK, OVERLAP = 1024, 128
#: The same of what is dealt out to tasks, and of texts for which that is done.
LONG, DEALT, DEALT_OVERLAP = 1 << 16, 1 << 15, 256
#: A run of white space from which on the library's pattern matcher isn't asked; every STEP characters, such a run is met twice.
RUN, STEP = 4096, 1024
_RUN, _TWO, _START = re.compile(f"[{WHITE}]{{{RUN},}}"), re.compile(f"[{WHITE}]{{2}}"), re.compile(f"(?<=[^{WHITE}])[{WHITE}]")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes, from a .tiktoken file or the vocabulary of a byte-level .json file."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    # printable bytes stand for themselves, the others for the code points from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    char = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    with open(path, encoding="utf-8") as f:
        tokenizer = json.load(f)
    added = {t["content"] for t in tokenizer["added_tokens"]}
    return {bytes(char[c] for c in t): r for t, r in tokenizer["model"]["vocab"].items() if t not in added}


@functools.lru_cache(2)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def encode_text(enc, text: str, encode=None) -> Iterator:
    """Ids of a text, part after part, as ``encode`` (the library's lists, if not given) gives them. The library matches white
    space by recursion, so very long runs are taken out by the pattern's own rule: all but the last character are one match,
    or all where the text ends."""
    at, encode = 0, encode or enc.encode_ordinary
    if len(text) > RUN and _TWO.search(text[::STEP]):
        for m in _RUN.finditer(text):
            if m.start() > at:
                yield encode(text[at : m.start()])
            at = m.end() - (m.end() < len(text))
            yield enc._encode_single_piece(text[m.start() : at].encode())
    if at < len(text):
        yield encode(text[at:])


@functools.lru_cache(2)
def _matcher(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Starts of a chunk's pre-tokens at which white space follows other text: those in its first ``overlap`` characters, and
    those from ``chunk`` on, which the next chunk has too."""
    starts = [m.start() for m in _matcher(pattern).finditer(text)]
    fit = lambda some: [s for s in some if s and _START.match(text, s)]
    return fit(starts[: bisect_left(starts, overlap)]), fit(starts[bisect_left(starts, chunk) :])


def pieces(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[str]:
    """A text cut where its chunks' boundaries agree; a chunk that never agrees with the next goes on in it."""
    if len(text) <= chunk:
        if text:
            yield text
        return
    begin, tail = 0, []
    for at in range(0, len(text), chunk):
        head, after = boundaries(text[at : at + chunk + overlap], pattern, chunk, overlap)
        both = {at + s for s in head}.intersection(tail)
        if both:
            cut = min(both)
            yield text[begin:cut]
            begin = cut
        tail = [at + s for s in after]
    yield text[begin:]


@functools.lru_cache(2)
def _shown(path: str, pattern: str) -> tuple[list[str], list[bytes]]:
    """For each id its decimal text and its bytes."""
    enc = encoding(path, pattern)
    return [f"{i}" for i in range(enc.n_vocab)], [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]


class _Digest:
    """Count and digests of a stream of ids."""

    def __init__(self, path: str, pattern: str):
        self.text_of, self.bytes_of = _shown(path, pattern)
        self.n, self.ids_sha, self.raw_sha = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids) -> None:
        if len(ids):
            line = " ".join(map(self.text_of.__getitem__, ids))
            self.ids_sha.update((" " + line if self.n else line).encode())
            self.raw_sha.update(b"".join(map(self.bytes_of.__getitem__, ids)))
            self.n += len(ids)

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids_sha.hexdigest(), self.raw_sha.hexdigest()


def _schema(spec: list):
    from pyspark.sql.pandas.types import to_arrow_schema

    s = T.StructType([f for x in spec for f in (T._parse_datatype_string(x).fields if isinstance(x, str) else [x])])
    return s, to_arrow_schema(s)


def _by_row(batches, width: int):
    """Rows as tuples of a batch's columns; binary ones are views."""
    for b in batches:
        yield from zip(*(b.column(i) if pa.types.is_binary(b.column(i).type) else b.column(i).to_pylist() for i in range(width)), strict=True)


def _batched(rows, arrow, size_of):
    """Record batches of rows, by about BATCH bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += size_of(r)
        if size >= BATCH or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)


def encode_decode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, dealt: int = DEALT, dealt_overlap: int = DEALT_OVERLAP, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Ids of every whole text and the bytes that they decode to, as counts and digests.

    With ``keep_ids`` also the ids themselves. Null and empty texts have no tokens; null
    ids and repeated rows are passed on. Chunks of texts of up to ``long`` characters stay in their task;
    a longer one becomes rows of large chunks, of any number of tasks: only their boundaries, and then the
    pieces' ids, meet by document, and a piece is cut into small chunks again. A pre-token that is longer than chunks is one piece.
    """
    doc = T.StructField("doc", docs.schema[id_col].dataType)
    answer = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
    columns = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]

    def encoded_pieces(enc, text: str) -> Iterator[list[int]]:
        for piece in pieces(text, pattern, chunk, overlap):
            yield from encode_text(enc, piece)

    def by_text(batches):
        """(id, text), a few of a batch's texts at a time."""
        for b in batches:
            for x, y in slices(b.column(1)):
                yield from zip(b.column(0).slice(x, y - x).to_pylist(), b.column(1).slice(x, y - x).to_pylist(), strict=True)

    short_schema, short_arrow = _schema([T.StructField(id_col, doc.dataType), answer])

    def in_task(batches):
        """Answers of texts whose chunks stay together."""
        enc = encoding(path, pattern)

        def rows():
            for i, text in by_text(batches):
                d, kept = _Digest(path, pattern), []
                for ids in encoded_pieces(enc, text or ""):
                    d.add(ids)
                    if keep_ids:
                        kept += ids
                yield i, *d.row(), kept if keep_ids else None

        yield from _batched(rows(), short_arrow, lambda r: 200 + 4 * len(r[4] or ()))

    size = F.coalesce(F.length(text_col), F.lit(0))
    read = small_batches(docs).select(F.col(id_col), F.col(text_col))
    short = read.filter(size <= long).mapInArrow(tidy(in_task), short_schema).select(id_col, *columns)
    chunk_schema, chunk_arrow = _schema(["key long, k long", doc, "more boolean, part string"])

    def deal(batches):
        """Large chunks of long texts, with their overlap."""
        from pyspark import TaskContext

        def rows():
            for key, (i, text) in enumerate(by_text(batches), TaskContext.get().partitionId() << 33):
                for k, at in enumerate(range(0, len(text), dealt)):
                    yield key, k, i, at + dealt < len(text), text[at : at + dealt + dealt_overlap]

        yield from _batched(rows(), chunk_arrow, lambda r: 200 + len(r[4]))

    chunks = written(read.filter(size > long).mapInArrow(tidy(deal), chunk_schema))
    if chunks.isEmpty():
        return short

    seen_schema, seen_arrow = _schema(["key long, k long, head array<long>, tail array<long>"])

    def pretokens(batches):
        """Boundaries that large chunks have in common with their neighbours."""

        def rows():
            for key, k, more, part in _by_row(batches, 4):
                head, tail = boundaries(part, pattern, dealt, dealt_overlap)
                yield key, k, [k * dealt + s for s in head], [k * dealt + s for s in tail] if more else []

        yield from _batched(rows(), seen_arrow, lambda r: 64 + 8 * len(r[2]) + 8 * len(r[3]))

    of_text = Window.partitionBy("key").orderBy("k")
    seen = chunks.select("key", "k", "more", "part").repartition("key", "k").mapInArrow(tidy(pretokens), seen_schema)
    stitched = seen.withColumn("cut", F.array_min(F.array_intersect("tail", F.lead("head").over(of_text))))
    stitched = stitched.select(
        "key", "k", F.coalesce(F.lag("cut").over(of_text), F.col("k") * dealt).alias("begin"), F.coalesce("cut", (F.col("k") + 1) * dealt).alias("stop"),
        F.coalesce(F.count("cut").over(of_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("piece"),
    )
    placed = chunks.join(stitched.hint("merge"), ["key", "k"]).select("key", "piece", "k", "doc", (F.col("begin") - F.col("k") * dealt).alias("begin"), (F.col("stop") - F.col("k") * dealt).alias("stop"), "part")
    ids_schema, ids_arrow = _schema(["key long, piece long, at long", doc, "raw binary"])

    def encode(batches):
        """Ids of whole pieces, in rows of bounded size."""
        enc = encoding(path, pattern)

        def rows():
            held, last, of = [], None, None

            def out():
                at = 0
                for some in encoded_pieces(enc, "".join(held)):
                    for x in range(0, len(some), BATCH // 8):
                        yield *last, at, of, np.array(some[x : x + BATCH // 8], "<u4").tobytes()
                        at += 1

            for key, piece, _, doc_id, begin, stop, part in _by_row(batches, 7):
                if (key, piece) != last:
                    if held:
                        yield from out()
                    held, last, of = [], (key, piece), doc_id
                held.append(part[begin:stop])
            if held:
                yield from out()

        yield from _batched(rows(), ids_arrow, lambda r: 64 + len(r[4]))

    encoded = placed.repartition("key", "piece").sortWithinPartitions("key", "piece", "k").mapInArrow(tidy(encode), ids_schema)
    joined_schema, joined_arrow = _schema([T.StructField(id_col, doc.dataType), answer])

    def join(batches):
        """The pieces' ids of each text, in order."""

        def rows():
            d, last, of, kept = None, None, None, []
            for key, _, _, doc_id, raw in _by_row(batches, 5):
                if key != last:
                    if d:
                        yield of, *d.row(), kept if keep_ids else None
                    d, last, of, kept = _Digest(path, pattern), key, doc_id, []
                ids = np.frombuffer(raw.as_buffer(), "<u4").tolist()
                d.add(ids)
                if keep_ids:
                    kept += ids
            if d:
                yield of, *d.row(), kept if keep_ids else None

        yield from _batched(rows(), joined_arrow, lambda r: 200 + 4 * len(r[4] or ()))

    whole = encoded.repartition("key").sortWithinPartitions("key", "piece", "at").mapInArrow(tidy(join), joined_schema)
    return short.unionByName(whole.select(id_col, *columns))


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of each row's ids; a null list decodes to nothing."""

    @F.pandas_udf("binary")
    def joined(ids: pd.Series) -> pd.Series:
        single = encoding(path, pattern).decode_single_token_bytes
        return ids.map(lambda x: b"" if x is None else b"".join(map(single, map(int, x))))

    return tokens.select(id_col, joined(F.col(ids_col)).alias("decoded"))
