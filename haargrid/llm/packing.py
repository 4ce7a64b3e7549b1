"""Packing token streams into sequences by order-preserving dynamic programming.

Documents keep the order in which a task reads them and form one stream. A sequence is a
window of the stream; its cuts cost nothing at a document's end, a little at a sentence's
end and more inside a sentence (only where a sentence runs on). Windows are padded to the
sequence length, except those of a power of two. The best cuts up to each place follow from
the best of the places one window before: a monotone queue holds their minimum, and windows
of a power of two are looked up. No row is shuffled; a task's last, short window is cut into
powers of two where that costs less than its padding.
"""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from haargrid.llm.bpe import encode_text, load_ranks
from haargrid.llm.rows import slices, small_batches, tidy

LENGTH = 1024
#: Costs of a cut, in tokens of padding: behind a sentence, inside one; and how far a stretch without a place to cut may reach.
SENTENCE, INSIDE, STRETCH = 1, 6, 32
#: Tokens that are planned together; the last window is planned again with those that follow.
PLAN = 1 << 18


@functools.lru_cache(1)
def _tokenizer(path: str):
    """The tokenizer of a byte-level .json file, and by id whether a sentence may end behind the token."""
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens=added)
    ends = np.zeros(enc.n_vocab, bool)
    for i in range(enc.n_vocab):
        b = enc.decode_single_token_bytes(i)
        ends[i] = b"\n" in b or b.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?")
    return enc, ends, re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None


def token_ids(enc, text: str, special: re.Pattern | None) -> Iterator[np.ndarray]:
    """Ids of a text as the tokenizer gives them, in arrays: special strings are their tokens, what is between them is encoded apart."""
    parts = special.split(text) if special and special.search(text) else [text]
    for k, part in enumerate(parts):
        if k % 2:
            yield np.array([enc.encode_single_token(part)], np.uint32)
        else:
            for ids in encode_text(enc, part, lambda t: enc.encode_to_numpy(t, disallowed_special=())):
                yield np.asarray(ids, np.uint32)


def best_cuts(place: list[int], cost: list[int], length: int = LENGTH) -> list[int]:
    """Indexes of the cuts of least padding plus cut costs, from the first place to the last.

    ``place`` ascends, neighbours at most ``length`` apart. Padding is ``length`` less the
    window, or nothing for a window of a power of two.
    """
    n = len(place)
    best, back = [0] * n, [0] * n
    where = {p: i for i, p in enumerate(place)}
    value = [0] * n  # best + place: what a window start adds to the cost at its end
    value[0] = place[0]
    queue = deque([0])
    powers = [1 << k for k in range(length.bit_length() - 1) if 1 << k >= 64]
    for j in range(1, n):
        p = place[j]
        floor = p - length
        while place[queue[0]] < floor:
            queue.popleft()
        i = queue[0]
        least = value[i] + length - p
        if least > best[i]:  # some padding: a window of a power of two may do without
            for w in powers:
                h = where.get(p - w)
                if h is not None and best[h] < least:
                    least, i = best[h], h
        best[j] = least + cost[j]
        back[j] = i
        v = value[j] = best[j] + p
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(j)
        j = back[j]
    return [0, *reversed(cuts)]


def _places(ids: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Where the stream may be cut (0 and its end included), and at what cost."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    cost[1:][ends[ids]] = SENTENCE
    cost[doc_ends] = 0
    cost[0] = 0
    if cost[-1] < 0:
        cost[-1] = INSIDE
    at = np.flatnonzero(cost >= 0)
    gap = np.diff(at)
    more = (gap - 1) // STRETCH
    if more.any():
        start = np.repeat(at[:-1], more)
        step = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        cost[start + step * STRETCH] = INSIDE
        at = np.flatnonzero(cost >= 0)
    return at.tolist(), cost[at].tolist()


def _tail(n: int, length: int) -> list[int]:
    """Windows of a short rest: powers of two are cut off while a cut costs less than the padding it saves."""
    out = []
    while n:
        w = 1 << (n.bit_length() - 1)
        if w == n or length - n <= INSIDE:
            out.append(n)
            break
        out.append(w)
        n -= w
    return out


class _Packer:
    """One task's stream."""

    def __init__(self, ends: np.ndarray, first_sequence: int, length: int):
        self.ends, self.sequence, self.length = ends, first_sequence, length
        self.docs: list[tuple] = []  # (id, tokens of the document, its ids before this part, part)
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        for at in range(0, len(ids), PLAN):
            part = ids[at : at + PLAN]
            self.docs.append((doc_id, len(ids), at, part))
            self.held += len(part)
            if self.held >= PLAN:
                self.plan(False)

    def plan(self, last: bool) -> None:
        if not self.held:
            return
        stream = np.concatenate([d[3] for d in self.docs])
        bounds = np.cumsum([len(d[3]) for d in self.docs])
        whole = np.array([d[2] + len(d[3]) == d[1] for d in self.docs])
        place, cost = _places(stream, self.ends, bounds[whole])
        cuts = [place[i] for i in best_cuts(place, cost, self.length)]
        windows = list(zip(cuts[:-1], cuts[1:], strict=True))
        a, b = windows.pop()
        if last:
            for w in _tail(b - a, self.length):
                windows.append((a, a + w))
                a += w
            self._emit(stream, bounds, windows)
            self.docs, self.held = [], 0
            return
        self._emit(stream, bounds, windows)
        k = int(np.searchsorted(bounds, a, "right"))
        before = int(bounds[k - 1]) if k else 0
        d = self.docs[k]
        self.docs = [(d[0], d[1], d[2] + a - before, d[3][a - before :]), *self.docs[k + 1 :]]
        self.held = b - a

    def _emit(self, stream: np.ndarray, bounds: np.ndarray, windows: list[tuple[int, int]]) -> None:
        ends = bounds.tolist()
        raw = memoryview(stream.astype("<u4").tobytes())
        k = 0
        for a, b in windows:
            at = a
            while at < b:
                k = bisect_left(ends, at + 1, k)
                doc_id, total, before, part = self.docs[k]
                stop = min(b, ends[k])
                start = before + at - (ends[k] - len(part))
                self.rows.append((doc_id, start, stop - at, zlib.crc32(raw[4 * at : 4 * stop]), total, self.sequence, at - a))
                at = stop
            self.sequence += 1


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` tokens.

    A document is its text's ids, then ``end_id``; null and empty texts are that one id.
    Null ids and repeated rows are packed like others, white space of any length too. Sequence numbers hold the task's
    number in their upper bits, so they are unique without a shuffle.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    cols = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string(cols).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        enc, ends, special = _tokenizer(tokenizer_path)
        packer = _Packer(ends, TaskContext.get().partitionId() << 36, length)
        end = np.array([end_id], np.uint32)

        def rows():
            got, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), arrow, strict=True)], schema=arrow)

        for b in batches:
            for at, stop in slices(b.column(1)):
                for doc_id, text in zip(b.column(0).slice(at, stop - at).to_pylist(), b.column(1).slice(at, stop - at).to_pylist(), strict=True):
                    packer.add(doc_id, np.concatenate([*token_ids(enc, text or "", special), end]))
                if len(packer.rows) >= 4096:
                    yield rows()
        packer.plan(True)
        if packer.rows:
            yield rows()

    return small_batches(docs).select(id_col, text_col).mapInArrow(tidy(run), schema)
