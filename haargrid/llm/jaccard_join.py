"""Exact Jaccard join of documents on word shingles, with set relations that skip work.

Equal sets are one. Sets of sizes that can match are cut by hash into more filled parts
than their difference may have elements, so two that link have an equal part; equal parts
give candidate groups. Inside a group, ``set_join`` skips blocks of the index lists by position, and
derives the answers of sets that are highly similar to an answered one from its answers.

Words and shingles are told by 64-bit hashes; equal sets by their size and two such sums of all elements.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haargrid.llm import set_join
from haargrid.llm.components import components
from haargrid.llm.exchange import mix, share_keys
from haargrid.llm.rows import slices, written

#: What op10 asks for; callers may ask for others.
WORDS = 3
#: Links need NUM * union <= DEN * intersection: nine tenths.
NUM, DEN = 9, 10
ROUNDS = 4  # cuts that are tried for a set that leaves many parts empty
PIECE = 1 << 16  # bytes of texts that are hashed together: they fit a processor's cache
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
ODD, MARK = np.uint64(0x100000001B3), np.uint64(0xD1B54A32D192ED03)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of lower-cased bytes; words are what white space doesn't separate."""
    inside = ~SPACES[data]
    start = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    if not len(start):
        return start, np.zeros(0, np.uint64)
    end = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1
    size = end - start
    first = np.cumsum(size) - size
    offset = np.arange(int(size.sum())) - np.repeat(first, size)
    power = np.cumprod(np.full(int(size.max()), ODD, np.uint64))
    h = np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * power[offset], first)
    return start, mix(h ^ size.astype(np.uint64) << np.uint64(48))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a shorter text's words are one shingle, none give none."""
    raw = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    bounds = np.cumsum([len(r) + 1 for r in raw])
    start, h = word_hashes(data)
    at = np.concatenate([[0], np.searchsorted(start, bounds)])
    s = h[: max(0, len(h) - words + 1)].copy()
    for k in range(1, words):
        s = mix(s) + h[k : k + len(s)]
    s = mix(s)
    out = []
    for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if y - x >= words:
            out.append(np.unique(s[x : y - words + 1]))
        elif y > x:
            short = np.array([y - x], np.uint64)
            for k in range(x, y):
                short = mix(short) + h[k : k + 1]
            out.append(mix(short ^ MARK))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two numbers that stand for a set."""
    both = np.array([mix(s ^ ODD).sum(dtype=np.uint64), mix(s + MARK).sum(dtype=np.uint64)], np.uint64)
    return tuple(mix(both + np.uint64(len(s))).view(np.int64).tolist())


def _bound(k: int, growth: float) -> int:
    """The first size of class k."""
    return k if k < 9 else int(9 * growth ** (k - 9))


def part_keys(s: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Keys of a set (not empty): sets that link at a similarity of num / den have one in common.

    A class holds sizes from one bound to below the next, and what can link with them. Two
    of it differ in at most (den - num) / num of the smaller size: ``most`` elements, which
    lie in as many parts at most. So of a set with more filled parts than that, a filled part
    is equal in the other. A set with fewer adds a second cut of its elements, and so on;
    after ROUNDS cuts, its elements one by one. Of two sets, the one that ends first shares
    a part of that cut with the other, which has made the same cut.
    """
    n = len(s)
    growth = 1.5 if num * 10 >= den * 9 else 1.25  # narrow classes where parts are small
    k = n if n < 9 else 9 + int(np.log(n / 9) / np.log(growth))
    while _bound(k + 1, growth) <= n:
        k += 1
    while _bound(k, growth) > n:
        k -= 1
    element = mix(s ^ MARK)
    cuts: list[tuple[np.ndarray, np.ndarray]] = []  # places in order, sums of the elements in that order
    keys = []
    while k > 0 and n * num <= (_bound(k + 1, growth) - 1) * den:
        most = (_bound(k + 1, growth) - 1) * (den - num) // num
        if most == 0:
            keys.append(mix(element.sum(dtype=np.uint64, keepdims=True) + np.uint64(k)))
            k -= 1
            continue
        # some more than would do if none were empty
        parts = most + 2 + most // (64 if _bound(k, growth) >= 5 * most else 8)
        inner = np.arange(1, parts, dtype=np.uint64) * np.uint64(2**64 // parts)
        for cut in range(ROUNDS):
            if cut == len(cuts):
                place = s if cut == 0 else mix(s + np.uint64(cut))
                order = np.argsort(place)
                cuts.append((place[order], np.concatenate([np.zeros(1, np.uint64), np.cumsum(element[order], dtype=np.uint64)])))
            place, total = cuts[cut]
            edge = np.concatenate([[0], np.searchsorted(place, inner), [n]])
            full = np.flatnonzero(edge[1:] > edge[:-1])
            label = mix(np.uint64(cut << 56 | k << 32) + full.astype(np.uint64))
            keys.append(mix(total[edge[full + 1]] - total[edge[full]] + label))
            if len(full) > most:
                break
        else:
            keys.append(mix(element + mix(np.array([ROUNDS << 56 | k << 32], np.uint64))))
        k -= 1
    return np.concatenate(keys)


def _sets_and_keys(words: int, num: int, den: int):
    def f(batch: pa.RecordBatch):
        ids, sizes, prints, keys, owners = batch.column(0).to_pylist(), [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in slices(batch.column(1), PIECE):
            for s in shingle_sets(batch.column(1).slice(a, b - a).to_pylist(), words):
                fp = fingerprint(s)
                if len(s) and ids[len(sizes)] is not None:
                    k = part_keys(s, num, den)
                    keys.append(k)
                    owners.append(np.full(len(k), fp[0]))
                sizes.append(len(s))
                prints.append(fp)
        fp, check = zip(*prints, strict=True)
        return [batch.column(0), sizes, fp, check], np.concatenate(keys), np.concatenate(owners)

    return f


def _sets_of(t: pa.Table, words: int) -> list[np.ndarray]:
    column, out = t.column("text").combine_chunks(), []
    for a, b in slices(column, PIECE):
        out += shingle_sets(column.slice(a, b - a).to_pylist(), words)
    # a text of another row with the same id is like nothing
    return [s if len(s) and fingerprint(s) == f else mix(np.array([i], np.uint64)) for i, (s, f) in enumerate(zip(out, zip(t.column("fp").to_pylist(), t.column("chk").to_pylist(), strict=True), strict=True))]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(id, n_shingles, component_id) of every row of documents.

    Documents link at a Jaccard similarity of num / den or more of their shingles of ``words``
    words (0.9 and 3 if not given); the component is named by its smallest id. A text without words (null, empty, only white
    space) links with nothing. A row without an id has no component; repeated rows are one
    document. Ids are long numbers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = written(share_keys(rows, partial(_sets_and_keys, words, num, den), "doc_id long, n_shingles long, fp long, chk long"))
    sets = shared.filter(F.col("fp").isNotNull()).select("doc_id", "n_shingles", "fp", "chk")
    groups = components(shared.filter(F.col("a").isNotNull()).select("a", "b"))
    same = ["fp", "chk", "n_shingles"]
    distinct = written(sets.filter("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("name")))
    wanted = written(distinct.join(groups, distinct.fp == groups.node).select("name", F.col("component").alias("grp"), "fp", "chk", "n_shingles"))
    members = written(rows.filter(F.col("text").isNotNull()).join(wanted.hint("merge"), rows.doc_id == wanted.name).select("grp", "name", "fp", "chk", "text"))
    sizes = wanted.groupBy("grp").agg(F.count("*").alias("n_members"), F.sum("n_shingles").alias("n_weight"))
    found = set_join.similar(members, sizes, partial(_sets_of, words=words), num, den)
    named = distinct.join(found, distinct.name == found.node, "left").select(*same, F.coalesce("component", "name").alias("component_id"))
    return sets.join(named, same, "left").select(
        F.col("doc_id").alias(id_col), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
