"""Restructuring compression of single trees: push-down of dimensions, coarsening, normalising.

What a plain aggregation can't express, path rewriting over several levels, runs on one
tree at a time inside ``mapInArrow``, many small trees in a batch. A tree is a float (leaf) or (ref, children), the
children in slot order. Large trees are cut by a path prefix and composed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO = 1e-12


def dims(ref: int) -> list[int]:
    return [d for d in range(ref.bit_length()) if ref >> d & 1]


def project(slot: int, ref: int, keep: int) -> int:
    """The slot's bits of the dimensions in ``keep``, packed again."""
    return sum((slot >> i & 1) << k for k, i in enumerate(i for i, d in enumerate(dims(ref)) if keep >> d & 1))


def spread(slot: int, part: int, ref: int) -> int:
    """A slot of ``part``'s dimensions as bits of a slot of ``ref``."""
    order = dims(ref)
    return sum((slot >> k & 1) << order.index(d) for k, d in enumerate(dims(part)))


def mean(t) -> float:
    return t if isinstance(t, float) else sum(map(mean, t[1])) / len(t[1])


def details(t) -> list[float]:
    """|details| by index; 0 at index 0."""
    values, n = [mean(c) for c in t[1]], len(t[1])
    return [0.0] + [abs(sum(-v if (i & j).bit_count() & 1 else v for i, v in enumerate(values))) / n for j in range(1, n)]


def coarsen(t, threshold: float, bound: str = "flat", volume: float = 1.0):
    """One round: (tree, whether anything changed, discarded L1)."""
    if isinstance(t, float):
        return t, False, 0.0
    ref, kids = t
    if not all(isinstance(c, float) for c in kids):
        done = [coarsen(c, threshold, bound, volume / len(kids)) for c in kids]
        return (ref, [d[0] for d in done]), any(d[1] for d in done), sum(d[2] for d in done)
    limit = (threshold if bound == "flat" else threshold / volume) + ZERO
    d = details(t)
    if max(d) <= limit:
        return mean(t), True, volume * sum(d)
    give, lost = 0, 0.0
    for i, e in enumerate(dims(ref)):
        own = [x for j, x in enumerate(d) if j >> i & 1]
        if max(own) <= limit:
            give |= 1 << e
            lost += sum(own)
    if not give:
        return t, False, 0.0
    keep = ref & ~give
    groups: list[list[float]] = [[] for _ in range(1 << keep.bit_count())]
    for s, c in enumerate(kids):
        groups[project(s, ref, keep)].append(c)
    return (keep, [sum(g) / len(g) for g in groups]), True, volume * lost


def push(t, e: int):
    """Dimension e of a node moves below its other ones; pairs of inner nodes with one refinement, without e, become one."""
    ref, kids = t
    keep, one = ref & ~(1 << e), 1 << e
    out = []
    for r in range(1 << keep.bit_count()):
        base = spread(r, keep, ref)
        pair = [kids[base | spread(b, one, ref)] for b in (0, 1)]
        if all(not isinstance(c, float) for c in pair) and pair[0][0] == pair[1][0] and not pair[0][0] & one:
            c = pair[0][0]
            both = c | one
            out.append((both, [pair[project(s, both, one)][1][project(s, both, c)] for s in range(1 << both.bit_count())]))
        else:
            out.append((one, pair))
    return keep, out


def normalize(t):
    """Nodes take over dimensions that all their children halve and they don't, inner ones first, until none is left."""
    if isinstance(t, float):
        return t
    t = (t[0], [normalize(c) for c in t[1]])
    while all(not isinstance(c, float) for c in t[1]):
        common = ~t[0]
        for c in t[1]:
            common &= c[0]
        if not (common := common & 0xFF):
            break
        ref = t[0] | common
        out: list = []
        for s in range(1 << ref.bit_count()):
            c = t[1][project(s, ref, t[0])]
            rest, at = c[0] & ~common, project(s, ref, common)
            found = [c[1][spread(at, common, c[0]) | spread(k, rest, c[0])] for k in range(1 << rest.bit_count())]
            out.append(normalize((rest, found)) if rest else found[0])
        t = (ref, out)
    return t


def best_dim(t) -> int:
    """The dimension with the smallest detail of its own (to 12 decimals); ties go to the highest."""
    d, order = details(t), dims(t[0])
    return min(((round(d[1 << i], 12), -e) for i, e in enumerate(order)))[1] * -1


def _push_all(t):
    """Pushes at every node with two or more dimensions and two or more leaves among its children."""
    if isinstance(t, float):
        return t, False
    done = [_push_all(c) for c in t[1]]
    new = (t[0], [d[0] for d in done])
    if t[0].bit_count() > 1 and sum(isinstance(c, float) for c in t[1]) > 1:
        return push(new, best_dim(t)), True
    return new, any(d[1] for d in done)


def downsplit(t, threshold: float, bound: str = "flat"):
    """Push everywhere, coarsen once, normalise; again while that coarsens anything. (tree, discarded L1)"""
    lost = 0.0
    while True:
        pushed, any_push = _push_all(t)
        new, changed, gone = coarsen(pushed, threshold, bound)
        if not changed:
            return (t if any_push else normalize(new)), lost
        lost += gone
        t = normalize(new)


def decomposed(t, threshold: float, bound: str = "flat"):
    """Each outermost node with two or more leaf children for itself: push, coarsen to the end, normalise. (tree, discarded L1)"""
    lost = 0.0

    def visit(t, volume: float):
        nonlocal lost
        if isinstance(t, float):
            return t, False
        if sum(isinstance(c, float) for c in t[1]) > 1:
            new, any_change, gone = push(t, best_dim(t)) if t[0].bit_count() > 1 else t, False, 0.0
            while True:
                new, changed, g = coarsen(new, threshold, bound, volume)
                gone += g
                if not changed:
                    break
                any_change = True
            if any_change:
                lost += gone
                return normalize(new), True
            return t, False
        done = [visit(c, volume / len(t[1])) for c in t[1]]
        return (t[0], [d[0] for d in done]), any(d[1] for d in done)

    while True:
        t, changed = visit(t, 1.0)
        if not changed:
            return t, lost


# trees and rows


def tree_of(rows: list[tuple[str, list[int], float]], depth: int = 0):
    """A tree from its leaves (path, refs, value) in order of paths."""
    if len(rows) == 1 and len(rows[0][0]) == depth:
        return float(rows[0][2])
    return int(rows[0][1][depth]), [tree_of(list(g), depth + 1) for _, g in groupby(rows, key=lambda r: r[0][depth])]


def rows_of(t, path: str = "", refs: tuple[int, ...] = ()) -> list[tuple[str, list[int], float]]:
    if isinstance(t, float):
        return [(path, list(refs), t)]
    return [r for s, c in enumerate(t[1]) for r in rows_of(c, f"{path}{s}", (*refs, t[0]))]


def push_and_back(t, *_):
    """Pushes the best dimension of the root down and normalises: the tree as it was."""
    return (normalize(push(t, best_dim(t))) if not isinstance(t, float) and t[0].bit_count() > 1 else t), 0.0


SCHEDULERS = {"batched": downsplit, "decomposed": decomposed, "normalize": lambda t, *_: (normalize(t), 0.0), "push_and_back": push_and_back}
BOUNDS = ("flat", "per_volume")


def restructure(leaves: DataFrame, scheduler: str = "batched", threshold: float | Column = 0.0, bound: str = "flat", prefix: int = 0) -> DataFrame:
    """Leaves of the restructured trees, with the discarded L1 of each (sub)tree at its first leaf. ``threshold`` may be an expression of tree_id.

    ``prefix`` cuts trees at that depth, so that a large tree is as many tasks as it has nodes
    there; seams between the parts are coarsened by ``coarsen.canonical`` only. Leaves above
    the cut stay as they are.
    """
    if bound not in BOUNDS:
        raise ValueError(f"unknown bound {bound!r}; there are {BOUNDS}")
    run = SCHEDULERS[scheduler]
    fields = leaves.select("tree_id", "path", "refs", "value", F.lit(0.0).alias("discarded")).schema

    def parts(batches: Iterator[pa.RecordBatch]):
        """Rows of all batches in order: a tree's part is never split, however batches are cut."""
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, out = to_arrow_schema(fields), []
        for (tree_id, cut), rows in groupby(parts(batches), key=lambda r: (r[0], r[1])):
            rows = list(rows)
            n = len(cut)
            above = rows[0][3][:n]
            volume = 2.0 ** -sum(int(r).bit_count() for r in above)
            tree, lost = run(tree_of([(p[n:], refs[n:], v) for _, _, p, refs, v, _ in rows]), rows[0][5], bound)
            for k, (p, refs, v) in enumerate(rows_of(tree)):
                out.append((tree_id, cut + p, above + refs, v, lost * volume if k == 0 else 0.0))
            if len(out) > 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    top = leaves.select("tree_id", F.substr("path", F.lit(1), F.lit(prefix)).alias("top"), "path", "refs", "value", (threshold if isinstance(threshold, Column) else F.lit(float(threshold))).alias("threshold"))
    return top.repartition("tree_id", "top").sortWithinPartitions("tree_id", "top", "path").mapInArrow(f, fields)
