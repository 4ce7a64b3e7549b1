"""Columns over tree paths.

A leaf carries its place in itself: ``path`` has a child slot (0 to 7) for each step from
the root, ``refs`` the refinement of each ancestor (bit d: halved in dimension d). In a
slot, the lowest refined dimension is the lowest bit. Lexicographic order of paths is
pre-order, prefixes are ancestors, and level, index and volume follow without a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = 3


def depth(path: Column) -> Column:
    return F.length(path)


def parent(path: Column) -> Column:
    return F.substr(path, F.lit(1), F.greatest(F.length(path) - 1, F.lit(0)))


def slot(path: Column, at: Column | int) -> Column:
    """Child slot of the step at depth ``at`` (0: from the root)."""
    return F.substr(path, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(1)).cast("int")


def bits(ref: Column) -> Column:
    return F.bit_count(ref).cast("int")


def level(refs: Column, dim: int) -> Column:
    """How often a node is halved in a dimension."""
    return F.aggregate(refs, F.lit(0), lambda a, r: a + F.shiftright(r, dim).bitwiseAND(1))


def volume(refs: Column) -> Column:
    return F.pow(F.lit(2.0), -F.aggregate(refs, F.lit(0), lambda a, r: a + bits(r)))


def index(path: Column, refs: Column, dim: int) -> Column:
    """Index of the node along a dimension, at its level there."""
    steps = F.arrays_zip(F.transform(refs, lambda r: r.cast("long")).alias("r"), F.transform(F.filter(F.split(path, ""), lambda c: c != ""), lambda c: c.cast("long")).alias("s"))

    def step(a: Column, x: Column) -> Column:
        r, s = x["r"], x["s"]
        rank = F.bit_count(r.bitwiseAND((1 << dim) - 1)).cast("int")  # refined dimensions below this one
        bit = F.call_function("shiftright", s, rank).bitwiseAND(1)
        return F.when(F.shiftright(r, dim).bitwiseAND(1) == 1, F.shiftleft(a, 1) + bit).otherwise(a)

    return F.aggregate(steps, F.lit(0).cast("long"), step)


def sign(slot: Column, j: Column) -> Column:
    """Entry of the Haar matrix: -1 to the number of bits that slot and j share."""
    return F.when(F.bit_count(slot.bitwiseAND(j)) % 2 == 0, 1.0).otherwise(-1.0)


def morton(coords: list[Column], levels: int) -> Column:
    """Interleaved bits of coordinates, dimension 0 lowest."""
    out = F.lit(0).cast("long")
    for b in range(levels):
        for d, c in enumerate(coords):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(1), b * len(coords) + d))
    return out


def unmorton(code: Column, dims: int, levels: int, dim: int) -> Column:
    out = F.lit(0).cast("long")
    for b in range(levels):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(code.cast("long"), b * dims + dim).bitwiseAND(1), b))
    return out


def path_of(coords: list[Column], levels: int) -> Column:
    """Path of a cell of a full grid that halves all its dimensions at each step."""
    steps = []
    for b in reversed(range(levels)):
        s = F.lit(0).cast("long")
        for d, c in enumerate(coords):
            s = s + F.shiftright(c.cast("long"), b).bitwiseAND(1) * (1 << d)
        steps.append(s.cast("string"))
    return F.concat(*steps)


def steps(path: Column, refs: Column) -> Column:
    """For each step from the root the refinement (bits 3 to 5) and the child slot with its bits at their dimensions' places (0 to 2)."""
    return F.transform(refs, lambda r, i: r * 8 + spread(F.substr(path, i + 1, F.lit(1)).cast("int"), r))


def marked_index(steps: Column, dim: int) -> Column:
    """Index of a node along a dimension with a one above its bits, so that its level there shows too: up to 62 levels."""
    return F.aggregate(steps, F.lit(1).cast("long"), lambda a, s: F.when(s.bitwiseAND(8 << dim) == 0, a).when(s.bitwiseAND(1 << dim) == 0, a * 2).otherwise(a * 2 + 1))


def marked_level(mark: Column) -> Column:
    """How often a node is halved in a dimension, from its marked index there."""
    return F.length(F.bin(mark)) - 1


def begun(path: Column) -> Column:
    """How many ancestors begin with this leaf: a node has just one first leaf, so nodes are listed or counted there without being told apart."""
    return F.length(path) - F.length(F.rtrim(path, F.lit("0")))


def has(ref: Column, dim: int) -> Column:
    return ref.bitwiseAND(1 << dim) != 0


def _table(entry: Callable[[int, int], int]) -> str:
    """A lookup for all refinements and slots, as one literal: much less to plan and run than shifts by counts of bits."""
    return "array(" + ",".join(str(entry(ref, x)) for ref in range(1 << DIMS) for x in range(1 << DIMS)) + ")"


def _dims(ref: int) -> list[int]:
    return [d for d in range(DIMS) if ref >> d & 1]


_SPREAD = _table(lambda ref, slot: sum((slot >> i & 1) << d for i, d in enumerate(_dims(ref))))
_PACKED = _table(lambda ref, bits: sum((bits >> d & 1) << i for i, d in enumerate(_dims(ref))))


def spread(slot: Column, ref: Column) -> Column:
    """The bits of a child slot at the places of their dimensions."""
    return F.get(F.expr(_SPREAD), ref * 8 + slot)


def packed(bits: Column, ref: Column) -> Column:
    """The child slot of bits at the places of their dimensions."""
    return F.get(F.expr(_PACKED), ref * 8 + bits)


def project(slot: Column, ref: Column, keep: Column) -> Column:
    """The slot's bits of the dimensions in ``keep`` (part of ``ref``), packed again."""
    return packed(spread(slot, ref).bitwiseAND(keep), keep)
