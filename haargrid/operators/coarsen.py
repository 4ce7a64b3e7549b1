"""Coarsening trees under a threshold, a round at a time, and adaptive building.

A round gathers each parent's leaves (8 at most) with one shuffle and decides from their
details: all of them small, and the parent becomes a leaf; or all that hold a dimension,
and that dimension is given up. Bounds: ``flat`` compares a detail with the threshold,
``per_volume`` with the threshold by the node's volume, ``sum_volume`` the details' sum with
the threshold times the volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haargrid.functions import paths
from haargrid.functions.tables import settled

#: Details no larger than this count as zero: sums of equal numbers differ by rounding.
ZERO = 1e-12


def _families(leaves: DataFrame) -> DataFrame:
    """Leaves by parent; ``whole`` where all children are leaves. Details and volume of whole ones."""
    kids = leaves.filter(F.size("refs") > 0).groupBy("tree_id", paths.parent(F.col("path")).alias("up")).agg(
        F.first("refs").alias("refs"), F.array_sort(F.collect_list(F.struct(paths.slot(F.col("path"), F.length("path") - 1).alias("slot"), "value", "path"))).alias("kids")
    )
    ref = F.element_at("refs", -1)
    up_refs = F.slice("refs", 1, F.size("refs") - 1)
    n = F.call_function("shiftleft", F.lit(1), paths.bits(ref))
    detail = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda j: F.abs(F.aggregate(F.col("kids"), F.lit(0.0), lambda a, k: a + paths.sign(k["slot"], j) * k["value"])) / n,
    )
    return kids.select("tree_id", "up", up_refs.alias("up_refs"), ref.alias("ref"), "kids", (F.size("kids") == n).alias("whole"), F.when(F.size("kids") == n, detail).alias("detail"), paths.volume(up_refs).alias("volume"))


def _bounded(d: Column, volume: Column, threshold: float | Column, bound: str) -> Column:
    if bound == "flat":
        return d <= threshold + ZERO
    if bound == "per_volume":
        return d <= threshold / volume + ZERO
    raise ValueError(f"unknown bound {bound!r}")


def _holding(indexes: Column, mask: Column) -> Column:
    return F.filter(indexes, lambda j: j.bitwiseAND(mask) != 0)


def decisions(leaves: DataFrame, threshold: float | Column, bound: str = "flat", partial: bool = True) -> DataFrame:
    """Families with ``give``: the refined dimensions to give up (all of them: the parent becomes a leaf),
    and ``discarded``, the L1 of the details that go; one that holds two of the dimensions counts twice."""
    fam = _families(leaves)
    ref, d = F.col("ref"), F.col("detail")
    index = F.sequence(F.lit(1), F.size(d) - 1)
    small = lambda js: F.forall(js, lambda j: _bounded(F.element_at(d, j + 1), F.col("volume"), threshold, bound))
    total = lambda js: F.aggregate(js, F.lit(0.0), lambda a, j: a + F.element_at(d, j + 1))
    fam = fam.withColumn("all", F.col("whole") & (F.aggregate(index, F.lit(0.0), lambda a, j: a + F.element_at(d, j + 1)) <= threshold * F.col("volume") + ZERO if bound == "sum_volume" else small(index)))
    give, lost = F.lit(0), F.lit(0.0)
    if partial and bound != "sum_volume":
        masks = [F.call_function("shiftleft", F.lit(1), F.bit_count(ref.bitwiseAND((1 << e) - 1)).cast("int")) for e in range(paths.DIMS)]
        oks = [F.col("whole") & (ref.bitwiseAND(1 << e) != 0) & small(_holding(index, m)) for e, m in enumerate(masks)]
        fam = fam.select("*", *[F.coalesce(ok, F.lit(False)).alias(f"ok_{e}") for e, ok in enumerate(oks)])
        for e, m in enumerate(masks):
            give = give + F.when(F.col(f"ok_{e}"), F.lit(1 << e)).otherwise(0)
            lost = lost + F.when(F.col(f"ok_{e}"), total(_holding(index, m))).otherwise(0.0)
    fam = fam.withColumn("give", F.coalesce(F.when(F.col("all"), ref).otherwise(give), F.lit(0)))
    fam = fam.withColumn("discarded", F.coalesce(F.when(F.col("all"), total(index)).when(F.col("give") > 0, lost), F.lit(0.0)) * F.col("volume"))
    return fam.drop(*[f"ok_{e}" for e in range(paths.DIMS)])


def coarsening_round(leaves: DataFrame, threshold: float | Column = 0.0, bound: str = "flat", partial: bool = True) -> tuple[DataFrame, DataFrame]:
    """(new leaves with ``changed`` and ``discarded`` of their parent's decision, decisions)."""
    plan = decisions(leaves, threshold, bound, partial)
    keep = F.col("ref") - F.col("give")
    n = F.call_function("shiftleft", F.lit(1), paths.bits(keep))
    groups = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda s: F.struct(
            s.alias("slot"),
            (F.aggregate(F.filter(F.col("kids"), lambda k: paths.project(k["slot"], F.col("ref"), keep) == s), F.lit(0.0), lambda a, k: a + k["value"]) * n / F.size("kids")).alias("value"),
        ),
    )
    same = F.transform("kids", lambda k: F.struct(k["slot"].alias("slot"), k["value"].alias("value")))
    made = plan.select("tree_id", "up", "up_refs", "ref", "give", "discarded", F.posexplode(F.when(F.col("give") > 0, groups).otherwise(same)).alias("pos", "kid"))
    leaf = F.col("give") == F.col("ref")
    new = made.select(
        "tree_id",
        F.when(leaf, F.col("up")).otherwise(F.concat("up", F.col("kid.slot").cast("string"))).alias("path"),
        F.when(leaf, F.col("up_refs")).otherwise(F.concat("up_refs", F.array(F.col("ref") - F.col("give")))).alias("refs"),
        F.col("kid.value").alias("value"),
        (F.col("give") > 0).alias("changed"),
        F.when(F.col("pos") == 0, F.col("discarded")).otherwise(0.0).alias("discarded"),
    )
    roots = leaves.filter(F.size("refs") == 0).select("tree_id", "path", "refs", "value", F.lit(False).alias("changed"), F.lit(0.0).alias("discarded"))
    return new.unionByName(roots), plan


def canonical(leaves: DataFrame, threshold: float | Column = 0.0, bound: str = "flat") -> DataFrame:
    """Rounds until nothing changes: leaves with ``discarded``, the L1 of all rounds, by tree.

    Each round with a change takes a dimension from a node, so rounds end, after as many at most as a tree has
    dimensions and depths. Only trees that the last round has changed are looked at again. ``threshold`` may be an
    expression of tree_id: trees of several thresholds then share the rounds.
    """
    now = settled(leaves.select("tree_id", "path", "refs", "value"))
    done, lost = None, None
    while True:
        new = settled(coarsening_round(now, threshold, bound)[0])
        part = settled(new.groupBy("tree_id").agg(F.sum("discarded").alias("discarded"), F.max("changed").alias("changed")))
        gone = part.select("tree_id", "discarded")
        lost = gone if lost is None else lost.unionByName(gone)
        changed = part.filter("changed").select("tree_id")
        new = new.select("tree_id", "path", "refs", "value")
        finished = new.join(part.filter("not changed").select("tree_id"), "tree_id", "left_semi")
        done = finished if done is None else done.unionByName(finished)
        if changed.isEmpty():
            break
        now = new.join(changed, "tree_id", "left_semi")
    total = lost.groupBy("tree_id").agg(F.sum("discarded").alias("discarded"))
    return done.join(total, "tree_id")


def lineage(leaves: DataFrame, threshold: float | Column, bound: str = "flat", partial: bool = True) -> DataFrame:
    """(tree_id, path, new_path): for every leaf the leaf of the next round that its region is in."""
    plan = decisions(leaves, threshold, bound, partial)
    keep = F.col("ref") - F.col("give")
    moved = plan.select("tree_id", "up", "ref", "give", keep.alias("keep"), F.explode("kids").alias("kid"))
    slot = paths.project(F.col("kid.slot"), F.col("ref"), F.col("keep"))
    new = F.when(F.col("give") == 0, F.col("kid.path")).when(F.col("keep") == 0, F.col("up")).otherwise(F.concat("up", slot.cast("string")))
    roots = leaves.filter(F.size("refs") == 0).select("tree_id", "path", F.col("path").alias("new_path"))
    return moved.select("tree_id", F.col("kid.path").alias("path"), new.alias("new_path")).unionByName(roots)


def adaptive(cells: DataFrame, coords: list[str], levels: int) -> DataFrame:
    """Minimal isotropic tree of a full grid: uniform regions are one leaf.

    For each depth a region's least and largest value are aggregated once; a leaf is the
    largest uniform region around a cell, so no loop over rounds is needed.
    """
    full = cells.select("tree_id", paths.path_of([F.col(c) for c in coords], levels).alias("cell"), F.col("value").cast("double").alias("value"))
    region = full.select("tree_id", "value", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("d"), "cell").select("tree_id", F.substr("cell", F.lit(1), F.col("d")).alias("path"), "value")
    uniform = region.groupBy("tree_id", "path").agg(F.min("value").alias("value"), F.max("value").alias("high")).filter(F.col("value") == F.col("high"))
    # a uniform region is a leaf unless its parent is uniform too
    outer = uniform.select("tree_id", F.col("path").alias("up"))
    leaf = uniform.withColumn("up", F.when(F.length("path") > 0, paths.parent(F.col("path")))).join(outer, ["tree_id", "up"], "left_anti")
    return leaf.select("tree_id", "path", F.array_repeat(F.lit((1 << len(coords)) - 1), F.length("path")).alias("refs"), "value")


def adaptive_sparse(voxels: DataFrame, coords: list[str], levels: int, background: float = 0.0, dealt: bool = False) -> DataFrame:
    """The same trees from the stored voxels (grid, coordinates, value) of many small grids, whose boxes are never filled.

    Voxels are dealt out by grid once (not at all if they are ``dealt`` out by grid already); regions and leaves are grouped below
    that, so no other row of a tree moves, here and in groupings by tree that follow. A task holds the nodes of its trees, many times
    the bytes of the voxels that come in, so the caller of a large table deals them out into partitions by rows, which aren't joined
    by bytes. What no voxel lies in is background and a leaf beside a region that is split.
    """
    dims = len(coords)
    full = voxels.select(F.col("grid").alias("tree_id"), paths.path_of([F.col(c) for c in coords], levels).alias("cell"), F.col("value").cast("double").alias("value"))
    full = full if dealt else full.repartition("tree_id")
    region = full.select("tree_id", "value", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("d"), "cell").select("tree_id", F.substr("cell", F.lit(1), F.col("d")).alias("path"), "value")
    node = region.groupBy("tree_id", "path").agg(F.count("*").alias("stored"), F.min("value").alias("low"), F.max("value").alias("high"))
    holes = F.col("stored") < F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(levels) - F.length("path")) * dims)
    low, high = (F.when(holes, f(F.col(c), F.lit(background))).otherwise(F.col(c)) for f, c in ((F.least, "low"), (F.greatest, "high")))
    node = node.select("tree_id", "path", low.alias("low"), (low != high).alias("split"))
    own = F.struct("path", F.when(~F.col("split"), F.col("low")).alias("value"), F.col("split").alias("split"), (F.col("path") == "").alias("beside"))
    child = F.transform(F.sequence(F.lit(0), F.lit((1 << dims) - 1)), lambda i: F.struct(F.concat("path", i.cast("string")).alias("path"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("split"), F.lit(True).alias("beside")))
    met = node.select("tree_id", F.inline(F.when(F.col("split"), F.concat(F.array(own), child)).otherwise(F.array(own)))).groupBy("tree_id", "path").agg(F.max("value").alias("value"), F.max("split").alias("split"), F.max("beside").alias("beside"))
    return met.filter(F.col("beside") & ~F.col("split")).select("tree_id", "path", F.array_repeat(F.lit((1 << dims) - 1), F.length("path")).alias("refs"), F.coalesce("value", F.lit(background)).alias("value"))


def what_if(leaves: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each tree and threshold, how much would be left of it without changing it: surviving boxes and nodes.

    A node can go if all inner nodes below it can and its own details sum up to at most the threshold
    times its volume. All thresholds share one transform.
    """
    from haargrid.operators import haar

    steps = haar._steps(leaves)
    n = F.call_function("shiftleft", F.lit(1), paths.bits(F.col("ref")))
    details = (
        steps.select("*", F.explode(F.sequence(F.lit(1), n - 1)).alias("j"))
        .groupBy("tree_id", "node", "j").agg(F.sum(paths.sign(F.col("slot"), F.col("j")) * F.col("value") * F.col("share")).alias("c"))
        .groupBy("tree_id", "node").agg(F.sum(F.abs("c")).alias("d"))
    )
    volumes = leaves.select("tree_id", "path", "refs", F.explode(F.sequence(F.lit(0), F.greatest(F.size("refs") - 1, F.lit(0)))).alias("k")).filter(F.size("refs") > 0)
    volumes = volumes.select("tree_id", F.substr("path", F.lit(1), F.col("k")).alias("node"), paths.volume(F.slice("refs", F.lit(1), F.col("k"))).alias("volume")).distinct()
    inner = details.join(volumes, ["tree_id", "node"]).select("tree_id", "node", (F.col("d") / F.col("volume")).alias("need"))
    # the threshold from which a node and all below it can go
    up = inner.select("tree_id", "need", F.explode(F.sequence(F.lit(0), F.length("node"))).alias("k"), "node").select("tree_id", F.substr("node", F.lit(1), F.col("k")).alias("node"), "need")
    goes = up.groupBy("tree_id", "node").agg(F.max("need").alias("from"))
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    stays = goes.select("tree_id", "node", "from", each).groupBy("tree_id", "threshold").agg(
        F.count_if(F.col("from") > F.col("threshold") + ZERO).alias("inner_left"), F.count_if(F.col("from") <= F.col("threshold") + ZERO).alias("coarsenable")
    )
    # leaves that are left: those whose parent stays, and coarsened nodes whose parent stays
    child = goes.select("tree_id", F.col("node").alias("path"), F.col("from")).unionByName(leaves.select("tree_id", "path", F.lit(float("-inf")).alias("from")))
    parents = goes.select("tree_id", F.col("node").alias("up"), F.col("from").alias("up_from"))
    fate = child.withColumn("up", F.when(F.length("path") > 0, paths.parent(F.col("path")))).join(parents, ["tree_id", "up"], "left")
    boxes = fate.select("tree_id", "from", "up_from", each).groupBy("tree_id", "threshold").agg(
        F.count_if((F.col("from") <= F.col("threshold") + ZERO) & (F.col("up_from").isNull() | (F.col("up_from") > F.col("threshold") + ZERO))).alias("boxes")
    )
    return boxes.join(stays, ["tree_id", "threshold"], "left").select("tree_id", "threshold", "boxes", F.coalesce("inner_left", F.lit(0)).alias("inner_nodes"), F.coalesce("coarsenable", F.lit(0)).alias("coarsenable"))
