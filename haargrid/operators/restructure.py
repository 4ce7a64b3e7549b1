"""Restructuring as joins over leaves: trees of any size are dealt out by leaf, never gathered.

A node that is pushed gives up one of its dimensions, which goes below the others: a table of planned nodes,
(tree, node, dimension), is made for all trees and depths at once, and each leaf's path is rewritten from the plans of its
ancestors. Pairs of children that end up with the same refinement become one (sibling fusion), which the plans
tell by a join of children with their parent. Normalising is the reverse: a node takes over what all its children
halve. Both keep the boxes as they are, so each row still is its leaf; ``was`` is its path before.
Inside a rewriting a step's slot is spread: its bits stand at their dimensions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haargrid.functions import paths
from haargrid.functions.tables import settled
from haargrid.operators import coarsen, haar, kernel

#: Leaves of a tree that one task restructures by itself.
WHOLE = 1 << 15
#: Decimals to which details count when the smallest is chosen: sums in another order agree.
DECIMALS = 12
LEAF = ("tree_id", "path", "refs", "value")


def _bit(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), x)


def push_plan(leaves: DataFrame) -> DataFrame:
    """(tree_id, node, ref, push) of all inner nodes: ``push`` is the bit of the dimension that goes down, 0 for none.

    Nodes are pushed that halve two dimensions or more and have two leaves or more among their children; the dimension
    is the one with the smallest detail of its own, the highest of equal ones. One aggregation for all depths.
    """
    steps = haar._steps(leaves).select("tree_id", "node", "ref", paths.spread(F.col("slot"), F.col("ref")).alias("bits"), (F.col("value") * F.col("share")).alias("part"), (F.length("path") == F.col("d") + 1).alias("child"))
    detail = [F.abs(F.sum(F.when(paths.has(F.col("bits"), d), -F.col("part")).otherwise(F.col("part")))).alias(f"detail_{d}") for d in range(paths.DIMS)]
    nodes = steps.groupBy("tree_id", "node").agg(F.first("ref").alias("ref"), F.count_if("child").alias("leaves"), *detail)
    own = F.array(*[F.when(paths.has(F.col("ref"), d), F.struct(F.round(f"detail_{d}", DECIMALS).alias("detail"), F.lit(-d).alias("less"))) for d in range(paths.DIMS)])
    best = _bit(-F.array_min(F.filter(own, lambda x: x.isNotNull()))["less"])
    return nodes.select("tree_id", "node", "ref", F.when((paths.bits(F.col("ref")) > 1) & (F.col("leaves") > 1), best).otherwise(0).alias("push"))


def _fusions(plan: DataFrame) -> DataFrame:
    """(tree_id, node, fused): of pushed nodes the pairs of children that become one, a bit for each place of the pair."""
    kids = plan.filter("node != ''").select("tree_id", paths.parent(F.col("node")).alias("node"), F.substr("node", F.length("node"), F.lit(1)).cast("int").alias("slot"), (F.col("ref") - F.col("push")).alias("new"))
    up = plan.filter("push > 0").select("tree_id", "node", "ref", "push")
    pair = kids.join(up, ["tree_id", "node"]).select("tree_id", "node", "push", "new", paths.spread(F.col("slot"), F.col("ref")).bitwiseAND(F.bitwise_not("push")).alias("pair"))
    same = pair.groupBy("tree_id", "node", "push", "pair").agg(F.count("*").alias("n"), F.min("new").alias("new"), F.max("new").alias("other"))
    same = same.filter((F.col("n") == 2) & (F.col("new") == F.col("other")) & (F.col("new").bitwiseAND(F.col("push")) == 0))
    return same.groupBy("tree_id", "node").agg(F.sum(_bit(F.col("pair"))).cast("int").alias("fused"))


def _with_ancestors(leaves: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """``leaves`` with ``plans``, a map from an ancestor's depth to its columns of ``nodes``; null where no ancestor has a row."""
    up = leaves.filter(F.size("refs") > 0).select("tree_id", "path", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("refs") - 1), lambda d: F.substr("path", F.lit(1), d))).alias("d", "node"))
    met = up.join(nodes.select("tree_id", "node", *columns), ["tree_id", "node"]).groupBy("tree_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("d", F.struct(*columns)))).alias("plans"))
    return leaves.join(met, ["tree_id", "path"], "left")


def push_down(leaves: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """Leaves with every planned node pushed, inner ones first; with ``was``. ``plan`` is the stored ``push_plan``."""
    plan = settled(push_plan(leaves)) if plan is None else plan
    nodes = plan.filter("push > 0").join(_fusions(plan), ["tree_id", "node"], "left").select("tree_id", "node", "push", F.coalesce("fused", F.lit(0)).alias("fused"))
    rows = _with_ancestors(leaves.select(*LEAF), nodes, "push", "fused")
    given = F.transform("refs", lambda r, k: F.struct(r.alias("ref"), paths.slot(F.col("path"), k).alias("slot"), F.coalesce(F.try_element_at("plans", k)["push"], F.lit(0)).alias("push"), F.coalesce(F.try_element_at("plans", k)["fused"], F.lit(0)).alias("fused")))
    spreads = F.transform("steps", lambda s: F.struct(s["ref"].alias("ref"), paths.spread(s["slot"], s["ref"]).alias("bits"), s["push"].alias("push"), s["fused"].alias("fused")))
    fused = F.transform("steps", lambda s: F.struct(s["ref"].alias("ref"), s["bits"].alias("bits"), s["push"].alias("push"), ((s["push"] > 0) & (F.call_function("shiftright", s["fused"], s["bits"].bitwiseAND(F.bitwise_not(s["push"]))).bitwiseAND(1) == 1)).alias("fuse")))

    def emitted(s: Column, k: Column) -> Column:
        """What is left of a step, with what a fused one before hands down; then the pushed dimension, if it stands alone."""
        before = F.get("steps", k - 1)
        handed = lambda c: F.when(before["fuse"], c).otherwise(0)
        keep = F.bitwise_not(s["push"])
        rest = F.struct(s["ref"].bitwiseAND(keep).bitwiseOR(handed(before["push"])).alias("ref"), s["bits"].bitwiseAND(keep).bitwiseOR(handed(before["bits"].bitwiseAND(before["push"]))).alias("bits"))
        return F.when((s["push"] > 0) & ~s["fuse"], F.array(rest, F.struct(s["push"].alias("ref"), s["bits"].bitwiseAND(s["push"]).alias("bits")))).otherwise(F.array(rest))

    for steps in (given, spreads, fused, F.flatten(F.transform("steps", emitted))):
        rows = rows.withColumn("steps", F.when(F.col("plans").isNotNull(), steps))
    return _put_together(rows)


def _put_together(rows: DataFrame) -> DataFrame:
    """Leaves of their new ``steps`` (ref, bits); those without stay as they are."""
    path = F.array_join(F.transform("steps", lambda s: paths.packed(s["bits"], s["ref"]).cast("string")), "")
    was = "was" if "was" in rows.columns else "path"
    return rows.select("tree_id", F.coalesce(path, "path").alias("path"), F.coalesce(F.transform("steps", lambda s: s["ref"]), "refs").alias("refs"), "value", F.col(was).alias("was"))


def _takeovers(leaves: DataFrame) -> DataFrame:
    """(tree_id, node, take): the dimensions that all children of a node halve and it doesn't."""
    inner = leaves.filter(F.size("refs") > 0).select("tree_id", F.posexplode("refs").alias("d", "ref"), "path").groupBy("tree_id", F.substr("path", F.lit(1), F.col("d")).alias("node")).agg(F.first("ref").alias("ref"))
    kids = inner.filter("node != ''").groupBy("tree_id", paths.parent(F.col("node")).alias("node")).agg(F.count("*").alias("n"), F.bit_and("ref").alias("common"))
    take = F.col("common").bitwiseAND(F.bitwise_not("ref"))
    return inner.join(kids, ["tree_id", "node"]).filter((F.col("n") == _bit(paths.bits(F.col("ref")))) & (take > 0)).select("tree_id", "node", take.alias("take"))


def normalized(leaves: DataFrame) -> DataFrame:
    """Leaves of trees in which no node is left whose children all halve a dimension that it doesn't; with ``was``.

    A round takes over for all nodes at once and the order doesn't matter, so rounds go on while there is something to
    take over: as many as dimensions rise steps. Only trees that a round has changed are looked at again.
    """
    now, done = leaves.select(*LEAF, F.col("path").alias("was")), []
    while True:
        take = settled(_takeovers(now))
        if take.isEmpty():
            return reduce(DataFrame.unionByName, [*done, now])
        trees = take.select("tree_id").distinct()
        done.append(now.join(trees, "tree_id", "left_anti"))
        rows = _with_ancestors(now.join(trees, "tree_id", "left_semi"), take, "take")

        given = F.transform("refs", lambda r, k: F.struct(r.alias("ref"), paths.slot(F.col("path"), k).alias("slot"), F.coalesce(F.try_element_at("plans", k)["take"], F.lit(0)).alias("take")))
        spreads = F.transform("steps", lambda s: F.struct(s["ref"].alias("ref"), paths.spread(s["slot"], s["ref"]).alias("bits"), s["take"].alias("take")))

        def emitted(s: Column, k: Column) -> Column:
            """A step without what the one above takes, with what it takes from the one below; it may be nothing."""
            rest = F.bitwise_not(F.coalesce(F.get("steps", k - 1)["take"], F.lit(0)))
            below = F.coalesce(F.get("steps", k + 1)["bits"], F.lit(0)).bitwiseAND(s["take"])
            return F.struct(s["ref"].bitwiseAND(rest).bitwiseOR(s["take"]).alias("ref"), s["bits"].bitwiseAND(rest).bitwiseOR(below).alias("bits"))

        for steps in (given, spreads, F.filter(F.transform("steps", emitted), lambda s: s["ref"] != 0)):
            rows = rows.withColumn("steps", F.when(F.col("plans").isNotNull(), steps))
        now = settled(_put_together(rows))


def _followed(line: DataFrame | None, step: DataFrame, was: str = "was", path: str = "path") -> DataFrame:
    """(tree_id, origin, path): ``line`` carried on by a step's (tree_id, was, path)."""
    step = step.select("tree_id", F.col(was).alias("at"), F.col(path).alias("to"))
    if line is None:
        return step.select("tree_id", F.col("at").alias("origin"), F.col("to").alias("path"))
    return line.join(step, (line["tree_id"] == step["tree_id"]) & (line["path"] == step["at"])).select(line["tree_id"], "origin", F.col("to").alias("path"))


def downsplit(leaves: DataFrame, threshold: float | Column = 0.0, bound: str = "flat", lineage: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Push everywhere, coarsen once, normalise; again while that coarsens anything.

    (leaves with ``discarded``, the L1 of all rounds, by tree; lineage if asked for). The lineage has (tree_id, origin,
    path): the leaf before, and the leaf that holds it. A tree that a round doesn't coarsen stays as it was before that round's
    pushes, and leaves the loop. ``threshold`` may be an expression of tree_id.
    """
    now, done, lost, lines, line = settled(leaves.select(*LEAF)), [], [], [], None
    while True:
        plan = settled(push_plan(now))
        pushed = push_down(now, plan)
        pushed = settled(pushed) if lineage else pushed
        new = settled(coarsen.coarsening_round(pushed, threshold, bound)[0])
        did = plan.filter("push > 0").select("tree_id").distinct().withColumn("pushed", F.lit(True))
        part = new.groupBy("tree_id").agg(F.sum("discarded").alias("discarded"), F.max("changed").alias("changed"))
        part = settled(part.join(did, "tree_id", "left").withColumn("pushed", F.col("pushed").isNotNull()))
        lost.append(part.select("tree_id", "discarded"))
        going, untouched = part.agg(F.count_if("changed"), F.count_if(F.expr("not changed and not pushed"))).first()
        kept = now.join(part.filter("not changed and pushed").select("tree_id"), "tree_id", "left_semi")
        ended = [kept.withColumn("was", F.col("path"))]
        if untouched:
            ended.append(normalized(now.join(part.filter("not changed and not pushed").select("tree_id"), "tree_id", "left_semi")))
        done += [x.select(*LEAF) for x in ended]
        lines += [_followed(line, x) for x in ended] if lineage else []
        if not going:
            total = reduce(DataFrame.unionByName, lost).groupBy("tree_id").agg(F.sum("discarded").alias("discarded"))
            return reduce(DataFrame.unionByName, done).join(total, "tree_id"), (reduce(DataFrame.unionByName, lines) if lineage else None)
        went = part.filter("changed").select("tree_id")
        tidy = normalized(new.join(went, "tree_id", "left_semi"))
        if lineage:
            before = pushed.join(went, "tree_id", "left_semi")
            merged = coarsen.lineage(before.select(*LEAF), threshold, bound)
            line = settled(_followed(_followed(_followed(line, before), merged, "path", "new_path"), tidy))
        now = settled(tidy.select(*LEAF))


def batched(leaves: DataFrame, threshold: float | Column = 0.0, bound: str = "flat", whole: int = WHOLE) -> DataFrame:
    """Leaves of the restructured trees: small trees many to a task, each by itself, in no rounds; trees of more than ``whole``
    leaves by ``downsplit``. Both give the same trees."""
    large = settled(leaves.groupBy("tree_id").agg(F.count("*").alias("n")).filter(F.col("n") > whole).select("tree_id"))
    small = leaves if large.isEmpty() else leaves.join(large, "tree_id", "left_anti")
    out = kernel.restructure(small, "batched", threshold, bound).select(*LEAF)
    return out if small is leaves else out.unionByName(downsplit(leaves.join(large, "tree_id", "left_semi"), threshold, bound)[0].select(*LEAF))
