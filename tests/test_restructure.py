"""Restructuring over leaves against the plain kernel, and its lineage."""

import random

from pyspark.sql import functions as F

from haargrid.functions import paths
from haargrid.operators import coarsen, kernel, restructure
from tests.test_trees import BIN15, FULL112, GOLDEN, canonical, leaves_of, parse, random_full


def random_tree(rng, depth):
    """A tree of any refinements, leaves at any depth, values that often are equal."""
    if not depth or rng.random() < 0.25:
        return float(rng.choice([0, 0, 1, rng.gauss(0, 1)]))
    ref = rng.randint(1, 7)
    return ref, [random_tree(rng, depth - 1) for _ in range(1 << ref.bit_count())]


def forest(seed, n=40):
    rng = random.Random(seed)
    return [random_tree(rng, 4) for _ in range(n)] + [random_full(rng, [2, 2, 1]) for _ in range(6)] + [parse(d, v) for d, v, _ in GOLDEN.values()] + [parse(*BIN15), (7, [(4, [float(v) for v in FULL112[2 * s : 2 * s + 2]]) for s in range(8)])]


def rows(df):
    return sorted((r.tree_id, r.path, tuple(r.refs), round(r.value, 9)) for r in df.select("tree_id", "path", "refs", "value").collect())


def plain(trees):
    return sorted((i, p, tuple(r), round(v, 9)) for i, t in enumerate(trees) for p, r, v in kernel.rows_of(t))


def test_rounds_equal_kernel(spark):
    trees = forest(1)
    pushed = [kernel._push_all(t)[0] for t in trees]
    assert rows(restructure.push_down(leaves_of(spark, trees))) == plain(pushed)
    assert rows(restructure.normalized(leaves_of(spark, pushed))) == plain([kernel.normalize(t) for t in pushed])


def test_downsplit_equals_kernel(spark):
    threshold = 0.3
    trees = [canonical(t, threshold) for t in forest(3)]
    got, line = restructure.downsplit(leaves_of(spark, trees), threshold, lineage=True)
    expected = [kernel.downsplit(t, threshold) for t in trees]
    assert rows(got) == plain([t for t, _ in expected])
    lost = {r.tree_id: r.lost for r in got.groupBy("tree_id").agg(F.max("discarded").alias("lost")).collect()}
    assert all(abs(lost[i] - x) < 1e-9 for i, (_, x) in enumerate(expected))
    check_lineage(leaves_of(spark, trees), got, line)


def check_lineage(old, new, line):
    """Every leaf before has one leaf after, and the shares of both sides sum up to one; means agree."""
    vol = lambda df, n: df.select("tree_id", F.col("path").alias(n), paths.volume(F.col("refs")).alias(f"{n}_volume"), F.col("value").alias(f"{n}_value"))
    line = line.withColumnRenamed("path", "new")
    assert line.count() == old.count() == line.select("tree_id", "origin").distinct().count()
    both = line.join(vol(old, "origin"), ["tree_id", "origin"]).join(vol(new, "new"), ["tree_id", "new"])
    assert both.count() == line.count()
    shares = both.groupBy("tree_id", "new").agg(F.sum(F.col("origin_volume") / F.col("new_volume")).alias("share"), F.sum(F.col("origin_volume") / F.col("new_volume") * F.col("origin_value")).alias("mean"), F.first("new_value").alias("value")).collect()
    assert len(shares) == new.count()
    assert all(abs(r.share - 1) < 1e-12 and abs(r["mean"] - r.value) < 1e-9 for r in shares)


def test_thresholds_share_one_loop(spark):
    """A threshold for each tree gives what separate runs give."""
    trees, thresholds = forest(4, 12), [0.0, 0.5]
    leaves = leaves_of(spark, trees).withColumn("t", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("tree_id", F.struct("t", "tree_id"))
    can = coarsen.canonical(leaves, F.col("tree_id.t")).drop("discarded")
    got, _ = restructure.downsplit(can, F.col("tree_id.t"))
    for t in thresholds:
        one = got.filter(F.col("tree_id.t") == t).withColumn("tree_id", F.col("tree_id.tree_id"))
        assert rows(one) == plain([kernel.downsplit(canonical(x, t), t)[0] for x in trees])


def test_single_leaves_and_no_trees(spark):
    leaves = leaves_of(spark, [1.0, (1, [0.0, 1.0])])
    assert rows(restructure.downsplit(leaves)[0]) == rows(leaves)
    assert restructure.downsplit(leaves.limit(0))[0].count() == 0
