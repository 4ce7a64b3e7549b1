"""Golden structures, properties and round trips of trees."""

import random

import pytest
from pyspark.sql import functions as F

from haargrid.functions import paths
from haargrid.jobs import queries
from haargrid.operators import coarsen, grid, haar, kernel, sparse
from haargrid.sources import grids

#: descriptor (dimension 0 leftmost), leaf values, boxes at first, after canonical coarsening, after restructuring
GOLDEN = {
    "merge_right": ("11 10 00 00 00 00 00", [0, 1, 1, 0, 1], (5, 5, 4)),
    "A": ("10 01 00 00 01 00 00", [0, 1, 0, 1], (4, 4, 4)),
    "Q": ("11" + " 10 01 00 00 01 00 00" * 4, [0, 1] * 8, (16, 16, 16)),
    "R": ("11 11 00 00 00 00 00 00 00", [0, 1, 1, 0, 0, 0, 0], (7, 7, 6)),
    "S": ("11 11 00 00 00 00 01 00 00 00 00", [0, 1, 1, 0, 1, 0, 0, 0], (8, 8, 7)),
    "M": ("11 00 10 10 00 00 00 00 10 00 00", [0, 0, 1, 1, 1, 0, 1], (7, 7, 7)),
}
BIN15 = ("111" + " 000" * 7 + " 111" + " 000" * 8, [1, 0, 0, 1, 1, 1, 0] + [1] * 8)
FULL112 = [0, 1, 1, 0, 0, 1, 1, 0, 0, 0, 0, 1, 1, 1, 1, 1]


def parse(descriptor, values):
    tokens, values = iter(descriptor.split()), iter(values)

    def node():
        ref = sum(int(c) << d for d, c in enumerate(next(tokens)))
        return (ref, [node() for _ in range(1 << ref.bit_count())]) if ref else float(next(values))

    return node()


def boxes(t):
    return 1 if isinstance(t, float) else sum(map(boxes, t[1]))


def canonical(t, threshold=0.0):
    while True:
        t, changed, _ = kernel.coarsen(t, threshold)
        if not changed:
            return t


def cells(t, levels, low=(0, 0, 0), size=None):
    """Cell to value."""
    size = size or [1 << n for n in levels]
    if isinstance(t, float):
        return {(low[0] + x, low[1] + y, low[2] + z): t for x in range(size[0]) for y in range(size[1]) for z in range(size[2])}
    out = {}
    for s, c in enumerate(t[1]):
        at, part = list(low), list(size)
        for k, d in enumerate(kernel.dims(t[0])):
            part[d] //= 2
            at[d] += (s >> k & 1) * part[d]
        out |= cells(c, levels, tuple(at), part)
    return out


def random_full(rng, levels):
    ref = sum(1 << d for d, n in enumerate(levels) if n)
    if not ref:
        return rng.gauss(0, 1)
    return ref, [random_full(rng, [max(0, n - 1) for n in levels]) for _ in range(1 << ref.bit_count())]


def leaves_of(spark, trees):
    rows = [(i, p, r, v) for i, t in enumerate(trees) for p, r, v in kernel.rows_of(t)]
    return spark.createDataFrame(rows, "tree_id long, path string, refs array<int>, value double")


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_kernel(name):
    d, v, expected = GOLDEN[name]
    t = parse(d, v)
    c = canonical(t)
    assert (boxes(t), boxes(c), boxes(kernel.downsplit(c, 0.0)[0])) == expected


def test_golden_schedulers_differ():
    t = parse(*BIN15)
    assert boxes(kernel.downsplit(t, 0.0)[0]) == 6
    assert boxes(kernel.decomposed(t, 0.0)[0]) == 5


def test_golden_on_spark(spark):
    trees = [parse(d, v) for d, v, _ in GOLDEN.values()]
    leaves = leaves_of(spark, trees)
    count = lambda df: [r["n"] for r in df.groupBy("tree_id").agg(F.count("*").alias("n")).orderBy("tree_id").collect()]
    can = coarsen.canonical(leaves).drop("discarded")
    assert count(can) == [e[1] for _, _, e in GOLDEN.values()]
    assert count(kernel.restructure(can)) == [e[2] for _, _, e in GOLDEN.values()]


def test_full_112():
    """The last dimension is halved twice; values in the order of leaves."""
    t = (7, [(4, [float(v) for v in FULL112[2 * s : 2 * s + 2]]) for s in range(8)])
    c = canonical(t)
    assert cells(c, (1, 1, 2)) == cells(t, (1, 1, 2))
    assert (boxes(t), boxes(c), boxes(kernel.downsplit(c, 0.0)[0])) == (16, 13, 13)


@pytest.mark.parametrize("seed", range(12))
def test_properties(seed):
    rng = random.Random(seed)
    levels = (2, 3, 3)
    t = random_full(rng, list(levels))
    before = cells(t, levels)
    for scheduler in (kernel.downsplit, kernel.decomposed):
        last = None
        for threshold in (0.0, 0.1, 0.4, 0.6):
            new, lost = scheduler(t, threshold)
            after = cells(new, levels)
            assert abs(kernel.mean(t) - sum(after.values()) / len(after)) < 1e-12
            error = sum(abs(after[k] - before[k]) for k in before) / len(before)
            assert error <= lost + 1e-12
            if not threshold:
                assert error < 1e-12
            last = new
        assert boxes(last) <= boxes(t)


@pytest.mark.parametrize("dim", [0, 1, 2])
def test_push_then_normalize_is_identity(dim):
    t = random_full(random.Random(5), [2, 2, 2])
    assert kernel.normalize(kernel.push(t, dim)) == t


def test_round_matches_kernel(spark):
    trees = [random_full(random.Random(s), [2, 2, 1]) for s in range(6)]
    leaves = leaves_of(spark, trees)
    new = coarsen.coarsening_round(leaves, 0.5)[0]
    got = {}
    for r in new.collect():
        got.setdefault(r.tree_id, {})[r.path] = (list(r.refs), round(r.value, 9))
    for i, t in enumerate(trees):
        expected = {p: (r, round(v, 9)) for p, r, v in kernel.rows_of(kernel.coarsen(t, 0.5)[0])}
        assert got[i] == expected
    lost = {r.tree_id: r.d for r in new.groupBy("tree_id").agg(F.sum("discarded").alias("d")).collect()}
    assert all(abs(lost[i] - kernel.coarsen(t, 0.5)[2]) < 1e-12 for i, t in enumerate(trees))


def test_inverse_of_uneven_trees(spark):
    trees = [parse(d, v) for d, v, _ in GOLDEN.values()]
    leaves = leaves_of(spark, trees)
    back = {(r.tree_id, r.path): r.value for r in haar.inverse(leaves, haar.forward(leaves)).collect()}
    assert all(abs(back[i, p] - v) < 1e-12 for i, t in enumerate(trees) for p, _, v in kernel.rows_of(t))


def test_rasterise_and_descriptor_round_trip(spark):
    trees = [parse(d, v) for d, v, _ in GOLDEN.values()]
    leaves = leaves_of(spark, trees)
    got = {(r.tree_id, r.x, r.y): r.value for r in grid.rasterise(leaves, 2, 3).collect()}
    for i, t in enumerate(trees):
        assert all(got[i, x, y] == v for (x, y, _), v in cells(t, (3, 3, 0)).items())
    files = grid.descriptors(leaves, 2)
    bits = {r.tree_id: "".join(f"{b:08b}" for b in r.descriptor)[: r.n_bits] for r in files.collect()}
    assert [bits[i] for i in range(len(trees))] == [d.replace(" ", "") for d, _, _ in GOLDEN.values()]
    shape = {(r.tree_id, r.path) for r in grid.read_descriptors(files, 2).collect()}
    assert shape == {(i, p) for i, t in enumerate(trees) for p, _, _ in kernel.rows_of(t)}


def test_bounds_on_smooth_functions(spark):
    """At a threshold of 1e-2 two boxes are left of smooth functions if the bound follows the volume."""
    cells3 = grids.sampled(spark, lambda x, y, z: F.lit(0.05) + 0.05 * x, 3).withColumn("tree_id", F.lit(1))
    leaves = grids.full_tree(cells3, list("xyz"), 3)
    assert coarsen.canonical(leaves, 1e-2, "per_volume").count() <= 2
    constant = leaves.withColumn("value", F.lit(0.05))
    assert coarsen.canonical(constant).count() == 1


def test_shapes_build_and_coarsen(spark):
    """Full, canonical and restructured boxes of the sphere at level 2."""
    leaves = grids.full_tree(grids.sampled(spark, grids.sphere, 2).withColumn("tree_id", F.lit(1)), list("xyz"), 2)
    can = coarsen.canonical(leaves).drop("discarded")
    assert (leaves.count(), can.count(), kernel.restructure(can).count()) == (64, 64, 32)


def test_named_grid(spark):
    v = spark.createDataFrame([("a", 0, 0, 0, 1.0)], "grid string, x long, y long, z long, value double")
    assert grids.named_grid(v, "a").count() == 1
    with pytest.raises(ValueError, match="'a'"):
        grids.named_grid(v, "b")


def test_morton_inverse(spark):
    m = spark.range(512)
    code = paths.morton([paths.unmorton(F.col("id"), 3, 3, d) for d in range(3)], 3)
    assert m.filter(code != F.col("id")).count() == 0


def test_sparse_voxels_give_the_trees_of_the_filled_grids_and_move_once(spark):
    r = random.Random(7)
    rows = [(g, x, y, z, float(r.randint(0, 2))) for g in range(6) for x in range(4) for y in range(4) for z in range(4) if g == 5 or r.random() < g / 5]
    voxels = spark.createDataFrame(rows, "grid long, x long, y long, z long, value double")
    key = lambda t: sorted((r.tree_id, r.path, list(r.refs), r.value) for r in t.collect())
    filled = grids.padded(voxels, 4).withColumnRenamed("grid", "tree_id")
    tree = coarsen.adaptive_sparse(voxels, list("xyz"), 2)
    assert key(tree) == key(coarsen.adaptive(filled, list("xyz"), 2))
    nodes = tree.groupBy("tree_id", "path").count()
    assert nodes._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_event_trees_take_as_many_tasks_as_events_need_whatever_their_bytes(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries, "EVENTS", 100)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    tree = queries.event_tree(spark, sf_dir)
    assert tree.rdd.getNumPartitions() == events // 100 + 1 > 4
    assert tree.groupBy("tree_id", "path").count()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_trees_of_scattered_voxels_move_voxels_and_heads_only(spark, sf_dir, monkeypatch):
    from haargrid.jobs import studies

    v = studies.user_grid(spark, sf_dir)
    box = sparse.extent(v)
    shape = lambda t: sorted((r.tree_id, r.path, list(r.refs), r.value) for r in t.collect())
    found = {}
    for bits in (4, 9, 15, 40):  # 40: no box has so many halvings, so all nodes take the way of the upper ones
        monkeypatch.setattr(sparse, "HEAD_BITS", bits)
        found[bits] = shape(sparse.adaptive(v, box, partitions=5))
    assert found[4] == found[9] == found[15] == found[40]
    monkeypatch.setattr(sparse, "HEAD_BITS", 9)
    plan = sparse.adaptive(v, box, partitions=5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and all("Broadcast" in line for line in plan.splitlines() if "Join" in line)  # only boxes are joined


def test_families_of_scattered_voxels_are_put_together_without_rows_for_background(spark, sf_dir):
    from haargrid.jobs import studies

    events = studies.user_grid(spark, sf_dir)
    # a family's background children come from one mask: no row for each of them is grouped
    plan = sparse.adaptive(events, sparse.extent(events), partitions=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan and "bit_or" in plan

    rng = random.Random(11)
    size, value = (5, 3, 1), lambda: rng.choice([0.0, 1.0, 1.0, 1.0, 2.0, float("nan")])
    grids_of = {g: {(x, y, z): value() for x in range(size[0]) for y in range(size[1]) for z in range(size[2]) if rng.random() < g / 4 or x == y == 0 or x == 4} for g in range(5)}
    grids_of[5] = {(x, y, z): 1.0 for x in range(4) for y in range(4) for z in range(2)}
    grids_of[6] = {(x, 0, 0): 0.0 for x in range(3)}
    v = spark.createDataFrame([(g, *at, c) for g, cells in grids_of.items() for at, c in cells.items()], "grid long, x long, y long, z long, value double")
    expected = []

    def visit(g, levels, low, path, refs):
        inside = [grids_of[g].get((x, y, z), 0.0) for x in range(low[0], low[0] + (1 << levels[0])) for y in range(low[1], low[1] + (1 << levels[1])) for z in range(low[2], low[2] + (1 << levels[2]))]
        if len({str(c) for c in inside}) == 1:
            expected.append((g, path, refs, str(inside[0])))
            return
        halved = [d for d in range(3) if levels[d]]
        finer = [max(x - 1, 0) for x in levels]
        for s in range(1 << len(halved)):
            at = [low[d] + ((s >> halved.index(d) & 1) << finer[d] if d in halved else 0) for d in range(3)]
            visit(g, finer, at, path + str(s), [*refs, sum(1 << d for d in halved)])

    for g, cells in grids_of.items():
        low = [min(c[d] for c in cells) for d in range(3)]
        visit(g, [(max(c[d] for c in cells) - low[d]).bit_length() for d in range(3)], low, "", [])
    found = sparse.adaptive(v, sparse.extent(v)).collect()
    assert sorted((r.tree_id, r.path, list(r.refs), str(r.value)) for r in found) == sorted(expected)


def test_places_of_leaves_with_unequal_levels(spark, sf_dir):
    from haargrid.jobs import studies

    v = studies.user_grid(spark, sf_dir)
    box = sparse.extent(v)
    b = sparse.placed_boxes(sparse.adaptive(v, box), box).join(box.withColumnRenamed("grid", "tree_id"), "tree_id")
    wrong = F.lit(False)
    for d, c in enumerate("xyz"):
        size = F.pow(F.lit(2.0), F.col(f"level_{c}") - paths.level(F.col("refs"), d))
        wrong = wrong | (F.col(f"size_{c}") != size) | (F.col(c) != F.col(f"low_{c}") + paths.index(F.col("path"), F.col("refs"), d) * size)
    assert b.filter(wrong).count() == 0 < b.count()


def test_refinements_are_counted_at_first_leaves(spark):
    rng = random.Random(5)
    leaves = leaves_of(spark, [random_full(rng, [2, 3, 2]), 1.0, (1, [0.0, (2, [0.0, (4, [0.0, (1, [0.0, 1.0])])])])])
    nodes = {(r.tree_id, r.path[:d], r.refs[d]) for r in leaves.collect() for d in range(len(r.refs))}
    found = grid.ref_histogram(leaves)
    assert {r.ref: r.n for r in found.collect()} == {k: sum(n[2] == k for n in nodes) for k in {n[2] for n in nodes}}
    assert "hashpartitioning(tree_id" not in found._jdf.queryExecution().executedPlan().toString()


def _some_trees(spark):
    rng = random.Random(7)
    return leaves_of(spark, [random_full(rng, [2, 3, 2]), 1.0, (1, [0.0, (2, [0.0, (4, [0.0, (1, [0.0, 1.0])])])]), (7, [0.0] * 7 + [random_full(rng, [1, 1, 1])]), (2, [(5, [(7, [1.0] * 8), 0.0, 1.0, 0.0]), 0.0])])


def test_nodes_come_with_their_first_leaves(spark, monkeypatch):
    leaves = _some_trees(spark)
    rows = leaves.collect()
    nodes = {(r.tree_id, r.path[:k], k == len(r.path)) for r in rows for k in range(len(r.path) + 1)}
    found = queries._all_nodes(leaves)
    assert sorted(map(tuple, found.collect())) == sorted(nodes)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()  # no node is made twice

    monkeypatch.setattr(queries, "event_tree", lambda *_: leaves)
    below = queries.subtree_ranges(spark, "")
    assert sorted(map(tuple, below.collect())) == sorted((t, p, sum(u == t and q.startswith(p) for u, q, _ in nodes)) for t, p, _ in nodes)
    assert below._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # leaves are summed up at once
    order = {t: sorted((p, leaf) for u, p, leaf in nodes if u == t) for t in {r.tree_id for r in rows}}
    expected = [(t, p, k, sum(x[1] for x in at[: k + 1]) - 1 if leaf else None) for t, at in order.items() for k, (p, leaf) in enumerate(at)]
    assert sorted(map(tuple, queries.preorder_ordinals(spark, "").collect()), key=repr) == sorted(expected, key=repr)


def test_places_of_leaves_come_from_one_pass_over_their_steps(spark, monkeypatch):
    leaves = _some_trees(spark)
    monkeypatch.setattr(queries, "event_tree", lambda *_: leaves)
    wanted = leaves.select("tree_id", "path", *[paths.level(F.col("refs"), d) for d in range(3)], *[paths.index(F.col("path"), F.col("refs"), d) for d in range(3)]).collect()
    found = queries.tree_levels(spark, "")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted))
    for df in (found, grid.filled(leaves, 3, 3), grids.at_corners(leaves, leaves.select(F.col("tree_id").alias("grid"), *[F.lit(0).cast("long").alias(c) for c in "xyz"], "value"), 3)):
        assert "arrays_zip" not in df._jdf.queryExecution().optimizedPlan().toString()  # steps aren't zipped again for each dimension
    # each cell once, with the value of the leaf whose box it is in
    boxes = {(r[0], r[1]): [((r[5 + d] << 3 - r[2 + d]), 1 << 3 - r[2 + d]) for d in range(3)] for r in wanted}
    value = {(r.tree_id, r.path): r.value for r in leaves.collect()}
    cells_of = sorted((t, *(lo + k for (lo, _), k in zip(b, at, strict=True)), value[t, p]) for (t, p), b in boxes.items() for at in [(x, y, z) for x in range(b[0][1]) for y in range(b[1][1]) for z in range(b[2][1])])
    assert sorted(map(tuple, grid.rasterise(leaves, 3, 3).collect())) == cells_of
    assert len({c[:4] for c in cells_of}) == len(cells_of) == 5 * 512


def test_outermost_nodes_are_told_in_preorder_without_joins(spark, monkeypatch):
    leaves = _some_trees(spark).unionByName(_some_trees(spark).filter("tree_id = 3").withColumn("tree_id", F.lit(9).cast("long")).withColumn("path", F.concat(F.lit("1"), "path")).withColumn("refs", F.concat(F.array(F.lit(1)), "refs")))
    monkeypatch.setattr(queries, "event_tree", lambda *_: leaves)
    families = {}
    for r in leaves.filter("path != ''").collect():
        families[r.tree_id, r.path[:-1]] = families.get((r.tree_id, r.path[:-1]), 0) + 1
    c = {k: n for k, n in families.items() if n >= 2}
    found = queries.outermost_prefixes(spark, "")
    assert sorted(map(tuple, found.collect())) == sorted((t, p, n) for (t, p), n in c.items() if not any((t, p[:k]) in c for k in range(len(p))))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
