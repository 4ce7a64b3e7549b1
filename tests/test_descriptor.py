"""Topology files in chunks against the trees that they describe."""

import random

import pytest
from pyspark.sql import functions as F

from haargrid.operators import descriptor, grid
from tests.test_restructure import random_tree
from tests.test_trees import leaves_of, random_full


@pytest.mark.parametrize("nodes", [8, 64])
def test_chunks_meet(spark, nodes):
    rng = random.Random(nodes)
    trees = [random_tree(rng, d) for d in (0, 1, 2, 3, 4, 5, 5)] + [random_full(rng, [2, 3, 2]), 1.0, (1, [0.0, (2, [0.0, (4, [0.0, (1, [0.0, 1.0])])])])]
    leaves = leaves_of(spark, trees)
    parts = descriptor.chunks(leaves, 3, nodes)
    shape = lambda df: sorted((r.tree_id, r.path, tuple(r.refs)) for r in df.collect())
    assert parts.groupBy("tree_id").count().agg(F.max("count")).first()[0] > 2
    assert shape(descriptor.read(parts.drop("n_nodes"), 3)) == shape(leaves)
    files = grid.descriptors(leaves, 3)
    joined = {r.tree_id: b"" for r in files.collect()}
    for r in parts.orderBy("tree_id", "chunk").collect():
        joined[r.tree_id] += bytes(r.bits)
    assert joined == {r.tree_id: bytes(r.descriptor) for r in files.collect()}
    assert shape(descriptor.read(descriptor.split(files, 3, nodes), 3)) == shape(leaves)


def test_first_chunks_are_parsed_where_they_lie(spark):
    one = [(0, "", [], 1.0), (1, "0", [1], 1.0), (1, "1", [1], 2.0)]
    many = [(2, f"{a}{b}{c}", [7, 7, 7], 1.0) for a in range(8) for b in range(8) for c in range(8)]
    leaves = spark.createDataFrame(one + many, "tree_id long, path string, refs array<int>, value double")
    found = descriptor.read(descriptor.chunks(leaves, 3, nodes=64), 3)
    assert sorted((r.tree_id, r.path, list(r.refs)) for r in found.collect()) == sorted((r[0], r[1], r[2]) for r in one + many)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()  # only trees of several chunks are summed up
