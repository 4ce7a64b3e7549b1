"""Connected components of a graph that is too large for one machine: distributed union-find.

Each round hooks every node to the neighbour (or itself) of the least priority (its number in
the first rounds, then a hash of it that changes with the round), and replaces the nodes of all links by what they hook
to. Links inside a component vanish and the rest get fewer by a constant factor, whatever
the order of the numbers (a long chain too). Minima are aggregated before the shuffle, so a
node with very many links costs a row for each task; the joins that replace nodes have plain
shuffles on both sides, so adaptive execution splits such a node's links. Once so few links are left
that a task can hold them (LOCAL, by count), one task ends the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haargrid.llm.rows import tidy, written

#: Links, of 16 bytes, that one task may solve by itself.
LOCAL = 1 << 19


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link (long numbers); component is its smallest node.

    Repeated links, links in both directions and links of a node with itself are allowed;
    links with a null end are ignored.
    """
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter(F.col("a") != F.col("b"))
    edges = written(links.mapInArrow(tidy(_thinned), "a long, b long"))
    hooks: list[DataFrame] = []
    while edges.count() > LOCAL:
        # links often lead to smaller numbers already; what two rounds in their order leave is hooked at random
        random = lambda c, r=len(hooks): F.xxhash64(F.col(c), F.lit(r)) if r > 1 else F.col(c)
        priority = lambda c: F.struct(random(c).alias("p"), F.col(c).alias("n"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(priority("b")).alias("m"))
        hook = written(least.select(F.col("a").alias("node"), F.least("m", priority("a"))["n"].alias("to")))
        hooks.append(hook)
        for side in ("a", "b"):
            edges = edges.join(hook.withColumnRenamed("node", side), side).withColumn(side, F.col("to")).drop("to")
        edges = written(edges.select("a", "b").filter(F.col("a") != F.col("b")).mapInArrow(tidy(_thinned), "a long, b long"))
    rest = written(edges.coalesce(1).mapInArrow(tidy(_solved), "node long, component long"))
    if not hooks:
        return rest
    labels = hooks[0]
    for hook in [*hooks[1:], rest.toDF("node", "to")]:
        labels = labels.join(hook.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    labels = written(labels)
    smallest = written(labels.groupBy("to").agg(F.least(F.min("node"), F.col("to")).alias("component")))
    return labels.join(smallest, "to").select("node", "component")


def _solved(batches):
    """(node, its component's smallest node) of all links of the task."""
    parts = [tuple(b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)) for b in batches if b.num_rows]
    if parts:
        x, y = local_forest(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        root = np.unique(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, root]), pa.int64()), pa.array(np.concatenate([y, root]), pa.int64())], names=["node", "component"])


def _thinned(batches):
    """As many links of each batch as connect what it connects."""
    for batch in batches:
        if batch.num_rows:
            x, y = local_forest(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest node that it reaches, for those that differ: as many as are needed."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]
