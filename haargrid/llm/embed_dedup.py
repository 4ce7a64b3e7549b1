"""Near-duplicate vectors by collision counting on many one-dimensional projections.

Vectors of a label are dealt to cells by the signs of random projections, in several tables. A
label of twice as many vectors has one sign more, so a cell's size stays the same and work
grows with the number of vectors and tables. In a cell, many projections are sorted; a query's window, centred on
it, collides with the vectors that can be near in that projection, and collisions are counted for
each pair. Pairs that collide often enough are verified by their cosine in double precision.
Window, count and number of tables follow from the wanted recall.
"""

from __future__ import annotations

import functools
from math import acos, ceil, comb, log, pi
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haargrid.llm.components import components, local_forest
from haargrid.llm.exchange import by_group
from haargrid.llm.rows import small_batches, tidy, written
from haargrid.llm.set_join import ranges

COSINE = 0.98
#: Sorted projections of a cell, half a window in deviations of a pair at the threshold, share of such pairs that a table's count lets pass.
PROJECTIONS, WIDTH, PASS = 24, 1.5, 0.9995
#: Vectors of a cell on average, and of a block at most; signs of a cell at most.
PER_CELL, ROWS, SIGNS = 256, 1024, 40
RECALL = 0.9995


@functools.cache
def calibrated(cosine: float = COSINE, projections: int = PROJECTIONS) -> tuple[float, int]:
    """Half a window's width and the collisions needed: of a pair at the threshold, a random
    projection differs by a normal number of the distance's size, and the count is the largest
    that such a pair reaches with probability PASS."""
    half = WIDTH * (2 - 2 * cosine) ** 0.5
    p = 2 * NormalDist().cdf(WIDTH) - 1
    tail, need = 0.0, projections + 1
    while need > 0 and tail < PASS:
        need -= 1
        tail += comb(projections, need) * p**need * (1 - p) ** (projections - need)
    return half, need


def plan(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(signs of a cell, tables) for a label of n vectors: a pair at the threshold is found with RECALL."""
    signs = min(SIGNS, max(0, ceil(log(max(n, 1) / PER_CELL, 2))))
    found = (1 - acos(cosine) / pi) ** signs * PASS
    return signs, ceil(log(1 - RECALL) / log(1 - found))


@functools.lru_cache(64)
def directions(size: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """A table's projections: those that are sorted, and those whose signs make cells."""
    rng = np.random.default_rng((11, size, table))
    return rng.normal(size=(size, PROJECTIONS)), rng.normal(size=(size, SIGNS))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells(u: np.ndarray, table: int, signs: int) -> np.ndarray:
    """Cells of unit vectors; those of other sizes have other cells."""
    bits = u @ directions(u.shape[1], table)[1][:, :signs] >= 0
    return bits @ (1 << np.arange(signs, dtype=np.int64)) + (u.shape[1] << SIGNS)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _place(batches):
    """A row for each vector and table."""
    for b in batches:
        if not b.num_rows:
            continue
        kind = np.stack([np.diff(b.column(2).offsets.to_numpy()), b.column(3).to_numpy()])
        for size, n in np.unique(kind, axis=1).T.tolist():
            part = b.filter(pa.array((kind[0] == size) & (kind[1] == n)))
            u = unit(_vectors(part.column(2)))
            signs, tables = plan(n)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(u), t, np.int32)), pa.array(cells(u, t, signs), pa.int64())], names=["vec", "label", "x", "n", "copies", "tbl", "cell"])


def collisions(u: np.ndarray, table: int) -> np.ndarray:
    """For each pair (a * len(u) + b, a before b) in how many sorted projections their windows hold each other."""
    half, m = calibrated()[0], len(u)
    projected = u @ directions(u.shape[1], table)[0]
    count = np.zeros(m * m, np.uint8)
    at = np.arange(m)
    for j in range(PROJECTIONS):
        order = np.argsort(projected[:, j], kind="stable")
        v = projected[order, j]
        # the upper half of each query's window: its lower half is the upper one of others
        stop = np.searchsorted(v, v + half, "right")
        a, b = order[np.repeat(at, stop - at - 1)], order[ranges(at + 1, stop)]
        count[np.minimum(a, b) * m + np.maximum(a, b)] += 1  # a pair once for each projection
    return count


def near_pairs(x: np.ndarray, side: np.ndarray, table: int, signs: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of a block (indexes) with at least COSINE that no earlier table has found, and how many were verified.

    With two sides in the block, only pairs across; pairs of a side are found in its own block.
    """
    half, need = calibrated()
    u = unit(x)
    a, b = np.divmod(np.flatnonzero(collisions(u, table) >= need), len(u))
    if side.any() and not side.all():
        across = side[a] != side[b]
        a, b = a[across], b[across]
    verified = len(a)
    near = (x[a] * x[b]).sum(1) / (np.sqrt((x[a] * x[a]).sum(1)) * np.sqrt((x[b] * x[b]).sum(1))) >= COSINE
    a, b = a[near], b[near]
    for t in range(table):
        c = cells(u, t, signs)
        again = np.flatnonzero(c[a] == c[b])
        p = np.sort(np.stack([u[a[again]] @ directions(u.shape[1], t)[0], u[b[again]] @ directions(u.shape[1], t)[0]]), 0)
        fresh = np.ones(len(a), bool)
        fresh[again] = (p[1] <= p[0] + half).sum(1) < need
        a, b = a[fresh], b[fresh]
    return a, b, verified


def _block_links(t: pa.Table, _):
    """Number of a block's pairs for each vector, and a forest of them, both weighed by copies."""
    x = _vectors(t.column("x").combine_chunks())
    table, i, j = t.column("tbl")[0].as_py(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
    side = t.column("own").to_numpy() == j if i != j else np.zeros(len(x), bool)
    a, b, _ = near_pairs(x, side, table, plan(t.column("n")[0].as_py())[0])
    ids, copies = t.column("vec").to_numpy(), t.column("copies").to_numpy()
    links = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
    u, v = local_forest(ids[a], ids[b]) if len(a) else (np.zeros(0, np.int64),) * 2
    some = links > 0
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([ids[some], u]), pa.int64()), pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(u), np.int64)])), pa.array([None] * int(some.sum()) + v.tolist(), pa.int64())],
        names=["vec", "links", "other"],
    )


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Vectors of the same label, not null, link at a cosine of 0.98 or more. A vector that is
    null, empty, zero or has a null or non-finite component links with nothing, nor does one of another
    size. Equal vectors of a label are compared once; each counts as a link of the others.
    A row without an id has no link and no component. Ids are distinct long numbers; rows that
    repeat an id with the same vector are one vector.
    """
    v = F.col("x")
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"  # these are sent as they are
    kind = "float" if single else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("x"))
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    usable = rows.filter(F.col("vec").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("x", F.transform(v, lambda c: c + F.lit(0).cast(kind)))
    distinct = written(usable.groupBy("label", "x").agg(F.min("vec").alias("vec"), F.countDistinct("vec").alias("copies")))
    of_label = distinct.groupBy("label").agg(F.count("*").alias("n"))
    placed = small_batches(distinct).join(of_label, "label").select("vec", "label", "x", "n", "copies").mapInArrow(tidy(_place), f"vec long, label string, x array<{kind}>, n long, copies long, tbl int, cell long")
    sizes = written(placed.groupBy("label", "tbl", "cell").agg(F.count("*").alias("n_cell")).filter(F.col("n_cell") > ROWS))
    # a block of up to ROWS vectors; a larger cell's parts meet in pairs, and each part by itself
    parts = F.coalesce(F.ceil(F.col("n_cell") / (ROWS // 2)), F.lit(1)).cast("int")
    blocks = (
        placed.join(sizes, ["label", "tbl", "cell"], "left")
        .withColumn("parts", parts)
        .withColumn("own", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("label", "tbl", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vec", "x", "n", "copies")
    )
    found = written(by_group(blocks, ["label", "tbl", "cell", "i", "j"], _block_links, "vec long, links long, other long"))
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    groups = components(found.filter(F.col("other").isNotNull()).select(F.col("vec").alias("a"), F.col("other").alias("b")))
    named = written(
        distinct.join(links, "vec", "left").join(groups.withColumnRenamed("node", "vec"), "vec", "left")
        .select("label", "x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec").alias("component_id"))
    )
    answer = usable.join(named, ["label", "x"]).select("vec", "n_links", "component_id").dropDuplicates(["vec"])
    return rows.select("vec").join(answer, "vec", "left").select(
        F.col("vec").alias(id_col),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec").alias("component_id"),
        (F.col("vec") == F.coalesce("component_id", "vec")).alias("kept"),
    )
