"""Topology files in chunks that meet: trees of any size, written and read by many tasks.

A file has ``dims`` bits a node in pre-order, zeros for a leaf. In pre-order every node takes the first open child slot, and an
inner one opens its own. A chunk of nodes can't know which slots are open at its start, but only how many of those it
takes, and which of its own nodes are open at its end: that is its summary. Summaries, a row for a chunk, are put
together tree by tree and give each chunk its open slots; then all chunks are parsed by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haargrid.functions.tables import settled
from haargrid.operators import order

#: Nodes of a chunk, a multiple of eight, so that chunks are whole bytes.
NODES = 1 << 16


def chunks(leaves: DataFrame, dims: int, nodes: int = NODES) -> DataFrame:
    """(tree_id, chunk, n_nodes, bits): the files of the trees, in chunks. The last one is padded to a whole byte."""
    inner = leaves.filter(F.size("refs") > 0).select("tree_id", F.posexplode("refs").alias("d", "ref"), "path").groupBy("tree_id", F.substr("path", F.lit(1), F.col("d")).alias("node")).agg(F.first("ref").alias("ref"))
    every = inner.unionByName(leaves.select("tree_id", F.col("path").alias("node"), F.lit(0).alias("ref")))
    text = F.concat(*[F.shiftright("ref", d).bitwiseAND(1).cast("string") for d in range(dims)])
    placed = order.numbered(every, "tree_id", [F.col("node")]).select("tree_id", F.floor(F.col("ordinal") / nodes).alias("chunk"), "ordinal", text.alias("b"))
    rows = placed.groupBy("tree_id", "chunk").agg(F.count("*").alias("n_nodes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "b"))), lambda x: x["b"]), "").alias("text"))
    padded = F.rpad("text", (F.ceil(F.length("text") / 8) * 8).cast("int"), F.lit("0"))
    hexed = F.array_join(F.transform(F.sequence(F.lit(0), (F.length("padded") / 4 - 1).cast("int")), lambda i: F.conv(F.substr("padded", i * 4 + 1, F.lit(4)), 2, 16)), "")
    return rows.withColumn("padded", padded).select("tree_id", "chunk", "n_nodes", F.unhex(hexed).alias("bits"))


def split(files: DataFrame, dims: int, nodes: int = NODES) -> DataFrame:
    """Whole files (tree_id, descriptor) as chunks (tree_id, chunk, bits)."""
    size = nodes * dims // 8
    n = F.ceil(F.octet_length("descriptor") / size).cast("long")
    each = files.select("tree_id", "descriptor", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    return each.select("tree_id", "chunk", F.substr("descriptor", (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("bits"))


def _refs(raw: bytes, dims: int) -> list[int]:
    """Refinements of a chunk's nodes; bits of padding may look like leaves."""
    text = "".join(f"{b:08b}" for b in raw)
    number = {f"{k:0{dims}b}": sum((k >> (dims - 1 - d) & 1) << d for d in range(dims)) for k in range(1 << dims)}
    return [number[text[i : i + dims]] for i in range(0, len(text) - dims + 1, dims)]


def _summary(refs: list[int]) -> tuple[int, list[int], list[int]]:
    """(slots taken of what was open before, refinements of the own nodes that are open in the end, their next slots), outer nodes first."""
    taken, ref, after = 0, [], []
    for r in refs:
        while ref and after[-1] == 1 << ref[-1].bit_count():
            ref.pop()
            after.pop()
        if ref:
            after[-1] += 1
        else:
            taken += 1
        if r:
            ref.append(r)
            after.append(0)
    return taken, ref, after


def read(parts: DataFrame, dims: int) -> DataFrame:
    """Leaves (tree_id, path, refs) of chunks (tree_id, chunk, bits).

    A tree's first chunk starts at the root and is parsed where it lies; only trees of several chunks are summed up and joined.
    """
    tree = T.StructField("tree_id", parts.schema["tree_id"].dataType)
    of = lambda ddl: T.StructType([tree, *T._parse_datatype_string(ddl).fields])
    parts = settled(parts.select("tree_id", "chunk", "bits"))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_summary(_refs(raw, dims)) for raw in b["bits"]]
            yield pd.DataFrame({"tree_id": b["tree_id"], "chunk": b["chunk"], "taken": [x[0] for x in found], "ref": [x[1] for x in found], "after": [x[2] for x in found]})

    def opened(rows: pd.DataFrame) -> pd.DataFrame:
        """The open slots at each chunk's start: nodes on the way down, each with its next slot; the tree itself is the slot of a node above."""
        stack, out = [("", [], 0, 1)], []
        for r in rows.sort_values("chunk").itertuples(index=False):
            out.append((r.tree_id, r.chunk, [s[0] for s in stack], [list(s[1]) for s in stack], [s[2] for s in stack]))
            taken, at = int(r.taken), None
            while taken and stack:
                path, refs, after, n = stack.pop()
                use = min(taken, n - after)
                taken -= use
                if use:
                    at = (path + str(after + use - 1) if refs else "", refs)
                if after + use < n:
                    stack.append((path, refs, after + use, n))
            if at is None and len(r.ref):
                break
            for ref, after in zip(r.ref, r.after, strict=True):
                path, refs = at
                refs = [*refs, int(ref)]
                n = 1 << int(ref).bit_count()
                if after < n:
                    stack.append((path, refs, int(after), n))
                at = (path + str(after - 1), refs)
        return pd.DataFrame(out, columns=["tree_id", "chunk", "paths", "above", "after"])

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                stack = [[p, tuple(map(int, a)), int(k), 1 << int(a[-1]).bit_count() if len(a) else 1] for p, a, k in zip(r.paths, r.above, r.after, strict=True)]
                out = []
                for ref in _refs(r.bits, dims):
                    while stack and stack[-1][2] == stack[-1][3]:
                        stack.pop()
                    if not stack:
                        break
                    path, refs, k, _ = stack[-1]
                    stack[-1][2] += 1
                    path = f"{path}{k}" if refs else path
                    if ref:
                        stack.append([path, (*refs, ref), 0, 1 << ref.bit_count()])
                    else:
                        out.append((r.tree_id, path, list(refs)))
                yield pd.DataFrame(out, columns=["tree_id", "path", "refs"])

    several = parts.join(parts.filter("chunk > 0").select("tree_id").distinct(), "tree_id", "left_semi").select("tree_id", "chunk", "bits")
    sums = several.mapInPandas(summed, of("chunk long, taken long, ref array<int>, after array<int>"))
    starts = sums.groupBy("tree_id").applyInPandas(opened, of("chunk long, paths array<string>, above array<array<int>>, after array<int>"))
    root = {"paths": "array('')", "above": "array(cast(array() as array<int>))", "after": "array(0)"}
    first = parts.filter("chunk = 0").select("tree_id", "chunk", "bits", *[F.expr(e).alias(c) for c, e in root.items()])
    later = parts.filter("chunk > 0").join(starts, ["tree_id", "chunk"]).select(*first.columns)
    return first.unionByName(later).mapInPandas(parsed, of("path string, refs array<int>"))
