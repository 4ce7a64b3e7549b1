"""Manifest of a dataset: a Merkle tree of its documents by source, with a proof for each document.

Documents are ranked by source without gathering one: a range exchange sorts them, and the counts of each
partition's runs give what comes before. The ranks' digits (to the base of the tree's width) then group
nodes away, the lowest first, inside blocks of a bounded number of leaves: each group becomes one struct
with its children nested in it. One exchange brings a block together and all its levels follow from it.
Blocks are the leaves of the next layer, until a source is one block; sources are the leaves of a last tree.
Proofs come back down: a block takes the path above it, and transforms and explodes hand it to its leaves
with the siblings of each level, so no join is made inside a block; a layer costs one join of a row a block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haargrid.llm.rows import written

#: Bits of a digit (16 children a node) and digits that a block nests: 4,096 leaves of about 130 bytes.
BITS, DIGITS = 4, 3
#: The fields that a leaf's digest covers, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Column) -> Column:
    return F.sha2(parts, 256)


def framed(c: Column) -> Column:
    """A value after its length in bytes; - for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return digest(F.concat(*map(framed, fields)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (key, ...) with ``rank`` within their key by ``order``, from 0, and ``n``, the key's number of rows.

    A key may hold any share of the rows: they stay dealt out by range. ``order`` should tell all rows apart.
    """
    by = [F.col("key"), *order]
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("run", F.shiftright(at, 33)).withColumn("place", at.bitwiseAND((1 << 33) - 1)))
    runs = placed.groupBy("key", "run").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    of_key = Window.partitionBy("key").orderBy("run")
    before = F.coalesce(F.sum("rows").over(of_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("key", "run", (before - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("key")).alias("n"))
    return placed.join(runs, ["key", "run"]).withColumn("rank", F.col("place") + F.col("shift")).drop("run", "place", "shift")


def _grouped(step: int) -> Column:
    """Whether the nodes that digit ``step`` groups are several, so that their runs become digests."""
    return F.col("n") > 1 << BITS * step


def blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(key, n, block, h, kids): blocks of nodes (key, rank, n, h and the payload), a struct nested for each digit."""
    digit = lambda s: F.shiftright("rank", BITS * s).bitwiseAND((1 << BITS) - 1).cast("int")
    upper = [f"d{s}" for s in range(1, DIGITS)]
    t = nodes.select("key", "n", F.shiftright("rank", BITS * DIGITS).alias("block"), *[digit(s).alias(f"d{s}") for s in range(1, DIGITS)], F.struct(digit(0).alias("d"), "h", *payload).alias("kid")).repartition("key", "block")
    for s in range(DIGITS):
        t = t.groupBy("key", "n", "block", *upper[s:]).agg(F.array_sort(F.collect_list("kid")).alias("kids"))
        h = F.when(_grouped(s), digest(F.array_join(F.transform("kids", lambda k: k["h"]), ""))).otherwise(F.element_at("kids", 1)["h"])
        rest = upper[s + 1 :]
        t = t.select("key", "n", "block", *rest, F.struct(F.col(upper[s]).alias("d"), h.alias("h"), "kids").alias("kid")) if s + 1 < DIGITS else t.select("key", "n", "block", h.alias("h"), "kids")
    return t


def layers(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """Blocks of the nodes, blocks of those blocks, and so on until each key is one block."""
    width, out = 1 << BITS * DIGITS, [written(blocks(nodes, payload))]
    while not (more := out[-1].filter(F.col("n") > width)).isEmpty():
        out.append(written(blocks(more.select("key", F.col("block").alias("rank"), F.ceil(F.col("n") / width).alias("n"), "h"), [])))
    return out


def tops(found: list[DataFrame]) -> DataFrame:
    """(key, h): the node that is left of each key."""
    return reduce(DataFrame.unionByName, [t.filter(F.col("n") <= 1 << BITS * DIGITS).select("key", "h") for t in found])


def handed_down(found: list[DataFrame], top: DataFrame, payload: list[str], carried: list[str]) -> DataFrame:
    """(key, h, the payload, ``carried``, path) of the lowest nodes; ``top`` has (key, carried, path) of each key.

    ``path`` lists, level by level from the node up, the siblings' digests left and right of it.
    """
    nothing = F.array().cast("array<struct<left:string,right:string>>")

    def with_step(s: int):
        def of(k: Column) -> Column:
            side = lambda test: F.array_join(F.transform(F.filter("kids", test), lambda x: x["h"]), "")
            step = F.array(F.struct(side(lambda x: x["d"] < k["d"]).alias("left"), side(lambda x: x["d"] > k["d"]).alias("right")))
            return F.struct(k.alias("k"), F.when(_grouped(s), step).otherwise(nothing).alias("step"))

        return of

    below = None
    for t in reversed(found):
        whole = F.col("n") <= 1 << BITS * DIGITS
        rows = t.filter(whole).join(top, "key")
        if below is not None:
            rows = rows.unionByName(t.filter(~whole).join(below.select("key", F.col("rank").alias("block"), *carried, "path"), ["key", "block"]))
        rows = rows.select("key", "n", F.col("block").alias("rank"), "kids", *carried, "path")
        for s in reversed(range(DIGITS)):
            # a child, its rank, and its own step put before the path that it takes over
            rows = rows.select("key", "n", "rank", *carried, "path", F.explode(F.transform("kids", with_step(s))).alias("kid"))
            inner = [F.col("kid.k.kids").alias("kids")] if s else [F.col("kid.k.h").alias("h"), *([F.col(f"kid.k.{c}").alias(c) for c in payload] if t is found[0] else [])]
            rows = rows.select("key", "n", (F.shiftleft("rank", BITS) + F.col("kid.k.d")).alias("rank"), *carried, F.concat("kid.step", "path").alias("path"), *inner)
        below = rows
    return below


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A document whose id's crc32 five divides is tampered with (A-Z of its text lower-cased) before its root is folded
    from its leaf and the siblings; ``verified`` tells whether the root comes out. Rows of one source and id go by
    their leaves' digests; equal rows have equal ones and each has its own proof. A null id comes first in its
    source and isn't tampered with; nulls of other fields are part of the leaf, a null text stays null. Only the five
    fields are read, whatever other columns there are. An empty table gives no rows.
    """
    other = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_digest(other))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    leaves = written(docs.select("doc_id", key.alias("key"), leaf_digest([F.col(c) for c in FIELDS]).alias("h"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("at")))
    own = layers(ranked(leaves, [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("at")]).drop("at"), ["doc_id", "tampered"])
    sources = tops(own).select(F.lit("").alias("key"), F.col("key").alias("source_key"), "h")
    above = layers(ranked(sources, [F.col("source_key")]), ["source_key"])
    root = tops(above).select("key", F.col("h").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    by_source = handed_down(above, root, ["source_key"], ["root"]).select(F.col("source_key").alias("key"), "root", F.col("h").alias("subroot"), "path")
    rows = handed_down(own, written(by_source), ["doc_id", "tampered"], ["root", "subroot"])
    folded = F.aggregate("path", F.coalesce("tampered", "h"), lambda a, s: digest(F.concat(s["left"], a, s["right"])))
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    rows = rows.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
