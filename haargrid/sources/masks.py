"""Which leaves have a stored value, as one bit a leaf in the order of leaves, with rank and select.

Bits stand in words of 64 and blocks of WORDS words; a block also has how many bits are set before it. A leaf's
value is the one whose number is the rank of the leaf's bit: values are found by number, not by paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of 64 bits that a block holds: 4,096 leaves in 512 bytes.
WORDS = 64


def pack(marked: DataFrame) -> DataFrame:
    """(tree_id, block, before, words) of rows (tree_id, ordinal, stored): all ordinals of a tree, from 0."""
    bit = F.when(F.col("stored"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("ordinal").bitwiseAND(63).cast("int"))).otherwise(0)
    words = marked.groupBy("tree_id", F.shiftright("ordinal", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    blocks = words.groupBy("tree_id", F.floor(F.col("word") / WORDS).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words"))
    own = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w))
    # one row for 4,096 leaves meets here
    earlier = Window.partitionBy("tree_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("own", own).withColumn("before", F.coalesce(F.sum("own").over(earlier), F.lit(0))).select("tree_id", "block", "before", "words")


def words(blocks: DataFrame) -> DataFrame:
    """(tree_id, word, bits, before) of the blocks: each word, and how many bits are set before it."""
    each = blocks.select("tree_id", "block", "before", "words", F.posexplode("words").alias("k", "bits"))
    inside = F.aggregate(F.slice("words", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w))
    return each.select("tree_id", (F.col("block") * WORDS + F.col("k")).alias("word"), "bits", (F.col("before") + inside).alias("before"))


def ranked(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (tree_id, ordinal, ...) with ``stored``, their bit, and ``rank``, the number of set bits before it."""
    at = F.col("ordinal").bitwiseAND(63).cast("int")
    met = rows.withColumn("word", F.shiftright("ordinal", 6)).join(words(blocks), ["tree_id", "word"])
    below = F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), at)))
    stored = F.call_function("shiftrightunsigned", F.col("bits"), at).bitwiseAND(1) == 1
    return met.withColumn("stored", stored).withColumn("rank", F.col("before") + F.bit_count(below)).drop("word", "bits", "before")


def selected(blocks: DataFrame) -> DataFrame:
    """(tree_id, rank, ordinal) of all set bits: the ordinal of the bit with so many before it."""
    each = words(blocks).select("tree_id", "word", "before", F.posexplode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.call_function("shiftrightunsigned", F.col("bits"), i).bitwiseAND(1) == 1, i)), lambda i: i.isNotNull())).alias("k", "i"))
    return each.select("tree_id", (F.col("before") + F.col("k")).alias("rank"), (F.col("word") * 64 + F.col("i")).alias("ordinal"))
