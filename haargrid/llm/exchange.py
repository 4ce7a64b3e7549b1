"""Key exchange in packed arrays: who else has this key?

Operators that look for rows with a key in common have several keys for each row. Tasks send
them as packed arrays, one for each of many buckets; inside a batch, ids with the same key
are linked at once and only one of them is sent on, so a very common key costs an entry for
each batch. A receiving partition sorts its entries and links the ids of each key, to
the smallest one: as many links as ids, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haargrid.llm.components import local_forest
from haargrid.llm.rows import small_batches, tidy, written

MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits (the splitmix64 finaliser)."""
    x = x + MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def star(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the smallest id of each; and links of the other ids with it."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    least = ids[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(keys) else ids
    other = ids != least
    return keys[head], ids[head], least[other], ids[other]


#: Keys that a task holds before it sends them, links before it thins them out.
SENT, THINNED = 1 << 19, 1 << 18


def share_keys(rows: DataFrame, per_task: Callable, keep: str, n_buckets: int | None = None) -> DataFrame:
    """Links between ids that have a key in common, and the kept rows, in one shuffle.

    ``per_task()`` gives the function of a record batch, which gives (kept columns, keys, ids):
    arrays of the columns that the DDL list ``keep`` names, and uint64 keys and int64 ids. The
    result has the kept columns, and (a, b) in rows of their own. A receiver sorts one bucket at a time.
    Of a key its bucket and the lower 32 bits are sent: 42 bits at least, as links are only candidates.
    """
    n = n_buckets or max(1024, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = T._parse_datatype_string(keep).fields
    sent = T.StructType([*kept, *T._parse_datatype_string("bucket int, keys binary, ids binary").fields])
    got = T.StructType([*kept, *T._parse_datatype_string("a long, b long").fields])
    sent_arrow, got_arrow = to_arrow_schema(sent), to_arrow_schema(got)
    width = len(kept)

    def packed(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, ids, a, b = star(keys, ids)
        parts = [(-1, *(x.astype("<i8").tobytes() for x in local_forest(a, b)))] if len(a) else []
        bucket = ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)  # ascending, as the keys are
        at = np.searchsorted(bucket, np.arange(n + 1))
        raw, who = keys.astype("<u4").tobytes(), ids.astype("<i8").tobytes()  # the lower bits: the others tell the bucket
        parts += [(k, raw[4 * x : 4 * y], who[8 * x : 8 * y]) for k, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if y > x]
        for i in range(0, len(parts), 512):
            some = list(zip(*parts[i : i + 512], strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some[0]), f.type) for f in list(sent_arrow)[:width]), pa.array(some[0], pa.int32()), pa.array(some[1], pa.binary()), pa.array(some[2], pa.binary())], schema=sent_arrow)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, held, size, at = per_task(), [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, keys, ids = f(batch)
            m = len(columns[0])
            if m:
                spread = pa.array(-2 - (at + np.arange(m)) % n, pa.int32())  # kept rows are dealt out evenly
                at += m
                yield pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, sent_arrow, strict=False)), spread, pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], schema=sent_arrow)
            held.append((keys, ids))
            size += len(keys)
            if size >= SENT:
                yield from packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield from packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, n_links, held, last = [], 0, [], None

        def linked(thin: bool):
            """Links of the bucket that is held."""
            nonlocal n_links, held, links
            if held:
                keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                _, _, a, b = star(keys, ids)
                links.append((a, b))
                n_links += len(a)
                held = []
            if links and (thin or n_links > THINNED):
                a, b = local_forest(*(np.concatenate(x) for x in zip(*links, strict=True)))
                links, n_links = [], 0
                for i in range(0, len(a), 65536):
                    x, y = a[i : i + 65536], b[i : i + 65536]
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(x), f.type) for f in list(got_arrow)[:width]), pa.array(x, pa.int64()), pa.array(y, pa.int64())], schema=got_arrow)

        for batch in batches:
            own = batch.column(width + 1).is_null()
            plain = batch.filter(own)
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([*(plain.column(i) for i in range(width)), pa.nulls(plain.num_rows, pa.int64()), pa.nulls(plain.num_rows, pa.int64())], schema=got_arrow)
            some = batch.filter(pa.compute.invert(own))
            for bucket, k, i in zip(some.column(width).to_pylist(), some.column(width + 1), some.column(width + 2), strict=True):
                k, i = (np.frombuffer(x.as_buffer(), kind) for x, kind in ((k, "<i8" if bucket < 0 else "<u4"), (i, "<i8")))
                if bucket < 0:
                    links.append((k, i))
                    n_links += len(i)
                    continue
                if bucket != last:
                    yield from linked(False)
                    last = bucket
                held.append((k, i))
        yield from linked(True)

    small_batches(rows)
    return rows.mapInArrow(tidy(send), sent).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(receive), got)


#: Bits of a filter of keys, and those of one of its blocks, as bitmap_construct_agg makes them.
FILTER, BLOCK = 1 << 26, 1 << 15


def marked(rows: DataFrame, wanted: DataFrame, keys: list[str], name: str = "maybe") -> DataFrame:
    """``rows`` with ``name``: whether their ``keys`` (whole numbers) may be in ``wanted``, which is never wrong if it is false.

    A filter of hashed keys is broadcast in blocks, 8 MB at most however long ``wanted`` is; the more keys it holds, the more other
    rows are true. What a join would drop needn't be dealt out for it, and the join that follows decides.
    """
    bit = F.xxhash64(*[F.col(k).cast("long") for k in keys]).bitwiseAND(FILTER - 1)
    block, place = F.shiftright(bit, BLOCK.bit_length() - 1).cast("int"), bit.bitwiseAND(BLOCK - 1)
    blocks = wanted.select(block.alias("block_"), place.alias("place_")).repartition("block_").groupBy("block_").agg(F.bitmap_construct_agg("place_").alias("bits_"))
    byte = F.conv(F.hex(F.substr("bits_", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.call_function("shiftright", byte, place.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    return rows.withColumn("block_", block).join(F.broadcast(blocks), "block_", "left").select(*rows.columns, F.coalesce(there, F.lit(False)).alias(name))


def among(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that ``marked`` finds."""
    return marked(rows, wanted, keys, "maybe_").filter("maybe_").drop("maybe_")


def by_group(df: DataFrame, keys: list[str], f: Callable[[pa.Table, list[int]], Iterator[pa.RecordBatch]], schema: str, together: int = 1) -> DataFrame:
    """f over whole groups of rows, and where each of them starts: one group, or as many as reach ``together`` rows."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        starts: list[int] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = list(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True))
            done = 0
            for x, mark in enumerate(marks):
                if mark == last:
                    continue
                if rows + x - done >= together:
                    if x > done:
                        held.append(batch.slice(done, x - done))
                    yield from f(pa.Table.from_batches(held), starts)
                    held, starts, rows, done = [], [], 0, x
                starts.append(rows + x - done)
                last = mark
            held.append(batch.slice(done))
            rows += batch.num_rows - done
        if rows:
            yield from f(pa.Table.from_batches(held), starts)

    rest = [c for c in df.columns if c not in keys]
    return small_batches(df).select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)


def in_parts(members: DataFrame, sizes: DataFrame, group: str, member: str, pairs: bool, most: int, weight: int) -> DataFrame:
    """``members`` with (i, j, cut): the block of a member, and whether its group has more than one.

    ``sizes`` has (group, n_members, n_weight) of groups; one of over ``most`` members or ``weight`` is
    cut into parts by the members' hash. With ``pairs`` any two parts of a group are a block, so all its
    members meet; else each part is one.
    """
    share = 2 if pairs else 1
    large = sizes.filter((F.col("n_members") > most) | (F.col("n_weight") > weight)).select(
        group, F.greatest(F.ceil(F.col("n_members") * share / most), F.ceil(F.col("n_weight") * share / weight)).cast("int").alias("n_parts")
    )
    parts = F.coalesce("n_parts", F.lit(1))
    own = F.when(parts > 1, F.pmod(F.xxhash64(member), parts)).otherwise(0).cast("int")
    placed = members.join(large, group, "left").withColumn("own", own).withColumn("cut", parts > 1)
    if not pairs:
        return placed.withColumn("i", F.col("own")).withColumn("j", F.col("own")).drop("own", "n_parts")
    other = F.sequence(F.lit(0), parts - 1)
    return (
        placed.withColumn("other", F.explode(F.when(parts > 1, F.filter(other, lambda k: k != F.col("own"))).otherwise(other)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .drop("own", "other", "n_parts")
    )
