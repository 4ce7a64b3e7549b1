"""Similar sets in candidate groups: index lists with block skipping, and answers derived from similar sets' answers.

Sets of a group are indexed by all their elements, each list in blocks by the element's
position in its set; a block whose positions can't leave enough overlap is skipped whole. A
probed set (a pivot) is answered by the index with some slack, so that by the triangle inequality of
the Jaccard distance its answers hold those of every set that is very similar to it. Those sets' answers follow from the
pivot's: by bounds from the sizes of the differences, and where these don't decide, by counting
the index lists of just the elements that differ.

Of a group that is too large for one block, sets go first that have too few elements in common with any others
to be similar to one of them; chains of chance candidates fall apart so. What is left, if still too large, is cut into parts. Each part is joined by itself; then only pivots
meet. Two pivots that are too far apart for any of their sets to link need nothing more; the sets of two
that aren't, and that no chain of links connects, are compared: those of one pivot with those of all such others together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haargrid.llm.components import components
from haargrid.llm.exchange import by_group, in_parts, marked, mix
from haargrid.llm.rows import tidy, written

#: Entries of a block of an index list; sets and elements of a block of a group; pivots that meet one hub in a block.
ENTRIES, SETS, ELEMENTS, PAIRED = 32, 4096, 1 << 20, 512


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    n = stop - start
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


class Index:
    """Index lists of some sets (sorted arrays, none empty), which get numbers by ascending size."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = np.argsort([len(s) for s in sets], kind="stable")
        self.size = np.array([len(sets[i]) for i in self.order])
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)
        _, inverse, count = np.unique(np.concatenate([sets[i] for i in self.order]), return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int32)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count), dtype=np.int32)  # rare ones first
        tokens = rank[inverse]
        self.tokens = tokens[np.lexsort((tokens, owner))]
        place = (np.arange(len(tokens)) - self.at[owner]).astype(np.int32)
        by = np.lexsort((place, self.tokens))
        self.who, self.place = owner[by], place[by]
        self.lists = np.concatenate([[0], np.cumsum(count[np.argsort(count, kind="stable")])])
        n_blocks = -(-np.diff(self.lists) // ENTRIES)
        self.blocks = np.concatenate([[0], np.cumsum(n_blocks)])
        self.start = np.repeat(self.lists[:-1], n_blocks) + ENTRIES * (np.arange(int(n_blocks.sum())) - np.repeat(self.blocks[:-1], n_blocks))
        self.stop = np.append(self.start[1:], len(tokens))
        self.first = self.place[self.start]
        sizes = self.size[self.who]
        self.least, self.most = np.minimum.reduceat(sizes, self.start), np.maximum.reduceat(sizes, self.start)
        self.mark = np.zeros(len(count), bool)
        self.skipped = self.read = self.derived = self.probed = 0  # what was done, for tests

    def of(self, x: int) -> np.ndarray:
        return self.tokens[self.at[x] : self.at[x + 1]]

    def probe(self, p: int, num: int, den: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Open sets (p isn't) with a similarity of num / den or more with p, and the sizes of the intersections."""
        n = int(self.size[p])
        least = -(-num * n // den)
        mine = self.of(p)
        prefix = mine[: n - least + 1]
        a, b = self.blocks[prefix], self.blocks[prefix + 1]
        block, place = ranges(a, b), np.repeat(np.arange(len(prefix)), b - a)
        need = -(-num * (n + np.maximum(self.least[block], least)) // (num + den))
        reach = np.minimum(n - place, self.most[block] - self.first[block])
        fine = (reach >= need) & (self.most[block] >= least) & (num * self.least[block] <= den * n)
        self.skipped += len(block) - int(fine.sum())
        block = block[fine]
        y = self.who[ranges(self.start[block], self.stop[block])]
        self.read += len(y)
        y = np.unique(y[open_[y]])
        y = y[(self.size[y] >= least) & (num * self.size[y] <= den * n)]
        if not len(y):
            return y, np.zeros(0, np.int64)
        self.mark[mine] = True
        ends = np.cumsum(self.size[y])
        both = np.add.reduceat(self.mark[self.tokens[ranges(self.at[y], self.at[y + 1])]].astype(np.int64), ends - self.size[y])
        self.mark[mine] = False
        self.probed += len(y)
        fine = den * both >= num * (n + self.size[y] - both)
        return y[fine], both[fine]

    def differing(self, p: int, x: int, y: np.ndarray) -> np.ndarray:
        """By how many elements the intersections with x are larger than those with p, for the sets y."""
        a, b = self.of(p), self.of(x)
        gone, new = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
        count = lambda t: np.bincount(self.who[ranges(self.lists[t], self.lists[t + 1])], minlength=len(self.size))
        self.derived += len(y)
        return (count(new) - count(gone))[y]


def join(sets: list[np.ndarray], num: int, den: int, index: Index | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of sets with a similarity of num / den or more, as many as connect what is connected; and each set's pivot.

    A pivot's similarity with each of its sets is at least halfway from num / den to 1.
    """
    ix = index or Index(sets)
    n = len(sets)
    label, pivot, open_ = np.arange(n), np.arange(n), np.ones(n, bool)
    links: list[tuple[int, int]] = []

    def link(a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            if label[a] != label[b]:
                links.append((a, b))
                label[label == label[b]] = label[a]

    for p in range(n):
        if not open_[p]:
            continue
        open_[p] = False
        y, both = ix.probe(p, 3 * num - den, 2 * den, open_)
        union = ix.size[p] + ix.size[y] - both
        link(p, y[den * both >= num * union])
        near = 2 * den * both >= (num + den) * union
        close, common = y[near], both[near]
        for x, with_p in zip(close.tolist(), common.tolist(), strict=True):
            rest = label[y] != label[x]
            if not rest.any():  # all answers are connected: so are those of the other close sets
                break
            z, b, s = y[rest], both[rest], ix.size[x] + ix.size[y[rest]]
            high, low = b + (ix.size[x] - with_p), b - (ix.size[p] - with_p)
            sure = den * low >= num * (s - low)
            link(x, z[sure])
            open_pairs = ~sure & (den * high >= num * (s - high))
            if open_pairs.any():
                z, b, s = z[open_pairs], b[open_pairs], s[open_pairs]
                b = b + ix.differing(p, x, z)
                link(x, z[den * b >= num * (s - b)])
        open_[close] = False
        pivot[close] = p
    real = ix.order
    back = np.empty(n, np.int64)
    back[real] = real[pivot]
    return [(int(real[a]), int(real[b])) for a, b in links], back


def far_pairs(sets: list[np.ndarray], wide: np.ndarray, num: int, den: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links of pivots, and pairs that these don't connect but whose sets may link; only pivots that are ``wide`` have other sets."""
    ix = Index(sets)
    n = len(sets)
    open_, wide = np.ones(n, bool), wide[ix.order]
    label, links, pairs = np.arange(n), [], []
    for p in range(n):
        open_[p] = False
        # a pivot's sets are at most half of what two that link may be apart from it
        least = (max(1, 2 * num - den), den) if wide[p] else (3 * num - den, 2 * den) if wide[p:].any() else (num, den)
        y, both = ix.probe(p, *least, open_)
        union = ix.size[p] + ix.size[y] - both
        linked = den * both >= num * union
        for q in y[linked].tolist():
            if label[p] != label[q]:
                links.append((p, q))
                label[label == label[q]] = label[p]
        may = ~linked & ((wide[y] & wide[p]) | ((wide[y] | wide[p]) & (2 * den * both >= (3 * num - den) * union)))
        pairs += [(p, q) for q in y[may].tolist()]
    real = ix.order.tolist()
    return [(real[a], real[b]) for a, b in links], [(real[a], real[b]) for a, b in pairs if label[a] != label[b]]


def across(sets: list[np.ndarray], probes: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links of the sets that are probes with the others, as many as connect what these connect."""
    ix = Index(sets)
    probes, label, links = probes[ix.order], np.arange(len(sets)), []
    for p in np.flatnonzero(probes).tolist():
        for q in ix.probe(p, num, den, ~probes)[0].tolist():
            if label[p] != label[q]:
                links.append((p, q))
                label[label == label[q]] = label[p]
    real = ix.order.tolist()
    return [(real[a], real[b]) for a, b in links]


def with_company(members: DataFrame, sets_of: Callable[[pa.Table], list[np.ndarray]], num: int, den: int) -> DataFrame:
    """(name) of the members of which a share of num / den of the elements is in other members of the group too.

    All others are similar to none. Elements are dealt by packed arrays; a bucket's counts are summed by name.
    """
    n = 4 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches):
        def packed(held: list):
            keys, names = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys)
            keys, names = keys[order], names[order]
            at = np.searchsorted(((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64), np.arange(n + 1)).tolist()
            rows = [(k, keys[x:y].tobytes(), names[x:y].tobytes()) for k, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]
            bucket, raw, who = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(raw, pa.binary()), pa.array(who, pa.binary())], names=["bucket", "keys", "names"])

        held, size = [], 0
        for b in batches:
            t = pa.Table.from_batches([b])
            for s, grp, name in zip(sets_of(t), t.column("grp").to_pylist(), t.column("name").to_pylist(), strict=True):
                held.append((mix(s ^ mix(np.array([grp], np.int64).view(np.uint64))), np.full(len(s), name)))
                size += len(s)
                if size >= ELEMENTS:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def count(batches):
        def counted(held: list):
            keys, names = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys)
            keys, names = keys[order], names[order]
            same = keys[1:] == keys[:-1]
            shared = np.append(same, False) | np.insert(same, 0, False)
            who, at = np.unique(names, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.bincount(at, shared).astype(np.int64)), pa.array(np.bincount(at))], names=["name", "shared", "n"])

        held, last = [], None
        for b in batches:
            for bucket, keys, names in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if bucket != last and held:
                    yield counted(held)
                    held = []
                last = bucket
                held.append((np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(names.as_buffer(), np.int64)))
        if held:
            yield counted(held)

    sent = members.mapInArrow(tidy(send), "bucket int, keys binary, names binary")
    counts = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(count), "name long, shared long, n long")
    return counts.groupBy("name").agg(F.sum("shared").alias("shared"), F.sum("n").alias("n")).filter(F.col("shared") * den >= F.col("n") * num).select("name")


def _pairs(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    kind, a, b = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])


LINK, OF_PIVOT, FAR = 0, 1, 2


def similar(members: DataFrame, sizes: DataFrame, sets_of: Callable[[pa.Table], list[np.ndarray]], num: int, den: int, small: Callable | None = None, together: int = 1) -> DataFrame:
    """(node, component) of the members that link with others.

    ``members`` (a written table) has (grp, name) and what ``sets_of`` makes sets from, ``sizes`` for each
    group (grp, n_members, n_weight). ``small``, if given, takes (sets, starts of the groups) and joins
    many groups at once; it returns links and the numbers of the groups that it leaves to ``join``.
    """

    def first(t: pa.Table, starts: list[int]):
        names, cut, sets, out = t.column("name").to_pylist(), t.column("cut").to_pylist(), sets_of(t), []
        ends = [*starts[1:], len(names)]
        groups = range(len(starts))
        if small is not None:
            links, groups = small(sets, starts)
            out += [(LINK, names[a], names[b]) for a, b in links]
            groups = sorted({*groups, *(g for g, x in enumerate(starts) if cut[x])})  # a part needs pivots, however few its sets are
        for g in groups:
            x, y = starts[g], ends[g]
            links, pivot = join(sets[x:y], num, den)
            out += [(LINK, names[x + a], names[x + b]) for a, b in links]
            if cut[x]:
                out += [(OF_PIVOT, names[x + k], names[x + p]) for k, p in enumerate(pivot.tolist())]
        yield _pairs(out)

    def second(t: pa.Table, starts: list[int]):
        names, sets = t.column("name").to_pylist(), sets_of(t)
        links, pairs = far_pairs(sets, t.column("wide").to_numpy(), num, den)
        yield _pairs([(LINK, names[a], names[b]) for a, b in links] + [(FAR, names[a], names[b]) for a, b in pairs])

    def third(t: pa.Table, starts: list[int]):
        names, sets = t.column("name").to_pylist(), sets_of(t)
        yield _pairs([(LINK, names[a], names[b]) for a, b in across(sets, t.column("probes").to_numpy(), num, den)])

    sizes = written(sizes)
    large = sizes.filter((F.col("n_members") > SETS) | (F.col("n_weight") > ELEMENTS))
    rest = [c for c in members.columns if c not in ("grp", "name")]
    found = "kind int, a long, b long"
    whole = lambda df: df.select("grp", F.lit(0).alias("i"), F.lit(False).alias("cut"), "name", *rest)
    if large.isEmpty():
        return components(written(by_group(whole(members), ["grp", "i"], first, found, together)).filter(F.col("kind") == LINK).select("a", "b"))
    # members of the few large groups are set apart; all others move once, for their group
    told = marked(members, large, ["grp"])
    apart = written(told.filter("maybe").drop("maybe").join(large.select("grp", F.lit(True).alias("large")), "grp", "left"))
    inside = apart.filter("large").drop("large")
    some = written(with_company(inside, sets_of, num, den))
    inside = written(inside.join(some, "name", "left_semi"))
    share = F.coalesce(F.col("left") / F.col("n_members"), F.lit(0.0))
    sizes = large.join(inside.groupBy("grp").agg(F.count("*").alias("left")), "grp", "left").select("grp", F.ceil(F.col("n_members") * share).alias("n_members"), F.ceil(F.col("n_weight") * share).alias("n_weight"))
    blocks = in_parts(inside, sizes, "grp", "name", False, SETS, ELEMENTS).select("grp", "i", "cut", "name", *rest)
    blocks = whole(told.filter("not maybe")).unionByName(whole(apart.filter("large is null"))).unionByName(blocks)
    one = written(by_group(blocks, ["grp", "i"], first, found, together))
    links = one.filter(F.col("kind") == LINK).select("a", "b")
    of_pivot = one.filter(F.col("kind") == OF_PIVOT).select(F.col("a").alias("name"), F.col("b").alias("pivot"))
    if of_pivot.isEmpty():
        return components(links)
    pivots = inside.join(of_pivot.groupBy(F.col("pivot").alias("name")).agg((F.count("*") > 1).alias("wide")), "name")
    counts = of_pivot.filter("name = pivot").join(inside.select("grp", "name"), "name").groupBy("grp").agg(F.count("*").alias("n_members"))
    counts = counts.join(sizes.filter("n_members > 0").select("grp", (F.col("n_weight") / F.col("n_members")).alias("each")), "grp").select("grp", "n_members", F.ceil(F.col("n_members") * F.col("each")).alias("n_weight"))
    blocks = in_parts(pivots, written(counts), "grp", "name", True, SETS, ELEMENTS)
    two = written(by_group(blocks.select("grp", "i", "j", "name", "wide", *rest), ["grp", "i", "j"], second, found))
    links = links.unionByName(two.filter(F.col("kind") == LINK).select("a", "b"))
    far = two.filter(F.col("kind") == FAR).select("a", "b").distinct()
    if far.isEmpty():
        return components(links)
    known = components(links)
    at = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    open_ = written(far.join(at("a"), "a", "left").join(at("b"), "b", "left").filter(F.coalesce("a_of", "a") != F.coalesce("b_of", "b")).select("a", "b"))
    if open_.isEmpty():
        return known
    # of a pair the pivot with more sets is the hub: its sets move once for all pivots that they may link with, PAIRED of these together
    n_sets = of_pivot.groupBy("pivot").agg(F.count("*").alias("n"))
    weighed = lambda c: n_sets.select(F.col("pivot").alias(c), F.struct("n", "pivot").alias(f"{c}_n"))
    turned = open_.join(weighed("a"), "a").join(weighed("b"), "b").select(F.greatest("a_n", "b_n")["pivot"].alias("hub"), F.least("a_n", "b_n")["pivot"].alias("pivot")).distinct()
    n_parts = F.ceil(F.col("n_pairs") / PAIRED)
    turned = written(turned)
    turned = turned.join(turned.groupBy("hub").agg(F.count("*").alias("n_pairs")), "hub").select("hub", "pivot", F.pmod(F.xxhash64("pivot"), n_parts).cast("int").alias("part"))
    hubs = turned.select("hub", "part", F.col("hub").alias("pivot")).distinct().withColumn("probes", F.lit(True))
    meet = hubs.unionByName(turned.withColumn("probes", F.lit(False))).join(of_pivot, "pivot").join(inside.drop("grp"), "name")
    three = by_group(meet.select("hub", "part", "name", "probes", *rest), ["hub", "part"], third, found)
    return components(links.unionByName(written(three).filter(F.col("kind") == LINK).select("a", "b")))
