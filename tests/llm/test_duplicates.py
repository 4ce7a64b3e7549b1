"""Operators on pairs against brute force, on the small tables and on odd rows."""

import hashlib
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haargrid.llm import bwt_dedup, embed_dedup, exchange, jaccard_join, line_dedup, queries, rows, set_join
from haargrid.llm.components import components

BASE = "the quick brown fox jumps over the lazy dog and runs far away from here into the deep dark wood where no one ever goes at night"
TEXTS = [
    None, "", " \n\t ", "one", "one", "One", "one two", BASE, BASE, BASE + " now", BASE.upper(), BASE + "\n" + BASE, BASE + "\n\n" + "another line that nobody else has in this table at all",
    "é" * 60, "x" + "é" * 60, "long " * 3000, "ab" * 2000, BASE.replace("quick", "quack"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i * 3, t, "c", i) for i, t in enumerate(TEXTS)]
    rows += [rows[8], (None, BASE, "c", 0)]  # a repeated row, a row without an id
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, line long").repartition(3)


class Union:
    def __init__(self, items):
        self.root = {i: i for i in items}

    def find(self, x):
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def plain_jaccard(texts):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    u, items = Union(sets), sorted(sets)
    for k, a in enumerate(items):
        for b in items[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * len(sets[a] | sets[b]):
                u.join(a, b)
    return {d: (len(s), u.find(d)) for d, s in sets.items()}


def test_jaccard(spark, sf_dir, odd):
    docs = queries.documents(spark, sf_dir)
    expected = plain_jaccard({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_jaccard_join(spark, sf_dir).collect()} == expected
    rows = jaccard_join.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    expected = plain_jaccard({i * 3: t for i, t in enumerate(TEXTS)})
    assert all((r.n_shingles, r.component_id) == expected[r.doc_id] for r in rows if r.doc_id is not None)
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert jaccard_join.jaccard_components(odd.limit(0)).count() == 0


def test_parts_meet():
    """Sets at the threshold have a part in common, of all sizes."""
    rng = np.random.default_rng(4)
    for n in [*range(1, 40), 57, 100, 333, 1000]:
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        for cut in {0, (n - -(-9 * n // 10))}:
            t = s[rng.permutation(len(s))[: len(s) - cut]]
            t = np.sort(t)
            assert set(jaccard_join.part_keys(s).tolist()) & set(jaccard_join.part_keys(t).tolist()), n


def plain_repeats(texts):
    first, out = {}, {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        g = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], d) < d:
                g[i] += 1
                g[i + 50] -= 1
        m = np.cumsum(g[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        out[d] = (len(b), int(m.sum()), int(np.diff(np.concatenate([[0], m.astype(int)])).clip(0).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_strings(spark, sf_dir, odd):
    docs = queries.documents(spark, sf_dir)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    expected = plain_repeats({r.doc_id: r.text for r in docs.collect()})
    assert {r[0]: tuple(r)[1:] for r in queries.op4_repeated_strings(spark, sf_dir).select(*columns).collect()} == expected
    # many small blocks, and common anchors in parts
    small = bwt_dedup.without_repeats(docs, block_size=2, hot_blocks=3, block_bytes=4096).select(*columns)
    assert {r[0]: tuple(r)[1:] for r in small.collect()} == expected
    rows = bwt_dedup.without_repeats(odd).select(*columns).collect()
    assert len(rows) == odd.count()
    expected = plain_repeats({i * 3: t for i, t in enumerate(TEXTS)})
    assert all(tuple(r)[1:] == expected[r.doc_id] for r in rows if r.doc_id is not None)
    assert [r.n_removed for r in rows if r.doc_id is None] == [0]
    assert bwt_dedup.without_repeats(odd.limit(0)).count() == 0


def test_merged_intervals_equal_sorted_windows():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 2, int(n)).astype(np.uint8)) for n in rng.integers(50, 90, 40)]
    docs = np.arange(40)[::-1].copy()
    got = bwt_dedup.least_documents(texts, docs, rng.integers(0, 2, 40))
    least = {}
    for t, d in zip(texts, docs.tolist(), strict=True):
        for i in range(len(t) - 49):
            least[t[i : i + 50]] = min(d, least.get(t[i : i + 50], d))
    assert all(a.tolist() == [least[t[i : i + 50]] for i in range(len(t) - 49)] for a, t in zip(got, texts, strict=True))


def plain_least(texts, docs):
    least = {}
    for t, d in zip(texts, docs, strict=True):
        for i in range(len(t) - 49):
            least[t[i : i + 50]] = min(d, least.get(t[i : i + 50], d))
    return [[least[t[i : i + 50]] for i in range(len(t) - 49)] for t in texts]


def test_common_prefixes_of_merged_transforms():
    """The merge gives what sorting all suffixes gives: their order and their common prefixes."""
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(3, 90, 30)]
    shards = []
    for part in (texts[:13], texts[13:]):
        start = np.cumsum([0, *(len(t) + 1 for t in part)])[:-1]
        flat = np.frombuffer(b"".join(t + b"\0" for t in part), np.uint8).astype(np.uint16) + np.uint16(1)
        flat[flat == 1] = 0
        shards.append((flat, start))
    z, place, interval, common = bwt_dedup.merged_intervals(shards)
    ends = [np.flatnonzero(s[0] == 0) for s in shards]

    def suffix(k, p):
        stop = int(ends[k][np.searchsorted(ends[k], p)])
        return (*shards[k][0][p:stop].tolist(), 0, k, stop)

    every = [suffix(int(k), int(p)) for k, p in zip(z, place, strict=True)]
    # ties of strings that end are in the order of the strings
    clip = [e[:50] for e in every]
    assert clip == sorted(clip) and len({(int(k), int(p)) for k, p in zip(z, place, strict=True)}) == len(z)
    for x, y, c in zip(every[:-1], every[1:], common[1:].tolist(), strict=True):
        same = next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v or u == 0), 50)
        assert c == min(same, 50)
    assert (np.diff(interval) == (common[1:] < 50)).all()


@pytest.mark.parametrize("merged", [60, 400, 1 << 18])
def test_answers_of_contexts(merged):
    """However small a merge has to be, each string's smallest document is found; equal keys of different bytes don't matter."""
    rng = np.random.default_rng(7)
    base = rng.integers(97, 101, 400).astype(np.uint8).tobytes()
    texts = []
    for _ in range(60):
        t = bytearray(base[int(rng.integers(0, 200)) :][: int(rng.integers(50, 200))])
        for k in rng.integers(0, len(t), int(rng.integers(0, 3))).tolist():
            t[k] = 98
        texts.append(bytes(t))
    docs = rng.permutation(60)
    data, h, owner, a, lo, hi = bwt_dedup.runs_of(texts)
    least, begin = bwt_dedup.answers_of(data, h, a, lo, hi, bwt_dedup.SPAN, docs[owner], owner, merged)
    expected = plain_least(texts, docs.tolist())
    starts = np.cumsum([0, *map(len, texts)])
    for o, x, y, at in zip(owner.tolist(), lo.tolist(), hi.tolist(), begin.tolist(), strict=True):
        assert least[at : at + y - x + 1].tolist() == expected[o][x - starts[o] : y - starts[o] + 1]
    one, of = bwt_dedup.distinct(data, lo, hi - lo + 50, np.zeros(len(lo), np.uint64), np.zeros(len(lo), np.uint64), docs[owner])
    contexts = [data[x : y + 50].tobytes() for x, y in zip(lo, hi, strict=True)]
    assert len(one) == len(set(contexts)) and all(contexts[one[of[i]]] == c for i, c in enumerate(contexts))


def test_parts_of_hot_anchors_hold_all_strings():
    texts = [BASE.encode() * 3]
    _, h, _, a, _, _ = bwt_dedup.runs_of(texts)
    grams = np.unique(h[a])
    _, _, _, _, lo, hi, _, width = bwt_dedup.contexts(texts, grams, grams)
    assert (width == bwt_dedup.FINE).all() and (hi - lo < bwt_dedup.FINE).all()
    assert sorted(i for x, y in zip(lo.tolist(), hi.tolist(), strict=True) for i in range(x, y + 1)) == list(range(len(texts[0]) - 49))


def plain_lines(texts):
    first, places, sets = {}, [], {}
    for d in sorted(texts):
        for i, line in enumerate((texts[d] if texts[d] is not None else "").split("\n")):
            k = line.strip().lower()
            if k:
                places.append((d, i, k))
                first.setdefault(k, (d, i))
                sets[k] = {k[j : j + 8] for j in range(max(1, len(k) - 7))}
    keys = list(sets)
    u, by = Union(range(len(keys))), defaultdict(list)
    for n, k in enumerate(keys):
        for m in {m for s in sets[k] for m in by[s]}:
            both = len(sets[k] & sets[keys[m]])
            if 5 * both >= 4 * (len(sets[k]) + len(sets[keys[m]]) - both):
                u.join(n, m)
        for s in sets[k]:
            by[s].append(n)
    kept = {}
    for n, k in enumerate(keys):
        kept[u.find(n)] = min(first[k], kept.get(u.find(n), first[k]))
    number = {k: n for n, k in enumerate(keys)}
    out = defaultdict(list)
    for d, i, k in places:
        if kept[u.find(number[k])] != (d, i):
            out[d].append(i)
    return out


def test_lines(spark, sf_dir, odd):
    docs = queries.documents(spark, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    expected = plain_lines(texts)
    got = {r.doc_id: [int(x) for x in r.removed.split(",") if x] for r in queries.op7_line_dedup(spark, sf_dir).collect()}
    wrong = [d for d in texts if got[d] != expected.get(d, [])]
    assert len(wrong) <= 0.02 * len(texts)  # bands find a pair at the threshold with 99 %
    rows = line_dedup.repeated_lines(odd).collect()
    expected = plain_lines({i * 3: t for i, t in enumerate(TEXTS)})
    assert all(list(r.removed) == expected.get(r.doc_id, []) for r in rows if r.doc_id is not None)
    assert {r.n_lines for r in rows if r.doc_id == 0} == {0}
    cleaned = line_dedup.without_repeated_lines(odd)
    assert cleaned.columns == odd.columns
    assert {r.doc_id: r.text for r in cleaned.collect() if r.doc_id == 36} == {36: "\nanother line that nobody else has in this table at all"}
    assert line_dedup.repeated_lines(odd.limit(0)).count() == 0


def plain_vectors(rows):
    fine = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u, n = Union(i for i, _, _ in rows), defaultdict(int)
    for k, (i, a, x) in enumerate(fine):
        for j, b, y in fine[:k]:
            if x == y and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                n[i] += 1
                n[j] += 1
                u.join(i, j)
    return {i: (n[i], u.find(i), u.find(i) == i) for i, _, _ in rows}


def test_vectors(spark, sf_dir):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 64))
    rows = [(i, (base[i % 12] * (1 + i % 3) + rng.normal(size=64) * 0.05).astype(np.float32).tolist(), i % 12 % 2) for i in range(240)]
    rows += [(300, None, 1), (301, [0.0] * 64, 1), (302, [None] + [1.0] * 63, 1), (303, [float("nan")] * 64, 1), (304, rows[0][1], None), (305, rows[0][1], 0), (306, rows[0][1], 0), (307, rows[0][1], 1), (308, [1.0, 2.0], 1), (309, [2.0, 4.0], 1), (310, [], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(df).collect()}
    expected = plain_vectors(rows)
    assert set(got) == set(expected)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(e[0] for e in expected.values())
    assert all(got[i][0] <= e[0] for i, e in expected.items())
    assert {i: g[1:] for i, g in got.items()} == {i: e[1:] for i, e in expected.items()}
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0
    real = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op6_near_vectors(spark, sf_dir).collect()} == plain_vectors([(r.vec_id, list(r.embedding), r.label) for r in real])


def test_large_block_is_cut_without_loss(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=64)
    rows = [(i, (x + rng.normal(size=64) * 0.02).tolist(), 1) for i in range(embed_dedup.ROWS + 300)]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.component_id for r in got} == {0}
    assert np.mean([r.n_links for r in got]) >= 0.99 * (len(rows) - 1)


@pytest.mark.parametrize("local", [0, 1 << 19])
def test_components(spark, monkeypatch, local):
    """A long chain, a star, a loop of one, repeated and null links; with and without a last step in one task."""
    monkeypatch.setattr(sys.modules["haargrid.llm.components"], "LOCAL", local)
    links = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(200)] + [(5000, 5000), (6000, 6001), (6001, 6000), (6001, 6000), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[2000 + i] == 1000 for i in range(200)) and got[6001] == got[6000] == 6000
    assert 5000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_similar(sets, num, den):
    u = Union(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if den * both >= num * (len(a) + len(sets[j]) - both):
                u.join(i, j)
    return [u.find(i) for i in range(len(sets))]


def made_sets(seed, n):
    """Copies of few bases with small and larger edits, and sets that share only a common part."""
    rng = np.random.default_rng(seed)
    bases = [rng.integers(0, 2**63, int(k)).astype(np.uint64) for k in (30, 60, 200)]
    common = rng.integers(0, 2**63, 12).astype(np.uint64)
    out = []
    for i in range(n):
        b = bases[i % 3].copy()
        k = int(rng.integers(0, len(b) // 4))
        b[rng.permutation(len(b))[:k]] = rng.integers(0, 2**63, k).astype(np.uint64)
        out.append(np.unique(b if i % 5 else np.concatenate([common, rng.integers(0, 2**63, 20).astype(np.uint64)])))
    return out


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_join_of_sets(num, den):
    """Exact components; index blocks are skipped, and most answers are derived from a similar set's."""
    for seed in range(6):
        sets = made_sets(seed, 90)
        expected = plain_similar([set(s.tolist()) for s in sets], num, den)
        ix = set_join.Index(sets)
        links, pivot = set_join.join(sets, num, den, ix)
        u = Union(range(len(sets)))
        for a, b in links:
            u.join(a, b)
        assert [u.find(i) for i in range(len(sets))] == expected
        for x, p in enumerate(pivot.tolist()):
            both = len(np.intersect1d(sets[x], sets[p]))
            assert 2 * den * both >= (num + den) * (len(sets[x]) + len(sets[p]) - both)
        assert ix.skipped > 0
    base = np.arange(1000, dtype=np.uint64) * np.uint64(77)
    sets = [np.unique(np.concatenate([base[i % 3 * 40 :], np.arange(i % 7, dtype=np.uint64) + np.uint64(10**6 + 50 * i)])) for i in range(300)]
    ix = set_join.Index(sets)
    links, pivot = set_join.join(sets, num, den, ix)
    assert len(links) == 299 and ix.probed < 10 * 300 and len(set(pivot.tolist())) < 10


def test_groups_beyond_a_block(spark, monkeypatch):
    """A large group is cut: each part, then pivots, then what stays open, give the same components."""
    monkeypatch.setattr(set_join, "SETS", 16)
    sets = made_sets(9, 200)
    members = spark.createDataFrame([(1, 10 + i, s.tobytes()) for i, s in enumerate(sets)] + [(2, 1000, sets[0].tobytes())], "grp long, name long, raw binary")
    sizes = members.groupBy("grp").agg(F.count("*").alias("n_members"), F.sum(F.octet_length("raw")).alias("n_weight"))
    got = {r.node: r.component for r in set_join.similar(members, sizes, lambda t: [np.frombuffer(x, np.uint64) for x in t.column("raw").to_pylist()], 4, 5).collect()}
    expected = plain_similar([set(s.tolist()) for s in sets], 4, 5)
    assert {10 + i: 10 + e for i, e in enumerate(expected) if expected.count(e) > 1} == got


def test_members_of_small_groups_move_once(spark, monkeypatch):
    """Beside a large group, the texts of all others are dealt out for their group only, and not stored again."""
    sets = made_sets(4, 120)
    pairs = [(1, 10 + i, s.tobytes()) for i, s in enumerate(sets)] + [(2 + i, 1000 + 2 * i + k, sets[i].tobytes()) for i in range(100) for k in (0, 1)]
    members = rows.written(spark.createDataFrame(pairs, "grp long, name long, raw binary"))
    sizes = members.groupBy("grp").agg(F.count("*").alias("n_members"), F.sum(F.octet_length("raw")).alias("n_weight"))
    real, stored = rows.written, []
    monkeypatch.setattr(set_join, "written", lambda df: stored.append((df, real(df))) or stored[-1][1])
    sets_of = lambda t: [np.frombuffer(x, np.uint64) for x in t.column("raw").to_pylist()]
    expected = plain_similar([set(s.tolist()) for s in sets], 4, 5)
    small = {x: 1000 + 2 * i for i in range(100) for x in (1000 + 2 * i, 1001 + 2 * i)}
    expected = small | {10 + i: 10 + e for i, e in enumerate(expected) if expected.count(e) > 1}
    for most in (16, 4096):
        monkeypatch.setattr(set_join, "SETS", most)
        stored.clear()
        assert {r.node: r.component for r in set_join.similar(members, sizes, sets_of, 4, 5).collect()} == expected
        again = [t for _, t in stored if "raw" in t.columns]
        assert len(again) == (2 if most == 16 else 0) and all(t.filter("grp > 1").count() < 10 for t in again)
        if most == 4096:
            plan = next(df for df, t in stored if "kind" in t.columns)._jdf.queryExecution().toString().rpartition("== Physical Plan ==")[2]
            assert plan.count("Exchange") == 1 and "Join" not in plan


def test_sets_of_a_pivot_meet_others_together(spark, monkeypatch):
    """Pivots that may link with many others: their sets aren't sent for each of those pairs, and all links are found."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)

    def changed(of, own):
        out = of.copy()
        out[own] = rng.integers(0, 2**63, len(own)).astype(np.uint64)
        return out

    # near copies; sets beyond the reach of all of them; sets within that of one copy only
    copies = [changed(base, np.arange(150 + 2 * i, 152 + 2 * i)) for i in range(24)]
    others = [changed(base, np.arange(k % 60, k % 60 + 25)) for k in range(30)] + [changed(copies[5 + 2 * k], np.arange(10 * k, 10 * k + 22)) for k in range(8)]
    sets = [np.unique(s) for s in copies + others]
    real, sent = set_join.by_group, []
    monkeypatch.setattr(set_join, "by_group", lambda df, *a: sent.append(df.count()) or real(df, *a))
    members = spark.createDataFrame([(1, 10 + i, s.tobytes()) for i, s in enumerate(sets)], "grp long, name long, raw binary")
    sizes = members.groupBy("grp").agg(F.count("*").alias("n_members"), F.sum(F.octet_length("raw")).alias("n_weight"))
    expected = plain_similar([set(s.tolist()) for s in sets], 4, 5)
    for paired in (512, 3):
        monkeypatch.setattr(set_join, "SETS", 16)
        monkeypatch.setattr(set_join, "PAIRED", paired, raising=False)
        sent.clear()
        got = {r.node: r.component for r in set_join.similar(members, sizes, lambda t: [np.frombuffer(x, np.uint64) for x in t.column("raw").to_pylist()], 4, 5).collect()}
        assert got == {10 + i: 10 + e for i, e in enumerate(expected) if expected.count(e) > 1}
        assert expected.count(0) == 32 and len(sent) == 3
        if paired == 512:
            assert sent[2] < 4 * len(sets)


def test_parts_of_few_sets_meet_the_others(spark, monkeypatch):
    """Parts of a cut group that count as small are joined with the other parts too."""
    monkeypatch.setattr(set_join, "SETS", 6)
    sets = made_sets(9, 60)
    members = spark.createDataFrame([(1, 10 + i, s.tobytes()) for i, s in enumerate(sets)], "grp long, name long, raw binary")
    sizes = members.groupBy("grp").agg(F.count("*").alias("n_members"), F.sum(F.octet_length("raw")).alias("n_weight"))
    found = set_join.similar(members, sizes, lambda t: [np.frombuffer(x, np.uint64) for x in t.column("raw").to_pylist()], 4, 5, line_dedup.small_groups, line_dedup.TOGETHER)
    expected = plain_similar([set(s.tolist()) for s in sets], 4, 5)
    assert {r.node: r.component for r in found.collect()} == {10 + i: 10 + e for i, e in enumerate(expected) if expected.count(e) > 1}


def test_keys_are_sent_as_32_bits(spark, monkeypatch):
    """A key's bucket and lower bits tell it; ids of a key in common are linked as before."""
    sent = []
    real = spark.createDataFrame([(0, "")], "a int, b string").__class__.mapInArrow
    monkeypatch.setattr(spark.range(0).__class__, "mapInArrow", lambda self, f, schema, *a, **b: sent.append(out := real(self, f, schema, *a, **b)) or out)

    def per_task():
        return lambda batch: ([batch.column(0)], exchange.mix(batch.column(0).to_numpy().astype(np.uint64) // np.uint64(3)), batch.column(0).to_numpy())

    shared = exchange.share_keys(spark.range(3000).repartition(3), per_task, "id long")
    links = {(r.a, r.b) for r in shared.filter("a is not null").collect()}
    found = Union(range(3000))
    for a, b in links:
        found.join(a, b)
    assert [found.find(i) for i in range(3000)] == [i // 3 * 3 for i in range(3000)]
    weight = sent[0].filter("bucket >= 0").agg(F.sum(F.octet_length("keys")), F.sum(F.octet_length("ids"))).first()
    assert 2 * weight[0] == weight[1] > 0


def test_equal_line_numbers_of_different_lines(spark, monkeypatch):
    """Half of a digest may be equal by chance: lines are told by all of it."""
    real = line_dedup.digest
    monkeypatch.setattr(line_dedup, "digest", lambda k: (b"same key" + real(k)[8:]) if k else bytes(16))
    f = line_dedup._lines_and_keys()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one line", "another line\none line"]})
    (_, lines, checks), _, _ = f(batch)
    assert len({x for row in lines.to_pylist() for x in row}) == 1 and checks.to_pylist()[0][0] == checks.to_pylist()[1][1] != checks.to_pylist()[1][0]


def test_vector_work_is_near_linear():
    """Twice the vectors: a sign more, so pairs that are counted and verified grow little faster than vectors."""
    work = []
    for n in (2048, 4096, 8192):
        x = np.random.default_rng(1).normal(size=(n, 64))
        u = embed_dedup.unit(x)
        signs, tables = embed_dedup.plan(n)
        pairs = 0
        for t in range(tables):
            size = np.unique(embed_dedup.cells(u, t, signs), return_counts=True)[1]
            pairs += int((size * (size - 1) // 2).sum())
        work.append(pairs)
    assert work[1] <= 2.5 * work[0] and work[2] <= 2.5 * work[1]


def test_planted_vectors_are_found(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    y = embed_dedup.unit(x)
    noise = rng.normal(size=x.shape)
    noise -= (noise * y).sum(1, keepdims=True) * y
    near = y + embed_dedup.unit(noise) * np.tan(np.arccos(0.9801))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([y, near]))]
    got = {r.vec_id: r.component_id for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    assert np.mean([got[3000 + i] == i for i in range(3000)]) >= 0.998


def test_clashing_names(spark):
    """Columns may have the names that the operators use inside."""
    one, two = "a line that both of the documents have in them", "and another that only one of them has, which is longer"
    rows = [(1, one, "u", "v", "w", "x"), (2, f"{one}\n{two}", "u", "v", "w", "x"), (None, one, "u", "v", "w", "x"), (4, None, "u", "v", "w", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, id string, removed string, `left` string")
    out = {r.doc_id: tuple(r) for r in line_dedup.without_repeated_lines(docs).collect()}
    assert out == {1: rows[0], 2: (2, two, "u", "v", "w", "x"), None: rows[2], 4: rows[3]}


def test_only_rows_that_a_join_may_keep_are_dealt_out(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("case when id % 1000 = 7 then null else id end as id", "cast(id % 3 as int) as no")
    wanted = spark.range(0, 20_000, 100).selectExpr("id", "id % 3 as no")
    found = exchange.among(rows, wanted, ["id", "no"])
    assert found.columns == rows.columns
    assert found.join(wanted, ["id", "no"]).count() == 200 and found.count() < 250
    assert exchange.among(rows, wanted.limit(0), ["id", "no"]).count() == 0
    # texts without a candidate line and those that lose none stay where they are, and a full filter changes nothing
    docs = spark.createDataFrame([(k, f"line {k // 2} of a text that stands in two\nline {k} of a text that is alone {'xyz'[k % 3] * 40}\n\n{k}") for k in range(60)] + [(None, "line 1 of a text that stands in two"), (99, None)], "doc_id long, text string")
    real, seen = exchange.marked, []
    monkeypatch.setattr(line_dedup, "marked", lambda *x: seen.append(real(*x)) or seen[-1])
    want = sorted(map(repr, line_dedup.without_repeated_lines(docs).collect()))
    assert 0 < seen[0].filter("maybe").count() < 60
    monkeypatch.setattr(exchange, "FILTER", 64)
    assert sorted(map(repr, line_dedup.without_repeated_lines(docs).collect())) == want
