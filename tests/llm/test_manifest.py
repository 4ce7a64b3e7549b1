"""The manifest of documents against a plain Merkle tree."""

import hashlib
import zlib

import pytest

from haargrid.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(s):
    return s and "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def plain_tree(nodes, width=16):
    """(root, for each node the (left, right) siblings of each level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // width * width
            paths[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + width])))
        nodes = [h(*nodes[i : i + width]) for i in range(0, len(nodes), width)]
        at = [k // width for k in at]
    return (nodes[0] if nodes else None), paths


def plain(rows):
    leaf = lambda r, text: h(*map(framed, (*r[:4], text)))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = own, *plain_tree([leaf(r, r[4]) for r in own])
    root, above = plain_tree([trees[s][1] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            path = path + up
            now = leaf(r, lower(r[4]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4])
            for a, b in path:
                now = h(a, now, b)
            out.append((r[0], leaf(r, r[4]), subroot, root, h(*(a + b for a, b in path)), now, now == root))
    return out


ODD = [(1, "a", "en", 3, "Abc"), (2, "a", None, None, None), (2, "a", None, None, None), (None, "a", "en", 1, "X"), (5, None, "en", 0, ""), (4, "", "é", 2, "ÀB"), (8, "z", "en", 90_000, "Long Text " * 9_000), (-7, "Z", None, 1, "É")]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as key", "2 as h", "3 as path", "'x' as leaf")
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("n", [1, 15, 16, 17, 256, 257])
def test_sizes_of_a_source(spark, n):
    check(spark, [(i * 7 % 1000, "one", "en", i, f"Text {i}") for i in range(n)] + [(3, "other", "en", 1, "B")])


def test_odd_rows(spark):
    check(spark, ODD)
    check(spark, [])


def test_blocks_of_blocks(spark, monkeypatch):
    """With blocks of sixteen leaves, one source is four layers and the sources two."""
    monkeypatch.setattr(merkle, "DIGITS", 1)
    check(spark, [(i, "hot", "en", i, f"T{i}") for i in range(4200)] + [(i, f"s{i % 20:02}", "en", 1, "B") for i in range(40)])


def test_tampering_shows(spark, sf_dir):
    rows = merkle.manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert len({r.root for r in rows}) == 1 and {r.verified for r in rows} == {True, False}
    assert all(r.verified for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5)
