"""Spelling variants against a plain version over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from haargrid.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, length=5, times=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{w}".encode())) % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= length and k >= times}
    by = {w: [v for v in n if near(v, w)] for w in n}
    form = {w: (best if by[w] and n[best := min(by[w], key=lambda v: (-n[v], v))] >= 2 * k else None) for w, k in n.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return [(w, form[w], root(w), n[w], len(by[w]), n.get(form[w])) for w in n]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'w' as word", "2 as sig")
    assert sorted(map(tuple, spelling.variants(docs).collect()), key=repr) == sorted(plain(rows), key=repr)


def test_variants_equal_plain_version(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéÉß×") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    texts = []
    for i in range(150):
        words = []
        for _ in range(200):
            w = rng.choice(stems[: rng.randint(1, 60)])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÀ") + w[k:], w[:k] + rng.choice("abc") + w[k + 1 :], w.upper()])
            words.append(w)
        texts.append((i if i % 9 else None, " ".join(words)))
    check(spark, texts + texts[:3] + [(1, None), (2, ""), (3, "Ab1cdefg " * 5000), (4, "x" * 50_000)])


def test_chains_lead_to_roots(spark):
    chain = ["abcdefgh", "abcdefg", "abcdef", "abcde"]
    check(spark, [(None, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k))), (None, "tiesa tiesa tiesa tiesb tiesb tiesb tiesb tiesb tiesb tiesc tiesc tiesc tiesc tiesc tiesc")])


def test_no_words(spark):
    check(spark, [])
    check(spark, [(1, "abc def"), (2, None)])


def test_near_words_share_a_signature():
    rng = random.Random(5)
    pairs = []
    for _ in range(3000):
        w = "".join(rng.choice("abcdefgé") for _ in range(rng.randint(5, 12)))
        k, c = rng.randrange(len(w)), rng.choice("abcdefgé")
        pairs.append((w, rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])))
    a, b = (spelling.signatures(list(x)) for x in zip(*pairs, strict=True))
    assert (a == b).any(1).all() and len(np.unique(a)) > 3000


def test_given_texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, spelling.variants(rows).collect()), key=repr) == sorted(plain(list(map(tuple, rows.collect()))), key=repr)
