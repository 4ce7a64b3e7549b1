"""Licence scans against plain searches."""

import random
import re

from haargrid.llm import license_scan
from haargrid.llm.license_texts import PHRASES, TEMPLATES


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    words = plain_words(text)
    return sorted((i, label) for label, p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


ODD = [None, "", "   ", "é" * 50, "MIT License", "mit\nlicense MIT licensE, mit LiCENSE", "GNU General Public License; Apache-License CC BY", "KIT LICENSE MİT license", "cc by cc by cc by", "apache license " * 20_000, "mit license\x00mit license", "x" * 60_000, "licensed under cc by nc 4.0", "mit", "license"]


def digest(spark, texts):
    docs = spark.createDataFrame([(i if i != 4 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as base", "3 as spans")
    return license_scan.license_digest(license_scan.scan_documents(docs)).collect()


def test_phrases_equal_plain_search(spark, sf_dir):
    rng = random.Random(1)
    mixed = [" ".join(rng.choice("gnu general public license apache cc by mit é the of MIT".split()) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    given = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = {r.doc_id: r for r in digest(spark, ODD + mixed + given)}
    assert len(rows) == len(ODD + mixed + given)
    for i, t in enumerate(ODD + mixed + given):
        r, base = rows[i if i != 4 else None], plain_base(t)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(plain_words(t)), len(base), base[0][0] if base else None, base[-1][0] if base else None)
        assert r.base_labels == ",".join(sorted({b[1] for b in base})) and set(r.base_labels.split(",")) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_empty_table(spark):
    assert digest(spark, []) == []


def test_matching_statistics_equal_plain_ones():
    rng = random.Random(2)
    for _ in range(60):
        known = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 5))]
        a = license_scan.Automaton(known)
        runs = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
        text = [rng.randrange(4) for _ in range(40)]
        for i, (s, n) in enumerate(a.statistics(text)):
            longest = max((m for m in range(i + 2) if tuple(text[i + 1 - m : i + 1]) in runs), default=0) if tuple(text[i : i + 1]) in runs else 0
            assert n == longest
            run = text[i + 1 - n : i + 1]
            assert not n or a.ends[s] == [(t, j) for t, k in enumerate(known) for j in range(n - 1, len(k)) if k[j + 1 - n : j + 1] == run]


def test_templates_are_found_among_other_words():
    scan = license_scan.scanner().scan
    for label, text in TEMPLATES:
        n, _, spans = scan(f"Some words before. {text} And some after.".encode())
        assert (label, 3, 3 + len(plain_words(text)) - 1, 1.0) in spans, label
    assert scan(b"") == (0, [], []) and scan(b"nothing of the kind, of the license or so")[2] == []


def test_changed_templates_are_chained():
    scan, rng = license_scan.scanner().scan, random.Random(4)
    for label, text in TEMPLATES:
        words = plain_words(text)
        if len(words) < 30:
            continue
        for _ in range(20):
            changed = list(words)
            for k in rng.sample(range(len(words)), len(words) // 25):
                changed[k] = rng.choice(["", "zzz", "zzz yyy"])
            spans = scan(" ".join(["zzz"] * 7 + changed + ["zzz"] * 5).encode())[2]
            assert any(s[0] == label and s[3] >= 0.6 and s[1] < 20 for s in spans), (label, changed)


def test_two_copies_are_two_spans():
    text = "Released under the MIT License. " * 3
    assert [s[:3] for s in license_scan.scanner().scan(text.encode())[2]] == [("mit", 0, 4), ("mit", 5, 9), ("mit", 10, 14)]
