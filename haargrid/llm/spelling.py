"""Spelling variants: words one insertion, deletion or replacement apart, and the forms they lead to.

Words are counted over all whole texts, batch by batch before the shuffle. A word's letters are a binary
vector: bit (letter, k) is set if the letter occurs k times or more. One edit changes at most two bits, so near
words have vectors of Hamming distance at most two. Bits are dealt to PARTS parts; two vectors that differ in at
most two bits agree on all bits of some PARTS - 2 parts, so every choice of that many parts gives a signature (the
choice and the vector's bits in it), and near words share one: an equi-join of signatures is exact. What it proposes is
verified by the edit distance in code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haargrid.llm.exchange import mix
from haargrid.llm.rows import slices, small_batches, tidy, written

#: Parts of the bits; a signature leaves two of them out. 21 signatures a word.
PARTS, EDIT_BITS = 7, 2
#: Code points and occurrences that a word has at least.
LENGTH, TIMES = 5, 3
#: One in so many (document, word) pairs loses a code point, as the crc32 says.
LOSES = 97
#: Different words that a task counts before it sends them on.
HELD = 1 << 18
_LOWER = {c: c + 32 for c in range(65, 91)}


def _runs(least: int) -> re.Pattern:
    """Maximal runs of letters of ``least`` code points or more."""
    return re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")


def document_words(doc_id: int | None, text: str, runs: re.Pattern) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text, after the deletions that its id decides; a null id decides none."""
    found: Counter = Counter()
    for run, n in Counter(runs.findall(text)).items():
        found[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    if doc_id is None:
        yield from found.items()
        return
    start = zlib.crc32(f"{doc_id}:".encode())
    for word, n in found.items():
        h = zlib.crc32(word.encode(), start)
        if h % LOSES == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(word, n) of all words of at least ``length`` code points and ``times`` occurrences in all texts."""
    runs = _runs(length)  # a shorter run never becomes longer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            words = list(held)
            for x in range(0, len(words), 65536):
                some = words[x : x + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([held[w] for w in some], pa.int64())], names=["word", "n"])

        for b in batches:
            for x, y in slices(b.column(1)):
                for i, text in zip(b.column(0).slice(x, y - x).to_pylist(), b.column(1).slice(x, y - x).to_pylist(), strict=True):
                    for word, n in document_words(i, text or "", runs):
                        if len(word) >= length:
                            held[word] += n
                    if len(held) >= HELD:
                        yield from out()
                        held.clear()
        yield from out()

    found = small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def signatures(words: list[str], parts: int = PARTS) -> np.ndarray:
    """(words, choices) 64-bit signatures of the words' vectors. Different ones may collide, which only proposes more."""
    bit_of, which, bits = {}, [], []
    for i, word in enumerate(words):
        for c, n in Counter(word).items():
            for k in range(n):
                bits.append(bit_of.setdefault((c, k), (ord(c) << 16) + k))
                which.append(i)
    h = mix(np.array(bits, np.uint64))
    sums = np.zeros((len(words), parts), np.uint64)
    np.add.at(sums, (np.array(which, int), (mix(h) % np.uint64(parts)).astype(int)), h)
    own = mix(sums + np.arange(parts, dtype=np.uint64)[None, :])
    return np.stack([mix(own[:, list(c)].sum(1) + np.uint64(k)) for k, c in enumerate(combinations(range(parts), parts - EDIT_BITS))], 1)


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, b, na, nb), a < b: all pairs of words (word, n) that differ by exactly one code point inserted, deleted or replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(0, b.num_rows, 4096):
                some, n = b.column(0).slice(x, 4096), b.column(1).slice(x, 4096)
                sigs = signatures(some.to_pylist(), parts)
                at = pa.array(np.repeat(np.arange(len(some)), sigs.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(sigs.ravel().view(np.int64)), some.take(at), n.take(at)], names=["sig", "word", "n"])

    sigs = small_batches(words).select("word", "n").mapInArrow(tidy(run), "sig long, word string, n long")
    sigs = written(sigs.withColumn("size", F.length("word")))
    # what no other word has is no candidate; the join needs its partners only
    shared = written(sigs.groupBy("sig").agg(F.count("*").alias("k")).filter("k > 1").select("sig"))
    sigs = written(sigs.join(shared, "sig", "left_semi"))
    a, b = (sigs.select("sig", *[F.col(c).alias(f"{c}_{s}") for c in ("word", "n", "size")]) for s in "ab")
    met = a.join(b, (a["sig"] == b["sig"]) & (F.col("word_a") < F.col("word_b")) & (F.abs(F.col("size_a") - F.col("size_b")) <= 1) & (F.levenshtein("word_a", "word_b", 1) == 1))
    return met.select(F.col("word_a").alias("a"), F.col("word_b").alias("b"), F.col("n_a").alias("na"), F.col("n_b").alias("nb")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form) by pointer doubling: as many rounds as a path's length has bits."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of all texts.

    A word's form is its near word of most occurrences (ties: the first by code points), if it has at least twice
    the word's; its root is where the forms lead. Null and empty texts have no words; a null id deletes nothing; a repeated row
    counts again; an empty table gives no rows. Only the two named columns are read.
    """
    words = written(count_words(docs, id_col, text_col, length, times))
    pairs = written(near_words(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("form"), F.col("na").alias("n"), F.col("nb").alias("form_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("form"), F.col("nb").alias("n"), F.col("na").alias("form_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"), F.first("n").alias("n"))
    led = F.col("best.less") * -1 >= F.col("n") * 2
    near = written(best.select("word", "n_near", F.when(led, F.col("best.form")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n")))
    roots = _roots(near.filter("form is not null"))
    return words.join(near, "word", "left").join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
