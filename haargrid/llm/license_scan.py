"""Licence texts in documents: a suffix automaton of all templates' words, matching statistics, chained matches.

The automaton holds every run of words of every template. Streaming a document through it gives, for each word, the
length of the longest run that ends there and stands in a template too (the matching statistics). Places where a
pair of neighbouring words is in no template have a statistic of at most one, so only what lies between them
is streamed; those pairs are looked up by numpy. Long matches are chained template by template, both sides in
order, and a chain that covers enough of its template is a span. Phrases are read off the automaton too: a phrase
ends where the state, or one on its suffix links, is the phrase's.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haargrid.llm.license_texts import PHRASES, TEMPLATES
from haargrid.llm.rows import slices, small_batches, tidy

#: Words that a match has to have, words between matches of a chain, share of a template that a span covers.
LONG, GAP, SHARE = 4, 24, 0.6
#: What a phrase without a span scores.
PHRASE_SCORE = 0.5
#: After A-Z are lower case, these bytes are exactly those that no separator has.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8; lower-casing bytes changes A-Z only."""
    return _WORD.findall(text.lower())


class Automaton:
    """Generalised suffix automaton of sequences of small numbers, with where each state's runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.size, ends = [{}], [-1], [0], [set()]

        def state(size: int, after: dict, link: int) -> int:
            self.next.append(after)
            self.link.append(link)
            self.size.append(size)
            ends.append(set())
            return len(self.next) - 1

        def cloned(p: int, c: int, q: int) -> int:
            """The part of state q that is reached from p, as a state of its own."""
            new = state(self.size[p] + 1, dict(self.next[q]), self.link[q])
            self.link[q] = new
            while p >= 0 and self.next[p].get(c) == q:
                self.next[p][c] = new
                p = self.link[p]
            return new

        def extended(last: int, c: int) -> int:
            if c in self.next[last]:  # another sequence went here
                q = self.next[last][c]
                return q if self.size[q] == self.size[last] + 1 else cloned(last, c, q)
            cur, p = state(self.size[last] + 1, {}, 0), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[cur] = q if self.size[q] == self.size[p] + 1 else cloned(p, c, q)
            return cur

        for t, sequence in enumerate(sequences):
            last = 0
            for i, c in enumerate(sequence):
                last = extended(last, c)
                ends[last].add((t, i))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.size[s]):
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        self.ends = [sorted(e) for e in ends]

    def find(self, sequence: list[int]) -> int:
        """The state of a run that is known to be there."""
        s = 0
        for c in sequence:
            s = self.next[s][c]
        return s

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest known run that ends at each place."""
        s, n = 0, 0
        for c in sequence:
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.size[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            else:
                s, n = 0, 0
            yield s, n


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, long: int = LONG, gap: int = GAP, share: float = SHARE):
        self.long, self.gap, self.share = long, gap, share
        self.labels, self.phrase_labels = [t[0] for t in templates], [p[0] for p in phrases]
        texts = [words_of(t[1].encode()) for t in templates]
        own = [words_of(p[1].encode()) for p in phrases]
        self.sizes = [len(t) for t in texts]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for t in [*texts, *own] for w in t))}
        coded = [[self.ids[w] for w in t] for t in [*texts, *own]]
        n = len(self.ids)
        # the last row and column stand for words of no template
        self.pairs = np.zeros((n + 1) ** 2, bool)
        for t in coded:
            self.pairs[[a * (n + 1) + b for a, b in zip(t, t[1:], strict=False)]] = True
        self.automaton = Automaton(coded)
        a = self.automaton
        of = {}
        for k, p in enumerate(own):
            of.setdefault(a.find([self.ids[w] for w in p]), []).append((k, len(p)))
        # phrases that end where a state's runs end, with their lengths; shorter states first
        self.phrases = [[] for _ in a.next]
        for s in sorted(range(1, len(a.next)), key=a.size.__getitem__):
            self.phrases[s] = [*of.get(s, []), *self.phrases[a.link[s]]]
        self.ends = [[(t, i) for t, i in e if t < len(templates)] for e in a.ends]
        #: A template shorter than a long match is found as a whole.
        self.least = [min(long, size) for size in self.sizes]
        self.shortest = min(self.least, default=long)

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Number of words; phrases as (label, first word); spans as (label, first word, last word, covered share)."""
        words, n = words_of(text), len(self.ids)
        ids = np.fromiter(map(self.ids.get, words, repeat(n)), np.int64, len(words))
        known = np.flatnonzero(self.pairs[ids[:-1] * (n + 1) + ids[1:]]) if len(words) > 1 else np.zeros(0, int)
        base, matches = [], {}
        if len(known):
            cut = np.flatnonzero(np.diff(known) > 1) + 1
            for x, y in zip(known[np.r_[0, cut]].tolist(), (known[np.r_[cut - 1, len(known) - 1]] + 2).tolist(), strict=True):
                self._stream(ids[x:y].tolist(), x, base, matches)
        spans = [s for t, found in matches.items() for s in self._chains(t, found)]
        return len(words), base, sorted(spans, key=lambda s: (s[1], s[2], s[0]))

    def _stream(self, ids: list[int], start: int, base: list, matches: dict) -> None:
        stats = list(self.automaton.statistics(ids))
        for i, (s, n) in enumerate(stats):
            for k, size in self.phrases[s]:
                if size <= n:
                    base.append((self.phrase_labels[k], start + i + 1 - size))
            # a match ends where the next word doesn't prolong it
            if n >= self.shortest and (i + 1 == len(stats) or stats[i + 1][1] <= n):
                for t, end in self.ends[s]:
                    if n >= self.least[t]:
                        matches.setdefault(t, []).append((start + i - n + 1, end - n + 1, n))

    def _chains(self, t: int, found: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, float]]:
        """Spans of a template from its matches (place, place in the template, words), in order of their ends in the document."""
        best: list[tuple[int, int]] = []  # words covered by the best chain that ends with a match, and where that chain begins
        first = 0
        for j, (d, p, n) in enumerate(found):
            cover, start = n, d
            while first < j and found[first][0] + found[first][2] + self.gap < d:
                first += 1
            for i in range(first, j):
                e, q, m = found[i]
                new = n - max(0, e + m - d, q + m - p)
                if new > 0 and q < p and e < d and e + m + self.gap >= d and best[i][0] + new > cover:
                    cover, start = best[i][0] + new, best[i][1]
            best.append((cover, start))
        need, taken = self.share * self.sizes[t], []
        for cover, start, last in sorted(((c, s, d + n - 1) for (c, s), (d, p, n) in zip(best, found, strict=True) if c >= need), key=lambda x: (-x[0], x[1])):
            k = bisect_left(taken, (start, last))
            if (k == len(taken) or taken[k][0] > last) and (k == 0 or taken[k - 1][1] < start):
                taken.insert(k, (start, last))
                yield self.labels[t], start, last, min(1.0, cover / self.sizes[t])


@cache
def scanner() -> Scanner:
    return Scanner()


SCHEMA = "n_words long, base array<struct<label:string,word:long>>, spans array<struct<label:string,first:long,last:long,covered:double>>"


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, base, spans): places of the phrases, and covered spans of the templates, of every whole text.

    Words are numbered from 0 and spans include their last. A null text counts as empty; null ids and repeated rows are
    passed on; an empty table gives no rows. One pass without a shuffle; only the two named columns are read.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string(SCHEMA).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for b in batches:
            raw = b.column(1).cast(pa.binary())
            for x, y in slices(b.column(1)):
                rows = [scan(t or b"") for t in raw.slice(x, y - x).to_pylist()]
                named = [([{"label": k, "word": w} for k, w in base], [{"label": k, "first": i, "last": j, "covered": c} for k, i, j, c in spans]) for _, base, spans in rows]
                columns = [[r[0] for r in rows], [r[0] for r in named], [r[1] for r in named]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x).cast(arrow.field(0).type), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), schema)


def license_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, places and labels of each row of ``scan_documents``. ``score`` is the largest share of a template that a
    span covers; phrases alone give one half, nothing gives zero."""
    places = F.transform("base", lambda b: b["word"])
    own, more = F.transform("base", lambda b: b["label"]), F.transform("spans", lambda s: s["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0)), F.when(F.size("base") > 0, PHRASE_SCORE).otherwise(0.0))
    return found.select(id_col, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), joined(own).alias("base_labels"), joined(F.concat(own, more)).alias("labels"), score.alias("score"))
