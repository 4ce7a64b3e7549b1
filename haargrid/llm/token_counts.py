"""Token counts with the whole-token shortcut.

A sentencepiece BPE model merges symbols inside a text; no merge can join two units between
which no vocabulary string reaches. ``Counter`` proves from the vocabulary, before any text
is read, (a) which characters may separate units and (b) which vocabulary strings encode
alone as one token. A text is then cut into units; units found in the proved table count
one, and only the other units are merged, each distinct one once while it stays in memory.
"""

from __future__ import annotations

import functools
import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haargrid.llm.rows import map_text

SPACE = "▁"
#: Remembered units of a task's worker; at this many the table is started again.
MEMO_UNITS = 300_000


class Counter:
    """Counts the tokens of texts as the sentencepiece library gives them.

    Needs a BPE model without normalisation (checked): its spaces become U+2581, one more
    is put in front of a text that isn't empty, and nothing else changes.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in plain]
        probe = " a  b\n c "
        if sp.encode(probe, out_type=str)[:1] != [SPACE * 2] and "".join(sp.encode(probe, out_type=str)).count(SPACE) != 6:
            raise ValueError("the model normalises white space; units can't be told apart")
        # (a) a unit may start at a space that follows another character, and newline stands alone
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a vocabulary string reaches over the start of a word")
        self.lines_apart = not any("\n" in p for p in pieces)
        self.newline = len(sp.encode("a\na")) - len(sp.encode("a")) - self._bare("a") if self.lines_apart else 0
        self.units = re.compile(" +[^ \n]*|[^ \n]+" if self.lines_apart else " +[^ ]*|[^ ]+").findall
        # (b) these encode alone as one token
        shown = [p.replace(SPACE, " ") for p in pieces if "\n" not in p]
        self.whole = {u: 1 for u, n in zip(shown, self.merge(shown), strict=True) if n == 1}
        self.memo = dict(self.whole)

    def _bare(self, unit: str) -> int:
        """Tokens of a unit that no space precedes: as they stand after a newline."""
        return len(self.sp.encode("\n" + unit)) - len(self.sp.encode("\n"))

    def merge(self, units: list[str]) -> list[int]:
        """Tokens of units by merging; a bare one as it stands after a newline."""
        after = len(self.sp.encode("\n"))
        bare = [u[0] != " " for u in units]
        # the library puts a space in front, except of the empty text
        ids = self.sp.encode(["\n" + u if b else u[1:] for u, b in zip(units, bare, strict=True)], num_threads=1)
        return [len(x) - after if b else len(x) if len(u) > 1 else 1 for u, b, x in zip(units, bare, ids, strict=True)]

    def __call__(self, texts: list[str]) -> list[int]:
        texts = [" " + t.replace(SPACE, " ") if t else t for t in texts]
        units = [self.units(t) for t in texts]
        if len(self.memo) > len(self.whole) + MEMO_UNITS:
            self.memo = dict(self.whole)
        memo = self.memo
        rest = [u for u in set(chain.from_iterable(units)) if u not in memo]
        if rest:
            memo.update(zip(rest, self.merge(rest), strict=True))
        counts = [sum(map(memo.__getitem__, u)) + (t.count("\n") * self.newline if self.lines_apart else 0) for t, u in zip(texts, units, strict=True)]
        for u in rest:
            if len(u) > 64:
                del memo[u]
        return counts


@functools.lru_cache(2)
def counter(model_path: str) -> Counter:
    return Counter(model_path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text; one pass over the table, no shuffle.

    Nulls and empty texts have 0 of both. A null id, repeated rows and very long texts are
    counted like any others; an empty table gives no rows.
    """

    def per_texts():
        count = counter(model_path)
        return lambda texts: list(zip((len(t.encode()) for t in texts), count(texts), strict=True))

    return map_text(docs, per_texts, "n_bytes long, n_tokens long", id_col, text_col).withColumn("over_limit", F.col("n_tokens") > limit)
