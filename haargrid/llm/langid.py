"""Language identification by a byte convolutional network in numpy.

Bytes are embedded; filters of several widths slide over a window of fixed length; each
filter's largest response goes to a softmax over the languages. The network is trained on
the driver on windows of a bounded sample of labelled texts; its few thousand weights go along
with the tasks. For prediction, embedding and
filters collapse into tables by byte pair, so a filter's response is a sum of looked-up
rows; all windows of a text are scored, and their probabilities averaged by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haargrid.llm.rows import map_text, slices, small_batches

#: Bytes of a window, widths of the filters, filters of each width, size of an embedding.
WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: Bounds of the training sample: texts of each language, windows of each text, languages (the most frequent).
TEXTS, WINDOWS, LANGUAGES = 400, 3, 100
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # by width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """By width: response rows by pair (65536) or byte (256)."""
        pairs = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        out = {}
        for w, f in self.filters.items():
            one = [self.embedding @ f[i * EMBED : (i + 1) * EMBED] for i in range(w)]
            out[w] = [pairs(one[0], one[1])] + ([one[2]] if w == 3 else [pairs(one[2], one[3])] if w == 4 else [])
        return out

    def probabilities(self, windows: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Softmax for each row of (n, WINDOW) bytes."""
        n, size = windows.shape
        x = windows.astype(np.int32)
        pair = x[:, :-1] << 8 | x[:, 1:]
        pooled = np.empty((n, len(tables) * FILTERS), np.float32)
        for k, (w, parts) in enumerate(tables.items()):
            m = size - w + 1
            r = parts[0][pair[:, :m]]
            if w == 3:
                r += parts[1][x[:, 2:]]
            elif w == 4:
                r += parts[1][pair[:, 2:]]
            pooled[:, k * FILTERS : (k + 1) * FILTERS] = r.max(1)
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(texts: list[str], languages: list[str], steps: int = 400, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> Model:
    """Adam on the cross-entropy of windows, each language weighted alike. Deterministic."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    raw = [t.encode()[:WINDOW] for t in texts]
    x = np.frombuffer(b"".join(r.ljust(WINDOW, b"\0") for r in raw), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(names, languages)
    of = [np.flatnonzero(y == c) for c in range(len(names))]
    p = {"e": rng.normal(0, 0.5, (256, EMBED)), "v": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(names))), "c": np.zeros(len(names)), "b": np.zeros(len(WIDTHS) * FILTERS)}
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(of[c]) for c in rng.integers(0, len(names), batch)])
        xb, yb = x[pick], y[pick]
        e = p["e"][xb]
        cols, hits, pooled = {}, {}, []
        for w in WIDTHS:
            m = WINDOW - w + 1
            cols[w] = np.concatenate([e[:, i : i + m] for i in range(w)], 2)
            r = cols[w] @ p[f"w{w}"]
            hits[w] = r.argmax(1)
            pooled.append(np.take_along_axis(r, hits[w][:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1) + p["b"]
        a = np.maximum(h, 0)
        z = a @ p["v"] + p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(batch), yb] -= 1
        z /= batch
        g = {"v": a.T @ z, "c": z.sum(0)}
        dh = (z @ p["v"].T) * (h > 0)
        g["b"] = dh.sum(0)
        ge = np.zeros_like(p["e"])
        row = np.arange(batch)[:, None]
        for k, w in enumerate(WIDTHS):
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            seen = cols[w][row, hits[w]]  # (batch, filter, w * EMBED): what each filter's largest response saw
            g[f"w{w}"] = np.einsum("bf,bfc->cf", d, seen)
            back = (d[:, :, None] * p[f"w{w}"].T[None]).reshape(batch, FILTERS, w, EMBED)
            for i in range(w):
                np.add.at(ge, xb[row, hits[w] + i].ravel(), back[:, :, i].reshape(-1, EMBED))
        g["e"] = ge
        for k, v in p.items():
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.001 * (g[k] ** 2 - second[k])
            v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(names, p["e"], {w: p[f"w{w}"] for w in WIDTHS}, p["b"], p["v"], p["c"])


def sample(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = TEXTS) -> tuple[list[str], list[str]]:
    """Windows of about ``texts`` texts of each language, at places that follow from the id.

    At most 2 * TEXTS * WINDOWS * LANGUAGES short strings reach the driver.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    counts = {r.l: r["count"] for r in rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()}
    if not counts:
        return [], []
    dice = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, int(min(1.0, texts / n) * (1 << 30)))])
    start = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.pmod(F.xxhash64("id", i), F.greatest(F.length("t") - WINDOW, F.lit(0)) + 1))
    picked = (
        rows.filter(F.col("l").isin(*counts) & (dice <= share[F.col("l")]))
        .select("id", "l", F.transform(start, lambda s: F.substr(F.col("t"), (s + 1).cast("int"), F.lit(WINDOW))).alias("w"))
        .limit(2 * texts * len(counts))
        .collect()
    )
    picked.sort(key=lambda r: (str(r.id), r.l, r.w))
    flat = [(w, r.l) for r in picked for w in dict.fromkeys(r.w) if w]
    return [w for w, _ in flat], [lang for _, lang in flat]


def _predictor(m: Model):
    """The function from a list of texts to (language, mean probability)."""
    tables = m.tables()

    def f(texts: list[str]) -> list[tuple]:
        raw = [t.encode() for t in texts]
        sizes = [-(-max(len(r), 1) // WINDOW) for r in raw]
        flat = np.frombuffer(b"".join(r.ljust(n * WINDOW, b"\0") for r, n in zip(raw, sizes, strict=True)), np.uint8).reshape(-1, WINDOW)
        probs = np.concatenate([m.probabilities(flat[i : i + 64], tables) for i in range(0, len(flat), 64)])
        weight = np.full(len(flat), WINDOW, np.float64)
        ends = np.cumsum(sizes)
        weight[ends - 1] = [max(len(r), 1) - (n - 1) * WINDOW for r, n in zip(raw, sizes, strict=True)]
        total = np.add.reduceat(probs * weight[:, None], ends - sizes) / np.add.reduceat(weight, ends - sizes)[:, None]
        best = total.argmax(1)
        return [(m.languages[c], min(1.0, float(row[c]))) if t else (UNKNOWN, 0.0) for t, c, row in zip(texts, best.tolist(), total, strict=True)]

    return f


def _lettered(text_col: str):
    """The text if it has a letter, else null."""
    return F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language and score (its mean probability) of every whole text: one pass, no shuffle.

    A text that is null or has no letter is ``und`` with score 0, as is every text without a model.
    """
    if model is None:
        return docs.select(id_col, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return map_text(docs.select(id_col, _lettered(text_col).alias(text_col)), lambda: _predictor(model), "lang_pred string, score double", id_col, text_col)


def accepted(docs: DataFrame, least: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is known with a score of ``least`` or more; learns as ``identify`` does.

    Null and empty texts and those without a letter go. A row without an id or a label is judged like
    others; repeated rows stay repeated. Without a labelled row to learn from, all rows with a letter stay.
    """
    texts, languages = sample(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    if not texts:
        return docs.filter(_lettered(text_col).isNotNull())
    model = train(texts, languages)

    @F.pandas_udf("double")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = _predictor(model)
        for column in columns:
            texts = pa.array(column, pa.string())
            yield pd.Series([s for a, b in slices(texts) for _, s in f([t or "" for t in texts.slice(a, b - a).to_pylist()])], dtype="float64")

    return small_batches(docs).filter(score(_lettered(text_col)) >= least)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether a row is kept from learning, by its id; null for a row without an id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the labelled rows that aren't held out, and predicts all rows.

    Without a labelled row with letters every text is ``und``. A row without an id is
    never learned from and counts as not held out.
    """
    texts, languages = sample(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    out = predict(docs, train(texts, languages) if texts else None, id_col, text_col)
    return out.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "lang_pred", "score")
