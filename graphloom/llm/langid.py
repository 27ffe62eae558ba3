"""Language identification with a byte convolutional network in numpy.

A text is lower-cased, everything in ASCII but letters becomes white space,
and its UTF-8 bytes are laid into windows of ``WINDOW`` bytes.  Bytes are
embedded, filters of several widths slide over them, the largest response of
each filter over a window goes through a rectifier to a softmax.  A text's
probabilities are the mean over all its windows, weighted by their letters;
no part of a text is left out.

The network is trained by Adam on a bounded sample of labelled rows
(``SAMPLE_TEXTS`` stretches of ``STRETCH`` characters for each language),
chosen by hash.  It is some tens of kilobytes and travels with the tasks.

Nulls and edge cases: a null text or one without a letter is ``und`` with
score 0; rows without a language are not learned from; with no learned
language every text is ``und``; null ids count as not held out; repeated
rows are scored alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import crc_mod, documents, gathered

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Bound of the training sample: texts of each language, and characters of each.
SAMPLE_TEXTS = 600
STRETCH = 320
EPOCHS = 10
UNKNOWN = "und"
#: ASCII without letters, as white space.
_PLAIN = bytes(k if k >= 128 or chr(k).isalpha() else 32 for k in range(256))


def clean(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split())


def windows(data: bytes) -> np.ndarray:
    """All of ``data`` in rows of WINDOW bytes, the last filled with spaces."""
    return np.frombuffer(data.ljust(-(-max(1, len(data)) // WINDOW) * WINDOW), dtype=np.uint8).reshape(-1, WINDOW)


@dataclass
class ByteNetwork:
    labels: list[str]
    embedding: np.ndarray
    filters: np.ndarray  # (widest * EMBEDDING, all filters), zero beyond a filter's width
    shift: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    @staticmethod
    def new(labels: list[str], seed: int = 7) -> "ByteNetwork":
        rng, n, wide = np.random.default_rng(seed), len(WIDTHS) * FILTERS, max(WIDTHS)
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return ByteNetwork(labels, f(256, EMBEDDING, scale=0.5), f(wide * EMBEDDING, n, scale=0.25) * ByteNetwork.mask(), np.zeros(n, np.float32), f(n, len(labels), scale=0.2), np.zeros(len(labels), np.float32))

    @staticmethod
    def mask() -> np.ndarray:
        wide = max(WIDTHS)
        return np.concatenate([np.repeat((np.arange(wide * EMBEDDING) < w * EMBEDDING).astype(np.float32)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1)

    def columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, widest * EMBEDDING) of embedded bytes."""
        e = self.embedding[x]
        n, size, d = e.shape
        wide = max(WIDTHS)
        view = np.lib.stride_tricks.as_strided(e, (n, size - wide + 1, wide * d), (e.strides[0], e.strides[1], e.strides[2]))
        return np.ascontiguousarray(view)

    def pooled(self, x: np.ndarray, where: bool = False):
        cols = self.columns(x)
        y = (cols.reshape(-1, cols.shape[2]) @ self.filters).reshape(*cols.shape[:2], -1)
        if not where:
            return y.max(axis=1)
        at = y.argmax(axis=1)
        return np.take_along_axis(y, at[:, None, :], axis=1)[:, 0], at, cols

    def top(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.shift, 0) @ self.dense + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.top(self.pooled(x[k : k + 64])) for k in range(0, len(x), 64)])

    def step(self, x: np.ndarray, y: np.ndarray, moments: dict, t: int, rate: float) -> None:
        pooled, at, cols = self.pooled(x, where=True)
        p = self.top(pooled)
        hidden = np.maximum(pooled + self.shift, 0)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.dense.T) * (hidden > 0)
        chosen = np.take_along_axis(cols, at[:, :, None], axis=1)  # (windows, filters, widest * EMBEDDING)
        g_filters = np.einsum("nfk,nf->kf", chosen, back) * self.mask()
        g_bytes = (back[:, :, None] * self.filters.T[None]).reshape(len(x), at.shape[1], max(WIDTHS), EMBEDDING)
        g_embedding = np.zeros_like(self.embedding)
        spots = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))]
        np.add.at(g_embedding, spots.reshape(-1), g_bytes.reshape(-1, EMBEDDING))
        for name, g in (("embedding", g_embedding), ("filters", g_filters), ("shift", back.sum(0)), ("dense", hidden.T @ p), ("bias", p.sum(0))):
            m, v = moments.setdefault(name, [np.zeros_like(g), np.zeros_like(g)])
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            getattr(self, name)[...] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def train(texts: list[str], labels: list[str], seed: int = 7) -> ByteNetwork | None:
    """Fit on short and long windows of labelled texts."""
    names = sorted(set(labels))
    if not names:
        return None
    rng, xs, ys = np.random.default_rng(seed), [], []
    for text, label in zip(texts, labels):
        data = clean(text)
        if not data:
            continue
        for size in (WINDOW, 64, 24):  # a text may be a word
            first = int(rng.integers(0, max(1, len(data) - size)))
            xs.append(windows(data[first : first + size])[0])
            ys.append(names.index(label))
    net = ByteNetwork.new(names, seed)
    if not xs or len(names) == 1:
        return net
    x, y, moments, t = np.stack(xs), np.array(ys), {}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for k in range(0, len(order), 64):
            t += 1
            net.step(x[order[k : k + 64]], y[order[k : k + 64]], moments, t, 0.006 * (1 - epoch / EPOCHS) + 0.0005)
    return net


def sample(docs: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(text, lang) of at most SAMPLE_TEXTS stretches a language among the rows that ``allowed`` admits."""
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), allowed.alias("allowed")).where("allowed AND lang IS NOT NULL AND text IS NOT NULL")
    counts = own.groupBy("lang").agg(F.count("*").alias("n"))
    space = 1 << 24
    draw = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(space))
    # thin by hash first: what is ordered below is bounded too
    thin = own.join(F.broadcast(counts) if counts.limit(2000).count() < 2000 else counts, "lang").where(draw < F.lit(2.0 * SAMPLE_TEXTS * space) / F.col("n"))
    first = F.pmod(F.xxhash64("id", F.lit("first")), F.greatest(F.lit(1), F.length("text") - STRETCH)) + 1
    cut = thin.select(F.col("text").substr(first.cast("int"), F.lit(STRETCH)).alias("text"), "lang", draw.alias("draw"), "id")
    return cut.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))).where(F.col("k") <= SAMPLE_TEXTS).orderBy("lang", "k").select("text", "lang")


def fit(docs: DataFrame, allowed=None, **columns) -> ByteNetwork | None:
    rows = sample(docs, F.lit(True) if allowed is None else allowed, **columns).collect()
    return train([r.text for r in rows], [r.lang for r in rows])


def _score(net: ByteNetwork | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [j for j, t in enumerate(texts) if t and net is not None and any(map(str.isalpha, t))]
    if known:
        laid = [windows(clean(texts[j])) for j in known]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in laid])[:-1]])
        x = np.concatenate(laid)
        weight = (x != 32).sum(axis=1).astype(np.float64) + 1e-6
        p = np.add.reduceat(net.probabilities(x) * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
        for j, row in zip(known, p):
            names[j], scores[j] = net.labels[int(row.argmax())], float(min(1.0, row.max()))
    return names, scores


def identify(docs: DataFrame, net: ByteNetwork | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__lang`` and ``__score``; rows never leave their tasks."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                names, scores = _score(net, part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names), pa.array(scores)], names=[*part.schema.names, "__lang", "__score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, net: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return identify(own, net).select("doc_id", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


#: A text whose likeliest language has less than this is no text in a learned language.
LEAST_SCORE = 0.5


def keep_identified(docs: DataFrame, net: ByteNetwork | None, least: float = LEAST_SCORE) -> DataFrame:
    """Rows of ``docs`` in a learned language: ``und`` and what scores below ``least`` go.

    So null, empty and letterless texts go; repeated rows stay or go together; all columns stay as they are; of an empty table, or without a label to learn from, nothing is left.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                stays = [name != UNKNOWN and score >= least for name, score in zip(*_score(net, part.column(at).to_pylist()))]
                yield part.filter(pa.array(stays, pa.bool_()))

    return gathered(docs, docs).mapInArrow(run, docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    net = fit(docs, ~held_out)
    return predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
