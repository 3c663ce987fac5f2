"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, word pairs and pairs with one or two words between, in a
table of ``2**bits`` weights.  FTRL-proximal learns them online with a rate for each coordinate; its L1 term leaves most
of them zero, so the model that goes to the executors is small, and never larger than the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import frugal, ship


@dataclass(frozen=True)
class Model:
    """The non-zero weights; ``rows``: how many rows taught them."""

    bits: int
    ids: np.ndarray
    weights: np.ndarray
    bias: float
    rows: int


def features(data: np.ndarray, offsets: np.ndarray, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) pairs of some texts, ordered by text, each pair once; only features that are true in ``wanted``, if given."""
    _, h, of = tx.words(data, offsets, tx.tables(lower=True, letters_only=True))
    c = tx.constants(4, 211)
    keys = []

    def add(hashes: np.ndarray, text: np.ndarray) -> None:
        ids = tx.mix(hashes) >> np.uint64(64 - bits)
        if wanted is not None:
            keep = wanted[ids.astype(np.int64)]
            ids, text = ids[keep], text[keep]
        keys.append(text.astype(np.uint64) << np.uint64(bits) | ids)

    add(h ^ c[0], of)
    for gap in (1, 2, 3):
        if len(h) > gap:
            same = np.flatnonzero(of[:-gap] == of[gap:])
            add(h[same] * c[0] + h[same + gap] * c[gap], of[same])
    key = np.unique(np.concatenate(keys))
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), (key >> np.uint64(bits)).astype(np.int64)


def ftrl(samples: list[np.ndarray], labels: np.ndarray, bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, float]:
    """(weights, bias) after ``epochs`` passes over the samples, each an array of feature ids; the bias has no penalty."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    rate = min(max(float(labels.mean()), 1e-3), 1 - 1e-3) if len(labels) else 0.5
    bias, bias_n = float(np.log(rate / (1 - rate))), 1.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for ids, y in zip(samples, labels.tolist()):
            zi, ni = z[ids], n[ids]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-min(35.0, max(-35.0, float(w.sum()) + bias))))
            g = p - y
            if abs(g) < 1e-4:
                continue
            more = ni + g * g
            z[ids] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[ids] = more
            bias_n += g * g
            bias -= alpha / (beta + np.sqrt(bias_n)) * g
    return weights(z, n), bias


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The score over which a row had best count as label 1, by F1; 0 if all labels are equal."""
    if not len(labels) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + labels.sum())
    f1[:-1][s[1:] == s[:-1]] = -1  # a cut falls between different scores
    i = int(f1.argmax())
    return float((s[i] + s[min(i + 1, len(s) - 1)]) / 2)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 16_000, bits: int = 20, alpha: float = 2.0, beta: float = 1.0, l1: float | None = None, l2: float = 1.0, epochs: int = 4) -> Model:
    """Learn from at most ``max_rows`` labelled rows, those whose hashed id comes first; one task streams them.

    Seven eighths of the rows teach the weights; the others set the bias, so that 0.5 is the probability over which
    their F1 is best.  ``l1`` is by default a 1600th of the rows, between 1 and 10.

    Ids that ``labels`` repeats count by their largest label.  Null ids, null labels and labels without a document teach
    nothing.  Without any row the model is empty and scores 0.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = known.join(d.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(*order).limit(max_rows)
    sample = d.join(F.broadcast(taken), "doc_id").select("doc_id", "text", "y").repartition(1).sortWithinPartitions(*order, "text")

    @frugal
    def fit(batches):
        samples, ys = [], []
        for batch in batches:
            data, offsets = tx.buffers(batch.column("text"))
            ys.append(batch.column("y").to_numpy())
            for i, j in tx.chunks(offsets):
                at = offsets[i : j + 1]
                ids, of = features(data[at[0] : at[-1]], at - at[0], bits)
                samples += np.split(ids.astype(np.uint32), np.searchsorted(of, np.arange(1, j - i)))
        y = np.concatenate(ys) if ys else np.zeros(0)
        m = len(y) - len(y) // 8
        penalty = min(10.0, max(1.0, len(y) / 1600)) if l1 is None else l1
        w, bias = ftrl(samples[:m], y[:m], bits, alpha, beta, penalty, l2, epochs)
        bias -= best_cut(np.array([w[x].sum() + bias for x in samples[m:]]), y[m:])
        ids = np.flatnonzero(w)
        yield pa.record_batch([pa.array([ids.astype("<u4").tobytes()], pa.binary()), pa.array([w[ids].astype("<f8").tobytes()], pa.binary()), pa.array([bias], pa.float64()), pa.array([len(y)], pa.int64())], ["ids", "weights", "bias", "rows"])

    got = [r for r in sample.mapInArrow(fit, "ids binary, weights binary, bias double, rows long").collect() if r.rows]
    if not got:
        return Model(bits, np.zeros(0, np.uint32), np.zeros(0), -np.inf, 0)
    r = got[0]
    return Model(bits, np.frombuffer(r.ids, "<u4"), np.frombuffer(r.weights, "<f8"), r.bias, r.rows)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic in ``out_col``; a null text scores as an empty one.

    Only the text goes to Python, in Arrow batches, and only the score comes back.  An empty table gives an empty result.
    ``out_col`` replaces a column of that name; all other columns stay.
    """

    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.zeros(1 << model.bits, np.float64)
        table[model.ids] = model.weights
        wanted = table != 0
        for batch in batches:
            data, offsets = tx.buffers(batch)
            out = np.zeros(len(batch))
            for i, j in tx.chunks(offsets):
                at = offsets[i : j + 1]
                ids, of = features(data[at[0] : at[-1]], at - at[0], model.bits, wanted)
                out[i:j] = np.bincount(of, table[ids], minlength=j - i)
            with np.errstate(over="ignore"):
                yield pa.array(1 / (1 + np.exp(-(out + model.bias))))

    scored = F.arrow_udf(run, "double")(F.col(f"`{text_col}`").cast("string"))
    return docs.withColumn(out_col, scored)


ship(__name__)
