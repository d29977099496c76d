"""Operator 6: quality by supervised subword embeddings: learned vectors of
hashed words and character n-grams, averaged over a document, with a softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textfeatures as tf
from .labelled import fold, training_sample

#: Feature of a word that equals the word before it, as a word of its own.
_SAME = np.uint64(0x5A17)


@dataclass(frozen=True)
class Params:
    """per_class bounds the training sample (rows of each class)."""

    sizes: tuple[int, ...] = (2, 3, 4)
    bits: int = 18
    dim: int = 12
    per_class: int = 2500
    epochs: int = 6
    rate: float = 2.0
    seed: int = 7


def buckets(text: str, p: Params) -> np.ndarray:
    """Buckets of all words, word repeats and character n-grams of a text."""
    c = tf.code_points(text)
    w = tf.words(c)
    same = np.full(int((w[1:] == w[:-1]).sum()), _SAME, np.uint64) if len(w) > 1 else w[:0]
    return np.concatenate([tf.mixed(np.concatenate([w, same]), p.bits), tf.char_ngrams(c, p.sizes, p.bits)])


def fit(texts: list[str], y: np.ndarray, totals: dict[int, int], p: Params) -> tuple[np.ndarray, float]:
    """One number for each bucket (its vector times the difference of the two
    output rows) and an intercept; a document's logit is the intercept plus the
    mean of its buckets' numbers.

    Plain SGD, a document a step, the classes taken alternately; the intercept
    then puts back the labels' own class rate.
    """
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not len(texts) or y.min() == y.max():
        return np.zeros(1 << p.bits, np.float32), prior
    rng = np.random.default_rng(p.seed)
    vec = rng.uniform(-1 / p.dim, 1 / p.dim, (1 << p.bits, p.dim)).astype(np.float32)
    out = rng.uniform(-0.1, 0.1, (2, p.dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    docs = []  # 8 bytes a distinct feature, in few arrays, which go back to the system whole
    for low in range(0, len(texts), 500):
        some = [np.unique(buckets(t, p), return_counts=True) for t in texts[low: low + 500]]
        u, s = np.concatenate([x for x, _ in some]).astype(np.int32), np.concatenate([n / max(1, n.sum()) for _, n in some]).astype(np.float32)
        ends = np.cumsum([0] + [len(x) for x, _ in some])
        docs += [(u[a:b], s[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        del some
    ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    steps = 2 * max(len(ones), len(zeros))
    for epoch in range(p.epochs):
        a, b = rng.permutation(np.resize(ones, steps // 2)), rng.permutation(np.resize(zeros, steps // 2))
        order = np.stack([a, b], 1).ravel()
        for k, i in enumerate(order):
            rate = np.float32(p.rate * (1 - (epoch * steps + k) / (p.epochs * steps)))
            u, s = docs[i]
            hidden = s @ vec[u] if len(u) else np.zeros(p.dim, np.float32)
            z = out @ hidden + bias
            z = np.exp(z - z.max())
            g = z / z.sum()
            g[y[i]] -= 1
            back = g @ out
            out -= rate * np.float32(0.1) * np.outer(g, hidden)
            bias -= rate * np.float32(0.01) * g
            if len(u):
                vec[u] -= rate * np.outer(s / s.max(), back) * np.float32(0.1)
    return (vec @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]) + prior


def scorer(spark: SparkSession, weights: np.ndarray, bias: float, p: Params):
    """A function of a text column: the score (0 to 1); null counts as empty."""
    model = spark.sparkContext.broadcast((weights, bias))

    def run(series: pd.Series) -> pd.Series:
        w, b = model.value
        out = np.empty(len(series))
        for i, text in enumerate(series):
            h = buckets(text or "", p)
            out[i] = b + (float(w[h].mean(dtype=np.float64)) if len(h) else 0.0)
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return F.pandas_udf(run, "double")


def model(docs: DataFrame, labels: DataFrame, p: Params = Params(), hold_mod: int = 5, hold_rest: int = 0):
    rows, totals = training_sample(docs, labels, "quality", hold_mod, hold_rest, p.per_class)
    return fit(list(rows["text"]), rows["y"].to_numpy(np.int64), totals, p)


def quality(docs: DataFrame, labels: DataFrame, p: Params = Params(), hold_mod: int = 5, hold_rest: int = 0, threshold: float = 0.3) -> DataFrame:
    """Every document's doc_id, held_out, score and predicted.

    Rows: one for each row of docs, repeated rows included. A null or empty text
    gets the intercept's score. A null doc_id is never held out. Other columns
    of either table are not read.
    """
    w, bias = model(docs, labels, p, hold_mod, hold_rest)
    score = scorer(docs.sparkSession, w, bias, p)(F.col("text"))
    return docs.select("doc_id", score.alias("score")).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), hold_mod) == hold_rest, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def kept(docs: DataFrame, labels: DataFrame, p: Params = Params(), threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier does not reject, columns as given.
    Null texts are scored as empty ones, repeated rows each for itself; an empty
    table gives no rows."""
    w, bias = model(docs, labels, p)
    return docs.where(scorer(docs.sparkSession, w, bias, p)(F.col("text")) >= threshold)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return quality(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/labels.parquet"))
