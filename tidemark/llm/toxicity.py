"""Operator 1: toxicity by a linear classifier over character n-grams whose
features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textfeatures as tf
from .common import as_long, as_text
from .labelled import fold, training_sample


@dataclass(frozen=True)
class Params:
    """per_class bounds the training sample (rows of each class). N-grams in
    under least_docs of its texts, or whose log-count ratio is within
    least_ratio of 0, are left out."""

    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 20
    per_class: int = 2000
    smooth: float = 1.0
    least_docs: int = 3
    least_ratio: float = 0.7
    l2: float = 1e-4
    rounds: int = 50
    rate: float = 0.05


def buckets(text: str, p: Params, stamp: np.ndarray) -> np.ndarray:
    return tf.first_of_each(tf.char_ngrams(tf.code_points(text.lower()), p.sizes, p.bits), stamp)


def fit(texts: list[str], y: np.ndarray, totals: dict[int, int], p: Params) -> tuple[np.ndarray, float]:
    """Weights by bucket, already times the log-count ratios, and intercept.

    Rows are weighted so that each class counts as often as in all training
    labels, so scores are probabilities at the labels' own rate. With one class
    or no rows the weights are zero and the intercept is the smoothed rate.
    """
    size = 1 << p.bits
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not len(texts) or y.min() == y.max():
        return np.zeros(size, np.float32), prior
    stamp = np.zeros(size, np.int32)
    rows = [buckets(t, p, stamp).astype(np.int32) for t in texts]
    pos = np.bincount(np.concatenate([r for r, v in zip(rows, y) if v] or [np.zeros(0, int)]), minlength=size)
    neg = np.bincount(np.concatenate([r for r, v in zip(rows, y) if not v] or [np.zeros(0, int)]), minlength=size)
    keep = pos + neg >= p.least_docs
    a, b = pos + p.smooth, neg + p.smooth
    ratio = np.log(a / (y.sum() + 2 * p.smooth)) - np.log(b / ((1 - y).sum() + 2 * p.smooth))
    keep &= np.abs(ratio) >= p.least_ratio
    ratio = np.where(keep, ratio, 0.0)
    rows = [r[keep[r]] for r in rows]
    lens = np.array([len(r) for r in rows])
    idx = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), lens)
    share = np.where(y == 1, n1 / max(1, y.sum()), n0 / max(1, (1 - y).sum()))
    share = share / share.sum()
    w, bias = np.zeros(size), prior
    m1, m2, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, p.rounds + 1):  # Adam over the whole bounded sample
        z = bias + np.bincount(owner, weights=(w * ratio)[idx], minlength=len(rows))
        g = share * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        gw = np.bincount(idx, weights=g[owner], minlength=size) * ratio + p.l2 * w
        gb = g.sum()
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        k1, k2 = 1 - 0.9**t, 1 - 0.99**t
        w -= p.rate * (m1 / k1) / (np.sqrt(m2 / k2) + 1e-8)
        bias -= p.rate * (mb / k1) / (np.sqrt(vb / k2) + 1e-8)
    return (w * ratio).astype(np.float32), float(bias)


def scored(docs: DataFrame, weights: np.ndarray, bias: float, p: Params) -> DataFrame:
    """(doc_id, score) of every row of docs; null texts count as empty."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((weights, bias))

    def run(batches):
        w, b = model.value
        used, stamp = w != 0, np.zeros(1 << p.bits, np.int32)
        for pdf in batches:
            out = np.empty(len(pdf))
            for i, text in enumerate(pdf["text"]):
                h = tf.char_ngrams(tf.code_points((text or "").lower()), p.sizes, p.bits)
                h = tf.first_of_each(h[used[h]], stamp)
                out[i] = b + float(w[h].sum(dtype=np.float64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": 1 / (1 + np.exp(-np.clip(out, -35, 35)))})

    return as_long(docs.select(as_text("doc_id"), "text").mapInPandas(run, "doc_id string, score double"), "doc_id")


def toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params(), hold_mod: int = 4, hold_rest: int = 2, threshold: float = 0.3) -> DataFrame:
    """Every document's doc_id, held_out, score and predicted.

    Rows: one for each row of docs, repeated rows included. Null or empty texts
    get the score of a text without n-grams. A null doc_id is never held out.
    Other columns of either table, whatever their names, are not read.
    """
    rows, totals = training_sample(docs, labels, "toxic", hold_mod, hold_rest, p.per_class)
    w, bias = fit(list(rows["text"]), rows["y"].to_numpy(np.int64), totals, p)
    return scored(docs, w, bias, p).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), hold_mod) == hold_rest, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return toxicity(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/labels.parquet"))
