"""Operator 5: quality rules as weak supervision. Rules vote or abstain,
expectation-maximisation estimates how often each is right, and the posterior
probability of quality decides, not the passing of every rule."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, as_text, written

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space to str.split() that does not end a word here.
_OTHER_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
SYMBOLS = "#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_alpha")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, n)
    k = len(number)
    pair = w[:-1] * k + w[1:]
    _, pair = np.unique(pair, return_inverse=True)
    _, back, times = np.unique(pair[:-1] * k + w[2:], return_inverse=True, return_counts=True)
    hit = times[back] > 1
    inside = np.zeros(n, bool)
    for j in range(3):
        inside[j: n - 2 + j] |= hit
    return int(inside.sum())


def counts_of(text: str) -> tuple[int, ...]:
    words = words_of(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    chars = "".join(words)
    return (
        len(words), len(chars), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), sum(map(str.isupper, words)), sum(map(str.isalpha, words)),
    )


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row's whole text (null: no words)."""

    def run(batches):
        for pdf in batches:
            got = pd.DataFrame([counts_of(t or "") for t in pdf["text"]], columns=list(_COUNTS))
            got.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield got

    return as_long(docs.select(as_text("doc_id"), "text").mapInPandas(run, "doc_id string, " + ", ".join(f"{c} long" for c in _COUNTS)), "doc_id")


def _share(a: str, b: str):
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


#: name -> (counts whose quotient is the figure, good where, bad where); no vote where neither holds or the
#: figure is undefined.
RULES = {
    "word_length": (("word_chars", "n_words"), lambda x: x.between(2.5, 12), lambda x: (x < 2) | (x > 20)),
    "symbols": (("n_symbols", "n_words"), lambda x: x <= 0.05, lambda x: x > 0.2),
    "dup_lines": (("n_dup_lines", "n_lines"), lambda x: x <= 0.15, lambda x: x > 0.4),
    "repeats": (("n_repeat_words", "n_words"), lambda x: x <= 0.2, lambda x: x > 0.35),
    "capitals": (("n_upper", "n_words"), lambda x: x <= 0.15, lambda x: x > 0.4),
    "letters": (("n_alpha", "n_words"), lambda x: x >= 0.6, lambda x: x < 0.3),
}


def votes(stats: DataFrame) -> DataFrame:
    """stats plus a vote of each rule: 1 good, -1 bad, 0 none."""
    return stats.select("*", *(
        F.when(good(x), 1).when(bad(x), -1).otherwise(0).alias(f"v_{name}")
        for name, (pair, good, bad) in RULES.items() for x in [_share(*pair)]
    ))


def accuracies(patterns: np.ndarray, times: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Each rule's chance of each vote (axis 2: bad, none, good) in bad and in
    good documents (axis 0), and the share of good ones, by
    expectation-maximisation over the vote patterns' counts.

    Rules are taken as independent given the class. The start, documents with a
    bad vote likely bad and the others likely good, names the classes; a rule
    whose bad vote comes to speak for good is held at no evidence, so the
    classes cannot change places.
    """
    one_hot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(np.float64)
    good = np.where((patterns == -1).any(axis=1), 0.1, 0.95) if len(times) else np.zeros(0)
    chance, share = np.full((2, patterns.shape[1], 3), 1 / 3), 0.5
    for _ in range(rounds if len(times) else 0):
        weight = np.stack([times * (1 - good), times * good])
        new = np.einsum("cp,pjv->cjv", weight, one_hot) + 0.1
        new /= new.sum(axis=2, keepdims=True)
        wrong = new[0, :, 0] < new[1, :, 0]
        new[:, wrong] = new[:, wrong].mean(axis=0)
        share = float(np.clip((times @ good + 1) / (times.sum() + 2), 0.01, 0.99))
        moved = np.abs(new - chance).max()
        chance = new
        z = np.log(share / (1 - share)) + np.einsum("pjv,jv->p", one_hot, np.log(chance[1] / chance[0]))
        good = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        if moved < 1e-9:
            break
    return chance, share


def based(stats: DataFrame) -> DataFrame:
    """stats plus base_failed: too few words, or over half of them repeated."""
    return stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, votes, posterior and verdict of every row of docs.

    Counts and patterns cover all rows; at most 3 to the number of rules
    patterns reach the driver. Null and empty texts have no words and fail the
    base rules; repeated rows are judged each for itself; an empty table gives
    no rows. Columns other than doc_id and text are not read.
    """
    stats = votes(written(counted(docs), "counts"))
    names = [f"v_{n}" for n in RULES]
    seen = stats.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).toPandas()
    chance, share = accuracies(seen[names].to_numpy(np.float64).reshape(-1, len(names)), seen["n"].to_numpy(np.float64))
    logit = F.lit(float(np.log(share / (1 - share))))
    for n, (bad, none, good) in zip(names, np.log(chance[1] / chance[0]).tolist()):
        logit = logit + F.when(F.col(n) == 1, good).when(F.col(n) == -1, bad).otherwise(none)
    posterior = 1 / (1 + F.exp(-logit))
    return based(stats).withColumn("posterior", posterior).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)
    )


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", *BASE, "base_failed", "kept", "posterior"
    )


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and rules of every document, without votes."""
    return based(counted(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", *BASE, "base_failed")
