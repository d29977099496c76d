import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, textfeatures, toxicity
from tidemark.llm.labelled import training_sample


def _auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def _made(spark, n=400):
    rng = np.random.default_rng(0)
    plain = [f"{a}{b}" for a in ("ba", "lo", "mi", "tu") for b in ("ren", "sal", "dor", "kip")]
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(plain, 40))
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            w[int(rng.integers(40))] = f"zlurk{rng.choice(plain)}"
        docs.append((i, " ".join(x + "###" if bad else x for x in w), "clash"))
        labels.append((i, int(not bad), int(toxic), "clash"))
    docs += [(None, None, "x"), (n, "", "x"), (n + 1, "x" * 50_000, "x"), (3, docs[3][1], "x")]
    labels += [(None, 1, 1, "x"), (n, None, None, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize("name,mod,rest", [("toxic", 4, 2), ("quality", 5, 0)])
def test_held_out(spark, name, mod, rest):
    docs, labels = _made(spark)
    run = toxicity.toxicity if name == "toxic" else quality.quality
    got = run(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3).astype(int)).all()
    known = got.dropna(subset=["doc_id"])
    assert (known.held_out == [zlib.crc32(str(int(i)).encode()) % mod == rest for i in known.doc_id]).all()
    y = {r.doc_id: getattr(r, name) for r in labels.dropna().collect()}
    held = known[known.held_out & known.doc_id.isin(list(y))].drop_duplicates("doc_id")
    assert _auc(held.score.to_numpy(), held.doc_id.map(y).to_numpy()) > 0.95


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = _made(spark, 200)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxicity(docs, x).where("doc_id is not null").orderBy("doc_id", "score").toPandas() for x in (labels, turned))
    assert (a.score == b.score).all()


def test_sample_is_bounded(spark):
    docs, labels = _made(spark)
    rows, totals = training_sample(docs, labels, "toxic", 4, 2, 10)
    assert rows.groupby("y").size().max() <= 10 and totals[0] > 100 and totals[1] > 20


def test_empty_tables(spark):
    docs, labels = _made(spark, 10)
    none = docs.limit(0)
    assert toxicity.toxicity(none, labels).count() == 0 and quality.quality(none, labels).count() == 0
    got = toxicity.toxicity(docs, labels.limit(0)).toPandas()
    assert len(got) == docs.count() and got.score.nunique() == 1


def test_stage_keeps_columns(spark):
    docs, labels = _made(spark)
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_features():
    c = textfeatures.code_points("ab ab  c\tab")
    w = textfeatures.words(c)
    assert len(w) == 4 and w[0] == w[1] == w[3] != w[2]
    assert len(textfeatures.char_ngrams(c, (3, 4), 18)) == len(c) - 2 + len(c) - 3
    stamp = np.zeros(1 << 18, np.int32)
    h = textfeatures.char_ngrams(c, (2,), 18)
    assert sorted(textfeatures.first_of_each(h, stamp)) == sorted(set(h.tolist()))


def test_null_ids_beside_large_ones(spark):
    docs, labels = _made(spark, 60)
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "one two"), (None, "x"), (big + 2, None)], "doc_id long, text string").coalesce(1)
    for run in (toxicity.toxicity, quality.quality):
        assert {r.doc_id for r in run(df, labels).collect()} == {big, None, big + 2}


def test_scores_match_brute_force(spark):
    """Scores recomputed text by text with plain dictionaries of n-grams."""
    docs, labels = _made(spark, 150)
    p = toxicity.Params(bits=22, rounds=20)
    rows, totals = training_sample(docs, labels, "toxic", 4, 2, p.per_class)
    w, bias = toxicity.fit(list(rows["text"]), rows["y"].to_numpy(np.int64), totals, p)
    number = {}

    def grams(t):
        return {t[i: i + n] for n in p.sizes for i in range(len(t) - n + 1)}

    for t in rows["text"]:
        for g in grams(t.lower()):
            number[g] = int(textfeatures.char_ngrams(textfeatures.code_points(g), (len(g),), p.bits)[0])
    # log-count ratios by counting in how many texts of each class an n-gram is
    pos, neg = ({}, {})
    for t, y in zip(rows["text"], rows["y"]):
        for b in {number[g] for g in grams(t.lower())}:
            (pos if y else neg)[b] = (pos if y else neg).get(b, 0) + 1
    n1, n0 = int(rows["y"].sum()), int((1 - rows["y"]).sum())
    for b in np.flatnonzero(w):
        r = np.log((pos.get(b, 0) + 1) / (n1 + 2)) - np.log((neg.get(b, 0) + 1) / (n0 + 2))
        assert abs(r) >= p.least_ratio and pos.get(b, 0) + neg.get(b, 0) >= p.least_docs
    got = {(r.doc_id, r.score) for r in toxicity.scored(docs, w, bias, p).collect()}
    for r in docs.collect():
        t = (r.text or "").lower()
        z = bias + sum(float(w[b]) for b in {number.get(g, int(textfeatures.char_ngrams(textfeatures.code_points(g), (len(g),), p.bits)[0])) for g in grams(t)})
        want = 1 / (1 + np.exp(-z))
        assert any(i == r.doc_id and s == pytest.approx(want, abs=1e-6) for i, s in got)


def test_quality_scores_match_brute_force(spark):
    docs, labels = _made(spark, 120)
    p = quality.Params(epochs=2)
    w, bias = quality.model(docs, labels, p)
    got = [(r.doc_id, r.score) for r in quality.quality(docs, labels, p).collect()]

    def one(t):
        c = textfeatures.code_points(t)
        words = [x for x in textfeatures.words(c)]
        b = [int(x) for x in textfeatures.mixed(np.array(words + [quality._SAME for x, y in zip(words, words[1:]) if x == y], np.uint64), p.bits)]
        for n in p.sizes:
            b += [int(textfeatures.char_ngrams(c[i: i + n], (n,), p.bits)[0]) for i in range(len(c) - n + 1)]
        z = bias + (sum(float(w[x]) for x in b) / len(b) if b else 0.0)
        return 1 / (1 + np.exp(-z))

    for r in docs.where("length(text) < 1000 or text is null").collect():
        want = one(r.text or "")
        assert any(i == r.doc_id and s == pytest.approx(want, abs=1e-5) for i, s in got)


def test_totals_of_many_label_values(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4) for i in range(400)], "doc_id long, toxic int")
    _, totals = training_sample(docs, labels, "toxic", 5, 0, 10)
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 0]
    assert totals == {0: sum(i % 4 == 0 for i in train), 1: sum(i % 4 > 0 for i in train)}
