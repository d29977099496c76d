import math

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def _docs(spark):
    rows = [(i, f"s{min(3, i % 9)}", "w " * (i % 11 + 1)) for i in range(900)]
    rows += [(2000, None, "a b c"), (2001, "s0", None), (2002, "s0", ""), (2003, "empty", ""), (5, "s3", "w " * 6), (None, "s1", "q q")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, weight int")


def _alpha(totals, fits, top):
    """Plain bisection of the exponent."""
    low, high = 0.0, top
    if fits(0.0):
        return 0.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def _copies(rows, places, p):
    """Copies of each row by brute force: whole passes of its source, then a
    prefix of the last pass's permutation, whose places are given."""
    tokens = [len((x or "").split()) for _, _, x in rows]
    t = {}
    for (_, s, _), n in zip(rows, tokens):
        t[s] = t.get(s, 0) + n
    t = {k: v for k, v in t.items() if v}
    total, most = sum(t.values()), max(t.values())

    def figures(a):
        z = sum((v / total) ** a for v in t.values())
        w = {k: (v / total) ** a / z for k, v in t.items()}
        budget = p.budget_tokens or most / max(w[k] for k in t if t[k] == most)
        return w, budget, -sum(x * math.log(x) for x in w.values() if x), max(w[k] * budget / t[k] for k in t)

    if p.entropy is not None:
        a = _alpha(t, lambda a: figures(a)[2] <= p.entropy, 16.0)
    else:
        a = _alpha(t, lambda a: figures(a)[3] <= p.max_repetition + 1e-12, 1.0)
    w, budget, _, _ = figures(a)
    out = [1] * len(rows)
    for s in t:
        passes = int(w[s] * budget / t[s] + 1e-6)
        rest = w[s] * budget - passes * t[s]
        at = sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: places(i, passes))
        before = 0
        for i in at:
            # a row is taken where the budget ends in its second half or later
            more = rest > 1e-3 * t[s] / len(at) and before + tokens[i] / 2 <= rest
            out[i] = passes + more
            before += tokens[i]
    return out, w


@pytest.mark.parametrize("p", [mixing.Params(max_repetition=1.3, block_rows=20), mixing.Params(max_repetition=2.0, block_rows=7), mixing.Params(max_repetition=None, entropy=0.9, block_rows=20), mixing.Params(budget_tokens=7777.0, block_rows=10)])
def test_copies_match_brute_force(spark, p):
    rows, df = _docs(spark)
    rows = [r for r in rows if r[2] and r[0] is not None]  # all have tokens and distinct (id, source)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    m = mixing.mixed(df, p).collect()
    copies = {(r.doc_id, r.source): r.mix_copies for r in m}
    most = max(copies.values()) + 1
    place = {
        (r.doc_id, r.source, e): r.p for e in range(most + 1)
        for r in df.select("doc_id", "source", mixing._position(F.col("doc_id"), F.col("text"), F.lit(e).cast("long"), p).alias("p")).collect()
    }
    want, w = _copies(rows, lambda i, e: place[(*rows[i][:2], e)], p)
    off = [(r, copies[r[:2]], n) for r, n in zip(rows, want) if copies[r[:2]] != n]
    assert len(off) <= len(w)  # the exponents differ by rounding: at most the edge row of a source
    assert {r.source: r.mix_weight for r in m} == pytest.approx(w, rel=1e-5)


def test_limits_that_cannot_be_met(spark):
    _, df = _docs(spark)
    with pytest.raises(ValueError):
        mixing.mixed(df, mixing.Params(budget_tokens=1e6, max_repetition=2.0))
    with pytest.raises(ValueError):
        mixing.mixed(spark.createDataFrame([(1, "a", "x y"), (2, "b", "x y")], df.select("doc_id", "source", "text").schema), mixing.Params(max_repetition=None, entropy=0.01))
    m = mixing.mixed(df, mixing.Params(max_repetition=None, entropy=50.0)).where("mix_weight > 0").toPandas()
    assert m.mix_weight.max() == pytest.approx(m.mix_weight.min())


def test_names_that_clash(spark):
    _, df = _docs(spark)
    more = df.selectExpr("*", "7 as mix_copies", "8 as key", "9 as passes", "10 as last", "11 as _mix_key", "12 as epoch", "13 as position", "14 as row")
    a, b = mixing.mixed(df), mixing.mixed(more)
    assert sorted(r.mix_copies for r in a.collect()) == sorted(r.mix_copies for r in b.collect()) and "_mix_key" in b.columns
    out = mixing.realised(more)
    assert out.columns == more.columns and out.where("mix_copies = 7 and position = 13").count() == out.count()


def test_order_of_passes(spark):
    _, df = _docs(spark)
    p = mixing.Params(max_repetition=2.0)
    rows = mixing.realised(df, p).coalesce(1).collect()
    first = rows[: df.count()]
    seen = [r.source for r in first]
    assert sorted(map(str, first)) == sorted(map(str, df.collect()))  # the first pass has every row once
    assert len(set(seen[:40])) > 2  # sources alternate


@pytest.mark.parametrize("limit", [1.3, 2.0, 50.0])
def test_repetition(spark, limit):
    rows, df = _docs(spark)
    p = mixing.Params(max_repetition=limit, block_rows=20)
    m = mixing.mixed(df, p).toPandas()
    assert len(m) == len(rows) and (m.mix_copies >= 1).all()
    t = {}
    for _, s, x in rows:
        t[s] = t.get(s, 0) + len((x or "").split())
    t = {k: v for k, v in t.items() if v}
    ratio = max(t.values()) / min(t.values())
    alpha = max(0.0, 1 - math.log(limit) / math.log(ratio))
    w = {k: (v / sum(t.values())) ** alpha for k, v in t.items()}
    z = sum(w.values())
    budget = max(v / (w[k] / z) for k, v in t.items())
    for s, g in m.groupby("source", dropna=False):
        s = None if s != s else s
        if s not in t:
            assert (g.mix_copies == 1).all() and (g.mix_weight == 0).all()
            continue
        assert g.mix_weight.iloc[0] == pytest.approx(w[s] / z, rel=1e-4)
        want = w[s] / z * budget
        assert abs((g.mix_tokens * g.mix_copies).sum() - want) <= g.mix_tokens.max() + 1e-3 * want
        assert g.mix_copies.max() - g.mix_copies.min() <= 1


def test_entropy_and_budget(spark):
    rows, df = _docs(spark)
    m = mixing.mixed(df, mixing.Params(max_repetition=None, entropy=0.5)).toPandas()
    w = m.drop_duplicates("source").mix_weight
    assert -sum(x * math.log(x) for x in w if x > 0) == pytest.approx(0.5, abs=1e-3)
    b = mixing.mixed(df, mixing.Params(budget_tokens=1000.0, block_rows=20)).toPandas()
    assert abs((b.mix_tokens * b.mix_copies).sum() - 1000) < 60


def test_permutation_is_a_prefix_of_the_order(spark):
    rows, df = _docs(spark)
    p = mixing.Params(budget_tokens=2000.0, block_rows=10)
    a, b = mixing.mixed(df, p).orderBy("doc_id", "source").collect(), mixing.mixed(df.repartition(7), p).orderBy("doc_id", "source").collect()
    assert [(r.doc_id, r.mix_copies) for r in a] == [(r.doc_id, r.mix_copies) for r in b]


def test_rows(spark):
    rows, df = _docs(spark)
    p = mixing.Params(max_repetition=1.5)
    out = mixing.realised(df, p)
    assert out.columns == df.columns
    assert out.count() == sum(r.mix_copies for r in mixing.mixed(df, p).collect())
    assert mixing.realised(df.limit(0), p).count() == 0
