import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fim

TEXTS = [None, "", "a", "ab", "has <P> inside", "<M>", "<S> x", "< P>", "<" * 40, "naïve ☕ 日本語 𝔘\U0010ffff é", "one two\nthree\n\n four", "x" * 300_000, "\x00\x1f ", "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "no id here", "c", 2), (2**53 + 1, "large id " * 20, "c", 3), (3, "ab", "c", 4)] + [(100 + i, f"word{i} <x> and some more", "c", 5) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, output string, form int").repartition(3)


def _brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k: 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return (doc_id, n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text)


def test_like_brute_force(spark, docs):
    got = fim.transformed(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [_brute(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transformed(docs.limit(0)).count() == 0


def test_units():
    text = "one  two, three\nfour\n\nend"
    cut = lambda unit: [text[a:b] for a, b in zip(e[:-1], e[1:])] if len(e := fim.edges(fim.np.frombuffer(text.encode("utf-32-le"), "<u4"), unit)) > 1 else []
    assert cut("char") == list(text)
    assert cut("line") == text.splitlines(keepends=True)
    assert cut("word") == re.findall(r"\w+|\s+|.", text)
    assert fim.edges(fim.np.zeros(0, "<u4"), "word").tolist() == [0]


def test_cuts_fall_between_units(spark):
    df = spark.createDataFrame([(i, f"alpha beta{i} gamma, delta\nline {i}\n") for i in range(200)], "doc_id long, text string")
    for unit, at in (("word", r"(?<=\w)(?=\w)"), ("line", r"(?<=[^\n])(?!$)")):
        rows = fim.transformed(df, fim.Params(unit=unit)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).join(df, "doc_id").where("form <> 'plain'").collect()
        assert len(rows) > 100
        for r in rows:
            assert r.back == r.text
            for k in (r.prefix_chars, r.prefix_chars + r.middle_chars):
                assert not re.compile(at).match(r.text, k) or k in (0, r.n)
    with pytest.raises(ValueError):
        fim.transformed(df, fim.Params(unit="page"))


def test_shares(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text to cut").alias("text"))
    n = {r.form: r["count"] for r in fim.transformed(df).groupBy("form").count().collect()}
    assert 320 < n["plain"] < 480 and 600 < n["spm"] < 850
    none = fim.transformed(df, fim.Params(fim_percent=0)).where("form <> 'plain'").count()
    assert none == 0


def test_query(spark, sf):
    got = {r.doc_id: r for r in fim.op13_fim(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(got)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in docs:
        i, n, form, a, m, out, back = _brute(r.doc_id, r.text)
        assert tuple(got[i]) == (i, n, form, a, m, sha(out), sha(back))
