import hashlib
import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprint as f


def _canon(t):
    n = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"\s+", " ", n).strip()


ODD = ["Straße", "STRASSE", "ﬁx  y", "fix y", "é", "é", "ấ", "ấ", "ＡＢ", "ab", "’x", "x  y", "x y", "ΣΣ", "Å", "Å", " \t\n ", "", None, "a  b\r\nc ", "½ …"]


def test_canonical(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "text string").select("text", f.canonical(F.col("text")).alias("c")).collect()
    assert [(r.text, r.c) for r in rows] == [(t, _canon(t)) for t in ODD]


@pytest.mark.parametrize("bucket,first", [(2000, 512), (3, 2)])
def test_fingerprints(spark, monkeypatch, bucket, first):
    monkeypatch.setattr(f, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(f, "_FIRST_LEVEL", first)
    rows = [(i * i % 97, t) for i, t in enumerate(ODD)] + [(None, "null id"), (None, "also"), (4, "tie"), (4, "tie"), (10**15, "far"), (500, "abc def"), (499, "ABC  def")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bucket string")
    got = f.fingerprints(df).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(10**18)), r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), float(_canon(t) == _canon(e)), float(_canon(t) == _canon(nxt))))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got], key=key) == sorted(want, key=key)
    assert len({r.fingerprint for r in got}) == len({_canon(t) for _, t in rows})
    assert f.fingerprints(df.limit(0)).count() == 0


def test_one_row_follows_itself(spark):
    r = f.fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0


def test_equal_buckets_are_told_apart(spark):
    weak = lambda c: F.lpad(F.hex(F.abs(F.xxhash64(c)) % 3), 4, "0")
    texts = [f"t{i % 11}" for i in range(44)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = f.fingerprints(d, weak).toPandas().set_index("doc_id")
    all_of = {}
    for i, t in enumerate(texts):
        nxt = texts[i - 1]  # the first follows the last
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        all_of.setdefault(t, set()).add(got.fingerprint[i])
        all_of.setdefault(e, set()).add(got.edited_fingerprint[i])
    assert all(len(v) == 1 for v in all_of.values()) and len(set.union(*all_of.values())) == len(all_of)
    assert f.numbered(spark.createDataFrame([("a" * 96,), ("b" * 96,)], "key string")) is None


def test_bytes_are_compared(spark):
    d = spark.createDataFrame([(1, "same"), (2, "SAME "), (3, "other")], "doc_id long, text string")
    keys = f.keyed(d, "text", "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    f.compared(d, keys)
    assert keys.where("n = 2").count() == 1


MARKS = ["a", "e", "o", "q", "\u0301", "\u0302", "\u0323", "\u0307", "\u0327", "\u1100", "\u1161", "\u11a8", "\uac00", "\u3099", "\u30ab", "\ufb01", "\u0130", "\u00df", "\u03c2", "\u1fb3", " ", "\u00a0", "\t"]


def test_canonical_forms_of_any_marks(spark):
    """Marks in any order, conjoining Hangul, ligatures and folds against
    Python's Unicode data, all permutations of up to three and random runs."""
    rnd = random.Random(0)
    texts = ["".join(x) for n in (1, 2, 3) for x in itertools.product(MARKS, repeat=n)] + ["".join(rnd.choices(MARKS, k=rnd.randint(4, 12))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", f.canonical(F.col("text")).alias("c")).collect()
    assert [r.text for r in rows if r.c != _canon(r.text)] == []
    forms = [unicodedata.normalize(k, t) for t in texts[-500:] for k in ("NFC", "NFD", "NFKC", "NFKD")]
    got = [r.c for r in spark.createDataFrame([(t,) for t in forms], "text string").select(f.canonical(F.col("text")).alias("c")).collect()]
    assert all(len(set(got[k: k + 4])) == 1 for k in range(0, len(got), 4))


def test_very_long_text(spark):
    t = "Ǆé " * 200_000
    got = {r.doc_id: r for r in f.fingerprints(spark.createDataFrame([(2, t), (1, t.lower() + "\n"), (0, "x")], "doc_id long, text string")).collect()}
    assert got[2].n_chars == len(t) and got[2].fingerprint == got[1].fingerprint and got[2].near_next == 1.0 and got[1].near_next == 0.0
    assert got[2].edited_sha256 == hashlib.sha256((t[: len(t) // 2] + t.lower()[: len(t) // 2]).encode()).hexdigest()


@pytest.mark.parametrize("run", [1, 3, 1000])
def test_buckets_follow_each_other(spark, monkeypatch, run):
    monkeypatch.setattr(f, "BUCKET_RUN", run)
    for buckets in ([], [-1], [5], [-1, 0, 1, 2, 3, 9, 10, 40, 41, 42, 43]):
        heads = spark.createDataFrame([(b, 10 * b) for b in buckets], "bucket long, head long")
        got = {r.b: (r["head"], r.to) for r in f._following(heads).collect()}
        assert got == {b: (10 * b, buckets[(k + 1) % len(buckets)]) for k, b in enumerate(buckets)}


def test_runs_of_buckets_change_no_result(spark, monkeypatch):
    rows = [(7 * i, f"text {i} " * (i % 5)) for i in range(60)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(map(str, r)) for r in f.fingerprints(df).collect())
    monkeypatch.setattr(f, "BUCKET_ROWS", 3)
    monkeypatch.setattr(f, "BUCKET_RUN", 2)
    assert sorted(tuple(map(str, r)) for r in f.fingerprints(df).collect()) == want
