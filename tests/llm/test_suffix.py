import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import suffixdedup as s


def _brute(texts, n):
    seen, out = set(), []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            w = t[i: i + n]
            if w in seen:
                gone[i: i + n] = b"\1" * n
            else:
                seen.add(w)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(b for b, g in zip(t, gone) if not g)))
    return out


def _texts(seed, n=25):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("ab cdé") for _ in range(rnd.randint(20, 300))) for _ in range(8)]
    piece = [lambda: rnd.choice(pool), lambda: pool[0][: rnd.randint(0, 100)], lambda: "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 150))), lambda: "x" * rnd.randint(0, 260), lambda: "ab" * rnd.randint(0, 130)]
    return ["".join(rnd.choice(piece)() for _ in range(rnd.randint(0, 6))) for _ in range(n)]


def _local(texts, p):
    rows = []
    for i, t in enumerate(texts):
        for h, at, a, z in zip(*(x.tolist() for x in s.anchors(np.frombuffer(t, np.uint8), p))):
            rows.append((h, i, at << 16 | (at - a) << 8 | (at - z), t[a: z + p.length]))
    gone = [bytearray(len(t)) for t in texts]
    if rows:
        rows.sort(key=lambda r: r[0])
        h, rid, code = (np.array([r[j] for r in rows]) for j in range(3))
        for i, a, z in zip(*(x.tolist() for x in s.repeated_strings(h, rid, code, [r[3] for r in rows], p))):
            gone[i][a: z + p.length] = b"\1" * (z + p.length - a)
    return [bytes(b for b, g in zip(t, x) if not g) for t, x in zip(texts, gone)]


@pytest.mark.parametrize("p", [s.Params(), s.Params(chunk=64, strings=50), s.Params(length=40, gram=8, chunk=100, strings=7, shallow=3)])
def test_strings_match_brute_force(p):
    for seed in range(25):
        texts = [t.encode() for t in _texts(seed)]
        assert _local(texts, p) == [r[3] for r in _brute(texts, p.length)]


def test_deep_shallow_groups_equal_strings():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, (500, 24)).astype(np.uint8)
    text[:, 4:20] = 97
    order, leaf = s.deep_shallow(text, np.zeros(500, np.int64), s.Params())
    got = {}
    for i, g in zip(order.tolist(), leaf.tolist()):
        got.setdefault(g, set()).add(i)
    want = {}
    for i in range(500):
        want.setdefault(text[i].tobytes(), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_multikey_quicksort_keeps_groups_apart():
    rng = np.random.default_rng(1)
    for n, values, depth in ((0, 2, 1), (1, 2, 1), (400, 3, 2), (3000, 2, 3), (500, 1, 2)):
        words, group = rng.integers(0, values, (n, depth)).astype(np.uint64) << np.uint64(60), rng.integers(0, 9, n) * 1000
        order, segment = s.multikey_quicksort(words, group)
        want = {}
        for i in range(n):
            want.setdefault((group[i], *words[i].tolist()), set()).add(i)
        got = {}
        for i, g in zip(order.tolist(), segment.tolist()):
            got.setdefault(g, set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
        assert len(order) == sum(map(len, got.values())) and (np.diff(segment) >= 0).all()


@pytest.mark.parametrize("p", [s.Params(), s.Params(hot=2, block=20), s.Params(hot=2, strings=30)])
def test_query_matches_brute_force(spark, p):
    texts = _texts(99, 60) + [None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, h string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.k) for r in s.without_repeats(df, p).select("*", F.sha2("kept", 256).alias("k")).collect()}
    want = [(a, b, c, hashlib.sha256(k).hexdigest()) for a, b, c, k in _brute([(t or "").encode() for t in texts], 100)]
    assert got == dict(enumerate(want))


def test_repeated_and_null_ids(spark):
    rnd = random.Random(4)
    t = "".join(rnd.choice("abcdefghijk") for _ in range(130))
    rows = [(3, t), (3, t), (None, t), (1, "z" + t), (1, "short")]
    got = s.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got) == [("1", 5, 0), ("1", 131, 130), ("3", 130, 130), ("3", 130, 130), ("None", 130, 0)]
    assert s.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_cleaned(spark):
    rnd = random.Random(5)
    t = "é".join(rnd.choice("abcdefghijk") for _ in range(80))
    df = spark.createDataFrame([(1, t, "en", "a", 0), (2, "x" + t, "en", "a", 0), (3, t, "en", "a", 0), (4, "", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in s.cleaned(df).collect()}
    assert s.cleaned(df).columns == df.columns and set(got) == {1, 2, 4}
    assert got[2].text == "x" and got[2].n_chars == 1 and got[1].text == t


def test_common_line_is_never_gathered(spark, monkeypatch):
    rnd = random.Random(6)
    line = "".join(rnd.choice("abcdefghijk") for _ in range(104))
    texts = ["".join(rnd.choice("lmnopqrstuv") for _ in range(40 + i)) + line + "".join(rnd.choice("lmnopqrstuv") for _ in range(30)) for i in range(40)]
    most, gathered = [], s._repeats

    def watched(contexts, p):
        most.append(max([r["count"] for r in contexts.groupBy("h").count().collect()], default=0))
        return gathered(contexts, p)

    monkeypatch.setattr(s, "_repeats", watched)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in s.without_repeats(df, s.Params(hot=10)).orderBy("doc_id").collect()]
    assert got == _brute([t.encode() for t in texts], 100) and max(most) <= 10
    assert sum(r[1] for r in got) >= 39 * 104


def test_very_long_text(spark):
    rnd = random.Random(7)
    body = "".join(rnd.choice("abcdefghij é") for _ in range(60_000))
    texts = [body[:30_000], "x" + body[20_000:] + body[:500], body[100:300] * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in s.without_repeats(df, s.Params(chunk=5000)).orderBy("doc_id").collect()]
    assert got == _brute([t.encode() for t in texts], 100)


def _told_apart(text, group):
    order, leaf = s.blind_tries(text, np.arange(len(text)), group, 0)
    got, want = {}, {}
    for i, g in zip(order.tolist(), leaf.tolist()):
        got.setdefault(g, []).append(i)
    for i in range(len(text)):
        want.setdefault((group[i], text[i].tobytes()), []).append(i)
    return sorted(map(sorted, got.values())), sorted(v for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("seed", range(40))
def test_blind_tries_tell_equal_strings(seed):
    rng = np.random.default_rng(seed)
    n, width, letters = int(rng.integers(1, 300)), int(rng.integers(1, 30)), int(rng.integers(1, 4))
    text = rng.integers(97, 97 + letters, (n, width)).astype(np.uint8)
    text[:, : int(rng.integers(0, width))] = 97
    got, want = _told_apart(text, np.sort(rng.integers(0, 4, n)))
    assert got == want


def test_blind_tries_part_one_edge_at_every_depth():
    width = 60
    text = np.full((2 * width + 2, width), 97, np.uint8)  # all a; then each string and a copy leave at its own place
    for i in range(width):
        text[2 + 2 * i: 4 + 2 * i, i] = 98 + i % 3
    got, want = _told_apart(text, np.zeros(len(text), np.int64))
    assert got == want == [[i, i + 1] for i in range(0, 2 * width + 2, 2)]


def test_blind_tries_see_bytes_they_skip():
    # the third string descends by its last byte to the second and is only then found to differ before
    text = np.array([[1, 1, 1], [1, 1, 2], [1, 9, 2], [1, 9, 2], [0, 255, 0], [0, 255, 0]], np.uint8)
    got, want = _told_apart(text, np.array([0, 0, 0, 0, 7, 7]))
    assert got == want == [[2, 3], [4, 5]]
    assert len(s.blind_tries(text[:0], np.zeros(0, np.int64), np.zeros(0, np.int64), 0)[0]) == 0


@pytest.mark.parametrize("most", [0, 10])
def test_broadcast_bound_changes_no_result(spark, most):
    rows = [(i, "".join(chr(97 + (i * j) % 7) for j in range(60)) + "m" * 140 + str(i)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p = s.Params(hot=5, strings=60, broadcast_ids=most)
    got = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in s.without_repeats(docs, p).orderBy("doc_id").collect()]
    assert got == _brute([t.encode() for _, t in rows], 100)
