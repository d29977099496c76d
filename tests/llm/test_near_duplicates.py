import numpy as np
import pytest

from tidemark.llm import common
from tidemark.llm import dartminhash as d


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.uniform(0.1, 3, 400), rng.uniform(0.1, 3, 400)
    s = d.signatures(np.concatenate([e, e, e]), np.concatenate([a, b, a]), np.repeat([0, 1, 2], 400), 3, 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)
    assert (s[0] == s[2]).all()
    few = d.signatures(np.array([5, 6, 6], np.uint64), np.ones(3), np.array([0, 1, 3]), 4, 252)
    assert (few[1] == few[3]).all() and not few[2].any() and (few[0] != few[1]).any()


def _texts():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(5000)]
    out = []
    for _ in range(25):
        base = list(rng.choice(words, int(rng.integers(5, 300))))
        out.append(" ".join(base))
        for _ in range(int(rng.integers(0, 5))):
            c = list(base)
            for _ in range(int(rng.integers(0, 6))):
                c[int(rng.integers(len(c)))] = str(rng.choice(words))
            out.append(" ".join(c))
    hub = list(rng.choice(words, 400))
    for i in range(60):  # a large group of near copies
        c = list(hub)
        c[int(rng.integers(400))] = f"x{i}"
        out.append(" ".join(c))
    passage = " ".join(rng.choice(words, 60))
    out += [passage + " " + " ".join(rng.choice(words, 40)) for _ in range(40)]
    return out + ["", None, "  ", "one two", "ONE  two", "one two three", out[0], out[0].upper()]


def _brute(keys, texts, size=5, at=0.8):
    cache = d.Words()
    sets = {k: set(d.shingles(t or "", size, cache).tolist()) for k, t in zip(keys, texts)}
    up = {k: k for k in keys}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            s, t = sets[a], sets[b]
            if s == t or (s and t and len(s & t) >= at * len(s | t)):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def test_classes_match_brute_force(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rid string").repartition(3)
    got = d.near_duplicates(df, d.Params(group_rows=10, batch_elements=500)).collect()
    want = _brute(list(range(len(texts))), texts)
    assert {r.doc_id: r.class_id for r in got} == want
    assert {r.doc_id for r in got if r.kept} == set(want.values())
    assert d.deduplicated(df).columns == df.columns
    assert sorted(r.doc_id for r in d.deduplicated(df).collect()) == sorted(set(want.values()))


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here are now many"), (None, "a b c d e f"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = d.near_duplicates(df).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 3
    assert d.deduplicated(df).count() == 3
    assert d.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(300, 200), (200, 250)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[300] == got[250] == got[200] == 200


@pytest.mark.parametrize("block", [1_000_000, 20_000])
def test_large_buckets_leave_no_pair_out(spark, block):
    """Documents of one template, hardly unlike enough, that hide pairs."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(50_000)]
    template = list(rng.choice(words, 430))
    texts = []
    for _ in range(60):
        own = list(rng.choice(words, 70))
        texts.append(" ".join(template + own))
        texts.append(" ".join(template + own[:24] + list(rng.choice(words, 46))))  # at least 0.8
    p = d.Params(bands=6, block_shingles=block)
    cache, n = d.Words(), len(texts)
    sets = [d.shingles(t, p.words, cache) for t in texts]
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    keys = d.band_keys(d.signatures(np.concatenate(sets), np.ones(len(owner)), owner, n, p.bands * p.rows, p.darts), p.bands, p.rows)
    up = list(range(n))
    for j in range(n):
        for i in range(j):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if (keys[i] == keys[j]).any() and both >= p.similarity * (len(sets[i]) + len(sets[j]) - both):
                up = [up[i] if u == up[j] else u for u in up]
    want = {i: min(k for k in range(n) if up[k] == up[i]) for i in range(n)}
    assert 10 < n - len(set(want.values())) < n / 2 + 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in d.near_duplicates(df, p).collect()} == want


def test_counts_as_weights(spark):
    """Repeats of a shingle weigh with counts=True and do not without."""
    rng = np.random.default_rng(3)
    line, rest = " ".join(rng.choice(5000, 12).astype(str)), " ".join(rng.choice(5000, 80).astype(str))
    texts = [f"{rest} {' '.join([line] * 20)}", f"{rest} {' '.join([line] * 3)}", f"{rest} {' '.join([line] * 19)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in d.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 0}
    assert {r.doc_id: r.class_id for r in d.near_duplicates(df, d.Params(counts=True)).collect()} == {0: 0, 1: 1, 2: 0}


def test_bucket_of_many_links(spark):
    """A chain in one bucket: neighbours are alike, its ends are not."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    base, texts = list(rng.choice(words, 200, replace=False)), []
    for k in range(40):
        texts.append(" ".join(base))
        base[(5 * k) % 200: (5 * k) % 200 + 5] = [f"n{k}x{j}" for j in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in d.near_duplicates(df).collect()}
    assert got == _brute(list(range(40)), texts) and set(got.values()) == {0}


def test_very_long_text(spark):
    rng = np.random.default_rng(5)
    w = [f"w{x}" for x in rng.integers(0, 90_000, 60_000)]
    v = list(w)
    v[::400] = ["edit"] * len(v[::400])
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(v)), (3, " ".join(w[:20_000]))], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in d.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_joined_components():
    rng = np.random.default_rng(9)
    base = rng.choice(2000, 60, replace=False)
    sets = []
    for _ in range(90):
        s = base.copy()
        s[: int(rng.integers(0, 16))] = rng.integers(2000, 2100)
        sets.append(np.unique(np.concatenate([s, rng.integers(3000, 3040, int(rng.integers(0, 9)))])).astype("<u4"))
    comp = rng.integers(0, 70, 90)

    def parts(pairs):
        up = comp.copy()
        for i, j in pairs:
            up[up == up[j]] = up[i]
        return {frozenset(np.flatnonzero(up == u).tolist()) for u in up}

    for side in (np.zeros(90), rng.integers(0, 2, 90)):
        brute = [(i, j) for i in range(90) for j in range(i) if (len(set(side)) == 1 or side[i] != side[j])
                 and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        got = d.joined(comp, side, sets, 0.8)
        assert set(got) <= {p for i, j in brute for p in ((i, j), (j, i))} and len(got) < len(set(comp)) and parts(got) == parts(brute)


def test_rows_are_linear_beside_one_large_component(spark):
    """A bucket of n members of one component and three others: three blocks of
    shingles more for each thousand members, and no member twice."""
    p = d.Params(block_shingles=10_000)
    for n in (2000, 8000):
        shared = spark.range(n + 3).selectExpr("7L AS bucket", "id AS rid", "30L AS n")
        comp = spark.range(n).selectExpr("id AS node", "0L AS comp")
        placed = d._placed(shared, comp, p)
        rows = d._dealt(placed).toPandas()
        blocks = n * 30 // 10_000
        assert len(rows) == n + 3 * (1 + blocks) and (rows[rows.comp == 0].groupby("rid").size() == 1).all()
        met = rows.merge(rows, on=["lo", "hi"])
        pairs = set(zip(met.rid_x[met.side_x != met.side_y], met.rid_y[met.side_x != met.side_y])) | set(zip(met.rid_x[met.lo == met.hi], met.rid_y[met.lo == met.hi]))
        assert all((x, y) in pairs for x in range(n, n + 3) for y in range(n + 3))
    several = spark.createDataFrame([(1, k, 4000) for k in range(9)] + [(2, 1, 5), (2, 2, 5), (3, 3, 9)], "bucket long, rid long, n long")
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, comp long")
    got = {r.bucket: (r.top, r.seekers, r.targets) for r in d._placed(several, comp, p).collect()}
    assert got == {1: (1, 3, 2)}
