import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import qualityrules as q


def _brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i: i + 3]) for i in range(len(w) - 2)]
    inside = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc", "#", "é|", " ", "\n", "\t", "\x1c", "\xa0", "　", "\r", "\x0b"]), max_size=60).map("".join))
def test_counts(t):
    assert q.counts_of(t)[:5] == _brute(t)


def _texts():
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(3000)]
    good = [" ".join(rng.choice(vocabulary, 120)) for _ in range(150)]
    noisy = [" ".join(f"{x}***" for x in rng.choice(vocabulary, 120)) for _ in range(25)]
    # rules that fail together are what sets a class apart
    loud = [" ".join(f"{x.upper()}#" for x in rng.choice(vocabulary, 120)) for _ in range(25)]
    return good, noisy + loud


def test_verdicts(spark):
    good, bad = _texts()
    rows = [(i, t, 1) for i, t in enumerate(good + bad)] + [(None, None, 1), (900, "", 1), (901, "a b " * 100, 1), (902, good[0], 1), (902, good[0], 1)]
    got = q.judged(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).toPandas()
    assert len(got) == len(rows)
    by = got.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    assert by.kept.loc[list(range(len(good)))].all() and not by.kept.loc[list(range(len(good), len(good) + len(bad)))].any()
    assert by.base_failed[900] and by.base_failed[901] and not by.kept[901] and by.kept[902]
    assert q.judged(spark.createDataFrame(rows, "doc_id long, text string, n_words int").limit(0)).count() == 0


def test_accuracies_recover_rules():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.85
    votes = []
    for right_good, right_bad, cast in ((0.98, 0.6, 1.0), (0.95, 0.5, 0.8), (0.99, 0.7, 0.9), (0.97, 0.4, 1.0)):
        ok = np.where(y, rng.random(len(y)) < right_good, rng.random(len(y)) < right_bad)
        v = np.where(ok == y, 1, -1)
        votes.append(np.where(rng.random(len(y)) < cast, v, 0))
    patterns, times = np.unique(np.stack(votes, 1), axis=0, return_counts=True)
    chance, share = q.accuracies(patterns.astype(float), times.astype(float))
    assert share == pytest.approx(0.85, abs=0.05)
    assert chance[1, 0, 2] == pytest.approx(0.98, abs=0.03) and chance[0, 2, 0] == pytest.approx(0.7 * 0.9, abs=0.12)


def test_null_ids_beside_large_ones(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "one two"), (None, "x"), (big + 2, None)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in q.judged(df).collect()} == {big, None, big + 2}


def test_kept_matches_brute_force(spark):
    """The verdicts recomputed row by row: plain EM over documents, not over
    vote patterns, then Bayes by hand."""
    good, bad = _texts()
    rows = list(enumerate(good + bad + ["", "a b " * 100]))
    got = {r.doc_id: r for r in q.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def vote(name, c):
        num, den = (dict(zip(q._COUNTS, c))[x] for x in q.RULES[name][0])
        if not den:
            return 0
        x = num / den
        low = {"word_length": (2.5 <= x <= 12, x < 2 or x > 20), "symbols": (x <= 0.05, x > 0.2), "dup_lines": (x <= 0.15, x > 0.4), "repeats": (x <= 0.2, x > 0.35), "capitals": (x <= 0.15, x > 0.4), "letters": (x >= 0.6, x < 0.3)}[name]
        return 1 if low[0] else -1 if low[1] else 0

    votes = [[vote(n, q.counts_of(t)) for n in q.RULES] for _, t in rows]
    p_good = [0.1 if -1 in v else 0.95 for v in votes]
    for _ in range(500):
        chance = []
        for c in (0, 1):
            weight = [g if c else 1 - g for g in p_good]
            chance.append([])
            for j in range(len(q.RULES)):
                tally = {x: 0.1 + sum(w for w, v in zip(weight, votes) if v[j] == x) for x in (-1, 0, 1)}
                chance[c].append({x: n / sum(tally.values()) for x, n in tally.items()})
        for j in range(len(q.RULES)):
            if chance[0][j][-1] < chance[1][j][-1]:
                both = {x: (chance[0][j][x] + chance[1][j][x]) / 2 for x in (-1, 0, 1)}
                chance[0][j] = chance[1][j] = both
        share = min(0.99, max(0.01, (sum(p_good) + 1) / (len(rows) + 2)))
        new = []
        for v in votes:
            a, b = share, 1 - share
            for j, x in enumerate(v):
                a, b = a * chance[1][j][x], b * chance[0][j][x]
            new.append(a / (a + b))
        p_good = new
    for (i, t), g in zip(rows, p_good):
        c = q.counts_of(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        assert got[i].base_failed == failed and got[i].posterior == pytest.approx(g, abs=1e-6) and got[i].kept == (not failed and g >= 0.5)
