import hashlib
import random
import zlib

import pytest

from tidemark.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string, keys string"


def _brute(rows):
    """Nodes by plain dictionaries; turns of one number in the digest's order."""
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for _, _, _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = sorted(c for c in nodes[p] if len(built[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(below), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def _got(df, **kw):
    r = convtrie.trie(convtrie.rebuilt(convtrie.turns(df)), **kw) if kw else convtrie.conversation_trie(df)
    assert r.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, r.collect()), key=str)


def _rows(seed, n, alphabet, longest):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for k in range(rng.randint(1, longest)):
            rows.append((c * rng.choice([1, 1, 1, 7]), k if rng.random() > 0.05 else None, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(alphabet), "clash"))
    return rows


@pytest.mark.parametrize("seed,alphabet,longest", [(1, "ab", 6), (2, ["x", "é", None, "", "long " * 50], 12), (3, "a", 20), (4, "abcdefghij", 3)])
def test_like_brute_force(spark, seed, alphabet, longest):
    rows = _rows(seed, 120, list(alphabet), longest)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = _brute(rows)
    assert _got(df) == want
    assert _got(df, part_bytes=300, run_rows=3) == want  # many partitions, many runs in each


def test_hot_copies_and_first_turns(spark):
    """One conversation many times, over many partitions, and one first turn."""
    rows = [(5 * c, k, "user", t, "") for c in range(400) for k, t in enumerate(["hot", "x", "y"])]
    rows += [(5 * c, k, "user", t, "") for c in range(400, 600) for k, t in enumerate(["hot", f"own {c}", "z"])]
    rows += [(5 * c, k, "user", f"t{k}", "") for c in range(600, 603) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert _got(df, part_bytes=400, run_rows=7) == _brute(rows)


def test_edges(spark):
    rows = [(4, 0, "user", "gone", ""), (4, 1, None, None, ""), (11, None, "a", "b", ""), (11, None, "a", "b", ""), (None, 3, "x", "y", ""), (12, 1, "", "", ""), (-3, 0, "u", "v", ""), (-5, 0, "w", "x", ""), (2**63 - 1, 0, "end", "z", ""), (2**63 - 3, 0, "e", "z", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert _got(df) == _brute(rows)
    assert _got(df.limit(0)) == []


def test_merge_is_sorted_and_carries_prefixes():
    rng = random.Random(7)
    rows = [(b"".join(bytes([rng.randint(0, 1)]) * convtrie.WIDTH for _ in range(rng.randint(0, 9))), i, []) for i in range(500)]
    for k in (1, 2, 3, 8, 500):
        out = list(convtrie.merged([convtrie.Run(rows[j::k]) for j in range(k)]))
        assert [r[:2] for r in out] == sorted(r[:2] for r in rows)
        for a, b in zip(out, out[1:]):
            assert b[3] == convtrie.common(a[0], b[0], 0)
    assert list(convtrie.merged([])) == [] and list(convtrie.merged([convtrie.Run([])])) == []


def test_shared_turns_are_not_compared_again(monkeypatch):
    """40 runs of conversations with 200 shared turns: a merge compares what is
    beyond them."""
    rows = [(b"s" * convtrie.WIDTH * 200 + i.to_bytes(convtrie.WIDTH, "big"), i, []) for i in range(400)]
    runs, seen, plain = [convtrie.Run(rows[j::40]) for j in range(40)], [], convtrie.common
    monkeypatch.setattr(convtrie, "common", lambda a, b, at: seen.append(at) or plain(a, b, at))
    assert len(list(convtrie.merged(runs))) == 400
    assert sum(x == 0 for x in seen) < 40 <= len(seen)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, convtrie.op12_conversation_trie(spark, sf).collect()), key=str) == _brute(rows)
