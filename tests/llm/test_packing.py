import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bestfit, packing
from tidemark.llm.tokens import Encoder, Vocabulary

ODD = ["", " ", "a", "  two  spaces \n\n tail ", "tabs\t\tand\r\nlines", "it's we'll 'tis", "<|endoftext|> inside <|endoftext|>", "naïve café ☕ 日本語  x\x1c y \x85 z", "x" * 9000, " lead", "trail ", "a b  c", "1234 5678,90.", "…“quotes” — dash"]


def _expected(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_ids(spark, sf):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    enc = Encoder(Vocabulary())
    for x, want in zip(texts, _expected(texts)):
        assert np.frombuffer(enc(x), "<u2").tolist() == want[:-1], x[:40]


LONG_SPACE = ["a" + c * 1_000_001 + "b" for c in (" ", "\t", "\n", "\u00a0")]


def test_a_million_spaces(spark):
    """In the encoder and both packings."""
    want = _expected(LONG_SPACE)
    for x, ids in zip(LONG_SPACE, want):
        assert np.frombuffer(Encoder(Vocabulary())(x), "<u2").tolist() == ids[:-1]
    df = spark.createDataFrame(list(enumerate(LONG_SPACE)), "doc_id long, text string")
    _check(packing.packed(df).collect(), LONG_SPACE, 2048)
    _check(bestfit.segments(bestfit.token_matrices(df)).collect(), LONG_SPACE, 2048)


def test_files_in_order(spark, tmp_path):
    """Files of unlike size, which the engine reads the largest first."""
    texts = [f"{k} " * (1 + (37 * k) % 200) for k in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for lo, hi in ((0, 10), (10, 200), (200, 203), (203, 330), (330, 390), (390, 400)):
        df.where(f"doc_id >= {lo} and doc_id < {hi}").coalesce(1).sortWithinPartitions("doc_id").write.mode("append").parquet(f"{tmp_path}/t/k={lo}")
    rows = packing.packed(spark.read.parquet(f"{tmp_path}/t").drop("k"), size=64).collect()
    _check(rows, texts, 64)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert order == list(range(400))


def _check(pieces, texts, size):
    """Each id in one piece, rows gapless, checksums of the ids."""
    want = {i: x for i, x in enumerate(_expected(texts))}
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, rows in by_doc.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[i])
            assert r.ids_crc32 == zlib.crc32(np.array(want[i][at: at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[i])
    assert set(by_seq) == set(range(len(by_seq)))
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return by_seq


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, *ODD, *(["one two three"] * 30), "word " * 700]
    return texts, spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)


def test_concatenate_and_cut(spark, docs):
    texts, df = docs
    got = packing.packed(df, size=64).collect()
    by_seq = _check(got, texts, 64)
    full = [sum(r.length for r in rows) for rows in by_seq.values()]
    assert sorted(full)[1:] == [64] * (len(full) - 1)
    assert packing.packed(df.limit(0)).count() == 0


def test_sequences(spark, docs):
    texts, df = docs
    seq = packing.sequences(packing.packed(df, size=64, with_ids=True)).orderBy("sequence_id").collect()
    ids = np.concatenate([np.frombuffer(r.ids, "<u2") for r in seq])
    assert len(ids) == sum(r.n_tokens for r in seq) == sum(map(len, _expected(texts)))


def test_best_fit(spark, docs):
    texts, df = docs
    m = bestfit.token_matrices(df, size=64)
    _check(bestfit.segments(m).collect(), texts, 64)
    for r in m.collect():
        ids, pos = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(pos) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for a, b in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
    assert bestfit.token_matrices(df.limit(0)).count() == 0


def test_best_fit_is_the_fullest_row():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 65, 200)
        rows = bestfit.best_fit(lengths, 64)
        assert sorted(i for r in rows for i in r) == list(range(200))
        left, want = [], 0  # brute force by the same rule
        for n in sorted(lengths, reverse=True):
            fit = [x for x in left if x >= n]
            if fit:
                left.remove(min(fit))
                left.append(min(fit) - n)
            else:
                left.append(64 - n)
        assert len(rows) == len(left)
        assert sorted(64 - int(lengths[r].sum()) for r in rows) == sorted(int(x) for x in left)


def test_null_ids_beside_large_ones(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "a b c"), (None, "d " * 90), (big + 2, None), (None, None)], "doc_id long, text string").coalesce(1)
    for pieces in (packing.packed(df, size=16), bestfit.segments(bestfit.token_matrices(df, size=16))):
        rows = pieces.collect()
        assert {r.doc_id for r in rows} == {big, big + 2, None}
        assert sum(r.length for r in rows) == sum(map(len, _expected(["a b c", "d " * 90, None, None])))
