import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import sentencepieces

ODD = [
    None, "", " ", "  a", "trail  ", "hello  world\n\tx", "<s> a </s><unk> <0x0A>", "\x00a", "日本 𝔘 ​", "a▁b▁▁ ▁", "ﬁ é é", "▁", "▁▁", "日本" * 300, "x" * 5000, "same text", "same text",
    *(" " * k + "x" + " " * (40 - k) for k in range(0, 41, 3)), "\t" * 70 + "\n" * 70, "‮עברית‬ العربية", "\U0010ffff",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def own():
    return sentencepieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def _ids(x):
    return np.frombuffer(x, "<u4").tolist()


def test_random_texts_like_the_library(own, library):
    rng, letters = random.Random(1), sorted(own.alphabet)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    texts += ["".join(rng.choice("ae ▁tin") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    texts += ["".join(rng.choice("aaab \n▁日") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    for t in texts:
        assert _ids(own.encode(t)) == library.encode(t, add_bos=True, add_eos=True), t


@pytest.mark.parametrize("text", [" " * 1_000_001, "\n" * 200_000, "ab" * 150_000, "x" * 300_000, "▁a" * 100_000])
def test_long_texts(own, library, text):
    assert _ids(own.encode(text)) == library.encode(text, add_bos=True, add_eos=True)


def test_prefix_table(own, library):
    """The last token of every prefix is that of the prefix's own encoding."""
    word = "▁unbelievably"
    last = own.last_tokens(word)
    for k in range(1, len(word) + 1):
        assert own.text[last[k][0]] == own.merged(word[:k])[-1]


def test_together_is_what_merging_gives(own):
    a, b, ab = (own.number[x] for x in ("t", "h", "th"))
    assert not own.together(a, b) and own.together(ab, own.number["▁"])


def test_caches_are_bounded(own, library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "MOST_CHUNKS", 50)
    monkeypatch.setattr(sentencepieces, "MOST_PAIRS", 50)
    p = sentencepieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    for _ in range(300):
        t = " ".join("".join(rng.choice("abcdet") for _ in range(6)) for _ in range(9))
        assert _ids(p.encode(t)) == library.encode(t, add_bos=True, add_eos=True)
        assert len(p.known) <= 50 and len(p.pairs) <= 50


def test_operator(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "no id", "c"), (2**53 + 1, "large", "c"), (3, "again", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sentencepieces.encoded(df, decode=True)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), ids, library.decode(ids)))
    assert sorted(((r.doc_id, r.n_tokens, _ids(r.ids), r.decoded) for r in got.collect()), key=str) == sorted(want, key=str)
    again = sentencepieces.decoded(sentencepieces.encoded(df)).collect()
    assert sorted((r.decoded for r in again)) == sorted(w[3] for w in want)
    assert sentencepieces.encoded(df.limit(0)).count() == 0


def test_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in sentencepieces.op11_sentencepiece(spark, sf).collect()}
    for r in docs:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id] == (r.doc_id, len(ids), sha, hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert len(got) == len(docs)
