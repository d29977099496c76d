"""The pipeline's stages, each against brute force on its own input."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import dartminhash, mixing, quality
from tidemark.llm.common import written


def _classes(rows):
    cache = dartminhash.Words()
    sets = {i: set(dartminhash.shingles(t or "", 5, cache).tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, b in enumerate(ids):
        for a in ids[:k]:
            s, t = sets[a], sets[b]
            if s == t or (s and t and len(s & t) >= 0.8 * len(s | t)):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {top(i) for i in ids}


def _cleaned(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - n + 1):
            w = raw[k: k + n]
            if w in seen:
                gone[k: k + n] = b"\1" * n
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        if kept or not raw:
            out[i] = kept
    return out


def test_stages_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, labels = docs.columns, spark.read.parquet(f"{sf}/labels.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(docs)
        docs = written(stage(spark, docs, sf), name)
    seen.append(docs)
    rows = [[(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] if "text" in d.columns else None for d in seen]
    assert all(d.columns == names for d in seen[:5])
    fine = {r.doc_id for r in quality.quality(seen[0], labels).where("predicted = 1").collect()}
    assert {i for i, _ in rows[1]} == fine and dict(rows[1]).items() <= dict(rows[0]).items() and len(rows[1]) < len(rows[0])
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(clean & fine) >= 0.9 * len(clean)
    assert {i for i, _ in rows[2]} == _classes(rows[1]) and len(rows[2]) < len(rows[1])
    assert dict(rows[3]) == _cleaned(rows[2])
    assert all(r.n_chars == len(r.text) for r in seen[3].collect())
    copies = {r.doc_id: r.mix_copies for r in mixing.mixed(seen[3], mixing.Params(max_repetition=1.25)).collect()}
    assert Counter(i for i, _ in rows[4]) == Counter({i: n for i, n in copies.items() if n}) and set(rows[4]) == set(rows[3])
    words = Counter()
    for r in seen[4].select("source", "text").collect():
        words[r.source] += len(r.text.split())
    once = Counter()
    for r in seen[3].select("source", "text").collect():
        once[r.source] += len(r.text.split())
    longest = max(len(t.split()) for _, t in rows[3])
    assert all(words[s] <= 1.25 * once[s] + longest for s in once)
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    texts, pieces = dict(rows[4]), docs.collect()
    n = {i: len(encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    total = Counter()
    for r in pieces:
        total[r.doc_id] += r.length
        assert r.doc_tokens == n[r.doc_id]
    assert total == Counter({i: n[i] * c for i, c in copies.items() if c})
    at = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert sorted(at) == list(range(len(at))) and all(x == 2048 for k, x in at.items() if k < len(at) - 1)


def test_run(spark, sf):
    assert set(corpus_pipeline.run(spark, sf).columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_packed_in_the_order_of_the_mix(spark, sf):
    """Eight files of unlike size; the permutation of the first pass decides."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = [r.doc_id for r in mixing.mixed(docs, mixing.Params(max_repetition=1.25)).where("mix_copies > 0").orderBy("mix_position").collect()]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        mix = written(corpus_pipeline.mixing_stage(spark, docs, sf), "mix")
        assert len(mix.inputFiles()) >= 6
        pieces = corpus_pipeline.packing_stage(spark, mix, sf).where("start = 0").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = [r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))]
    assert got[: len(want)] == want and len(got) > len(want)  # then the second pass


ODD = [(1, None), (2, ""), (3, "same words here " * 20), (3, "same words here " * 20), (4, "same words here " * 20), (None, "no id at all " * 9), (2**53 + 1, "long " * 60_000), (7, "other clean text of its own kind " * 5)]


def test_stages_take_odd_rows(spark, sf):
    """Null ids and texts, repeated ids, a long text, extra columns that are
    named like the operators' own, and no rows at all."""
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, rid long, epoch int, position long, ids string"
    rows = [(i, t, None, None if k % 2 else "s", None, 0.5, k, k, k, "x") for k, (i, t) in enumerate(ODD)]
    for docs in (spark.createDataFrame(rows, names), spark.createDataFrame([], names)):
        columns = docs.columns
        before = [(i, t or "") for i, t in ODD] if docs.count() else []
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf), name)
            if name != "packing":
                assert docs.columns == columns, name
                after = [(r.doc_id, r.text or "") for r in docs.collect()]
                if name in ("quality_classifier", "near_duplicates"):
                    assert not Counter(after) - Counter(before), name
                else:
                    assert {i for i, _ in after} <= {i for i, _ in before}, name
                before = after
        n = Counter()
        for r in docs.collect():
            n[r.doc_id] += r.length
        assert set(n) == {i for i, _ in before}
