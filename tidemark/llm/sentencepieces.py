"""Operator 11: SentencePiece ids of merge-type (BPE) models by a prefix table.

Of every prefix of a text the table holds the one token that ends its encoding:
the piece that ends there (an automaton finds all of them) and goes with the last
token of the prefix before it. Two tokens go together if merging their joined
text gives just the two. Ids are read off the table backwards.

That is exact: a sequence is an encoding if all its neighbours go together. The
library merges the best pair by (score, place); what it picks within two
neighbours of an encoding never depends on the rest, so a merge across a border
would already happen in those two alone.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, as_text

SPACE = "▁"
#: Entries of the caches of a worker: the bound of its memory.
MOST_CHUNKS, MOST_PAIRS, CACHED_CHARS = 1 << 19, 1 << 20, 64


class Pieces:
    """A model's pieces, and chunks of normalised text in their ids."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        own = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        byte = {int(m.id_to_piece(i)[3:5], 16): i for i in range(size) if m.is_byte(i)}
        if len(byte) < 256 or any(m.is_unused(i) for i in range(size)):
            raise ValueError("a model with byte fallback and no unused pieces is needed")
        self.score = {m.id_to_piece(i): m.get_score(i) for i in own}
        self.text = {i: m.id_to_piece(i) for i in own}
        self.ids = {i: np.array([i], "<u4").tobytes() for i in own}
        long = [p for p in self.score if len(p) > 1]
        self.alphabet = set("".join(long))
        self.bytes_of = lambda c: np.array([byte[b] for b in c.encode()], "<u4").tobytes()
        # signs that occur in pieces but are none themselves: numbers beyond the model's
        for i, c in enumerate(sorted(c for c in self.alphabet if c not in self.score), size):
            self.text[i], self.ids[i] = c, self.bytes_of(c)
        self.shift = max(self.text).bit_length()
        self.number = {t: i for i, t in self.text.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.number.items():
            if set(t) <= self.alphabet and self.merged(t) == [t]:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        # a border that no piece spans: other signs, and white space after something else where no piece holds that
        letters = re.escape("".join(sorted(self.alphabet - {SPACE})))
        spans = any(re.search(f"[^{SPACE}]{SPACE}", t) for t in long)
        runs = f"[{letters}{SPACE}]+" if spans else f"{SPACE}*[{letters}]+|{SPACE}+"
        self.chunks = re.compile(f"{runs}|.", re.S).findall
        self.begin, self.end = (np.array([i], "<u4").tobytes() if i >= 0 else b"" for i in (m.bos_id(), m.eos_id()))
        self.pairs: dict[int, bool] = {}
        self.known = _Known(self)

    def merged(self, *texts: str) -> list[str]:
        """The symbols left of the joined texts when no pair makes a piece: the
        highest score first, of equal ones the leftmost."""
        s = [c for t in texts for c in t]
        score = self.score.get
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                x = score(s[i] + s[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            s[at: at + 2] = [s[at] + s[at + 1]]
        return s

    def together(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their joined text."""
        key = a << self.shift | b
        ok = self.pairs.get(key)
        if ok is None:
            x, y = self.text[a], self.text[b]
            ok = self.merged(x, y) == [x, y]
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def last_tokens(self, chunk: str) -> list[tuple[int, int]]:
        """For each prefix but the empty one, (token, its length)."""
        last: list = [None] * (len(chunk) + 1)
        pairs, shift = self.pairs, self.shift
        for end, (token, n) in self.automaton.iter(chunk):
            if last[end + 1] is None:
                start = end + 1 - n
                if start:
                    before = last[start][0]
                    ok = pairs.get(before << shift | token)
                    if ok is None:
                        ok = self.together(before, token)
                    if not ok:
                        continue
                last[end + 1] = (token, n)
        return last

    def encoded_chunk(self, chunk: str) -> bytes:
        if chunk not in self.number and len(chunk) == 1:
            return self.bytes_of(chunk)
        if len(chunk) == 1:
            return self.ids[self.number[chunk]]
        last, at, out = self.last_tokens(chunk), len(chunk), []
        while at:
            token, n = last[at]
            out.append(self.ids[token])
            at -= n
        return b"".join(reversed(out))

    def encode(self, text: str) -> bytes:
        """Ids with begin and end as little-endian 32-bit numbers."""
        chunks = self.chunks(self.model.normalize(text))
        return b"".join([self.begin, *map(self.known.__getitem__, chunks), self.end])

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


class _Known(dict):
    """Chunks met before, up to MOST_CHUNKS of them."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, chunk: str) -> bytes:
        ids = self.pieces.encoded_chunk(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= MOST_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each worker process, whose tasks then share its caches."""
    import public_tokenizers

    return Pieces(path or public_tokenizers.path("piece_bpe_32k.model"))


def encoded(docs: DataFrame, model_path: str = "", decode: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row: ids with begin and end as
    little-endian 32-bit numbers; decode adds decoded, the text that the ids give.

    Rows are encoded one by one, whole and without a shuffle. A null text is
    empty: begin and end alone. Repeated rows come out alike; an empty table
    gives no rows; columns other than doc_id and text are not read. An empty
    path stands for the installed model; it must be of merge type with byte
    fallback.
    """

    def run(batches):
        p = pieces(model_path)
        for pdf in batches:
            for low in range(0, len(pdf), 500):  # what goes back at once
                some = pdf.iloc[low: low + 500]
                ids = [p.encode(t or "") for t in some["text"]]
                out = pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "n_tokens": [len(x) // 4 for x in ids], "ids": ids})
                yield out.assign(decoded=[p.decode(x) for x in ids]) if decode else out

    made = docs.select(as_text("doc_id"), "text").mapInPandas(run, "doc_id string, n_tokens long, ids binary" + ", decoded string" * decode)
    return as_long(made, "doc_id")


def decoded(tokens: DataFrame, model_path: str = "") -> DataFrame:
    """tokens plus decoded, the text of ids as encoded() gives them (null: null)."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        p = pieces(model_path)
        return ids.map(lambda x: None if x is None else p.decode(x))

    return tokens.withColumn("decoded", text("ids"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), decode=True)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
