"""Token ids of whole texts as little-endian 16-bit arrays."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, as_text

@dataclass(frozen=True)
class Vocabulary:
    """The tokenizer's file, and the same vocabulary as ranks, whose encoder is
    faster. An empty path stands for the installed file."""

    json_path: str = ""
    ranks_path: str = ""
    eos_id: int = 1


class Encoder:
    """A text's ids as little-endian 16-bit bytes. Texts that hold a special
    token's string go through the tokenizer itself, and so do those that the
    faster encoder refuses: its pattern gives up within white space of about a
    million signs."""

    def __init__(self, v: Vocabulary):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(v.json_path or public_tokenizers.path("byte_bpe_50k.json"))
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(v.ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            try:
                return self.plain.encode_to_numpy(text).astype("<u2").tobytes()
            except ValueError:
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def tokenised(docs: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """(file, block, part, start, doc_id, n_tokens, ids) of every row of docs.

    ids ends with v.eos_id; n_tokens counts it. file and block say which piece of
    which file a row was read from (none: an empty name), part which task read
    it, start how many tokens that piece has before the row. A null text counts
    as empty.
    """

    def run(batches):
        from pyspark import TaskContext

        encode, part, starts = Encoder(v), TaskContext.get().partitionId(), {}
        eos = np.array([v.eos_id], "<u2").tobytes()
        for pdf in batches:
            for low in range(0, len(pdf), 1000):
                some = pdf.iloc[low: low + 1000]
                ids = [encode(t or "") + eos for t in some["text"]]
                n, at = [len(x) // 2 for x in ids], []
                for key, k in zip(zip(some["file"], some["block"]), n):
                    at.append(starts.get(key, 0))
                    starts[key] = at[-1] + k
                yield pd.DataFrame({
                    "file": some["file"].to_numpy(), "block": some["block"].to_numpy(), "part": np.int32(part), "start": at,
                    "doc_id": some["doc_id"].to_numpy(), "n_tokens": n, "ids": ids,
                })

    rows = docs.select(as_text("doc_id"), "text", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"))
    return as_long(rows.mapInPandas(run, "file string, block long, part int, start long, doc_id string, n_tokens long, ids binary"), "doc_id")
