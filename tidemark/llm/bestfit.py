"""Operator 9: best-fit-decreasing packing with a segment tree over capacities;
packed id matrices, cumulative segment lengths and position resets, written."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, as_text, written
from .tokens import Vocabulary, tokenised

SEQUENCE = 2048
#: Tokens that a task gathers before it packs them: the bound of its memory.
BLOCK_TOKENS = 1 << 22
_MATRIX = (
    "part int, row long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, "
    "doc_ids array<long>, starts array<long>, doc_tokens array<long>"
)


class Capacities:
    """Open rows by the room they have: a segment tree counts the rows under
    each range of capacities, so the least one that suffices is found in
    log(size) steps."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the fullest row with room for need, removed."""
        at, count = need + self.leaves, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, row


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows of item numbers; items in decreasing length, each into the fullest
    row that holds it, ties by number. Every length is 1 to size."""
    rows: list[list[int]] = []
    room = Capacities(size)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = room.take(n)
        if found is None:
            found = (size, len(rows))
            rows.append([])
        left, row = found
        rows[row].append(i)
        if left > n:
            room.add(left - n, row)
    return rows


def matrices(tokens: DataFrame, size: int = SEQUENCE, block_tokens: int = BLOCK_TOKENS, pad_id: int = 0) -> DataFrame:
    """Rows of size ids from tokenised() rows, a task at a time in blocks of
    about block_tokens. ids and positions are little-endian 16-bit arrays of
    size numbers; positions restart at 0 with each segment (and with the
    padding); cu_seqlens starts with 0 and ends with n_tokens."""

    def emit(part, first, pieces):
        lengths = np.array([len(p[0]) for p in pieces], np.int64)
        out = []
        for k, row in enumerate(best_fit(lengths, size)):
            n = int(lengths[row].sum())
            ids = np.full(size, pad_id, "<u2")
            ids[:n] = np.concatenate([pieces[i][0] for i in row])
            ends = np.concatenate([[0], np.cumsum(lengths[row])])
            positions = np.concatenate([np.arange(x) for x in [*lengths[row], size - n]]).astype("<u2")
            out.append((part, first + k, n, ids.tobytes(), ends.astype(np.int32), positions.tobytes(), *([pieces[i][j] for i in row] for j in (1, 2, 3))))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _MATRIX.split(", ")])

    def run(batches):
        from pyspark import TaskContext

        part, held, pieces, row = TaskContext.get().partitionId(), 0, [], 0
        for pdf in batches:
            for doc, raw in zip(pdf["doc_id"], pdf["ids"]):
                ids = np.frombuffer(raw, "<u2")
                doc = None if doc is None else int(doc)
                pieces += [(ids[low: low + size], doc, low, len(ids)) for low in range(0, len(ids), size)]
                held += len(ids)
                if held >= block_tokens:
                    yield (made := emit(part, row, pieces))
                    row, held, pieces = row + len(made), 0, []
        if pieces:
            yield emit(part, row, pieces)

    return tokens.select(as_text("doc_id"), "ids").mapInPandas(run, _MATRIX)


def numbered(packed: DataFrame) -> DataFrame:
    """packed plus sequence_id, gapless over all partitions: the rows of the
    partitions before (one number a partition, which bounds the broadcast)."""
    at, rows = 0, []
    for r in packed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        rows.append((r.part, at))
        at += r.n
    offsets = packed.sparkSession.createDataFrame(rows, "part int, before long")
    return packed.join(F.broadcast(offsets), "part").withColumn("sequence_id", F.col("before") + F.col("row")).drop("before")


def token_matrices(docs: DataFrame, v: Vocabulary = Vocabulary(), size: int = SEQUENCE) -> DataFrame:
    """The packed matrices of all rows of docs, written and read again.

    Documents of more than size tokens are split without loss. A null or empty
    text is its end id alone; repeated rows are packed each for itself; an empty
    table gives no rows. Columns other than doc_id and text are not read.
    """
    return numbered(written(matrices(tokenised(docs, v), size), "matrices"))


def segments(packed: DataFrame) -> DataFrame:
    """A row for each segment of the matrices, cut out of them."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                ids = np.frombuffer(r.ids, "<u2").astype("<u4")
                for a, b, doc, start, n in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], r.doc_ids, r.starts, r.doc_tokens):
                    out.append((doc, start, b - a, zlib.crc32(ids[a:b].tobytes()), n, r.sequence_id, a))
            yield pd.DataFrame(out, columns=names)

    made = packed.select("ids", "cu_seqlens", F.col("doc_ids").cast("array<string>").alias("doc_ids"), "starts", "doc_tokens", "sequence_id").mapInPandas(
        run, ", ".join(f"{c} {'string' if c == 'doc_id' else 'long'}" for c in names)
    )
    return as_long(made, "doc_id")


def op9_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(token_matrices(spark.read.parquet(f"{sf_dir}/documents.parquet")))
