"""Operator 2: concatenate and cut. Prefix sums over the token totals of the
partitions give every document its global offset; fixed windows then cut it."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, as_text, written
from .tokens import Vocabulary, tokenised

SEQUENCE = 2048
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _natural(name: str) -> list:
    """Order of names by the numbers in them: part-100000 after part-99999."""
    return [int(x) if x.isdigit() else x for x in re.split("([0-9]+)", name)]


def with_offsets(tokens: DataFrame) -> DataFrame:
    """tokens plus base, the tokens of all rows before each one: of files by
    name and place in them, so that what was written in an order is packed in
    it; of other rows by partition.

    First pass: a total for each piece of a file that one task read. Their
    running sum has one row a piece (some thousands, whatever the rows), which
    bounds what is sorted in one place and broadcast.
    """
    totals = tokens.groupBy("file", "block", "part").agg(F.sum("n_tokens").alias("t")).collect()
    at, rows = 0, []
    for r in sorted(totals, key=lambda r: (_natural(r.file), r.block, r.part)):
        rows.append((r.file, r.block, r.part, at))
        at += r.t
    offsets = tokens.sparkSession.createDataFrame(rows, "file string, block long, part int, before long")
    return tokens.join(F.broadcast(offsets), ["file", "block", "part"]).withColumn("base", F.col("before") + F.col("start"))


def cut(tokens: DataFrame, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of with_offsets(): a row for each part of a
    document that lies within one window of size tokens; a document that crosses
    window boundaries has a piece on each side. with_ids adds the ids (binary,
    little-endian 16-bit)."""

    def run(batches):
        for pdf in batches:
            out = []
            for doc, raw, base in zip(pdf["doc_id"], pdf["ids"], pdf["base"]):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                n, low = len(ids), 0
                while low < n:
                    high = min(n, low + size - (base + low) % size)
                    piece = (doc, low, high - low, zlib.crc32(ids[low:high].tobytes()), n, (base + low) // size, (base + low) % size)
                    out.append((*piece, raw[2 * low: 2 * high]) if with_ids else piece)
                    low = high
            names = [c.split()[0] for c in _PIECES.split(", ")] + ["ids"] * with_ids
            yield pd.DataFrame(out, columns=names)

    made = tokens.select(as_text("doc_id"), "ids", "base").mapInPandas(run, _PIECES.replace("doc_id long", "doc_id string") + ", ids binary" * with_ids)
    return as_long(made, "doc_id")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) from pieces with ids: at most size tokens
    meet in a group."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = F.aggregate(joined, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), whole.alias("ids"))


def packed(docs: DataFrame, v: Vocabulary = Vocabulary(), size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of docs, in sequences of size tokens without padding
    but for the last.

    The tokens are written once (16 bits an id), so both passes see the same
    rows in the same partitions and each text is encoded once; nothing is
    shuffled but the partition totals. A null or empty text is its end id alone.
    Repeated rows are packed each for itself; an empty table gives no pieces.
    Rows of files keep the order of the files' names and of their rows.
    Columns other than doc_id and text are not read.
    """
    return cut(with_offsets(written(tokenised(docs, v), "tokens")), size, with_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
