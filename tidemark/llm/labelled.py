"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id, n: int):
    """crc32 of the id as text, mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def training_sample(docs: DataFrame, labels: DataFrame, label: str, hold_mod: int, hold_rest: int, per_class: int):
    """(rows, totals): at most per_class labelled rows of each class as
    (text, y), in hash order of their ids, and all training counts by class.

    The choice reads ids and labels only; its 2 * per_class ids are the proven
    bound of the broadcast that picks their texts out of the documents. Labels
    that are null are skipped; if an id has several, the largest counts. If
    several documents have an id, the least text is taken, so rows are bounded
    too.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(fold(F.col("doc_id"), hold_mod) != hold_rest)
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    totals = {int(r.positive): r.n for r in known.groupBy((F.col("y") > 0).alias("positive")).agg(F.count(F.lit(1)).alias("n")).collect()}
    part = [
        known.where((F.col("y") > 0) == F.lit(bool(y))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for y in (0, 1)
    ]
    chosen = part[0].union(part[1])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min((F.col("y") > 0).cast("int")).alias("y"))
    rows = some.toArrow().sort_by("doc_id")
    return rows.select(["text", "y"]).to_pandas(), totals
