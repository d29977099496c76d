"""Operator 4: temperature mixing of sources. Token shares are raised to an
exponent that is bisected to meet a target entropy or repetition limit; the
weights are realised as budgeted permutations of blocks of each source."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Most sources whose table is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 20_000
_SECTIONS = 16
MADE = ("mix_tokens", "mix_weight", "mix_copies", "mix_position")


@dataclass(frozen=True)
class Params:
    """Exactly one of entropy (nats) and max_repetition is given.

    budget_tokens None: the budget at which the least repeated source is passed
    exactly once, so no document is left out.
    """

    max_repetition: float | None = 4.0
    entropy: float | None = None
    budget_tokens: float | None = None
    seed: int = 20240229
    block_rows: int = 2000


def words(text: Column) -> Column:
    """Tokens of a text for the shares: runs without white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def _key(source: Column) -> Column:
    """A source as a string that is never null; null is a source of its own."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("v"), source.cast("string")))


def exponent(totals: DataFrame, p: Params) -> tuple[float, float, float]:
    """(exponent, normaliser, budget) for the table (key, tokens) of sources.

    1 keeps the shares and 0 makes sources equal; entropy and repetition fall as
    the exponent grows. It is searched from 0 to 1, or to 16 for an entropy
    below that of the shares. Each job cuts the range in sixteen parts (four
    bisections at once) and returns sums only. A limit that no exponent of the
    range meets is an error; for an entropy above that of equal sources, they
    are made equal.
    """
    t = totals.where("tokens > 0")
    total, least, most = t.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not total:
        return 1.0, 1.0, 0.0
    share = F.col("tokens") / F.lit(float(total))

    def figures(exponents: list[float]) -> list[tuple[float, float, float]]:
        """(normaliser, entropy, most passes of a source) of each exponent."""
        row = t.agg(*(x for a in exponents for x in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share))))).first()
        out = []
        for k, a in enumerate(exponents):
            z, s = row[2 * k], row[2 * k + 1]
            budget = p.budget_tokens or most * z / (most / total) ** a
            out.append((z, math.log(z) - a * s / z, max((x / total) ** a / z * budget / x for x in (least, most))))
        return out

    def fits(f: tuple[float, float, float]) -> bool:
        return f[1] <= p.entropy if p.entropy is not None else f[2] <= p.max_repetition

    low, high = 0.0, 1.0 if p.entropy is None else 16.0
    if fits(figures([0.0])[0]):
        high = 0.0
    for _ in range(9 if high else 0):
        grid = [low + (high - low) * k / _SECTIONS for k in range(1, _SECTIONS)]
        good = [fits(f) for f in figures(grid)]
        k = good.index(True) if True in good else len(grid)
        low, high = ([low] + grid)[k], (grid + [high])[k]
    best = figures([high])[0]
    if not (fits(best) or p.max_repetition is not None and best[2] <= p.max_repetition * (1 + 1e-9)):
        raise ValueError(f"no exponent to {high} meets {p}: entropy {best[1]}, most passes {best[2]}")
    z = best[0]
    return high, z, float(p.budget_tokens or most * z / (most / total) ** high)


def _position(doc_id: Column, text: Column, epoch: Column, p: Params) -> Column:
    return F.xxhash64(F.lit(p.seed), epoch, doc_id, F.xxhash64(F.coalesce(text, F.lit(""))))


def plan(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row a source: key, tokens, weight, passes (whole), and last, the
    position up to which the pass after those goes (null: nowhere).

    In each pass a source's documents come in the order of a hash of the pass
    and the document, cut into blocks by its leading bits. Block totals give
    where the budget ends; only documents of that one block are then ranked, so
    no source, however large, is sorted or gathered.
    """
    slim = written(
        docs.select(_key(F.col("source")).alias("key"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"), words(F.col("text")).alias("tokens")),
        "mixing",
    )
    totals = written(slim.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "sources")
    alpha, z, budget = exponent(totals, p)
    total, rows, sources = totals.agg(F.sum("tokens"), F.max("n"), F.count(F.lit(1))).first()
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(alpha)) / F.lit(z)).otherwise(0.0)
    wanted = F.col("weight") * F.lit(budget)
    s = (
        totals.withColumn("weight", weight)
        # a whole number of passes is not missed by a rounding of the last bit
        .withColumn("passes", F.when(F.col("tokens") > 0, F.floor(wanted / F.col("tokens") + 1e-9)).otherwise(1).cast("long"))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.greatest(F.lit(0.0), wanted - F.col("passes") * F.col("tokens"))).otherwise(0.0))
    )
    s = written(s, "plan")
    bits = max(1, min(40, math.ceil(math.log2(max(2, (rows or 0) / p.block_rows)))))
    few = F.broadcast(s) if (sources or 0) <= BROADCAST_SOURCES else s
    at = slim.join(few.select("key", "passes", "rest"), "key").where("rest > 0 and tokens > 0")
    at = at.withColumn("position", F.xxhash64(F.lit(p.seed), F.col("passes"), "doc_id", "text"))
    at = at.withColumn("block", F.shiftright("position", 64 - bits))
    blocks = at.groupBy("key", "block", "rest").agg(F.sum("tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = blocks.withColumn("before", before).where("before <= rest and before + t > rest").select("key", "block", "before")
    inside = at.join(F.broadcast(edge) if (sources or 0) <= BROADCAST_SOURCES else edge, ["key", "block"])
    so_far = F.sum("tokens").over(Window.partitionBy("key").orderBy("position"))
    ends = inside.withColumn("upto", F.col("before") + so_far).groupBy("key", "block").agg(F.max(F.when(2 * F.col("upto") - F.col("tokens") <= 2 * F.col("rest"), F.col("position"))).alias("p"))
    ends = ends.select("key", F.coalesce("p", F.greatest(F.shiftleft(F.col("block"), 64 - bits), F.lit(1 - (1 << 63))) - 1).alias("last"))
    out = s.join(ends, "key", "left")
    # where the rest is nothing no document follows; where no block holds the edge all of them do
    last = F.when(F.col("rest") <= 0, F.lit(None).cast("long")).otherwise(F.coalesce("last", F.lit((1 << 63) - 1)))
    return written(out.select("key", "tokens", "weight", "passes", last.alias("last")), "mix")


def mixed(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs plus mix_tokens, mix_weight, mix_copies (how often each row is
    taken) and mix_position (its place in the permutation of the first pass).

    Rows with equal doc_id and text share their position and so their copies.
    Texts that are null or without tokens are passed as often as their source; a
    source without tokens has weight 0 and one pass, so that nothing is lost for
    want of a share. An empty table gives no rows. Columns of docs that are
    named like one of the four give way to it; all others pass unread.
    """
    s = plan(docs, p)
    few = F.broadcast(s) if s.count() <= BROADCAST_SOURCES else s
    rows = docs.select(_key(F.col("source")).alias("key"), F.struct(*docs.columns).alias("row"))
    place = lambda epoch: _position(F.col("row.doc_id"), F.col("row.text"), epoch, p)
    more = F.coalesce(place(F.col("passes")) <= F.col("last"), F.lit(False))
    return rows.join(few.drop("tokens"), "key").select(
        *(F.col("row")[c].alias(c) for c in docs.columns if c not in MADE),
        words(F.col("row.text")).alias("mix_tokens"), F.col("weight").alias("mix_weight"),
        (F.col("passes") + more.cast("long")).alias("mix_copies"), place(F.lit(0).cast("long")).alias("mix_position"),
    )


def realised(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs, each as often as mixed() says, columns as given, pass
    by pass and within a pass in the order of its permutation of all sources'
    documents: written part by part, they are in that order. Nulls, repeated
    rows and empty tables are as in mixed(); columns named like its own are kept."""
    names = docs.columns
    m = mixed(docs.select(F.struct(*names).alias("row"), "doc_id", "source", "text"), p)
    epochs = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("mix_copies") - 1, F.lit(0)))
    m = m.where("mix_copies > 0").select("row", "doc_id", "text", F.explode(epochs).alias("epoch"))
    m = m.select("row", "epoch", _position(F.col("doc_id"), F.col("text"), F.col("epoch"), p).alias("position"))
    return m.repartitionByRange("epoch", "position").sortWithinPartitions("epoch", "position").select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, its source's weight, its copies at a repetition
    limit of 4 and its place in the first pass."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).select(
        "doc_id", "source", F.col("mix_tokens").alias("tokens"), F.col("mix_weight").alias("weight"), F.col("mix_copies").alias("copies"), F.col("mix_position").alias("position")
    )
