"""Shared helpers of the training-data operators: the shared folder, written
stages, document keys and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a temporary folder is made and set, but only
    on a local master, where driver and executors are one machine; elsewhere it
    is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = _LOCAL.get(sc.applicationId)
        if at is None:
            at = _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts the
    lineage, survives lost executors and is smaller than a checkpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for t in tables:
        jvm, sc = t.sparkSession._jvm, t.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def as_text(name: str):
    """A column of whole numbers as text on its way through pandas, where a
    null beside them would turn all into floating point; as_long reads it."""
    return F.col(name).cast("string").alias(name)


def as_long(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("long"))


def with_row_key(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """docs as (rid, <id_col>, <text_col>) with a unique long rid that follows
    the order of (id, text); carry adds all of docs' columns as a struct, row.

    rid is the id itself where ids are whole and unique, which one pass over the
    ids decides (own_ids of the result says so). Otherwise rows are ranked: range partitions are sorted and
    written, and partition offsets (one row a partition) are added.
    """
    row = ["row"] if carry else []
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col), *(F.struct(*docs.columns).alias(x) for x in row))
    n, whole, uniq = (
        d.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n"), F.sum(F.when(F.col(id_col).isNotNull(), F.col("n"))), F.count(F.lit(1)))
        .first()
    )
    if not n or (whole == n and uniq == n):
        out = d.select(F.col(id_col).cast("long").alias("rid"), id_col, text_col, *row)
        out.own_ids = True
        return out
    parts = max(1, min(2048, n // 20_000 + 1))
    ranged = d.repartitionByRange(parts, F.col(id_col).asc_nulls_first(), text_col).sortWithinPartitions(
        F.col(id_col).asc_nulls_first(), text_col
    )
    keyed = written(ranged.withColumn("m", F.monotonically_increasing_id()), "rowkey")
    part = F.shiftright("m", 33)
    sizes = keyed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c"))
    offsets = sizes.select(
        "p", (F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("o")
    )
    out = (
        keyed.withColumn("p", part)
        .join(F.broadcast(offsets), "p")
        .select((F.col("o") + F.col("m") - F.shiftleft(F.col("p"), 33)).alias("rid"), id_col, text_col, *row)
    )
    out.own_ids = False
    return out


def components(edges: DataFrame, most: int = 200) -> DataFrame:
    """(node, comp) of every node of edges (a, b); comp is the least node.

    Alternating large-star and small-star steps, each a grouped minimum and a
    join, written between rounds. A hub is only ever grouped with a map-side
    minimum; its rows are joined, never gathered. The rounds grow with the
    logarithm of the nodes; if the edges are no forest of stars after most of
    them, that is an error, not an answer.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(most):
        # done where every child has one parent and no parent is a child
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(e.select("b", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child + parent > 1")
        if open_.isEmpty():
            break
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        down = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        dropped(e)
        e = new
    else:
        raise RuntimeError(f"no components after {most} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
