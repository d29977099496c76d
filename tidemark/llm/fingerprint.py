"""Operator 7: canonical exact digests. Unicode normalisation, case and white
space folding, a 128-bit xxhash, and byte comparison inside equal buckets; all
of it DataFrame and SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Most rows of a table (of ids or hashes) that is broadcast.
BROADCAST_ROWS = 200_000
#: Documents of a bucket of consecutive ids, about.
BUCKET_ROWS = 2000
BUCKET_RUN = 1000  # bucket numbers that are put in order in one task
_FIRST_LEVEL = 512

#: White space that NFKC leaves, without the blank: such a run, or one of
#: several blanks, is replaced; single blanks, nearly all runs, are passed over.
_SPACE = r"\t-\r\x1C-\x1F\x85\x{1680}\x{2028}\x{2029}"
_RUNS = f" {{2,}}[ {_SPACE}]*| ?[{_SPACE}][ {_SPACE}]*"


def normalised(t: Column) -> Column:
    """The NFKC form of a text, by the Unicode library that Spark ships for its
    collations (java_method calls it in the executor's JVM)."""
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))


def case_folded(t: Column) -> Column:
    """Full Unicode case folding, by the same library."""
    return F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), t, F.lit(True))


def canonical(t: Column) -> Column:
    """Normalised, case folded and normalised again, each run of white space a
    blank, none at the ends. Null is empty. ASCII texts need lower case only."""
    x = F.coalesce(t, F.lit(""))
    folded = F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(normalised(case_folded(normalised(x))))
    return F.trim(F.regexp_replace(folded, _RUNS, " "))


def wide_hash(c: Column) -> Column:
    """128 bits of xxhash64 under two seeds, in hexadecimal."""
    part = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), c))), 16, "0") for seed in (1, 2)]
    return F.concat(*part)


def keyed(docs: DataFrame, text: str, out: str, digest=wide_hash) -> DataFrame:
    """docs plus a key of the canonical text: its hash, then its SHA-256. The
    canonical text is made once for both."""
    c = docs.withColumn("_c", canonical(F.col(text)))
    return c.withColumn(out, F.concat(digest(F.col("_c")), F.sha2(F.col("_c").cast("binary"), 256))).drop("_c")


def hash_of(key: Column) -> Column:
    return F.substring(key, F.lit(1), F.length(key) - 64)


def compared(docs: DataFrame, keys: DataFrame, digest=wide_hash) -> None:
    """Raises where two of docs' canonical texts have the same key (one of keys)
    but unlike bytes. Only rows whose hash occurs twice can, so only those bring
    their texts, equal ones merged before the shuffle."""
    twice = written(keys.groupBy(hash_of(F.col("key")).alias("hash")).agg(F.sum("n").alias("n")).where("n > 1").select("hash"), "twice")
    few = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    c = docs.select(canonical(F.col("text")).alias("canon")).withColumn("hash", digest(F.col("canon")))
    texts = c.join(few, "hash", "left_semi").groupBy("hash", "canon").agg(F.lit(1).alias("one"))
    wrong = texts.groupBy("hash", F.sha2(F.col("canon").cast("binary"), 256).alias("sha")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not wrong.isEmpty():
        raise RuntimeError("unlike texts have the same hash and the same SHA-256")


def numbered(keys: DataFrame) -> DataFrame | None:
    """(key, number) of the keys whose hash several of keys share, from 0 in
    their order; None where there are none, as is to be expected."""
    h = hash_of(F.col("key"))
    clash = written(keys.groupBy(h.alias("hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "clashes")
    if clash.isEmpty():
        return None
    at = F.row_number().over(Window.partitionBy("hash").orderBy("key")) - 1
    return keys.withColumn("hash", h).join(clash, "hash", "left_semi").select("key", at.alias("number"))


def _buckets(docs: DataFrame) -> Column:
    """An expression of doc_id that grows with it, for buckets of about
    BUCKET_ROWS consecutive ids: quantiles, each cut evenly. Null ids: -1."""
    i = F.col("doc_id")
    n = docs.agg(F.count("doc_id")).first()[0]
    first = max(1, min(_FIRST_LEVEL, n // BUCKET_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / first for k in range(1, first)] or [0.5], 10_000)).first()[0] if n else None
    cuts = sorted(set(cuts or [])) if first > 1 else []
    outer = F.size(F.filter(F.array(*(F.lit(int(c)).cast("long") for c in cuts)), lambda c: c < i)) if cuts else F.lit(0)
    each = -(-n // (first * BUCKET_ROWS)) if n else 1
    if each <= 1:
        return F.when(i.isNull(), F.lit(-1)).otherwise(outer).cast("long")
    spans = docs.where(i.isNotNull()).groupBy(outer.alias("b")).agg(F.min(i).alias("lo"), F.max(i).alias("hi")).collect()
    lo = F.element_at(F.create_map(*(F.lit(x) for r in spans for x in (r.b, r.lo))), outer)
    width = F.element_at(F.create_map(*(F.lit(x) for r in spans for x in (r.b, max(1, -(-(r.hi - r.lo + 1) // each))))), outer)
    inner = F.floor((i - lo) / width)
    return F.when(i.isNull(), F.lit(-1)).otherwise(outer.cast("long") * (each + 1) + inner).cast("long")


def _following(heads: DataFrame) -> DataFrame:
    """(b, head, to) of heads (bucket, head), to being the next higher bucket;
    the highest is followed by the lowest.

    Buckets are ordered within runs of BUCKET_RUN bucket numbers. The last bucket
    of a run is followed by the least of the next run that has any, so only a row
    a run, one in BUCKET_ROWS * BUCKET_RUN documents, meets in one task.
    """
    h = heads.withColumn("run", F.floor(F.col("bucket") / BUCKET_RUN))
    runs = h.groupBy("run").agg(F.min("bucket").alias("low"))
    over_runs, whole = Window.orderBy(F.desc("run")), Window.partitionBy()
    runs = runs.select("run", F.coalesce(F.lag("low").over(over_runs), F.min("low").over(whole)).alias("next_run"))
    within = h.withColumn("up", F.lag("bucket").over(Window.partitionBy("run").orderBy(F.desc("bucket"))))
    return within.join(runs, "run").select(F.col("bucket").alias("b"), "head", F.coalesce("up", "next_run").alias("to"))


def with_next(docs: DataFrame, digest=wide_hash) -> DataFrame:
    """(doc_id, text, key) of docs plus next_text and next_key, those of the row
    that follows by descending doc_id (nulls last, ties by text); the first
    follows the last.

    Rows are sorted within buckets of consecutive ids, so no task holds all of
    them. The first row of each bucket is also put at the end of the bucket
    before it; buckets are one in BUCKET_ROWS, and their ids' number decides
    whether they are broadcast.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("bucket", _buckets(docs))
    heads = written(d.groupBy("bucket").agg(F.max("doc_id").alias("head")), "heads")
    ends = _following(heads)
    few = F.broadcast(ends) if heads.count() <= BROADCAST_ROWS else ends
    ghosts = d.join(few, (d.bucket == few.b) & d.doc_id.eqNullSafe(few["head"])).groupBy("to").agg(F.min("text").alias("text"))
    ghosts = ghosts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("bucket"), F.lit(1).alias("ghost"))
    both = keyed(d.select("doc_id", "text", "bucket", F.lit(0).alias("ghost")).union(ghosts), "text", "key", digest)
    w = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    after = both.select("*", F.lead("text").over(w).alias("next_text"), F.lead("key").over(w).alias("next_key"))
    return after.where("ghost = 0").drop("ghost", "bucket")


def edited(docs: DataFrame, digest=wide_hash) -> DataFrame:
    """with_next() plus n_chars and edited_text: the last half of the code
    points replaced by as many from the start of the next text, or all."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    return with_next(docs, digest).select(
        "doc_id", "key", "next_key", n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited_text"),
    )


def fingerprints(docs: DataFrame, digest=wide_hash) -> DataFrame:
    """Fingerprints of every row's text and edited text, and whether they meet
    (an exact digest's likeness is 1 or 0).

    A fingerprint is the hash; where unlike texts share it, all but the first
    have a number after it. Documents in equal buckets are compared by their
    bytes; edited texts, which are not kept, by SHA-256. Each text is put in
    order, shuffled and edited once, and only figures of it are written.

    One row for each row of docs, repeated ones included; null texts count as
    empty, null ids come last. An empty table gives no rows. Columns other than
    doc_id and text are not read.
    """
    made = written(
        keyed(edited(docs, digest), "edited_text", "edited_key", digest)
        .select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "key", "edited_key", "next_key"),
        "edited",
    )
    own = made.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    compared(docs, own, digest)
    several = numbered(made.select("key").union(made.select("edited_key")).distinct())

    def fingerprint(df: DataFrame, key: str, out: str) -> DataFrame:
        if several is None:
            return df.withColumn(out, hash_of(F.col(key)))
        more = F.when(F.coalesce("number", F.lit(0)) == 0, "").otherwise(F.concat(F.lit("-"), F.col("number").cast("string")))
        return df.join(several.withColumnRenamed("key", key), key, "left").withColumn(out, F.concat(hash_of(F.col(key)), more)).drop("number")

    return fingerprint(fingerprint(made, "key", "fingerprint"), "edited_key", "edited_fingerprint").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        (F.col("key") == F.col("edited_key")).cast("double").alias("near_edited"), (F.col("key") == F.col("next_key")).cast("double").alias("near_next"),
    )


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of every document and the SHA-256 of its edited text."""
    made = edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"))
