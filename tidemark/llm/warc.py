"""Operator 3: WARC archives. Long records are written as segments with chunked
transfer framing; reading groups the continuations of each origin, orders them,
verifies the total length and decodes the framing."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

_END = b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Most bytes of a record's block, and of a chunk within it.
SEGMENT_BYTES = 1 << 15
CHUNK_BYTES = 1 << 12
#: Most records in a file: with SEGMENT_BYTES, the bound of what a reader holds.
RECORDS_PER_FILE = 1000


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(part), part) for k in range(0, len(payload), size) for part in [payload[k: k + size]]]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = data.index(_END, at)
        size = int(data[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(data[line + 2: line + 2 + size])
        if len(out[-1]) != size or data[line + 2 + size: line + 4 + size] != _END:
            raise ValueError("a chunk is cut short")
        at = line + 4 + size


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = [f"{k}: {''.join(c if c >= ' ' else '%%%02X' % ord(c) for c in str(v))}" for k, v in headers if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def _urn(page, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}/{digest}/{copy}')}>"


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages as (page_id, url, payload, digest, copy, first_page, response).

    Of rows with equal payloads of at least min_bytes, the one with the least
    page_id is the response (of several with that id and payload, copy 1);
    others are to revisit it. Payloads are compared by digest on narrow rows;
    the payload itself is shuffled once, by page. A null html is empty.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    # the key is never null, so that join and window share one partitioning
    p = p.withColumn("digest", F.sha1("payload")).withColumn("page_key", F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    slim = p.select("page_id", "page_key", "digest", (F.octet_length("payload") >= min_bytes).alias("shared"))
    once = slim.groupBy("page_key", "page_id", "digest", "shared").agg(F.lit(1).alias("one")).drop("one")
    first = once.where("shared").groupBy("digest").agg(F.min("page_id").alias("first_page"))
    plan = once.join(first, "digest", "left").select("page_key", "digest", "shared", "first_page")
    w = Window.partitionBy("page_key", "digest").orderBy("url")
    return (
        p.join(plan, ["page_key", "digest"])
        .withColumn("copy", F.row_number().over(w))
        .withColumn("response", ~F.col("shared") | (F.col("page_id").eqNullSafe(F.col("first_page")) & (F.col("copy") == 1)))
        .select("page_id", "url", "payload", "digest", "copy", "first_page", "response")
    )


def records(plan: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(record) of every row of decided(): one for each segment of a response,
    one for a revisit."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                page = None if pd.isna(r.page_id) else int(r.page_id)
                first = None if pd.isna(r.first_page) else int(r.first_page)
                own, digest = _urn(page, r.digest, r.copy), base32_sha1(r.payload)
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                common = [("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Target-URI", r.url), ("WARC-Page-ID", page), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if not r.response:
                    out.append(_record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Refers-To", _urn(first, r.digest, 1)), ("WARC-Profile", _PROFILE), *common], head))
                    continue
                block = head + chunked(r.payload)
                parts = [block[k: k + segment_bytes] for k in range(0, len(block), segment_bytes)]
                one = [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
                out.append(_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *one], parts[0]))
                for n, part in enumerate(parts[1:], 2):
                    total = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
                    out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, own + str(n))}>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", own), *total], part))
            yield pd.DataFrame({"record": out})

    return plan.mapInPandas(run, "record binary")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """A WARC record per row of pages, in files under path. The text sink puts
    the bytes as they are, ends each record with the format's two line ends and
    compresses the file, so writing has its retries and commits."""
    made = records(decided(pages, min_bytes), segment_bytes)
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def parsed(content: bytes):
    """(headers, block) of each record of a file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        at = end + 4 + size
        if content[at: at + 4] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield headers, content[end + 4: at]
        at += 4


_SEGMENTS = "origin string, type string, page_id long, refers_id string, digest string, number int, total long, block binary"


def _segments(files: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                out = []
                content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                for h, block in parsed(content):
                    n = int(h.get("WARC-Segment-Number", 0))
                    page, total = h.get("WARC-Page-ID"), h.get("WARC-Segment-Total-Length")
                    out.append((
                        h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), h["WARC-Type"], None if page is None else int(page), h.get("WARC-Refers-To"),
                        h.get("WARC-Payload-Digest"), n, None if total is None else int(total), block,
                    ))
                made = pd.DataFrame(out, columns=[c.split()[0] for c in _SEGMENTS.split(", ")])
                yield made.astype({"page_id": "Int64", "total": "Int64"})

    return files.select("content").mapInPandas(run, _SEGMENTS)


def _decode(blocks: DataFrame) -> DataFrame:
    """Rows with parts, the ordered (number, total, block) of one record, to
    its payload; total length and digest are verified."""

    def run(batches):
        for pdf in batches:
            out = []
            for parts, digest, kind in zip(pdf["parts"], pdf["digest"], pdf["type"]):
                if kind != "response":
                    out.append(None)
                    continue
                block = b"".join(x["block"] for x in parts)
                if len(parts) > 1 and ([x["number"] for x in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block)):
                    raise ValueError("segments are missing or their total length is wrong")
                head, _, body = block.partition(b"\r\n\r\n")
                payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                if digest != f"sha1:{base32_sha1(payload)}":
                    raise ValueError("a payload's digest is wrong")
                out.append(payload)
            yield pd.DataFrame({"record_id": pdf["origin"], "record_type": pdf["type"], "page_id": pdf["page_id"].astype("Int64"), "refers_id": pdf["refers_id"], "payload_digest": pdf["digest"].str.slice(5), "payload": out})

    return blocks.mapInPandas(run, "record_id string, record_type string, page_id long, refers_id string, payload_digest string, payload binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, page_id, refers_id, payload_digest, payload) of
    every record under path, segments put together; a revisit has no payload.

    Only segmented records are grouped, and a group is one record's segments.
    """
    s = _segments(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    part = F.struct("number", "total", "block")
    whole = s.where("number = 0").select("origin", "type", "page_id", "refers_id", "digest", F.array(part).alias("parts"))
    # of a record's segments only the first has the fields; the others' type must not count
    first = F.col("number") == 1
    cut = s.where("number > 0").groupBy("origin").agg(
        F.max(F.when(first, F.col("type"))).alias("type"), F.max(F.when(first, F.col("page_id"))).alias("page_id"), F.max(F.when(first, F.col("refers_id"))).alias("refers_id"),
        F.max(F.when(first, F.col("digest"))).alias("digest"), F.array_sort(F.collect_list(part)).alias("parts"),
    )
    return _decode(whole.unionByName(cut))


def resolved(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each
    record; a revisit's length and page come from the response it refers to."""
    slim = written(read.select("record_id", "record_type", "page_id", "refers_id", "payload_digest", F.octet_length("payload").cast("long").alias("n")), "records")
    first = slim.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("n").alias("m"))
    # responses, most of the rows, refer to nothing and take no part in the join
    own = slim.where("refers_id is null").select("page_id", F.col("n").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    others = slim.where("refers_id is not null").join(first, "refers_id", "left")
    return own.union(others.select("page_id", F.coalesce("n", "m"), "payload_digest", "record_type", "refers_to"))


def archived(pages: DataFrame, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """pages written to archives in the shared folder and read back, resolved.

    One row for each row of pages; repeated rows are records of their own, the
    later ones revisits; null page_ids stay null and null html is empty. An
    empty table gives no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes, segment_bytes)
    return resolved(read_archives(spark, path))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
