import base64
import hashlib

import pytest

from tidemark.llm import warc


def _pages(spark):
    rows = [(5, "http://a", "<p>one</p>"), (2, "http://b\r\nX: y", "<p>one</p>"), (9, None, None), (4, "u", ""), (7, "u", "é" * 5000), (7, "u", "é" * 5000), (None, "u", "<p>null id</p>"), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n0\r\n\r\n"), (7, "u", "other")]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def _digest(h):
    return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


@pytest.mark.parametrize("segment", [300, 1 << 15])
def test_round_trip(spark, segment):
    rows, df = _pages(spark)
    got = warc.archived(df, segment_bytes=segment).collect()
    want, first = [], {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    used = set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        h = h or ""
        response = (i == first.get(h)) and h not in used
        used.add(h)
        want.append((i, len(h.encode()), _digest(h), "response" if response or i is None else "revisit", None if response or i is None else first[h]))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)


def test_payloads_and_least_size(spark, tmp_path):
    rows, df = _pages(spark)
    warc.write_archives(df, str(tmp_path / "a"), min_bytes=100_000, segment_bytes=200)
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert {r.record_type for r in got} == {"response"}
    assert sorted(r.payload.decode() for r in got) == sorted(h or "" for _, _, h in rows)
    assert warc.archived(df.limit(0)).count() == 0


def test_framing():
    for n in (0, 1, 4096, 10_000):
        data = bytes(i % 251 for i in range(n))
        assert warc.unchunked(warc.chunked(data)) == data
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab\r\n0\r\n\r\n")


def test_damage_is_found(spark):
    s = spark.createDataFrame([("o", "response", 1, None, "sha1:X", [(1, None, b"ab"), (3, 9, b"c")])], "origin string, type string, page_id long, refers_id string, digest string, parts array<struct<number:int,total:long,block:binary>>")
    with pytest.raises(Exception, match="segments are missing"):
        warc._decode(s).collect()


def test_oracle(spark):
    import duckdb

    from tidemark.llm import registry

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = registry.QUERIES["op3_warc"](spark, sf)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLE_SQL['op3_warc']})").fetchall()
    assert sorted(got.columns) == sorted(names) and sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want)


def test_very_long_page(spark):
    html = "<p>é</p>\r\n0\r\n" * 40_000
    df = spark.createDataFrame([(7, "http://a", html), (9, "http://b", html), (None, "http://c", "x")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archived(df).collect()}
    assert got[7].payload_bytes == got[9].payload_bytes == len(html.encode()) and got[9].refers_to == 7 and got[7].record_type == "response" and got[None].payload_bytes == 1
