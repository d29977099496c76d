"""Queries over parts of operators against their SQL, on odd rows too."""

import duckdb
import pytest

from tidemark.llm import fingerprint, qualityrules, registry

ODD = [
    None, "", " ", "\n\n\t\n", "a", "a b", "a b c", "a b c a b c", "x x x x x", "one\ntwo\n one\none\r\none", "tab\tsep\vv\ff\x1cfs\x85nel\xa0nbsp em　wide",
    "$ % & | < > # * plain", "näïve 日本語 \U0001f600 " * 20, "same line here\n" * 30, "word " * 3000, " ".join(f"w{i}" for i in range(60)),
]


@pytest.mark.parametrize("name", ["quality_rule_counts", "edited_texts"])
def test_like_sql(spark, sf, tmp_path, name):
    odd = tmp_path / "odd"
    odd.mkdir()
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").toPandas().to_parquet(odd / "documents.parquet")
    for folder in (str(odd), sf):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        got = registry.QUERIES[name](spark, folder)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 10


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert not qualityrules.based(qualityrules.counted(none)).count() and not fingerprint.edited(none).count()
