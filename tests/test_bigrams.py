"""Bigrams of neighbouring texts against brute force and SQL."""

import duckdb

from linkloom.operators import quality
from linkloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_previous_jaccard_as_sql(spark, tmp_path):
    texts = ["abc", "abcd", None, "xy", "x", "", "", "𝒳y𝒳y", "y𝒳"] * 40
    rows = [(i * 7 % len(texts), "one" if i % 9 < 7 else None if i % 2 else "two", x) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.bigram_jaccard(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.sql(catalogue.ORACLE["bigram_jaccard"]).fetchall()))


def test_texts_are_not_sorted_by_group_alone(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = catalogue.bigram_jaccard(spark, SF)
    assert "array_distinct" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(catalogue.ORACLE["bigram_jaccard"]).fetchall())


def test_previous_jaccard_without_rows(spark):
    assert quality.previous_jaccard(spark.createDataFrame([], "d long, s string, x string"), "d", "s", "x").count() == 0
