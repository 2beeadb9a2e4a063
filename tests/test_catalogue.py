"""Queries of the catalogue against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from linkloom.plans import audits, catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Dear ones are run by the driver at its own size.
CHECKED = [
    "link_exact_words", "kb_alias_index", "alias_conflicts_part", "kb_profile_part", "fuzzy_trigram", "link_one_way_words", "decide_words", "rerank_blend", "ner_merge",
    "span_audit", "context_window", "mark_mention", "coref_single", "coref_ordinal", "coref_groups", "cluster_backlink", "sentence_index", "vector_topk", "vector_components",
    "eval_linking", "eval_breakdown", "eval_sets", "off_on_compare", "most_common", "exact_duplicates", "kb_upsert", "trace_runs", "trace_audit_explode", "llm_parse", "hard_negatives", "passage_text",
]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 9)
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", audits.ORACLE)
def test_audits_same_as_sql(spark, duck, name):
    got, want = audits.QUERIES[name](spark, SF).toPandas(), duck.sql(audits.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)


def test_every_query_is_a_callable():
    assert len(catalogue.QUERIES) > 50 and set(catalogue.ORACLE) <= set(catalogue.QUERIES)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) | set(audits.QUERIES) <= set(entry.queries()) and entry.entry(spark).columns
