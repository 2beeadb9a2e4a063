"""Containment pairs by keys against brute force."""

import random

from pyspark.sql import functions as F

from linkloom.operators import candidates
from linkloom.plans import catalogue


def test_keys_find_what_brute_force_finds(spark):
    r = random.Random(3)
    words = {"".join(r.choice("ab𝒳") for _ in range(n)) for n in [*range(1, 9)] * 12 for _ in range(2)} | {"a" * n for n in (2, 3, 6, 15, 16, 17, 31, 32, 33, 34, 70)} | {("ab" * 30)[i : i + n] for i in (0, 1) for n in (15, 16, 17, 33, 60)}
    m, a = sorted(words), sorted(w for i, w in enumerate(sorted(words)) if i % 3)
    got = [tuple(x) for x in candidates.containment_pairs(spark.createDataFrame([(f" {x} ",) for x in m], "mention string"), spark.createDataFrame([(x,) for x in a], "alias string"), "trigram").select("stripped", "alias").collect()]
    want = {(x, y) for x in m for y in a if min(len(x), len(y)) >= 3 and 2 * min(len(x), len(y)) >= max(len(x), len(y)) and (x in y or y in x)}
    assert len(got) == len(set(got)) and set(got) == want


def test_hundreds_of_aliases_take_no_nested_loop(spark):
    words = [("w" + "".join(chr(97 + int(d)) for d in str(i)),) for i in range(300)]
    pairs = candidates.containment_pairs(spark.createDataFrame(words, "mention string"), spark.createDataFrame(words, "alias string"))
    assert "NestedLoopJoin" not in pairs._jdf.queryExecution().executedPlan().toString() and pairs.where(F.col("mention") == F.col("alias")).count() == 290


def test_texts_are_read_once_for_all_steps(spark):
    for query in (catalogue.decide_words, catalogue.link_by_language):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan
