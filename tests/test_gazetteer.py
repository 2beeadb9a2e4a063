"""The gazetteer against its definition, and readers of many files."""

import json
import random

import pytest

from linkloom.operators import ner
from linkloom.plans import catalogue, linking
from linkloom.sources import kb

SF = "/root/testdata/sf0.001"


def greedy(text, aliases):
    """aliases: (alias, ord); longest first, each at its first place that overlaps nothing taken."""
    held, out = [], []
    for alias, _ in sorted(aliases, key=lambda a: (-len(a[0]), a[1], a[0])):
        at = text.find(alias)
        while at >= 0:
            end = at + len(alias)
            if all(end <= s or at >= e for s, e in held):
                held.append((at, end))
                out.append((alias, at, end))
                break
            at = text.find(alias, at + 1)
    return out


@pytest.mark.parametrize("part", [1000, 7])
def test_gazetteer_by_brute_force(spark, part):
    r = random.Random(3)
    aliases = [("".join(r.choice("abc") for _ in range(r.randrange(1, 5))), i) for i in range(30)]
    aliases = list({a: (a, i) for a, i in aliases}.values())
    texts = [(i, "".join(r.choice("abcd") for _ in range(r.randrange(60)))) for i in range(60)] + [(100, None), (101, "")]
    got = ner.gazetteer(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(a, i, "ORG") for a, i in aliases], "alias string, alias_ord long, entity_type string"), part)
    want = sorted((i, *x) for i, t in texts for x in greedy(t or "", aliases))
    assert sorted((x["doc_id"], x["mention"], x["char_start"], x["char_end"]) for x in got.collect()) == want


def test_gazetteer_query_on_whole_documents(spark):
    got = {}
    for x in catalogue.gazetteer_ner(spark, SF).collect():
        got.setdefault(x["doc_id"], []).append((x["mention"], x["char_start"], x["char_end"]))
    index = [(x["alias"], x["o"]) for x in catalogue.word_index(spark, SF).groupBy("alias").agg({"alias_ord": "min"}).toDF("alias", "o").collect()]
    for d in catalogue.t(spark, SF, "documents").collect():
        assert sorted(got.get(d["doc_id"], [])) == sorted(greedy(d["text"] or "", index))


def test_folder_of_files(spark, tmp_path):
    for k in range(8):
        (tmp_path / f"{k}.json").write_text(json.dumps({"entities": [{"entity_id": f"E{k}{i}", "standard_name": f"n{k}{i}"} for i in range(3)]}), encoding="utf-8")
    got = kb.read_json_kb(spark, str(tmp_path)).orderBy("entity_ord").collect()
    assert [x["entity_id"] for x in got] == [f"E{k}{i}" for k in range(8) for i in range(3)]


def test_order_column_of_a_table(spark):
    t = spark.createDataFrame([("a", "x", 2), ("b", "y", 1)], "id string, name string, at int")
    assert [x["entity_id"] for x in kb.from_table(t, entity_id="id", standard_name="name", entity_ord="at").orderBy("entity_ord").collect()] == ["b", "a"]


def test_whole_plan_on_raw_texts(spark):
    got = catalogue.link_documents(spark, SF)
    n = got.count()
    assert n > 0 and got.where("is_nil = false and entity_id is null").count() == 0
    assert linking.Options.of({"nil_threshold": "0.5"}).nil_threshold == 0.5


def test_texts_are_not_searched_again_for_each_step(spark):
    plan = catalogue.link_documents(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("documents.parquet") <= 4
