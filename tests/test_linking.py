"""Operators on hand-made rows, against plain Python where there is more than a case."""

import json
import random

import pytest
from pyspark.sql import functions as F

from linkloom.functions import lexicons as lx
from linkloom.functions import text as tx
from linkloom.operators import aliases, candidates, coref, decide, metrics, ner, ports, quality, trace, vectors
from linkloom.plans import linking
from linkloom.sources import datasets, kb

ENTITIES = "entity_id string, standard_name string, aliases array<string>, entity_type string, description string, metadata map<string,string>, entity_ord long"
MENTIONS = "doc_id long, idx int, mention string, mention_type string, char_start int, char_end int, sentence_index int, role string, entity_id string, entity_name string, confidence double"


def entities(spark, rows):
    return spark.createDataFrame([(i, n, list(a), k, "", {}, o) for o, (i, n, a, k) in enumerate(rows)], ENTITIES)


def mention_rows(rows):
    return [(d, i, m, k, s, e, sent, "", ent, ent, 1.0) for d, i, m, k, s, e, sent, ent in rows]


def test_a_request_links_one_and_leaves_one_nil(spark):
    base = entities(spark, [("E1", "国家电网有限公司", ["国家电网", "国网"], "ORG"), ("E2", "南方电网", [], "ORG")])
    docs = spark.createDataFrame([(1, "国家电网与某某公司合作")], "doc_id long, text string")
    m = spark.createDataFrame([(1, 0, "国家电网", "ORG", 0, 4), (1, 1, "某某公司", "ORG", 5, 9)], "doc_id long, idx int, mention string, mention_type string, char_start int, char_end int")
    got = {r["mention"]: r for r in linking.link(docs, base, m).links.collect()}
    assert got["国家电网"]["entity_id"] == "E1" and got["国家电网"]["confidence"] == 0.95 and got["国家电网"]["reason"] == "entity_selected"
    assert got["某某公司"]["is_nil"] and got["某某公司"]["entity_id"] is None and got["某某公司"]["reason"] == "no_candidates"


def test_without_mentions_nothing_is_linked_unless_the_gazetteer_may_look(spark):
    base = entities(spark, [("E1", "国家电网", [], "ORG")])
    docs = spark.createDataFrame([(1, "国家电网发布公告")], "doc_id long, text string")
    assert linking.link(docs, base).links.count() == 0 and linking.link(docs, base).input_mode == "provided_mentions_required"
    found = linking.link(docs, base, None, linking.Options(allow_ner_fallback=True))
    assert [(r["mention"], r["entity_id"]) for r in found.links.collect()] == [("国家电网", "E1")]


def naive_fuzzy(mention, index, k=10):
    m, best = mention.strip(), {}
    for alias, owners in index.items():
        if not m or not (m in alias or alias in m):
            continue
        s, l = min(len(m), len(alias)), max(len(m), len(alias))
        if s < 3 or s / l < 0.5:
            continue
        score = 0.35 + 0.35 * (s / l) + 0.30 * (1.0 - (l - s) / l)
        for e in owners:
            if e not in best or score > best[e][0]:
                best[e] = (score, alias)
    ranked = sorted(((sc, len(a), e) for e, (sc, a) in best.items()), reverse=True)[:k]
    return [(e, round(sc, 9)) for sc, _, e in ranked]


@pytest.mark.parametrize("plan", ["nested", "trigram"])
def test_containment_candidates_as_in_plain_python(spark, plan):
    r = random.Random(3)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 8)))
    names = [(f"E{i:02}", word(), [word() for _ in range(2)], "ORG") for i in range(30)]
    index = {}
    for i, n, al, _ in names:
        for a in [n, *al]:
            index.setdefault(a, [])
            if i not in index[a]:
                index[a].append(i)
    ms = sorted({word() for _ in range(40)} | {" abab "})
    got = candidates.fuzzy(spark.createDataFrame([(m,) for m in ms], "mention string"), aliases.alias_index(entities(spark, names)), plan=plan).orderBy("mention", "rank").collect()
    for m in ms:
        assert [(x["entity_id"], round(x["score"], 9)) for x in got if x["mention"] == m] == naive_fuzzy(m, index)


def test_exact_comes_first_but_a_longer_name_may_win(spark):
    base = entities(spark, [("A", "abcdefghijklm", [], "ORG"), ("B", "abcdefghijklmn", [], "ORG")])
    m = spark.createDataFrame([("abcdefghijklm",)], "mention string")
    c = candidates.generate(m, aliases.alias_index(base))
    assert [(r["entity_id"], r["method"]) for r in c.orderBy("cand_ord").collect()] == [("A", "alias_exact"), ("B", "alias_fuzzy")]
    assert decide.decide(m, c, base).first()["entity_id"] == "B"  # 13/14 scores above an exact hit


def test_nil_threshold_keeps_equality(spark):
    df = spark.createDataFrame([("E", 0.95, 0.95), ("E", 0.94, 0.95), (None, 1.0, 0.5)], "e string, s double, t double")
    assert [r[0] for r in df.select(decide.is_nil(F.col("e"), F.col("s"), F.col("t"))).collect()] == [False, True, True]


def naive_gazetteer(text, names):
    held, out = [], []
    for a in sorted(names, key=len, reverse=True):
        at = text.find(a)
        while at != -1:
            if all(at + len(a) <= s or at >= e for s, e in held):
                held.append((at, at + len(a)))
                out.append((a, at))
                break
            at = text.find(a, at + 1)
    return sorted(out)


def test_gazetteer_as_in_plain_python(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    names = list(dict.fromkeys(word(r.randint(1, 5)) for _ in range(25)))
    texts = [word(r.randint(0, 30)) for _ in range(20)]
    al = spark.createDataFrame([(a, i, "ORG") for i, a in enumerate(names)], "alias string, alias_ord int, entity_type string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ner.gazetteer(docs, al).collect()
    for i, text in enumerate(texts):
        assert sorted((x["mention"], x["char_start"]) for x in got if x["doc_id"] == i) == naive_gazetteer(text, names)


def test_collective_references(spark):
    docs = spark.createDataFrame([(1, "甲公司和乙公司签约，双方表示满意"), (2, "甲公司签约。乙公司到场，双方满意"), (3, "甲公司、乙公司和丙公司，三方满意"), (4, "甲公司和甲公司，双方满意")], "doc_id long, text string")
    m = mention_rows([
        (1, 0, "甲公司", "ORG", 0, 3, 0, "A"), (1, 1, "乙公司", "ORG", 4, 7, 0, "B"), (1, 2, "双方", "PRON", 10, 12, 0, None),
        (2, 0, "甲公司", "ORG", 0, 3, 0, "A"), (2, 1, "乙公司", "ORG", 6, 9, 1, "B"), (2, 2, "双方", "PRON", 12, 14, 1, None),
        (3, 0, "甲公司", "ORG", 0, 3, 0, "A"), (3, 1, "乙公司", "ORG", 4, 7, 0, "B"), (3, 2, "丙公司", "ORG", 8, 11, 0, "C"), (3, 3, "三方", "PRON", 12, 14, 0, None),
        (4, 0, "甲公司", "ORG", 0, 3, 0, "A"), (4, 1, "甲公司", "ORG", 4, 7, 0, "A"), (4, 2, "双方", "PRON", 8, 10, 0, None),
    ])
    got = {r["doc_id"]: (r["entity_ids"], r["is_nil"]) for r in coref.collective(docs, spark.createDataFrame(m, MENTIONS)).collect()}
    assert got == {1: (["A", "B"], False), 2: ([], True), 3: (["A", "B", "C"], False), 4: ([], True)}


def test_an_ambiguous_collective_is_rejected(spark):
    text = "甲和乙签约，丙和丁合作，随后戊宣布，双方满意"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    at = lambda w: (text.index(w), text.index(w) + len(w))
    rows = [(1, i, w, "ORG", *at(w), 0, w.upper() + "1") for i, w in enumerate("甲乙丙丁戊")] + [(1, 5, "双方", "PRON", *at("双方"), 0, None)]
    df = spark.createDataFrame(mention_rows(rows), MENTIONS)
    assert coref.collective(docs, df).first()["rule"] == "collective_ambiguity_rejection"
    kept = coref.collective(docs, df, reject_ambiguous=False).first()
    assert kept["entity_ids"] == ["丙1", "丁1"] and not kept["is_nil"]


def test_joins_and_fold_agree_where_anaphors_cannot_chain(spark):
    r, rows = random.Random(7), []
    for d in range(12):
        for i in range(8):
            named = r.random() < 0.5
            rows.append((d, i, "名" if named else r.choice(["该公司", "他", "它", "前者", "后者"]), r.choice(["ORG", "PERSON", "GPE"]) if named else "PRON", i, i + 1, i // 2, f"E{r.randint(0, 4)}" if named else None))
    df = spark.createDataFrame(mention_rows(rows), MENTIONS)
    docs = spark.createDataFrame([(d, "x" * 40) for d in range(12)], "doc_id long, text string")
    key = lambda t: sorted((x["doc_id"], x["idx"], x["entity_id"], round(x["score"], 9), x["rule"]) for x in t.collect() if x["rule"] != "linked_name")
    assert key(coref.resolve(docs, df)) == key(coref.fold(df))


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([("A", "A", True), ("A", "B", True), ("A", None, True), (None, None, True), (None, "B", True), ("A", None, False)], "gold_id string, pred_id string, found boolean")
    m = metrics.linking_metrics(rows).first()
    assert (m["total"], m["correct"], m["nil_tp"], m["nil_fp"], m["nil_fn"], m["missing"]) == (6, 2, 1, 1, 1, 1) and m["linking_accuracy"] == 0.25
    assert {r["outcome"]: r["n"] for r in quality.histogram(rows, metrics.outcome(), "outcome").collect()} == {"correct": 2, "wrong_entity": 1, "nil_false_positive": 1, "nil_false_negative": 1, "missing_prediction": 1}


def test_text_functions(spark):
    row = spark.createDataFrame([("a　 b\u001cC", "第一句。第二句！", "国家电网成立于2020年，国家电网")], "a string, b string, c string")
    got = row.select(
        tx.normal_mention(F.col("a")).alias("n"), tx.sentence_index(F.col("b"), F.lit(5)).alias("s"), tx.sentences(F.col("b")).alias("p"),
        tx.mark_mention(F.col("c"), F.lit("国家电网"), F.lit(13), F.lit(17)).alias("m"), tx.context_clues(F.col("c"), F.lit("国家电网")).alias("k"),
        tx.parse_answer(F.lit('{"entity_id": "E2"}'), F.array(F.lit("E1"), F.lit("E2"))).alias("j"),
    ).first()
    assert got["n"] == "abc" and got["s"] == 1 and [(p["start"], p["end"]) for p in got["p"]] == [(0, 4), (4, 8)]
    assert got["m"].endswith("[*]国家电网[/*]") and "动作/状态：成立" in got["k"] and "时间：2020年" in got["k"] and got["j"] == "E2"


def test_readers(spark, tmp_path):
    (tmp_path / "kb.json").write_text(json.dumps({"deep": [{"entity_id": "E1", "entity_name": "名", "aliases": ["a", {"name": "b"}], "type": "nt", "tags": ["x"]}, {"entity_id": "", "standard_name": "无"}]}), encoding="utf-8")
    got = kb.read_json_kb(spark, str(tmp_path / "kb.json")).collect()
    assert [(r["entity_id"], r["standard_name"], r["aliases"], r["entity_type"]) for r in got] == [("E1", "名", ["a", "b"], "ORG")]
    assert kb.read_json_kb(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(NotImplementedError):
        kb.reader("neo4j")
    (tmp_path / "t.txt").write_text("一\n\n  \n二\n", encoding="utf-8")
    (tmp_path / "t.jsonl").write_text('{"text": "甲"}\nraw\n', encoding="utf-8")
    (tmp_path / "t.json").write_text('{"texts": ["x", " "]}', encoding="utf-8")
    texts = lambda n: sorted(r["text"] for r in datasets.read_texts(spark, str(tmp_path / n)).collect())
    assert texts("t.txt") == ["一", "二"] and texts("t.jsonl") == ["raw", "甲"] and texts("t.json") == ["x"]


def test_trace_store_replays_a_run(spark, tmp_path):
    base = entities(spark, [("E1", "国家电网", [], "ORG")])
    docs = spark.createDataFrame([(1, "国家电网和无名")], "doc_id long, text string")
    m = spark.createDataFrame([(1, 0, "国家电网", "ORG", 0, 4), (1, 1, "无名", "ORG", 5, 7)], "doc_id long, idx int, mention string, mention_type string, char_start int, char_end int")
    store = trace.TraceStore(spark, str(tmp_path))
    linking.record(store, "run1", linking.link(docs, base, m))
    got = store.trace("run1")
    assert got["pipeline_run"].first()["status"] == "success" and got["mention"].count() == 2 and got["candidate"].count() == 1
    assert got["link_result"].count() == 2 and got["audit_log"].count() == 4 and got["pipeline_step"].count() == 3 and store.runs().count() == 1


def test_upsert_reports_and_adds(spark):
    base = entities(spark, [("E1", "甲", ["a"], "ORG")])
    more = entities(spark, [("E1", "别", [], "ORG"), ("E2", "乙", ["a"], "ORG")])
    merged, issues = aliases.upsert(base, more, spark.createDataFrame([("E2", ["b"]), ("E9", ["c"])], "entity_id string, aliases array<string>"))
    assert {r["entity_id"]: r["aliases"] for r in merged.collect()} == {"E1": ["a"], "E2": ["a", "b"]}
    assert sorted((r["severity"], r["issue"], r["entity_id"]) for r in issues.collect()) == [("error", "duplicate_entity_id", "E1"), ("error", "unknown_entity_id", "E9"), ("warning", "alias_owned_elsewhere", "E2")]


def test_ports_have_stand_ins(spark):
    df = spark.createDataFrame([("k1", "p"), ("k2", "q"), ("k1", "p")], "key string, prompt string")
    cache = spark.createDataFrame([("k1", "E1")], "key string, result string")
    answers, new = ports.ask_with_cache(df, cache, ports.NoAnswer())
    assert {r["key"]: r["answer"] for r in answers.collect()} == {"k1": "E1", "k2": "NIL"} and new.count() == 1
    v = df.select(ports.HashEmbedder(8).embed(F.col("prompt")).alias("v")).first()["v"]
    assert len(v) == 8


def test_components_of_a_cycle_and_a_pair(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0), (5, 6)], "a long, b long")
    assert {r["node"]: r["comp"] for r in vectors.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5}


def test_options_come_from_text(monkeypatch):
    monkeypatch.setenv("LINKLOOM_NIL_THRESHOLD", "0.3")
    monkeypatch.setenv("LINKLOOM_ENABLE_COREFERENCE", "true")
    o = linking.Options.load()
    assert o.nil_threshold == 0.3 and o.enable_coreference and o.linkable_types == lx.LINKABLE_TYPES


def test_streams_equal_batches(spark, tmp_path):
    from linkloom.streaming import incremental

    base = entities(spark, [("E1", "国家电网", [], "ORG")])
    docs = spark.createDataFrame([(1, "国家电网发布"), (2, "无")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = incremental.link_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), base, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "mention", "entity_id").collect()
    assert [tuple(r) for r in got] == [(1, "国家电网", "E1")]
