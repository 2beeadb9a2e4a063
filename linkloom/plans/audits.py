"""More queries: profiles, contracts, metric suites, the model path, lookups and the trace, each over whole driver tables and in SQL.

Where an operator reads nested samples, the tables stand in for them: orders with their lines, dialogues with their turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import answers, coref, metrics, profiles, trace, validators, vectors
from .catalogue import EVAL, TALK, evaluated, micro, t, talk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def named(prefix: str, c):
    return F.concat(F.lit(prefix), c.cast("string"))


def part_entities(spark, sf) -> DataFrame:
    return t(spark, sf, "part").select(named("P", F.col("p_partkey")).alias("entity_id"), F.col("p_type").alias("entity_type"))


def samples(spark, sf) -> DataFrame:
    d = t(spark, sf, "documents").join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("difficulty"), F.col("source").alias("scenario"), F.when(F.col("quality") == 1, named("P", F.col("doc_id") % 300)).alias("gold_id"))


SAMPLES = """sm AS (SELECT d.doc_id AS id, d.text, d.lang AS difficulty, d.source AS scenario, CASE WHEN l.quality = 1 THEN 'P' || (d.doc_id % 300) END AS gold_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
    ty AS (SELECT sm.*, CASE WHEN gold_id IS NULL THEN 'NIL' ELSE coalesce(p.p_type, 'UNKNOWN') END AS entity_type FROM sm LEFT JOIN part p ON 'P' || p.p_partkey = gold_id)"""
BUCKET = "CASE WHEN length(coalesce(text, '')) < 30 THEN '<30' WHEN length(coalesce(text, '')) < 60 THEN '30-59' WHEN length(coalesce(text, '')) < 100 THEN '60-99' ELSE '>=100' END"


def long_form(table: str, measures: dict[str, str]) -> str:
    """SQL that counts rows of a table by each measure."""
    return " UNION ALL ".join(f"SELECT '{m}' AS measure, CAST({c} AS VARCHAR) AS bucket, CAST(count(*) AS BIGINT) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 2" for m, c in measures.items())


@query(f"WITH {SAMPLES} SELECT id, entity_type FROM ty")
def gold_types(spark, sf):
    return profiles.with_gold_type(samples(spark, sf), part_entities(spark, sf)).select("id", "entity_type")


@query(f"WITH {SAMPLES} {long_form('ty', {'label': "CASE WHEN gold_id IS NULL THEN 'nil' ELSE 'linked' END", 'difficulty': "coalesce(difficulty, 'unknown')", 'entity_type': 'entity_type', 'text_length': BUCKET})} UNION ALL SELECT 'scenarios', 'distinct', CAST(count(DISTINCT coalesce(scenario, '(none)')) AS BIGINT) FROM ty")
def profile_composite(spark, sf):
    return profiles.composite(profiles.with_gold_type(samples(spark, sf), part_entities(spark, sf)))


@query(f"WITH {SAMPLES} {long_form('(SELECT *, id % 4 AS k, CASE id % 3 WHEN 0 THEN ' + "'name' WHEN 1 THEN 'alias'" + ' END AS kind FROM sm)', {'label': "CASE WHEN gold_id IS NULL THEN 'nil' ELSE 'linked' END", 'difficulty': "coalesce(difficulty, 'unknown')", 'ambiguity_type': "coalesce(kind, 'unknown')", 'candidate_count': 'k', 'text_length': BUCKET})}")
def profile_fallback(spark, sf):
    i = F.col("id")
    listed = F.slice(F.array(*map(F.lit, "abc")), F.lit(1), (i % 4).cast("int"))
    kind = F.when(i % 3 == 0, "name").when(i % 3 == 1, "alias")
    return profiles.fallback(samples(spark, sf).select("text", "difficulty", F.col("gold_id").isNull().alias("expected_nil"), listed.alias("candidates"), kind.alias("ambiguity_type")))


def order_sets(spark, sf) -> DataFrame:
    """Of each order the distinct suppliers as candidates, and one of them or another as gold."""
    k = F.col("l_orderkey")
    s = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(named("S", F.col("l_suppkey") % 20))).alias("candidates"))
    return s.withColumn("gold_id", F.when(k % 5 != 0, named("S", k % 20)))


ORDER_SETS = "os AS (SELECT l_orderkey AS k, list_sort(list_distinct(list('S' || (l_suppkey % 20)))) AS cs, CASE WHEN l_orderkey % 5 <> 0 THEN 'S' || (l_orderkey % 20) END AS gold FROM lineitem GROUP BY l_orderkey)"


@query(f"WITH {ORDER_SETS} {long_form('os', {'label': "CASE WHEN gold IS NULL THEN 'nil_like' ELSE 'positive' END", 'gold_among': "CASE WHEN gold IS NOT NULL THEN CASE WHEN list_contains(cs, gold) THEN 'yes' ELSE 'no' END END", 'hard_negative': "CASE WHEN (gold IS NULL AND len(cs) > 0) OR len(list_filter(cs, lambda c: c <> gold)) > 0 THEN 'yes' END", 'candidate_count': 'len(cs)'})}")
def profile_candidates(spark, sf):
    return profiles.candidates(order_sets(spark, sf))


def dialogue_samples(spark, sf) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t(spark, sf, "conversations").withColumn("i", (F.row_number().over(w) - 1).cast("int"))
    user, n = F.col("role") == "user", F.length("text")
    mention = F.struct("i", F.when(user, "AAA").when(F.col("turn") % 3 == 0, "双方").otherwise("该公司").alias("mention"), F.when(user, named("E", n % 5)).alias("entity_id"), F.col("turn").cast("int").alias("sentence_index"))
    case = F.when(F.col("role") == "assistant", F.struct(F.col("i").alias("mention_index"), F.when(n % 4 != 0, named("E", n % 5)).alias("entity_id"), (n % 4 == 0).alias("is_nil")))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(mention)).alias("mentions"), F.collect_list(case).alias("cases"))
    return g.select("conv_id", F.transform("mentions", lambda m: F.struct(m["mention"].alias("mention"), m["entity_id"].alias("entity_id"), m["sentence_index"].alias("sentence_index"))).alias("mentions"), "cases")


@query(
    f"""WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn, role, length(text) AS n, CASE WHEN role = 'user' THEN 'AAA' WHEN turn % 3 = 0 THEN '双方' ELSE '该公司' END AS mention, CASE WHEN role = 'user' THEN 'E' || (length(text) % 5) END AS e FROM conversations),
    cs AS (SELECT conv_id, i, turn, mention, CASE WHEN n % 4 <> 0 THEN 'E' || (n % 5) END AS e FROM m WHERE role = 'assistant'),
    gp AS (SELECT cs.mention, cs.turn - max(m.turn) AS gap, any_value(cs.e) AS e FROM cs LEFT JOIN m ON m.conv_id = cs.conv_id AND m.i < cs.i AND m.e = cs.e GROUP BY cs.conv_id, cs.i, cs.turn, cs.mention),
    sp AS (SELECT m.conv_id, count(e) > 1 AS several, bool_or(role = 'assistant' AND n % 4 = 0) AS mixed FROM m GROUP BY m.conv_id)
    {long_form('gp', {'cases': "'all'", 'collective': "CASE WHEN mention = '双方' THEN 'yes' END", 'cross_sentence': "CASE WHEN gap >= 1 THEN 'yes' END", 'cross_three': "CASE WHEN gap >= 3 THEN 'yes' END", 'simple_single': "CASE WHEN gap <= 1 AND mention <> '双方' THEN 'yes' END", 'surface': 'mention'})}
    UNION ALL {long_form('sp', {'several_antecedents': "CASE WHEN several THEN 'yes' END", 'nil_mixed': "CASE WHEN mixed THEN 'yes' END"})}"""
)
def profile_coreference(spark, sf):
    return profiles.coreference(dialogue_samples(spark, sf))


@query(
    f"""WITH b AS (SELECT l_orderkey AS k, repeat('x', CAST(l_orderkey % 160 AS INTEGER)) || CASE WHEN l_orderkey % 7 = 0 THEN '该公司' ELSE '' END AS text, count(*) AS n, count(CASE WHEN l_suppkey % 3 <> 0 THEN 1 END) AS linked, count(DISTINCT l_partkey % 5) AS names FROM lineitem GROUP BY l_orderkey)
    {long_form('b', {'mention_count': 'n', 'long_text': "CASE WHEN length(text) >= 80 THEN 'yes' END", 'multi_mention': "CASE WHEN n > 1 THEN 'yes' END", 'nil_mixed': "CASE WHEN linked > 0 AND linked < n THEN 'yes' END", 'repeated_mention': "CASE WHEN names < n THEN 'yes' END", 'coreference_like': "CASE WHEN k % 7 = 0 THEN 'yes' END"})}"""
)
def profile_batch(spark, sf):
    k = F.col("l_orderkey")
    e = F.struct(named("m", F.col("l_partkey") % 5).alias("mention"), F.when(F.col("l_suppkey") % 3 != 0, named("P", F.col("l_partkey"))).alias("entity_id"))
    g = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(e).alias("expected"))
    return profiles.batch(g.select("expected", F.concat(F.expr("repeat('x', cast(l_orderkey % 160 as int))"), F.when(k % 7 == 0, "该公司").otherwise("")).alias("text")))


@query("SELECT event_type, CAST(count(value) AS BIGINT) AS calls, CAST(round(avg(value) * 10000) AS BIGINT) AS mean_e4 FROM events GROUP BY event_type")
def mean_latency(spark, sf):
    return profiles.mean_latency(t(spark, sf, "events"), "event_type", "value").select("event_type", "calls", F.round(F.col("mean_seconds") * 10000).cast("long").alias("mean_e4"))


CASES = """cs AS (SELECT l_orderkey AS k, list_sort(list('E' || (l_suppkey % 7))) AS ids, list_distinct(list('E' || (l_partkey % 7))) AS declared, l_orderkey % 2 = 0 AS coll, l_orderkey % 3 = 0 AS nil, CASE WHEN l_orderkey % 5 = 0 THEN 'E1' END AS e FROM lineitem GROUP BY l_orderkey)"""


@query(
    f"""WITH {CASES} SELECT k AS sample_id, 'invalid_collective_success_contract' AS issue FROM cs WHERE coll AND NOT nil AND (e IS NOT NULL OR len(ids) < 2 OR len(list_distinct(ids)) < len(ids) OR len(list_filter(ids, lambda x: NOT list_contains(declared, x))) > 0)
    UNION ALL SELECT k, 'invalid_collective_nil_contract' FROM cs WHERE coll AND nil AND (e IS NOT NULL OR len(ids) > 0) UNION ALL SELECT k, 'ordinary_nil_has_entity_ids' FROM cs WHERE NOT coll AND nil AND len(ids) > 0
    UNION ALL SELECT k, 'single_entity_ids_inconsistent' FROM cs WHERE NOT coll AND NOT nil AND e IS NOT NULL AND len(ids) > 0 AND ids <> [e]"""
)
def coref_contract(spark, sf):
    k = F.col("l_orderkey")
    g = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(named("E", F.col("l_suppkey") % 7))).alias("entity_ids"), F.collect_set(named("E", F.col("l_partkey") % 7)).alias("declared"))
    return validators.coreference_contract(g.select(k.alias("sample_id"), "entity_ids", "declared", (k % 2 == 0).alias("is_collective"), (k % 3 == 0).alias("is_nil"), F.when(k % 5 == 0, "E1").alias("entity_id")))


@query(
    """WITH s AS (SELECT l_orderkey AS k, count(*) FILTER (l_suppkey % 3 = 0) AS blank, count(*) FILTER (l_quantity > 25) AS nils FROM lineitem GROUP BY l_orderkey)
    SELECT k AS id, CAST(CASE k % 4 WHEN 0 THEN blank WHEN 1 THEN CASE WHEN k % 8 = 1 THEN 1 ELSE 0 END WHEN 2 THEN nils ELSE CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END END AS INTEGER) AS units FROM s"""
)
def nil_units(spark, sf):
    k = F.col("l_orderkey")
    g = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_suppkey") % 3 != 0, named("S", F.col("l_suppkey"))).otherwise("")).alias("ids"), F.collect_list(F.col("l_quantity") > 25).alias("nils"))
    return g.select(k.alias("id"), validators.nil_units(F.when(k % 4 == 0, F.col("ids")), k % 4 == 1, F.when(k % 8 != 1, "E"), F.when(k % 4 == 2, F.col("nils")), k % 3 == 0).cast("int").alias("units"))


@query(
    """WITH i AS (SELECT l_orderkey AS k, list(l_suppkey % 2 ORDER BY l_linenumber, l_suppkey % 2) AS m FROM lineitem WHERE l_orderkey % 9 <> 0 GROUP BY l_orderkey), g AS (SELECT l_orderkey AS k, list(l_partkey % 2 ORDER BY l_linenumber, l_partkey % 2) AS m, l_orderkey % 2 = 0 AS has_nil, bool_or(l_suppkey % 5 = 0) AS nil FROM lineitem WHERE l_orderkey % 8 <> 0 GROUP BY l_orderkey),
    b AS (SELECT coalesce(i.k, g.k) AS line_no, i.k IS NOT NULL AS hi, g.k IS NOT NULL AS hg, i.m AS im, g.m AS gm, has_nil, nil FROM i FULL JOIN g ON g.k = i.k)
    SELECT line_no, 'input_missing' AS issue FROM b WHERE NOT hi UNION ALL SELECT line_no, 'gold_missing' FROM b WHERE NOT hg UNION ALL SELECT line_no, 'mentions_differ' FROM b WHERE hi AND hg AND im <> gm UNION ALL SELECT line_no, 'has_nil_differs' FROM b WHERE hi AND hg AND has_nil <> nil"""
)
def alignment_audit(spark, sf):
    k, at = F.col("l_orderkey"), F.col("l_linenumber")
    in_order = lambda c, name: F.transform(F.sort_array(F.collect_list(F.struct(at.alias("at"), c.alias("v")))), lambda x: x["v"]).alias(name)
    rows = t(spark, sf, "lineitem")
    inputs = rows.where(k % 9 != 0).groupBy(k.alias("line_no")).agg(in_order((F.col("l_suppkey") % 2).cast("string"), "mentions"))
    gold = rows.where(k % 8 != 0).groupBy(k.alias("line_no")).agg(in_order((F.col("l_partkey") % 2).cast("string"), "mentions"), in_order(F.when(F.col("l_suppkey") % 5 != 0, named("S", F.col("l_suppkey"))), "entity_ids"))
    return validators.alignment(inputs, gold.withColumn("has_nil", F.col("line_no") % 2 == 0))


@query(
    """WITH s AS (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' WHEN 2 THEN 'odd' ELSE 'medium' END AS difficulty, CASE WHEN doc_id % 4 <> 0 THEN 'S' || (doc_id % 6) END AS gold, doc_id % 8 = 0 AS nil FROM documents)
    SELECT doc_id AS id, 'text_missing' AS issue FROM s WHERE length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) = 0 UNION ALL SELECT doc_id, 'difficulty_unknown' FROM s WHERE difficulty = 'odd' UNION ALL SELECT doc_id, 'mention_not_in_text' FROM s WHERE NOT contains(coalesce(text, ''), 'the')
    UNION ALL SELECT doc_id, 'nil_differs_from_gold' FROM s WHERE nil <> (gold IS NULL) UNION ALL SELECT doc_id, 'gold_not_among_candidates' FROM s WHERE gold IS NOT NULL AND gold NOT IN ('S1', 'S2', 'S3')"""
)
def dataset_rules(spark, sf):
    i = F.col("doc_id")
    s = t(spark, sf, "documents").select(i.alias("_i"), i.cast("string").alias("id"), "text", F.when(i % 5 == 0, "easy").when(i % 5 == 1, "hard").when(i % 5 == 2, "odd").otherwise("medium").alias("difficulty"), F.lit("the").alias("mention"), F.when(i % 4 != 0, named("S", i % 6)).alias("gold_id"), (i % 8 == 0).alias("expected_nil"), F.array(*map(F.lit, ("S1", "S2", "S3"))).alias("candidates"))
    return validators.validate(s, "disambiguation").select(F.col("id").cast("long").alias("id"), "issue")


@query(
    """WITH c AS (SELECT l_orderkey AS k, l_orderkey % 100 AS number, list_sort(list('P' || (l_partkey + l_linenumber * 37))) AS ids, list(CAST(l_linenumber - 1 AS INTEGER)) AS ai, l_orderkey % 2 = 0 AND l_orderkey % 3 <> 0 AS won FROM lineitem GROUP BY l_orderkey),
    kb AS (SELECT 'P' || p_partkey AS e FROM part)
    SELECT k AS sample_id, 'invalid_or_missing_acceptance_subset' AS issue FROM c WHERE number >= 61 AND k % 7 = 0 UNION ALL SELECT k, 'missing_acceptance_scenario' FROM c WHERE number >= 61 AND k % 11 = 0 UNION ALL SELECT k, 'acceptance_anaphor_mismatch' FROM c WHERE number >= 61 AND k % 13 = 0
    UNION ALL SELECT k, 'invalid_acceptance_sentence_distance' FROM c WHERE number >= 61 AND k % 17 = 0 UNION ALL SELECT k, 'invalid_acceptance_antecedent_indices' FROM c WHERE won AND (len(ai) < 2 OR list_max(ai) >= 4)
    UNION ALL SELECT k, 'invalid_acceptance_collective_entity_ids' FROM c WHERE won AND (len(ids) < 2 OR len(list_distinct(ids)) < len(ids) OR k IN (SELECT k FROM (SELECT k, unnest(ids) AS e FROM c) WHERE e NOT IN (SELECT e FROM kb)))"""
)
def acceptance_contract(spark, sf):
    k = F.col("l_orderkey")
    g = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(named("P", F.col("l_partkey") + F.col("l_linenumber") * 37))).alias("entity_ids"), F.collect_list((F.col("l_linenumber") - 1).cast("int")).alias("antecedent_indices"))
    text = lambda ok: F.when(ok, "x").otherwise(" ")
    cases = g.select(
        k.alias("sample_id"), (k % 100).alias("number"), F.when(k % 7 != 0, "challenge_dev").alias("subset"), F.lit("easy").alias("difficulty"), text(k % 11 != 0).alias("scenario"), F.lit("和").alias("conjunction"), F.lit("双方").alias("anaphor"),
        F.when(k % 13 == 0, "二者").otherwise("双方").alias("mention"), F.when(k % 17 == 0, -1).otherwise(1).alias("sentence_distance"), F.lit("x").alias("evidence"), (k % 2 == 0).alias("is_collective"), (k % 3 == 0).alias("is_nil"), "entity_ids", "antecedent_indices", F.lit(4).alias("n_mentions"),
    )
    return validators.acceptance(cases, part_entities(spark, sf))


@query("SELECT marker, CAST((SELECT count(*) FROM documents WHERE contains(text, marker)) AS BIGINT) AS n FROM (VALUES ('the'), ('eau'), ('und'), ('qqqq')) v(marker)")
def coverage_markers(spark, sf):
    return validators.coverage(t(spark, sf, "documents"), "text", ("the", "eau", "und", "qqqq"))


@query("SELECT p_partkey, 'P_' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END AS expected_id FROM part WHERE p_partkey % 50 = 0 OR p_partkey < 10")
def continuous_ids(spark, sf):
    k = F.col("p_partkey")
    ids = F.when(k % 50 == 0, F.lit(None)).when(k < 10, named("P_", k)).otherwise(F.format_string("P_%03d", k.cast("long")))
    return validators.not_continuous(t(spark, sf, "part").withColumn("id", ids), "id", k, "P").select("p_partkey", "expected_id")


@query("SELECT DISTINCT e AS entity_id, CASE WHEN e LIKE 'TEST#_%' ESCAPE '#' THEN 'fixture' ELSE 'unconfirmed' END AS category FROM (SELECT CASE WHEN l_orderkey % 50 = 0 THEN 'TEST_' || l_linenumber ELSE 'P' || (l_partkey + CASE WHEN l_orderkey % 40 = 1 THEN 100000 ELSE 0 END) END AS e FROM lineitem) WHERE e NOT IN (SELECT 'P' || p_partkey FROM part)")
def unknown_ids(spark, sf):
    k = F.col("l_orderkey")
    e = F.when(k % 50 == 0, named("TEST_", F.col("l_linenumber"))).otherwise(named("P", F.col("l_partkey") + F.when(k % 40 == 1, 100000).otherwise(0)))
    return validators.unknown_ids(t(spark, sf, "lineitem").select(e.alias("e")), "e", part_entities(spark, sf))


ALIAS_ROWS = "al AS (SELECT d.lang, 'Q' || l.quality AS e, CASE WHEN d.n_chars % 5 <> 0 THEN 'Q' || (d.n_chars % 2) END AS p, l.toxic = 1 AS neg, d.n_chars % 3 = 0 AS amb, d.n_chars % 4 < 2 AS prs FROM labels l JOIN documents d ON d.doc_id = l.doc_id), ar AS (SELECT *, CASE WHEN neg THEN p IS NULL ELSE coalesce(p = e, false) END AS ok FROM al)"


@query(
    f"""WITH {ALIAS_ROWS} SELECT lang, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (ok) AS BIGINT) AS correct, CASE WHEN count(*) FILTER (NOT neg) = 0 THEN 0 ELSE count(*) FILTER (NOT neg AND ok) / count(*) FILTER (NOT neg) END AS positive_recall,
    CASE WHEN count(*) FILTER (neg) = 0 THEN 0 ELSE count(*) FILTER (neg AND ok) / count(*) FILTER (neg) END AS negative_precision, CASE WHEN count(*) FILTER (NOT neg AND amb AND prs) = 0 THEN 0 ELSE count(*) FILTER (NOT neg AND amb AND prs AND ok) / count(*) FILTER (NOT neg AND amb AND prs) END AS ambiguous_accuracy, count(*) FILTER (ok) / count(*) AS overall FROM ar GROUP BY lang"""
)
def alias_metrics(spark, sf):
    n = F.col("n_chars")
    rows = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    rows = rows.select("lang", named("Q", F.col("quality")).alias("expected_id"), F.when(n % 5 != 0, named("Q", n % 2)).alias("predicted_id"), (F.col("toxic") == 1).alias("is_negative"), (n % 3 == 0).alias("is_ambiguous"), (n % 4 < 2).alias("has_pressure"))
    return metrics.alias_metrics(rows, ["lang"])


@query(
    f"""WITH {ORDER_SETS}, r AS (SELECT *, gold IS NULL AS nil, CASE WHEN k % 3 = 0 THEN NULL ELSE cs[1] END AS pred FROM os), c AS (SELECT count(*) FILTER (gold IS NOT NULL AND list_contains(cs, gold)) AS h, count(*) FILTER (gold IS NOT NULL) AS ht, count(*) FILTER (CASE WHEN nil THEN pred IS NULL ELSE coalesce(pred = gold, false) END) AS d, count(*) AS dt FROM r)
    SELECT CAST(h AS BIGINT) AS candidate_hits, CAST(ht AS BIGINT) AS candidate_total, CAST(d AS BIGINT) AS disambiguation_correct, CAST(dt AS BIGINT) AS disambiguation_total, h / ht AS alias_recall, d / dt AS disambiguation_accuracy FROM c"""
)
def acceptance_rates(spark, sf):
    s = order_sets(spark, sf)
    return metrics.acceptance_rates(s.select("gold_id", F.col("gold_id").isNull().alias("expected_nil"), F.col("candidates").alias("candidate_ids"), F.when(F.col("l_orderkey") % 3 != 0, F.get("candidates", F.lit(0))).alias("pred_id")))


@query(
    f"""WITH {ORDER_SETS}, r AS (SELECT *, CASE WHEN gold IS NULL THEN 'none' WHEN list_contains(cs, gold) AND k % 3 = 0 THEN 'low' WHEN list_contains(cs, gold) AND cs[1] = gold THEN NULL WHEN list_contains(cs, gold) THEN 'other' ELSE 'lost' END AS why FROM os)
    SELECT cause, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE why WHEN 'none' THEN CASE WHEN k % 3 <> 0 THEN 'nil_linked' END WHEN 'low' THEN 'nil_false_positive:below_threshold' WHEN 'other' THEN 'disambiguation:other_taken' WHEN 'lost' THEN 'recall:gold_not_generated' END AS cause FROM r) GROUP BY cause"""
)
def error_causes(spark, sf):
    s = order_sets(spark, sf).withColumn("pred_id", F.when(F.col("l_orderkey") % 3 != 0, F.get("candidates", F.lit(0))))
    return s.groupBy(metrics.error_cause(F.col("gold_id"), F.col("pred_id"), F.col("candidates")).alias("cause")).agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT l_orderkey AS k, l_orderkey % 4 AS sc, CASE WHEN l_orderkey % 3 = 0 THEN [] ELSE list_sort(list_distinct(list(l_suppkey % 3))) END AS g, CASE WHEN l_orderkey % 5 = 0 THEN [] ELSE list_sort(list_distinct(list(l_partkey % 3))) END AS p FROM lineitem GROUP BY l_orderkey),
    d AS (SELECT unnest([{'d': 'scenario', 'b': CAST(sc AS VARCHAR)}, {'d': 'parity', 'b': CAST(k % 2 AS VARCHAR)}]) AS x, g, p FROM s)
    SELECT x.d AS dimension, x.b AS bucket, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (len(g) > 0) AS BIGINT) AS positive, CAST(count(*) FILTER (len(g) > 0 AND g = p) AS BIGINT) AS positive_right, CAST(count(*) FILTER (len(g) = 0) AS BIGINT) AS nil, CAST(count(*) FILTER (len(g) = 0 AND len(p) = 0) AS BIGINT) AS nil_right,
      CAST(count(*) FILTER (len(g) > 0 AND len(p) = 0) AS BIGINT) AS false_nil, CAST(count(*) FILTER (len(g) > 0 AND len(p) > 0 AND g <> p) AS BIGINT) AS wrong_set FROM d GROUP BY 1, 2"""
)
def discourse_metrics(spark, sf):
    k = F.col("l_orderkey")
    none = F.array().cast("array<bigint>")
    g = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_suppkey") % 3).cast("long")).alias("s"), F.collect_set((F.col("l_partkey") % 3).cast("long")).alias("q"))
    rows = g.select(F.when(k % 3 == 0, none).otherwise(F.col("s")).alias("gold_ids"), F.when(k % 5 == 0, none).otherwise(F.col("q")).alias("pred_ids"), (k % 4).alias("scenario"), (k % 2).alias("parity"))
    return metrics.discourse_metrics(rows, ["scenario", "parity"])


@query(
    """WITH p AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_linenumber % 2 = 0) AS v, min(CASE WHEN l_quantity > 45 THEN l_linenumber END) AS r FROM lineitem GROUP BY l_orderkey)
    SELECT CAST(count(*) AS BIGINT) AS mentions, avg(n) AS mean_candidates, sum(v) / sum(n) AS vector_share, (sum(n) - sum(v)) / sum(n) AS alias_share, count(*) FILTER (r <= 1) / count(*) AS recall_at_1, count(*) FILTER (r <= 3) / count(*) AS recall_at_3, count(*) FILTER (r <= 5) / count(*) AS recall_at_5 FROM p"""
)
def candidate_stats(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, "vector").otherwise("alias_exact").alias("method"), F.col("l_linenumber").alias("rank"), (F.col("l_quantity") > 45).alias("is_gold"))
    return metrics.candidate_stats(rows, "l_orderkey")


@query(
    f"""WITH {TALK}, m AS (SELECT conv_id, turn, role, e, kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM tk), u AS (SELECT conv_id, list(turn ORDER BY turn) AS ts, list(kind ORDER BY turn) AS ks FROM m WHERE role = 'user' GROUP BY conv_id)
    SELECT m.conv_id, CAST(m.i AS INTEGER) AS idx, CASE WHEN m.turn % 2 = 0 THEN 'legacy' ELSE 'collective' END AS source, m.role AS target, CASE WHEN len(list_filter(coalesce(u.ts, []), lambda x: x < m.turn)) = 0 OR m.turn - list_min(u.ts) <= 0 THEN 'same' WHEN m.turn - list_min(u.ts) = 1 THEN 'next' WHEN m.turn - list_min(u.ts) = 2 THEN 'two' ELSE 'three_or_more' END AS distance,
      CASE WHEN u.ks IS NULL THEN 'UNKNOWN' WHEN len(list_distinct(u.ks)) = 1 THEN u.ks[1] ELSE 'MIXED:' || array_to_string(list_sort(list_distinct(u.ks)), '+') END AS kinds FROM m LEFT JOIN u ON u.conv_id = m.conv_id WHERE m.role = 'assistant'"""
)
def case_union(spark, sf):
    """Cases of two sets under one schema: the case's own mention, its distance to the named ones, and their types."""
    c = t(spark, sf, "conversations").where(F.col("role").isin("user", "assistant"))
    kind = F.when(F.length("text") % 2 == 0, "ORG").otherwise("GPE")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("int").alias("turn"), "role", kind.alias("kind")))).alias("ms"))
    each = g.select("conv_id", "ms", F.posexplode("ms").alias("idx", "m")).where("m.role = 'assistant'")
    sets = {"legacy": each.where("m.turn % 2 = 0"), "collective": each.where("m.turn % 2 <> 0").withColumn("note", F.lit(1))}
    user = F.filter("ms", lambda x: x["role"] == "user")
    distance = metrics.distance_bucket(metrics.sentence_distance(F.col("m.turn"), F.transform(user, lambda x: x["turn"])))
    return metrics.all_cases(sets).select("conv_id", "idx", "source", metrics.case_target(F.col("ms"), F.col("idx"))["role"].alias("target"), distance.alias("distance"), metrics.target_type(F.transform(user, lambda x: x["kind"])).alias("kinds"))


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'E1' WHEN 1 THEN 'E2' WHEN 5 THEN 'E3' END AS entity_id, CASE WHEN event_id % 6 = 4 THEN 'llm_failed' WHEN event_id % 6 IN (2, 3) THEN 'llm_nil' ELSE 'llm' END AS method, CAST(CASE event_id % 6 WHEN 0 THEN 80 WHEN 1 THEN 50 WHEN 5 THEN 50 ELSE 0 END AS BIGINT) AS score_e2 FROM events"""
)
def fallback_answers(spark, sf):
    i = F.col("event_id")
    answer = F.when(i % 6 == 0, '{"entity_id": "E1", "reason": "named", "confidence": 0.8}').when(i % 6 == 1, 'it is {"entity_id": "E2"}').when(i % 6 == 2, "NIL").when(i % 6 == 3, '{"entity_id": "E9", "confidence": 0.9}').when(i % 6 == 5, "E3")
    cands = F.array(*[F.struct(F.lit(e).alias("entity_id")) for e in ("E1", "E2", "E3")])
    rows = t(spark, sf, "events").select("event_id", i.alias("key"), cands.alias("candidates"))
    said = t(spark, sf, "events").select(i.alias("key"), answer.alias("answer")).where("answer is not null")
    return answers.decided(rows, said).select("event_id", "entity_id", "method", F.round(F.col("score") * 100).cast("long").alias("score_e2"))


@query(
    """SELECT p_partkey, md5('实体ID：P' || p_partkey || '；标准名称：' || p_name || '；别名/简称：' || p_brand || '；实体类型：' || k || CASE WHEN p_size > 25 THEN '；实体描述：' || p_type ELSE '' END || '；所属行业/领域：' || p_type || CASE WHEN p_size > 25 THEN '；实体特征：' || k || '「' || p_name || '」' || CASE WHEN p_brand <> p_name THEN '（又称' || p_brand || '）' ELSE '' END ELSE '' END) AS passage
    FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN '组织机构' ELSE '人物' END AS k FROM part)"""
)
def enhanced_passage(spark, sf):
    p = t(spark, sf, "part")
    e = p.select("p_partkey", named("P", F.col("p_partkey")).alias("entity_id"), F.col("p_name").alias("standard_name"), F.array("p_brand").alias("aliases"), F.when(F.col("p_size") % 2 == 0, "ORG").otherwise("PERSON").alias("entity_type"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("description"), F.create_map(F.lit("industry"), F.col("p_type")).alias("metadata"))
    return answers.enhanced_passage(e).select("p_partkey", F.md5("passage").alias("passage"))


@query("WITH q AS (SELECT user_id, event_id % 900 AS e, event_id FROM events), s AS (SELECT vec_id FROM embeddings), l AS (SELECT DISTINCT user_id FROM q WHERE e NOT IN (SELECT vec_id FROM s)) SELECT q.event_id, CASE WHEN q.user_id IN (SELECT user_id FROM l) THEN 'encoded' ELSE 'stored' END AS path FROM q")
def vector_lookup(spark, sf):
    pairs = t(spark, sf, "events").select("event_id", F.col("user_id").alias("mention"), (F.col("event_id") % 900).alias("entity_id"))
    stored = t(spark, sf, "embeddings").select(F.col("vec_id").alias("entity_id"), F.col("embedding").alias("v"))
    return vectors.lookup(pairs, stored, F.array(F.lit(0.0).cast("float"))).select("event_id", "path")


@query("SELECT l_orderkey AS mention_id, l_linenumber, 'c' || o_custkey AS mention_text FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 3 <> 0")
def trace_candidates(spark, sf):
    c = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("mention_id"), "l_linenumber")
    m = t(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), named("c", F.col("o_custkey")).alias("mention_text"), F.lit(0).alias("start_idx"), F.lit(1).alias("end_idx"), F.lit("d").alias("doc_id"))
    return trace.with_mentions(c, m).select("mention_id", "l_linenumber", "mention_text")


@query("WITH m AS (SELECT o_orderkey AS id, 'c' || o_custkey AS x, 'r' || (o_orderkey % 4) AS run FROM orders WHERE o_orderkey % 3 <> 0), a AS (SELECT l_orderkey AS mid, l_linenumber, 'r' || (l_linenumber % 4) AS run FROM lineitem) SELECT a.mid AS mention_id, a.l_linenumber, m.x AS mention_text FROM a LEFT JOIN m ON m.id = a.mid WHERE a.run = 'r1' OR m.run = 'r1'")
def trace_audit(spark, sf):
    a = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("mention_id"), "l_linenumber", named("r", F.col("l_linenumber") % 4).alias("run_id"))
    m = t(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), named("c", F.col("o_custkey")).alias("mention_text"), named("r", F.col("o_orderkey") % 4).alias("run_id"))
    return trace.audit_of_run(a, m, "r1").select("mention_id", "l_linenumber", "mention_text")


@query(
    f"""WITH {TALK}, p AS (SELECT m.conv_id, m.turn, a.turn AS pt, a.e, CAST(0.80 AS DOUBLE) - CAST(0.08 AS DOUBLE) * (m.turn - a.turn) - CAST(0.05 AS DOUBLE) * (m.turn - a.turn) + CASE WHEN m.turn - a.turn = 1 THEN CAST(0.04 AS DOUBLE) ELSE 0 END AS score FROM tk m JOIN tk a ON a.conv_id = m.conv_id AND a.role = 'user' AND a.turn < m.turn WHERE m.role = 'assistant'),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, pt) AS r FROM p) WHERE r = 1)
    SELECT m.conv_id AS doc_id, CAST(m.turn AS INTEGER) AS idx, CASE WHEN m.role = 'user' THEN m.e WHEN b.score >= CAST(0.55 AS DOUBLE) THEN b.e END AS entity_id, CASE WHEN m.role = 'user' THEN 'linked_name' WHEN b.score IS NULL THEN 'no_candidate' WHEN b.score < CAST(0.55 AS DOUBLE) THEN 'below_threshold' ELSE 'recency_and_type' END AS rule
    FROM tk m LEFT JOIN b ON b.conv_id = m.conv_id AND b.turn = m.turn"""
)
def coref_by_recency(spark, sf):
    m = talk(spark, sf, "该公司").withColumn("role", F.when(F.col("mention") == "name", "name").otherwise("anaphor"))
    return coref.by_recency(m).select("doc_id", "idx", "entity_id", "rule")


@query("SELECT conv_id, CAST(turn AS INTEGER) AS turn, turn % 3 = 0 AS is_plural, CASE WHEN turn % 3 = 2 THEN 0 ELSE 100 END AS sure FROM conversations")
def plural_pronouns(spark, sf):
    i = F.col("turn")
    p = coref.is_plural(F.when(i % 3 == 0, "双方").when(i % 3 == 1, "该公司").otherwise("某物"))
    return t(spark, sf, "conversations").select("conv_id", i.cast("int").alias("turn"), p["is_plural"].alias("is_plural"), (p["confidence"] * 100).cast("int").alias("sure"))


@query(
    """SELECT event_id, (event_id % 4 >= 2) AND event_id % 5 <> 0 AND NOT (event_id % 7 = 0) AND ((event_id % 3 = 0 AND event_id % 2 = 0) OR event_id % 3 = 1) AS ambiguous FROM events"""
)
def coref_ambiguity(spark, sf):
    i = F.col("event_id")
    between = F.concat(F.when(i % 7 == 0, "AAA和BBB").otherwise("AAA"), F.when(i % 3 == 0, "随后").when(i % 3 == 1, "与此同时").otherwise("。"))
    rejected = coref.ambiguity(i % 4, i % 5 != 0, between, F.array(F.lit("AAA"), F.lit("BBB")), i % 2 == 0)
    return t(spark, sf, "events").select("event_id", rejected.alias("ambiguous"))


@query(f"WITH {EVAL} SELECT CAST(floor(b.accuracy * 1000000) AS BIGINT) AS score_micro, b.threshold FROM (SELECT threshold, count(*) FILTER (o = 'correct' AND doc_id % 10 >= threshold) / count(*) AS accuracy FROM oc CROSS JOIN (SELECT unnest([2, 5, 8]) AS threshold) GROUP BY threshold ORDER BY accuracy DESC, threshold LIMIT 1) b")
def best_threshold(spark, sf):
    rows = evaluated(spark, sf).withColumn("ok", metrics.outcome() == "correct")
    swept = metrics.sweep(rows, [2, 5, 8], lambda at: F.col("ok") & (F.col("doc_id") % 10 >= at))
    return metrics.best_threshold(swept).select(micro("accuracy"), "threshold")
