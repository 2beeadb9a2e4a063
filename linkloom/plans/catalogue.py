"""Queries that run each operator over the whole driver tables, and the same in SQL.

The tables hold no knowledge base, so it is derived: an entity for each
benchmark item, its aliases the item's words; mentions are the words of all
documents. Dialogues stand in for documents with coreference, events for runs
and tagger spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aliases, candidates, coref, decide, metrics, ner, quality, trace, vectors
from . import linking

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def word_entities(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]{5,})"), F.lit(1)))
    b = t(spark, sf, "benchmark")
    return b.select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("entity_id"), F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("standard_name"), words.alias("aliases"), F.lit("ORG").alias("entity_type"), F.col("text").alias("description"), F.col("item_id").alias("entity_ord"))


def word_index(spark: SparkSession, sf: str) -> DataFrame:
    return aliases.alias_index(word_entities(spark, sf)).where("at > 0")


def word_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{4,})"), F.lit(1))).alias("mention")).distinct()


def stored_words(words: DataFrame) -> DataFrame:
    """Words written to the shared folder, so that texts are read once for all steps that take them."""
    path = vectors._shared(words.sparkSession, "words")
    words.write.parquet(path)
    return words.sparkSession.read.parquet(path)


KB = """
    ent AS (SELECT item_id, regexp_extract_all(text, '[a-z]{5,}') AS ws FROM benchmark),
    ali AS (SELECT item_id, w AS alias, min(i) AS pos FROM (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ent) GROUP BY item_id, w),
    fst AS (SELECT alias, min(item_id) AS fo, arg_min(pos, item_id) AS fp FROM ali GROUP BY alias),
    men AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{4,}')) AS mention FROM documents)"""
PAIRS = """
    prs AS (SELECT m.mention, a.alias, a.fo, a.fp, least(length(m.mention), length(a.alias)) AS s, greatest(length(m.mention), length(a.alias)) AS l
            FROM men m JOIN fst a ON (contains(a.alias, m.mention) OR contains(m.mention, a.alias))
            WHERE least(length(m.mention), length(a.alias)) * 2 >= greatest(length(m.mention), length(a.alias)) AND least(length(m.mention), length(a.alias)) >= 3)"""
#: The same pairs by trigrams, where the nested loop of PAIRS takes the database too long; fuzzy_nested_loop proves them equal.
PAIRS_BY_TRIGRAM = """
    mtg AS MATERIALIZED (SELECT mention, unnest(list_distinct(list_transform(range(1, length(mention) - 1), lambda i: substr(mention, i, 3)))) AS k FROM men),
    atg AS MATERIALIZED (SELECT alias, unnest(list_distinct(list_transform(range(1, length(alias) - 1), lambda i: substr(alias, i, 3)))) AS k FROM fst),
    met AS MATERIALIZED (SELECT m.mention, a.alias FROM men m JOIN atg a ON a.k = substr(m.mention, 1, 3) AND length(m.mention) <= length(a.alias) AND contains(a.alias, m.mention)
            UNION SELECT m.mention, a.alias FROM mtg m JOIN fst a ON m.k = substr(a.alias, 1, 3) AND length(m.mention) > length(a.alias) AND contains(m.mention, a.alias)),
    prs AS MATERIALIZED (SELECT t.mention, t.alias, a.fo, a.fp, least(length(t.mention), length(t.alias)) AS s, greatest(length(t.mention), length(t.alias)) AS l
            FROM met t JOIN fst a ON a.alias = t.alias WHERE least(length(t.mention), length(t.alias)) * 2 >= greatest(length(t.mention), length(t.alias)))"""
SCORE = "CAST(0.35 AS DOUBLE) + CAST(0.35 AS DOUBLE) * (s / l) + CAST(0.30 AS DOUBLE) * (CAST(1.0 AS DOUBLE) - (l - s) / l)"
CANDS = f"""
    sco AS (SELECT p.mention, a.item_id, p.alias, p.fo, p.fp, {SCORE} AS score FROM prs p JOIN ali a ON a.alias = p.alias),
    bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention, item_id ORDER BY score DESC, fo, fp, alias) AS b FROM sco) WHERE b = 1),
    fuz AS (SELECT * FROM (SELECT mention, 'B' || item_id AS entity_id, score, row_number() OVER (PARTITION BY mention ORDER BY score DESC, length(alias) DESC, 'B' || item_id DESC) AS pl FROM bst) WHERE pl <= 10),
    exa AS (SELECT mention, 'B' || item_id AS entity_id, item_id AS pl FROM men JOIN ali ON alias = mention),
    uni AS (SELECT mention, entity_id, CAST(0.95 AS DOUBLE) AS score, 'alias_exact' AS method, 0 AS stage, pl FROM exa
            UNION ALL SELECT mention, entity_id, score, 'alias_fuzzy', 1, pl FROM fuz),
    see AS (SELECT *, row_number() OVER (PARTITION BY mention, entity_id ORDER BY stage, pl) AS r FROM uni),
    cnd AS (SELECT * FROM (SELECT mention, entity_id, score, method, row_number() OVER (PARTITION BY mention ORDER BY stage, pl, entity_id) AS cand_ord FROM see WHERE r = 1) WHERE cand_ord <= 10)"""


def micro(c: str):
    """A score in whole millionths."""
    return F.floor(F.col(c) * 1000000).cast("long").alias("score_micro")


@query(f"WITH {KB} SELECT mention, 'B' || item_id AS entity_id FROM men JOIN ali ON alias = mention")
def link_exact_words(spark, sf):
    return candidates.exact(word_mentions(spark, sf), word_index(spark, sf)).select("mention", "entity_id")


@query(f"WITH {KB} SELECT alias, CAST(count(*) AS BIGINT) AS owners, 'B' || min(item_id) AS first_owner, 'B' || max(item_id) AS last_owner FROM ali GROUP BY alias")
def kb_alias_index(spark, sf):
    i = word_index(spark, sf)
    owners = i.groupBy("alias").agg(F.count("*").alias("owners"))
    first, last = aliases.first_owner(i), aliases.last_owner(i)
    return owners.join(first.withColumnRenamed("entity_id", "first_owner"), "alias").join(last.withColumnRenamed("entity_id", "last_owner"), "alias")


@query("SELECT p_name AS alias, CAST(count(DISTINCT p_partkey) AS BIGINT) AS owners FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1")
def alias_conflicts_part(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("standard_name"), F.lit(None).cast("array<string>").alias("aliases"), F.col("p_partkey").alias("entity_ord"))
    return aliases.alias_conflicts(aliases.alias_index(p))


@query(
    """SELECT p_type AS entity_type, CAST(count(*) AS BIGINT) AS entities, CAST(sum(CASE WHEN p_brand = p_name THEN 0 ELSE 1 END) AS BIGINT) AS alias_total,
       CAST(sum(CASE WHEN p_size > 25 THEN 0 ELSE 1 END) AS BIGINT) AS missing_description, CAST(sum(CASE WHEN p_brand = p_name THEN 1 ELSE 0 END) AS BIGINT) AS missing_aliases, count(*) < 8 AS weak
       FROM part GROUP BY p_type"""
)
def kb_profile_part(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_type").alias("entity_type"), F.filter(F.array("p_brand"), lambda b: b != F.col("p_name")).alias("aliases"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("description"))
    return aliases.type_profile(p)


@query(f"WITH {KB}, {PAIRS} SELECT mention, alias FROM prs")
def fuzzy_nested_loop(spark, sf):
    return candidates.containment_pairs(word_mentions(spark, sf), word_index(spark, sf), "nested").select("mention", "alias")


@query(f"WITH {KB}, {PAIRS} SELECT mention, alias FROM prs")
def fuzzy_trigram(spark, sf):
    return candidates.containment_pairs(word_mentions(spark, sf), word_index(spark, sf), "trigram").select("mention", "alias")


@query(f"WITH {KB}, {PAIRS}, {CANDS} SELECT mention, entity_id, CAST(floor(score * 1000000) AS BIGINT) AS score_micro, method, CAST(cand_ord AS INTEGER) AS cand_ord FROM cnd")
def link_fuzzy_words(spark, sf):
    c = candidates.generate(stored_words(word_mentions(spark, sf)), word_index(spark, sf))
    return c.select("mention", "entity_id", micro("score"), "method", "cand_ord")


@query(
    f"""WITH {KB}, hit AS (SELECT DISTINCT mention, item_id FROM men JOIN ali ON contains(alias, mention))
    SELECT mention, 'B' || item_id AS entity_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY item_id, 'B' || item_id) AS r FROM hit) WHERE r <= 5"""
)
def link_one_way_words(spark, sf):
    return candidates.one_way(word_mentions(spark, sf), word_index(spark, sf)).select("mention", "entity_id", "rank")


def _decided(spark, sf, threshold=0.9):
    m = stored_words(word_mentions(spark, sf))
    return decide.decide(m, candidates.generate(m, word_index(spark, sf)), word_entities(spark, sf), threshold)


BEST = """
    bes AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY mention) AS n, row_number() OVER (PARTITION BY mention ORDER BY score DESC, method = 'alias_exact' DESC, length('Item ' || substr(entity_id, 2)) DESC, cand_ord) AS r FROM cnd) WHERE r = 1),
    dec AS (SELECT m.mention, b.entity_id, coalesce(b.score, 0) AS score, coalesce(b.n, 0) AS n FROM men m LEFT JOIN bes b ON b.mention = m.mention)"""


@query(
    f"""WITH {KB}, {PAIRS_BY_TRIGRAM}, {CANDS}, {BEST} SELECT mention, CASE WHEN score >= CAST(0.9 AS DOUBLE) THEN entity_id END AS entity_id, CAST(floor(score * 1000000) AS BIGINT) AS score_micro,
    CAST(n AS BIGINT) AS candidate_count, entity_id IS NULL OR score < CAST(0.9 AS DOUBLE) AS is_nil, CASE WHEN n = 0 THEN 'no_candidates' WHEN score < CAST(0.9 AS DOUBLE) THEN 'nil_threshold' ELSE 'entity_selected' END AS reason FROM dec"""
)
def decide_words(spark, sf):
    return _decided(spark, sf).select("mention", "entity_id", micro("score"), "candidate_count", "is_nil", "reason")


@query(
    f"""WITH {KB}, {PAIRS}, {CANDS}, {BEST} SELECT threshold, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN entity_id IS NOT NULL AND score >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS linked
    FROM dec CROSS JOIN (SELECT unnest([CAST(0.65 AS DOUBLE), CAST(0.8 AS DOUBLE), CAST(0.9 AS DOUBLE), CAST(0.95 AS DOUBLE)]) AS threshold) GROUP BY threshold"""
)
def nil_decision_sweep(spark, sf):
    rows = _decided(spark, sf, 0.0)
    s = metrics.sweep(rows, [0.65, 0.8, 0.9, 0.95], lambda at: ~decide.is_nil(F.col("entity_id"), F.col("score"), at))
    return s.select("threshold", "total", F.col("correct").alias("linked"))


@query(
    f"""WITH {KB}, {PAIRS}, {CANDS}, two AS (SELECT mention, max(CASE WHEN r = 1 THEN score END) AS top, max(CASE WHEN r = 2 THEN score END) AS second
      FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, cand_ord) AS r FROM cnd) GROUP BY mention)
    SELECT mention, top < CAST(0.61 AS DOUBLE) OR (second IS NOT NULL AND top - second < CAST(0.05 AS DOUBLE) AND top < CAST(0.65 AS DOUBLE)) AS is_nil FROM two"""
)
def nil_margin(spark, sf):
    c = candidates.generate(word_mentions(spark, sf), word_index(spark, sf))
    w = Window.partitionBy("mention").orderBy(F.desc("score"), "cand_ord")
    two = c.withColumn("second", F.lead("score").over(w)).withColumn("r", F.row_number().over(w)).where("r = 1")
    return two.select("mention", decide.nil_by_margin(F.col("score"), F.col("second")).alias("is_nil"))


@query(
    """WITH c AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS score, CAST(embedding[2] AS DOUBLE) AS rerank FROM embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM c),
    b AS (SELECT *, CASE WHEN rn <= 10 THEN CAST(0.3 AS DOUBLE) * score + CAST(0.7 AS DOUBLE) * rerank ELSE score END AS blended FROM r)
    SELECT CAST(label AS INTEGER) AS label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY rn > 10, CASE WHEN rn <= 10 THEN -blended ELSE 0 END, rn) AS INTEGER) AS place, CAST(floor(blended * 1000000) AS BIGINT) AS score_micro FROM b"""
)
def rerank_blend(spark, sf):
    e = t(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("score"), F.col("embedding")[1].cast("double").alias("rerank"), F.col("vec_id").alias("cand_ord"))
    return decide.rerank_blend(e, ["label"]).select("label", "vec_id", "place", micro("blended"))


@query()
def gazetteer_ner(spark, sf):
    i = word_index(spark, sf).groupBy("alias").agg(F.min("alias_ord").alias("alias_ord")).withColumn("entity_type", F.lit("ORG"))
    return ner.gazetteer(t(spark, sf, "documents").select("doc_id", "text"), i)


SPANS = """sp AS (SELECT user_id AS doc_id, event_type || '' AS mention, CASE event_id % 3 WHEN 0 THEN 'ORG' WHEN 1 THEN 'LOC' ELSE 'UNKNOWN' END AS type, CAST(event_id % 97 AS INTEGER) AS char_start,
    CAST(event_id % 97 + 1 + event_id % 11 AS INTEGER) AS char_end, CASE event_id % 4 WHEN 0 THEN 'msra' WHEN 1 THEN 'ontonotes' ELSE 'pku' END AS source, event_id AS ord FROM events)"""


@query(
    f"""WITH {SPANS}, pr AS (SELECT *, CASE type WHEN 'ORG' THEN 3 WHEN 'LOC' THEN 2 ELSE 1 END AS p, CASE source WHEN 'msra' THEN 3 WHEN 'ontonotes' THEN 2 ELSE 1 END AS s FROM sp),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, char_start, char_end, mention ORDER BY p DESC, ord) AS r FROM pr) WHERE r = 1),
    b AS (SELECT * FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY doc_id, char_start, char_end ORDER BY p DESC, s DESC, ord) AS r FROM a) WHERE r = 1)
    SELECT doc_id, mention, type, char_start, char_end FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.doc_id = b.doc_id AND o.char_start <= b.char_start AND o.char_end >= b.char_end
      AND o.char_end - o.char_start > b.char_end - b.char_start AND o.p >= b.p)"""
)
def ner_merge(spark, sf):
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "ORG").when(i % 3 == 1, "LOC").otherwise("UNKNOWN")
    source = F.when(i % 4 == 0, "msra").when(i % 4 == 1, "ontonotes").otherwise("pku")
    s = t(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("mention"), kind.alias("type"), (i % 97).cast("int").alias("char_start"), (i % 97 + 1 + i % 11).cast("int").alias("char_end"), source.alias("source"), i.alias("ord"))
    return ner.merge(s).select("doc_id", "mention", "type", "char_start", "char_end")


@query(
    """WITH s AS (SELECT doc_id, text, substr(text, 11, 5) AS mention, CAST(CASE WHEN doc_id % 7 = 0 THEN 11 ELSE 10 END AS INTEGER) AS st, CAST(CASE WHEN doc_id % 7 = 0 THEN 16 ELSE 15 END AS INTEGER) AS en FROM documents
      UNION ALL SELECT doc_id, text, substr(text, 13, 6), 12, 18 FROM documents),
    c AS (SELECT *, (st < 0 OR en > length(text) OR st >= en) AS bad, (st >= 0 AND st < en AND en <= length(text) AND substr(text, st + 1, en - st) = mention) AS ok,
      lag(en) OVER (PARTITION BY doc_id ORDER BY st, en, mention) > st AS ov, row_number() OVER (PARTITION BY doc_id, mention ORDER BY st, en) AS n FROM s)
    SELECT CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (ok) AS BIGINT) AS correct, CAST(count(*) FILTER (bad) AS BIGINT) AS out_of_bounds, CAST(count(*) FILTER (NOT bad AND NOT ok) AS BIGINT) AS mismatch,
      CAST(count(*) FILTER (n > 1) AS BIGINT) AS duplicate_mentions, CAST(count(*) FILTER (ov) AS BIGINT) AS overlaps FROM c"""
)
def span_audit(spark, sf):
    d = t(spark, sf, "documents")
    shift = F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    a = d.select(F.col("doc_id").alias("sample_id"), "text", F.substring("text", 11, 5).alias("mention"), (shift + 10).alias("start"), (shift + 15).alias("end"))
    b = d.select(F.col("doc_id").alias("sample_id"), "text", F.substring("text", 13, 6).alias("mention"), F.lit(12).alias("start"), F.lit(18).alias("end"))
    return quality.span_audit(a.union(b))


@query("SELECT doc_id, CAST(instr(text, 'the') - 1 AS INTEGER) AS char_start, substr(text, greatest(0, instr(text, 'the') - 81) + 1, least(length(text), instr(text, 'the') + 82) - greatest(0, instr(text, 'the') - 81)) AS context FROM documents WHERE contains(text, 'the')")
def context_window(spark, sf):
    d = t(spark, sf, "documents").withColumn("char_start", tx.find(F.col("text"), F.lit("the"))).where("char_start >= 0")
    return d.select("doc_id", "char_start", tx.context_window(F.col("text"), F.col("char_start"), F.col("char_start") + 3).alias("context"))


@query("SELECT doc_id, CASE WHEN instr(text, 'the') > 0 THEN md5(substr(text, 1, instr(text, 'the') - 1) || '[*]the[/*]' || substr(text, instr(text, 'the') + 3)) ELSE md5(text) END AS marked FROM documents")
def mark_mention(spark, sf):
    marked = tx.mark_mention(F.col("text"), F.lit("the"), F.lit(-1), F.lit(-1))
    return t(spark, sf, "documents").select("doc_id", F.md5(marked).alias("marked"))


def talk(spark, sf, anaphor) -> DataFrame:
    """Turns as mentions: those of the user are named, those of the assistant anaphors."""
    user = F.col("role") == "user"
    c = t(spark, sf, "conversations").where(F.col("role").isin("user", "assistant"))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("idx"), F.when(user, "name").otherwise(anaphor).alias("mention"), F.when(user, F.when(F.length("text") % 2 == 0, "ORG").otherwise("GPE")).otherwise("PRON").alias("mention_type"), F.col("turn").cast("int").alias("sentence_index"), F.lit("").alias("role"), F.when(user, F.concat(F.lit("E"), (F.length("text") % 50).cast("string"))).alias("entity_id"))


TALK = "tk AS (SELECT conv_id, turn, role, CASE WHEN length(text) % 2 = 0 THEN 'ORG' ELSE 'GPE' END AS kind, 'E' || (length(text) % 50) AS e FROM conversations WHERE role IN ('user', 'assistant'))"


@query(
    f"""WITH {TALK}, p AS (SELECT m.conv_id, m.turn, a.turn AS pt, a.e, CAST(0.82 AS DOUBLE) - CAST(0.06 AS DOUBLE) * (greatest(1, m.turn - a.turn) - 1) - CAST(0.05 AS DOUBLE) * (m.turn - a.turn) + CASE WHEN m.turn = a.turn THEN CAST(0.08 AS DOUBLE) ELSE 0 END
      + CASE WHEN a.kind = 'ORG' THEN CAST(0.05 AS DOUBLE) ELSE 0 END AS score FROM tk m JOIN tk a ON a.conv_id = m.conv_id AND a.role = 'user' AND a.turn < m.turn AND m.turn - a.turn <= 3 WHERE m.role = 'assistant'),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, pt DESC) AS r FROM p) WHERE r = 1)
    SELECT m.conv_id AS doc_id, CAST(m.turn AS INTEGER) AS idx, CAST(b.pt AS INTEGER) AS antecedent_idx, CASE WHEN b.score >= CAST(0.55 AS DOUBLE) THEN b.e END AS entity_id, CAST(floor(coalesce(b.score, 0) * 1000000) AS BIGINT) AS score_micro,
      CASE WHEN b.score IS NULL THEN 'no_compatible_antecedent' WHEN b.score < CAST(0.55 AS DOUBLE) THEN 'below_nil_threshold' ELSE 'recency_type_sentence' END AS rule
    FROM tk m LEFT JOIN b ON b.conv_id = m.conv_id AND b.turn = m.turn WHERE m.role = 'assistant'"""
)
def coref_single(spark, sf):
    return coref.single(talk(spark, sf, "该公司")).select("doc_id", "idx", "antecedent_idx", "entity_id", micro("score"), "rule")


@query(
    f"""WITH {TALK}, p AS (SELECT m.conv_id, m.turn, a.turn AS pt, a.e, row_number() OVER (PARTITION BY m.conv_id, m.turn ORDER BY a.turn DESC) AS r, count(*) OVER (PARTITION BY m.conv_id, m.turn) AS n
      FROM tk m JOIN tk a ON a.conv_id = m.conv_id AND a.role = 'user' AND a.turn < m.turn WHERE m.role = 'assistant')
    SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS idx, CAST(pt AS INTEGER) AS antecedent_idx, e AS entity_id FROM p WHERE n >= 2 AND r = CASE WHEN turn % 4 < 2 THEN 2 ELSE 1 END"""
)
def coref_ordinal(spark, sf):
    return coref.ordinal(talk(spark, sf, F.when(F.col("turn") % 4 < 2, "前者").otherwise("后者"))).select("doc_id", "idx", "antecedent_idx", "entity_id")


@query()
def coref_fold(spark, sf):
    m = talk(spark, sf, F.when(F.col("turn") % 4 < 2, "该公司").otherwise("后者")).withColumn("mention_type", F.when(F.col("mention_type") == "PRON", "ORG").otherwise(F.col("mention_type")))
    return coref.fold(m)


def groups_text(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A text of four characters a turn, and its mentions: user turns are names, most with a conjunction after them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t(spark, sf, "conversations").withColumn("i", (F.row_number().over(w) - 1).cast("int"))
    cell = F.when(F.col("role") == "user", F.when(F.length("text") % 3 == 0, "AAA。").otherwise("AAA和")).when(F.col("role") == "assistant", "双方。。").otherwise("xxxx")
    docs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", cell.alias("c")))), lambda x: x["c"]), "").alias("text")).withColumnRenamed("conv_id", "doc_id")
    user = F.col("role") == "user"
    m = c.where(F.col("role") != "system").select(F.col("conv_id").alias("doc_id"), F.col("i").alias("idx"), F.when(user, "AAA").otherwise("双方").alias("mention"), F.when(user, "ORG").otherwise("PRON").alias("mention_type"), (4 * F.col("i")).alias("char_start"), (4 * F.col("i") + F.when(user, 3).otherwise(2)).alias("char_end"), F.lit(0).alias("sentence_index"), F.lit("").alias("role"), F.when(user, F.concat(F.lit("E"), (F.length("text") % 5).cast("string"))).alias("entity_id"))
    return docs, m


@query(
    """WITH c AS (SELECT conv_id, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
    u AS (SELECT conv_id, i, 'E' || (n % 5) AS e, sum(brk) OVER (PARTITION BY conv_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(n) OVER (PARTITION BY conv_id ORDER BY i) % 3 <> 0 THEN 0 ELSE 1 END AS brk FROM c WHERE role = 'user')),
    a AS (SELECT conv_id, i FROM c WHERE role = 'assistant'),
    g AS (SELECT a.conv_id, a.i, u.run, count(*) AS k, max(u.i) AS last, list_sort(list_distinct(list(u.e))) AS ids FROM a JOIN u ON u.conv_id = a.conv_id AND u.i < a.i GROUP BY a.conv_id, a.i, u.run HAVING count(*) >= 2 AND count(DISTINCT u.e) >= 2),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, i ORDER BY last DESC) AS r FROM g) WHERE r = 1)
    SELECT a.conv_id AS doc_id, CAST(a.i AS INTEGER) AS idx, CASE WHEN len(l.ids) = 2 THEN array_to_string(l.ids, ',') ELSE '' END AS entity_ids, l.ids IS NULL OR len(l.ids) <> 2 AS is_nil FROM a LEFT JOIN l ON l.conv_id = a.conv_id AND l.i = a.i"""
)
def coref_groups(spark, sf):
    docs, m = groups_text(spark, sf)
    return coref.collective(docs, m).select("doc_id", "idx", F.array_join(F.array_sort("entity_ids"), ",").alias("entity_ids"), "is_nil")


@query(
    """WITH r AS (SELECT label % 3 AS doc_id, label AS cluster_id, vec_id AS idx, CASE WHEN vec_id % 4 = 0 THEN 'V' || (vec_id % 9) END AS entity_id FROM embeddings),
    h AS (SELECT doc_id, cluster_id, min(idx) AS idx, arg_min(entity_id, idx) AS e FROM r WHERE entity_id IS NOT NULL GROUP BY doc_id, cluster_id)
    SELECT CAST(r.doc_id AS INTEGER) AS doc_id, CAST(r.cluster_id AS INTEGER) AS cluster_id, r.idx, h.e AS entity_id, h.idx AS resolved_from, CASE WHEN length('m' || r.idx) <= 3 THEN 'PRON' ELSE 'NOUN' END AS mention_type FROM r JOIN h ON h.doc_id = r.doc_id AND h.cluster_id = r.cluster_id WHERE r.entity_id IS NULL"""
)
def cluster_backlink(spark, sf):
    e = t(spark, sf, "embeddings").select((F.col("label") % 3).alias("doc_id"), F.col("label").alias("cluster_id"), F.col("vec_id").alias("idx"), F.concat(F.lit("m"), F.col("vec_id").cast("string")).alias("mention"))
    links = e.where("idx % 4 = 0").select("doc_id", "idx", F.concat(F.lit("V"), (F.col("idx") % 9).cast("string")).alias("entity_id"), F.lit(0.9).alias("confidence"))
    return coref.backlink(e, links).select("doc_id", "cluster_id", "idx", "entity_id", "resolved_from", "mention_type")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(substr(text, 1, CAST(length(text) // 2 AS INTEGER)), '[.!?]')) AS INTEGER) AS sentence_index, CAST(len(regexp_extract_all(text, '[^.!?]+[.!?]*|^[.!?]+')) AS INTEGER) AS pieces FROM documents")
def sentence_index(spark, sf):
    half = F.floor(F.length("text") / 2).cast("int")
    pieces = F.size(F.regexp_extract_all("text", F.lit("([^.!?]+[.!?]*|^[.!?]+)"), F.lit(1)))
    return t(spark, sf, "documents").select("doc_id", tx.sentence_index(F.col("text"), half, "[.!?]").alias("sentence_index"), pieces.alias("pieces"))


@query(
    """WITH d AS (SELECT doc_id, source, list_distinct(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS g FROM documents),
    p AS (SELECT doc_id, g, lag(g) OVER (PARTITION BY source ORDER BY doc_id) AS h FROM d)
    SELECT doc_id, CAST(floor(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) * 1000000) AS BIGINT) AS score_micro FROM p WHERE h IS NOT NULL AND len(list_concat(g, h)) > 0"""
)
def bigram_jaccard(spark, sf):
    return quality.previous_jaccard(t(spark, sf, "documents"), "doc_id", "source", "text").select(F.col("id").alias("doc_id"), micro("j"))


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, vec_id, CAST(r AS INTEGER) AS rank, CAST(round(score * 10000) AS BIGINT) AS score_e4 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10"""
)
def vector_topk(spark, sf):
    e = t(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.top_k(q, e.select("vec_id", F.col("embedding").alias("v"))).select("query_id", "vec_id", "rank", F.round(F.col("score") * 10000).cast("long").alias("score_e4"))


NEAR = """np AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
    WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= CAST(0.3 AS DOUBLE))"""


@query(
    f"""WITH RECURSIVE {NEAR}, un AS (SELECT a AS s, b AS d FROM np UNION SELECT b, a FROM np), rc AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT un.d, rc.c FROM rc JOIN un ON un.s = rc.n)
    SELECT n AS node, min(c) AS comp FROM rc GROUP BY n"""
)
def vector_components(spark, sf):
    """The label stands for the document, within which the reference clusters; links across labels are out of scope."""
    e = t(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    return vectors.components(e.select(F.col("vec_id").alias("node")), vectors.near_links(e, 0.3, F.col("label")))


@query(
    """WITH p AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0) SELECT p.vec_id, CAST(c.label AS INTEGER) AS comp, CAST(round(max(list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) * 10000) AS BIGINT) AS score_e4
    FROM p JOIN embeddings c ON p.vec_id <> c.vec_id GROUP BY 1, 2 HAVING max(list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) >= CAST(0.25 AS DOUBLE)"""
)
def plural_attach(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", F.col("label").alias("comp"), F.col("embedding").alias("v"))
    return vectors.attach_plurals(e.where("vec_id % 50 = 0"), e, 0.25).select("vec_id", "comp", F.round(F.col("score") * 10000).cast("long").alias("score_e4"))


@query(f"WITH {NEAR} SELECT a, b FROM np")
def pairwise_similarity(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    return vectors.near_pairs(e, 0.3, F.col("label")).select("a", "b")


def evaluated(spark, sf) -> DataFrame:
    gold = t(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 0, F.concat(F.lit("Q"), F.col("quality").cast("string"))).alias("gold_id"))
    pred = t(spark, sf, "documents").where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("n_chars") % 5 != 0, F.concat(F.lit("Q"), (F.col("n_chars") % 2).cast("string"))).alias("pred_id"))
    return metrics.paired(gold, pred, ["doc_id"])


EVAL = """ev AS (SELECT l.doc_id, CASE WHEN l.toxic = 0 THEN 'Q' || l.quality END AS g, CASE WHEN d.n_chars % 5 <> 0 THEN 'Q' || (d.n_chars % 2) END AS p, d.doc_id IS NOT NULL AS f FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 11 <> 0) d ON d.doc_id = l.doc_id),
    oc AS (SELECT *, CASE WHEN f AND g IS NULL AND p IS NULL THEN 'correct' WHEN NOT f AND g IS NOT NULL THEN 'missing_prediction' WHEN g IS NULL THEN 'nil_false_negative' WHEN p IS NULL THEN 'nil_false_positive' WHEN g = p THEN 'correct' ELSE 'wrong_entity' END AS o FROM ev)"""


@query(
    f"""WITH {EVAL}, c AS (SELECT count(*) AS total, count(*) FILTER (o = 'correct') AS correct, count(*) FILTER (g IS NOT NULL AND o = 'correct') AS linked_right, count(*) FILTER (g IS NULL AND o = 'correct') AS nil_tp, count(*) FILTER (o = 'nil_false_positive') AS nil_fp, count(*) FILTER (g IS NULL AND o <> 'correct') AS nil_fn, count(*) FILTER (o = 'missing_prediction') AS missing FROM oc)
    SELECT CAST(total AS BIGINT) AS total, CAST(correct AS BIGINT) AS correct, CAST(linked_right AS BIGINT) AS linked_right, CAST(nil_tp AS BIGINT) AS nil_tp, CAST(nil_fp AS BIGINT) AS nil_fp, CAST(nil_fn AS BIGINT) AS nil_fn, CAST(missing AS BIGINT) AS missing,
      CASE WHEN nil_tp + nil_fp = 0 THEN 0 ELSE nil_tp / (nil_tp + nil_fp) END AS nil_precision, CASE WHEN nil_tp + nil_fn = 0 THEN 0 ELSE nil_tp / (nil_tp + nil_fn) END AS nil_recall FROM c"""
)
def eval_linking(spark, sf):
    m = metrics.linking_metrics(evaluated(spark, sf))
    return m.select("total", "correct", "linked_right", "nil_tp", "nil_fp", "nil_fn", "missing", "nil_precision", "nil_recall")


@query(f"WITH {EVAL} SELECT o AS outcome, CAST(count(*) AS BIGINT) AS n FROM oc GROUP BY o")
def eval_bad_cases(spark, sf):
    return quality.histogram(evaluated(spark, sf), metrics.outcome(), "outcome")


@query(
    f"""WITH {EVAL}, j AS (SELECT o, lang, source FROM oc JOIN documents d ON d.doc_id = oc.doc_id)
    SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS dimension, coalesce(lang, source) AS bucket, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (o = 'correct') AS BIGINT) AS correct, count(*) FILTER (o = 'correct') / count(*) AS accuracy
    FROM j GROUP BY GROUPING SETS ((lang), (source))"""
)
def eval_breakdown(spark, sf):
    rows = evaluated(spark, sf).join(t(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return metrics.breakdown(rows, metrics.outcome() == "correct", ["lang", "source"])


@query(
    """WITH s AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_suppkey % 7))) AS g, list_sort(list_distinct(list(l_partkey % 7))) AS p FROM lineitem GROUP BY l_orderkey), c AS (SELECT *, len(list_intersect(g, p)) AS bo FROM s)
    SELECT k AS l_orderkey, g = p AS exact, CAST(bo AS INTEGER) AS overlap, bo / len(p) AS set_precision, bo / len(g) AS set_recall,
      CASE WHEN g = p THEN 'none' WHEN len(g) > bo AND len(p) = bo AND bo > 0 THEN 'partial_set' WHEN len(p) > bo AND len(g) = bo THEN 'superset' WHEN bo > 0 THEN 'overlap' ELSE 'wrong_set' END AS set_error FROM c"""
)
def eval_sets(spark, sf):
    s = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 7).alias("g"), F.collect_set(F.col("l_partkey") % 7).alias("p"))
    return metrics.set_scores(s, "g", "p").select("l_orderkey", "exact", "overlap", "set_precision", "set_recall", "set_error")


@query(
    """WITH r AS (SELECT l_orderkey, min(CASE WHEN l_quantity > 25 THEN l_linenumber END) AS rank FROM lineitem GROUP BY l_orderkey)
    SELECT CAST(count(*) AS BIGINT) AS total, count(*) FILTER (rank <= 1) / count(*) AS recall_at_1, count(*) FILTER (rank <= 3) / count(*) AS recall_at_3, count(*) FILTER (rank <= 5) / count(*) AS recall_at_5 FROM r"""
)
def recall_at_k(spark, sf):
    r = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(F.when(F.col("l_quantity") > 25, F.col("l_linenumber"))).alias("rank"))
    return metrics.recall_at(r, "rank")


@query(
    """WITH a AS (SELECT doc_id, quality = CASE WHEN n_chars % 3 = 0 THEN 0 ELSE 1 END AS c FROM labels JOIN documents USING (doc_id)), b AS (SELECT doc_id, quality = CASE WHEN n_chars % 2 = 0 THEN 0 ELSE 1 END AS c FROM labels JOIN documents USING (doc_id))
    SELECT CASE WHEN NOT a.c AND b.c THEN 'improved' WHEN a.c AND NOT b.c THEN 'degraded' WHEN a.c AND b.c THEN 'both_right' ELSE 'both_wrong' END AS change, CAST(count(*) AS BIGINT) AS n FROM a JOIN b USING (doc_id) GROUP BY 1"""
)
def off_on_compare(spark, sf):
    rows = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    run = lambda k: rows.select("doc_id", (F.col("quality") == F.when(F.col("n_chars") % k == 0, 0).otherwise(1)).alias("correct"))
    return quality.histogram(metrics.compare_runs(run(3), run(2), "doc_id"), F.col("change"), "change")


@query(
    """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels)
    SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c"""
)
def binary_metrics(spark, sf):
    return metrics.binary_metrics(t(spark, sf, "labels"), "quality", "toxic").select("tp", "fp", "fn", "tn", "accuracy")


@query("SELECT lang, CASE WHEN length(text) < 30 THEN '<30' WHEN length(text) < 60 THEN '30-59' WHEN length(text) < 100 THEN '60-99' ELSE '>=100' END AS bucket, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2")
def dataset_profile(spark, sf):
    return t(spark, sf, "documents").groupBy("lang", quality.length_bucket(F.length("text")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, CAST(count(*) AS BIGINT) AS n, count(*) / (SELECT count(*) FROM part) AS share FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 20")
def most_common(spark, sf):
    return quality.most_common(t(spark, sf, "part"), "p_brand")


@query(r"SELECT md5(lower(regexp_replace(text, '[^\p{L}\p{N}\p{M}]+', '', 'g'))) AS group_key, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return quality.exact_duplicates(t(spark, sf, "documents"), tx.normal_text(F.col("text")), "doc_id")


@query("SELECT md5(text) AS k, CAST(count(DISTINCT quality) AS BIGINT) AS labels, CAST(count(*) AS BIGINT) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) > 1")
def conflicting_gold(spark, sf):
    rows = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    return quality.conflicting(rows, [F.md5("text").alias("k")], "quality")


@query()
def near_duplicates(spark, sf):
    return quality.similar_pairs(t(spark, sf, "documents"), "doc_id", "text")


@query("SELECT o_orderkey AS k, 'customer' AS missing FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT l_orderkey, 'part' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)")
def fk_anti_join(spark, sf):
    a = quality.missing_keys(t(spark, sf, "orders"), "o_custkey", t(spark, sf, "customer"), "c_custkey").select(F.col("o_orderkey").alias("k"), F.lit("customer").alias("missing"))
    return a.union(quality.missing_keys(t(spark, sf, "lineitem"), "l_partkey", t(spark, sf, "part"), "p_partkey").select(F.col("l_orderkey"), F.lit("part")))


@query("SELECT p_partkey, issue FROM part, LATERAL (SELECT unnest(CASE WHEN p_size <= 25 THEN ['size_range'] ELSE [] END || CASE WHEN p_retailprice >= 1000 THEN ['price_range'] ELSE [] END) AS issue)")
def field_audit(spark, sf):
    return quality.violations(t(spark, sf, "part"), "p_partkey", {"size_range": F.col("p_size") > 25, "price_range": F.col("p_retailprice") < 1000})


@query("SELECT column_name, found FROM (VALUES ('entity_id', 'absent'), ('n_chars', 'bigint')) v(column_name, found)")
def schema_contract(spark, sf):
    missing = quality.missing_columns(t(spark, sf, "documents"), {"doc_id": "bigint", "text": "string", "entity_id": "string", "n_chars": "int"})
    return spark.createDataFrame(missing, "column_name string, found string")


@query(
    """WITH b AS (SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0), m AS (SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0), f AS (SELECT * FROM m WHERE p_partkey NOT IN (SELECT p_partkey FROM b)), fo AS (SELECT p_name, min(p_partkey) AS o FROM b GROUP BY p_name)
    SELECT 'error' AS severity, 'duplicate_entity_id' AS issue, CAST(p_partkey AS VARCHAR) AS entity_id, NULL AS alias FROM m WHERE p_partkey IN (SELECT p_partkey FROM b)
    UNION ALL SELECT 'warning', 'alias_owned_elsewhere', CAST(f.p_partkey AS VARCHAR), f.p_name FROM f JOIN fo ON fo.p_name = f.p_name"""
)
def kb_upsert(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("standard_name"), F.array().cast("array<string>").alias("aliases"), F.col("p_partkey").alias("entity_ord"))
    return aliases.upsert(p.where("entity_ord % 3 <> 0"), p.where("entity_ord % 2 = 0"))[1].select("severity", "issue", "entity_id", "alias")


@query("SELECT p_partkey, p_type, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS turn FROM part) ORDER BY turn, p_type LIMIT 50")
def balanced_sample(spark, sf):
    return aliases.balanced_sample(t(spark, sf, "part"), "p_type", F.col("p_partkey"), 50).select("p_partkey", "p_type", "turn")


def run_events(spark, sf) -> DataFrame:
    return t(spark, sf, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("status"), F.struct("ts", "event_id").alias("ts"), "event_id")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, arg_max(event_type, (ts, event_id)) AS status, CAST(count(*) AS BIGINT) AS steps FROM events GROUP BY user_id")
def trace_replay(spark, sf):
    e = run_events(spark, sf)
    return trace.latest_runs(e).select("run_id", "status").join(e.groupBy("run_id").agg(F.count("*").alias("steps")), "run_id")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id ORDER BY min((ts, event_id)) DESC, run_id DESC LIMIT 20")
def trace_runs(spark, sf):
    return trace.list_runs(trace.latest_runs(run_events(spark, sf)), 20).select("run_id", "status")


@query(
    """SELECT event_id, 'link_result' AS field, event_type AS old_value, CASE WHEN value > 50 THEN 'U' || user_id ELSE 'NIL' END AS new_value FROM events
    UNION ALL SELECT event_id, 'is_nil', '', CASE WHEN value > 50 THEN 'false' ELSE 'true' END FROM events"""
)
def trace_audit_explode(spark, sf):
    on = F.col("value") > 50
    e = t(spark, sf, "events").select("event_id", F.col("event_type").alias("mention"), F.when(on, F.concat(F.lit("U"), F.col("user_id").cast("string"))).alias("entity_id"), (~on).alias("is_nil"))
    return trace.audit_rows(e).select("event_id", "field", "old_value", "new_value")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_total FROM events GROUP BY event_type")
def stage_counts(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_total"))


@query("SELECT key, event_id AS newest FROM (SELECT md5(props || event_type) AS key, max(event_id) AS event_id FROM events GROUP BY 1) ORDER BY event_id DESC, key DESC LIMIT 500")
def llm_cache(spark, sf):
    e = t(spark, sf, "events").select(tx.cache_key(F.col("props"), F.col("event_type")).alias("key"), F.col("event_id").alias("result"), F.col("event_id").alias("ts"))
    return trace.newest_answers(e).select("key", F.col("result").alias("newest"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'E1' WHEN 1 THEN 'E2' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'E3' END AS answer_id FROM events"""
)
def llm_parse(spark, sf):
    i = F.col("event_id") % 5
    answer = F.when(i == 0, 'so: {"entity_id": "E1", "why": "x"}').when(i == 1, "entity_id: E2").when(i == 2, "NIL").when(i == 3, '{"entity_id": "E9"}').otherwise("I take E3.")
    return t(spark, sf, "events").select("event_id", tx.parse_answer(answer, F.array(F.lit("E1"), F.lit("E2"), F.lit("E3"))).alias("answer_id"))


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, unnest(list_distinct(list_transform(range(1, length(name) - 1), lambda i: substr(name, i, 3)))) AS g FROM n),
    p AS (SELECT DISTINCT a.name, b.name AS other FROM g a JOIN g b ON a.g = b.g AND a.name <> b.name), d AS (SELECT *, levenshtein(name, other) AS distance FROM p)
    SELECT name, other, CAST(distance AS INTEGER) AS distance, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, other) AS r FROM d) WHERE r <= 3"""
)
def hard_negatives(spark, sf):
    return quality.hard_negatives(t(spark, sf, "part").select(F.col("p_name").alias("name")))


@query("SELECT p_partkey, 'passage: 标准实体名：' || p_name || '，别名：' || p_brand || '，类型：' || p_type || CASE WHEN p_size > 25 THEN '，描述：' || p_brand ELSE '' END AS passage FROM part")
def passage_text(spark, sf):
    empty = F.lit(None).cast("string")
    text = tx.passage_text(F.col("p_name"), F.array("p_brand"), F.col("p_type"), F.when(F.col("p_size") > 25, F.col("p_brand")), empty, F.lit(None).cast("array<string>"))
    return t(spark, sf, "part").select("p_partkey", text.alias("passage"))


@query("SELECT replace(p_name, split_part(p_name, ' ', 1), '{}') AS template, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1 HAVING count(*) > 15")
def template_concentration(spark, sf):
    return quality.template_concentration(t(spark, sf, "part"), F.col("p_name"), F.split("p_name", " ")[0])


@query(f"WITH {KB}, {PAIRS}, {CANDS}, {BEST}, dm AS (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(text, '[a-z]{{4,}}')) AS mention FROM documents) SELECT lang, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (score >= CAST(0.9 AS DOUBLE) AND entity_id IS NOT NULL) AS BIGINT) AS linked, CAST(count(*) FILTER (score < CAST(0.9 AS DOUBLE) OR entity_id IS NULL) AS BIGINT) AS nil FROM dm JOIN dec USING (mention) GROUP BY lang")
def link_by_language(spark, sf):
    """The flagship: every distinct word of every document linked, NIL rates by language."""
    d = t(spark, sf, "documents").select("doc_id", "lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]{4,})"), F.lit(1)))).alias("mention"))
    per_word = stored_words(d.groupBy("mention", "lang").agg(F.count("*").alias("n")))
    words = per_word.select("mention").distinct()
    links = decide.decide(words, candidates.generate(words, word_index(spark, sf)), word_entities(spark, sf)).select("mention", "is_nil")
    return per_word.join(links, "mention").groupBy("lang").agg(F.sum("n").alias("total"), F.sum(F.when(~F.col("is_nil"), F.col("n")).otherwise(0)).alias("linked"), F.sum(F.when(F.col("is_nil"), F.col("n")).otherwise(0)).alias("nil"))


@query()
def link_documents(spark, sf):
    """The whole plan on raw texts: gazetteer, candidates, decisions, coreference."""
    docs = t(spark, sf, "documents").select("doc_id", "text")
    done = linking.link(docs, word_entities(spark, sf), None, linking.Options(allow_ner_fallback=True, enable_coreference=True))
    return done.links.select("doc_id", "idx", "mention", "mention_type", "char_start", "char_end", "entity_id", "confidence", "is_nil", "reason")
