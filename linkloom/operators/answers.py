"""The language model's part of a decision: prompts, what may be asked, and what an answer counts for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Candidates and characters of context that a prompt shows.
MOST_CANDIDATES, MOST_CONTEXT = 10, 500


def prompt(mention: Column, kind: Column, context: Column, candidates: Column) -> Column:
    """The question for a mention; candidates: array of structs with entity_id, standard_name, description."""
    shown = F.transform(F.slice(candidates, 1, MOST_CANDIDATES), lambda c: F.concat_ws(" | ", c["entity_id"], c["standard_name"], F.nullif(c["description"], F.lit(""))))
    hint = F.when(F.coalesce(kind, F.lit("UNKNOWN")) != "UNKNOWN", F.concat(F.lit("Type: "), tx.type_display(kind)))
    near = F.when(F.length(tx.strip_spaces(F.coalesce(context, F.lit("")))) > 0, F.concat(F.lit("Context: "), F.substring(context, 1, MOST_CONTEXT)))
    return F.concat_ws("\n", F.concat(F.lit("Which entity does this mention denote? "), mention), hint, near, F.lit("Candidates:"), F.array_join(shown, "\n"), F.lit('Answer as JSON {"entity_id": one of the ids or "NIL", "reason": ..., "confidence": 0 to 1}.'))


def decided(rows: DataFrame, answers: DataFrame, enabled: bool = True) -> DataFrame:
    """rows(key, candidates) with entity_id, score, method and evidence from answers(key, answer): an id among the first
    candidates counts with the answer's confidence (0.5 if it gives none); NIL and foreign ids are llm_nil, no answer
    llm_failed, a model that is switched off llm_disabled."""
    if not enabled:
        none = [F.lit(None).cast("string").alias("entity_id"), F.lit(0.0).alias("score"), F.lit("llm_disabled").alias("method"), F.lit("the model is switched off").alias("evidence")]
        return rows.select("*", *none)
    ids = F.transform(F.slice("candidates", 1, MOST_CANDIDATES), lambda c: c["entity_id"])
    said = tx.parse_answer(F.col("answer"), ids)
    block = F.regexp_extract("answer", r"(?s)(\{.*\})", 1)
    sure, why = F.get_json_object(block, "$.confidence").try_cast("double"), F.coalesce(F.get_json_object(block, "$.reason"), F.lit(""))
    out = rows.join(answers.select("key", "answer"), "key", "left").withColumn("_e", F.when(F.col("answer").isNotNull(), said))
    method = F.when(F.col("answer").isNull(), "llm_failed").when(F.col("_e").isNull(), "llm_nil").otherwise("llm")
    score = F.when(F.col("_e").isNotNull(), F.coalesce(sure, F.lit(0.5))).otherwise(0.0)
    return out.select(*rows.columns, F.col("_e").alias("entity_id"), score.alias("score"), method.alias("method"), why.alias("evidence"))


def contract(entity_id: Column, score: Column, method: Column, evidence: Column, candidate_ids: Column) -> Column:
    """A model result as one struct: ids that are not candidates count as none, absent fields as their defaults."""
    known = F.when((entity_id != "NIL") & F.array_contains(candidate_ids, entity_id), entity_id)
    return F.struct(known.alias("entity_id"), F.coalesce(score.try_cast("double"), F.lit(0.0)).alias("score"), F.coalesce(method, F.lit("bge")).alias("method"), F.coalesce(evidence, F.lit("")).alias("evidence"))


def enhanced_query(mention: Column, kind: Column, marked: Column, context: Column) -> Column:
    """What a reranker reads of a mention; ``marked`` is the context with the mention marked."""
    hint = F.when(F.coalesce(kind, F.lit("UNKNOWN")).isin("", "UNKNOWN"), F.lit("")).otherwise(F.concat(F.lit("（类型提示："), tx.type_display(kind), F.lit("）")))
    near = F.when(F.length(tx.strip_spaces(F.coalesce(marked, F.lit("")))) > 0, F.concat(F.lit("所属上下文："), F.substring(marked, 1, MOST_CONTEXT)))
    clues = F.nullif(tx.context_clues(F.coalesce(context, F.lit("")), mention), F.lit(""))
    return F.concat_ws("；", F.concat(F.lit("需要消歧的实体指称：“"), mention, F.lit("”"), hint), near, clues, F.concat(F.lit("请判断该实体指称“"), mention, F.lit("”对应哪个标准实体")))


def enhanced_passage(entity: DataFrame) -> DataFrame:
    """entity(entity_id, standard_name, aliases, entity_type, description, metadata) with passage, what a reranker reads."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    part = lambda label, c, ok=None: F.when(given(c) if ok is None else ok, F.concat(F.lit(label), c))
    aliases, kind, name = F.coalesce("aliases", F.array().cast("array<string>")), F.col("entity_type"), F.col("standard_name")
    shown, meta = tx.type_display(kind), lambda k: F.try_element_at(F.col("metadata"), F.lit(k))
    tags = F.array_join(F.slice(F.coalesce(F.from_json(meta("tags"), "array<string>"), F.array().cast("array<string>")), 1, 5), "、")
    short, main = F.substring_index(shown, "（", 1), F.get(aliases, 0)
    also = F.when(given(main) & (main != name), F.concat(F.lit("（又称"), main, F.lit("）"))).otherwise(F.lit(""))
    trait = F.when(given(F.col("description")) & given(kind), F.concat(F.lit("实体特征："), short, F.lit("「"), name, F.lit("」"), also))
    text = F.concat_ws(
        "；",
        F.concat(F.lit("实体ID："), "entity_id"),
        F.concat(F.lit("标准名称："), name),
        part("别名/简称：", F.array_join(aliases, "、"), F.size(aliases) > 0),
        part("实体类型：", shown, given(kind) & (kind != "UNKNOWN")),
        part("实体描述：", F.substring("description", 1, 200), given(F.col("description"))),
        part("所属行业/领域：", meta("industry")),
        part("标签/关键词：", tags),
        part("缩写：", meta("abbreviation")),
        part("数据来源：", meta("source")),
        trait,
    )
    return entity.withColumn("passage", text)
