"""Disambiguation and NIL decisions over candidate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx


def ranked(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """candidates with standard_name and rank: by score, exact before others, longer names, then as generated."""
    names = entities.select("entity_id", "standard_name")
    order = Window.partitionBy("mention").orderBy(F.desc("score"), F.desc(F.col("method") == "alias_exact"), F.desc(F.length("standard_name")), "cand_ord")
    return candidates.join(names, "entity_id").withColumn("rank", F.row_number().over(order))


def is_nil(entity_id: Column, score: Column, threshold: Column) -> Column:
    """Equality links."""
    return entity_id.isNull() | (score < threshold)


def nil_by_margin(top: Column, second: Column, threshold: float = 0.61, gap: float = 0.05, sure: float = 0.65) -> Column:
    """Too low, or too near the second while not sure."""
    return (top < threshold) | F.coalesce((top - second < gap) & (top < sure), F.lit(False))


def link_reason(has_candidates: Column, nil: Column) -> Column:
    return F.when(~has_candidates, "no_candidates").when(nil, "nil_threshold").otherwise("entity_selected")


def decide(mentions: DataFrame, candidates: DataFrame, entities: DataFrame, threshold: float = lx.NIL_THRESHOLD, llm_trigger: float = lx.LLM_TRIGGER, keep: int = 10) -> DataFrame:
    """One row for each row of mentions: the best candidate, or NIL with null id and confidence 0; score keeps the real
    value, candidates the best ``keep`` as generated, and evidence says what decided."""
    r = ranked(candidates, entities)
    item = F.struct("cand_ord", "entity_id", "standard_name", "score", "method")
    per = r.groupBy("mention").agg(F.max_by(F.struct("entity_id", "standard_name", "score", "method"), F.negative("rank")).alias("best"), F.count("*").alias("candidate_count"), F.slice(F.sort_array(F.collect_list(item)), 1, keep).alias("candidates"))
    out = mentions.join(per, "mention", "left")
    score = F.coalesce("best.score", F.lit(0.0))
    nil = is_nil(F.col("best.entity_id"), score, F.lit(threshold))
    evidence = F.format_string("best candidate %s; score %.2f; by %s; NIL below %.2f", "best.standard_name", "best.score", "best.method", F.lit(threshold))
    evidence = F.when(F.col("best").isNull(), "no candidates").otherwise(F.concat(evidence, F.when(score < llm_trigger, F.lit("; low enough for the language model")).otherwise("")))
    return out.select(
        *mentions.columns,
        F.when(~nil, F.col("best.entity_id")).alias("entity_id"),
        F.when(~nil, F.col("best.standard_name")).alias("standard_name"),
        F.when(nil, 0.0).otherwise(score).alias("confidence"),
        score.alias("score"),
        nil.alias("is_nil"),
        F.when(F.col("best").isNull(), "none").otherwise("fallback_rule").alias("method"),
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        "candidates",
        link_reason(F.col("best").isNotNull(), nil).alias("reason"),
        evidence.alias("evidence"),
    )


def rerank_blend(candidates: DataFrame, key: list[str], base_weight: float = 0.3, rerank_weight: float = 0.7, first: int = 10) -> DataFrame:
    """candidates(key, score, rerank, cand_ord): the first ones get a blend of both scores and are sorted by it; those
    after them keep score and place."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "cand_ord"))
    c = candidates.withColumn("rn", rn)
    blended = F.when(F.col("rn") <= first, base_weight * F.col("score") + rerank_weight * F.col("rerank")).otherwise(F.col("score"))
    c = c.withColumn("blended", blended)
    order = Window.partitionBy(*key).orderBy((F.col("rn") > first), F.when(F.col("rn") <= first, F.negative("blended")).otherwise(0.0), "rn")
    return c.withColumn("place", F.row_number().over(order))


def dispatch(mentions: DataFrame, scored: DataFrame, threshold: float = 0.65, llm_trigger: float = 0.55, gap: float = 0.05, sure: float = 0.65) -> DataFrame:
    """The model path's branch of each mention over scored(mention, entity_id, blended, place): empty mention or no
    candidate gives NIL, a single one its own rule, others the margin rule; low NILs go to the language model."""
    top = scored.groupBy("mention").agg(F.max(F.when(F.col("place") == 1, F.struct("blended", "entity_id"))).alias("a"), F.max(F.when(F.col("place") == 2, F.col("blended"))).alias("second"), F.count("*").alias("n"))
    m = mentions.join(top, "mention", "left")
    n = F.coalesce("n", F.lit(0))
    nil = F.when(F.col("mention") == "", True).when(n == 0, True).when(n == 1, F.col("a.blended") < threshold).otherwise(nil_by_margin(F.col("a.blended"), F.col("second"), threshold, gap, sure))
    branch = F.when(F.col("mention") == "", "empty").when(n == 0, "no_candidates").when(n == 1, "single").otherwise("rerank")
    return m.select(*mentions.columns, branch.alias("branch"), nil.alias("is_nil"), F.when(~nil, F.col("a.entity_id")).alias("entity_id"), F.coalesce("a.blended", F.lit(0.0)).alias("score"), (nil & (n > 0) & (F.col("a.blended") < llm_trigger)).alias("ask_llm"))
