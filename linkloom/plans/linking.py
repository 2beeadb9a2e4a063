"""The linking plan: texts, mentions and a knowledge base snapshot to links, in one DataFrame plan for all documents."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from ..functions import lexicons as lx
from ..functions import text as tx
from ..operators import aliases, candidates, coref, decide, ner, trace, vectors


@dataclass(frozen=True)
class Options:
    """What a request may set. The NIL threshold is 0.90 unless given."""

    nil_threshold: float = lx.NIL_THRESHOLD
    llm_trigger: float = lx.LLM_TRIGGER
    top_k: int = lx.TOP_K
    linkable_types: tuple[str, ...] = lx.LINKABLE_TYPES
    enable_coreference: bool = False
    coreference_nil_threshold: float = lx.COREF_THRESHOLD
    enable_collective_ambiguity_rejection: bool = True
    allow_ner_fallback: bool = False

    @classmethod
    def of(cls, given: dict | None = None) -> Options:
        """Known keys of a dict, cast to the field's type; others are ignored."""
        base = cls()
        known = {f.name: getattr(base, f.name) for f in fields(cls)}
        return replace(base, **{k: _cast(v, known[k]) for k, v in (given or {}).items() if k in known and v is not None})

    @classmethod
    def load(cls, path: str | None = None, prefix: str = "LINKLOOM_") -> Options:
        """A JSON file if there is one, else environment variables."""
        if path and Path(path).exists():
            return cls.of(json.loads(Path(path).read_text(encoding="utf-8")))
        return cls.of({k.removeprefix(prefix).lower(): v for k, v in os.environ.items() if k.startswith(prefix)})


def _cast(value, like):
    if isinstance(like, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, tuple):
        return tuple(value.split(",")) if isinstance(value, str) else tuple(value)
    return type(like)(value)


@dataclass
class Linked:
    """links (one row a mention), candidates (one a mention text and entity), stages (counts by stage)."""

    links: DataFrame
    candidates: DataFrame
    stages: dict[str, DataFrame]
    input_mode: str


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder, as the steps after them read them many times; untyped columns stay in the plan."""
    if any(isinstance(f.dataType, NullType) for f in rows.schema.fields):
        return rows
    path = vectors._shared(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def link(docs: DataFrame, entities: DataFrame, mentions: DataFrame | None = None, options: Options | None = None) -> Linked:
    """docs(doc_id, text), entities as the readers give them, mentions(doc_id, idx, mention, mention_type, char_start,
    char_end, sentence_index?, role?). Without mentions, the gazetteer finds them if options allow it."""
    o = options or Options()
    index = aliases.alias_index(entities)
    mode = "provided_mentions"
    if mentions is None:
        if o.allow_ner_fallback:
            mode, mentions = "ner_fallback", _stored(found_mentions(docs, entities, index), "mentions")
        else:
            mode = "provided_mentions_required"
            mentions = docs.limit(0).select("doc_id", F.lit(0).alias("idx"), F.lit("").alias("mention"), F.lit("").alias("mention_type"), F.lit(0).alias("char_start"), F.lit(0).alias("char_end"))
    kept = ner.linkable(mentions, o.linkable_types, o.enable_coreference)
    cands = candidates.generate(kept, index, o.top_k)
    links = decide.decide(kept, cands, entities, o.nil_threshold, o.llm_trigger)
    links = links.join(docs.select("doc_id", "text"), "doc_id").withColumn("context", tx.context_window(F.col("text"), F.col("char_start"), F.col("char_end"))).withColumn("mention_norm", tx.normal_mention(F.col("mention")))
    if o.enable_coreference:
        links = _stored(links.withColumn("_sentence", _sentence(links)).drop("text"), "links")
        facts = _for_coref(links)
        resolved = coref.resolve(docs, facts, o.coreference_nil_threshold, reject_ambiguous=o.enable_collective_ambiguity_rejection)
        links = coref.merge_links(links, resolved).drop("_sentence")
    else:
        links = links.drop("text")
    stages = {
        "mention_filter": kept.agg(F.count("*").alias("kept")),
        "candidate_generation": cands.agg(F.count("*").alias("candidates")),
        "nil_decision": links.agg(F.count("*").alias("total"), F.count_if(~F.col("is_nil")).alias("linked"), F.count_if("is_nil").alias("nil")),
    }
    return Linked(links, cands, stages, mode)


def found_mentions(docs: DataFrame, entities: DataFrame, index: DataFrame) -> DataFrame:
    """The gazetteer's mentions, numbered by place, longer ones first."""
    from pyspark.sql import Window

    first = index.groupBy("alias").agg(F.min("alias_ord").alias("alias_ord"), F.min_by("entity_id", F.struct("entity_ord", "at")).alias("entity_id"))
    typed = first.join(entities.select("entity_id", "entity_type"), "entity_id")
    got = ner.gazetteer(docs, typed.select("alias", "alias_ord", "entity_type"))
    order = Window.partitionBy("doc_id").orderBy("char_start", F.desc("char_end"))
    return got.withColumn("idx", F.row_number().over(order) - 1)


def _sentence(links: DataFrame) -> Column:
    """The sentence of a mention beside its text; a missing index is counted from the text."""
    sent = tx.sentence_index(F.col("text"), F.col("char_start"))
    return (F.coalesce(F.col("sentence_index"), sent) if "sentence_index" in links.columns else sent).cast("int")


def _for_coref(links: DataFrame) -> DataFrame:
    """Links as coreference sees them."""
    role = F.coalesce(F.col("role"), F.lit("name")) if "role" in links.columns else F.lit("name")
    return links.select("doc_id", "idx", "mention", "mention_type", "char_start", "char_end", F.col("_sentence").alias("sentence_index"), role.alias("role"), F.when(~F.col("is_nil"), F.col("entity_id")).alias("entity_id"), F.col("standard_name").alias("entity_name"), "confidence")


def stats(links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, linked, nil and coreference_resolved."""
    resolved = F.count_if("is_coreference") if "is_coreference" in links.columns else F.lit(0).cast("long")
    return links.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(~F.col("is_nil")).alias("linked"), F.count_if("is_nil").alias("nil"), resolved.alias("coreference_resolved"))


def record(store: trace.TraceStore, run_id: str, result: Linked, actor: str = "pipeline") -> None:
    """Append a run to the trace store."""
    now, links = F.current_timestamp(), result.links
    spark = links.sparkSession
    run = lambda status: spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit("link").alias("task_name"), F.lit(status).alias("status"), now.alias("ts"), F.lit(actor).alias("actor"), F.to_json(F.create_map(F.lit("input_mode"), F.lit(result.input_mode))).alias("metadata"))
    store.append("pipeline_run", run("running"))
    mid = F.xxhash64(F.lit(run_id), F.col("doc_id").cast("string"), "idx")
    base = links.withColumn("mention_id", mid).withColumn("run_id", F.lit(run_id)).withColumn("ts", now)
    doc = F.col("doc_id").cast("string").alias("doc_id")
    store.append("mention", base.select(F.col("mention_id").alias("id"), "run_id", doc, F.col("mention").alias("mention_text"), F.col("char_start").alias("start_idx"), F.col("char_end").alias("end_idx"), "mention_norm", "context", "ts"))
    c = base.select("run_id", "mention_id", F.explode("candidates").alias("c"))
    store.append("candidate", c.select(F.xxhash64("mention_id", "c.entity_id").alias("id"), "mention_id", "run_id", F.col("c.entity_id").alias("candidate_entity_id"), F.col("c.standard_name").alias("candidate_name"), F.col("c.score").alias("score"), F.to_json("c").alias("metadata")))
    shown = base.select(F.col("mention_id").alias("id"), "mention_id", "run_id", F.coalesce("entity_id", F.lit("")).alias("linked_entity_id"), F.coalesce("standard_name", F.lit("")).alias("linked_entity_name"), "is_nil", "score", F.col("reason").alias("decision_reason"), "evidence", F.lit("").alias("model_version"), F.col("method").alias("actor"), "ts")
    store.append("link_result", shown)
    a = trace.audit_rows(base.select("run_id", "mention_id", "mention", "entity_id", "is_nil", "reason", "ts"))
    store.append("audit_log", a.select(F.xxhash64("mention_id", "field").alias("id"), "mention_id", "run_id", F.col("mention_id").alias("link_result_id"), "field", "old_value", "new_value", "reason", F.lit(actor).alias("actor"), "ts"))
    log = trace.stage_log(run_id, result.stages)
    store.append("pipeline_step", log.select(F.xxhash64("run_id", "stage_name").alias("id"), "run_id", "stage_name", "status", F.lit("").alias("message"), "payload", now.alias("ts")))
    store.append("pipeline_run", run("success"))
