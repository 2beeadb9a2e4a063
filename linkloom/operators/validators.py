"""Contracts of evaluation sets: rows (id, issue) for what breaks one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .quality import violations

DIFFICULTIES = ("easy", "medium", "hard")
SUBSETS = ("acceptance_main", "challenge_dev")
#: Acceptance samples up to this number are older than the contract of subset, difficulty and case fields.
FIRST_OF_CONTRACT = 61


def _given(c: str) -> Column:
    return F.length(tx.strip_spaces(F.coalesce(F.col(c), F.lit("")))) > 0


def _none(c: str) -> Column:
    return F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 0


def _distinct(c: str) -> Column:
    return F.size(F.array_distinct(c)) == F.size(c)


def coreference_contract(cases: DataFrame) -> DataFrame:
    """sample_id, issue of cases(sample_id, entity_id, entity_ids, is_nil, is_collective, declared); cases without
    entity_ids or is_collective are of the older layout and pass. declared: entity ids of the sample's mentions."""
    many, nil, ids = F.col("is_collective"), F.col("is_nil"), F.col("entity_ids")
    success = F.col("entity_id").isNull() & (F.size(ids) >= 2) & _distinct("entity_ids") & (F.size(F.array_except(ids, "declared")) == 0)
    rules = {
        "invalid_collective_success_contract": ~(many & ~nil) | success,
        "invalid_collective_nil_contract": ~(many & nil) | (F.col("entity_id").isNull() & _none("entity_ids")),
        "ordinary_nil_has_entity_ids": ~(~many & nil) | _none("entity_ids"),
        "single_entity_ids_inconsistent": ~(~many & ~nil) | F.col("entity_id").isNull() | _none("entity_ids") | (ids == F.array("entity_id")),
    }
    return violations(cases.where(ids.isNotNull() & many.isNotNull()), "sample_id", rules)


def nil_units(expected_ids: Column, has_entity: Column, expected_id: Column, coreference_nil: Column, flagged: Column) -> Column:
    """How many NIL units a sample labels: of its list of ids, else of its one entity, else of its coreference cases, else
    of its flags; an absent layout is null (has_entity: whether it has the one entity, whose id may be null)."""
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    return F.coalesce(
        F.size(F.filter(expected_ids, blank)) + F.when(expected_ids.isNull(), F.lit(None)).otherwise(0),
        F.when(has_entity, blank(expected_id).cast("int")),
        F.when(coreference_nil.isNotNull(), F.size(F.filter(coreference_nil, lambda x: F.coalesce(x, F.lit(False))))),
        F.when(F.coalesce(flagged, F.lit(False)), 1).otherwise(0),
    )


def alignment(inputs: DataFrame, gold: DataFrame) -> DataFrame:
    """line_no, issue where inputs(line_no, mentions) and gold(line_no, mentions, entity_ids, has_nil) do not agree."""
    i = inputs.select("line_no", F.col("mentions").alias("_im"), F.lit(True).alias("_i"))
    both = i.join(gold.select("line_no", "mentions", "entity_ids", "has_nil", F.lit(True).alias("_g")), "line_no", "full_outer")
    there = F.col("_i").isNotNull() & F.col("_g").isNotNull()
    nil = F.exists("entity_ids", lambda x: x.isNull())
    return violations(both, "line_no", {"input_missing": F.col("_i").isNotNull(), "gold_missing": F.col("_g").isNotNull(), "mentions_differ": ~there | (F.col("_im") == F.col("mentions")), "has_nil_differs": ~there | (F.col("has_nil") == nil)})


def rules_of(kind: str) -> dict[str, Column]:
    """What must hold of a sample of a dataset: id, text and difficulty always, the rest by kind."""
    rules = {"id_missing": _given("id"), "text_missing": _given("text"), "difficulty_unknown": F.col("difficulty").isin(*DIFFICULTIES)}
    mention = {"mention_not_in_text": F.contains(F.coalesce("text", F.lit("")), F.col("mention"))}
    nil = {"nil_differs_from_gold": F.col("expected_nil") == F.col("gold_id").isNull()}
    among = {"gold_not_among_candidates": F.col("gold_id").isNull() | F.array_contains("candidates", F.col("gold_id"))}
    more = {
        "mention_linking": {"offsets_wrong": tx.span_holds(F.col("text"), F.col("char_start"), F.col("char_end"), F.col("mention"))},
        "alias": mention | {"negative_has_gold": ~F.col("is_negative") | F.col("gold_id").isNull()},
        "candidates": mention | among | {"candidates_missing": F.size("candidates") > 0},
        "disambiguation": mention | nil | among,
        "composite": nil | {"scenario_missing": _given("scenario")},
        "fallback": mention | nil | among | {"ambiguity_type_missing": _given("ambiguity_type")},
        "coreference": {"no_cases": F.size("cases") > 0},
        "batch": {"no_mentions": F.size("expected") > 0},
    }
    if kind not in more:
        raise ValueError(f"no rules for {kind}; there are {', '.join(more)}")
    return rules | more[kind]


def validate(samples: DataFrame, kind: str) -> DataFrame:
    """id, issue of the samples of a dataset."""
    return violations(samples, "id", rules_of(kind))


def acceptance(cases: DataFrame, entities: DataFrame) -> DataFrame:
    """sample_id, issue of cases(sample_id, number, subset, difficulty, scenario, conjunction, anaphor, mention,
    sentence_distance, evidence, is_collective, is_nil, entity_ids, antecedent_indices, n_mentions): contracts of the set
    that runs against the knowledge base. ``mention`` is the text of the case's own mention."""
    old, won = F.col("number") < FIRST_OF_CONTRACT, F.col("is_collective") & ~F.col("is_nil")
    at = F.col("antecedent_indices")
    rules = {
        "invalid_or_missing_acceptance_subset": old | F.col("subset").isin(*SUBSETS),
        "invalid_or_missing_acceptance_difficulty": old | F.col("difficulty").isin(*DIFFICULTIES),
        "missing_acceptance_scenario": old | _given("scenario"),
        "missing_acceptance_conjunction": old | _given("conjunction"),
        "missing_acceptance_anaphor": old | _given("anaphor"),
        "acceptance_anaphor_mismatch": old | ~_given("anaphor") | F.col("mention").isNull() | (F.col("anaphor") == F.col("mention")),
        "invalid_acceptance_sentence_distance": old | (F.col("sentence_distance") >= 0),
        "missing_acceptance_evidence": old | _given("evidence"),
        "invalid_acceptance_antecedent_indices": ~won | ((F.size(at) >= 2) & F.forall(at, lambda i: (i >= 0) & (i < F.col("n_mentions")))),
        "invalid_acceptance_collective_entity_ids": ~won | ((F.size("entity_ids") >= 2) & _distinct("entity_ids")),
    }
    said = violations(cases, "sample_id", rules)
    named = cases.where(won).select("sample_id", F.explode("entity_ids").alias("_e"))
    unknown = named.join(entities.select(F.col("entity_id").alias("_k")).distinct(), F.col("_e") == F.col("_k"), "left_anti")
    return said.union(unknown.select("sample_id", F.lit("invalid_acceptance_collective_entity_ids").alias("issue"))).distinct()


def coverage(texts: DataFrame, column: str, markers: tuple[str, ...]) -> DataFrame:
    """marker, n: texts that hold each marker, 0 for one that none holds."""
    hits = texts.select(F.explode(tx.terms_in(F.coalesce(column, F.lit("")), markers)).alias("marker")).groupBy("marker").agg(F.count("*").alias("n"))
    every = texts.sparkSession.createDataFrame([(m,) for m in markers], "marker string")
    return every.join(hits, "marker", "left").select("marker", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def not_continuous(rows: DataFrame, id_col: str, place: Column, prefix: str) -> DataFrame:
    """Rows whose id is not prefix_NNN of their place, counted from 1."""
    want = F.format_string(prefix + "_%03d", place.cast("long"))
    return rows.withColumn("expected_id", want).where(~F.col(id_col).eqNullSafe(F.col("expected_id")))


def unknown_ids(rows: DataFrame, id_col: str, entities: DataFrame, fixtures: tuple[str, ...] = ("TEST_", "PER_TEST_", "SYS_TEST_")) -> DataFrame:
    """entity_id, category of ids that no entity has: those of fixtures by their prefix, others unconfirmed."""
    ids = rows.select(F.col(id_col).alias("entity_id")).where("entity_id is not null").distinct()
    lost = ids.join(entities.select(F.col("entity_id").alias("_k")).distinct(), F.col("entity_id") == F.col("_k"), "left_anti")
    fixture = F.lit(False)
    for p in fixtures:
        fixture = fixture | F.startswith("entity_id", F.lit(p))
    return lost.select("entity_id", F.when(fixture, "fixture").otherwise("unconfirmed").alias("category"))
