"""Profiles of evaluation sets: counts by measure and bucket, each set read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .quality import length_bucket

#: Surfaces that a profile counts as collective, and those that make a line look like coreference.
PROFILE_COLLECTIVES = ("两家公司", "两家企业", "两家央企", "两家高校", "两所高校", "上述银行", "这些企业", "这些机构", "多家企业", "多家机构", "双方", "二者", "它们", "他们", "她们")
COREFERENCE_MARKS = ("该公司", "该机构", "前者", "后者", "上述", "这些", "他们", "它们")
LONG_TEXT = 80


def counted(rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """measure, bucket, n: how many rows show each value of each measure; a null is not counted."""
    items = F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("string").alias("bucket")) for m, c in measures.items()])
    return rows.select(F.explode(items).alias("i")).where("i.bucket is not null").groupBy("i.measure", "i.bucket").agg(F.count("*").alias("n"))


def _yes(c: Column) -> Column:
    return F.when(c, "yes")


def _or_empty(c: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(c, F.array().cast(kind))


def with_gold_type(samples: DataFrame, entities: DataFrame) -> DataFrame:
    """samples(gold_id) with entity_type: NIL without a gold id, UNKNOWN if no entity has it."""
    e = entities.select(F.col("entity_id").alias("_e"), F.col("entity_type").alias("_t")).dropDuplicates(["_e"])
    kind = F.when(F.col("gold_id").isNull(), "NIL").otherwise(F.coalesce("_t", F.lit("UNKNOWN")))
    return samples.join(e, F.col("gold_id") == F.col("_e"), "left").withColumn("entity_type", kind).drop("_e", "_t")


def composite(samples: DataFrame) -> DataFrame:
    """Of samples(gold_id, entity_type, difficulty, scenario, text): labels, difficulties, types, text lengths, scenarios."""
    got = counted(
        samples,
        {
            "label": F.when(F.col("gold_id").isNull(), "nil").otherwise("linked"),
            "difficulty": F.coalesce("difficulty", F.lit("unknown")),
            "entity_type": F.col("entity_type"),
            "text_length": length_bucket(F.length(F.coalesce("text", F.lit("")))),
        },
    )
    one = samples.agg((F.countDistinct("scenario") + F.max(F.col("scenario").isNull().cast("int"))).alias("n"))
    return got.unionByName(one.select(F.lit("scenarios").alias("measure"), F.lit("distinct").alias("bucket"), F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def candidates(samples: DataFrame) -> DataFrame:
    """Of samples(gold_id, candidates): whether gold is among them, whether another one is, and how many there are."""
    c, gold = _or_empty(F.col("candidates")), F.col("gold_id")
    return counted(
        samples,
        {
            "label": F.when(gold.isNull(), "nil_like").otherwise("positive"),
            "gold_among": F.when(gold.isNotNull(), F.when(F.array_contains(c, gold), "yes").otherwise("no")),
            "hard_negative": _yes(F.when(gold.isNull(), F.size(c) > 0).otherwise(F.exists(c, lambda x: x != gold))),
            "candidate_count": F.size(c),
        },
    )


def coreference(samples: DataFrame) -> DataFrame:
    """Of samples(mentions(mention, entity_id, sentence_index), cases(mention_index, entity_id, is_nil)): cases, sentence
    gaps to the nearest mention of the case's entity before it, collective surfaces, samples with several antecedents or NIL cases."""
    nil = lambda c: F.coalesce(c["is_nil"], F.lit(False)) | c["entity_id"].isNull()
    of_sample = counted(
        samples,
        {
            "several_antecedents": _yes(F.size(F.filter("mentions", lambda m: m["entity_id"].isNotNull())) > 1),
            "nil_mixed": _yes(F.exists("cases", nil)),
        },
    )
    each = samples.select("mentions", F.explode("cases").alias("c"))
    at = F.col("c.mention_index")
    each = each.withColumn("m", F.when(at >= 0, F.get("mentions", at)))
    before = F.filter("mentions", lambda m, i: (i < at) & (m["entity_id"] == F.col("c.entity_id")))
    each = each.withColumn("gap", F.when(F.col("m").isNotNull(), F.col("m.sentence_index") - F.array_max(F.transform(before, lambda m: m["sentence_index"]))))
    many, gap = F.col("m.mention").isin(*PROFILE_COLLECTIVES), F.col("gap")
    of_case = counted(
        each,
        {
            "cases": F.lit("all"),
            "collective": _yes(many),
            "cross_sentence": _yes(gap >= 1),
            "cross_three": _yes(gap >= 3),
            "simple_single": _yes((gap <= 1) & ~many),
            "surface": F.col("m.mention"),
        },
    )
    return of_sample.unionByName(of_case)


def fallback(samples: DataFrame) -> DataFrame:
    """Of samples(expected_nil, candidates, difficulty, ambiguity_type, text) put to a language model."""
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    return counted(
        samples,
        {
            "label": F.when(F.coalesce("expected_nil", F.lit(False)), "nil").otherwise("linked"),
            "difficulty": unknown("difficulty"),
            "ambiguity_type": unknown("ambiguity_type"),
            "candidate_count": F.size(_or_empty(F.col("candidates"))),
            "text_length": length_bucket(F.length(F.coalesce("text", F.lit("")))),
        },
    )


def batch(entries: DataFrame) -> DataFrame:
    """Of entries(text, expected(mention, entity_id)): long lines, several mentions, NIL beside links, repeats."""
    e = F.col("expected")
    ids, names = F.transform(e, lambda x: x["entity_id"]), F.transform(e, lambda x: x["mention"])
    return counted(
        entries,
        {
            "mention_count": F.size(e),
            "long_text": _yes(F.length("text") >= LONG_TEXT),
            "multi_mention": _yes(F.size(e) > 1),
            "nil_mixed": _yes(F.exists(ids, lambda x: x.isNull()) & F.exists(ids, lambda x: x.isNotNull())),
            "repeated_mention": _yes(F.size(names) != F.size(F.array_distinct(names))),
            "coreference_like": _yes(tx.contains_any(F.col("text"), COREFERENCE_MARKS)),
        },
    )


def mean_latency(calls: DataFrame, by: str, seconds: str) -> DataFrame:
    """Calls and their mean seconds."""
    return calls.groupBy(by).agg(F.count(seconds).alias("calls"), F.avg(seconds).alias("mean_seconds"))
