"""Candidate generation: exact, containment and vector candidates of mentions.

Candidates depend on the mention's text alone, so each distinct text is looked
up once and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx

#: Up to so many aliases (counted first) their keys, a few dozen each, are broadcast.
BROADCAST_ALIASES = 20_000
#: The most characters of a key by which strings meet that may hold one another.
KEY_LENGTH = 16


def exact(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """mention, entity_id, score, method, entity_ord: entities that bear the mention as it stands, in snapshot order."""
    m = mentions.select("mention").distinct()
    return m.join(index.select(F.col("alias").alias("mention"), "entity_id", "entity_ord"), "mention").select("mention", "entity_id", F.lit(lx.EXACT_SCORE).alias("score"), F.lit("alias_exact").alias("method"), "entity_ord")


def containment_score(short: Column, long: Column) -> Column:
    """If one string holds the other, their edit distance is the difference of their lengths."""
    ratio = short / long
    similarity = F.lit(1.0) - (long - short) / long
    return F.lit(lx.FUZZY_BASE) + F.lit(lx.FUZZY_RATIO) * ratio + F.lit(lx.FUZZY_SIMILARITY) * similarity


def _contained(m: Column, a: Column) -> Column:
    short, long = F.least(F.length(m), F.length(a)), F.greatest(F.length(m), F.length(a))
    return (short >= lx.MIN_FUZZY_LENGTH) & (short / long >= lx.MIN_FUZZY_RATIO) & (F.contains(a, m) | F.contains(m, a))


def _runs(text: Column, n: Column) -> Column:
    """The distinct runs of n characters, none if the text is shorter."""
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def _lengths(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def containment_pairs(mentions: DataFrame, aliases: DataFrame, plan: str = "auto") -> DataFrame:
    """mention, stripped and alias of all pairs in which one holds the other.

    plan "nested" broadcasts the aliases; "trigram" joins on a run of characters of both. The shorter side has half of
    the longer one's length at least, so a mention meets the aliases around it by its start, up to KEY_LENGTH, among
    their runs of so many characters; aliases inside it meet it by their starts of half its length among its own
    runs. Either way a pair meets once. "auto" counts the aliases to see whether their keys may be broadcast.
    """
    m = mentions.select("mention").distinct().withColumn("stripped", tx.strip_spaces(F.col("mention"))).where("stripped <> ''")
    a = aliases.select("alias").distinct()
    if plan == "nested":
        return m.join(F.broadcast(a), _contained(F.col("stripped"), F.col("alias")))
    s, t = F.col("stripped"), F.col("alias")
    least = lambda c: F.least(F.lit(KEY_LENGTH), F.greatest(F.lit(lx.MIN_FUZZY_LENGTH), F.ceil(F.length(c) * lx.MIN_FUZZY_RATIO - 1e-6).cast("int")))
    most = lambda c: F.least(F.lit(KEY_LENGTH), F.length(c))
    start, held = lambda k: F.concat(F.lit("<"), k), lambda k: F.concat(F.lit(">"), k)
    of_mention = F.concat(F.array(start(F.substring(s, F.lit(1), most(s)))), F.transform(_runs(s, least(s)), held))
    of_alias = F.concat(F.flatten(F.transform(_lengths(least(t), most(t)), lambda n: F.transform(_runs(t, n), start))), F.transform(_lengths(F.lit(lx.MIN_FUZZY_LENGTH), most(t)), lambda n: held(F.substring(t, F.lit(1), n))))
    keys = a.select("alias", F.explode(of_alias).alias("k"))
    if plan == "auto" and a.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES:
        keys = F.broadcast(keys)
    both = m.where(F.length(s) >= lx.MIN_FUZZY_LENGTH).withColumn("k", F.explode(of_mention)).join(keys, "k")
    around = F.startswith("k", F.lit("<")) == (F.length(s) <= F.length(t))
    return both.where(around & _contained(s, t)).select("mention", "stripped", "alias")


def fuzzy(mentions: DataFrame, index: DataFrame, top_k: int = lx.TOP_K, plan: str = "auto") -> DataFrame:
    """mention, entity_id, score, method, entity_ord, alias, rank and the match's measures: of each entity the best alias
    (the first of those that score best), ranked by score, alias length and id, falling."""
    pairs = containment_pairs(mentions, index, plan)
    short, long = F.least(F.length("stripped"), F.length("alias")), F.greatest(F.length("stripped"), F.length("alias"))
    scored = pairs.withColumn("score", containment_score(short, long)).withColumn("length_ratio", short / long).withColumn("edit_distance", long - short)
    rows = scored.join(index.select("alias", "alias_ord", "entity_id", "entity_ord"), "alias")
    best = Window.partitionBy("mention", "entity_id").orderBy(F.desc("score"), "alias_ord", "alias")
    rows = rows.withColumn("_b", F.row_number().over(best)).where("_b = 1")
    order = Window.partitionBy("mention").orderBy(F.desc("score"), F.desc(F.length("alias")), F.desc("entity_id"))
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return rows.select("mention", "entity_id", "score", F.lit("alias_fuzzy").alias("method"), "entity_ord", "alias", "rank", F.length("stripped").alias("mention_length"), F.length("alias").alias("alias_length"), "length_ratio", "edit_distance")


def generate(mentions: DataFrame, index: DataFrame, top_k: int = lx.TOP_K, plan: str = "auto") -> DataFrame:
    """mention, entity_id, score, method, cand_ord: exact candidates, then containment ones (the best top_k of these, less
    entities already there), top_k in all."""
    e = exact(mentions, index).select("mention", "entity_id", "score", "method", F.lit(0).alias("stage"), F.col("entity_ord").cast("long").alias("at"))
    f = fuzzy(mentions, index, top_k, plan).select("mention", "entity_id", "score", "method", F.lit(1).alias("stage"), F.col("rank").cast("long").alias("at"))
    both = e.unionByName(f)
    seen = Window.partitionBy("mention", "entity_id").orderBy("stage", "at")
    both = both.withColumn("_s", F.row_number().over(seen)).where("_s = 1")
    order = Window.partitionBy("mention").orderBy("stage", "at", "entity_id")
    return both.withColumn("cand_ord", F.row_number().over(order)).where(F.col("cand_ord") <= top_k).select("mention", "entity_id", "score", "method", "cand_ord")


def one_way(mentions: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """mention, entity_id, rank: the first k entities by snapshot order with an alias that holds the mention, case aside."""
    m = mentions.select("mention").distinct().withColumn("low", F.lower("mention")).where("low <> ''")
    a = index.groupBy(F.lower("alias").alias("alias"), "entity_id").agg(F.min("entity_ord").alias("entity_ord"))
    short = m.where(F.length("low") < 3)
    long = m.where(F.length("low") >= 3).withColumn("k", F.substring("low", 1, 3)).join(a.withColumn("k", F.explode(tx.ngrams(F.col("alias"), 3))), "k").where(F.contains("alias", "low")).drop("k")
    brief = short.withColumn("k", F.substring("low", 1, 1)).join(a.withColumn("k", F.explode(tx.ngrams(F.col("alias"), 1))), "k").where(F.contains("alias", "low")).drop("k")
    rows = long.unionByName(brief).select("mention", "entity_id", "entity_ord").distinct()
    w = Window.partitionBy("mention").orderBy("entity_ord", "entity_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def combine_scored(alias_hits: DataFrame, vector_hits: DataFrame, top_k: int = 50) -> DataFrame:
    """The model path: alias hits (mention, entity_id, method, score) weighted by method, vector hits (mention, entity_id,
    score) for the places left, no entity twice, by falling score."""
    weight = F.when(F.col("method") == "alias_exact", 1.05).otherwise(1.03)
    a = alias_hits.select("mention", "entity_id", F.least(F.lit(1.0), F.col("score") * weight).alias("score"), "method")
    n = a.groupBy("mention").agg(F.count("*").alias("n"))
    v = vector_hits.join(a.select("mention", "entity_id"), ["mention", "entity_id"], "left_anti")
    w = Window.partitionBy("mention").orderBy(F.desc("score"), "entity_id")
    v = v.join(n, "mention", "left").withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.greatest(F.lit(1), top_k - F.coalesce("n", F.lit(0))))
    out = a.unionByName(v.select("mention", "entity_id", "score", F.lit("vector").alias("method")))
    order = Window.partitionBy("mention").orderBy(F.desc("score"), F.when(F.col("method") == "alias_exact", 0).when(F.col("method") == "alias_fuzzy", 1).otherwise(2), "entity_id")
    return out.withColumn("cand_ord", F.row_number().over(order))
