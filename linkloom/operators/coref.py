"""Coreference: single, ordinal and collective anaphors.

mentions: doc_id, idx (order in the document), mention, mention_type,
char_start, char_end, sentence_index, role, entity_id, entity_name, confidence.

Only an anaphor of a type that its own expectation accepts can become an
antecedent (ORG, PERSON, GPE, LOC); a document without such anaphors resolves as
joins, the others go through a fold by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx


def normal_type(kind: Column) -> Column:
    k = F.upper(F.coalesce(F.nullif(kind, F.lit("")), F.lit("UNKNOWN")))
    return F.when(k.isin("ORGANIZATION", "COMPANY", "INSTITUTION"), "ORG").when(k.isin("PER", "PERSON"), "PERSON").otherwise(k)


def is_anaphor(mention: Column, kind: Column, role: Column) -> Column:
    m = tx.squash(mention)
    listed = m.isin(*lx.ORG_ANAPHORS, *lx.PERSON_ANAPHORS, *lx.COLLECTIVE_ANAPHORS, *lx.ORDINALS)
    return F.lower(F.coalesce(role, F.lit(""))).isin("pronoun", "anaphor", "coreference") | F.upper(F.coalesce(kind, F.lit(""))).isin(*lx.PRONOUN_TYPES) | listed


def is_collective(mention: Column) -> Column:
    return tx.squash(mention).isin(*lx.COLLECTIVE_ANAPHORS)


def expected_type(mention: Column, kind: Column) -> Column:
    m, k = tx.squash(mention), normal_type(kind)
    return F.when(m.isin(*lx.PERSON_ANAPHORS), "PERSON").when(m.isin(*lx.ORG_ANAPHORS), "ORG").when(k == "PERSON", "PERSON").when(k.isin("ORG", "PRON", "NOUN", "UNKNOWN"), "ORG").otherwise(k)


def compatible(expected: Column, kind: Column) -> Column:
    e, k = normal_type(expected), normal_type(kind)
    return e.isin("UNKNOWN", "PRON", "NOUN") | (e == k) | ((e == "ORG") & k.isin("GPE", "LOC")) | ((e == "LOC") & (k == "GPE"))


def cardinality_ok(mention: Column, n: Column) -> Column:
    m = tx.squash(mention)
    return F.when(m.isin(*lx.EXACTLY_TWO), n == 2).when(m.isin(*lx.EXACTLY_THREE), n == 3).otherwise(n >= 2)


def antecedent_score(distance: Column, gap: Column, same_type: Column) -> Column:
    d = F.greatest(F.lit(1), distance)
    score = F.lit(0.82) - F.lit(0.06) * (d - 1) - F.lit(0.05) * gap
    score = F.when(gap == 0, score + F.lit(0.08)).otherwise(score)
    return F.when(same_type, score + F.lit(0.05)).otherwise(score)


def single(mentions: DataFrame, threshold: float = lx.COREF_THRESHOLD, max_gap: int = lx.MAX_SENTENCE_GAP) -> DataFrame:
    """Each single anaphor's best named antecedent: doc_id, idx, antecedent_idx, entity_id, score, rule, is_nil.

    The self-join meets on document and sentence: a gap of at most max_gap is that many more keys.
    """
    anaphor = is_anaphor(F.col("mention"), F.col("mention_type"), F.col("role"))
    seek = mentions.where(anaphor & ~is_collective(F.col("mention")))
    named = mentions.where(F.col("entity_id").isNotNull() & ~anaphor)
    exp = expected_type(F.col("mention"), F.col("mention_type"))
    s = seek.select("doc_id", "idx", "sentence_index", exp.alias("expected"))
    a = named.select(F.col("doc_id").alias("_d"), F.col("idx").alias("a_idx"), F.col("sentence_index").alias("a_sent"), F.col("mention_type").alias("a_type"), F.col("entity_id").alias("a_entity"))
    gap = F.greatest(F.lit(0), F.col("sentence_index") - F.col("a_sent"))
    keyed = s.withColumn("_k", F.explode(F.sequence(F.col("sentence_index") - max_gap, F.col("sentence_index"))))
    pairs = keyed.join(a, (F.col("doc_id") == F.col("_d")) & (F.col("_k") == F.col("a_sent"))).drop("_k")
    # where sentences do not rise with idx, a mention before may be of a later sentence: gap 0
    back = F.max("sentence_index").over(Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)) > F.col("sentence_index")
    odd = mentions.select(F.col("doc_id").alias("_o"), back.alias("_b")).where("_b").select("_o").distinct()
    behind = s.join(odd, F.col("doc_id") == F.col("_o"), "left_semi").join(a, (F.col("doc_id") == F.col("_d")) & (F.col("a_sent") > F.col("sentence_index")))
    pairs = pairs.unionByName(behind).drop("_d").where((F.col("a_idx") < F.col("idx")) & (gap <= max_gap) & compatible(F.col("expected"), F.col("a_type")))
    score = antecedent_score(F.col("idx") - F.col("a_idx"), gap, normal_type(F.col("expected")) == normal_type(F.col("a_type")))
    best = pairs.groupBy("doc_id", "idx").agg(F.max(F.struct(score.alias("score"), "a_idx", "a_entity")).alias("b"))
    out = seek.select("doc_id", "idx", "mention").join(best, ["doc_id", "idx"], "left")
    low = F.col("b.score") < threshold
    nil = F.col("b").isNull() | low
    rule = F.when(F.col("b").isNull(), "no_compatible_antecedent").when(low, "below_nil_threshold").otherwise("recency_type_sentence")
    return out.select("doc_id", "idx", "mention", F.col("b.a_idx").alias("antecedent_idx"), F.when(~nil, F.col("b.a_entity")).alias("entity_id"), F.coalesce("b.score", F.lit(0.0)).alias("score"), rule.alias("rule"), nil.alias("is_nil"))


def ordinal(mentions: DataFrame) -> DataFrame:
    """The former and the latter: the last but one and the last named mention before; needs two."""
    place = F.try_element_at(F.create_map(*[F.lit(x) for kv in lx.ORDINALS.items() for x in kv]), tx.squash(F.col("mention")))
    seek = mentions.withColumn("ordinal", place).where("ordinal is not null").select("doc_id", "idx", "mention", "ordinal")
    named = mentions.where(F.col("entity_id").isNotNull() & ~is_anaphor(F.col("mention"), F.col("mention_type"), F.col("role")))
    a = named.select("doc_id", F.col("idx").alias("a_idx"), F.col("entity_id").alias("a_entity"))
    w = Window.partitionBy("doc_id", "idx").orderBy(F.desc("a_idx"))
    pairs = seek.join(a, "doc_id").where("a_idx < idx").withColumn("r", F.row_number().over(w)).where("r <= 2").withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "idx")))
    return pairs.where((F.col("n") == 2) & (F.col("r") == 2 - F.col("ordinal"))).select("doc_id", "idx", "mention", F.col("a_idx").alias("antecedent_idx"), F.col("a_entity").alias("entity_id"), F.lit(0.86).alias("score"))


def coordinated_groups(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """doc_id, idx (of the collective anaphor), group_no, indices, entity_ids, surfaces, start, end: runs of named mentions
    before it in its sentence that conjunctions join, all linked, all ORG or all PERSON, of two entities or more."""
    seek = mentions.where(is_collective(F.col("mention"))).select("doc_id", "idx", F.col("sentence_index").alias("s"), F.col("char_start").alias("t_start"))
    named = mentions.where(~is_anaphor(F.col("mention"), F.col("mention_type"), F.col("role"))).select("doc_id", F.col("idx").alias("m_idx"), F.col("sentence_index").alias("s"), "char_start", "char_end", "mention", normal_type(F.col("mention_type")).alias("kind"), F.nullif("entity_id", F.lit("")).alias("entity_id"))
    rows = seek.join(named, ["doc_id", "s"]).where("m_idx < idx and char_end <= t_start").join(docs.select("doc_id", "text"), "doc_id")
    w = Window.partitionBy("doc_id", "idx").orderBy("m_idx")
    before = F.lag("char_end").over(w)
    between = tx.span(F.col("text"), before, F.col("char_start"))
    joined = before.isNotNull() & (F.col("char_start") >= before) & tx.contains_any(between, lx.CONJUNCTIONS)
    rows = rows.withColumn("brk", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("brk").over(w))
    item = F.struct("m_idx", "entity_id", "mention")
    groups = rows.groupBy("doc_id", "idx", "island").agg(
        F.count("*").alias("n"), F.count("entity_id").alias("linked"), F.countDistinct("kind").alias("kinds"), F.min("kind").alias("kind"), F.sort_array(F.collect_list(item)).alias("m"),
        F.min_by("char_start", "m_idx").alias("start"), F.max_by("char_end", "m_idx").alias("end"),
    )
    ids = F.array_distinct(F.transform("m", lambda x: x["entity_id"]))
    legal = groups.where("n >= 2 and linked = n and kinds = 1 and kind in ('ORG', 'PERSON')").withColumn("entity_ids", ids).where(F.size("entity_ids") >= 2)
    order = Window.partitionBy("doc_id", "idx").orderBy("island")
    return legal.select("doc_id", "idx", F.row_number().over(order).alias("group_no"), F.transform("m", lambda x: x["m_idx"]).alias("indices"), "entity_ids", F.transform("m", lambda x: x["mention"]).alias("surfaces"), "start", "end")


def ambiguity(group_count: Column, cardinality: Column, between: Column, surfaces: Column, intervening: Column) -> Column:
    """Whether a collective reading is too ambiguous: several groups, no repetition of the nearest one's names, and a
    switch of subject (with another linked entity in between) or a reset of the event."""
    continuation = F.forall(surfaces, lambda s: F.contains(between, s))
    switch = intervening & tx.contains_any(between, lx.SWITCH_TERMS)
    reset = tx.contains_any(between, lx.RESET_TERMS)
    evidence = cardinality.cast("int") + 1 + continuation.cast("int")
    return (group_count >= 2) & cardinality & ~continuation & (switch | reset) & (evidence <= lx.MAX_EVIDENCE)


def collective(docs: DataFrame, mentions: DataFrame, reject_ambiguous: bool = True) -> DataFrame:
    """Each collective anaphor: doc_id, idx, mention, entity_ids, indices, score, rule, is_nil, groups."""
    seek = mentions.where(is_collective(F.col("mention"))).select("doc_id", "idx", "mention", "char_start")
    groups = coordinated_groups(docs, mentions)
    last = groups.groupBy("doc_id", "idx").agg(F.max_by(F.struct("entity_ids", "indices", "surfaces", "end"), "group_no").alias("g"), F.count("*").alias("groups"))
    rows = seek.join(last, ["doc_id", "idx"], "left").join(docs.select("doc_id", "text"), "doc_id")
    linked = mentions.where(F.coalesce("entity_id", F.lit("")) != "").select("doc_id", F.col("char_start").alias("o_start"), F.col("char_end").alias("o_end"), F.col("mention").alias("o_mention"), F.col("idx").alias("o_idx"))
    other = rows.where("groups >= 2").join(linked, "doc_id").where((F.col("o_start") >= F.col("g.end")) & (F.col("o_end") <= F.col("char_start")) & ~F.array_contains("g.surfaces", F.col("o_mention")) & (F.col("o_idx") != F.col("idx"))).select("doc_id", "idx").distinct().withColumn("_i", F.lit(True))
    rows = rows.join(other, ["doc_id", "idx"], "left")
    n = F.coalesce(F.size("g.entity_ids"), F.lit(0))
    ok = F.coalesce(cardinality_ok(F.col("mention"), n) & F.col("g").isNotNull(), F.lit(False))
    unclear = F.coalesce(ambiguity(F.col("groups"), ok, tx.span(F.col("text"), F.col("g.end"), F.col("char_start")), F.col("g.surfaces"), F.coalesce("_i", F.lit(False))), F.lit(False)) & F.lit(reject_ambiguous)
    rule = F.when(unclear, "collective_ambiguity_rejection").when(ok, "collective_coordinated_antecedents").otherwise("collective_unresolved")
    found = ok & ~unclear
    return rows.select("doc_id", "idx", "mention", F.when(found, F.col("g.entity_ids")).otherwise(F.array().cast("array<string>")).alias("entity_ids"), F.when(found, F.col("g.indices")).alias("indices"), F.when(found, 0.9).otherwise(0.0).alias("score"), rule.alias("rule"), (~found).alias("is_nil"), F.coalesce("groups", F.lit(0)).alias("groups"))


RESOLVED = "doc_id long, idx int, mention string, entity_id string, antecedent_idx int, score double, rule string, is_nil boolean"


def _normal(kind: str | None) -> str:
    k = (kind or "UNKNOWN").upper()
    return "ORG" if k in ("ORGANIZATION", "COMPANY", "INSTITUTION") else "PERSON" if k in ("PER", "PERSON") else k


class Stack:
    """A document's antecedents so far; also the state of the streaming form."""

    def __init__(self, threshold: float, max_gap: int, held: list[tuple] | None = None):
        self.threshold, self.max_gap = threshold, max_gap
        self.held: list[tuple] = held or []  # idx, type, sentence, entity, named

    def resolve(self, idx: int, mention: str, kind: str | None, sentence: int, role: str | None, entity: str | None, confidence: float) -> tuple:
        m = "".join(mention.split())
        listed = m in lx.ORG_ANAPHORS or m in lx.PERSON_ANAPHORS or m in lx.ORDINALS
        anaphor = (role or "").lower() in ("pronoun", "anaphor", "coreference") or (kind or "").upper() in lx.PRONOUN_TYPES or listed or m in lx.COLLECTIVE_ANAPHORS
        if entity and not anaphor:
            self.held.append((idx, _normal(kind), sentence, entity, True))
            return entity, idx, 1.0, "linked_name", False
        if m in lx.COLLECTIVE_ANAPHORS:
            return None, None, 0.0, "collective", True  # decided by collective()
        if m in lx.ORDINALS:
            named = [h for h in self.held if h[4]]
            if len(named) >= 2:
                h = named[-2 + lx.ORDINALS[m]]
                self.held.append((idx, _normal(kind), sentence, h[3], False))
                return h[3], h[0], 0.86, "ordinal_pair", False
        if not anaphor:
            return None, None, 0.0, "unlinked_name_nil", True
        k = _normal(kind)
        want = "PERSON" if m in lx.PERSON_ANAPHORS else "ORG" if m in lx.ORG_ANAPHORS else "PERSON" if k == "PERSON" else "ORG" if k in ("ORG", "PRON", "NOUN", "UNKNOWN") else k
        best = None
        for h in self.held:
            gap = max(0, sentence - h[2])
            fits = want == h[1] or (want == "ORG" and h[1] in ("GPE", "LOC")) or (want == "LOC" and h[1] == "GPE")
            if gap > self.max_gap or not fits:
                continue
            score = 0.82 - 0.06 * (max(1, idx - h[0]) - 1) - 0.05 * gap + (0.08 if gap == 0 else 0.0) + (0.05 if want == h[1] else 0.0)
            if best is None or (score, h[0]) > (best[0], best[1][0]):
                best = (score, h)
        if best is None:
            return None, None, 0.0, "no_compatible_antecedent", True
        score, h = best
        if score < self.threshold:
            return None, h[0], score, "below_nil_threshold", True
        self.held.append((idx, k, sentence, h[3], False))
        return h[3], h[0], score, "recency_type_sentence", False


def fold(mentions: DataFrame, threshold: float = lx.COREF_THRESHOLD, max_gap: int = lx.MAX_SENTENCE_GAP) -> DataFrame:
    """Every mention resolved in order, resolved anaphors joining the stack; a group is one document's mentions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stack = Stack(threshold, max_gap)
        rows = []
        for r in pdf.sort_values("idx").itertuples():
            entity = r.entity_id if isinstance(r.entity_id, str) and r.entity_id else None
            got = stack.resolve(int(r.idx), r.mention, r.mention_type, int(r.sentence_index), r.role, entity, 0.0)
            rows.append((r.doc_id, int(r.idx), r.mention, *got))
        return pd.DataFrame(rows, columns=["doc_id", "idx", "mention", "entity_id", "antecedent_idx", "score", "rule", "is_nil"]).astype({"antecedent_idx": "Int32"})

    cols = ["doc_id", "idx", "mention", "mention_type", "sentence_index", "role", "entity_id"]
    return mentions.select(*cols).groupBy("doc_id").applyInPandas(run, RESOLVED)


def resolve(docs: DataFrame, mentions: DataFrame, threshold: float = lx.COREF_THRESHOLD, max_gap: int = lx.MAX_SENTENCE_GAP, reject_ambiguous: bool = True) -> DataFrame:
    """doc_id, idx, mention, entity_id, antecedent_idx, score, rule, is_nil, entity_ids: documents in which an anaphor of a
    linkable type may itself become an antecedent are folded, all others resolved by joins."""
    chains = is_anaphor(F.col("mention"), F.col("mention_type"), F.col("role")) & ~is_collective(F.col("mention")) & normal_type(F.col("mention_type")).isin("ORG", "PERSON", "GPE", "LOC")
    chained = mentions.where(chains).select("doc_id").distinct()
    by_join = mentions.join(chained, "doc_id", "left_anti")
    cols = ["doc_id", "idx", "mention", "entity_id", "antecedent_idx", "score", "rule", "is_nil"]
    o = ordinal(by_join).select("doc_id", "idx", "mention", "entity_id", "antecedent_idx", "score", F.lit("ordinal_pair").alias("rule"), F.lit(False).alias("is_nil"))
    s = single(by_join, threshold, max_gap).join(o.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti").select(*cols)
    plain = by_join.where(~is_anaphor(F.col("mention"), F.col("mention_type"), F.col("role")))
    linked = F.coalesce("entity_id", F.lit("")) != ""
    p = plain.select("doc_id", "idx", "mention", F.when(linked, F.col("entity_id")).alias("entity_id"), F.when(linked, F.col("idx")).alias("antecedent_idx"), F.when(linked, 1.0).otherwise(0.0).alias("score"), F.when(linked, "linked_name").otherwise("unlinked_name_nil").alias("rule"), (~linked).alias("is_nil"))
    folded = fold(mentions.join(chained, "doc_id", "left_semi"), threshold, max_gap).where("rule <> 'collective'").select(*cols)
    none = F.array().cast("array<string>")
    singles = o.unionByName(s).unionByName(p).unionByName(folded).withColumn("entity_ids", none)
    c = collective(docs, mentions, reject_ambiguous).select("doc_id", "idx", "mention", F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("int").alias("antecedent_idx"), "score", "rule", "is_nil", "entity_ids")
    return singles.unionByName(c)


def merge_links(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """links(doc_id, idx, entity_id, confidence, is_nil, ...) in which NIL rows take a resolution; each row gets its
    resolution beside it. A collective success has no entity_id and is not NIL."""
    r = resolved.select("doc_id", "idx", F.struct("entity_id", "entity_ids", "antecedent_idx", "score", "rule", "is_nil").alias("coreference"))
    out = links.join(r, ["doc_id", "idx"], "left")
    won = F.col("is_nil") & F.coalesce(~F.col("coreference.is_nil"), F.lit(False))
    return out.withColumn("entity_id", F.when(won, F.col("coreference.entity_id")).otherwise(F.col("entity_id"))).withColumn("confidence", F.when(won, F.col("coreference.score")).otherwise(F.col("confidence"))).withColumn("is_coreference", won).withColumn("is_nil", F.col("is_nil") & ~won)


def backlink(clusters: DataFrame, links: DataFrame) -> DataFrame:
    """The first linked member of each cluster gives its entity to the members without one, at 0.9 of its confidence.

    clusters: doc_id, cluster_id, idx, mention; links: doc_id, idx, entity_id, confidence.
    """
    rows = clusters.join(links.select("doc_id", "idx", "entity_id", "confidence"), ["doc_id", "idx"], "left")
    head = rows.where("entity_id is not null").groupBy("doc_id", "cluster_id").agg(F.min_by(F.struct("entity_id", "confidence", "idx"), "idx").alias("h"))
    out = rows.where("entity_id is null").join(head, ["doc_id", "cluster_id"])
    short = (F.length("mention") <= 3) | tx.squash(F.col("mention")).isin(*lx.ORG_ANAPHORS, *lx.PERSON_ANAPHORS)
    return out.select("doc_id", "cluster_id", "idx", "mention", F.col("h.entity_id").alias("entity_id"), (F.col("h.confidence") * 0.9).alias("confidence"), F.col("h.idx").alias("resolved_from"), F.when(short, "PRON").otherwise("NOUN").alias("mention_type"))


def older_score(role: Column, distance: Column, gap: Column, kind: Column, antecedent_kind: Column, exact_alias: Column) -> Column:
    """The score of the standalone resolver: alias matches first, else recency by role."""
    base = F.when(F.lower(role).isin("pronoun", "anaphor"), 0.80).otherwise(0.62)
    s = base - F.lit(0.08) * distance - F.lit(0.05) * gap
    s = s + F.when(gap == 0, 0.10).when(gap == 1, 0.04).otherwise(0.0)
    s = s + F.when((F.upper(kind) == "ORG") & (F.upper(antecedent_kind) == "ORG"), 0.03).otherwise(0.0)
    return F.when(exact_alias, F.lit(0.98)).otherwise(s)


def best_link(pairs: DataFrame, above: float = 0.0) -> DataFrame:
    """pairs(doc_id, i, j, score), j before i: the best j of each i above a score, the first of equals."""
    best = pairs.groupBy("doc_id", "i").agg(F.max(F.struct("score", F.negative("j").alias("nj"))).alias("b"))
    return best.where(F.col("b.score") > above).select("doc_id", "i", F.negative("b.nj").alias("j"), F.col("b.score").alias("score"))


def fold_stream(it: Iterator[pd.DataFrame], stack: Stack) -> Iterator[pd.DataFrame]:
    """Rows of one key as they come; late ones (idx not above what was seen) are still resolved, against what is held."""
    for pdf in it:
        rows = []
        for r in pdf.sort_values("idx").itertuples():
            entity = r.entity_id if isinstance(r.entity_id, str) and r.entity_id else None
            rows.append((r.doc_id, int(r.idx), r.mention, *stack.resolve(int(r.idx), r.mention, r.mention_type, int(r.sentence_index), r.role, entity, 0.0)))
        yield pd.DataFrame(rows, columns=["doc_id", "idx", "mention", "entity_id", "antecedent_idx", "score", "rule", "is_nil"]).astype({"antecedent_idx": "Int32"})


#: How the older resolver scores an antecedent.
ALIAS_SCORE, ANAPHOR_BASE, NAME_BASE, STEP, GAP, SAME_SENTENCE, NEXT_SENTENCE, BOTH_ORG = 0.98, 0.80, 0.62, 0.08, 0.05, 0.10, 0.04, 0.03


def recency_score(is_alias: Column, is_anaphor_: Column, distance: Column, gap: Column, both_org: Column) -> Column:
    """The older resolver's score of an antecedent so many mentions and sentences before."""
    base = F.when(is_anaphor_, ANAPHOR_BASE).otherwise(NAME_BASE)
    near = F.when(gap == 0, SAME_SENTENCE).when(gap == 1, NEXT_SENTENCE).otherwise(0.0)
    return F.when(is_alias, ALIAS_SCORE).otherwise(base - STEP * distance - GAP * gap + near + F.when(both_org, BOTH_ORG).otherwise(0.0))


def by_recency(mentions: DataFrame, threshold: float = lx.COREF_THRESHOLD) -> DataFrame:
    """The older resolver, without its chains: linked names keep their entity, other mentions take the best linked name
    before them (an equal name, or by recency and type if they are anaphors): doc_id, idx, entity_id, score, rule, is_nil.
    An anaphor never becomes an antecedent here; the entity that it would hand on is its antecedent's."""
    named = mentions.where((F.lower("role") == "name") & F.col("entity_id").isNotNull())
    seek = mentions.where(~((F.lower("role") == "name") & F.col("entity_id").isNotNull()))
    a = named.select(F.col("doc_id").alias("_d"), F.col("idx").alias("a_idx"), F.col("sentence_index").alias("a_sent"), normal_type(F.col("mention_type")).alias("a_type"), tx.squash(F.col("mention")).alias("a_name"), F.col("entity_id").alias("a_entity"))
    s = seek.select("doc_id", "idx", "sentence_index", normal_type(F.col("mention_type")).alias("kind"), tx.squash(F.col("mention")).alias("name"), is_anaphor(F.col("mention"), F.col("mention_type"), F.col("role")).alias("anaphor"))
    pairs = s.join(a, (F.col("doc_id") == F.col("_d")) & (F.col("a_idx") < F.col("idx")) & compatible(F.col("kind"), F.col("a_type")) & (F.col("anaphor") | (F.col("name") == F.col("a_name"))))
    gap = F.greatest(F.lit(0), F.col("sentence_index") - F.col("a_sent"))
    alias = F.col("name") == F.col("a_name")
    score = recency_score(alias, F.col("anaphor"), F.col("idx") - F.col("a_idx"), gap, (F.col("kind") == "ORG") & (F.col("a_type") == "ORG"))
    # of equal scores the antecedent that came first wins
    best = pairs.groupBy("doc_id", "idx").agg(F.max(F.struct(score.alias("score"), F.negative("a_idx").alias("o"), "a_entity", F.when(alias, "alias_match").otherwise("recency_and_type").alias("rule"))).alias("b"))
    out = seek.select("doc_id", "idx").join(best, ["doc_id", "idx"], "left")
    low = F.col("b.score") < threshold
    found = out.select("doc_id", "idx", F.when(~low, F.col("b.a_entity")).alias("entity_id"), F.coalesce("b.score", F.lit(0.0)).alias("score"), F.when(F.col("b").isNull(), "no_candidate").when(low, "below_threshold").otherwise(F.col("b.rule")).alias("rule"), (F.col("b").isNull() | low).alias("is_nil"))
    return named.select("doc_id", "idx", "entity_id", F.lit(1.0).alias("score"), F.lit("linked_name").alias("rule"), F.lit(False).alias("is_nil")).unionByName(found)


def is_plural(mention: Column, model: Column | None = None) -> Column:
    """Whether a pronoun is plural, and how sure that is: by word list, else by a model's struct(is_plural, confidence), else no at 0."""
    m = tx.squash(mention)
    known = lambda yes: F.struct(F.lit(yes).alias("is_plural"), F.lit(1.0).alias("confidence"))
    other = F.struct(F.lit(False).alias("is_plural"), F.lit(0.0).alias("confidence")) if model is None else model
    plural = (*lx.COLLECTIVE_ANAPHORS, "他们", "她们", "它们")
    return F.when(m.isin(*plural), known(True)).when(m.isin(*lx.ORG_ANAPHORS, *lx.PERSON_ANAPHORS), known(False)).otherwise(other)
