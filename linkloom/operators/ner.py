"""Mention detection: gazetteer, merging of taggers, span enumeration."""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx


#: Aliases that one automaton holds, about a hundred bytes each.
ALIASES_OF_A_PART = 200_000


def _priority(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in lx.TYPE_PRIORITY.items() for x in kv]), kind), F.lit(1))


def _source_priority(source: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in lx.SOURCE_PRIORITY.items() for x in kv]), source), F.lit(1))


class _Finder:
    """Finds the aliases of one part of the dictionary in a text."""

    def __init__(self, rows: list[tuple[str, int]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (alias, _) in enumerate(rows):
            self.automaton.add_word(alias, i)
        self.automaton.make_automaton()
        self.rows = rows

    def places(self, text: str) -> dict[int, list[int]]:
        """The starts of each alias (its number) that occurs, rising."""
        out: dict[int, list[int]] = {}
        for end, i in self.automaton.iter(text):
            out.setdefault(i, []).append(end + 1 - len(self.rows[i][0]))
        return out


def taken(found: list[tuple[str, int, list[int]]]) -> list[tuple[str, int, int]]:
    """alias, start, end of what the greedy choice takes of found(alias, alias_ord, starts), by place, longer ones first.

    Spans that were taken are kept as sorted starts and ends, so that a place is tested by bisection.
    """
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for alias, _, places in sorted(found, key=lambda x: (-len(x[0]), x[1], x[0])):
        for a in places:
            b = a + len(alias)
            k = bisect.bisect_right(starts, a)
            if (k and ends[k - 1] > a) or (k < len(starts) and starts[k] < b):
                continue
            starts.insert(k, a)
            ends.insert(k, b)
            out.append((alias, a, b))
            break
    return sorted(out, key=lambda x: (x[1], -x[2]))


def gazetteer(docs: DataFrame, aliases: DataFrame, part: int = ALIASES_OF_A_PART) -> DataFrame:
    """doc_id, mention, mention_type, char_start, char_end: aliases by falling length take their first occurrence that
    overlaps nothing taken before, so each alias stands once in a text at most.

    aliases: alias, alias_ord, entity_type (of the alias's first entity). An automaton over at most ``part`` aliases
    (counted first) goes to every task and reads each text once. A larger dictionary is dealt over several, each of which
    reads the texts; their finds meet by document before the choice, which is bounded by the text. doc_id must be unique.
    """
    a = aliases.where(F.length("alias") > 0).select("alias", "alias_ord")
    parts = max(1, -(-a.count() // part))
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    every = None
    for k in range(parts):
        some = a if parts == 1 else a.where(F.pmod(F.xxhash64("alias"), F.lit(parts)) == k)
        rows = spark.sparkContext.broadcast(sorted((r["alias"], r["alias_ord"]) for r in some.toLocalIterator()))  # about ``part`` aliases

        def run(it: Iterable[pa.RecordBatch], rows=rows, whole=parts == 1) -> Iterator[pa.RecordBatch]:
            finder = _Finder(rows.value) if rows.value else None
            for b in it:
                spans: list[tuple[int, str, int, int, int]] = []
                for at, text in enumerate(b.column("text").to_pylist()):
                    found = [(*rows.value[i], p) for i, p in finder.places(text).items()] if finder and text else []
                    if whole:
                        spans += [(at, alias, s, e, 0) for alias, s, e in taken(found)]
                    else:
                        spans += [(at, alias, s, s + len(alias), o) for alias, o, p in found for s in p]
                ids, names, first, last, ords = zip(*spans, strict=True) if spans else ((),) * 5
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(names, pa.string()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(ords, pa.int64())], names=["doc_id", "mention", "char_start", "char_end", "alias_ord"])

        got = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, mention string, char_start int, char_end int, alias_ord long")
        every = got if every is None else every.unionByName(got)
    if parts > 1:

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            found = [(m, int(g["alias_ord"].iloc[0]), sorted(g["char_start"].tolist())) for m, g in pdf.groupby("mention")]
            return pd.DataFrame([(pdf["doc_id"].iloc[0], *x, 0) for x in taken(found)], columns=list(pdf.columns))

        every = every.groupBy("doc_id").applyInPandas(choose, every.schema)
    types = aliases.select(F.col("alias").alias("_a"), "entity_type").dropDuplicates(["_a"])
    if parts == 1:
        types = F.broadcast(types)
    out = every.join(types, F.col("mention") == F.col("_a"))
    return out.select("doc_id", "mention", tx.mention_type_of(F.col("entity_type")).alias("mention_type"), "char_start", "char_end")


def merge(spans: DataFrame) -> DataFrame:
    """spans(doc_id, mention, type, char_start, char_end, source, ord) of several taggers, one row a kept span.

    Same place and text: higher type priority, then the first. Same place: type, then source priority, then the first.
    Spans strictly inside a longer one of no lower priority go; containment is tested in buckets of positions.
    """
    p, s = _priority(F.col("type")), _source_priority(F.col("source"))
    same = Window.partitionBy("doc_id", "char_start", "char_end", "mention").orderBy(F.desc(p), "ord")
    u = spans.withColumn("_r", F.row_number().over(same)).where("_r = 1")
    # the first of a text keeps its place in order even if a later one gave its type
    place = Window.partitionBy("doc_id", "char_start", "char_end").orderBy(F.desc(p), F.desc(s), "ord")
    u = u.withColumn("_r", F.row_number().over(place)).where("_r = 1").drop("_r")
    width = 32
    inner = u.select("doc_id", "char_start", "char_end", p.alias("p")).withColumn("k", F.floor(F.col("char_start") / width))
    outer = u.select(F.col("doc_id").alias("_d"), F.col("char_start").alias("_s"), F.col("char_end").alias("_e"), p.alias("_p")).withColumn("_k", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width))))
    inside = inner.join(outer, (F.col("doc_id") == F.col("_d")) & (F.col("k") == F.col("_k")) & (F.col("_s") <= F.col("char_start")) & (F.col("_e") >= F.col("char_end")) & (F.col("_e") - F.col("_s") > F.col("char_end") - F.col("char_start")) & (F.col("_p") >= F.col("p")))
    return u.join(inside.select("doc_id", "char_start", "char_end").distinct(), ["doc_id", "char_start", "char_end"], "left_anti")


def linkable(mentions: DataFrame, types: tuple[str, ...] = lx.LINKABLE_TYPES, coreference: bool = False) -> DataFrame:
    """Mentions whose type may be linked; with coreference also pronouns, nouns and unknown ones."""
    return mentions.where(F.col("mention_type").isin(*types, *((*lx.PRONOUN_TYPES, "UNKNOWN") if coreference else ())))


def enumerate_spans(docs: DataFrame, width: int = 10, most: int = 1000) -> DataFrame:
    """doc_id, char_start, char_end, span: runs of up to ``width`` characters, by start and end, ``most`` a text; blank
    ones and those of digits or punctuation only are left out."""
    ends = F.flatten(F.transform(F.sequence(F.lit(0), F.length("text") - 1), lambda a: F.transform(F.sequence(a + 1, F.least(a + width, F.length("text"))), lambda b: F.struct(a.alias("s"), b.alias("e")))))
    rows = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(ends).alias("p"))
    rows = rows.select("doc_id", F.col("p.s").alias("char_start"), F.col("p.e").alias("char_end"), tx.span(F.col("text"), F.col("p.s"), F.col("p.e")).alias("span"))
    rows = rows.where(~F.col("span").rlike(r"^(?U)(\s*|\d+|[\p{Punct}\p{IsPunctuation}]+)$"))
    w = Window.partitionBy("doc_id").orderBy("char_start", "char_end")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def type_by_context(text: Column, start: Column, end: Column, clues: dict[str, tuple[str, ...]]) -> Column:
    """The first type of which a clue stands within 50 characters of the span, else UNKNOWN."""
    near = tx.context_window(text, start, end, 50)
    out = F.lit("UNKNOWN")
    for kind, words in reversed(clues.items()):
        out = F.when(tx.contains_any(near, words), kind).otherwise(out)
    return out


def from_clusters(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """doc_id, cluster_id, mention, char_start: cluster members (doc_id, cluster_id, members) at their first occurrence."""
    rows = clusters.select("doc_id", "cluster_id", F.explode("members").alias("mention")).join(docs.select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "cluster_id", "mention", tx.find(F.col("text"), F.col("mention")).alias("char_start"))
