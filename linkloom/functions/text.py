"""Column functions over texts, mentions and spans; all stay in the JVM.

Offsets are half-open and count code points, as Python's do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx


def squash(c: Column) -> Column:
    """c without any white space."""
    return F.regexp_replace(c, lx.SPACE_CLASS, "")


def strip_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"^{lx.SPACE_CLASS}+|{lx.SPACE_CLASS}+$", "")


def normal_mention(c: Column) -> Column:
    return F.lower(squash(c))


def normal_text(c: Column) -> Column:
    """Lower case, without white space, punctuation and underscores."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s\W_]+", ""))


def span(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def span_holds(text: Column, start: Column, end: Column, mention: Column) -> Column:
    return F.coalesce((start >= 0) & (start < end) & (end <= F.length(text)) & (span(text, start, end) == mention), F.lit(False))


def find(text: Column, sub: Column) -> Column:
    """Place of the first occurrence, -1 without one."""
    return F.call_function("locate", sub, text) - 1


def context_window(text: Column, start: Column, end: Column, width: int = 80) -> Column:
    low = F.greatest(F.lit(0), start - width)
    return span(text, low, F.least(F.length(text), end + width))


def mark_span(text: Column, start: Column, end: Column, left: str = "[*]", right: str = "[/*]") -> Column:
    return F.concat(span(text, F.lit(0), start), F.lit(left), span(text, start, end), F.lit(right), span(text, end, F.length(text)))


def mark_mention(text: Column, mention: Column, start: Column, end: Column, left: str = "[*]", right: str = "[/*]") -> Column:
    """Marks the span where it holds the mention, else the mention's first occurrence, else nothing."""
    at = find(text, mention)
    return F.when(span_holds(text, start, end, mention), mark_span(text, start, end, left, right)).when(at >= 0, mark_span(text, at, at + F.length(mention), left, right)).otherwise(text)


def sentence_index(text: Column, offset: Column, marks: str = lx.SENTENCE_END) -> Column:
    """How many sentence ends stand before the offset."""
    return F.regexp_count(span(text, F.lit(0), offset), F.lit(marks))


def sentences(text: Column, marks: str = "[。！？!?；;]") -> Column:
    """Array of (start, end, text) of the sentences, each with its mark."""
    parts = F.filter(F.split(text, f"(?<={marks})"), lambda s: F.length(s) > 0)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end = acc["at"] + F.length(s)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"), s.alias("text")))).alias("out"))

    return F.aggregate(parts, begin, step, lambda acc: acc["out"])


def contains_any(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def terms_in(text: Column, terms) -> Column:
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def conjunctions_in(text: Column) -> Column:
    """Coordination markers of a stretch of text, longest first; a marker inside a longer one counts too."""
    return terms_in(text, sorted(lx.CONJUNCTIONS, key=lambda w: (-len(w), w)))


def ngrams(text: Column, n: int = 2, stop: str = "") -> Column:
    """The distinct runs of n characters of a text from which the stop characters are gone."""
    t = F.regexp_replace(text, "[" + "".join("\\" + c for c in stop) + "]", "") if stop else text
    last = F.length(t) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(t, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def safe_ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def to_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def standard_type(raw: Column) -> Column:
    """Raw tags to standard types; others stay."""
    return F.coalesce(F.try_element_at(to_map(lx.TYPE_MAP), raw), raw)


def mention_type_of(kb_type: Column) -> Column:
    """The mention type that a knowledge base's type text stands for."""
    return F.when(F.coalesce(kb_type, F.lit("")) == "", "UNKNOWN").when(kb_type.isin("PERSON", "ORG", "GPE", "LOC"), kb_type).when(F.contains(kb_type, F.lit("人")), "PERSON").when(F.contains(kb_type, F.lit("地")), "GPE").otherwise("ORG")


def type_display(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(to_map(lx.TYPE_DISPLAY), kind), kind)


def query_text(mention: Column, context: Column, limit: int = 300) -> Column:
    """The question put to an embedding model."""
    has = F.length(strip_spaces(F.coalesce(context, F.lit("")))) > 0
    return F.when(has, F.concat(F.lit("query: 上下文中的mention指的是什么？上下文："), F.substring(context, 1, limit), F.lit("，mention："), mention)).otherwise(F.concat(F.lit("query: 实体指称 "), mention, F.lit(" 指的是什么？")))


def passage_text(name: Column, aliases: Column, kind: Column, description: Column, industry: Column, tags: Column) -> Column:
    """What an embedding model reads of an entity; parts that are empty are left out."""

    def part(label: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c)).otherwise(F.lit(""))

    listed = lambda a: F.array_join(F.slice(F.coalesce(a, F.array().cast("array<string>")), 1, 5), "、")
    shown = F.when(kind != "UNKNOWN", kind)
    return F.concat(F.lit("passage: 标准实体名："), name, part("，别名：", listed(aliases)), part("，类型：", shown), part("，描述：", description), part("，所属行业：", industry), part("，标签：", listed(tags)))


def metadata_text(metadata: Column) -> Column:
    """key: value pairs of a map, in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def context_clues(context: Column, mention: Column) -> Column:
    """Actions, first date and domain clues (three of each at most) of a context that holds the mention; else empty."""
    clues = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in lx.DOMAIN_CLUES.items()]), lambda c: F.contains(context, c["k"]))

    def part(label: str, words: Column) -> Column:
        return F.when(F.size(words) > 0, F.concat(F.lit(label), F.array_join(F.slice(words, 1, 3), "、")))

    dates = F.slice(F.regexp_extract_all(context, F.lit(lx.DATE_PATTERN), F.lit(1)), 1, 1)
    parts = F.array_compact(F.array(part("动作/状态：", terms_in(context, lx.ACTION_TERMS)), part("时间：", dates), part("领域/类型线索：", F.transform(clues, lambda c: c["v"]))))
    return F.when(F.contains(context, mention) & (F.size(parts) > 0), F.concat(F.lit("上下文关键信息："), F.array_join(parts, "；"))).otherwise(F.lit(""))


def parse_answer(answer: Column, candidate_ids: Column) -> Column:
    """The candidate id that a model's answer names: in a JSON block, else as a bare id, else null (NIL or none of them)."""
    block = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    named = F.coalesce(F.get_json_object(block, "$.entity_id"), F.nullif(F.regexp_extract(answer, r"entity_id[\"'\s:：=]+([A-Za-z0-9_\-]+)", 1), F.lit("")))
    bare = F.get(F.filter(candidate_ids, lambda c: F.contains(answer, c)), 0)
    said = F.when(named.isNotNull(), named).otherwise(F.when(~F.contains(F.upper(answer), F.lit("NIL")), bare))
    return F.when(F.array_contains(candidate_ids, said), said)


def cache_key(messages: Column, model: Column) -> Column:
    return F.md5(F.concat(messages, model))


def trace_id(prefix: str = "") -> Column:
    head = F.lit(prefix + "_") if prefix else F.lit("")
    return F.concat(head, F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), F.uuid())


def token_offsets(text: Column, tokens: Column, first: Column, last: Column) -> Column:
    """(start, end) of tokens[first:last] in text, found by their joined spelling; start is -1 if it is not there."""
    said = F.array_join(F.slice(tokens, first + 1, last - first), "")
    at = find(text, said)
    return F.struct(at.alias("start"), F.when(at >= 0, at + F.length(said)).otherwise(-1).alias("end"))
