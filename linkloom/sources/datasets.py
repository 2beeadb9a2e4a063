"""Texts, requests and gold sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


_TEXT, _INT = T.StringType(), T.IntegerType()
MENTION = struct(mention=_TEXT, type=_TEXT, mention_type=_TEXT, char_start=_INT, start=_INT, char_end=_INT, end=_INT, confidence=T.DoubleType(), metadata=T.MapType(_TEXT, _TEXT))
REQUEST = struct(text=_TEXT, mentions=T.ArrayType(MENTION), kb=_TEXT, options=T.MapType(_TEXT, _TEXT))
SAMPLE = struct(id=_TEXT, text=_TEXT, mentions=T.ArrayType(MENTION), expected_entities=T.ArrayType(struct(mention=_TEXT, entity_id=_TEXT)), has_nil=T.BooleanType(), scenario=_TEXT)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text: lines that are not blank (.txt), JSON or raw lines (.jsonl), a list, {texts} or {text} (.json)."""
    if path.endswith(".json"):
        raw = spark.read.text(path, wholetext=True)
        texts = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "struct<texts:array<string>>")["texts"], F.array(F.get_json_object("value", "$.text")))
        rows = raw.select(F.posexplode(texts).alias("at", "text"))
    else:
        raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.col("value"))
        rows = raw.select("at", F.coalesce(F.get_json_object("value", "$.text"), F.col("value")).alias("text")) if path.endswith(".jsonl") else raw.select("at", F.col("value").alias("text"))
    return rows.where(F.length(tx.strip_spaces(F.col("text"))) > 0).select(F.col("at").cast("string").alias("doc_id"), "text")


def flat_mentions(requests: DataFrame) -> DataFrame:
    """doc_id, idx, mention, mention_type, char_start, char_end, confidence of requests(doc_id, mentions); several field
    spellings, items that are null left out."""
    m = F.col("m")
    rows = requests.select("doc_id", F.posexplode("mentions").alias("idx", "m")).where(m.isNotNull() & m["mention"].isNotNull())
    return rows.select("doc_id", "idx", m["mention"].alias("mention"), F.coalesce(m["mention_type"], m["type"], F.lit("UNKNOWN")).alias("mention_type"), F.coalesce(m["char_start"], m["start"], F.lit(0)).alias("char_start"), F.coalesce(m["char_end"], m["end"], F.lit(0)).alias("char_end"), F.coalesce(m["confidence"], F.lit(1.0)).alias("confidence"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text, mentions, kb, options of a batch file {default_kb, items}; a request without kb takes the default."""
    schema = T.StructType([T.StructField("default_kb", T.StringType()), T.StructField("items", T.ArrayType(REQUEST))])
    raw = spark.read.schema(schema).json(path, multiLine=True)
    rows = raw.select("default_kb", F.posexplode("items").alias("at", "r"))
    return rows.select((F.col("at") + 1).cast("string").alias("doc_id"), "r.text", "r.mentions", F.coalesce("r.kb", "default_kb").alias("kb"), "r.options")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Gold samples of a file that is a list or holds one under samples, entries, cases or data."""
    names = ("samples", "entries", "cases", "data")
    raw = spark.read.text(path, wholetext=True)
    listed = T.ArrayType(SAMPLE)
    some = F.coalesce(F.from_json("value", listed), *[F.from_json("value", T.StructType([T.StructField(n, listed)]))[n] for n in names])
    return raw.select(F.explode(some).alias("s")).select("s.*")


def gold_links(samples: DataFrame) -> DataFrame:
    """sample_id, idx, mention, gold_id: blank ids are NIL."""
    rows = samples.select(F.col("id").alias("sample_id"), F.posexplode("expected_entities").alias("idx", "e"))
    return rows.select("sample_id", "idx", "e.mention", F.nullif(F.trim("e.entity_id"), F.lit("")).alias("gold_id"))


def legacy_samples(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """texts(line_no, text) with entries(text_idx, mention): the mention at its first occurrence."""
    return entries.join(texts, F.col("text_idx") == F.col("line_no")).withColumn("char_start", tx.find(F.col("text"), F.col("mention"))).withColumn("char_end", F.when(F.col("char_start") >= 0, F.col("char_start") + F.length("mention")).otherwise(-1))
