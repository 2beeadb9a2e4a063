"""A training corpus from raw documents, in five stages; each is written as Parquet and read as the next one's docs.

Stages but the last return the columns of documents. Documents are told apart by
doc_id and text, so null and repeated ids lose nothing. Null texts go with the
first stage; empty ones stay until the mix, which takes no document without a
word; texts of any length are taken whole; ties go to the lesser id; an empty
table stays empty.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import language_id, line_dedup, mixing, near_dedup, trie_bpe
from linkloom.llm.common import documents, small, stored
from linkloom.llm.queries import tokenizer


#: Columns that a stage reads; what else documents have is renamed meanwhile, so that no name of a stage meets it.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Rows of ids (16 bytes) that may be broadcast, counted first; more are shuffled, and texts with them.
BROADCAST_ROWS = 1_000_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _like(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*docs.columns)


def _whatever_columns(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in COLUMNS else f"_c{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return run


@_whatever_columns
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (``und``) go; if none was learned, those without a letter."""
    model = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    if not model.languages:
        return _like(language_id.with_letter(docs), docs)
    return _like(language_id.predict(docs, model).where("lang_pred <> 'und'"), docs)


@_whatever_columns
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; documents stay."""
    return _like(line_dedup.dedup(docs), docs)


@_whatever_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class stays."""
    rows = line_dedup.numbered(docs)
    classes = near_dedup.classes(rows.select(F.col("_doc").alias("doc_id"), "text"))
    heads = stored(classes.where("doc_id = class_id").select(F.col("doc_id").alias("_head")).distinct(), "pipeline-heads")
    kept = rows.join(small(heads, BROADCAST_ROWS), F.col("_doc") == F.col("_head"), "left_semi")
    if heads.count() < kept.select("_doc").count():  # whole rows that repeat
        kept = kept.dropDuplicates(["_doc"])
    return _like(kept, docs)


@_whatever_columns
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = line_dedup.numbered(docs)
    taken = mixing.mix(rows.select(F.col("_doc").alias("doc_id"), "text", "source")).groupBy(F.col("doc_id").alias("_taken")).agg(F.sum("copies").alias("copies"))
    taken = stored(taken.where("copies > 0"), "pipeline-taken")
    if rows.groupBy("_doc").count().where("count > 1").limit(1).count():  # whole rows that repeat: their copies are summed
        rows = rows.dropDuplicates(["_doc"])
    out = rows.join(small(taken, BROADCAST_ROWS), F.col("_doc") == F.col("_taken")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return _like(out, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each document encodes to and decodes to."""
    return trie_bpe.encode(docs, tokenizer())


STAGES = [("language ID", language), ("line dedup", lines), ("near-duplicates", near_duplicates), ("mixing", mixed), ("BPE", tokens)]

#: No SQL expresses the stages; run() is tested against a brute-force version of all five.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
