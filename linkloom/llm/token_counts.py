"""Token counts with a digest cache.

A text's key is the SHA-256 of its normalised content; a cache table holds
(version, digest, n_tokens) rows, version being the digest of the tokenizer file
and of the normalisation. Texts are joined with the cache by digest; each
distinct miss is encoded once, by the row that a grouped minimum picks, and
appended. A job that is lost half way has appended nothing or whole files, and a
digest appended twice counts once.

Normalisation: null reads as empty; byte-level tokenizers see every character,
so nothing else may be changed there; ``normalise`` takes a column function for
tokenizers that ignore more (say lower case).

Defined cases: repeated rows give repeated rows; ids may be null or repeat, as
rows are told apart by digest only; texts of any length are taken whole; an empty
table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH, batches_of, discard, shared_path, small, small_batches, stored, strings
from .pieces import encoder, file_digest

#: Rows of keys (40 bytes) that may be broadcast, counted first; more are shuffled, and texts with them.
BROADCAST_ROWS = 500_000

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str, normalisation: str = "none") -> str:
    return hashlib.sha256(f"{file_digest(path)} {normalisation}".encode()).hexdigest()


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The stored counts of a version; an absent cache is empty."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_lines(path: str, is_model: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """digest and the token count of _text, for mapInArrow."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if is_model:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            e = encoder(path)
            count = lambda texts: [len(x) // 4 for x in e.encode_many(texts)]
        for b in batches_of(it, BATCH):
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(count(strings(b.column("_text"))), pa.int64())], names=["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, cache: str, normalise: Callable[[Column], Column] | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of docs; the cache gains the distinct misses."""
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer_version(path, "none" if normalise is None else normalise.__name__)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("_text"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2((normalise or (lambda c: c))(F.col("_text")), 256)))
    known = read_cache(spark, cache, version)
    # Which row stands for each digest: file and place are unique, ids need not be.
    place = F.xxhash64(F.col("doc_id"), F.octet_length("_text"))
    first = keyed.groupBy("digest").agg(F.min(F.struct(place.alias("place"))).alias("first"))
    key = lambda digest, at: F.concat(digest, F.unhex(F.hex(at)))  # noqa: E731  one key, so that copies are not dealt by digest
    misses = stored(first.join(known, "digest", "left_anti").select(key(F.col("digest"), F.col("first.place")).alias("_key")), "count-misses")
    # A text goes to the encoder only if its own row was picked; rows of one digest that share id and length do so
    # together and are counted once below.
    picked = keyed.withColumn("_own", key(F.col("digest"), place)).join(small(misses, BROADCAST_ROWS), F.col("_own") == F.col("_key"), "left_semi").select("digest", "_text")
    counted = picked.mapInArrow(count_lines(path, path.endswith(".model")), "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    discard(misses)
    # a table, not an aggregate, so that the join may split the rows of a digest with many copies
    counts = stored(read_cache(spark, cache, version), "count-known")
    out = keyed.select("doc_id", F.octet_length("_text").cast("long").alias("n_bytes"), "digest").join(counts, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(spark: SparkSession) -> str:
    return shared_path(spark, "token-counts")
