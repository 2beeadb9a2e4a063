"""Ports for models, with deterministic stand-ins; no model is needed to import or run the engine."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Tagger(Protocol):
    """doc_id, text -> doc_id, mention, type, char_start, char_end, source, ord."""

    def tag(self, docs: DataFrame) -> DataFrame: ...


class Embedder(Protocol):
    def embed(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, query: Column, passage: Column) -> Column: ...


class LanguageModel(Protocol):
    """key, prompt -> key, answer; called on the low-scored slice only."""

    def ask(self, prompts: DataFrame) -> DataFrame: ...


class HashEmbedder:
    """Signed hashes of character bigrams, normalised: a stand-in with no weights."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, text: Column) -> Column:
        dim = self.dim

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series([_hashed(t or "", dim) for t in s])

        return run(text)


def _hashed(text: str, dim: int) -> list[float]:
    import zlib

    v = np.zeros(dim, np.float32)
    for i in range(max(0, len(text) - 1)):
        h = zlib.crc32(text[i : i + 2].encode())
        v[h % dim] += 1.0 if h & 1 << 20 else -1.0
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).tolist()


class OverlapReranker:
    """Jaccard similarity of character bigrams, in the JVM."""

    def score(self, query: Column, passage: Column) -> Column:
        from ..functions.text import jaccard, ngrams

        return jaccard(ngrams(query), ngrams(passage))


class NoAnswer:
    """Always NIL."""

    def ask(self, prompts: DataFrame) -> DataFrame:
        return prompts.select("key", F.lit("NIL").alias("answer"))


def ask_with_cache(prompts: DataFrame, cache: DataFrame, model: LanguageModel) -> tuple[DataFrame, DataFrame]:
    """Answers of prompts(key, prompt): cached ones by key, the distinct others asked once; and the rows to append."""
    known = cache.select("key", F.col("result").alias("answer"))
    new = model.ask(prompts.join(known, "key", "left_anti").dropDuplicates(["key"]))
    hits = prompts.select("key").distinct().join(known, "key")
    return hits.unionByName(new.select("key", "answer")), new.select("key", F.col("answer").alias("result"), F.current_timestamp().alias("ts"))


TAGGERS: dict[str, type] = {}


def tagger(name: str, **options) -> Tagger:
    """A registered tagger by name."""
    if name not in TAGGERS:
        raise NotImplementedError(f"no tagger named {name}; register one in TAGGERS")
    return TAGGERS[name](**options)
