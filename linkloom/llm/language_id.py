"""Language ID by multilingual mixture inference.

A model has, for each language, probabilities of hashed letter trigrams, learned
from a bounded sample of labelled documents. For a text, expectation
maximisation estimates the proportions of the languages that mix its trigrams;
the set of languages is the one of highest likelihood less half a log of the
trigram count for each member. The predicted language is the largest part.

Defined cases: null text or text without a letter gives ``und`` and score 0; so
does every text if nothing was learned. Ties go to the language first by code
point. Repeated rows give repeated rows. Texts of any length are taken whole; an
empty table gives no rows. The score is the predicted language's proportion in
the mixture of all languages, before the set is chosen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, free_names, small_batches

#: Documents of each language that the model learns from at most (about).
MAX_DOCS_PER_LANGUAGE = 1500
#: Hashed trigrams.
BUCKETS = 1 << 15

_LETTER = regex.compile(r"\p{L}")
_ASCII = np.array([c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)], np.uint32)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the letter trigrams of the lower-case text, ASCII other than letters read as one space each."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(cp < 128, _ASCII[np.minimum(cp, 127)], cp)
    blank = cp == 32
    cp = cp[~(blank & np.concatenate(([False], blank[:-1])))]  # runs of blanks as one
    if len(cp) < 3:
        return np.zeros(0, np.int64)
    h = cp[:-2] * np.uint32(2654435761) + cp[1:-1] * np.uint32(2246822519) + cp[2:] * np.uint32(3266489917)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(668265263)) >> np.uint32(17)).astype(np.int64)


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


@dataclass
class Mixture:
    languages: list[str]
    logp: np.ndarray  # buckets x languages

    def __post_init__(self) -> None:
        self.p = np.exp(self.logp)

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "p": self.p}  # what a worker needs

    def fit(self, p: np.ndarray, c: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, float]:
        """Proportions under a flat prior of one trigram for each language, and the log likelihood."""
        k = p.shape[1]
        pi, n = np.full(k, 1 / k), c.sum()
        for _ in range(rounds if k > 1 else 0):
            new = (pi * ((c / (p @ pi)) @ p) + 1) / (n + k)
            done = np.abs(new - pi).max() < 1e-4
            pi = new
            if done:
                break
        return pi, float(c @ np.log(p @ pi))

    def infer(self, text: str | None) -> tuple[str, float, list[str]]:
        """The predicted language, its proportion in the mixture of all languages, and the set of languages found."""
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0, []
        grams = trigrams(text)
        if not len(grams):
            return "und", 0.0, []
        counts = np.bincount(grams, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        c, p = counts[at].astype(float), self.p[at]
        pi, _ = self.fit(p, c)
        order = np.argsort(-pi, kind="stable")
        penalty = 0.5 * np.log(c.sum() + 1)
        chosen, worth = None, -np.inf
        for k in range(1, len(order) + 1):
            if k > 1 and pi[order[k - 1]] < 0.02:
                break
            part, likely = self.fit(p[:, order[:k]], c)
            if likely - k * penalty <= worth:
                break
            chosen, worth = part, likely - k * penalty
        first = int(order[: len(chosen)][np.argmax(chosen)])
        return self.languages[first], float(min(1.0, pi[first])), [self.languages[i] for i in order[: len(chosen)]]


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by id, that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, per_language: int = MAX_DOCS_PER_LANGUAGE) -> Mixture:
    """Trigram models of all languages in docs(doc_id, text, lang); rows with a null in text or lang are passed over.

    A language of more rows than ``per_language`` is sampled by a hash of id and text, of which the least is always
    taken; rows equal in both are taken or left together.
    """
    known = docs.select(F.col("text").alias("_text"), F.col("lang").alias("_lang"), F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)).alias("_at")).where("_text is not null and _lang is not null")
    sizes = known.groupBy("_lang").agg(F.count("*").alias("n"), F.min("_at").alias("least"))
    limits = sizes.select(F.col("_lang").alias("_of"), F.greatest("least", F.floor(F.least(F.lit(1.0), F.lit(per_language) / F.col("n")) * F.lit(1 << 30)) - 1).alias("_limit"))

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches_of(it):
            for lang, text in zip(b.column("_lang").to_pylist(), b.column("_text").to_pylist(), strict=True):
                got = np.bincount(trigrams(text), minlength=BUCKETS)
                total[lang] = total[lang] + got if lang in total else got
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "gram", "n"])

    seen = known.join(F.broadcast(limits), (F.col("_lang") == F.col("_of")) & (F.col("_at") <= F.col("_limit"))).select("_lang", "_text").mapInArrow(count, "lang string, gram long, n long")
    rows = seen.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    languages = sorted(rows["lang"].unique()) if len(rows) else []
    counts = np.zeros((BUCKETS, len(languages)))
    for j, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        counts[own["gram"].to_numpy(np.int64), j] = own["n"].to_numpy(float)
    return Mixture(languages, np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS)))


def with_letter(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has a letter."""
    small_batches(docs.sparkSession)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it):
            yield b.filter(pa.array([bool(t) and has_letter(t) for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: Mixture) -> DataFrame:
    """docs with lang_pred, score and languages put after its own columns; where docs has such a name, the new one gets an underscore."""
    from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

    small_batches(docs.sparkSession)
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    text = f"_c{names.index('text')}"
    schema = StructType([*inner.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("languages", ArrayType(StringType()))])
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages doubles

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches_of(it):
            got = [m.infer(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(pa.string()))], names=[*b.schema.names, "lang_pred", "score", "languages"])

    return inner.mapInArrow(run, schema).toDF(*names, *free_names(names, ["lang_pred", "score", "languages"]))
