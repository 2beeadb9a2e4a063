"""Shape statistics of whole texts, one pass, in Arrow batches.

Words are runs of bytes outside ASCII white space. A null text has none, so all
its statistics are 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, small_batches

#: Fixed values.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_punct", "n_digits")
SCHEMA = ", ".join(f"{c} long" for c in STATS)

_BYTES = np.arange(256)
_IS_SPACE = np.isin(_BYTES, list(SPACES))
_IS_SYMBOL = np.isin(_BYTES, list(SYMBOLS))
_STARTS_CHAR = (_BYTES & 0xC0) != 0x80
_IS_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_IS_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_IS_PUNCT = (_BYTES > 32) & (_BYTES < 127) & ~_IS_UPPER & ~_IS_DIGIT & ~((_BYTES >= 97) & (_BYTES <= 122))


def repeated_words(words: list[bytes], width: int = 3) -> tuple[int, int]:
    """How many words stand in a window of ``width`` words that the text has twice or more, and the distinct words."""
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(codes) <= width:
        return 0, len(ids)
    windows = len(codes) - width + 1
    key = codes[:windows]
    for k in range(1, width):
        key = key * len(ids) + codes[k : k + windows]
        if k < width - 1 and len(ids) ** (k + 2) >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(np.diff(key[order]) == 0)
    if not len(same):
        return 0, len(ids)
    twice = np.zeros(windows, bool)
    twice[order[same]] = True
    twice[order[same + 1]] = True
    covered = np.zeros(len(codes), bool)
    for k in range(width):
        covered[k : k + windows] |= twice
    return int(covered.sum()), len(ids)


def stats_of(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    repeats, distinct = repeated_words(words)
    return (
        len(words),
        int(by[_STARTS_CHAR & ~_IS_SPACE].sum()),
        int(by[_IS_SYMBOL].sum()),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        distinct,
        int(by[_IS_UPPER].sum()),
        int(by[_IS_PUNCT].sum()),
        int(by[_IS_DIGIT].sum()),
    )


def with_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of docs (renamed by place, so that clashing names do not matter) and STATS of the text."""
    small_batches(docs.sparkSession)
    inner = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    kept = [f for f in inner.schema.fields if f.name != "_text"]
    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [SCHEMA])

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it):
            got = np.array([stats_of(t) for t in b.column("_text").to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *(pa.array(got[:, i]) for i in range(len(STATS)))], names=[*(f.name for f in kept), *STATS])

    out = inner.mapInArrow(run, ddl)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *STATS)
