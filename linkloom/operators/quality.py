"""Audits of datasets: spans, fields, duplicates, contracts, profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, ByteType, IntegerType, LongType, StructField, StructType

from ..functions import text as tx
from .vectors import _shared

#: Sizes of the grams by which similar texts meet, the first that is sure to find a text's partners.
GRAM_SIZES = (8, 5, 2)
#: Counters of hashed grams, 2 ** bits, and marks of keys of the lesser sizes. They decide speed, never results.
GRAM_BITS, MARK_BITS = 20, 22
#: Of the grams that similar texts share at least, the part that must be among the rarest.
PREFIX_SHARE = 0.1


def span_audit(spans: DataFrame) -> DataFrame:
    """spans(sample_id, text, mention, start, end): counts of checked, correct, out of bounds and mismatched spans, of
    repeated mentions and of overlaps of neighbours in order of place."""
    bad = (F.col("start") < 0) | (F.col("end") > F.length("text")) | (F.col("start") >= F.col("end"))
    holds = tx.span_holds(F.col("text"), F.col("start"), F.col("end"), F.col("mention"))
    order = Window.partitionBy("sample_id").orderBy("start", "end", "mention")
    again = Window.partitionBy("sample_id", "mention").orderBy("start", "end")
    rows = spans.withColumn("_o", F.coalesce(F.lag("end").over(order) > F.col("start"), F.lit(False))).withColumn("_n", F.row_number().over(again))
    return rows.agg(F.count("*").alias("checked"), F.count_if(holds).alias("correct"), F.count_if(bad).alias("out_of_bounds"), F.count_if(~bad & ~holds).alias("mismatch"), F.count_if(F.col("_n") > 1).alias("duplicate_mentions"), F.count_if("_o").alias("overlaps"))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, issue: one row for each rule (a condition that must hold) that a row breaks; null breaks it."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(found).alias("issue"))


def confidence_rules() -> dict[str, Column]:
    c = F.col("confidence")
    return {"confidence_range": (c >= 0) & (c <= 1), "mention_present": F.length(F.coalesce("mention", F.lit(""))) > 0}


def missing_columns(df: DataFrame, required: dict[str, str]) -> list[tuple[str, str]]:
    """What a contract asks for and the schema lacks: (column, absent or its type)."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [(c, have.get(c, "absent")) for c, kind in required.items() if have.get(c) != kind]


def detect_kind(columns: list[str], contracts: dict[str, set[str]]) -> str:
    """The contract with most columns that all are there, else unknown."""
    fit = [(len(keys), name) for name, keys in contracts.items() if keys <= set(columns)]
    return max(fit)[1] if fit else "unknown"


def missing_keys(facts: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows of facts whose key is set and not known."""
    return facts.where(F.col(key).isNotNull()).join(known.select(F.col(known_key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")


def exact_duplicates(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """group_key, n, first_id of texts that are equal after normalisation."""
    return rows.groupBy(F.md5(key).alias("group_key")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def conflicting(rows: DataFrame, keys: list[Column], label: str) -> DataFrame:
    """Groups of equal keys with more than one label."""
    return rows.groupBy(*keys).agg(F.countDistinct(label).alias("labels"), F.count("*").alias("n")).where("labels > 1")


def length_bucket(n: Column) -> Column:
    return F.when(n < 30, "<30").when(n < 60, "30-59").when(n < 100, "60-99").otherwise(">=100")


def _apart(m: int) -> int:
    """The most that lengths may differ if the greater is m."""
    return max(6, int(m * 0.15))


def _least_length(m: int, at_least: float) -> int:
    """The least length of a text that may be like one of m characters, shorter than it or not."""
    return max(1, int(np.ceil(at_least / (2 - at_least) * m - 1e-9)), m - _apart(m))


def _shared_grams(m: int, at_least: float, k: int, blocks: float = np.inf) -> int:
    """The least number of k-grams, counted with repeats, that a text of m characters shares with any that is like it.

    With s the sum of the lengths, at least t s / 2 characters match, at most (1 - t) s do not, so there are at most
    (1 - t) s + 1 matching blocks, each of which loses k - 1 grams. All of it grows with s.
    """
    s = m + _least_length(m, at_least)
    return int(np.ceil(at_least / 2 * s - (k - 1) * min(blocks, (1 - at_least) * s + 1) - 1e-9))


def _gram_size(m: int, at_least: float, blocks: float = np.inf) -> int:
    """The size of grams by which texts like one of m characters are sure to be found."""
    return next((k for k in GRAM_SIZES if _shared_grams(m, at_least, k, blocks) >= 1), 1)


def _longest(n: int, at_least: float) -> int:
    return max(n + 6, int(n * (2 - at_least) / at_least) + 1)


def _gram_sizes(n: int, at_least: float) -> list[int]:
    """The gram sizes of all texts that one of n characters may be like, the greatest first."""
    least, longest = _gram_size(_least_length(n, at_least), at_least), _longest(n, at_least)
    most = _gram_size(longest, at_least) if longest < 200 else GRAM_SIZES[0]
    return [k for k in (*GRAM_SIZES, 1) if least <= k <= most]


def _band(n: int) -> int:
    """Texts are compared by bands of length."""
    return int(np.log(n) / np.log(1.5))


def _anchored_blocks(cp: np.ndarray) -> float:
    """The most matching blocks that SequenceMatcher finds with this as second text.

    From 200 characters on it starts no block at a character that makes up more than a hundredth of it, so each block
    holds one of the other characters, except one at the very start.
    """
    if len(cp) < 200:
        return np.inf
    n = np.unique(cp, return_counts=True)[1]
    return int(n[n <= len(cp) // 100 + 1].sum()) + 1


def _grams(cp: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a text's code points."""
    h = np.full(max(0, len(cp) - k + 1), k, np.uint64)
    for i in range(k):
        h = (h ^ cp[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def _told_apart(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes in order, and keys in which the first, second and further occurrences of a gram differ."""
    h = np.sort(h)
    at = np.arange(len(h))
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return h, ((h + nth.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def _in_band(keys: np.ndarray, band: int) -> np.ndarray:
    return keys ^ np.int64((band + 1) * 0x5851F42D4C957F2D % (1 << 63))


def _counts(texts: DataFrame, slots: Callable[[str], np.ndarray], bits: int) -> np.ndarray:
    """Log counts of 2 ** bits slots over all texts; as many rows of six bytes come to the driver at most."""

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for b in it:
            for text in b.column("t").to_pylist():
                np.add.at(total, slots(text), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    sums = texts.select("t").mapInArrow(count, "at int, n long").groupBy("at").agg(F.floor(16 * F.log2(F.sum("n") + 1)).cast("smallint").alias("n"))
    got = sums.toArrow()
    out = np.zeros(1 << bits, np.int16)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def _marks(keys: np.ndarray) -> np.ndarray:
    return keys & np.int64((1 << MARK_BITS) - 1)


def _later_keys(text: str, at_least: float, classes: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Keys of a text's rarest grams for each band of its partners, how many of them a partner has, and the gram size."""
    cp = _code_points(text)
    m, blocks = len(cp), _anchored_blocks(cp)
    k = _gram_size(m, at_least, blocks)
    h, keys = _told_apart(_grams(cp, k))
    share = _shared_grams(m, at_least, k, blocks)
    need = max(1, int(share * PREFIX_SHARE))
    first = keys[np.lexsort((keys, classes[_slots(h)]))[: max(0, len(h) - share + need)]]
    bands = range(_band(_least_length(m, at_least)), _band(_longest(m, at_least)) + 1)
    return np.concatenate([_in_band(first, b) for b in bands]), need, k


def _earlier_keys(text: str, at_least: float, marked: np.ndarray) -> np.ndarray:
    """Keys of all grams of a text; those of lesser sizes only where the key is marked."""
    cp = _code_points(text)
    out = []
    for k in _gram_sizes(len(cp), at_least):
        keys = _in_band(_told_apart(_grams(cp, k))[1], _band(len(cp)))
        out.append(keys if k == GRAM_SIZES[0] else keys[marked[_marks(keys)]])
    return np.concatenate(out)


def _keyed(texts: DataFrame, keys: Callable[[str], tuple[np.ndarray, int]]) -> DataFrame:
    """key, id, h, n, need of each key of texts(id, h, t), n being the length."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                held = part.column("t").to_pylist()
                got = [keys(text) for text in held]
                rows = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
                n, need = np.array([len(text) for text in held], np.int32), np.array([g[1] for g in got], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[0] for g in got])), part.column("id").take(pa.array(rows)), part.column("h").take(pa.array(rows)), pa.array(n[rows]), pa.array(need[rows])], names=["key", "id", "h", "n", "need"])

    return texts.mapInArrow(run, StructType([StructField("key", LongType()), texts.schema["id"], StructField("h", LongType()), StructField("n", IntegerType()), StructField("need", IntegerType())]))


def similar_pairs(rows: DataFrame, id_col: str, text_col: str, at_least: float = 0.9) -> DataFrame:
    """a, b, ratio: pairs of texts, a before b, whose matching-block ratio reaches ``at_least``.

    The ratio is 2 M / (n + m), M being characters in matching blocks; lengths differ by at most 15 % of the greater, or
    6. Each distinct text takes part once, under its least id, whatever its length; a copy is one row of ratio 1 with
    that id, so a group of copies is not expanded into all pairs. Null ids, null and empty texts take no part; an id
    with several texts may be paired with itself.

    Exact: from the threshold follows how many grams two such texts share at least, so the rarest grams of the later
    one, all but so many, must hold enough of the earlier one's; what meets that is verified.
    """
    t = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null and length(t) > 0")
    firsts = t.groupBy("t").agg(F.min("id").alias("id"), F.count("*").alias("_n"))
    copies = t.join(firsts.where("_n > 1").select(F.col("t").alias("_t"), F.col("id").alias("a")), F.col("t") == F.col("_t"))
    # the row that gives the group its id is not its own copy; a row that repeats id and text is
    rank = F.row_number().over(Window.partitionBy("t").orderBy("id"))
    copies = copies.withColumn("_r", rank).where("_r > 1").select("a", F.col("id").alias("b"), F.lit(1.0).alias("ratio"))

    texts = firsts.select("id", F.xxhash64("t").alias("h"), "t")
    held = texts.sparkSession.sparkContext.broadcast

    def usual(text: str) -> np.ndarray:
        cp = _code_points(text)
        return _slots(_grams(cp, _gram_size(len(cp), at_least, _anchored_blocks(cp))))

    classes = held(_counts(texts, usual, GRAM_BITS))

    def lesser(text: str) -> np.ndarray:
        keys, _, k = _later_keys(text, at_least, classes.value)
        return _marks(keys if k < GRAM_SIZES[0] else keys[:0])

    marked = held(_counts(texts, lesser, MARK_BITS) > 0)
    x = _keyed(texts, lambda text: (_earlier_keys(text, at_least, marked.value), 0)).select("key", F.col("id").alias("a"), F.col("h").alias("ha"), F.col("n").alias("na"))
    y = _keyed(texts, lambda text: _later_keys(text, at_least, classes.value)[:2]).select("key", F.col("id").alias("b"), F.col("h").alias("hb"), F.col("n").alias("nb"), "need")
    longer, shorter = F.greatest("na", "nb"), F.least("na", "nb")
    close = (longer - shorter <= F.greatest(F.lit(6), F.floor(longer * F.lit(0.15)))) & (shorter >= F.lit(at_least / (2 - at_least)) * longer - 1e-9)
    before = (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("ha") < F.col("hb")))
    pairs = x.join(y, "key").where(before & close).groupBy("a", "ha", "b", "hb").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("a", "ha", "b", "hb")
    left, right = (texts.select(F.col("id").alias(i), F.col("h").alias(h), F.col("t").alias(c)) for i, h, c in (("a", "ha", "ta"), ("b", "hb", "tb")))

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_ratio(p, q, at_least) for p, q in zip(x, y, strict=True)], dtype=float)

    found = pairs.join(left, ["a", "ha"]).join(right, ["b", "hb"]).select("a", "b", ratio("ta", "tb").alias("ratio")).where(F.col("ratio") >= at_least)
    return copies.union(found)


def _bigram_set(text: str | None) -> bytes | None:
    """The distinct pairs of neighbouring code points, sorted."""
    if text is None:
        return None
    cp = _code_points(text).astype(np.int64)
    return np.unique(cp[:-1] << 21 | cp[1:]).tobytes()


def _overlap(a: bytes, b: bytes) -> tuple[int, int]:
    """Sizes of the intersection and of the union of two sets."""
    x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, len(x) + len(y) - both


def previous_jaccard(rows: DataFrame, id_col: str, group_col: str, text_col: str) -> DataFrame:
    """id and j: Jaccard similarity of each text's bigrams with those of the text before it, by id, in its group.

    A text travels as the set of its bigrams, which is stored, dealt by ranges of group and id and walked in order, so
    that a large group spreads over many tasks; the first set of a range meets the last one before it afterwards. Rows
    without such a text or of which both sets are empty are left out; a null text has a null similarity, as in SQL.
    """
    spark = rows.sparkSession
    path = _shared(spark, "bigrams")
    t = rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("k"), F.col(text_col).alias("t"))
    kinds = [t.schema["id"], t.schema["k"]]

    def sets(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("k"), pa.array([_bigram_set(x) for x in part.column("t").to_pylist()], pa.binary())], names=["id", "k", "g"])

    t.mapInArrow(sets, StructType([*kinds, StructField("g", BinaryType())])).write.parquet(f"{path}/sets")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    ranges = spark.read.parquet(f"{path}/sets").repartitionByRange(parts, "k", "id").sortWithinPartitions("k", "id")

    def walk(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Overlaps of neighbours; edge 1 is the first row of a range with its set, edge 2 the last one."""
        before, last = None, None
        for b in it:
            if not b.num_rows:
                continue
            both: list[int | None] = []
            every: list[int | None] = []
            edge, held = [0] * b.num_rows, [None] * b.num_rows
            for n, (k, g) in enumerate(zip(b.column("k").to_pylist(), b.column("g").to_pylist(), strict=True)):
                if before is None:
                    edge[n], held[n] = 1, g
                near = before is not None and before[0] == k and before[1] is not None
                x, y = _overlap(g, before[1]) if near and g is not None else (None, len(before[1]) // 8 if near else None)
                both.append(x)
                every.append(y)
                before = (k, g)
            last = (b.slice(b.num_rows - 1, 1), before[1])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("k"), pa.array(both, pa.int32()), pa.array(every, pa.int32()), pa.array(edge, pa.int8()), pa.array(held, pa.binary())], names=names)
        if last:
            yield pa.RecordBatch.from_arrays([last[0].column("id"), last[0].column("k"), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([2], pa.int8()), pa.array([last[1]], pa.binary())], names=names)

    names = ["id", "k", "both", "every", "edge", "g"]
    ranges.mapInArrow(walk, StructType([*kinds, StructField("both", IntegerType()), StructField("every", IntegerType()), StructField("edge", ByteType()), StructField("g", BinaryType())])).write.parquet(f"{path}/walked")
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/sets")
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    walked = spark.read.parquet(f"{path}/walked")

    @F.pandas_udf("both int, every int")
    def overlap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_overlap(x, y) if x is not None else (None, len(y) // 8) for x, y in zip(a, b, strict=True)], columns=["both", "every"])

    w = Window.partitionBy("k").orderBy("id", "edge")  # two rows a range
    first = walked.where("edge > 0").withColumn("h", F.lag("g").over(w)).where("edge = 1 and h is not null").withColumn("o", overlap("g", "h")).select("id", "o.both", "o.every")
    return walked.where("edge = 0").select("id", "both", "every").unionByName(first).where("every > 0").select("id", (F.col("both") / F.col("every")).alias("j"))


def _ratio(p: str, q: str, at_least: float) -> float:
    """SequenceMatcher's ratio, or 0 where the grams of both say that it is below ``at_least``."""
    x, y = _code_points(p), _code_points(q)
    blocks, s = _anchored_blocks(y), len(x) + len(y)
    k = _gram_size(len(y), at_least, blocks)
    both = len(np.intersect1d(_told_apart(_grams(x, k))[1], _told_apart(_grams(y, k))[1], assume_unique=True))
    if both < at_least / 2 * s - (k - 1) * min(blocks, (1 - at_least) * s + 1) - 1e-9:
        return 0.0
    return SequenceMatcher(None, p, q).ratio()


def histogram(rows: DataFrame, column: Column, name: str = "bucket") -> DataFrame:
    return rows.groupBy(column.alias(name)).agg(F.count("*").alias("n"))


def most_common(rows: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k most frequent values (the report shows so many), ties by value, with their share of all."""
    g = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("t"))
    return g.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("t")).alias("share")).orderBy(F.desc("n"), column).limit(k)


def template_concentration(rows: DataFrame, text: Column, mention: Column, above: int = 15) -> DataFrame:
    """Texts that are the same but for the mention, more than ``above`` of them."""
    return rows.groupBy(F.replace(text, mention, F.lit("{}")).alias("template")).agg(F.count("*").alias("n")).where(F.col("n") > above)


def dominant_share(rows: DataFrame, column: str, above: float = 0.45) -> DataFrame:
    g = rows.groupBy(column).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).where(F.col("share") > above)


def hard_negatives(names: DataFrame, k: int = 3) -> DataFrame:
    """name, other, distance, rank: the k names of least edit distance that share a trigram with each name."""
    n = names.select("name").distinct()
    keyed = n.withColumn("g", F.explode(tx.ngrams(F.col("name"), 3)))
    pairs = keyed.join(keyed.withColumnRenamed("name", "other"), "g").where("name <> other").select("name", "other").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("name", "other"))
    w = Window.partitionBy("name").orderBy("distance", "other")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
