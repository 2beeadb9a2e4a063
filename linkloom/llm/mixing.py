"""Mixing sources to target weights by pivotal dependent rounding.

Water filling over the sources gives each a target; a document of the source is
to be taken target / source_size times, a number from 0 to 2. Its whole part is
taken for sure. The fraction becomes 0 or 1 by pivotal steps: of two documents
with open fractions, words move from one to the other, at random in such a
measure that expectations stay, until one of them is wholly in or out. So the
words of a source change only when its last open document is rounded. Leaves of
bounded size (hash buckets of a source) run in parallel, each leaves at most one
open document, and a reduction tree of fan-in ``FAN_IN`` combines these.

Random numbers are hashes of the two ids, the level and the seed, so reruns and
recomputed tasks agree. Defined cases: null text has size 0 and is never taken;
a null source is a source of its own, last; documents of size 0 get 0; an empty
table gives no rows; rows with the same id and size are alike, and which of them
is taken is not defined, but how many are is. Texts of any length are taken whole;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Documents of a leaf (about), and residuals that one node of the tree combines.
LEAF, FAN_IN = 4096, 1024
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources(source, source_size, n) with rank and target: share of all words by weight, at most cap times the size.

    Sorted by cap / weight, the sources that are full come first, and what is left for the others follows from
    running sums: this equals resharing the excess until none is above.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("rank", F.row_number().over(by_code_point) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("full", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("full") / F.col("weight"), "rank")
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("left", F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("is_full", F.col("full") / F.col("weight") <= F.col("level"))
    level = F.min(F.when(~F.col("is_full"), F.struct(F.col("full") / F.col("weight"), "rank", "level"))).over(all_)
    return s.select("source", "source_size", "n", "rank", F.when(F.col("is_full"), F.col("full")).otherwise(F.least("full", F.col("weight") * level["level"])).alias("target"))


def _uniform(*key: object) -> float:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little") / 2**64


def pivot(sizes: np.ndarray, mass: np.ndarray, names: list, salt: tuple) -> tuple[np.ndarray, int]:
    """Words of each document's fraction after pivotal steps in the order given, and the place of the open one (-1: none).

    mass[i] lies in [0, sizes[i]]; afterwards it is 0 or sizes[i] but for the open one, and the sum has not changed.
    """
    mass = mass.copy()
    open_ = -1
    for i in range(len(sizes)):
        if mass[i] <= 0 or mass[i] >= sizes[i]:
            continue
        if open_ < 0:
            open_ = i
            continue
        j = open_
        to_i, to_j = min(sizes[i] - mass[i], mass[j]), min(mass[i], sizes[j] - mass[j])
        if _uniform(salt, names[i], names[j]) * (to_i + to_j) < to_j:
            filled, emptied = to_i == sizes[i] - mass[i], to_i == mass[j]
            mass[i] = sizes[i] if filled else mass[i] + to_i
            mass[j] = 0.0 if emptied else mass[j] - to_i
        else:
            emptied, filled = to_j == mass[i], to_j == sizes[j] - mass[j]
            mass[i] = 0.0 if emptied else mass[i] - to_j
            mass[j] = sizes[j] if filled else mass[j] + to_j
        still = [k for k in (j, i) if 0 < mass[k] < sizes[k]]
        open_ = still[0] if still else -1
    return mass, open_


def _node(level: int, seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large documents first: smaller ones after them close what is open, so the last rounding moves few words.
        pdf = pdf.sort_values(["size", "doc_id", "place"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
        names = list(zip(pdf["doc_id"].astype(str), pdf["place"].astype(str), strict=True))
        size = pdf["size"].to_numpy(float)
        mass, at = pivot(size, pdf["mass"].to_numpy(float), names, (seed, level))
        if last and at >= 0:
            mass[at] = size[at] if _uniform(seed, "last", names[at]) * size[at] < mass[at] else 0.0
            at = -1
        return pdf.assign(mass=mass, open=np.arange(len(pdf)) == at)

    return run


NODE_SCHEMA = "doc_id long, place long, size long, whole long, source_rank int, bucket long, mass double, open boolean"


def _rounded(rows: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    return stored(rows.drop("open").groupBy("source_rank", "bucket").applyInPandas(_node(level, seed, last), NODE_SCHEMA), f"mix-{level}")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 17) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and taken for each row of docs(doc_id, text, source)."""
    sized = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), "source")
    sized = stored(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    plan = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, cap), "mix-targets")
    most = plan.agg(F.max("n")).first()[0] or 0
    leaves = max(1, math.ceil(most / LEAF))
    facts = plan.select(F.col("source").alias("_source"), "source_size", "target", F.ceil(F.col("n") / LEAF).alias("leaves"), F.col("rank").cast("int").alias("source_rank"))
    often = sized.groupBy(F.col("doc_id").alias("_i"), F.col("size").alias("_n")).count().where(F.col("count") > LEAF).select("_i", "_n", F.lit(True).alias("_often"))
    alike = F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("size") == F.col("_n"))
    joined = sized.join(F.broadcast(often), alike, "left").join(facts, F.col("source").eqNullSafe(F.col("_source")))  # of LEAF rows, one is often at most
    told = F.when(F.col("_often"), F.col("row"))  # rows that share id and size by the thousand would fill one leaf
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("times", times).withColumn("whole", F.floor("times").cast("long"))
    # place tells rows of the same id apart as far as their sizes do
    level0 = joined.select("doc_id", F.xxhash64("doc_id", "size").alias("place"), "size", "whole", "source_rank", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", told), F.col("leaves")).alias("bucket"), ((F.col("times") - F.col("whole")) * F.col("size")).alias("mass"))
    level, done, rows = 0, [], level0
    while True:  # the depth of the tree: log(leaves) to the base FAN_IN
        got = _rounded(rows, level, seed, leaves == 1)
        done.append(got.where(~F.col("open")))
        if leaves == 1:
            break
        leaves = math.ceil(leaves / FAN_IN)
        rows = got.where("open").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("mass") > 0, 1).otherwise(0)).otherwise(0)
    out = out.withColumn("copies", copies.cast("long"))
    return out.join(plan.withColumnRenamed("rank", "source_rank"), "source_rank").select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
