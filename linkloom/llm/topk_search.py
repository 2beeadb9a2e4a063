"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are dealt by length into ranges; a task cuts its range into buckets of
similar length, longest first. For a query with k-th best score so far ``t``, a
vector of bucket with longest length ``l`` can only matter if its cosine with
the query is at least ``t / (|q| l)``. Above 1 the bucket is passed over. A
high local threshold is worth coordinate pruning: the query's largest coordinate
bounds the same coordinate of every unit vector within that angle, an interval
of a sorted list. A low one leaves length pruning: only the bucket's vectors of
length ``t / |q|`` or more. What remains is verified by its integer products.
Each task keeps k rows a query, and one window merges them.

Queries go out in blocks of ``BLOCK`` (a fixed size), each against all rows.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows without id; a query meets vectors of its
own dimension; rows that share the query's id count as its own; repeated rows
are ranked as often as they occur; fewer than k others give fewer rows; an empty
table gives none. Products are exact in 64-bit integers: components of up to
2 ** 31 / sqrt(dimensions) are safe. Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Queries that one pass holds, and vectors of a bucket.
BLOCK, BUCKET = 8192, 1024
#: From this local cosine threshold on a bucket is searched by coordinate.
BY_COORDINATE = 0.6
GRID = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, the integer components and the length of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    fit = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where(F.coalesce(fit, F.lit(False))).select("vec_id", F.transform("x", lambda x: F.floor(GRID * x).cast("long")).alias("v"))
    return v.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The integer products of the rows of q with those of x: by floats where these hold them, else by 64-bit integers."""
    most = lambda a: int(max(a.max(initial=0), -int(a.min(initial=0))))
    if most(q) * most(x) * q.shape[-1] < 1 << 53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T


def _rows(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and integer matrices of a batch, by dimension."""
    ids, v = b.column("vec_id").to_numpy(zero_copy_only=False), b.column("v")
    ends = v.offsets.to_numpy()
    flat, dims = v.values.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(ends)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield ids[at], flat[(ends[:-1][at][:, None] + np.arange(d)).astype(np.int64)]


class Best:
    """The k best of each query so far; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.norm = np.sqrt((q.astype(float) ** 2).sum(1))
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        self.found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        self.least = np.full(len(q), np.iinfo(np.int64).min)  # the k-th best score, and the same to prune by
        self.floor = np.full(len(q), -np.inf)

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        hit = (scores >= self.least[i]) & (ids != self.ids[i])
        if not hit.any():
            return
        s, v = np.concatenate([self.scores[i], scores[hit]]), np.concatenate([self.found[i], ids[hit]])
        order = np.lexsort((v, ~s))[: self.k]
        self.scores[i], self.found[i] = s[order], v[order]
        if len(order) == self.k:
            self.least[i] = s[order[-1]]
            self.floor[i] = float(s[order[-1]]) * (1 - 1e-12 * np.sign(float(s[order[-1]])))

    def bucket(self, ids: np.ndarray, x: np.ndarray, length: np.ndarray) -> None:
        """x: vectors by falling length."""
        longest = length[0]
        if not len(self.q):
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(np.isinf(self.floor), -1.0, np.where(self.norm * longest > 0, self.floor / (self.norm * longest), np.where(self.floor > 0, 2.0, -1.0)))
        local -= 1e-9  # rounding never prunes what may tie
        coordinate = (local >= BY_COORDINATE) & (local <= 1)
        if coordinate.any():
            unit = x / np.maximum(length, 1e-300)[:, None]
            order, sorted_ = {}, {}
            for i in np.flatnonzero(coordinate):
                u = self.q[i] / self.norm[i]
                f = int(np.argmax(np.abs(u)))
                if f not in order:
                    order[f] = np.argsort(unit[:, f], kind="stable")
                    sorted_[f] = unit[order[f], f]
                mid, off = u[f] * local[i], np.sqrt(max(0.0, 1 - u[f] ** 2) * (1 - local[i] ** 2)) + 1e-9
                # the bound widens towards the pole itself when the query lies nearer to it than the threshold's cone
                low = -1.0 if -u[f] >= local[i] else mid - off
                high = 1.0 if u[f] >= local[i] else mid + off
                at = order[f][np.searchsorted(sorted_[f], low - 1e-9) : np.searchsorted(sorted_[f], high + 1e-9, "right")]
                if len(at):
                    self.add(i, ids[at], products(self.q[i], x[at]))
        by_length = np.flatnonzero(local < BY_COORDINATE)
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(self.floor[by_length] > 0, self.floor[by_length] / self.norm[by_length] * (1 - 1e-9), 0.0)
            reach = np.searchsorted(-length, -np.nan_to_num(least, posinf=np.inf), "right")
            for some in np.array_split(by_length, max(1, len(by_length) * len(x) // 4_000_000)):
                n = int(reach[np.searchsorted(by_length, some)].max()) if len(some) else 0
                if not n:
                    continue
                scores = products(self.q[some], x[:n])
                busy = (scores >= self.least[some][:, None]).any(1)
                for j in np.flatnonzero(busy):
                    self.add(int(some[j]), ids[:n], scores[j])


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k highest integer products with the other rows."""
    spark = vectors.sparkSession
    all_ = stored(usable(vectors), "vectors")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_length = all_.repartitionByRange(parts, F.desc("length"), "vec_id")
    queries = all_.where(is_query).select("vec_id", "v").distinct()
    passes = max(1, -(-queries.count() // BLOCK))
    out = None
    for p in range(passes):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).toArrow()  # about BLOCK rows
        by_dim: dict[int, tuple[list, list]] = {}
        for b in block.to_batches():
            for ids, q in _rows(b):
                by_dim.setdefault(q.shape[1], ([], []))[0].append(ids)
                by_dim[q.shape[1]][1].append(q)
        shared = spark.sparkContext.broadcast({d: (np.concatenate(i), np.concatenate(q)) for d, (i, q) in by_dim.items()})

        def run(it: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {d: Best(ids, q, k) for d, (ids, q) in shared.value.items()}
            for b in it:
                for ids, x in _rows(b):
                    if (own := best.get(x.shape[1])) is None:
                        continue
                    length = np.sqrt((x.astype(float) ** 2).sum(1))
                    order = np.argsort(-length, kind="stable")
                    for a in range(0, len(order), BUCKET):
                        at = order[a : a + BUCKET]
                        own.bucket(ids[at], x[at], length[at])
            for own in best.values():
                n = [len(s) for s in own.scores]
                if sum(n):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own.ids, n)), pa.array(np.concatenate(own.found)), pa.array(np.concatenate(own.scores))], names=["query_id", "vec_id", "score"])

        some = by_length.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
        out = some if out is None else out.unionByName(some)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
