"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: hang every greater neighbour of a node on the least of its neighbourhood. Small: hang a node and its
    lesser neighbours on the least. Minima are grouped sums of what each task saw; the join back may split hot nodes."""
    if large:
        arcs = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        arcs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = arcs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "_a")
    joined = arcs.join(least, F.col("a") == F.col("_a"))
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the least node of its component, for every node of edges(a, b) but the least ones themselves.

    Each round halves the depth of what is not yet a star; every round is written to the shared folder,
    where ``discard`` finds the last one.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    mark = _mark(now)
    while mark[0]:
        last, now = now, stored(_star(_star(now, True), False), "cc-round")
        discard(last)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    out._stored_at = now._stored_at
    return out
