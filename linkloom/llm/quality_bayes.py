"""Quality classifier: hierarchical empirical Bayes over sites.

A logistic regression on shape statistics gives each document its own evidence.
Hosts, and paths in a host, have means of these probabilities; grouped sums give
the variance within and between sites, hence how many documents a prior is worth
(method of moments). A host's posterior shrinks to the global mean, a path's to
its host's, each without the document itself, and the log odds by which the path
leaves the global mean are added to the document's own.

Defined cases: a null host or path is a site of its own; null text has all
statistics 0; no labels, or labels of one class, give every document the share
of good labels (1 without labels); repeated rows count as often as they occur;
an empty table gives no rows. A label is the least non-null one of its document.
Texts of any length are taken whole; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .quality_rules import MAX_LABELLED, RATIOS, labelled_sample, ratio
from .text_stats import with_stats

_EDGE = 1e-4


@dataclass
class Logistic:
    """Coefficients over standardised logs of RATIOS; ``rate`` alone if there was nothing to learn."""

    names: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the intercept
    rate: float

    def column(self) -> Column:
        """The probability as a Spark expression."""
        if not len(self.weights):
            return F.lit(self.rate)
        z = F.lit(float(self.weights[-1]))
        for n, m, s, w in zip(self.names, self.mean, self.scale, self.weights[:-1], strict=True):
            z = z + F.lit(float(w / s)) * (_seen(n) - F.lit(float(m)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def _seen(name: str) -> Column:
    return F.log1p(F.lit(20.0) * ratio(name)) if name != "words" else F.log1p(ratio(name))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], ridge: float = 1.0, rounds: int = 25) -> Logistic:
    """Newton steps on the ridge-penalised likelihood."""
    rate = float(y.mean()) if len(y) else 1.0
    none = Logistic(names, np.zeros(0), np.zeros(0), np.zeros(0), rate)
    if not len(y) or rate in (0.0, 1.0):
        return none
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    w = np.zeros(a.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    hold = ridge * np.eye(len(w))
    hold[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + hold, a.T @ (y - p) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(names, mean, scale, w, rate)


def _worth(sites: DataFrame) -> tuple[float, float]:
    """Global mean, and the number of documents that the prior over sites(n, total, squares) is worth."""
    r = sites.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("q"), F.sum(F.col("total") ** 2 / F.col("n")).alias("b"), F.sum(F.col("n").cast("double") ** 2).alias("nn")).first()
    if not r["n"]:
        return 0.5, 1.0
    k, n, mean = r["k"], r["n"], r["t"] / r["n"]
    within = max(1e-12, (r["q"] - r["b"]) / max(1, n - k))
    between = ((r["b"] - n * mean * mean) - (k - 1) * within) / max(1e-12, n - r["nn"] / n)
    return mean, within / between if between > 1e-9 else 1e9


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(_EDGE), F.least(F.lit(1 - _EDGE), p))
    return F.log(q / (1 - q))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, quality and kept for each row of docs(doc_id, text, host, path)."""
    source = docs.select("doc_id", F.col(host).cast("string").alias("_host"), F.col(path).cast("string").alias("_path"), "text")
    stats = stored(with_stats(source, ["doc_id", "_host", "_path"]), "bayes-stats")
    names = list(RATIOS)
    rows = labelled_sample(stats, labels, most=most).select("doc_id", *[_seen(n).alias(f"r_{n}") for n in names], "_y").toPandas()
    rows = rows.sort_values(["doc_id", *[f"r_{n}" for n in names]])
    model = fit(rows[[f"r_{n}" for n in names]].to_numpy(float), (rows["_y"].to_numpy() != 0).astype(float), names)
    scored = stats.select("doc_id", "_host", "_path", model.column().alias("evidence"))
    sums = [F.count("*").alias("n"), F.sum("evidence").alias("total"), F.sum(F.col("evidence") ** 2).alias("squares")]
    paths = stored(scored.groupBy("_host", "_path").agg(*sums), "bayes-paths")
    hosts = paths.groupBy("_host").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    mean, host_worth = _worth(hosts)
    # paths vary around their host: take the host's mean off before measuring
    around = paths.join(hosts.select(F.col("_host").alias("_h"), (F.col("total") / F.col("n")).alias("m")), F.col("_host").eqNullSafe(F.col("_h")))
    around = around.select("n", (F.col("total") - F.col("n") * F.col("m")).alias("total"), (F.col("squares") - 2 * F.col("m") * F.col("total") + F.col("n") * F.col("m") ** 2).alias("squares"))
    _, path_worth = _worth(around)
    sites = paths.select("_host", "_path", F.col("n").alias("path_n"), F.col("total").alias("path_total"))
    sites = sites.join(hosts.select(F.col("_host").alias("_h"), F.col("n").alias("host_n"), F.col("total").alias("host_total")), F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    sites = sites.withColumnsRenamed({"_host": "_h", "_path": "_p"})
    out = scored.join(sites, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")))
    own = F.col("evidence")
    host_post = (F.col("host_total") - own + host_worth * mean) / (F.col("host_n") - 1 + host_worth)
    path_post = (F.col("path_total") - own + path_worth * F.col("host_posterior")) / (F.col("path_n") - 1 + path_worth)
    out = out.withColumn("host_posterior", host_post).withColumn("path_posterior", path_post)
    odds = _logit(own) + _logit(F.col("path_posterior")) - _logit(F.lit(mean))
    out = out.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= 0.5).alias("kept"))
