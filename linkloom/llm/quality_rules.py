"""Quality rules: base rules and a learned decision list.

Sequential covering grows one conjunction of thresholds after another on
labelled statistics: each rule takes the thresholds of highest FOIL gain on the
growing two thirds, is pruned on the other third, and covers rows that no
earlier rule took. The list is emitted as ordered Spark conditionals
(``CASE WHEN rule_1 THEN ... WHEN rule_2 ...``), so applying it stays in the JVM.

Defined cases: a null or empty text has no words and fails the base rules; no
labels, or labels of one class, give an empty list (verdict: keep); repeated
rows give repeated rows; a document's label is the least non-null one of its rows.
Texts of any length are taken whole; other columns, whatever their names, are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fraction_of, stored
from .text_stats import STATS, with_stats

#: Labelled rows that the learner sees at most (about); all rows are judged.
MAX_LABELLED = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: What a rule may compare: name and the Spark expression over the statistics.
RATIOS: dict[str, tuple[str, str]] = {
    "words": ("n_words", "1"),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "punct_share": ("n_punct", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
}


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name]
    return F.col(top).cast("double") if bottom == "1" else F.col(top) / F.greatest(F.col(bottom), F.lit(1))


@dataclass
class Rule:
    """All conditions (feature, ``<=`` or ``>``, threshold) hold: the verdict is ``keep``."""

    conditions: list[tuple[str, str, float]]
    keep: bool = False
    covered: int = 0
    precision: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, at in self.conditions:
            out = out & (ratio(name) <= F.lit(at) if op == "<=" else ratio(name) > F.lit(at))
        return out

    def mask(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, op, at in self.conditions:
            v = x[:, names.index(name)]
            out &= (v <= at) if op == "<=" else (v > at)
        return out


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)
    default: bool = True

    def verdict(self) -> Column:
        """The list as one CASE expression; the first rule that holds decides."""
        out = None
        for r in self.rules:
            out = F.when(r.column(), F.lit(r.keep)) if out is None else out.when(r.column(), F.lit(r.keep))
        return F.lit(self.default) if out is None else out.otherwise(F.lit(self.default))

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out, open_ = np.full(len(x), self.default), np.ones(len(x), bool)
        for r in self.rules:
            hit = open_ & r.mask(x, names)
            out[hit] = r.keep
            open_ &= ~hit
        return out


def _cuts(v: np.ndarray, most: int = 64) -> np.ndarray:
    u = np.unique(v)
    if len(u) > most:
        u = np.unique(np.quantile(v, np.linspace(0, 1, most)))
    return (u[1:] + u[:-1]) / 2


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], longest: int) -> list[tuple[str, str, float]]:
    """Thresholds of highest FOIL gain until the rule is pure."""
    inside, out = np.ones(len(x), bool), []
    while len(out) < longest:
        p0, n0 = int(y[inside].sum()), int(inside.sum())
        if not p0 or p0 == n0:
            break
        best = (1e-9, None, None)
        for j, name in enumerate(names):
            v, w = x[inside, j], y[inside]
            for at in _cuts(v):
                low = v <= at
                for op, hit in (("<=", low), (">", ~low)):
                    p, n = int(w[hit].sum()), int(hit.sum())
                    if p:
                        gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if gain > best[0]:
                            best = (gain, (name, op, float(at)), j)
        if best[1] is None:
            break
        name, op, at = best[1]
        v = x[:, best[2]]
        inside &= (v <= at) if op == "<=" else (v > at)
        out.append(best[1])
    return out


def learn(x: np.ndarray, reject: np.ndarray, names: list[str], min_precision: float = 0.9, min_cover: int = 8, longest: int = 3, most_rules: int = 12) -> DecisionList:
    """Sequential covering of the rows to reject; rules below ``min_precision`` end the list, all else is kept."""
    out, left, reject = DecisionList(), np.ones(len(x), bool), reject.astype(bool)
    part = np.random.default_rng(len(x)).integers(0, 3, len(x))
    while len(out.rules) < most_rules and reject[left].any() and not reject[left].all():
        grow, prune = left & (part != 0), left & (part == 0)
        if reject[grow].sum() < min_cover:
            break
        conditions = _grow(x[grow], reject[grow], names, longest)
        if not conditions:
            break

        def worth(c: list) -> float:
            hit = prune & Rule(c).mask(x, names)
            p, n = int(reject[hit].sum()), int(hit.sum())
            return (2 * p - n) / n if n else -1.0  # as in reduced-error pruning: (p - n) / (p + n)

        while len(conditions) > 1 and (shorter := max((conditions[:k] for k in range(1, len(conditions))), key=worth)) and worth(shorter) >= worth(conditions):
            conditions = shorter
        hit = left & Rule(conditions).mask(x, names)
        n, p = int(hit.sum()), int((hit & reject).sum())
        if n < min_cover or p / n < min_precision:
            break
        out.rules.append(Rule(conditions, False, n, p / n))
        left &= ~hit
    return out


def labelled_sample(stats: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> DataFrame:
    """At most about ``most`` labelled rows of stats, chosen by a hash of the id and the statistics; rows that repeat are one."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_y")).where("_id is not null and _y is not null").groupBy("_id").agg(F.min("_y").alias("_y"))
    rows = stats.join(known, stats["doc_id"] == known["_id"]).drop("_id")
    return rows.where(fraction_of(F.xxhash64("doc_id", *STATS), most / max(rows.count(), 1))).dropDuplicates(["doc_id", *STATS])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[DataFrame, DecisionList]:
    """One row for each row of docs: doc_id, the statistics, base_failed and kept; and the list that was learned."""
    stats = stored(with_stats(docs, ["doc_id"]), "quality-stats")
    names = list(RATIOS)
    rows = labelled_sample(stats, labels, most=most).where(~base_failed()).select("doc_id", *[ratio(n).alias(f"r_{n}") for n in names], "_y").toPandas()
    rows = rows.sort_values(["doc_id", *[f"r_{n}" for n in names]])
    found = learn(rows[[f"r_{n}" for n in names]].to_numpy(float), rows["_y"].to_numpy() == 0, names)
    out = stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & found.verdict())
    return out, found
