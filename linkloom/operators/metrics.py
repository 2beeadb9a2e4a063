"""Evaluation: linking, coreference, classification and retrieval measures as conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_ratio


def last_predictions(predictions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of several predictions for one key the last one counts."""
    rest = [c for c in predictions.columns if c not in keys and c != order]
    return predictions.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_p")).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in rest])


def paired(gold: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """gold(keys, gold_id) with pred_id and found; NIL is null on both sides."""
    p = predictions.select(*keys, "pred_id", F.lit(True).alias("_f"))
    return gold.join(p, keys, "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def outcome() -> Column:
    """correct, or what went wrong, of a row of paired()."""
    gold, pred, found = F.col("gold_id"), F.col("pred_id"), F.col("found")
    return (
        F.when(found & gold.isNull() & pred.isNull(), "correct")
        .when(~found & gold.isNotNull(), "missing_prediction")
        .when(gold.isNull(), "nil_false_negative")
        .when(pred.isNull(), "nil_false_positive")
        .when(gold == pred, "correct")
        .otherwise("wrong_entity")
    )


def linking_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracies and NIL precision, recall and F1 of paired rows."""
    gold, o = F.col("gold_id"), outcome()
    counts = [
        F.count("*").alias("total"),
        F.count_if(o == "correct").alias("correct"),
        F.count_if(gold.isNotNull()).alias("linkable"),
        F.count_if(gold.isNotNull() & (o == "correct")).alias("linked_right"),
        F.count_if(gold.isNull() & (o == "correct")).alias("nil_tp"),
        F.count_if(o == "nil_false_positive").alias("nil_fp"),
        F.count_if(gold.isNull() & (o != "correct")).alias("nil_fn"),
        F.count_if(o == "missing_prediction").alias("missing"),
    ]
    m = rows.groupBy(*(by or [])).agg(*counts)
    precision = safe_ratio(F.col("nil_tp"), F.col("nil_tp") + F.col("nil_fp"))
    recall = safe_ratio(F.col("nil_tp"), F.col("nil_tp") + F.col("nil_fn"))
    m = m.withColumn("accuracy", safe_ratio(F.col("correct"), F.col("total"))).withColumn("linking_accuracy", safe_ratio(F.col("linked_right"), F.col("linkable")))
    return m.withColumn("nil_precision", precision).withColumn("nil_recall", recall).withColumn("nil_f1", safe_ratio(2 * precision * recall, precision + recall))


def breakdown(rows: DataFrame, correct: Column, dims: list[str]) -> DataFrame:
    """dimension, bucket, total, correct, accuracy: one pass over grouping sets, one set for each dimension."""
    flagged = rows.select(*dims, correct.cast("int").alias("_c"))
    stacked = flagged.select("_c", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("bucket")) for d in dims])).alias("d"))
    g = stacked.groupBy("d.dimension", "d.bucket").agg(F.count("*").alias("total"), F.sum("_c").cast("long").alias("correct"))
    return g.withColumn("accuracy", F.col("correct") / F.col("total"))


def set_scores(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """rows with exact, overlap, precision, recall and f1 of two id arrays, and the kind of error."""
    g, p = F.array_distinct(gold), F.array_distinct(pred)
    both = F.size(F.array_intersect(g, p))
    exact = F.array_sort(g) == F.array_sort(p)
    precision, recall = safe_ratio(both, F.size(p)), safe_ratio(both, F.size(g))
    missing, extra = F.size(F.array_except(g, p)), F.size(F.array_except(p, g))
    kind = F.when(exact, "none").when((missing > 0) & (extra == 0) & (both > 0), "partial_set").when((extra > 0) & (missing == 0), "superset").when(both > 0, "overlap").otherwise("wrong_set")
    return rows.withColumn("exact", exact).withColumn("overlap", both).withColumn("set_precision", precision).withColumn("set_recall", recall).withColumn("set_f1", safe_ratio(2 * precision * recall, precision + recall)).withColumn("set_error", kind)


def coref_metrics(rows: DataFrame) -> DataFrame:
    """rows(is_collective, gold_nil, pred_nil, gold_id, pred_id, gold_ids, pred_ids): single, collective, exact-match and NIL accuracy."""
    same = F.array_sort(F.array_distinct("gold_ids")) == F.array_sort(F.array_distinct("pred_ids"))
    right = F.when(F.col("gold_nil"), F.col("pred_nil")).when(F.col("is_collective"), ~F.col("pred_nil") & same).otherwise(~F.col("pred_nil") & (F.col("gold_id") == F.col("pred_id")))
    r = rows.withColumn("_r", F.coalesce(right, F.lit(False)))
    share = lambda c: safe_ratio(F.count_if(c & F.col("_r")), F.count_if(c))
    c, nil = F.col("is_collective"), F.col("gold_nil")
    return r.agg(F.count("*").alias("total"), share(F.lit(True)).alias("accuracy"), share(~c).alias("single_accuracy"), share(c).alias("collective_accuracy"), share(c & ~nil).alias("collective_exact_match"), share(c & nil).alias("collective_nil_accuracy"))


def binary_metrics(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    g, p = F.col(gold) == 1, F.col(pred) == 1
    m = rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    precision, recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return m.withColumn("accuracy", safe_ratio(F.col("tp") + F.col("tn"), total)).withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", safe_ratio(2 * precision * recall, precision + recall))


def recall_at(ranks: DataFrame, rank: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of rows whose gold entity stands among the first k; a null rank is not found."""
    found = [safe_ratio(F.count_if(F.col(rank) <= k), F.count("*")).alias(f"recall_at_{k}") for k in ks]
    return ranks.agg(F.count("*").alias("total"), *found)


def span_match(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """gold(doc_id, start, end, kind) with match: exact, partial (they overlap) or missed, and whether the type agrees."""
    p = pred.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("kind").alias("_k"))
    meet = gold.join(p, (F.col("doc_id") == F.col("_d")) & (F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e")), "left")
    exact = (F.col("_s") == F.col("start")) & (F.col("_e") == F.col("end"))
    level = F.when(exact, 2).when(F.col("_s").isNotNull(), 1).otherwise(0)
    best = meet.groupBy(*gold.columns).agg(F.max(F.struct(level.alias("l"), F.coalesce(F.col("_k") == F.col("kind"), F.lit(False)).alias("t"))).alias("b"))
    return best.select(*gold.columns, F.when(F.col("b.l") == 2, "exact").when(F.col("b.l") == 1, "partial").otherwise("missed").alias("match"), F.col("b.t").alias("type_match"))


def compare_runs(off: DataFrame, on: DataFrame, key: str) -> DataFrame:
    """off and on(key, correct): improved, degraded, both right or both wrong."""
    rows = off.select(key, F.col("correct").alias("_a")).join(on.select(key, F.col("correct").alias("_b")), key, "full_outer")
    a, b = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    return rows.select(key, F.when(~a & b, "improved").when(a & ~b, "degraded").when(a & b, "both_right").otherwise("both_wrong").alias("change"))


def sweep(rows: DataFrame, thresholds: list[float], correct) -> DataFrame:
    """threshold, total, correct, accuracy at each threshold; ``correct`` makes a condition of a threshold column. Every
    row is read once; the thresholds become an array."""
    grid = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    g = grid.groupBy("threshold").agg(F.count("*").alias("total"), F.count_if(correct(F.col("threshold"))).alias("correct"))
    return g.withColumn("accuracy", F.col("correct") / F.col("total"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold of highest accuracy, the lowest of equals."""
    return swept.agg(F.max_by(F.struct("threshold", "accuracy"), F.struct("accuracy", F.negative("threshold"))).alias("b")).select("b.threshold", "b.accuracy")


def alias_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of rows(expected_id, predicted_id, is_negative, is_ambiguous, has_pressure): recall of positives, precision of
    negatives (nothing is predicted), accuracy of ambiguous positives under candidate pressure, and of all."""
    bad = F.coalesce("is_negative", F.lit(False))
    right = F.when(bad, F.col("predicted_id").isNull()).otherwise(F.coalesce(F.col("predicted_id") == F.col("expected_id"), F.lit(False)))
    hard = ~bad & F.coalesce("is_ambiguous", F.lit(False)) & F.coalesce("has_pressure", F.lit(False))
    share = lambda c: safe_ratio(F.count_if(c & right), F.count_if(c))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(right).alias("correct"), share(~bad).alias("positive_recall"), share(bad).alias("negative_precision"), share(hard).alias("ambiguous_accuracy"), share(F.lit(True)).alias("overall"))


def acceptance_rates(rows: DataFrame) -> DataFrame:
    """Of rows(gold_id, expected_nil, candidate_ids, pred_id): alias recall (gold among the candidates, of rows with gold)
    and disambiguation accuracy (no candidates is right for NIL)."""
    has, nil = F.col("gold_id").isNotNull(), F.coalesce("expected_nil", F.lit(False))
    hit = F.coalesce(has & F.array_contains("candidate_ids", F.col("gold_id")), F.lit(False))
    said = F.when(F.size(F.coalesce("candidate_ids", F.array().cast("array<string>"))) > 0, F.col("pred_id"))
    right = F.when(nil, said.isNull()).otherwise(F.coalesce(said == F.col("gold_id"), F.lit(False)))
    m = rows.agg(F.count_if(hit).alias("candidate_hits"), F.count_if(has).alias("candidate_total"), F.count_if(right).alias("disambiguation_correct"), F.count("*").alias("disambiguation_total"))
    return m.withColumn("alias_recall", safe_ratio(F.col("candidate_hits"), F.col("candidate_total"))).withColumn("disambiguation_accuracy", safe_ratio(F.col("disambiguation_correct"), F.col("disambiguation_total")))


def discourse_metrics(rows: DataFrame, dims: list[str]) -> DataFrame:
    """By each of dims: cases, positives and NILs, how many of each are right, false NILs and wrong sets, of rows(gold_ids, pred_ids);
    an empty set is NIL."""
    g, p = F.array_sort(F.array_distinct("gold_ids")), F.array_sort(F.array_distinct("pred_ids"))
    yes, said = F.size(g) > 0, F.size(p) > 0
    flags = {"positive": yes, "positive_right": yes & (g == p), "nil": ~yes, "nil_right": ~yes & ~said, "false_nil": yes & ~said, "wrong_set": yes & said & (g != p)}
    each = rows.select(*[c.cast("long").alias(k) for k, c in flags.items()], F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("bucket")) for d in dims])).alias("d"))
    return each.groupBy("d.dimension", "d.bucket").agg(F.count("*").alias("total"), *[F.sum(k).alias(k) for k in flags])


def candidate_stats(candidates: DataFrame, key: str) -> DataFrame:
    """Of candidates(key, method, rank, is_gold): mentions, mean candidates, shares of alias and vector candidates, recall at 1, 3, 5."""
    per = candidates.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("method") == "vector").alias("v"), F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("gold_rank"))
    found = [safe_ratio(F.count_if(F.col("gold_rank") <= k), F.count("*")).alias(f"recall_at_{k}") for k in (1, 3, 5)]
    return per.agg(F.count("*").alias("mentions"), F.avg("n").alias("mean_candidates"), safe_ratio(F.sum("v"), F.sum("n")).alias("vector_share"), safe_ratio(F.sum("n") - F.sum("v"), F.sum("n")).alias("alias_share"), *found)


def error_cause(gold_id: Column, pred_id: Column, candidate_ids: Column) -> Column:
    """What went wrong and why: recall (no candidates, or gold is not among them), disambiguation (another was taken, or
    none though gold was there), a NIL that was linked; null where nothing did."""
    among = F.coalesce(F.array_contains(candidate_ids, gold_id), F.lit(False))
    return (
        F.when(gold_id.isNull() & pred_id.isNotNull(), "nil_linked")
        .when(gold_id.isNull() | F.coalesce(gold_id == pred_id, F.lit(False)), F.lit(None))
        .when(F.coalesce(F.size(candidate_ids), F.lit(0)) <= 0, "recall:no_candidates")
        .when(~among, "recall:gold_not_generated")
        .when(pred_id.isNull(), "nil_false_positive:below_threshold")
        .otherwise("disambiguation:other_taken")
    )


def all_cases(sets: dict[str, DataFrame]) -> DataFrame:
    """Cases of several sets with the set's name as source; columns that one lacks are null."""
    out = None
    for name, rows in sets.items():
        one = rows.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def case_target(mentions: Column, index: Column) -> Column:
    """The mention of a case, counted from 0; null beyond the ends."""
    return F.when(index >= 0, F.get(mentions, index))


def sentence_distance(sentence: Column, antecedents: Column) -> Column:
    """The greatest distance in sentences to the antecedents' sentences; 0 without any."""
    return F.coalesce(F.array_max(F.transform(antecedents, lambda a: F.greatest(F.lit(0), sentence - a))), F.lit(0))


def distance_bucket(d: Column) -> Column:
    return F.when(d <= 0, "same").when(d == 1, "next").when(d == 2, "two").otherwise("three_or_more")


def target_type(kinds: Column) -> Column:
    """The type of a set of antecedents, MIXED: and all of them if they differ."""
    k = F.array_sort(F.array_distinct(kinds))
    return F.when(F.size(k) == 0, "UNKNOWN").when(F.size(k) == 1, F.get(k, 0)).otherwise(F.concat(F.lit("MIXED:"), F.array_join(k, "+")))
