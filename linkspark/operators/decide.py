"""From scored pairs (s1_id, cand_id, proba) to the pairs that are kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.operators.config import DecideConfig
from linkspark.operators.evaluate import f_beta, macro_f_beta
from linkspark.sources.storage import written


def one_to_one(scored: DataFrame) -> DataFrame:
    """Each candidate keeps its best reference record; ties go to the least id."""
    best = Window.partitionBy("cand_id").orderBy(F.col("proba").desc(), F.col("s1_id"))
    return scored.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")


def global_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.filter(F.col("proba") >= threshold).select("s1_id", "cand_id")


def expected_f_subset(scored: DataFrame, beta: float = 0.5) -> DataFrame:
    """Of each record's candidates by falling probability, the shortest prefix with the best expected F-beta.

    Keeping none scores the product of (1 - p); keeping k scores F-beta of cum / k and cum / total. Running sums are
    rounded to nine places before they are compared.
    """
    b2 = beta * beta
    all_rows = Window.partitionBy("s1_id")
    order = all_rows.orderBy(F.col("proba").desc(), F.col("cand_id"))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    p = scored.withColumn("k", F.row_number().over(order)).withColumn("cum", F.sum("proba").over(run)).withColumn("total", F.sum("proba").over(all_rows))
    none = F.aggregate(F.array_sort(F.collect_list("proba").over(all_rows)), F.lit(1.0), lambda acc, x: acc * (1 - x))
    precision, recall = F.col("cum") / F.col("k"), F.when(F.col("total") > 0, F.col("cum") / F.col("total")).otherwise(0.0)
    bottom = b2 * precision + recall
    f = F.when(bottom > 0, (1 + b2) * precision * recall / bottom).otherwise(0.0)
    judged = p.withColumn("none", F.round(none, 9)).withColumn("f", F.round(f, 9))
    judged = judged.withColumn("best", F.max("f").over(all_rows))
    judged = judged.withColumn("at", F.min(F.when(F.col("f") == F.col("best"), F.col("k"))).over(all_rows))
    return judged.filter((F.col("best") > F.col("none")) & (F.col("k") <= F.col("at"))).select("s1_id", "cand_id")


def threshold_scores(scored: DataFrame, truth: DataFrame, ids: DataFrame, thresholds: Sequence[float], beta: float = 0.5) -> DataFrame:
    """(threshold, f): macro F-beta over ``ids`` at every threshold, by one pass over pairs repeated per threshold."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    hits = scored.join(truth.select("s1_id", "cand_id").distinct().withColumn("_hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    kept = hits.select("s1_id", "proba", F.coalesce("_hit", F.lit(0)).alias("hit"), grid).filter("proba >= threshold")
    per = kept.groupBy("threshold", "s1_id").agg(F.count("*").alias("n_pred"), F.sum("hit").alias("tp"))
    wanted = truth_sizes(truth, ids).select("s1_id", "n_truth", grid)
    joined = wanted.join(per, ["threshold", "s1_id"], "left").fillna(0, ["n_pred", "tp"])
    return joined.groupBy("threshold").agg(F.round(F.avg(f_beta(F.col("tp"), F.col("n_pred"), F.col("n_truth"), beta)), 9).alias("f"))


def truth_sizes(truth: DataFrame, ids: DataFrame) -> DataFrame:
    sizes = truth.select("s1_id", "cand_id").distinct().groupBy("s1_id").agg(F.count("*").alias("n_truth"))
    return ids.select("s1_id").distinct().join(sizes, "s1_id", "left").fillna(0, ["n_truth"])


def tune_threshold(scored: DataFrame, truth: DataFrame, ids: DataFrame, cfg: DecideConfig = DecideConfig()) -> DataFrame:
    """One row (threshold, f): the best threshold, the least among equals."""
    return threshold_scores(scored, truth, ids, cfg.thresholds, cfg.beta).orderBy(F.col("f").desc(), "threshold").limit(1)


def decide(scored: DataFrame, ids: DataFrame, truth: DataFrame | None = None, cfg: DecideConfig = DecideConfig()) -> DataFrame:
    """(s1_id, cand_id or null, policy): a row for each kept pair, and one for each id of ``ids`` that keeps none.

    With a truth, the tuned threshold is taken if it beats the expected-F subset on ``ids``, strictly.
    """
    single = written(one_to_one(scored), "one-to-one")
    subset = written(expected_f_subset(single, cfg.beta), "subset")
    kept, policy = subset, "expected_f"
    if truth is not None:
        own = single.join(ids.select("s1_id").distinct(), "s1_id", "left_semi")
        tuned = tune_threshold(own, truth, ids, cfg).first()
        base = macro_f_beta(subset, truth, ids, cfg.beta).first()["f"]
        if tuned is not None and tuned["f"] > round(base or 0.0, 9):
            kept, policy = global_threshold(single, tuned["threshold"]), f"threshold_{tuned['threshold']:g}"
    return ids.select("s1_id").distinct().join(kept, "s1_id", "left").withColumn("policy", F.lit(policy))
