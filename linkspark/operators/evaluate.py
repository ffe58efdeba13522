"""Metrics of kept pairs and of candidate pairs against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.operators.blocking import cap_candidates


def f_beta(tp: Column, n_pred: Column, n_truth: Column, beta: float = 0.5) -> Column:
    """1 if nothing is there and nothing was found, 0 if only one side is empty or nothing is right."""
    b2 = beta * beta
    precision, recall = tp.cast("double") / n_pred, tp.cast("double") / n_truth
    return F.when((n_pred == 0) & (n_truth == 0), 1.0).when((n_pred == 0) | (n_truth == 0) | (tp == 0), 0.0).otherwise((1 + b2) * precision * recall / (b2 * precision + recall))


def entity_counts(preds: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """(s1_id, tp, n_pred, n_truth) for every id; repeated pairs count once."""
    p = preds.select("s1_id", "cand_id").filter("cand_id is not null").distinct().withColumn("p", F.lit(1))
    t = truth.select("s1_id", "cand_id").distinct().withColumn("t", F.lit(1))
    both = p.join(t, ["s1_id", "cand_id"], "full").groupBy("s1_id").agg(F.count(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"), F.count("p").alias("n_pred"), F.count("t").alias("n_truth"))
    return ids.select("s1_id").distinct().join(both, "s1_id", "left").fillna(0, ["tp", "n_pred", "n_truth"])


def entity_f_beta(preds: DataFrame, truth: DataFrame, ids: DataFrame, beta: float = 0.5) -> DataFrame:
    return entity_counts(preds, truth, ids).withColumn("f", f_beta(F.col("tp"), F.col("n_pred"), F.col("n_truth"), beta))


def macro_f_beta(preds: DataFrame, truth: DataFrame, ids: DataFrame, beta: float = 0.5) -> DataFrame:
    """One row (f): the mean over all ids, 0 if there are none."""
    return entity_f_beta(preds, truth, ids, beta).agg(F.coalesce(F.avg("f"), F.lit(0.0)).alias("f"))


def micro_pr(preds: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (tp, n_pred, n_truth, precision, recall); NaN over nothing."""
    sums = entity_counts(preds, truth, ids).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "n_pred", "n_truth")])
    share = lambda c: F.when(F.col(c) == 0, F.lit(float("nan"))).otherwise(F.col("tp").cast("double") / F.col(c))
    return sums.withColumn("precision", share("n_pred")).withColumn("recall", share("n_truth"))


def singleton_accuracy(preds: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (accuracy): of ids without a true match, the share for which none was kept; null if there are none."""
    return entity_counts(preds, truth, ids).filter("n_truth = 0").agg(F.avg((F.col("n_pred") == 0).cast("double")).alias("accuracy"))


def group_metrics(preds: DataFrame, truth: DataFrame, ids: DataFrame, groups: DataFrame, beta: float = 0.5) -> DataFrame:
    """(grp, n, f) by the groups (s1_id, grp) of ids; an id without one is in unknown."""
    scored = entity_f_beta(preds, truth, ids, beta).join(groups.select("s1_id", "grp"), "s1_id", "left")
    return scored.groupBy(F.coalesce("grp", F.lit("unknown")).alias("grp")).agg(F.count("*").alias("n"), F.avg("f").alias("f"))


def score_report(preds: DataFrame, truth: DataFrame, ids: DataFrame, groups: DataFrame) -> DataFrame:
    """(metric, grp, value) of all metrics."""
    one = micro_pr(preds, truth, ids)
    parts = [
        macro_f_beta(preds, truth, ids).select(F.lit("macro_f").alias("metric"), F.lit("all").alias("grp"), F.col("f").alias("value")),
        one.select(F.lit("micro_precision").alias("metric"), F.lit("all").alias("grp"), F.col("precision").alias("value")),
        one.select(F.lit("micro_recall").alias("metric"), F.lit("all").alias("grp"), F.col("recall").alias("value")),
        singleton_accuracy(preds, truth, ids).select(F.lit("singleton_accuracy").alias("metric"), F.lit("all").alias("grp"), F.col("accuracy").alias("value")),
        group_metrics(preds, truth, ids, groups).select(F.lit("macro_f").alias("metric"), "grp", F.col("f").alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def found_truth(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """Truth (s1_id, cand_id, country) with blocks, null where no block found the pair."""
    return truth.join(pairs.select("s1_id", "cand_id", "blocks"), ["s1_id", "cand_id"], "left")


def blocking_recall(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """(scope, grp, n_truth, n_found, recall): over all, by country, and by the candidate's source."""
    found = found_truth(truth, pairs)
    pairs_of = {"all": F.lit("all"), "country": F.col("country"), "source": F.substring("cand_id", 1, 2)}
    scopes = F.explode(F.array(*[F.struct(F.lit(scope).alias("scope"), grp.alias("grp")) for scope, grp in pairs_of.items()])).alias("g")
    per = found.select("blocks", scopes).groupBy("g.scope", "g.grp").agg(F.count("*").alias("n_truth"), F.count("blocks").alias("n_found"))
    return per.withColumn("recall", F.round(F.col("n_found").cast("double") / F.col("n_truth"), 6))


def block_marginal(truth: DataFrame, pairs: DataFrame, names: list[str]) -> DataFrame:
    """(block, n_alone, n_without, n_found): true pairs a block finds, and what is left without it, in one aggregate."""
    found = found_truth(truth, pairs).select(F.split(F.coalesce("blocks", F.lit("")), ",").alias("b"), F.col("blocks").isNotNull().alias("hit"))
    rows = found.select("b", "hit", F.explode(F.array(*map(F.lit, names))).alias("block"))
    has = F.array_contains("b", F.col("block"))
    return rows.groupBy("block").agg(F.count(F.when(has, 1)).alias("n_alone"), F.count(F.when(F.col("hit") & ~(has & (F.size("b") == 1)), 1)).alias("n_without"), F.count(F.when(F.col("hit"), 1)).alias("n_found"))


def candidate_stats(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (n, avg, p99, max) of candidates per id, none counted as 0."""
    sizes = ids.select("s1_id").distinct().join(pairs.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").fillna(0, ["n"])
    return sizes.agg(F.count("*").alias("n_ids"), F.round(F.avg("n"), 6).alias("avg_n"), F.round(F.expr("percentile(n, 0.99)"), 6).alias("p99_n"), F.max("n").alias("max_n"))


def miss_universe(truth: DataFrame, union: DataFrame) -> DataFrame:
    """True pairs that no block found."""
    return truth.join(union.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")


def cap_loss(truth: DataFrame, union: DataFrame, capped: DataFrame) -> DataFrame:
    """(country, n_lost): true pairs that blocks found and the cap cut."""
    found = truth.join(union.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_semi")
    return found.join(capped.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti").groupBy("country").agg(F.count("*").alias("n_lost"))


def worst_misses(truth: DataFrame, union: DataFrame, records: DataFrame, n: int = 30) -> DataFrame:
    """The first missed pairs, with both names."""
    missed = miss_universe(truth, union).orderBy("s1_id", "cand_id").limit(n)
    names = records.select("entity_id", "business_name")
    a, b = names.toDF("s1_id", "name_a"), names.toDF("cand_id", "name_b")
    return missed.join(a, "s1_id", "left").join(b, "cand_id", "left").select("s1_id", "cand_id", "country", "name_a", "name_b")


def cap_sweep(truth: DataFrame, scored: DataFrame, caps: list[int]) -> DataFrame:
    """(cap, n_pairs, n_found, recall): ranks are assigned once and counted at each cap."""
    ranked = cap_candidates(scored, 1 << 30).select("s1_id", "cand_id", "rank").join(truth.select("s1_id", "cand_id").withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    grid = ranked.select("rank", "hit", F.explode(F.array(*map(F.lit, caps))).alias("cap")).filter("rank <= cap")
    total = truth.agg(F.count("*").alias("n_truth"))
    per = grid.groupBy("cap").agg(F.count("*").alias("n_pairs"), F.count("hit").alias("n_found")).join(F.broadcast(total))
    return per.select(F.col("cap").cast("long").alias("cap"), "n_pairs", "n_found", F.round(F.col("n_found").cast("double") / F.col("n_truth"), 6).alias("recall"))
