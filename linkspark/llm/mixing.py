"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, a water level turns weights into targets that no source repeats too often, and each
document is then emitted floor(rate) times plus once more with a probability equal to the fraction, decided by a
hash of its id. Only (id, source, size) rows move; texts are read twice at most and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.llm.storage import materialize, spare

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the id alone, so that reruns and retries agree. A null id draws as one id."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _in_order(rows: DataFrame, order: Sequence[Column], sums: Sequence[str], name: str) -> DataFrame:
    """``rows`` with _place, their place in an order, and _before_<column>, the sum of a column over all rows before.

    Each range of the order is numbered and summed by a task of its own; what the ranges before it hold is added, a row a range.
    """
    dealt = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    first, before = Window.partitionBy("_range").orderBy(*order), Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy("_range").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    offsets = held.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"), *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0.0)).alias(f"_sum_{c}") for c in sums])
    earlier = first.rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", F.row_number().over(first).alias("_local"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"_here_{c}") for c in sums])
    placed = local.join(F.broadcast(offsets), "_range")
    return placed.select(*rows.columns, (F.col("_rows") + F.col("_local") - 1).alias("_place"), *[(F.col(f"_sum_{c}") + F.col(f"_here_{c}")).alias(f"_before_{c}") for c in sums])


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target): one row per source from rows (source, size).

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. A target stops
    at ``max_repeat`` times its source; the excess is shared again by weight. With sources sorted by cap / weight
    the level that fills all is the largest (total - caps before) / (weights from here on), so running sums over one
    row per source replace the iteration. Sources of size 0 get 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    weighed = _in_order(totals, [by_name], [], "sources").withColumn("weight", weight).drop("_place")
    capped = weighed.withColumn("cap", F.col("source_size").cast("double") * F.lit(float(max_repeat))).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = _in_order(capped, [F.col("ratio").asc(), by_name], ["cap", "weight"], "sources-by-cap")
    every = filled.agg(F.sum("source_size").cast("double").alias("_all"), F.sum("weight").alias("_weights"))
    level = filled.join(F.broadcast(every)).withColumn("level", (F.col("_all") - F.col("_before_cap")) / (F.col("_weights") - F.col("_before_weight")))
    level = materialize(level.select("source", "source_size", "cap", "weight", "level"), "levels")
    highest = level.agg(F.max("level").alias("_level"))
    return level.join(F.broadcast(highest)).select("source", "source_size", F.least("cap", F.col("_level") * F.col("weight")).alias("target"))


def plan_mix(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, source, size) plus source_size, target, copies and taken = size * copies.

    Null ids draw alike, rows that share an id get the same number of copies, empty texts have size 0 and take 0.
    """
    targets = source_targets(sizes, weights, max_repeat).withColumnRenamed("source", "target_source")
    joined = sizes.join(targets, sizes["source"].eqNullSafe(targets["target_source"])).drop("target_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("rate", rate).withColumn("copies", F.floor("rate") + extra).withColumn("taken", F.col("size") * F.col("copies")).drop("rate")


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size), written once so that the sum and the draw share one pass over the texts."""
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``.

    The rate of a source joins its rows by source name (a third of all rows may share it: the small side has one row
    per source and the join splits or broadcasts it). An empty table gives an empty one.
    """
    name, rate, copy = (spare(docs, x) for x in ("_mix_source", "_mix_rate", "_mix_copy"))
    rates = source_targets(sizes_of(docs), weights, max_repeat)
    rates = rates.select(F.col("source").alias(name), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(rate))
    rates = materialize(rates, "rates")  # its size is then known before the join is planned
    joined = docs.join(rates, docs["source"].eqNullSafe(F.col(name)))
    copies = F.floor(rate).cast("int") + (draw(F.col("doc_id"), seed) < F.col(rate) - F.floor(rate)).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan_mix(sizes_of(docs)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM sizes GROUP BY source
), capped AS (
  SELECT *, ((rn - 1) % 3 + 1)::DOUBLE AS weight, source_size::DOUBLE * 3.0 AS cap FROM totals
), level AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped
), targets AS (
  SELECT source, source_size, least(cap, (max(level) OVER ()) * weight) AS target FROM level
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
