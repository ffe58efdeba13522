"""Samples and the validation slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.operators.blocking import address_tokens, geo_tokens, split_sources
from linkspark.operators.config import BlockingConfig
from linkspark.sources.storage import written


def hash_order(key: Column, seed: int = 42) -> Column:
    """A shuffled order that any engine reproduces."""
    return F.md5(F.concat(key, F.lit(f":{seed}")).cast("binary"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each stratum, in shuffled order."""
    order = Window.partitionBy(*strata).orderBy(hash_order(F.col(key), seed), F.col(key))
    return df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).drop("_k")


def greedy_buckets(geo: DataFrame, totals: DataFrame, target: int, max_bucket: int = 2000, seed: int = 42) -> DataFrame:
    """(country, geo_token, n): buckets in shuffled order until a country's share of the target is reached.

    ``totals`` is (country, n_country); a bucket is taken while the sum before it is under the share, rounded.
    """
    everything = Window.partitionBy()
    shares = totals.withColumn("share", F.round(F.col("n_country").cast("double") / F.sum("n_country").over(everything) * target))
    sizes = geo.groupBy("country", "geo_token").agg(F.count("*").alias("n")).filter(F.col("n") <= max_bucket)
    order = Window.partitionBy("country").orderBy(hash_order(F.concat_ws("|", "country", "geo_token"), seed), F.col("geo_token"))
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return sizes.withColumn("before", before).join(shares, "country").filter(F.col("before") < F.col("share")).select("country", "geo_token", "n")


def geo_pool(s1_geo: DataFrame, cand_tokens: DataFrame, ids: DataFrame) -> DataFrame:
    """(cand_id): candidates with any address token that is the rarest of one of the reference ids."""
    keys = s1_geo.join(ids.select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi").select("country", F.col("geo_token").alias("token")).distinct()
    return cand_tokens.join(keys, ["country", "token"], "left_semi").select(F.col("entity_id").alias("cand_id")).distinct()


def owners_of(truth: DataFrame, pool: DataFrame, known: DataFrame) -> DataFrame:
    """(s1_id): reference ids with a true match in the pool, without those already known."""
    owners = truth.join(pool.select("cand_id"), "cand_id", "left_semi").select("s1_id").distinct()
    return owners.join(known.select("s1_id"), "s1_id", "left_anti")


def decoy_rate(pool: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (n_pool, n_owned, n_own, naive, effective): shares of the pool no record owns, or none of ``ids`` does."""
    owned = truth.select("cand_id", "s1_id").distinct().join(ids.select("s1_id").distinct().withColumn("own", F.lit(1)), "s1_id", "left").groupBy("cand_id").agg(F.max("own").alias("own"))
    flags = pool.select("cand_id").distinct().join(owned.withColumn("owned", F.lit(1)), "cand_id", "left")
    sums = flags.agg(F.count("*").alias("n_pool"), F.count("owned").alias("n_owned"), F.count("own").alias("n_own"))
    return sums.withColumn("naive", F.round(1 - F.col("n_own").cast("double") / F.col("n_pool"), 6)).withColumn("effective", F.round(1 - F.col("n_owned").cast("double") / F.col("n_pool"), 6))


def validation_slice(records: DataFrame, truth: DataFrame, target: int, rounds: int = 2, cfg: BlockingConfig = BlockingConfig()) -> DataFrame:
    """(entity_id, business_name, business_address, country, is_eval): sampled buckets, their neighbourhoods and owners.

    The evaluation records come from greedy buckets; the pool holds their place neighbours and true matches; each round
    adds the records that own something in the pool, with their true matches. Only joins; the rounds are few and fixed.
    """
    s1, cand = split_sources(records)
    geo = written(geo_tokens(s1, cfg), "slice-geo")
    totals = s1.groupBy("country").agg(F.count("*").alias("n_country"))
    buckets = greedy_buckets(geo, totals, target)
    ids = written(geo.join(buckets, ["country", "geo_token"], "left_semi").select(F.col("entity_id").alias("s1_id")), "slice-ids")
    tokens = address_tokens(cand, cfg.min_token_len)
    own = truth.join(ids, "s1_id", "left_semi").select("cand_id")
    pool = written(geo_pool(geo, tokens, ids).unionByName(own).distinct(), "slice-pool")
    known = ids
    for _ in range(rounds):
        fresh = owners_of(truth, pool, known)
        known = written(known.unionByName(fresh), "slice-known")
        pool = written(pool.unionByName(truth.join(known, "s1_id", "left_semi").select("cand_id")).distinct(), "slice-pool")
    flagged = s1.join(known.withColumnRenamed("s1_id", "entity_id"), "entity_id", "left_semi").join(ids.select(F.col("s1_id").alias("entity_id"), F.lit(True).alias("is_eval")), "entity_id", "left")
    rest = cand.join(pool.withColumnRenamed("cand_id", "entity_id"), "entity_id", "left_semi").withColumn("is_eval", F.lit(False))
    columns = ["entity_id", "business_name", "business_address", "country"]
    return flagged.select(*columns, F.coalesce("is_eval", F.lit(False)).alias("is_eval")).unionByName(rest.select(*columns, "is_eval"))
